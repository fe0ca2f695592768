"""Matching, block and file queries over parts, embeddings, documents, orders and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..operators import matching as M
from ..operators import ranking as R
from ..operators.scoring import band_name
from . import ranking
from .ranking import _t

THRESHOLD = 0.62


def _aliases(spark, sf_dir):
    p = _t(spark, sf_dir, "part").filter("p_size % 2 = 0 AND p_partkey % 40 < 9")
    return p.select(F.lower("p_name").alias("alias_norm"), F.concat(F.lit("c"), F.col("p_partkey") % 40).alias("canonical_id"))


def _nearest(spark, sf_dir):
    """The distance of each name to the concepts (labels): the least of their vectors to the vector that the name's first part has."""
    v = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    n = _t(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("norm")).agg((F.min("p_partkey") % 100).alias("query")).filter("query % 7 > 0")
    q = v.join(n.select(F.col("query").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("query"), F.col("label").alias("expected"), F.col("v").alias("q"))
    best = M.best_of_labels(v, q).select("query", F.concat(F.lit("c"), "label").alias("canonical_id"), F.round(1 - F.col("s"), 9).alias("distance"))
    return n.join(best, "query").select("norm", "canonical_id", "distance")


def _asked(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.upper("p_name"))).alias("raw"))


def _matched(spark, sf_dir):
    cache = _t(spark, sf_dir, "part").filter("p_partkey % 97 = 5").select(F.lower("p_name").alias("norm"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("k"), "p_size")).alias("concept_id"), F.lit(0.5).alias("distance")).groupBy("norm").agg(F.max("concept_id").alias("concept_id"), F.max("distance").alias("distance"))
    return M.matched(_asked(spark, sf_dir), _aliases(spark, sf_dir), _nearest(spark, sf_dir), THRESHOLD, cache)


def matched_skills(spark, sf_dir):
    df = _matched(spark, sf_dir)
    return df.select("p_partkey", "norm", "tier", "concept_id", F.round("distance", 6).alias("distance"), F.array_join("candidates", ",").alias("candidates"), F.array_join("warnings", ",").alias("warnings"))


def cached_matches(spark, sf_dir):
    """What is worth keeping, by its key."""
    df = M.matched(_asked(spark, sf_dir), _aliases(spark, sf_dir), _nearest(spark, sf_dir))
    return df.filter(M.is_cacheable(F.col("warnings"))).select(M.cache_key("ix", "p1", F.col("norm")).alias("key"), "tier").distinct()


def recall_of_labels(spark, sf_dir):
    """Whether the label of a vector is among the labels of its nearest ones, itself left out."""
    v = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("expected"), F.col("v").alias("q"))
    best = M.best_of_labels(v, q).withColumn("s", F.round("s", 9))
    place = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "label"))).groupBy("query").agg(F.max(F.when(F.col("label") == F.col("expected"), F.col("place"))).alias("place"))
    return place.agg(*(F.round(M.recall_at(place, k), 6).alias(f"at_{k}") for k in (1, 3, 5)))


def verdict_checks(spark, sf_dir):
    """Lines as verdicts on the first four places of an order."""
    ln = _t(spark, sf_dir, "lineitem")
    v = ln.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("pos"), F.concat(F.lit(" items["), F.col("l_suppkey") % 6, F.lit("] ")).alias("path"), F.col("l_returnflag").alias("verdict"))
    known = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("l_orderkey", F.concat(F.lit("items["), "i", F.lit("]")).alias("path"))
    kept, counts = M.checked_verdicts(v, known, "l_orderkey")
    n = kept.groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.count_if(F.col("verdict") == "R").alias("r"))
    return counts.join(n, "l_orderkey", "left")


def migrations(spark, sf_dir):
    p, s = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "supplier")
    files = p.filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("version"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("checksum"))
    log = s.select(F.col("s_suppkey").alias("version"), F.col("s_name").alias("name"), (F.col("s_nationkey") * 2).cast("string").alias("checksum"))
    return M.migration_states(files, log)


def updated_ranking(spark, sf_dir):
    """The first five vacancies after a candidate added skills and took some back."""
    c = ranking.candidates(spark, sf_dir)
    n = spark.range(30).select(F.col("id").alias("pos"), (F.col("id") * 31 % 1000).alias("key"))
    added = c.select("candidate_id").crossJoin(F.broadcast(n)).withColumn("key", (F.col("key") + F.col("candidate_id")) % 1000)
    removed = c.select("candidate_id", F.explode("keys").alias("key")).filter("key % 4 = 0")
    df = R.scored(R.pairs(ranking.vacancies(spark, sf_dir), M.with_skills(c, added, removed), ranking.vectors(spark, sf_dir)), floor=ranking.FLOOR, ceil=ranking.CEIL)
    return R.working_set(df, 5).select("candidate_id", "rank", "vacancy_id", band_name(F.col("band_rank")).alias("band"), F.round("fit", 6).alias("fit"))


def document_blocks(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.explode(B.plain_blocks(F.coalesce("text", F.lit("")))).alias("b")).select("doc_id", "b.*")
    return d.select("doc_id", "start", "end", F.sha2("text", 256).alias("hash"))


def assembled_turns(spark, sf_dir):
    """Turns of a conversation as blocks of one text."""
    c = _t(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return B.assembled(c, "conv_id", "turn").select("conv_id", "turn", "start", "end")


def heading_keys(spark, sf_dir):
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.concat(F.when(k % 4 == 0, "• ").when(k % 4 == 1, "12) ").when(k % 4 == 2, "iv. ").otherwise(""), F.when(k % 5 == 0, F.regexp_replace(F.upper("p_type"), "(.)", "$1 ")).otherwise(F.initcap("p_name")), F.when(k % 3 == 0, " :").when(k % 3 == 1, F.lit("'s & Co. — ")).otherwise(""))
    return p.select("p_partkey", B.heading_key(text).alias("key"))


def match_keys(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    text = F.concat(F.initcap("c_mktsegment"), F.lit("'s (No. "), F.col("c_custkey").cast("string"), F.lit(") / \"R&amp;D\" – "), F.col("c_name"), F.lit("  "))
    return c.select("c_custkey", B.match_key(text).alias("key"))


def warning_codes(spark, sf_dir):
    e, k = _t(spark, sf_dir, "events"), F.col("event_id") % 6
    text = F.when(k == 0, "quote not found: ").when(k == 1, "experience 'x': no start date, not counted").when(k == 2, "experience 'x': ends before it starts").when(k == 3, "experience 'x': other").when(k == 4, "possible personal data in output at ").otherwise("no end date")
    return e.select("event_type", B.warning_code(F.concat(text, F.col("event_type"))).alias("code")).groupBy("event_type", "code").agg(F.count("*").alias("n"))


def known_inputs(spark, sf_dir):
    """Countries and industries that are known among what customers give."""
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    code = F.concat(F.lit(" "), F.lower(F.concat(F.substring("c_mktsegment", 1, 1), F.substring(F.reverse("c_mktsegment"), 1, 1))), F.lit(" "))
    given = F.array(F.lit("mlm"), F.lower("c_mktsegment"), F.when(k % 2 == 0, "crypto").otherwise("gambling"), F.lit("crypto"))
    return c.select("c_custkey", B.known_country(code).alias("country"), F.array_join(B.known_niches(given), ",").alias("niches"))


def shown_parts(spark, sf_dir):
    ln = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_orderkey") % 100).agg(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string")).alias("p"))
    return ln.select("l_suppkey", B.shown(F.col("p")).alias("text")).groupBy("l_suppkey", "text").agg(F.count("*").alias("n"))


def csv_rows(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", B.csv_row(F.col("o_orderkey"), F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit('say "'), "o_orderpriority", F.lit('", twice')))).alias("row"))


def feedback_lines(spark, sf_dir):
    """Customers as rated cards in a file of JSON lines, some of them broken."""
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    text = F.to_json(F.struct(F.when(k % 11 > 0, F.concat(F.lit("s"), F.col("c_nationkey"))).alias("session"), F.col("c_name").alias("vacancy_id"), (F.col("c_acctbal") / 9000).alias("skill"), (k % 2 + (k % 13 == 0).cast("int")).alias("label")))
    good, bad = B.read_feedback(c.select(k.alias("line"), F.when(k % 17 == 0, F.concat(F.lit("{"), text)).when(k % 19 == 0, " ").otherwise(text).alias("text")))
    return good.groupBy("session").agg(F.count("*").alias("n"), F.sum("label").alias("useful")).unionByName(bad.agg(F.lit("bad").alias("session"), F.count("*").alias("n"), F.sum("line").alias("useful")))


QUERIES = {f.__name__: f for f in (matched_skills, cached_matches, recall_of_labels, verdict_checks, migrations, updated_ranking, document_blocks, assembled_turns, heading_keys, match_keys, warning_codes, known_inputs, shown_parts, csv_rows, feedback_lines)}

_M = f"""WITH a AS (SELECT DISTINCT lower(p_name) AS norm, 'c' || (p_partkey % 40) AS id FROM part WHERE p_size % 2 = 0 AND p_partkey % 40 < 9), x AS (SELECT norm, list(id ORDER BY id) AS ex FROM a GROUP BY 1),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT norm, v AS q, own FROM (SELECT lower(p_name) AS norm, min(p_partkey) % 100 AS own FROM part GROUP BY 1) JOIN v ON vec_id = own WHERE own % 7 > 0),
d AS (SELECT norm, 'c' || label AS id, round(1 - max(list_dot_product(v, q)), 9) AS d FROM v JOIN q ON vec_id <> own GROUP BY 1, 2), n AS (SELECT norm, list(id ORDER BY d, id)[1:5] AS ids, min(d) AS d FROM d GROUP BY 1),
h AS (SELECT lower(p_name) AS norm, max(CASE WHEN p_size % 2 = 0 THEN 'k' || p_size END) AS cid FROM part WHERE p_partkey % 97 = 5 GROUP BY 1),
k AS (SELECT p_partkey, CASE WHEN p_size % 10 = 3 THEN '' ELSE lower(p_name) END AS norm FROM part)
"""
ORACLES = {
    "matched_skills": _M + f"""SELECT p_partkey, k.norm, CASE WHEN k.norm = '' THEN 'unmatched' WHEN h.norm IS NOT NULL THEN CASE WHEN cid IS NULL THEN 'unmatched' ELSE 'cache' END WHEN len(ex) = 1 THEN 'exact' WHEN len(ex) > 1 THEN 'unmatched' WHEN n.d <= {THRESHOLD} THEN 'vector' ELSE 'unmatched' END AS tier,
CASE WHEN h.norm IS NOT NULL THEN cid WHEN len(ex) = 1 THEN ex[1] WHEN len(ex) > 1 THEN NULL WHEN n.d <= {THRESHOLD} THEN ids[1] END AS concept_id, round(CASE WHEN h.norm IS NOT NULL THEN 0.5 WHEN len(ex) = 1 THEN 0 WHEN len(ex) > 1 THEN NULL WHEN n.d <= {THRESHOLD} THEN n.d END, 6) AS distance,
CASE WHEN k.norm = '' OR h.norm IS NOT NULL THEN '' WHEN len(ex) >= 1 THEN array_to_string(ex[1:5], ',') ELSE coalesce(array_to_string(ids, ','), '') END AS candidates,
CASE WHEN k.norm = '' THEN 'empty_skill' WHEN h.norm IS NOT NULL OR len(ex) = 1 THEN '' WHEN len(ex) > 1 THEN 'ambiguous_alias,llm_unavailable' WHEN n.d <= {THRESHOLD} THEN '' WHEN n.norm IS NULL THEN 'no_candidates' ELSE 'llm_unavailable' END AS warnings
FROM k LEFT JOIN h ON h.norm = k.norm LEFT JOIN x ON x.norm = k.norm LEFT JOIN n ON n.norm = k.norm""",
    "cached_matches": _M + "SELECT DISTINCT 'ix|p1|' || k.norm AS key, 'exact' AS tier FROM k JOIN x ON x.norm = k.norm WHERE len(ex) = 1",
    "recall_of_labels": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), b AS (SELECT q.vec_id AS query, q.label AS expected, v.label, round(max(list_dot_product(v.v, q.v)), 9) AS s FROM v JOIN v q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, label) AS place FROM b), p AS (SELECT query, max(place) FILTER (label = expected) AS place FROM r GROUP BY 1)
SELECT round(count(*) FILTER (place <= 1) / CAST(count(*) AS DOUBLE), 6) AS at_1, round(count(*) FILTER (place <= 3) / CAST(count(*) AS DOUBLE), 6) AS at_3, round(count(*) FILTER (place <= 5) / CAST(count(*) AS DOUBLE), 6) AS at_5 FROM p""",
    "verdict_checks": """WITH l AS (SELECT l_orderkey, l_suppkey % 6 AS i, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 6 ORDER BY l_linenumber, l_partkey, l_quantity) AS n, l_orderkey IN (SELECT o_orderkey FROM orders) AND l_suppkey % 6 < 4 AS ok FROM lineitem),
c AS (SELECT l_orderkey, count(*) FILTER (NOT ok) AS unknown, count(*) FILTER (ok AND n > 1) AS duplicates, count(*) FILTER (ok AND n = 1) AS kept, count(*) FILTER (ok AND n = 1 AND f = 'R') AS r FROM l GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS l_orderkey, coalesce(unknown, 0) AS unknown, coalesce(duplicates, 0) AS duplicates, CASE WHEN o_orderkey IS NULL THEN 0 ELSE 4 - coalesce(kept, 0) END AS unjudged, nullif(kept, 0) AS kept, CASE WHEN kept > 0 THEN r END AS r FROM orders FULL JOIN c ON l_orderkey = o_orderkey""",
    "migrations": "SELECT coalesce(p_partkey, s_suppkey) AS version, coalesce(p_name, s_name) AS name, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN s_suppkey IS NULL THEN 'pending' WHEN p_size = s_nationkey * 2 THEN 'applied' ELSE 'changed' END AS state FROM (SELECT * FROM part WHERE p_partkey % 3 > 0) FULL JOIN supplier ON s_suppkey = p_partkey",
    "updated_ranking": ranking._BASE.replace("ck AS (SELECT DISTINCT c_nationkey AS candidate_id, l_partkey % 1000 AS key FROM", "ck0 AS (SELECT DISTINCT c_nationkey AS candidate_id, l_partkey % 1000 AS key FROM").replace("cand AS (SELECT", "ck AS (SELECT * FROM ck0 WHERE key % 4 <> 0 UNION SELECT n_nationkey, (i * 31 % 1000 + n_nationkey) % 1000 FROM nation, range(20) t(i)),\ncand AS (SELECT") + "SELECT candidate_id, rank, vacancy_id, CASE band_rank WHEN 0 THEN 'strong' WHEN 1 THEN 'partial' WHEN 2 THEN 'weak' ELSE 'unscored' END AS band, round(fit, 6) AS fit FROM r WHERE rank <= 5 AND fit IS NOT NULL",
    "document_blocks": r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM l),
s AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM x)
SELECT doc_id, CAST(s AS INT) AS start, CAST(s + length(t) AS INT) AS "end", sha256(t) AS hash FROM s WHERE regexp_matches(t, '\S')""",
    "assembled_turns": """WITH s AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations) SELECT conv_id, turn, CAST(s AS BIGINT) AS start, CAST(s + n AS BIGINT) AS "end" FROM s""",
    "heading_keys": r"""SELECT p_partkey, trim(CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 3 = 1 THEN regexp_replace(lower(p_type), '(.)', '\1 ', 'g') || 's & co ' ELSE lower(p_type) END ELSE lower(p_name) || CASE WHEN p_partkey % 3 = 1 THEN 's & co ' ELSE '' END END) AS key FROM part""",
    "match_keys": "SELECT c_custkey, lower(c_mktsegment) || 's no ' || c_custkey || ' r&d ' || lower(c_name) AS key FROM customer",
    "warning_codes": """SELECT event_type, CASE event_id % 6 WHEN 0 THEN 'quote_not_found' WHEN 1 THEN 'experience_no_start' WHEN 2 THEN 'experience_reversed' WHEN 4 THEN 'possible_personal_data' ELSE 'extraction_warning' END AS code, count(*) AS n FROM events GROUP BY 1, 2""",
    "known_inputs": "SELECT c_custkey, CASE WHEN upper(c_mktsegment[1:1] || c_mktsegment[-1:]) IN (" + ", ".join(f"'{c}'" for c in B.COUNTRIES) + ") THEN upper(c_mktsegment[1:1] || c_mktsegment[-1:]) END AS country, CASE WHEN c_custkey % 2 = 0 THEN 'crypto,mlm' ELSE 'gambling,crypto,mlm' END AS niches FROM customer",
    "shown_parts": """WITH g AS (SELECT l_suppkey, l_orderkey % 100 AS k, list_sort(list(DISTINCT l_partkey)) AS p FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, array_to_string(p[1:6], ', ') || CASE WHEN len(p) > 6 THEN ' +' || (len(p) - 6) || ' more' ELSE '' END AS text, count(*) AS n FROM g GROUP BY 1, 2""",
    "csv_rows": """SELECT o_orderkey, o_orderkey || ',' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || ',' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '"say ""' || o_orderpriority || '"", twice"' END AS row FROM orders""",
    "feedback_lines": """WITH c AS (SELECT *, c_custkey AS k, c_custkey % 2 + CAST(c_custkey % 13 = 0 AS INT) AS label, c_acctbal / 9000 AS skill FROM customer WHERE NOT (c_custkey % 19 = 0 AND c_custkey % 17 > 0)),
g AS (SELECT *, k % 17 > 0 AND k % 11 > 0 AND label <= 1 AND skill BETWEEN 0 AND 1 AS ok FROM c)
SELECT 's' || c_nationkey AS session, count(*) AS n, CAST(sum(label) AS BIGINT) AS useful FROM g WHERE ok GROUP BY 1 UNION ALL SELECT 'bad', count(*), CAST(sum(k) AS BIGINT) FROM g WHERE NOT ok""",
}
