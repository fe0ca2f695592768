"""Queries of feeds, sections, tags, weights, adjustments and sessions that complete the areas of the other modules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import requirements as Q
from ..operators import comparison as C
from ..operators import evaluate as E
from ..operators import ranking as R
from ..operators.records import loader_order
from ..sources import postings as G
from . import ranking, understanding
from .comparison import _cards
from .ranking import _t

SEEN = "1997-01-01"


def _pages(rows, item, path, size=50):
    """Pages of ``size`` items in the order of ``k``."""
    at = F.struct(F.col("k"), item.alias("i"))
    pages = rows.groupBy(F.floor(F.col("k") / size).alias("page")).agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["i"]).alias(path))
    return pages.select("page", F.to_json(F.struct(path)).alias("body"))


def arbeitnow_postings(spark, sf_dir):
    """Orders as a feed that marks remote postings; every other one is."""
    o = _t(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    item = F.struct(F.concat(F.lit("s"), F.col("k") % 9000).alias("slug"), F.concat(F.lit("https://b.example/"), "k").alias("url"), F.when(F.col("k") % 9 > 0, F.col("o_orderpriority")).otherwise(" ").alias("title"), F.when(F.col("k") % 5 > 0, F.col("k") % 2 == 0).alias("remote"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.array(F.lit("a"), F.col("o_orderstatus")).alias("tags"), F.array("o_orderstatus", "o_orderpriority").alias("job_types"))
    kept, _ = G.parsed_run(_pages(o, item, "data"), "arbeitnow")
    return kept.select("source_id", "url", "title", F.unix_timestamp("posted_at").alias("posted"), F.array_join("tags", ",").alias("tags"), "employment_type")


def themuse_counts(spark, sf_dir):
    """Customers as a feed whose places say whether a posting is remote."""
    c = _t(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    places = F.array(F.struct(F.col("c_mktsegment").alias("name")), F.struct(F.when(F.col("k") % 4 == 0, "Flexible / Remote").when(F.col("k") % 4 == 1, "REMOTE, US").otherwise("Oslo").alias("name")))
    item = F.struct("k", F.col("k").alias("id"), F.when(F.col("k") % 6 > 0, F.col("c_name")).alias("name"), F.struct(F.concat(F.lit("https://m.example/"), "k").alias("landing_page")).alias("refs"), F.when(F.col("k") % 10 > 0, places).alias("locations"))
    return G.parsed_run(_pages(c, item, "results", 20), "themuse")[1]


def jooble_ids(spark, sf_dir):
    """Parts as a feed in which some items have no id, so that their link stands for them."""
    p = _t(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    item = F.struct(F.when(F.col("k") % 3 > 0, F.col("k").cast("string")).otherwise("").alias("id"), F.concat(F.lit("https://j.example/"), F.col("k") % 500).alias("link"), F.col("p_name").alias("title"), F.lit(" ").alias("company"))
    return G.parsed_run(_pages(p, item, "jobs", 30), "jooble")[0].select("source_id", "url", "company", "description_is_excerpt")


def loaded_since(spark, sf_dir):
    """Postings of urgent sources seen since a day, as the loader orders them."""
    o = _t(spark, sf_dir, "orders").filter((F.col("o_orderpriority") <= "2-HIGH") & (F.col("o_orderdate") >= F.lit(SEEN).cast("timestamp")))
    o = o.select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("source_id"), F.col("o_orderdate").alias("posted_at"))
    return loader_order(o).select("source", "source_id", "place")


def section_fill(spark, sf_dir):
    """Lines of an order as lines of a posting: some are headings, some titles; which section the others stand in."""
    ln = _t(spark, sf_dir, "lineitem")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    text = F.when(F.col("l_partkey") % 5 == 0, F.element_at(F.array(*map(F.lit, understanding.HEADS)), (F.col("l_partkey") % len(understanding.HEADS) + 1).cast("int"))).otherwise(F.concat(F.lit("line of part "), "l_partkey"))
    lines = ln.select("l_orderkey", at.alias("at"), "l_partkey", text.alias("text"), (F.col("l_partkey") % 10 == 0).alias("heading"), (F.col("l_partkey") % 7 == 1).alias("title"))
    return Q.sectioned(lines, "l_orderkey", "at").groupBy("section").agg(F.count("*").alias("n"), F.sum(F.col("l_orderkey") * 7 + F.col("at")).alias("sum"))


def kept_tags(spark, sf_dir):
    """Names and types of parts as tags, of which some are blank, repeated or too long."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    tags = F.array(F.concat(F.lit(" "), F.initcap("p_name")), F.upper("p_name"), F.lit("  "), F.when(k % 3 == 0, F.repeat(F.lit("long "), F.lit(13))).otherwise(F.col("p_type")), F.col("p_type"), F.col("p_brand"))
    return p.select("p_partkey", F.array_join(Q.tags_kept(tags), ",").alias("tags"))


def country_names(spark, sf_dir):
    """Codes made of customers' keys with the names of their countries."""
    k = F.col("c_custkey")
    code = F.concat(F.char(F.lit(97) + k % 26), F.char(F.lit(97) + F.floor(k / 26) % 26))
    return _t(spark, sf_dir, "customer").select("c_custkey", P.country_name(code).alias("name"))


def weighted_overlaps(spark, sf_dir):
    """Overlap of nations' and orders' skills where a skill weighs more the rarer its remainder by ten."""
    v, c = ranking.vacancies(spark, sf_dir), ranking.candidates(spark, sf_dir)
    skills = v.select("vacancy_id", F.explode(F.concat(F.transform("required", lambda x: F.struct(x.alias("key"), F.lit(True).alias("must"))), F.transform("preferred", lambda x: F.struct(x.alias("key"), F.lit(False).alias("must"))))).alias("s")).select("vacancy_id", "s.*")
    weights = spark.range(1000).filter("id % 10 < 5").select(F.col("id").alias("key"), (F.lit(1.0) + F.col("id") % 10 / 4).alias("w"))
    df = R.weighted_overlap(skills, c.select("candidate_id", F.explode("keys").alias("key")), weights)
    return df.groupBy("candidate_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"), F.count_if(F.col("score") > 0.999).alias("whole"))


def remote_reasons(spark, sf_dir):
    """Reasons of hidden pairs where remote orders are limited to some nations, with a caller's own adjustments."""
    v = ranking.vacancies(spark, sf_dir).withColumn("allowed", F.when(F.col("vacancy_id") % 3 > 0, F.array(F.col("vacancy_id") % 25, F.col("vacancy_id") % 7).cast("array<int>")))
    given = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vacancy_id")).filter("vacancy_id % 50 = 0")
    given = given.select("vacancy_id", (F.col("vacancy_id") % 100 == 0).alias("hidden"), F.lit(2).alias("cap"), F.lit("asked_for").alias("reason"))
    paired = R.pairs(R.adjusted(v, given, ["vacancy_id"]), ranking.candidates(spark, sf_dir), ranking.vectors(spark, sf_dir))
    df = R.merged_adjustments(R.scored(paired, floor=ranking.FLOOR, ceil=ranking.CEIL))
    return df.groupBy("candidate_id", "hidden", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


def session_comparison(spark, sf_dir):
    """Two scorers over sessions of cards: mean NDCG of each, and how many sessions either wins."""
    cards = _cards(spark, sf_dir).dropDuplicates(["session", "vacancy_id"])

    def of(fit, name):
        df = E.ndcg(C.session_ranks(cards, fit), "session", [F.asc("place")], "label")
        return df.select("session", F.col("ndcg").alias(name))

    both = of(F.col("skill") + F.col("semantic") / 7, "a").join(of(F.col("semantic") + F.col("skill") / 7, "b"), "session").withColumn("d", F.col("b") - F.col("a"))
    df = both.agg(F.count("*").alias("sessions"), F.round(F.avg("a"), 6).alias("linear"), F.round(F.avg("b"), 6).alias("learned"), F.count_if(F.col("d") > 1e-9).alias("wins"), F.count_if(F.abs("d") <= 1e-9).alias("ties"), F.count_if(F.col("d") < -1e-9).alias("losses"))
    return df.withColumn("verdict", C.verdict(F.col("learned") - F.col("linear") - 0.01, F.col("learned") - F.col("linear") + 0.01, F.col("sessions")))


def caught_plants(spark, sf_dir):
    """Planted errors (lines at a discount) by kind and how many a verdict caught; agreement of labels and verdicts."""
    ln = _t(spark, sf_dir, "lineitem").filter("l_discount > 0.05")
    caught, wrong = F.col("l_returnflag") != "N", F.col("l_tax") > 0.04
    df = ln.groupBy(F.col("l_linenumber").alias("kind")).agg(F.count("*").alias("planted"), F.count_if(caught).alias("caught"), *(F.count_if((caught == c) & (wrong == w)).alias(n) for c, w, n in ((True, True, "both"), (True, False, "only_judge"), (False, True, "only_label"), (False, False, "neither"))))
    return df.withColumns({"catch_rate": F.round(F.try_divide(F.col("caught").cast("double"), F.col("planted")), 4), "agreement": F.round(F.try_divide((F.col("both") + F.col("neither")).cast("double"), F.col("planted")), 4)})


QUERIES = {f.__name__: f for f in (arbeitnow_postings, themuse_counts, jooble_ids, loaded_since, section_fill, kept_tags, country_names, weighted_overlaps, remote_reasons, session_comparison, caught_plants)}

_HEADINGS = understanding._list(Q._HEADINGS)
ORACLES = {
    "arbeitnow_postings": """WITH o AS (SELECT *, o_orderkey % 9000 AS id FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 2 = 0 AND o_orderkey % 9 > 0), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderkey) AS n FROM o)
SELECT 's' || id AS source_id, 'https://b.example/' || o_orderkey AS url, o_orderpriority AS title, CAST(epoch(o_orderdate) AS BIGINT) AS posted, 'a,' || o_orderstatus AS tags, o_orderstatus || ', ' || o_orderpriority AS employment_type FROM n WHERE n = 1""",
    "themuse_counts": "SELECT count(*) FILTER (r AND c_custkey % 6 > 0) AS kept, count(*) FILTER (NOT r) AS filtered, count(*) FILTER (r AND c_custkey % 6 = 0) AS skipped, count(*) AS raw_count, NULL::VARCHAR AS error FROM (SELECT *, c_custkey % 10 > 0 AND c_custkey % 4 < 2 AS r FROM customer)",
    "jooble_ids": "WITH p AS (SELECT CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey AS VARCHAR) ELSE substr(sha256('https://j.example/' || (p_partkey % 500)), 1, 20) END AS id, p_partkey AS k FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM p) SELECT id AS source_id, 'https://j.example/' || (k % 500) AS url, NULL::VARCHAR AS company, true AS description_is_excerpt FROM n WHERE n = 1",
    "loaded_since": f"SELECT o_orderpriority AS source, o_orderkey AS source_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS place FROM orders WHERE o_orderpriority <= '2-HIGH' AND o_orderdate >= TIMESTAMP '{SEEN}'",
    "section_fill": understanding._HEAD.split("p AS (SELECT")[0] + f"""l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i, CASE WHEN l_partkey % 5 = 0 THEN {understanding._pick(understanding.HEADS, "l_partkey")} ELSE 'line of part ' || l_partkey END AS text FROM lineitem),
t AS (SELECT DISTINCT text, ' ' || trim(regexp_replace(replace(lower(text), 'ʼ', ' '), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' AS key FROM l),
s AS (SELECT text, key, coalesce(arg_max(section, (size, -ord)), 'general') AS found FROM t LEFT JOIN ph ON contains(key, ' ' || phrase || ' ') GROUP BY 1, 2),
u AS (SELECT text, key, CASE WHEN found = 'nice_to_have' AND {understanding._HAS.format(understanding._list(map(Q._key, Q.REQUIRED_WORDS)))} THEN 'requirements' ELSE found END AS found FROM s),
h AS (SELECT l.*, found, l_partkey % 10 = 0 OR list_contains({_HEADINGS}, trim(key)) AS heading, l_partkey % 7 = 1 AS title FROM l JOIN u USING (text)),
f AS (SELECT *, coalesce(last_value(CASE WHEN heading OR title THEN found END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY i), 'general') AS section FROM h)
SELECT section, count(*) AS n, CAST(sum(l_orderkey * 7 + i) AS BIGINT) AS sum FROM f WHERE NOT heading AND NOT (title AND found <> 'general') GROUP BY 1""",
    "kept_tags": """WITH p AS (SELECT p_partkey, p_name, p_type, p_brand, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') AS nn FROM part)
SELECT p_partkey, concat_ws(',', nn, CASE WHEN lower(p_type) <> lower(p_name) THEN p_type END, p_brand) AS tags FROM p""",
    "country_names": f"WITH n(code, name) AS (VALUES {understanding._values([(c, s[0]) for c, s in P.COUNTRIES.items()])}) SELECT c_custkey, name FROM customer LEFT JOIN n ON code = upper(chr(CAST(97 + c_custkey % 26 AS INT)) || chr(CAST(97 + (c_custkey // 26) % 26 AS INT)))",
    "weighted_overlaps": ranking._BASE + """, wk AS (SELECT vacancy_id, key, CASE WHEN must THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN key % 10 < 5 THEN 1 + (key % 10) / 4.0::DOUBLE ELSE 1 END AS w FROM sk),
ta AS (SELECT vacancy_id, sum(w) AS a FROM wk WHERE vacancy_id IN (SELECT o_orderkey FROM orders) GROUP BY 1), hw AS (SELECT candidate_id, vacancy_id, sum(w) AS h FROM wk JOIN ck USING (key) GROUP BY 1, 2)
SELECT candidate_id, count(*) AS n, round(sum(least(1.0, h / a)), 6) AS total, count(*) FILTER (h / a > 0.999) AS whole FROM hw JOIN ta USING (vacancy_id) GROUP BY 1""",
    "remote_reasons": ranking._BASE + """, m AS (SELECT candidate_id, abroad, short, risky, o_orderstatus = 'F' AND vacancy_id % 3 > 0 AND candidate_id <> vacancy_id % 25 AND candidate_id <> vacancy_id % 7 AS outside, vacancy_id FROM r JOIN orders ON o_orderkey = vacancy_id)
SELECT candidate_id, abroad OR outside OR risky OR vacancy_id % 100 = 0 AS hidden, concat_ws(',', CASE WHEN abroad THEN 'on_site_abroad' END, CASE WHEN outside THEN 'remote_outside_region' END, CASE WHEN short THEN 'experience_short' END, CASE WHEN risky THEN 'risky_niche' END, CASE WHEN vacancy_id % 50 = 0 THEN 'asked_for' END) AS reasons, count(*) AS n FROM m GROUP BY 1, 2, 3""",
    "session_comparison": """WITH c AS (SELECT DISTINCT ON (l_suppkey, v) l_suppkey AS session, l_orderkey * 100000 + l_partkey * 8 + l_linenumber AS v, coalesce(CASE WHEN l_linestatus <> 'O' THEN CAST(trunc(l_quantity / 20) AS INT) END, 0) AS band, CAST(l_returnflag = 'R' AS INT) AS label, CASE WHEN l_tax > 0 THEN l_discount * 10 END AS sk, l_tax * 10 AS se FROM lineitem),
u AS (SELECT * FROM c WHERE session IN (SELECT session FROM c GROUP BY 1 HAVING sum(label) > 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY band, sk + se / 7 DESC NULLS LAST, v) AS p, row_number() OVER (PARTITION BY session ORDER BY band, se + sk / 7 DESC NULLS LAST, v) AS q, row_number() OVER (PARTITION BY session ORDER BY label DESC) AS i FROM u),
d AS (SELECT session, coalesce(sum(label / log2(p + 1)) FILTER (p <= 10), 0) / sum(label / log2(i + 1)) FILTER (i <= 10) AS a, coalesce(sum(label / log2(q + 1)) FILTER (q <= 10), 0) / sum(label / log2(i + 1)) FILTER (i <= 10) AS b FROM o GROUP BY 1),
t AS (SELECT count(*) AS sessions, round(avg(a), 6) AS linear, round(avg(b), 6) AS learned, count(*) FILTER (b - a > 1e-9) AS wins, count(*) FILTER (abs(b - a) <= 1e-9) AS ties, count(*) FILTER (b - a < -1e-9) AS losses FROM d)
SELECT *, CASE WHEN sessions < 20 THEN 'inconclusive' WHEN learned - linear > 0.01 THEN 'learned_better' WHEN learned - linear < -0.01 THEN 'linear_better' ELSE 'inconclusive' END AS verdict FROM t""",
    "caught_plants": """WITH l AS (SELECT l_linenumber AS kind, l_returnflag <> 'N' AS c, l_tax > 0.04::DOUBLE AS w FROM lineitem WHERE l_discount > 0.05::DOUBLE),
k AS (SELECT kind, count(*) AS planted, count(*) FILTER (c) AS caught, count(*) FILTER (c AND w) AS "both", count(*) FILTER (c AND NOT w) AS only_judge, count(*) FILTER (NOT c AND w) AS only_label, count(*) FILTER (NOT c AND NOT w) AS neither FROM l GROUP BY 1)
SELECT *, round(CAST(caught AS DOUBLE) / planted, 4) AS catch_rate, round(CAST("both" + neither AS DOUBLE) / planted, 4) AS agreement FROM k""",
}
