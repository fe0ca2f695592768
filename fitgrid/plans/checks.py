"""Monitoring, judging, feed and line queries over events, lines, orders and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import text as T
from ..operators import checks as K
from ..operators import records as R
from ..operators import requirements as N
from ..operators import scoring as S
from ..sources import postings as G
from . import ranking
from .ranking import _t


def _checks(spark, sf_dir):
    """A user's events as checks of a site: errors with a high value are down."""
    e = _t(spark, sf_dir, "events")
    status = F.when((F.col("event_type") == "error") & (F.col("value") > 100), "down").when(F.col("value") > 60, "degraded").otherwise("ok")
    return e.select((F.col("user_id") % 50).alias("site"), F.concat(F.initcap("event_type"), F.lit(" "), F.col("user_id") % 3).alias("name"), status.alias("status"), F.concat(F.lit("K/"), (F.col("value") / 40).cast("int")).alias("code"))


def health_alerts(spark, sf_dir):
    return K.health_alerts(_checks(spark, sf_dir))


def site_health(spark, sf_dir):
    """The worst status of a site, and what it answers."""
    df = _checks(spark, sf_dir).groupBy("site").agg(K.worst("status").alias("status"), F.count("*").alias("checks"))
    return df.withColumn("answer", F.when(F.col("status") == "down", 503).otherwise(200))


def metric_alerts(spark, sf_dir):
    """Sites are days; an error of three counts as the service's fault, purchases as analyses that went well."""
    e = _t(spark, sf_dir, "events").withColumn("site", F.date_trunc("hour", "ts").cast("string"))
    key = F.when(F.col("event_type") == "error", F.concat(F.lit("extract:"), F.element_at(F.array(*map(F.lit, ("llm_error", "no_text", "bad_pdf"))), (F.col("event_id") % 3 + 1).cast("int")))).when(F.col("event_id") % 17 == 0, "unexpected")
    m = e.groupBy("site").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(K.is_fault(key)).alias("faults"), F.count("value").alias("n_timed"), (F.max("value") * 200).alias("p95_ms"), F.sum(F.floor(F.col("value") * 1000)).alias("tokens"), F.count_if(F.col("event_id") % 50 == 0).alias("denied"))
    return K.metric_alerts(m).groupBy("alert", "severity").agg(F.count("*").alias("n"))


def warning_counts(spark, sf_dir):
    """Warnings by stage and code, in the order of stages."""
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("value") / 50).cast("int").alias("code"))
    stages = F.array_position(F.array(*map(F.lit, ("signup", "view", "click", "purchase", "error"))), F.col("stage"))
    df = e.groupBy("stage", "code").agg(F.count("*").alias("n"), F.max(stages).alias("s"))
    return df.select("stage", "code", "n", F.row_number().over(Window.partitionBy(F.col("code") * 0).orderBy("s", "stage", "code")).alias("place"))


def failing_runs(spark, sf_dir):
    """Orders of a customer as a run's items, newest first; those of the same status as failures in a row end it."""
    o = _t(spark, sf_dir, "orders").withColumn("day", -F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    df = K.run_until_failing(o, "o_custkey", ["day", "o_orderkey"], F.col("o_orderstatus") == "F", 3)
    return df.groupBy("o_custkey").agg(F.count_if("done").alias("processed"), F.count_if(F.col("done") & (F.col("o_orderstatus") == "F")).alias("failed"), F.count_if(~F.col("done")).alias("left"))


def judged_fields(spark, sf_dir):
    """Lines as judged items of a field (the month of shipping), open ones with a high tax as missed; of unreadable orders none."""
    ln = _t(spark, sf_dir, "lineitem").filter("l_orderkey % 10 > 0").withColumn("field", F.month("l_shipdate"))
    verdict = F.when(F.col("l_returnflag") == "N", "supported").when(F.col("l_returnflag") == "A", "partly_wrong").otherwise("unsupported")
    return K.judged(ln.filter("l_tax < 0.07").withColumn("verdict", verdict), ln.filter("l_tax >= 0.07"), ["field", "l_linestatus"])


def held_intervals(spark, sf_dir):
    """The first order of a customer whose sixty days hold the week after a line was shipped."""
    o, ln = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")

    def day(c):
        return F.unix_date(F.to_date(c))

    lines = ln.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", day("l_shipdate")).alias("id"), day("l_shipdate").alias("start"), (day("l_shipdate") + 7).alias("end")).dropDuplicates(["o_custkey", "id"])
    outer = o.select("o_custkey", F.col("o_orderkey").alias("outer_id"), day("o_orderdate").alias("from"), (day("o_orderdate") + 60).alias("to"))
    return K.contained(lines, outer, "o_custkey").select("id", "outer_id")


def matched_headings(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return K.multiset_matches(p.filter("p_size > 20"), p.filter("p_size <= 20 OR p_retailprice > 950"), ["p_type", "p_brand"])


def file_hashes(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", K.file_hash(F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n"))).alias("hash"))


def content_hashes(spark, sf_dir):
    """Orders hashed as JSON of their fields in the order of names, nulls included."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("v"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("type"), F.col("o_orderpriority").alias("category"), F.col("o_custkey").alias("company"))
    return o.select("o_orderkey", R.content_hash("category", "company", "type", "v").alias("hash"))


def first_deliveries(spark, sf_dir):
    """The first line of each order and part, as they came."""
    ln = _t(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice"))
    return R.first_wins(ln, ["l_orderkey", "l_suppkey"], "at").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")


def duplicate_ids(spark, sf_dir):
    """Parts of an order that it lists more than once."""
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


def fit_warnings(spark, sf_dir):
    """What a score lacks, counted by codes."""
    df = ranking.scored(spark, sf_dir)
    gap = F.col("vacancy_id") % 5
    skill, semantic = F.when(gap != 1, F.col("skill")), F.when((gap != 2) & (gap != 4), F.col("semantic"))
    none = F.lit(None).cast("double")
    skill = F.when(gap == 4, none).otherwise(skill)
    fit = S.linear_fit(skill, semantic, F.col("experience"))
    w = S.fit_warnings(skill, semantic, fit, S.band_rank(fit, F.coalesce("required_coverage", skill)))
    return df.select("candidate_id", F.array_join(w, ",").alias("warnings")).groupBy("candidate_id", "warnings").agg(F.count("*").alias("n"))


def percentiles_by_correctness(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("correct", F.col("event_type") != "error")
    p = e.groupBy("correct").agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"), F.count("*").alias("n"))
    return p.select("correct", "n", *(F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p10", "p50", "p90"))))


def calibration_export(spark, sf_dir):
    """At most two pairs of each class for each candidate: the best and the worst two of its lines by price."""
    ln = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("class"), "l_extendedprice")
    w = Window.partitionBy("l_suppkey", "class").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return ln.withColumn("n", F.row_number().over(w)).filter("n <= 2").drop("l_extendedprice")


def document_lines(spark, sf_dir):
    """Lines of plain texts: headings, bullets, titles, and whether there is enough to read."""
    d = _t(spark, sf_dir, "documents").select("doc_id", L.lines_of(F.coalesce("text", F.lit(""))).alias("l"))

    def n(what):
        return F.size(F.filter("l", lambda x: x[what]))

    return d.select("doc_id", F.size("l").alias("n_lines"), n("heading").alias("headings"), n("bullet").alias("bullets"), n("title").alias("titles"), L.is_usable(F.col("l")).alias("usable"))


def page_lines(spark, sf_dir):
    """Lines of pages as postings: what is a heading, a bullet or a title."""
    p = _t(spark, sf_dir, "pages").select("page_id", L.lines_of(F.col("html")).alias("l"))
    return p.select("page_id", F.size("l").alias("n_lines"), F.size(F.filter("l", lambda x: x["heading"])).alias("headings"), F.size(F.filter("l", lambda x: x["bullet"])).alias("bullets"), L.is_usable(F.col("l")).alias("usable"))


def skill_mentions(spark, sf_dir):
    """Names and types of parts that texts of three parts' names give; the longest run of words counts."""
    p = _t(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_name", F.lower("p_type"), "p_name", F.lit("and"), F.lower("p_brand"))
    v = p.filter("p_size % 3 = 0").select(F.lower("p_name").alias("alias_norm"), F.lit(False).alias("weak")).union(p.select(F.lower("p_type"), F.lit(True))).union(p.select(F.element_at(F.split(F.lower("p_name"), " "), -1), F.lit(True)))
    v = v.groupBy("alias_norm").agg(F.bool_and("weak").alias("weak"))
    texts = p.select("p_partkey", text.alias("text")).distinct()
    hits = L.skill_hits(texts.select("text").distinct(), ["text"], v)  # each text is read once, however many parts have it
    return texts.hint("merge").join(hits, "text").select("p_partkey", "place", "skill", "norm", "weak")


def posting_requirements(spark, sf_dir):
    """Pages as postings, the long words of benchmark items as skills; words that end in -ing count only where they are asked."""
    words = _t(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("alias_norm")).filter("length(alias_norm) > 7").distinct()
    vocabulary = words.withColumn("weak", F.col("alias_norm").endswith("ing"))
    p = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("description"), F.split(F.regexp_replace("url", "^.*://", ""), "[./-]").alias("tags"))
    df = N.extracted(p, vocabulary)
    return df.select("id", *(F.array_join(c, ",").alias(c) for c in ("required", "preferred", "warnings")), F.size("responsibilities").alias("n_responsibilities"), "min_years")


def posting_niches(spark, sf_dir):
    """Industries of postings made of customers' segments, from their heads alone or from two mentions."""
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    said = F.element_at(F.array(*map(F.lit, ("poker", "a blockchain", "forex desk", "nothing", "bingo and slot machines", "cfd trading"))), (k % 6 + 1).cast("int"))
    head = L.posting_head(F.concat(F.lit("Clerk "), F.when(k % 4 == 0, said).otherwise("")), F.when(k % 3 == 0, F.col("c_name")), F.array(F.lit("tag"), F.lower("c_mktsegment")), F.when(k % 5 == 0, "Online betting"))
    return c.select("c_custkey", F.array_join(T.niches(head, F.concat_ws(" ", said, F.when(k % 7 < 3, said))), ",").alias("niches"))


def _adzuna_pages(spark, sf_dir):
    """Pages of up to fifty orders as a search gives them; some without an address, and ids that come again on a later page."""
    o = _t(spark, sf_dir, "orders")
    item = F.struct((F.col("o_orderkey") % 12000).cast("string").alias("id"), F.when(F.col("o_orderkey") % 11 > 0, F.concat(F.lit("https://a.example/"), F.col("o_orderkey"))).alias("redirect_url"), F.col("o_orderpriority").alias("title"), F.struct(F.when(F.col("o_custkey") % 4 > 0, F.concat(F.lit(" c"), "o_custkey")).alias("display_name")).alias("company"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"), F.when(F.col("o_orderkey") % 3 > 0, F.round(F.col("o_totalprice"), 0)).alias("salary_min"), F.when(F.col("o_orderkey") % 5 > 0, F.round(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 2), 0)).alias("salary_max"), (F.col("o_orderkey") % 2).cast("string").alias("salary_is_predicted"))
    at = F.struct(F.col("o_orderkey").alias("k"), item.alias("i"))
    pages = o.groupBy(F.floor(F.col("o_orderkey") / 50).alias("page")).agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["i"]).alias("results"))
    return pages.select("page", F.to_json(F.struct("results")).alias("body"))


def adzuna_postings(spark, sf_dir):
    kept, _ = G.parsed_run(_adzuna_pages(spark, sf_dir), "adzuna")
    return kept.select("source_id", "url", "title", "company", "country", F.unix_timestamp("posted_at").alias("posted"), "salary_raw", "description_is_excerpt")


def adzuna_counts(spark, sf_dir):
    return G.parsed_run(_adzuna_pages(spark, sf_dir), "adzuna")[1]


def remotive_counts(spark, sf_dir):
    """Runs of two feeds: customers as postings, of which some have no title, and a feed whose second page is none."""
    c = _t(spark, sf_dir, "customer")
    job = F.struct(F.when(F.col("c_custkey") % 13 > 0, F.col("c_custkey").cast("string")).otherwise("x1").alias("id"), F.concat(F.when(F.col("c_custkey") % 7 > 0, "https").otherwise("ftp"), F.lit("://r.example/"), F.col("c_custkey")).alias("url"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).otherwise(" ").alias("title"))
    pages = c.groupBy((F.col("c_custkey") % 3).alias("page")).agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("body"))
    broken = pages.withColumn("body", F.when(F.col("page") == 1, "<html>").otherwise(F.col("body")))
    both = [G.parsed_run(p, "remotive")[1].withColumn("feed", F.lit(n)) for n, p in (("whole", pages), ("broken", broken), ("none", pages.withColumn("body", F.lit("{"))))]
    return both[0].unionByName(both[1]).unionByName(both[2])


QUERIES = {f.__name__: f for f in (health_alerts, site_health, metric_alerts, warning_counts, failing_runs, judged_fields, held_intervals, matched_headings, file_hashes, content_hashes, first_deliveries, duplicate_ids, fit_warnings, percentiles_by_correctness, calibration_export, document_lines, page_lines, skill_mentions, posting_requirements, posting_niches, adzuna_postings, adzuna_counts, remotive_counts)}

_C = """WITH c AS (SELECT user_id % 50 AS site, upper(event_type[1:1]) || event_type[2:] || ' ' || (user_id % 3) AS name, CASE WHEN event_type = 'error' AND value > 100 THEN 'down' WHEN value > 60 THEN 'degraded' ELSE 'ok' END AS status, 'K/' || CAST(trunc(value / 40) AS INT) AS code FROM events)
"""
_AD = """WITH o AS (SELECT *, o_orderkey % 12000 AS id, round(o_totalprice, 0) AS p, row_number() OVER (PARTITION BY o_orderkey % 12000, o_orderkey % 11 > 0 ORDER BY o_orderkey) AS n FROM orders),
s AS (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN p END AS lo, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice * (1 + o_orderkey % 2), 0) END AS hi FROM o)
"""
_RC = """WITH c AS (SELECT *, c_custkey % 3 AS page, c_custkey % 13 > 0 AND c_custkey % 7 > 0 AND c_custkey % 5 > 0 AS ok FROM customer)
"""
#: page_lines, skill_mentions and posting_requirements are held to brute force in tests: SQL has neither a parser of HTML nor runs that exclude each other.
ORACLES = {
    "health_alerts": _C + "SELECT site, 'check.' || regexp_replace(lower(name), '[^a-z0-9_.:-]', '_', 'g') || '.' || regexp_replace(lower(code), '[^a-z0-9_.:-]', '_', 'g') AS alert, CASE WHEN bool_or(status = 'down') THEN 'critical' ELSE 'warning' END AS severity FROM c WHERE status <> 'ok' GROUP BY 1, 2",
    "site_health": _C + "SELECT site, CASE WHEN bool_or(status = 'down') THEN 'down' WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'ok' END AS status, count(*) AS checks, CASE WHEN bool_or(status = 'down') THEN 503 ELSE 200 END AS answer FROM c GROUP BY 1",
    "metric_alerts": """WITH m AS (SELECT date_trunc('hour', ts) AS site, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (CASE WHEN event_type = 'error' THEN event_id % 3 = 0 ELSE event_id % 17 = 0 END) AS faults, count(value) AS n, max(value) * 200 AS p, CAST(sum(floor(value * 1000)) AS DOUBLE) AS tokens, count(*) FILTER (event_id % 50 = 0) AS denied FROM events GROUP BY 1),
a AS (SELECT 'service_errors' AS alert, CASE WHEN faults / total >= 0.5 THEN 'critical' ELSE 'warning' END AS severity FROM m WHERE total >= 10 AND CAST(faults AS DOUBLE) / total >= 0.2::DOUBLE UNION ALL SELECT 'slow_analyses', 'warning' FROM m WHERE n >= 10 AND p > 60000 UNION ALL SELECT 'token_spike', 'warning' FROM m WHERE ok >= 10 AND tokens / ok > 40000 UNION ALL SELECT 'limiter_failing', 'warning' FROM m WHERE denied > 0)
SELECT alert, severity, count(*) AS n FROM a GROUP BY 1, 2""",
    "warning_counts": """WITH c AS (SELECT event_type AS stage, CAST(trunc(value / 50) AS INT) AS code, count(*) AS n FROM events GROUP BY 1, 2)
SELECT stage, code, n, row_number() OVER (ORDER BY coalesce(list_position(['signup', 'view', 'click', 'purchase', 'error'], stage), 0), stage, code) AS place FROM c""",
    "failing_runs": """WITH r AS (SELECT o_custkey, o_orderstatus = 'F' AS bad, row_number() OVER w AS n, count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)),
e AS (SELECT o_custkey, min(n) FILTER (l = 3) AS e FROM r GROUP BY 1)
SELECT o_custkey, count(*) FILTER (e IS NULL OR n <= e) AS processed, count(*) FILTER ((e IS NULL OR n <= e) AND bad) AS failed, count(*) FILTER (n > e) AS "left" FROM r JOIN e USING (o_custkey) GROUP BY 1""",
    "judged_fields": """WITH l AS (SELECT month(l_shipdate) AS field, l_linestatus, l_returnflag AS f, l_tax < 0.07::DOUBLE AS j FROM lineitem WHERE l_orderkey % 10 > 0),
c AS (SELECT field, l_linestatus, count(*) FILTER (j) AS judged, count(*) FILTER (j AND f = 'N') AS supported, count(*) FILTER (j AND f = 'A') AS partly_wrong, count(*) FILTER (j AND f NOT IN ('N', 'A')) AS unsupported, count(*) FILTER (NOT j) AS missed FROM l GROUP BY 1, 2)
SELECT *, round(CAST(supported AS DOUBLE) / nullif(judged, 0), 4) AS supported_rate, round(CAST(partly_wrong + unsupported AS DOUBLE) / nullif(judged, 0), 4) AS error_rate, round(CAST(missed AS DOUBLE) / nullif(judged + missed, 0), 4) AS miss_rate FROM c""",
    "held_intervals": """WITH l AS (SELECT DISTINCT o_custkey, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || (CAST(l_shipdate AS DATE) - DATE '1970-01-01') AS id, CAST(l_shipdate AS DATE) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT id, arg_min(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS outer_id FROM l LEFT JOIN orders o ON o.o_custkey = l.o_custkey AND CAST(o.o_orderdate AS DATE) <= s AND s + 7 <= CAST(o.o_orderdate AS DATE) + 60 GROUP BY id""",
    "matched_headings": """WITH c AS (SELECT p_type, p_brand, count(*) FILTER (p_size > 20) AS p, count(*) FILTER (p_size <= 20 OR p_retailprice > 950) AS g FROM part GROUP BY 1, 2) SELECT p_type, p_brand, least(p, g) AS tp, p - least(p, g) AS fp, g - least(p, g) AS fn FROM c""",
    "file_hashes": "SELECT doc_id, sha256(replace(replace(text, '. ', '.' || chr(13) || chr(10)), chr(13) || chr(10), chr(10))) AS hash FROM documents",
    "content_hashes": """SELECT o_orderkey, sha256('{"category":"' || o_orderpriority || '","company":' || o_custkey || ',"type":' || CASE WHEN o_orderstatus <> 'P' THEN '"' || o_orderstatus || '"' ELSE 'null' END || ',"v":1}') AS hash FROM orders""",
    "first_deliveries": "SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_shipdate, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n = 1",
    "duplicate_ids": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "fit_warnings": ranking._BASE + """, z AS (SELECT candidate_id, vacancy_id % 5 AS gap, required_coverage, experience, CASE WHEN vacancy_id % 5 NOT IN (1, 4) THEN skill END AS sk, CASE WHEN vacancy_id % 5 NOT IN (2, 4) THEN semantic END AS se FROM r),
y AS (SELECT *, CASE WHEN sk IS NOT NULL OR se IS NOT NULL THEN (coalesce(0.40::DOUBLE * sk, 0) + coalesce(0.45::DOUBLE * se, 0) + coalesce(0.15::DOUBLE * experience, 0)) / (CASE WHEN sk IS NOT NULL THEN 0.40::DOUBLE ELSE 0 END + CASE WHEN se IS NOT NULL THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN experience IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END) END AS ft FROM z)
SELECT candidate_id, concat_ws(',', CASE WHEN ft IS NULL THEN 'unscored' WHEN se IS NULL THEN 'semantic_missing' WHEN sk IS NULL THEN 'skill_missing' END, CASE WHEN ft >= 0.7 AND coalesce(required_coverage, sk) >= 0.8 AND se IS NULL THEN 'band_without_semantic' END) AS warnings, count(*) AS n FROM y GROUP BY 1, 2""",
    "percentiles_by_correctness": "SELECT event_type <> 'error' AS correct, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1",
    "calibration_export": "SELECT * EXCLUDE (l_extendedprice) FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_returnflag AS class, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 2",
    "document_lines": r"""WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, '')[1:50000], chr(10))) AS raw FROM documents), s AS (SELECT doc_id, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t FROM t),
b AS (SELECT doc_id, regexp_matches(t, '^([-*•–·▪●‣⁃]|[0-9]{1,2}[.)]) ') AS bullet, trim(regexp_replace(t, '^([-*•–·▪●‣⁃]|[0-9]{1,2}[.)]) ', '')) AS t FROM s WHERE t <> ''),
w AS (SELECT doc_id, bullet, t, string_split(t, ' ') AS w FROM b WHERE t <> ''), h AS (SELECT *, NOT bullet AND t LIKE '%:' AND length(t) <= 80 AND len(w) <= 8 AS heading FROM w),
k AS (SELECT *, NOT heading AND NOT bullet AND len(w) BETWEEN 3 AND 6 AND NOT regexp_matches(t, '[.!?,;)]$') AND len(list_filter(w, lambda x: length(x) > 3 AND NOT regexp_matches(x, '^\p{Lu}'))) = 0 AS title FROM h),
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (heading) AS h, count(*) FILTER (bullet) AS b, count(*) FILTER (title) AS t, sum(length(t)) AS chars FROM k GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::INT AS n_lines, coalesce(h, 0)::INT AS headings, coalesce(b, 0)::INT AS bullets, coalesce(t, 0)::INT AS titles, coalesce(chars, 0) >= 200 AS usable FROM documents d LEFT JOIN c USING (doc_id)""",
    "posting_niches": """WITH c AS (SELECT c_custkey AS k, ['gambling', 'crypto', 'forex', '', 'gambling', 'forex'][c_custkey % 6 + 1] AS code, ['poker', 'a blockchain', 'forex desk', 'nothing', 'bingo and slot machines', 'cfd trading'][c_custkey % 6 + 1] AS said FROM customer),
n AS (SELECT *, CASE said WHEN 'nothing' THEN 0 WHEN 'bingo and slot machines' THEN 2 ELSE 1 END * (1 + CAST(k % 7 < 3 AS INT) + CAST(k % 4 = 0 AS INT)) AS times, k % 5 = 0 AS bets FROM c)
SELECT k AS c_custkey, array_to_string(list_filter(['gambling', 'crypto', 'forex'], lambda x: (x = code AND (times >= 2 OR (k % 4 = 0 AND times > 0))) OR (x = 'gambling' AND bets)), ',') AS niches FROM n""",
    "adzuna_postings": _AD + """SELECT CAST(id AS VARCHAR) AS source_id, 'https://a.example/' || o_orderkey AS url, o_orderpriority AS title, CASE WHEN o_custkey % 4 > 0 THEN 'c' || o_custkey END AS company, 'GB' AS country, CAST(epoch(o_orderdate) AS BIGINT) AS posted,
CASE WHEN lo IS NOT NULL OR hi IS NOT NULL THEN concat_ws(' - ', format('{:,.0f}', lo), CASE WHEN hi IS DISTINCT FROM lo THEN format('{:,.0f}', hi) END) || CASE WHEN o_orderkey % 2 = 1 THEN ' (estimated)' ELSE '' END END AS salary_raw, true AS description_is_excerpt FROM s WHERE o_orderkey % 11 > 0 AND n = 1""",
    "adzuna_counts": _AD + "SELECT count(*) FILTER (o_orderkey % 11 > 0 AND n = 1) AS kept, 0 AS filtered, count(*) FILTER (o_orderkey % 11 = 0 OR n > 1) AS skipped, count(*) AS raw_count, NULL::VARCHAR AS error FROM s",
    "remotive_counts": _RC + """SELECT 'whole' AS feed, count(*) FILTER (ok) AS kept, 0 AS filtered, count(*) FILTER (NOT ok) AS skipped, count(*) AS raw_count, NULL::VARCHAR AS error FROM c UNION ALL SELECT 'broken', count(*) FILTER (ok), 0, count(*) FILTER (NOT ok), count(*), NULL FROM c WHERE page = 0 UNION ALL SELECT 'none', 0, 0, 0, 0, 'invalid_response'""",
}
