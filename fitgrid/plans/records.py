"""Store, monitoring and limit queries over orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import records as R
from .ranking import _t

CUT = "1996-01-01"


def _postings(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    text = F.concat_ws("|", F.col("o_custkey").cast("string"), F.coalesce("o_orderpriority", F.lit("")), F.coalesce("o_orderstatus", F.lit("")))
    return o.select(F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("source"), F.sha2(text, 256).alias("content_hash"), F.col("o_orderdate").alias("posted_at"), "o_orderstatus", "o_custkey")


def _stored(spark, sf_dir):
    p = _postings(spark, sf_dir).filter(F.col("posted_at") < F.lit(CUT).cast("timestamp"))
    return p.withColumns({"content_hash": F.when(F.col("o_orderstatus") == "P", F.lit("old")).otherwise(F.col("content_hash")), "version": F.when(F.col("source").startswith("5"), "v1").otherwise("v2")})


def classify_postings(spark, sf_dir):
    df = R.classify(_postings(spark, sf_dir), _stored(spark, sf_dir).select("source_id", "source", "content_hash", "version"), ["source", "source_id"], "v2")
    return df.select("source", "source_id", "status")


def classify_summary(spark, sf_dir):
    return classify_postings(spark, sf_dir).groupBy("source").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "stale", "unchanged")))


def _deliveries(spark, sf_dir):
    o, ln = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    stored = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("fetched_at"), F.col("o_orderdate").alias("first_seen_at"), F.col("o_orderstatus").alias("state"))
    seen = ln.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("fetched_at"), F.max("l_linestatus").alias("state")).withColumn("first_seen_at", F.col("fetched_at"))
    return stored, seen


def guarded_upsert(spark, sf_dir):
    stored, seen = _deliveries(spark, sf_dir)
    return R.upsert(stored, seen, ["id"]).select("id", "state", F.col("fetched_at").cast("timestamp").alias("fetched_at"), F.col("first_seen_at").cast("timestamp").alias("first_seen_at"), "skipped_older")


def touch_seen(spark, sf_dir):
    stored, seen = _deliveries(spark, sf_dir)
    df = R.touch(stored.withColumn("last_seen_at", F.col("fetched_at")), seen.withColumn("seen_at", F.col("fetched_at")), ["id"])
    return df.select("id", F.col("last_seen_at").cast("timestamp").alias("last_seen_at"))


def sources_summary(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("n"), F.max("o_orderdate").cast("timestamp").alias("newest"))
    top = df.agg(F.max("newest").alias("now"))
    return df.crossJoin(F.broadcast(top)).select("source", "n", "newest", (F.unix_timestamp("now") - F.unix_timestamp("newest") > 86400).alias("stale"))


def load_newest(spark, sf_dir):
    """Postings in the loader's order, newest first within a source, as a rank."""
    p = _postings(spark, sf_dir).select("source", "source_id", "posted_at")
    return R.loader_order(p).select("source", "source_id", "place")


def ingest_plan(spark, sf_dir):
    """New and changed postings of a run: the newest 200 of each source go, the rest are deferred."""
    df = R.classify(_postings(spark, sf_dir), _stored(spark, sf_dir).select("source_id", "source", "content_hash", "version"), ["source", "source_id"], "v2").filter("status <> 'unchanged'")
    return R.ingest_split(df)[1]


def _hits(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("subject"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").alias("seq"))


def rate_limit(spark, sf_dir):
    return R.windowed_hits(_hits(spark, sf_dir), 86400, 3).select("subject", "seq", F.col("window_start").cast("long").alias("window_start"), "allowed", F.col("retry_after").cast("long").alias("retry_after"))


def request_ledger(spark, sf_dir):
    """Hits of the same subject in the 24 hours before each, itself included."""
    w = Window.partitionBy("subject").orderBy("micros").rangeBetween(-86_400_000_000, 0)
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return e.select("subject", "seq", F.count("*").over(w).alias("n"))


def stage_percentiles(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), "ts", "event_id")
    return R.nearest_rank(e, "stage", "ms", ["ts", "event_id"])


def stage_alerts(spark, sf_dir):
    """Stages whose p95 is over a bound on enough samples, with a severity."""
    df = stage_percentiles(spark, sf_dir)
    return df.filter("n >= 10 AND p95 > 20").select("stage", F.round("p95", 6).alias("p95"), F.when(F.col("p95") > 40, "critical").otherwise("warning").alias("severity"))


def event_counters(spark, sf_dir):
    """Counts by key; beyond the first hundred keys seen, a key counts as other."""
    return R.counters(_t(spark, sf_dir, "events"), F.get_json_object("props", "$.k"), F.struct("ts", "event_id"))


def user_counters(spark, sf_dir):
    """The same over many more keys: user and type, of which some are no keys."""
    return R.counters(_t(spark, sf_dir, "events"), F.concat(F.when(F.col("user_id") % 10 == 0, F.lit("User ")).otherwise(F.lit("user:")), "user_id", F.lit("."), "event_type"), F.struct("ts", "event_id"))


def experience_months(spark, sf_dir):
    """Months in which a customer's orders were open (order date to last shipment), as a union of intervals."""
    o, ln = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    last = ln.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"))

    def month(c):
        return F.year(c) * 12 + F.month(c) - 1

    spans = o.join(last, "o_orderkey").select(F.col("o_custkey").alias("candidate_id"), month("o_orderdate").alias("first"), month(F.greatest("ship", "o_orderdate")).alias("last"))
    return R.covered_months(spans, "candidate_id")


def top_tags(spark, sf_dir):
    """Part types merged by their normal form: count and the spelling seen first."""
    p = _t(spark, sf_dir, "part")
    df = p.groupBy(F.lower(F.trim("p_type")).alias("tag"), F.col("p_type").alias("spelling")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return df.groupBy("tag").agg(F.sum("n").alias("n"), F.max_by("spelling", F.struct("n", -F.col("first"))).alias("spelling"))


def ambiguous_aliases(spark, sf_dir):
    """Aliases (the last word of a part's type) that name several concepts (brands), with the sorted concepts."""
    p = _t(spark, sf_dir, "part").select(F.lower(F.element_at(F.split("p_type", " "), -1)).alias("alias"), F.col("p_brand").alias("concept"))
    df = p.groupBy("alias").agg(F.sort_array(F.collect_set("concept")).alias("c")).filter(F.size("c") > 1)
    return df.select("alias", F.size("c").alias("n"), F.array_join("c", ",").alias("concepts"))


QUERIES = {f.__name__: f for f in (classify_postings, classify_summary, guarded_upsert, touch_seen, sources_summary, load_newest, ingest_plan, rate_limit, request_ledger, stage_percentiles, stage_alerts, event_counters, user_counters, experience_months, top_tags, ambiguous_aliases)}

_POST = f"""
WITH p AS (SELECT o_orderkey AS source_id, o_orderpriority AS source, sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), coalesce(o_orderpriority, ''), coalesce(o_orderstatus, ''))) AS content_hash, o_orderdate AS posted_at, o_orderstatus FROM orders),
s AS (SELECT source_id, source, CASE WHEN o_orderstatus = 'P' THEN 'old' ELSE content_hash END AS h, CASE WHEN source LIKE '5%' THEN 'v1' ELSE 'v2' END AS version FROM p WHERE posted_at < TIMESTAMP '{CUT}'),
c AS (SELECT p.source, p.source_id, posted_at, CASE WHEN s.source_id IS NULL THEN 'new' WHEN content_hash <> h THEN 'changed' WHEN version <> 'v2' THEN 'stale' ELSE 'unchanged' END AS status FROM p LEFT JOIN s ON p.source = s.source AND p.source_id = s.source_id)
"""
_PCT = """
WITH l AS (SELECT event_type AS stage, value AS ms, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
r AS (SELECT stage, ms, row_number() OVER (PARTITION BY stage ORDER BY ms, ts, event_id) AS rk, count(*) OVER (PARTITION BY stage) AS n FROM l WHERE k <= 1000),
q AS (SELECT stage, count(*) AS n, max(ms) FILTER (rk = greatest(1, ceil(n * 0.5::DOUBLE))) AS p50, max(ms) FILTER (rk = greatest(1, ceil(n * 0.95::DOUBLE))) AS p95, max(ms) AS highest FROM r GROUP BY stage)
"""
ORACLES = {
    "classify_postings": _POST + "SELECT source, source_id, status FROM c",
    "classify_summary": _POST + "SELECT source, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'unchanged') AS unchanged FROM c GROUP BY source",
    "guarded_upsert": """WITH n AS (SELECT l_orderkey AS id, min(l_shipdate) AS f, max(l_linestatus) AS state FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, id) AS id, CASE WHEN o_orderkey IS NULL OR f >= o_orderdate THEN state ELSE o_orderstatus END AS state, CASE WHEN f IS NULL THEN o_orderdate ELSE coalesce(greatest(f, o_orderdate), f) END AS fetched_at, coalesce(least(f, o_orderdate), f, o_orderdate) AS first_seen_at, coalesce(f < o_orderdate, false) AS skipped_older
FROM orders FULL JOIN n ON id = o_orderkey""".replace("CASE WHEN o_orderkey IS NULL OR f >= o_orderdate THEN state", "CASE WHEN o_orderkey IS NULL OR coalesce(f >= o_orderdate, false) THEN state"),
    "touch_seen": "SELECT o_orderkey AS id, greatest(o_orderdate, f) AS last_seen_at FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "sources_summary": "WITH s AS (SELECT o_orderpriority AS source, count(*) AS n, max(o_orderdate) AS newest FROM orders GROUP BY 1) SELECT source, n, newest, epoch((SELECT max(newest) FROM s)) - epoch(newest) > 86400 AS stale FROM s",
    "load_newest": "SELECT o_orderpriority AS source, o_orderkey AS source_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS place FROM orders",
    "ingest_plan": _POST + ", k AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY posted_at DESC NULLS LAST, source_id) AS n FROM c WHERE status <> 'unchanged') SELECT source, count(*) FILTER (n <= 200) AS processed, count(*) FILTER (n > 200) AS deferred FROM k GROUP BY source",
    "rate_limit": """WITH h AS (SELECT user_id AS subject, event_id AS seq, epoch_us(ts) AS us, epoch_us(ts) // 86400000000 * 86400 AS window_start FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY subject, window_start ORDER BY us, seq) AS n FROM h)
SELECT subject, seq, window_start, n <= 3 AS allowed, CASE WHEN n > 3 THEN CAST(ceil(window_start + 86400 - us / 1e6) AS BIGINT) END AS retry_after FROM n""",
    "request_ledger": "SELECT user_id AS subject, event_id AS seq, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events",
    "stage_percentiles": _PCT + "SELECT * FROM q",
    "stage_alerts": _PCT + "SELECT stage, round(p95, 6) AS p95, CASE WHEN p95 > 40 THEN 'critical' ELSE 'warning' END AS severity FROM q WHERE n >= 10 AND p95 > 20",
    "event_counters": "WITH k AS (SELECT json_extract_string(props, '$.k') AS key, count(*) AS n, min((ts, event_id)) AS seen FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY seen) AS place FROM k) SELECT CASE WHEN place <= 100 THEN key ELSE 'other' END AS key, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1",
    "user_counters": """WITH u AS (SELECT CASE WHEN user_id % 10 = 0 THEN 'other' ELSE 'user:' || user_id || '.' || event_type END AS key, ts, event_id FROM events),
k AS (SELECT key, count(*) AS n, min((ts, event_id)) AS seen FROM u GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY seen) AS place FROM k) SELECT CASE WHEN place <= 100 THEN key ELSE 'other' END AS key, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""",
    "experience_months": """WITH s AS (SELECT o_custkey AS candidate_id, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS a, year(greatest(max(l_shipdate), o_orderdate)) * 12 + month(greatest(max(l_shipdate), o_orderdate)) - 1 AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)
SELECT candidate_id, count(DISTINCT m) AS months FROM (SELECT candidate_id, unnest(range(a, b + 1)) AS m FROM s) GROUP BY 1""",
    "top_tags": "WITH t AS (SELECT lower(trim(p_type)) AS tag, p_type AS spelling, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2) SELECT tag, CAST(sum(n) AS BIGINT) AS n, arg_max(spelling, (n, -first)) AS spelling FROM t GROUP BY tag",
    "ambiguous_aliases": "SELECT lower(split_part(p_type, ' ', -1)) AS alias, count(DISTINCT p_brand) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS concepts FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
}
