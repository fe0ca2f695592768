"""Text, taxonomy and limit queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as T
from ..streaming.limits import limited_batch
from .ranking import _t


def safe_urls(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.safe_url(F.col("url")).alias("safe"), T.stable_id(F.col("url")).alias("stable_id"))


def niche_mentions(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(T.niches(F.regexp_replace("url", "[-./]", " "), F.lit("")), ",").alias("niches"))


def normalized_names(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", T.normalize(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" \t"))).alias("norm"))


def deduped_aliases(spark, sf_dir):
    """One alias per concept (brand) and normal form: the strongest kind (size), then the first part."""
    p = _t(spark, sf_dir, "part").select("p_brand", T.normalize(F.col("p_type")).alias("norm"), "p_size", "p_partkey")
    w = Window.partitionBy("p_brand", "norm").orderBy("p_size", "p_partkey")
    return p.withColumn("n", F.row_number().over(w)).filter("n = 1").select("p_brand", "norm", "p_size", "p_partkey")


def alias_lookup(spark, sf_dir):
    """Exact tier: distinct phrases against aliases; one concept accepts, several are ambiguous, none is unmatched."""
    p = _t(spark, sf_dir, "part")
    alias = p.select(F.lower("p_type").alias("norm"), F.col("p_brand").alias("concept")).distinct().groupBy("norm").agg(F.count("*").alias("n"), F.min("concept").alias("concept"))
    asked = p.select(F.explode(F.array(F.lower("p_type"), F.lower("p_name"))).alias("norm")).distinct()
    tier = F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return asked.join(alias, "norm", "left").select("norm", tier.alias("tier"), F.when(F.col("n") == 1, F.col("concept")).alias("concept"))


def agreed_hidden(spark, sf_dir):
    """A rule applies to an id only if every row with that id agrees: orders all of whose lines were returned."""
    ln = _t(spark, sf_dir, "lineitem")
    return ln.groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "R").alias("agreed"))


def shares_as_text(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count("*").alias("n"))
    return o.select("o_orderpriority", T.percent(F.col("f") / F.col("n")).alias("share"), T.plural(F.col("n"), "order").alias("orders"))


def limits_of_two_rules(spark, sf_dir):
    """Hits under a daily and a weekly limit together; a refused hit counts in neither."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("subject"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return limited_batch(e, ((86400, 3), (604800, 10)))


QUERIES = {f.__name__: f for f in (safe_urls, niche_mentions, normalized_names, deduped_aliases, alias_lookup, agreed_hidden, shares_as_text, limits_of_two_rules)}
#: limits_of_two_rules depends on its own refusals in order, which SQL cannot say; tests compare it with a plain loop.
ORACLES = {
    "safe_urls": r"SELECT page_id, CASE WHEN length(url) <= 2048 AND NOT regexp_matches(url, '[\s\x00-\x1f]') AND regexp_matches(lower(url), '^https?://[^/?#@:]') THEN url END AS safe, substr(sha256(url), 1, 20) AS stable_id FROM pages",
    "niche_mentions": r"SELECT page_id, CASE WHEN regexp_matches(regexp_replace(url, '[-./]', ' ', 'g'), '\bcasino|\bpoker\b', 'i') THEN 'gambling' ELSE '' END AS niches FROM pages",
    "normalized_names": "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[ \t]+', ' ', 'g')) AS norm FROM part",
    "deduped_aliases": "SELECT p_brand, norm, p_size, p_partkey FROM (SELECT p_brand, lower(trim(p_type)) AS norm, p_size, p_partkey, row_number() OVER (PARTITION BY p_brand, lower(trim(p_type)) ORDER BY p_size, p_partkey) AS n FROM part) WHERE n = 1",
    "alias_lookup": """WITH a AS (SELECT lower(p_type) AS norm, count(DISTINCT p_brand) AS n, min(p_brand) AS concept FROM part GROUP BY 1), q AS (SELECT lower(p_type) AS norm FROM part UNION SELECT lower(p_name) FROM part)
SELECT q.norm, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS tier, CASE WHEN n = 1 THEN concept END AS concept FROM q LEFT JOIN a ON a.norm = q.norm""",
    "agreed_hidden": "SELECT l_orderkey, bool_and(l_returnflag = 'R') AS agreed FROM lineitem GROUP BY 1",
    "shares_as_text": "SELECT o_orderpriority, CAST(CAST(floor(100 * (CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*)) + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) || '%' AS share, count(*) || CASE WHEN count(*) = 1 THEN ' order' ELSE ' orders' END AS orders FROM orders GROUP BY 1",
}
