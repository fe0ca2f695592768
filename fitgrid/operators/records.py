"""Incremental records: classification, guarded upsert, touch, counters and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import numbered


def _loader() -> list[Column]:
    return [F.desc_nulls_last("posted_at"), F.col("source_id")]


def loader_order(postings: DataFrame) -> DataFrame:
    """``place`` of each posting (source, source_id, posted_at) in the loader's order: the newest of its source first. A source
    may hold most of the postings: they are numbered by ranges."""
    return numbered(postings, ["source"], _loader(), "place")


def ingest_split(changed: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` changed postings of each source, of which a task keeps no more before any are shuffled; and by source how many
    are processed and how many are deferred to the next run."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(*_loader()))
    chosen = changed.withColumn("__n", place).filter(F.col("__n") <= most).drop("__n")
    n = F.count("*")
    return chosen, changed.groupBy("source").agg(F.least(n, F.lit(most)).alias("processed"), F.greatest(n - most, F.lit(0)).alias("deferred"))


def first_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row per key: the first by position."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def content_hash(*cols: str) -> Column:
    """SHA-256 of the columns as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def classify(fetched: DataFrame, stored: DataFrame, keys: list[str], version: str) -> DataFrame:
    """``status`` of each fetched row (with content_hash): new, changed, stale (an older version), unchanged."""
    old = stored.select(*keys, F.col("content_hash").alias("__hash"), F.col("version").alias("__version"), F.lit(True).alias("__known"))
    df = fetched.join(old, keys, "left")
    status = F.when(F.col("__known").isNull(), "new").when(~F.col("content_hash").eqNullSafe(F.col("__hash")), "changed").when(~F.col("__version").eqNullSafe(F.lit(version)), "stale").otherwise("unchanged")
    return df.withColumn("status", status).drop("__hash", "__version", "__known")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot after an upsert that an older fetch never wins; first_seen_at is kept. ``skipped_older`` marks
    rows whose new version was older. Both sides hold fetched_at and first_seen_at."""
    both = stored.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
    w = Window.partitionBy(*keys)
    newest = Window.partitionBy(*keys).orderBy(F.desc("fetched_at"), F.desc("__new"))
    df = both.withColumns({"__n": F.row_number().over(newest), "first_seen_at": F.min("first_seen_at").over(w), "__any_new": F.max("__new").over(w)})
    return df.filter("__n = 1").withColumn("skipped_older", F.col("__any_new") & ~F.col("__new")).drop("__n", "__new", "__any_new")


def touch(stored: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """last_seen_at moves forward only."""
    return stored.join(seen.select(*keys, F.col("seen_at").alias("__seen")), keys, "left").withColumn("last_seen_at", F.greatest("last_seen_at", "__seen")).drop("__seen")


def windowed_hits(hits: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Fixed windows for one rule: which hits are allowed, and the seconds to wait where not. Hits of a subject
    (ts in epoch seconds as double, ties by seq) count in order; those beyond the limit do not count."""
    start = F.floor(F.col("ts") / seconds) * seconds
    w = Window.partitionBy("subject", "window_start").orderBy("ts", "seq")
    df = hits.withColumn("window_start", start).withColumn("n", F.row_number().over(w))
    return df.withColumn("allowed", F.col("n") <= limit).withColumn("retry_after", F.when(F.col("n") > limit, F.ceil(F.col("window_start") + seconds - F.col("ts"))))


def nearest_rank(df: DataFrame, by: str, value: str, order: list[str], last: int = 1000) -> DataFrame:
    """p50, p95 and max of the last samples of each group, by nearest rank."""
    w = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    df = df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= last)
    own = Window.partitionBy(by)
    df = df.withColumns({"__rank": F.row_number().over(own.orderBy(value, *order)), "__all": F.count("*").over(own)})

    def at(q: float) -> Column:
        return F.max(F.when(F.col("__rank") == F.greatest(F.lit(1), F.ceil(F.col("__all") * q)), F.col(value)))

    return df.groupBy(by).agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("highest"))


#: What is a key, and how many are counted by themselves.
KEY, MAX_KEYS = r"^[a-z0-9_.:-]{1,64}$", 100


def counters(df: DataFrame, key: Column, seen: Column, most: int = MAX_KEYS) -> DataFrame:
    """Counts by key. What is no key counts as other, and so do keys beyond the first ``most`` by when they were seen."""
    safe = F.when(key.rlike(KEY), key).otherwise(F.lit("other"))
    per = df.groupBy(safe.alias("key")).agg(F.count("*").alias("n"), F.min(seen).alias("__seen"))
    first = per.orderBy("__seen").limit(most).select("key", F.lit(True).alias("__own"))  # at most ``most`` rows
    own = per.join(F.broadcast(first), "key", "left")
    return own.groupBy(F.when(F.col("__own"), F.col("key")).otherwise(F.lit("other")).alias("key")).agg(F.sum("n").alias("n"))


def covered_months(spans: DataFrame, by: str) -> DataFrame:
    """Months in the union of the intervals (first, last; both inclusive, months as integers) of each group."""
    order = Window.partitionBy(by).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = spans.withColumn("__reach", reach)
    more = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first"), F.coalesce(F.col("__reach") + 1, F.col("first"))) + 1)
    return df.withColumn("__more", more).groupBy(by).agg(F.sum("__more").alias("months"))
