"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power t, normalised: t = 1 keeps
the shares, t = 0 makes them equal. t is bisected (in each pass at ``POINTS`` places at
once, one aggregation over the table of sources) to the greatest flattening that a
limit allows: an entropy to reach, or the most passes over a source. The weights
become token budgets; a source gives whole passes over its texts, each in its own
random order, and then a part of one; and the whole output is dealt into blocks in
which every source has its share, permuted within the block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, saved, table

POINTS, PASSES = 32, 5
#: So many sources are measured on the driver, eight bytes each.
FEW_SOURCES = 10_000
#: Texts of a source that one task orders, about.
BUCKET_ROWS = 20_000
BLOCKS = 64


def _n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _rank(order: Column | str) -> Column:
    return F.shiftrightunsigned(order, 1)


def _measures(sources: DataFrame, points: list[float]) -> list[tuple[float, float]]:
    """(entropy, passes over the source that is repeated most when every source is passed once at least) by exponent."""
    p = F.col("tokens") / F.lit(float(sources.agg(F.sum("tokens")).collect()[0][0] or 1))
    cols = []
    for i, t in enumerate(points):
        w = F.pow(p, F.lit(t))
        cols += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(w)).alias(f"l{i}"), F.max(w / p).alias(f"a{i}"), F.min(w / p).alias(f"b{i}")]
    row = sources.agg(*cols).collect()[0]
    return [(math.log(row[f"z{i}"]) - row[f"l{i}"] / row[f"z{i}"], row[f"a{i}"] / row[f"b{i}"]) for i in range(len(points))]


def _local_measures(p: np.ndarray, points: list[float]) -> list[tuple[float, float]]:
    out = []
    for t in points:
        w = p**t
        out.append((float(np.log(w.sum()) - (w * np.log(w)).sum() / w.sum()), float((w / p).max() / (w / p).min())))
    return out


def exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None) -> float:
    """The least t in [0, 1] whose weights need at most ``repeats`` passes over a source while no source is
    passed less than once; with ``entropy`` (of its maximum, 0 to 1), the greatest t that still reaches it.
    With both, the larger t: the limit on repeats holds."""
    n = sources.count()
    if n < 2:
        return 1.0
    measure = _measures
    if n <= FEW_SOURCES:  # as many fit on the driver; more are measured where they are
        tokens = np.array([r[0] for r in sources.select("tokens").collect()], float)
        measure = lambda _, points: _local_measures(tokens / tokens.sum(), points)

    def search(fits) -> tuple[float, float]:
        """Two neighbouring exponents: up to the first ``fits`` fails, from the second on it holds."""
        lo, hi = 0.0, 1.0
        if fits(measure(sources, [0.0])[0]):
            return 0.0, 0.0
        for _ in range(PASSES):
            points = [lo + (hi - lo) * k / POINTS for k in range(POINTS + 1)]
            ok = [fits(m) for m in measure(sources, points)]
            k = next((k for k in range(1, POINTS + 1) if ok[k]), POINTS)
            lo, hi = points[k - 1], points[k]
        return lo, hi

    found = []
    if repeats is not None:
        found.append(search(lambda m: m[1] <= repeats)[1])
    if entropy is not None:
        goal = entropy * math.log(n)
        found.append(search(lambda m: m[0] < goal)[0] if measure(sources, [1.0])[0][0] < goal else 1.0)
    return max(found, default=1.0)


def mix(docs: DataFrame, entropy: float | None = 0.95, repeats: float | None = 2.0, blocks: int = BLOCKS, seed: int = 3, budget: float | None = None) -> DataFrame:
    """``docs`` (all columns) as drawn, with ``__pass``, ``__block``, ``__place``, ``__tokens`` and ``__weight``.

    ``budget`` is the number of tokens to draw; by default the least for which every
    source is passed once, so no text is lost. Null sources are one source of their
    own; texts without words cost nothing and are drawn in every pass begun;
    repeated rows are drawn as often as they stand; texts of any length are whole; ties of
    the order go by a hash of id and text; columns of other names are carried; an empty table gives no rows.
    """
    rows = docs.withColumns({"__tokens": _n_tokens(F.col("text")), "__source": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))})
    rows = rows.withColumn("__id", F.xxhash64(F.lit(seed), "doc_id", "text"))
    slim = saved(rows.groupBy("__source", "__id").agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("n")), "slim")
    sources = saved(slim.groupBy("__source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")), "sources")
    t = exponent(sources.filter("tokens > 0"), entropy, repeats)
    w = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(t))).otherwise(0.0)
    z, least, whole, most_rows = sources.agg(F.sum(w), F.min(F.when(F.col("tokens") > 0, w / F.col("tokens"))), F.sum("tokens"), F.max("n")).collect()[0]
    scale = 0.0 if not z or not least else (1 / least if budget is None else budget / z)
    weights = sources.select("__source", (w / (z or 1.0)).alias("__weight"), F.when(F.col("tokens") > 0, w * scale / F.col("tokens")).otherwise(1.0).alias("__passes"), "tokens")
    near = F.round("__passes")
    weights = weights.withColumn("__passes", F.when(F.abs(F.col("__passes") - near) <= 1e-9, near).otherwise(F.col("__passes")))
    buckets = 1 + int((most_rows or 0) // BUCKET_ROWS)

    # the part of a pass: texts in the order of a hash, up to the budget; sums first by bucket of that order, then within
    turn = F.floor("__passes").cast("int")
    order = F.xxhash64(F.lit(seed), "__id", "__pass")
    drawn = slim.join(weights.withColumnRenamed("tokens", "__all"), "__source")
    drawn = drawn.withColumn("__pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__passes") - 1e-9).cast("int") - 1)))
    drawn = drawn.withColumn("__order", order).withColumn("__bucket", F.floor((F.shiftrightunsigned("__order", 12)) * F.lit(float(buckets) / 2.0**52)).cast("int"))
    drawn = saved(drawn, "drawn")
    sums = drawn.groupBy("__source", "__pass", "__bucket").agg(F.sum("tokens").alias("s"))
    sums = sums.withColumn("before", F.sum("s").over(Window.partitionBy("__source", "__pass").orderBy("__bucket")) - F.col("s")).drop("s")
    within = Window.partitionBy("__source", "__pass", "__bucket").orderBy(_rank("__order"), "__id")
    placed = drawn.withColumn("run", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).join(sums, ["__source", "__pass", "__bucket"])
    at = F.col("before") + F.col("run")
    placed = placed.withColumn("at", at).filter((F.col("__pass") < turn) | (F.col("at") < (F.col("__passes") - turn) * F.col("__all") - 1e-6))
    spread = (F.col("__pass") + F.col("at") / F.greatest("__all", F.lit(1))) / F.col("__passes")
    block = F.least(F.floor(spread * blocks), F.lit(blocks - 1)).cast("int")
    # a block of a pass is a range of that order, so texts find their block by their own hash: they are not moved for it
    ranges = placed.groupBy("__source", "__pass", "__weight", block.alias("block")).agg(F.min(_rank("__order")).alias("lo"), F.max(_rank("__order")).alias("hi"))
    ranges = saved(ranges.groupBy("__source", "__pass", "__weight").agg(F.sort_array(F.collect_list(F.struct("block", "lo", "hi"))).alias("__ranges")), "ranges")
    here = _rank(order)
    # texts without words behind the last text drawn cost nothing: they go to the block before them
    before = F.coalesce(F.get(F.reverse(F.filter("__ranges", lambda r: r["lo"] <= here)), F.lit(0)), F.get("__ranges", F.lit(0)))["block"]
    drawn_in = F.get(F.filter("__ranges", lambda r: (r["lo"] <= here) & (here <= r["hi"])), 0)["block"]
    out = rows.join(ranges, "__source").withColumn("__block", F.coalesce(drawn_in, F.when(F.col("__tokens") == 0, before)))
    return out.filter("__block IS NOT NULL").withColumn("__place", F.xxhash64(F.lit(seed + 1), "__id", "__pass")).select(*docs.columns, "__source", "__pass", "__block", "__place", "__tokens", "__weight")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The columns of ``docs`` in the order of the mixture: by block, and permuted within each."""
    return mix(docs, **how).repartitionByRange("__block", "__place").sortWithinPartitions("__block", "__place").select(*docs.columns)


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, pass, block, place (order within the block), n_tokens and the source's weight, for every text drawn."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("__pass").alias("pass"), F.col("__block").alias("block"), F.col("__place").alias("place"), F.col("__tokens").alias("n_tokens"), F.col("__weight").alias("weight"))
