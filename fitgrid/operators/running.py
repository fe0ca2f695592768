"""Ranks and running sums within groups of any size: rows are dealt by ranges of group and order, so that no task has to
hold a whole group. Every task ranks its own range, and the few numbers of the ranges before it are added."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.shared import saved

#: Bits of a row's number within its partition, as monotonically_increasing_id gives it.
_WITHIN = 33


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "place", total: str | None = None) -> DataFrame:
    """``df`` with each row's number (from 1) among the rows of its ``keys``, in ``order``; ``total`` names a column for the
    rows of the group. As ``row_number`` over a window, but a group may be larger than a task: the rows are sorted by
    ranges once and kept in the shared folder, since the numbers hang on where the ranges were cut. Null keys are a group;
    rows that tie are numbered in any order; an empty table gives an empty one."""
    cut = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = saved(cut.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("__part", F.shiftright("__at", _WITHIN))
    parts = dealt.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    of = Window.partitionBy(*keys)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        parts = parts.withColumn("__total", F.sum("__n").over(of))
    parts = parts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__of"), "__first", "__before", *(["__total"] if total else []))
    same = F.col("__part") == F.col("__of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    number = (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(name)
    return dealt.join(parts, same).select(*df.columns, number, *([F.col("__total").alias(total)] if total else []))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (name: what is summed), each row's own included, among the rows of its ``keys`` in ``order``. As
    ``numbered``, a group may be larger than a task: a range is summed by itself, and what the ranges before it hold is added.
    Rows that tie come in any order; nulls add nothing."""
    cut = df.withColumns({f"__{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()}).repartitionByRange(*[*keys, *order]).sortWithinPartitions(*keys, *order)
    dealt = saved(cut.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("__part", F.shiftright("__at", _WITHIN))
    parts = dealt.groupBy(*keys, "__part").agg(*(F.sum(f"__{k}").alias(f"__n_{k}") for k in sums))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__of"), *(F.coalesce(F.sum(f"__n_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums))
    same = F.col("__part") == F.col("__of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({k: F.sum(f"__{k}").over(within) for k in sums})
    return own.join(parts, same).select(*df.columns, *((F.col(k) + F.col(f"__before_{k}")).alias(k) for k in sums))
