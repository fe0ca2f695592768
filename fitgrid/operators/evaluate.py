"""Ranking-quality and agreement statistics as DataFrame aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running


def ndcg(df: DataFrame, by: str, order: list[Column], grade: str, k: int = 10) -> DataFrame:
    """NDCG@k with gains 2**grade - 1; NULL where no item has a gain."""
    gain = F.pow(F.lit(2.0), F.col(grade)) - 1

    def dcg(places: list[Column], name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(by).orderBy(*places))
        top = df.withColumn("__at", place).filter(F.col("__at") <= k)  # each task keeps k of a group before any are shuffled
        return top.groupBy(F.col(by).alias(f"__{name}")).agg(F.sum(F.coalesce(gain / F.log2(F.col("__at") + 1), F.lit(0.0))).alias(name))

    both = dcg(order, "own").join(dcg([F.desc(grade), *order], "best"), F.col("__own").eqNullSafe(F.col("__best")))
    return both.select(F.col("__own").alias(by), F.try_divide("own", "best").alias("ndcg"))


def average_ranks(df: DataFrame, by: str, value: str, name: str, weight: str | None = None) -> DataFrame:
    """``df`` with the rank of ``value`` within ``by``, from 1, ties averaged. A group may be larger than a task: equal values are
    counted first, and their counts summed by ranges; nulls rank first and are equal. A row stands for
    ``weight`` equal ones, if that is given."""
    per = df.groupBy(by, value).agg((F.sum(weight) if weight else F.count("*")).alias("__n"))
    ranks = running(per, [by], [value], {"__upto": F.col("__n")}).select(F.col(by).alias("__by"), F.col(value).alias("__value"), (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(by).eqNullSafe(F.col("__by")) & F.col(value).eqNullSafe(F.col("__value"))).drop("__by", "__value")


def spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Correlation of average ranks. Rows of equal values are counted first and weigh as many in every sum; the mean of ranks is
    half of the rows and one."""
    per = df.groupBy(by, F.col(x).alias("__xv"), F.col(y).alias("__yv")).agg(F.count("*").alias("__w"))
    per = average_ranks(average_ranks(per, by, "__xv", "__x", "__w"), by, "__yv", "__y", "__w")
    constant = (F.min("__x") == F.max("__x")) | (F.min("__y") == F.max("__y"))
    n, mean = F.sum("__w"), (F.sum("__w") + 1) / 2
    both, xx, yy = (F.sum(F.col("__w") * F.col(a) * F.col(b)) - n * mean * mean for a, b in (("__x", "__y"), ("__x", "__x"), ("__y", "__y")))
    return per.groupBy(by).agg(F.when(~constant, both / F.sqrt(xx * yy)).alias("spearman"), n.alias("n"))


def kendall(df: DataFrame, by: str, key: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b over the pairs of a group; for groups of bounded size, as pairs are what it counts."""
    a, b = df.select(by, F.col(key).alias("k1"), F.col(x).alias("x1"), F.col(y).alias("y1")), df.select(by, F.col(key).alias("k2"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    p = a.join(b, by).filter("k1 < k2").withColumns({"dx": F.signum(F.col("x1") - F.col("x2")), "dy": F.signum(F.col("y1") - F.col("y2"))})
    return p.groupBy(by).agg(F.try_divide(F.sum(F.col("dx") * F.col("dy")), F.sqrt(F.sum(F.abs("dx")) * F.sum(F.abs("dy")))).alias("tau"))


def auc(df: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """ROC AUC from rank sums, ties a half; NULL without both labels."""
    df = average_ranks(df.select(by, score, label), by, score, "__r")
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    top = F.sum(F.when(F.col(label) == 1, F.col("__r")).otherwise(0.0)) - pos * (pos + 1) / 2
    return df.groupBy(by).agg(F.try_divide(top, (pos * neg).cast("double")).alias("auc"), pos.alias("positive"), neg.alias("negative"))


def precision_recall(df: DataFrame, by: str, predicted: Column, actual: Column) -> DataFrame:
    tp, fp, fn = F.count_if(predicted & actual), F.count_if(predicted & ~actual), F.count_if(~predicted & actual)

    def r4(c: Column) -> Column:
        return F.round(c, 4)

    return df.groupBy(by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), r4(F.try_divide(tp.cast("double"), tp + fp)).alias("precision"), r4(F.try_divide(tp.cast("double"), tp + fn)).alias("recall"), r4(F.try_divide(2.0 * tp, 2 * tp + fp + fn)).alias("f1"))


def threshold(df: DataFrame, distance: str, correct: Column, least: float, samples: int) -> DataFrame:
    """The largest distance up to which precision is ``least`` over ``samples`` or more; ties are cut together.
    Equal distances are counted first, and the counts summed by ranges of distance."""
    per = df.groupBy(F.col(distance).alias("d")).agg(F.count("*").alias("__all"), F.count_if(correct).alias("__right"))
    run = running(per, [], ["d"], {"n": F.col("__all"), "good": F.col("__right")})
    ok = (F.col("n") >= samples) & (F.col("good") / F.col("n") >= least)
    return run.agg(F.max(F.when(ok, F.col("d"))).alias("threshold"), F.count_if(ok).alias("n_ok"))
