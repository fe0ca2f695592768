"""Alert tracking over monitoring cycles, and significance of paired differences.

Cycles are rows (code, now seconds, severity or NULL while clear, delivered). An alert
is announced once it is seen in ``confirm`` cycles in a row, again when it gets worse or
its message did not go out, reminded of after ``remind`` seconds, and resolved after
``confirm`` clear cycles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType

CONFIRM, REMIND = 2, 6 * 3600.0
START = (False, 0, 0, None, None)


def step(state: tuple, severity: str | None, now: float, delivered: bool, confirm: int = CONFIRM, remind: float = REMIND) -> tuple[tuple, str | None]:
    """State (active, seen, clear, severity, sent) after one cycle, and what to say: new, still, resolved or nothing."""
    active, seen, clear, was, sent = state
    if severity is None:
        if not active:
            return START, None
        return (START, "resolved") if clear + 1 >= confirm else ((True, 0, clear + 1, was, sent), None)
    if not active:
        if seen + 1 < confirm:
            return (False, seen + 1, 0, None, None), None
        said = "new"
    elif severity != was and severity == "critical":
        sent, said = None, "new"
    else:
        said = "new" if sent is None else "still" if now - sent >= remind else None
    return (True, 0, 0, severity, now if said and delivered else sent), said


def _told(code: str, rows: pd.DataFrame, state: tuple) -> tuple[list[tuple], tuple]:
    """What is said in cycles that are in order of time, and the state after them."""
    out = []
    for now, severity, delivered in zip(rows["now"], rows["severity"], rows["delivered"], strict=True):
        severity = severity if isinstance(severity, str) else None
        state, said = step(state, severity, float(now), bool(delivered))
        if said:
            out.append((code, float(now), said, severity))
    return out, state


_COLUMNS = ["code", "now", "change", "severity"]
_SCHEMA = "code string, now double, change string, severity string"


def tracked(cycles: DataFrame) -> DataFrame:
    """What was said in each cycle, code by code, in order of time. A task holds one Arrow batch and one state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, state = None, START
        for b in batches:
            for c, rows in b.groupby("code", sort=False, dropna=False):
                code, state = c, state if c == code else START
                out, state = _told(c, rows, state)
                yield pd.DataFrame(out, columns=_COLUMNS)

    return cycles.select("code", "now", "severity", "delivered").repartition("code").sortWithinPartitions("code", "now").mapInPandas(run, _SCHEMA)


def tracked_stream(cycles: DataFrame) -> DataFrame:
    """The same of a stream, whose batches bring each code's cycles in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("now", kind="stable")
        out, after = _told(key[0], rows, state.get if state.exists else START)
        state.update(after)
        yield pd.DataFrame(out, columns=_COLUMNS)

    kept = "active boolean, seen int, clear int, severity string, sent double"
    return cycles.select("code", "now", "severity", "delivered").groupBy("code").applyInPandasWithState(run, _SCHEMA, kept, "append", GroupStateTimeout.NoTimeout)


@F.pandas_udf(DoubleType())
def _two_sided(n: pd.Series, positive: pd.Series) -> pd.Series:
    def p(n: int, k: int) -> float | None:
        if not n:
            return None
        i = np.arange(1, min(k, n - k) + 1)
        logs = np.concatenate([[0.0], np.cumsum(np.log(n - i + 1) - np.log(i))]) - (n - 1) * math.log(2)
        return min(1.0, float(np.exp(logs - logs.max()).sum() * math.exp(logs.max())))

    return pd.Series([p(int(a), int(b)) for a, b in zip(n, positive, strict=True)], dtype="float64")


def sign_test(df: DataFrame, by: str, difference: str) -> DataFrame:
    """Exact two-sided sign test of each group; differences of zero are left out, NULL without any."""
    d = F.col(difference)
    got = df.groupBy(by).agg(F.count_if(d != 0).alias("n"), F.count_if(d > 0).alias("positive"))
    return got.withColumn("p", _two_sided("n", "positive"))


def bootstrap_mean(df: DataFrame, by: str, key: str, value: str, samples: int = 2000, seed: int = 25) -> DataFrame:
    """95% percentile interval of each group's mean. Rows are drawn Poisson(1) times per sample by a hash of their
    key; a task sums each group's draws over a batch, so no row is written once a sample."""
    ends = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    kind = df.schema[by].dataType.simpleString()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.arange(samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            for group, rows in b.groupby("g", dropna=False):
                top, n = np.zeros(samples), np.zeros(samples, np.int64)
                for h, v in zip(rows["h"].to_numpy().view(np.uint64), rows["v"], strict=True):
                    x = h + s
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    times = np.searchsorted(ends, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), "right")
                    n += times
                    top += times * v
                yield pd.DataFrame({"g": group, "s": np.arange(samples), "top": top, "n": n})

    drawn = df.filter(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.xxhash64(key, F.lit(seed)).alias("h"), F.col(value).cast("double").alias("v"))
    summed = drawn.mapInPandas(sums, f"g {kind}, s int, top double, n long")
    means = summed.groupBy(F.col("g").alias(by), "s").agg(F.try_divide(F.sum("top"), F.sum("n")).alias("m"))
    return means.groupBy(by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
