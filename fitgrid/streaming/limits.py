"""Rate limits with several rules, as a stateful stream and as a batch with the same rules.

A hit of a subject is allowed if every rule's fixed window is under its limit; a refused
hit counts in none. Several rules depend on each other through refusals, so hits are
taken in order per subject with a small state: a counter per rule. The seconds to wait are those
of the first rule, in their order, that refuses. A stream's state of a subject ends an hour after
the longest window without hits; a batch carries it from one Arrow batch to the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RULES = ((60, 6), (86400, 100))
OUT = "subject string, ts double, allowed boolean, retry_after long"
STATE = "starts array<bigint>, counts array<bigint>"


def decide(ts: list[float], starts: list[int], counts: list[int], rules=RULES) -> list[tuple[bool, int | None]]:
    """Verdicts of hits in order of time; ``starts`` and ``counts`` (one per rule) are carried on in place."""
    out = []
    for t in ts:
        for r, (seconds, _) in enumerate(rules):
            start = math.floor(t / seconds) * seconds
            if start != starts[r]:
                starts[r], counts[r] = start, 0
        refusing = next((r for r, (_, limit) in enumerate(rules) if counts[r] >= limit), None)
        if refusing is None:
            counts[:] = [n + 1 for n in counts]
            out.append((True, None))
        else:
            out.append((False, max(1, math.ceil(starts[refusing] + rules[refusing][0] - t))))
    return out


def _frame(subject: str, ts: list[float], verdicts) -> pd.DataFrame:
    return pd.DataFrame({"subject": subject, "ts": ts, "allowed": [v[0] for v in verdicts], "retry_after": pd.array([v[1] for v in verdicts], dtype="Int64")})


def limited_stream(hits: DataFrame, rules=RULES, expire: bool = True) -> DataFrame:
    """Verdicts of a stream of hits (subject string, ts double); within a batch hits are taken by time. A stream that
    is to end by itself (availableNow) must not ``expire`` its state: Spark would wait for the timeouts without end."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, counts = (list(x) for x in state.get) if state.exists else ([-1] * len(rules), [0] * len(rules))
        if state.hasTimedOut:
            state.remove()
            return
        ts = sorted(float(x) for b in batches for x in b["ts"])
        verdicts = decide(ts, starts, counts, rules)
        state.update((starts, counts))
        if expire:
            state.setTimeoutDuration(1000 * (3600 + max(seconds for seconds, _ in rules)))
        yield _frame(key[0], ts, verdicts)

    return hits.groupBy("subject").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def limited_batch(hits: DataFrame, rules=RULES) -> DataFrame:
    """Verdicts of hits. A task holds one Arrow batch and a counter per rule, however many hits a subject has."""

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, starts, counts = None, [], []
        for b in batches:
            for who, rows in b.groupby("subject", sort=False, dropna=False):
                if who != subject or not starts:
                    subject, starts, counts = who, [-1] * len(rules), [0] * len(rules)
                ts = rows["ts"].astype(float).tolist()
                yield _frame(who, ts, decide(ts, starts, counts, rules))

    return hits.select("subject", "ts").repartition("subject").sortWithinPartitions("subject", "ts").mapInPandas(ordered, OUT)
