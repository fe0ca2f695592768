"""Searches over all vectors and skills of all texts: against plain loops, and by plans that do not grow with pairs or copies."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from fitgrid.functions import lines as L
from fitgrid.operators import matching as M
from fitgrid.plans import checks, evaluation
from fitgrid.plans import matching as plans


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_recall_meets_no_pairs_in_a_join(spark):
    for query in (plans.recall_of_labels, evaluation.nearest_concepts, plans._nearest):
        plan = plan_of(query(spark, DATA))
        assert "Join Cross" not in plan and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_best_of_labels_on_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(M, "QUERY_BYTES", block)  # some hundred bytes: many blocks of both
    monkeypatch.setattr(M, "VECTOR_BYTES", 2 * block)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100, 1, None), (101, 1, [1.0, None, 0.0, 2.0]), (102, None, [1.0, 2.0, 3.0, 4.0]), (103, 7, [1.0, 2.0]), (104, 8, []), (105, 9, [math.nan, 0.0, 0.0, 1.0]), (106, 10, [math.inf, 0.0, 0.0, 1.0]), (None, 2, [9.0, 9.0, 9.0, 9.0]), (107, 11, [1e200, -1e200, 3.0, 1.0])]
    rows += [(0, 5, [1.0, 1.0, 0.0, 0.0]), (200, 6, rows[1][2]), (201, 6, rows[1][2]), (220, None, [0.0, -0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    q = v.filter("vec_id % 20 = 0 OR vec_id > 99").select(F.col("vec_id").alias("query"), F.col("label").alias("expected"), F.col("v").alias("q"))

    def dot(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        out = 0.0
        for x, y in zip(a, b, strict=True):
            out += x * y
        return out

    want = {}
    for query, expected, a in rows:
        if query is None or (query % 20 and query < 100):
            continue
        for vec, label, b in rows:
            if vec is not None and vec != query:
                s, key = dot(a, b), (query, expected, label)
                known = [x for x in (want.get(key), s) if x is not None]
                want[key] = None if not known else math.nan if any(map(math.isnan, known)) else max(known)
    got = {(r["query"], r["expected"], r["label"]): r["s"] for r in M.best_of_labels(v, q).collect()}
    assert {k: repr(x and x + 0.0) for k, x in got.items()} == {k: repr(x and x + 0.0) for k, x in want.items()}


def test_runs_of_texts_are_never_broadcast(spark):
    text = checks.skill_mentions(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in text and "BuildLeft" not in text


def test_mentions_with_a_large_vocabulary_and_repeated_texts(spark, monkeypatch):
    lines = spark.createDataFrame([(i, ("a b c B", "b  c a", "", "Ä b c.")[i % 4]) for i in range(16)] + [(99, None)], "id int, text string")
    v = spark.createDataFrame([("a b", False), ("b c", True), ("b", False), ("ä", True)], "alias_norm string, weak boolean")
    small = sorted(map(tuple, L.skill_hits(lines, ["id"], v).collect()))
    monkeypatch.setattr(L, "MOST_BYTES", -1)
    assert sorted(map(tuple, L.skill_hits(lines, ["id"], v).collect())) == small
    want = {0: [(1, "a b", "a b", False), (4, "B", "b", False)], 1: [(1, "b c", "b c", True)], 2: [], 3: [(1, "Ä", "ä", True), (2, "b c", "b c", True)]}
    assert small == sorted((i, *hit) for i in range(16) for hit in want[i % 4])
