"""op13 against all products, and against its SQL; the bounds of the cover trees."""

import math

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_queries import assert_same

from fitgrid.llm import topk_search
from fitgrid.llm.queries import ORACLES, QUERIES


def by_hand(rows, k=10, every=100):
    fine = []
    for n, (i, v) in enumerate(rows):
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(1024 * x) for x in v]
        if sum(x * x for x in whole) < 2**62:
            fine.append((n, i, whole))
    out = []
    for n, i, q in fine:
        if i % every == 0:
            all_ = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j, m) for m, j, p in fine if m != n and len(p) == len(q))
            out += [(i, r, j, -s) for r, (s, j, _) in enumerate(all_[:k], 1)]
    return sorted(out)


def found(spark, rows, every=100, k=10):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, row int, cell string").repartition(5)
    return sorted(tuple(r) for r in topk_search.top_k(df.withColumn("asks", F.col("vec_id") % every == 0), k).collect())


def vectors(seed, n=600, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(int(i), [float(x) for x in np.round(centres[i % 5] + 0.2 * rng.normal(size=dim), 2)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # a vector in many copies, queries among them
    rows += [(10, rows[10][1]), (10, rows[10][1]), (None, rows[1][1]), (2000, None), (2010, []), (2020, []), (2030, [None] * dim), (2040, [float("nan")] * dim), (2050, [float("inf")] * dim)]
    rows += [(2060, [0.0] * dim), (2070, [1e6] * dim), (2080, [1e5] * dim), (2090, [-1e5 + 0.001] * dim), (2100, [1e300] * dim), (2110, [1.0, 2.0]), (2120, [2.0, 1.0]), (2130, [3.0])]
    return rows


@pytest.mark.parametrize(("seed", "tile", "group", "visits", "cells"), [(1, 4096, 512, 32, 64), (2, 16, 3, 2, 8), (3, 50, 7, 1, 3)])
def test_against_all_products(spark, monkeypatch, seed, tile, group, visits, cells):
    for name, value in (("TILE", tile), ("GROUP", group), ("VISITS", visits), ("CELLS", cells), ("FIT_ROWS", 200)):
        monkeypatch.setattr(topk_search, name, value)
    rows = vectors(seed)
    assert found(spark, rows, 10) == by_hand(rows, every=10)


def test_search_skips_and_loses_nothing():
    rng = np.random.default_rng(4)
    x = np.floor(1024 * (rng.normal(size=(40, 8))[rng.integers(0, 40, 3000)] * 3 + 0.05 * rng.normal(size=(3000, 8))))
    q = x[::50] + np.floor(5 * rng.normal(size=(60, 8)))
    tree = topk_search.CoverTree(x)
    for node, (lo, hi) in enumerate(tree.span):
        assert np.sqrt(((x[tree.order[lo:hi]] - tree.centres[node]) ** 2).sum(1)).max() <= tree.radius[node]
        assert not tree.kids[node] or sorted(i for k in tree.kids[node] for i in range(*tree.span[k])) == list(range(lo, hi))
    first = topk_search.Best(len(q), 10, np.full(len(q), -np.inf))
    topk_search.dual_search(topk_search.CoverTree(q), tree, [[(i, i)] for i in range(len(x))], first)
    best = topk_search.Best(len(q), 10, first.worst)  # as after the queries' own cells
    done = topk_search.dual_search(topk_search.CoverTree(q), tree, [[(i, i)] for i in range(len(x))], best)
    scores = topk_search.products(q, x)
    assert (scores == q.astype(int) @ x.astype(int).T).all()
    assert first.rows == best.rows == [sorted((-int(s), i, i) for i, s in enumerate(row))[:10] for row in scores]
    assert done < 0.5 * scores.size


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, asks boolean")
    assert topk_search.top_k(df).collect() == []


def test_query(spark, duck):
    df = QUERIES["op13_exact_topk"](spark, DATA)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in df.collect()) == by_hand(rows)
    assert_same(df, duck, ORACLES["op13_exact_topk"])
