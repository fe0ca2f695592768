"""The persisted index: a build, readers in between, a failed build, a swap; and what a search finds."""

import os

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from fitgrid.operators import vector_index as I


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, v array<double>")


def rows_of(n, seed=0, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, i % 6, (centres[i % 6] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_build_swap_and_readers(spark, tmp_path):
    home = str(tmp_path / "index")
    assert I.open_index(spark, home) == (None, ["index_missing"])
    odd = [(900, 1, None), (901, 1, [0.0] * 8), (902, 1, [float("nan")] * 8), (903, 1, [None] * 8)]
    first = I.build(vectors_of(spark, rows_of(200) + odd), home, {"model": "m", "n": 1}, cells=5)
    old, warnings = I.open_index(spark, home, {"model": "m", "n": 1})
    assert warnings == [] and old.manifest["rows"] == 200 and old.manifest["left_out"] == 4 and old.manifest["version"] == first
    # a build that fails: nothing is left of it, and the old one stays
    before = sorted(os.listdir(home))
    for bad in (rows_of(10) + [(11, 1, [1.0, 2.0])], [(1, 1, None)], odd):
        with pytest.raises(I.BuildError):
            I.build(vectors_of(spark, bad), home, {"model": "m", "n": 2})
    assert sorted(os.listdir(home)) == before and I.open_index(spark, home)[0].manifest["version"] == first
    assert I.open_index(spark, home, {"model": "other", "n": 1})[1] == ["index_stale"]
    # a swap: who has opened the old version keeps reading it
    second = I.build(vectors_of(spark, rows_of(300, seed=1)), home, {"model": "m", "n": 2}, cells=5)
    assert old.vectors.count() == 200 and I.open_index(spark, home)[0].vectors.count() == 300
    assert I.drop_old(spark, home, keep=2) == [] and I.drop_old(spark, home, keep=1) == [first]
    assert I.open_index(spark, home)[0].manifest["version"] == second and I.open_index(spark, home)[0].vectors.count() == 300


@pytest.mark.parametrize("tile", [16_384, 20])
def test_all_cells_find_what_every_pair_finds(spark, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(I, "TILE", tile)
    rows = rows_of(240, seed=2)
    home = str(tmp_path / "index")
    I.build(vectors_of(spark, rows), home, {"n": 3}, cells=7)
    index, _ = I.open_index(spark, home)
    queries = vectors_of(spark, rows[::30] + [(5000, 0, None)]).select(F.col("vec_id").alias("query"), F.col("v").alias("q"))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    want = {}
    for i in range(0, 240, 30):
        for j, label, _ in rows:
            if i != j:
                want[i, label] = max(want.get((i, label), -2), round(float(unit[i] @ unit[j]), 9))
    got = {(r["query"], r["label"]): round(r["s"], 9) for r in I.nearest_labels(index, queries, probes=7).collect()}
    assert got == want
    few = {(r["query"], r["label"]): round(r["s"], 9) for r in I.nearest_labels(index, queries, probes=2).collect()}
    assert few and all(few[k] <= want[k] for k in few)


def test_recall(spark, tmp_path):
    from fitgrid.plans import search

    row = search.index_recall(spark, DATA.replace("sf0.001", "sf0.01")).first()
    assert row["queries"] > 0 and row["recall_at_5"] >= 0.9
