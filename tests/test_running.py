"""Numbers by ranges against plain sorting."""

import numpy as np
from pyspark.sql import functions as F

from fitgrid.operators import evaluate
from fitgrid.operators.running import numbered, running


def test_numbers_within_groups_of_any_size(spark):
    rng = np.random.default_rng(5)
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.8 else f"k{rng.integers(0, 20)}", int(v)) for v in rng.permutation(3000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = {(r["k"], r["v"]): (r["place"], r["n"]) for r in numbered(df, ["k"], [F.col("v").desc()], total="n").collect()}
    want = {}
    for k in {k for k, _ in rows}:
        own = sorted((v for j, v in rows if j == k), reverse=True)
        want |= {(k, v): (i, len(own)) for i, v in enumerate(own, 1)}
    assert got == want


def test_running_sums_of_groups_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.8 else "cold", int(v), int(rng.integers(0, 9)) if rng.random() < 0.9 else None) for v in rng.permutation(2000)]
    df = spark.createDataFrame(rows, "k string, v int, x int").repartition(6)
    got = {(r["k"], r["v"]): (r["n"], r["s"]) for r in running(df, ["k"], ["v"], {"n": F.lit(1), "s": F.col("x")}).collect()}
    want = {}
    for k in {k for k, *_ in rows}:
        total = 0
        for i, (v, x) in enumerate(sorted(((v, x) for j, v, x in rows if j == k), key=lambda t: t[0]), 1):
            total += x or 0
            want[k, v] = (i, total)
    assert got == want
    assert running(df.limit(0), [], ["v"], {"n": F.lit(1)}).count() == 0


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", v) for v in (3, 1, 3, 3, None, 2)] + [(None, 5)], "k string, v int")
    got = sorted((str(r["k"]), str(r["v"]), r["r"]) for r in evaluate.average_ranks(df, "k", "v", "r").collect())
    assert got == [("None", "5", 1.0), ("a", "1", 2.0), ("a", "2", 3.0), ("a", "3", 5.0), ("a", "3", 5.0), ("a", "3", 5.0), ("a", "None", 1.0)]


def test_ties_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 2)], "k string, v int")
    assert sorted((r["k"], r["place"]) for r in numbered(df, ["k"], ["v"]).collect()) == [("a", i) for i in range(1, 51)] + [("b", 1)]
    assert numbered(df.limit(0), ["k"], ["v"]).columns == ["k", "v", "place"]
    assert numbered(df.limit(0), ["k"], ["v"]).count() == 0


def test_many_candidates_meet_vacancies_block_by_block(spark, monkeypatch):
    from conftest import DATA
    from fitgrid.operators import ranking as R
    from fitgrid.plans import ranking as plans

    columns = ["candidate_id", "vacancy_id", "required_matched", "preferred_matched", "band_rank", "hidden"]
    want = sorted(map(tuple, plans.scored(spark, DATA).select(*columns).collect()))
    size, words = R.bytes_of(plans.candidates(spark, DATA))
    keys = plans.candidates(spark, DATA).select(F.explode("keys").alias("k")).distinct().count()
    assert words == -(-keys // 64) and size >= 25 * 8 * words
    monkeypatch.setattr(R, "MOST_BYTES", size // 5)
    monkeypatch.setattr(R, "PARTS", 3)
    df = plans.scored(spark, DATA).select(*columns)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "(__block" in plan
    assert sorted(map(tuple, df.collect())) == want


def test_the_loader_takes_the_newest_first(spark):
    from fitgrid.operators import records

    rows = [("a", i, None if i == 3 else 100 - i // 2) for i in range(7)] + [("b", 9, 1), (None, 1, 5)]
    df = spark.createDataFrame(rows, "source string, source_id int, posted_at int")
    order = [(r["source"], r["source_id"]) for r in records.loader_order(df).orderBy("source", "place").collect()]
    assert order == [(None, 1), ("a", 0), ("a", 1), ("a", 2), ("a", 4), ("a", 5), ("a", 6), ("a", 3), ("b", 9)]
    chosen, counts = records.ingest_split(df, 3)
    assert {(r["source"], r["source_id"]) for r in chosen.collect()} == {(None, 1), ("a", 0), ("a", 1), ("a", 2), ("b", 9)}
    assert {r["source"]: (r["processed"], r["deferred"]) for r in counts.collect()} == {None: (1, 0), "a": (3, 4), "b": (1, 0)}
