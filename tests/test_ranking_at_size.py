"""What keeps the ranking bounded: products once a vector, bounds before a sort, adjustments before pairs, counts before ranks."""

import pytest
from pyspark.sql import functions as F

from fitgrid.operators import evaluate as E
from fitgrid.operators import ranking as R

DIMS = 3


def tables(spark, n=400, people=4):
    vectors = spark.createDataFrame([(i, [float((i * (d + 2)) % 7) / 10 - 0.3 for d in range(DIMS)]) for i in range(20)], "vector_id long, embedding array<double>")
    rows = [(i, i % 9, i % 4, "remote" if i % 3 else "on_site", i % 4, [], [i % 11, 20 + i % 3], [i % 5], i % 23) for i in range(n)]
    v = spark.createDataFrame(rows, "vacancy_id long, posted_at long, years int, mode string, country int, niches array<string>, required array<long>, preferred array<long>, vector_id long")
    c = spark.createDataFrame([(i, list(range(i % 5, 23, 2)), 12 * i, i % 4, [], None if i == 2 else [0.1 * i, 0.5, -0.2]) for i in range(people)], "candidate_id long, keys array<long>, months int, home int, avoid array<string>, c_embedding array<double>")
    return v, c, vectors


def lines(df):
    names = ("candidate_id", "vacancy_id", "required_matched", "preferred_matched", "semantic_raw", "fit", "band_rank", "hidden")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("slots", [256, 2])
def test_products_of_vectors_are_those_of_pairs(spark, monkeypatch, slots):
    monkeypatch.setattr(R, "SLOTS", slots)
    v, c, vectors = tables(spark)
    plain = R.scored(R.pairs(v.join(vectors, "vector_id", "left").drop("vector_id"), c))
    found = R.scored(R.pairs(v, c, vectors))
    assert lines(found) == lines(plain) and found.count() == 1600


def test_working_set_is_bounded_before_it_is_sorted(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARE", 4)
    v, c, vectors = tables(spark, 2000)
    df = R.scored(R.pairs(v, c, vectors), floor=-0.15, ceil=0.25)
    rows = [r for r in lines(df) if not r[-1]]
    posted = {r["vacancy_id"]: r["posted_at"] for r in v.collect()}
    want = set()
    for i in range(4):
        own = sorted((r for r in rows if r[0] == i), key=lambda r: (r[6], -r[5], -posted[r[1]], r[1]))
        want |= {(i, r[1], n + 1) for n, r in enumerate(own[:10])}
    assert {tuple(r) for r in R.working_set(df, 10).select("candidate_id", "vacancy_id", "rank").collect()} == want
    assert 40 <= R._no_worse(df, 10).count() < len(rows) / 4


def test_candidates_with_few_pairs_keep_them(spark):
    v, c, vectors = tables(spark, 20)
    df = R.scored(R.pairs(v, c, vectors))
    assert R.first_ranked(df, 50).count() == df.filter("NOT hidden").count()


def test_hidden_pairs_are_not_numbered(spark):
    v, c, vectors = tables(spark, 60)
    df = R.scored(R.pairs(v, c, vectors))
    got = R.ranked(df)
    assert got.count() == 240 and got.filter("hidden <> (rank IS NULL)").count() == 0
    n = {r[0]: (r[1], r[2]) for r in got.filter("rank IS NOT NULL").groupBy("candidate_id").agg(F.max("rank"), F.count_distinct("rank")).collect()}
    assert all(a == b for a, b in n.values())


def test_adjustments_of_vacancies_before_pairs(spark):
    v, c, vectors = tables(spark, 60)
    given = spark.createDataFrame([(i, i % 2 == 0, 2, "asked") for i in range(0, 60, 5)], "vacancy_id long, hidden boolean, cap int, reason string")
    after = R.merged_adjustments(R.scored(R.pairs(v, c, vectors)), given, ["vacancy_id"])
    before = R.merged_adjustments(R.scored(R.pairs(R.adjusted(v, given, ["vacancy_id"]), c, vectors)))
    assert lines(before) == lines(after)


def test_weighted_overlap_by_many_tasks(spark, monkeypatch):
    skills = spark.createDataFrame([(i, k, k < 3) for i in range(50) for k in range(i % 7)], "vacancy_id long, key long, must boolean")
    keys = spark.createDataFrame([(c, k) for c in range(5) for k in range(c, 7, 2)], "candidate_id long, key long")
    weights = spark.createDataFrame([(0, 2.0), (3, 0.5)], "key long, w double")
    whole = sorted(map(tuple, R.weighted_overlap(skills, keys, weights).collect()))
    monkeypatch.setattr(R, "LINKS", 20)
    many = R.weighted_overlap(skills, keys, weights)
    assert sorted(map(tuple, many.collect())) == whole and many.rdd.getNumPartitions() > 4


def test_spearman_of_repeated_rows(spark):
    rows = [("a", x % 5, x % 3) for x in range(200)] + [("b", 1, x) for x in range(4)] + [("c", None if x == 0 else x, x * x % 7) for x in range(9)]
    df = spark.createDataFrame(rows, "by string, x int, y int")
    ranked = E.average_ranks(E.average_ranks(df, "by", "x", "rx"), "by", "y", "ry")
    want = {r[0]: (r[1], r[2]) for r in ranked.filter("by <> 'b'").groupBy("by").agg(F.corr("rx", "ry"), F.count("*")).collect()}
    got = {r["by"]: (r["spearman"], r["n"]) for r in E.spearman(df, "by", "x", "y").collect()}
    assert got.pop("b") == (None, 4) and {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 for k in ("a", "c"))


def test_insights_pair_vacancies_once(spark):
    """The working set is read up to three times, and none of them works it out again."""
    from fitgrid.plans import ranking as P

    for query in (P.weighted_learning, P.weighted_reach, P.within_reach, P.worth_learning, P.in_demand):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "o_orderkey" not in plan, query.__name__
