"""Hand-computed cases and boundaries of the scoring rules."""

import pytest
from pyspark.sql import functions as F

from fitgrid.operators import records as R
from fitgrid.operators import scoring as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0][0]


def lit(x):
    return F.lit(x) if x is not None else F.lit(None).cast("double")


def test_overlap_of_two_of_three_required_and_one_of_two_preferred(spark):
    assert one(spark, S.overlap_score(lit(2), lit(3), lit(1), lit(2))) == pytest.approx(2.5 / 4)


def test_overlap_without_skills_is_unknown(spark):
    assert one(spark, S.overlap_score(lit(0), lit(0), lit(0), lit(0))) is None


@pytest.mark.parametrize("years,months,want", [(None, 10, None), (0, 10, None), (3, None, None), (3, 36, 1.0), (3, 6, 0.0), (3, 21, 0.5), (1, 60, 1.0)])
def test_experience(spark, years, months, want):
    assert one(spark, S.experience_fit(lit(years), lit(months))) == (want if want is None else pytest.approx(want))


@pytest.mark.parametrize("parts,want", [((None, None, 1.0), None), ((1.0, None, None), 1.0), ((0.5, 1.0, None), (0.2 + 0.45) / 0.85), ((1.0, 1.0, 0.0), 0.85)])
def test_unknown_parts_give_their_weight_away(spark, parts, want):
    got = one(spark, S.linear_fit(*(lit(p) for p in parts)))
    assert got is None if want is None else got == pytest.approx(want)


@pytest.mark.parametrize("fit,cover,cap,want", [(None, 1.0, None, "unscored"), (0.9, None, None, "partial"), (0.6, None, None, "weak"), (0.7, 0.8, None, "strong"), (0.7, 0.79, None, "partial"), (0.69, 0.9, None, "partial"), (0.65, 0.5, None, "partial"), (0.64, 0.9, None, "weak"), (0.9, 0.9, 1, "partial"), (0.1, 0.1, 1, "weak")])
def test_bands(spark, fit, cover, cap, want):
    rank = S.capped(S.band_rank(lit(fit), lit(cover)), F.lit(cap).cast("int"))
    assert one(spark, S.band_name(rank)) == want


def test_weights_must_add_up():
    with pytest.raises(ValueError):
        S.Weights(0.5, 0.5, 0.5)


def test_months_of_touching_and_nested_intervals(spark):
    spans = spark.createDataFrame([("a", 0, 11), ("a", 12, 13), ("a", 5, 6), ("b", 3, 3), ("b", 9, 10)], "who string, first int, last int")
    assert {r["who"]: r["months"] for r in R.covered_months(spans, "who").collect()} == {"a": 14, "b": 3}


def test_nearest_rank_of_five(spark):
    df = spark.createDataFrame([("s", float(v), i) for i, v in enumerate((1, 2, 3, 4, 10))], "stage string, ms double, at int")
    row = R.nearest_rank(df, "stage", "ms", ["at"]).collect()[0]
    assert (row["p50"], row["p95"]) == (3.0, 10.0)


def test_older_fetch_never_overwrites(spark):
    old = spark.createDataFrame([(1, 10, 5, "x"), (2, 10, 5, "x")], "id int, fetched_at int, first_seen_at int, v string")
    new = spark.createDataFrame([(1, 9, 9, "y"), (2, 10, 10, "y"), (3, 1, 1, "y")], "id int, fetched_at int, first_seen_at int, v string")
    got = {r["id"]: (r["v"], r["first_seen_at"], r["skipped_older"]) for r in R.upsert(old, new, ["id"]).collect()}
    assert got == {1: ("x", 5, True), 2: ("y", 5, False), 3: ("y", 1, False)}
