"""Insights with weights by skill: the example worked out by hand, and all subsets tried one by one."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitgrid.operators import ranking as R
from fitgrid.operators import scoring as S

KIND = "candidate_id int, vacancy_id string, keys array<string>, required array<string>, preferred array<string>, semantic double, experience double, short boolean"


def working(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    hit = lambda c: F.size(F.array_intersect(c, "keys"))
    df = df.withColumns({"required_matched": hit("required"), "n_required": F.size("required"), "preferred_matched": hit("preferred"), "n_preferred": F.size("preferred"), "reasons": F.when(F.col("short"), F.array(F.lit("experience_short"))).otherwise(F.array().cast("array<string>"))})
    skill = S.overlap_score(F.col("required_matched"), F.col("n_required"), F.col("preferred_matched"), F.col("n_preferred"))
    df = df.withColumn("fit", S.linear_fit(skill, F.col("semantic"), F.col("experience")))
    df = df.withColumn("band_rank", S.capped(S.band_rank(F.col("fit"), F.coalesce(S.coverage(F.col("required_matched"), F.col("n_required")), skill)), F.when(F.col("short"), 1)))
    return df.withColumn("rank", F.col("vacancy_id"))


def test_the_example(spark):
    own = list("ABCDE")
    rows = [(1, "v1", own, list("ABCFG"), [], 0.7, None, False), (1, "v2", own, list("ABCDEHIJ"), [], 0.7, None, False), (1, "v3", own, list("AX"), [], 0.2, None, False)]
    unit = spark.createDataFrame([], "key string, w double")
    got = [(r["vacancy_id"], r["added"]) for r in R.weighted_reach(working(spark, rows), unit).orderBy("place").collect()]
    assert got == [(r["vacancy_id"], r["added"]) for r in R.within_reach(working(spark, rows)).orderBy("place").collect()] == [("v1", ["F"]), ("v2", ["H", "I"])]
    heavy = spark.createDataFrame([("G", 2.0), ("J", 3.0), ("I", 1.5)], "key string, w double")
    got = {r["vacancy_id"]: r["added"] for r in R.weighted_reach(working(spark, rows[:1]), heavy).collect()}
    assert got == {"v1": ["G"]}
    labels = spark.createDataFrame([("F", "zeta"), ("G", "Alpha")], "key string, label string")
    got = [(r["key"], r["label"], r["gain"], r["frequency"], r["vacancies"]) for r in R.weighted_learning(working(spark, rows), unit, labels).orderBy("place").collect()]
    assert got == [("G", "Alpha", 1, 1, ["v1"]), ("F", "zeta", 1, 1, ["v1"])]
    with pytest.raises(Exception, match="positive and finite"):
        R.weighted_reach(working(spark, rows), spark.createDataFrame([("F", -1.0)], "key string, w double")).collect()


def test_all_subsets(spark):
    rng = np.random.default_rng(3)
    keys = [f"k{i:02d}" for i in range(20)]
    weight = {k: float(rng.choice([0.5, 1.0, 1.0, 2.0, 3.0])) for k in keys[:14]}
    rows = []
    for c in range(6):
        own = sorted(rng.choice(keys, 10, replace=False).tolist())
        for v in range(40):
            skills = rng.permutation(keys)[: int(rng.integers(4, 14))].tolist()
            cut = int(rng.integers(2, len(skills)))
            rows.append((c, f"v{v:02d}", own, skills[:cut], skills[cut:], float(rng.choice([0.5, 0.7, 0.9])), None, bool(rng.random() < 0.1)))
    df = working(spark, rows)
    now = {(r["candidate_id"], r["vacancy_id"]): (r["band_rank"], r["fit"]) for r in df.collect()}

    def after(row, added):
        _, _, own, required, preferred, semantic, _, short = row
        has = set(own) | set(added)
        total = sum(S.REQUIRED * weight.get(k, 1.0) for k in required) + sum(S.PREFERRED * weight.get(k, 1.0) for k in preferred)
        hit = sum(S.REQUIRED * weight.get(k, 1.0) for k in required if k in has) + sum(S.PREFERRED * weight.get(k, 1.0) for k in preferred if k in own)
        fit = (S.W_SKILL * hit / total + S.W_SEMANTIC * semantic) / (S.W_SKILL + S.W_SEMANTIC)
        strong = fit >= 0.70 and sum(k in has for k in required) / len(required) >= 0.8 and not short
        return fit, strong

    want, gains = {}, {}
    for row in rows:
        c, v, own, required = row[:4]
        band, fit = now[c, v]
        missing = [k for k in required if k not in own]
        for k in missing:
            got = gains.setdefault((c, k), [0, 0, []])
            got[1] += 1
            if band != 0 and after(row, [k])[1]:
                got[0] += 1
                got[2].append(v)
        if band != 1:
            continue
        for size in (1, 2):
            best = None
            for added in itertools.combinations(missing, size):
                value, strong = after(row, added)
                if strong and (best is None or value > best[0] + 1e-12):
                    best = (value, list(added))
            if best:
                want.setdefault(c, []).append((size, -fit, v, best[1]))
                break
    w = spark.createDataFrame(list(weight.items()), "key string, w double")
    got = {}
    for r in R.weighted_reach(df, w).orderBy("candidate_id", "place").collect():
        got.setdefault(r["candidate_id"], []).append((r["vacancy_id"], r["added"]))
    assert got and got == {c: [(v, added) for _, _, v, added in sorted(x)[: R.REACH]] for c, x in want.items()}
    got = {}
    for r in R.weighted_learning(df, w).orderBy("candidate_id", "place").collect():
        got.setdefault(r["candidate_id"], []).append((r["key"], r["gain"], r["frequency"], r["vacancies"]))
    learn = {}
    for (c, k), (gain, n, where) in gains.items():
        if gain:
            learn.setdefault(c, []).append((-gain, -n, k, where))
    assert got == {c: [(k, -g, -n, where) for g, n, k, where in sorted(x)[: R.LEARN]] for c, x in learn.items()}
