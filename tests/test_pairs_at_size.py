"""Pairs of names in groups of any size: by plain loops, and what they may shuffle."""

import numpy as np
from test_extraction import greedy

from fitgrid.functions import fuzzy, pairing
from fitgrid.operators import fuzzy_pairs


def test_likeness_of_many_is_that_of_two(monkeypatch):
    rng = np.random.default_rng(8)
    words = ["data", "date", "engineer", "enginer", "a", "ab", "abc", "of", "analyst", "дані", "n\0l", "😀x", "x" * 70, "x" * 69 + "y", "longword" * 5, "longwird" * 5]
    for turn in range(40):
        monkeypatch.setattr(pairing, "SLICE", 20 if turn % 2 else 1 << 18)
        monkeypatch.setattr(pairing, "AT_ONCE", 7 if turn % 3 else 1 << 14)
        gold, predicted = (list(dict.fromkeys(" ".join(rng.choice(words, int(rng.integers(0, 6)))) for _ in range(int(rng.integers(0, 25))))) for _ in "gp")
        for least in (85.0, 40.0):
            want = {(g, p): s for g, a in enumerate(gold) for p, b in enumerate(predicted) if (s := fuzzy.token_set_ratio(a, b)) >= least}
            g, p, score = pairing.alike_pairs(gold, predicted, least)
            assert dict(zip(zip(g.tolist(), p.tolist(), strict=True), score.tolist(), strict=True)) == want
        assert pairing.matched(gold, predicted, 85.0) == greedy(gold, predicted)


def test_large_groups_are_paired_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = ["data", "date", "engineer", "enginer", "senior", "lead", "a", "of", "analyst", "analysts"]
    sides = [[(group, i, " ".join(rng.choice(words, 3))) for group in ("a", "b", None) for i in range(9 if group == "b" else 40)] for _ in "gp"]
    gold, predicted = (spark.createDataFrame(s, "grp string, pos long, text string") for s in sides)
    keys = [{g: list(dict.fromkeys(t for of, _, t in s if of == g)) for g in ("a", "b", None)} for s in sides]
    want = []
    for g in ("a", "b"):
        tp = greedy(keys[0][g], keys[1][g])
        want.append((g, tp, len(keys[1][g]) - tp, len(keys[0][g]) - tp))
    for cells, tile in ((1 << 23, 1 << 13), (200, 7), (0, 3)):
        monkeypatch.setattr(fuzzy_pairs, "CELLS", cells)
        monkeypatch.setattr(fuzzy_pairs, "TILE_ROWS", tile)
        got = [tuple(r) for r in fuzzy_pairs.pair_counts(gold, predicted, "grp").collect()]
        # texts without a group are counted and never paired
        assert sorted(r for r in got if r[0]) == want and sum(r[1] for r in got if r[0] is None) == 0
        assert [sum(r[i] for r in got if r[0] is None) for i in (2, 3)] == [len(keys[1][None]), len(keys[0][None])]


def test_pairs_of_a_group_are_not_shuffled(spark):
    """Six hundred names that share words: 360,000 pairs of a group, of which only the texts may be shuffled, and nothing kept."""
    rows = [("a", i, f"part{i // 12} brand{i % 12} mark {i % 7}") for i in range(600)]
    df = spark.createDataFrame(rows, "grp string, pos long, text string").repartition(4).cache()
    before = shuffled(spark)
    (got,) = fuzzy_pairs.pair_counts(df, df, "grp").collect()
    assert tuple(got) == ("a", 600, 0, 0)
    assert shuffled(spark) - before < 4000


def shuffled(spark):
    """Rows that were written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_groups_go_to_as_many_tasks_as_their_pairs_need(spark, monkeypatch):
    rows = [(f"g{i % 9}", i, f"name{i} of {i % 5}") for i in range(90)] + [("none", 0, " ... "), ("none", 1, None)]
    df = spark.createDataFrame(rows, "grp string, pos long, text string")
    monkeypatch.setattr(fuzzy_pairs, "TASK", 3000)
    got = fuzzy_pairs.pair_counts(df, df, "grp")
    assert got.rdd.getNumPartitions() == 1 + (9 * (100 + 64 * 20 + 2048) + (4 + 64 * 4 + 2048)) // 3000
    assert sorted(map(tuple, got.collect())) == [(f"g{i}", 10, 0, 0) for i in range(9)]
