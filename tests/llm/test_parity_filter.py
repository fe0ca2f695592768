"""The parity bitmaps never set apart two sets that link."""

import numpy as np
from pyspark.sql import functions as F

from fitgrid.llm.near_dedup import WORDS, may_link, near_duplicates, parities


def test_ones_are_at_most_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 5, 80, 3000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for gone in (0, 1, size // 5, size // 2):
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, gone, dtype=np.uint64)]))
            ones = sum(int(x).bit_count() for x in (parities(a) ^ parities(b)).view(np.uint64))
            assert len(parities(a)) == WORDS and ones <= len(np.setxor1d(a, b))


def test_filter_keeps_every_link(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 60)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, len(a) // 3 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, 9)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        linked = 100 * common >= 80 * (len(a) + len(b) - common)
        rows.append((len(a), parities(a).tolist(), len(b), parities(b).tolist(), linked))
    df = spark.createDataFrame(rows, "n long, x array<long>, m long, y array<long>, linked boolean")
    got = df.select("linked", may_link(F.col("n"), F.col("x"), F.col("m"), F.col("y"), 80).alias("may")).collect()
    assert any(r["linked"] for r in got) and all(r["may"] for r in got if r["linked"])
    assert not all(r["may"] for r in got)


def test_texts_around_the_threshold(spark):
    """Chains of edited copies: the classes equal those of all pairs compared."""
    rng = np.random.default_rng(5)
    texts = []
    for g in range(6):
        words = [f"w{g}x{j}" for j in range(60)]
        for _ in range(8):
            words = list(words)
            for at in rng.integers(0, 60, int(rng.integers(0, 4))):
                words[at] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(57)} for t in texts]
    label = list(range(len(texts)))
    moved = True
    while moved:
        moved = False
        for i in range(len(texts)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label))
