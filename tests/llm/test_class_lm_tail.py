"""Words beyond the head: every one gets its class by exchange, and scores hold to plain loops over those classes."""

import collections
import math
import zlib

import numpy as np
import pytest

from fitgrid.llm import class_lm
from fitgrid.llm.kernels import Words

K, CORE = class_lm.K, class_lm.CORE


def _hash(word):
    return int(Words(np.array([0, len(word)]), np.frombuffer(word.encode(), np.uint8), lower=True).hash[0])


def _bucket(word):
    return int(class_lm._bucket(Words(np.array([0, len(word)]), np.frombuffer(word.encode(), np.uint8), lower=True))[0])


def _rows():
    rng = np.random.default_rng(8)
    rows = []
    for d in range(300):
        text = [f"{'uv'[d % 2]}{i}" for i in rng.integers(0, 30, 40)]
        for at in range(3, 40, 9):  # words that occur once, of one bucket, in two contexts
            text[at] = f"{'rs'[d % 2]}{d}x{at}end"
        if d % 7 == 0:
            text += [f"n{d}end", f"n{d}end", f"m{d}end", f"o{d % 14}end"]
        rows.append((d, " ".join(text)))
    return [*rows, (rows[10][0], rows[10][1]), (900, None), (901, ""), (902, "solo"), (903, "Solo solo zzz")]


def test_words_that_occur_once_get_a_class_by_their_bigrams(spark, monkeypatch):
    rows = _rows()
    monkeypatch.setattr(class_lm, "HEAD", 40)
    monkeypatch.setattr(class_lm, "HELD", 500)
    seen, real = [], class_lm.tail_classes

    def spy(train, head, kind, of, n, words):
        kinds, new = real(train, head, kind, of, n, words)
        seen.append((dict(zip(head.tolist(), kind.tolist(), strict=True)), of, n, words, {r["h"] % 2**64: r["kind"] for r in kinds.collect()}, new))
        return kinds, new

    monkeypatch.setattr(class_lm, "tail_classes", spy)
    got = class_lm.class_lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    head, of, before, n_tail, tail, n = seen[0]
    texts = {d: (t or "").lower().split() for d, t in rows}
    train = [(d, (t or "").lower().split()) for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    count = collections.Counter(w for _, t in train for w in t)
    assert len(tail) == n_tail == len(count) - len(head) > 1000
    assert not set(tail) & set(head) and {_hash(w) for w in count} == set(tail) | set(head)

    known = {w: int({**head, **tail}[_hash(w)]) for w in count}
    kind = lambda w: known.get(w, int(of[CORE + _bucket(w)]))
    assert sum(c == 1 and known[w] != of[CORE + _bucket(w)] for w, c in count.items()) > 500

    def first(w):
        return int(head.get(_hash(w), of[CORE + _bucket(w)]))

    some = [w for w in count if _hash(w) in tail][::40] + [f"n{d}end" for d in (7, 14, 21) if f"n{d}end" in count]
    for w in some:  # the best of all classes while every other word stays
        by = []
        for c in range(K - 1):
            m = before.copy()
            for _, t in train:
                if w in t:
                    for moved, sign in ((False, -1), (True, 1)):
                        of_text = [K - 1, *(c if moved and x == w else first(x) for x in t), K - 1]
                        np.add.at(m, (of_text[:-1], of_text[1:]), sign)
            by.append(class_lm.likelihood(m))
        assert by[known[w]] == pytest.approx(max(by), abs=1e-6, rel=0)

    plain = np.zeros((K, K))
    for _, t in train:
        of_text = [K - 1, *map(kind, t), K - 1]
        for a, b in zip(of_text, of_text[1:], strict=False):
            plain[a, b] += 1
    assert (n == plain).all() and class_lm.likelihood(n) > class_lm.likelihood(before)

    size, types = n.sum(0), np.bincount(list(known.values()), minlength=K).astype(float)
    types[K - 1] = 1
    unigram = (size + 0.1) / (size.sum() + 0.1 * K)
    move = np.log10((n + class_lm.BACKOFF * unigram) / (n.sum(1, keepdims=True) + class_lm.BACKOFF))
    ends = len(train)

    def emitted(w, k):
        top = (count[w] if w else ends) - class_lm.DISCOUNT if not w or w in count else class_lm.DISCOUNT * types[k] if types[k] else 1.0
        return math.log10(top) - math.log10(max(size[k], 1) if types[k] else 1.0)

    assert len(got) == len(rows)
    for r in got:
        words = [*texts[r["doc_id"]], None]
        kinds = [K - 1, *(kind(w) if w else K - 1 for w in words)]
        want = sum(move[a, b] + emitted(w, b) for a, b, w in zip(kinds, kinds[1:], words, strict=False))
        assert r["score"] == pytest.approx(want)
        assert r["n_known"] == sum(w is None or w in count for w in words)


def test_probabilities_after_a_class_sum_to_one_over_words_and_one_unknown():
    """The unknown word of a class has what the discount leaves over."""
    counts, kinds = np.array([1.0, 1, 4, 7]), np.array([0, 0, 1, 1])
    size, types = np.bincount(kinds, counts), np.bincount(kinds)
    known = [((counts[kinds == k] - class_lm.DISCOUNT) / size[k]).sum() for k in (0, 1)]
    assert np.allclose(known + class_lm.DISCOUNT * types / size, 1)


def test_exchange_goes_on_until_nothing_moves():
    rng = np.random.default_rng(4)
    units, classes = 90, 12
    pairs = rng.poisson(0.7, (units, units)).astype(float)
    of = class_lm.exchange(pairs, classes)
    one = np.eye(classes + 1)[of]
    to, come, own = pairs @ one, (one.T @ pairs).T, np.diagonal(pairs)
    own_class = one * own[:, None]
    n = one.T @ pairs @ one

    def likelihood(of):
        m = np.eye(classes + 1)[of].T @ pairs @ np.eye(classes + 1)[of]
        return class_lm.likelihood(m)

    best = class_lm.best_classes(n, to - own_class, come - own_class, own, of)
    here = likelihood(of)
    for u in range(units - 1):
        assert likelihood(np.where(np.arange(units) == u, best[u], of)) <= here + 1e-6
