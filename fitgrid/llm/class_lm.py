"""Brown class-based bigram model with exchange clustering.

P(w | previous) = P(class(w) | class(previous)) * P(w | class(w)).

The units that are clustered first are the most frequent words, and for every other word
the bucket of its last letters. Units move between classes (exchange) as long as the
likelihood of the class bigrams rises. The counts of units' bigrams cover all training
texts; there are at most UNITS squared of them, however large the corpus. That only seeds
the exchange of all words: in each of ROUNDS rounds every word of the head, the most frequent
included from the second round on, goes to the class that is best for its own bigrams with the
classes, all such words at once, and the class bigrams are counted again; a round that lowers the
likelihood is undone and ends it. Then all other words of the training texts, down to those that
occur once, go to theirs in the same way; only unknown words have the class of their bucket.
The head are the words with LEAST occurrences (and a share RARE of all tokens), or the HEAD most
frequent if they are more: their counts and classes go to every executor (RARE bounds their
number). Those of the others, the tail, are joined: by their bigrams with each other, and with the head's
classes. Emission takes DISCOUNT off each known word for one
unknown word of its class; transitions are interpolated with the class frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, in_fold, saved, table
from .kernels import Words, chunks, mix

CORE, BUCKETS, CLASSES = 1000, 256, 48
#: Words whose counts every executor holds at least (17 bytes each).
HEAD = 1 << 17
#: Occurrences, and share of all tokens, from which every executor holds a word's counts.
LEAST, RARE = 10, 1e-7
#: Such words that one task assigns, about; and others, whose bigrams are few.
TASK_WORDS, TASK_TAIL = 8192, 65536
DISCOUNT, BACKOFF, ROUNDS = 0.5, 20.0, 1
#: Entries that a task holds before it sums them up, or gives them on.
HELD = 500_000
END = np.uint64(1)
UNITS, K = CORE + BUCKETS + 1, CLASSES + 1


def _bucket(w: Words) -> np.ndarray:
    """A number for the last three bytes of each word, below BUCKETS."""
    out = np.zeros(len(w.starts), np.uint64)
    for back in (1, 2, 3):
        at = w.ends - back
        out = out * np.uint64(257) + np.where(at >= w.starts, w.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return (mix(out) % np.uint64(BUCKETS)).astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys (first array), any value of the second, sums of the last."""
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    key, first, inverse = np.unique(cols[0], return_index=True, return_inverse=True)
    return (key, *(c[first] for c in cols[1:-1]), np.bincount(inverse, cols[-1], len(key)).astype(np.int64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(p):
        return pa.RecordBatch.from_arrays([pa.array(p[0].view(np.int64), pa.int64()), pa.array(p[1], pa.int16()), pa.array(p[2], pa.int64())], ["h", "bucket", "n"])

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        for _, _, off, data in chunks(b["text"]):
            w = Words(off, data, lower=True)
            key, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            held.append((key, _bucket(w)[first], n))
            held.append((np.array([END]), np.array([-1]), np.array([len(off) - 1])))
            if sum(len(p[0]) for p in held) > HELD:
                held = [_merged(held)]
                if len(held[0][0]) > HELD // 2:
                    yield out(held.pop())
    if held:
        yield out(_merged(held))


def _units(w: Words, core: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(core, w.hash), max(len(core) - 1, 0))
    own = core[at] == w.hash if len(core) else np.zeros(len(w.hash), bool)
    return np.where(own, ids[at] if len(core) else 0, CORE + _bucket(w))


def _with_ends(values: np.ndarray, w: Words, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of each text's words and then ``end``; and where each text starts (one more than texts)."""
    starts = w.off + np.arange(len(w.off))
    out = np.full(len(values) + len(w.n), end, np.int64)
    out[np.arange(len(values)) + w.doc()] = values
    return out, starts


def _bigrams(core: np.ndarray, ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(UNITS * UNITS, np.int64)
        for b in batches:
            for _, _, off, data in chunks(b["text"]):
                w = Words(off, data, lower=True)
                unit, starts = _with_ends(_units(w, core, ids), w, UNITS - 1)
                before = np.concatenate([[UNITS - 1], unit[:-1]])
                before[starts[:-1]] = UNITS - 1
                cell, times = np.unique(before * UNITS + unit, return_counts=True)
                n[cell] += times
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n[cell], pa.int64())], ["cell", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each unit from their bigram counts (square); the last unit, the end, keeps a class of its own. Sweeps go
    on until no unit moves: each move raises the likelihood by more than its rounding, so that they end."""
    units = len(pairs)
    total = pairs.sum(0) + pairs.sum(1)
    of = np.full(units, classes)
    order = [u for u in np.argsort(-total, kind="stable") if u != units - 1]
    for rank, u in enumerate(order):
        of[u] = rank % classes
    k = classes + 1
    one = np.zeros((units, k))
    one[np.arange(units), of] = 1
    n = one.T @ pairs @ one
    to, come = pairs @ one, (one.T @ pairs).T  # per unit: counts towards and from each class
    least, moved = 1e-9 + 1e-12 * float(total.sum()), 1
    while moved:
        moved = 0
        for u in order:
            if not total[u]:
                continue
            a, self_n = of[u], pairs[u, u]
            r, c = to[u].copy(), come[u].copy()
            r[a] -= self_n
            c[a] -= self_n
            n[a] -= r
            n[:, a] -= c
            n[a, a] -= self_n
            rows, cols = n.sum(1) + c, n.sum(0) + r  # the classes' own totals keep the unit's bigrams with them
            base = _xlogx(n)
            gain = (_xlogx(n + r[None, :]) - base).sum(1) + (_xlogx(n + c[:, None]) - base).sum(0)
            diag = np.diagonal(n)
            gain += _xlogx(diag + r + c + self_n) - _xlogx(diag) - (_xlogx(diag + r) - _xlogx(diag)) - (_xlogx(diag + c) - _xlogx(diag))
            gain -= _xlogx(rows + r.sum() + self_n) - _xlogx(rows) + _xlogx(cols + c.sum() + self_n) - _xlogx(cols)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + least:
                b = a
            n[b] += r
            n[:, b] += c
            n[b, b] += self_n
            if b != a:
                moved += 1
                of[u] = b
                to[:, a] -= pairs[:, u]
                to[:, b] += pairs[:, u]
                come[:, a] -= pairs[u]
                come[:, b] += pairs[u]
    return of


def best_classes(n: np.ndarray, to: np.ndarray, come: np.ndarray, own: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Class of each word by the gain of ``exchange``, while all others stay: from the class bigrams ``n``, the
    word's bigrams towards and from each class without those with itself, the latter, and its class in ``n``."""
    at_now = np.arange(len(n)) == now[:, None]
    lost = at_now * (to.sum(1) + own)[:, None], at_now * (come.sum(1) + own)[:, None]
    # the classes' own totals keep the word's bigrams with them, wherever it goes
    rows, cols = n.sum(1) - lost[0], n.sum(0) - lost[1]
    diag = np.diagonal(n) - at_now * (to + come + own[:, None])
    own = own[:, None]
    gain = _xlogx(diag + to + come + own) - _xlogx(diag + to) - _xlogx(diag + come) + _xlogx(diag)
    gain -= _xlogx(rows + to.sum(1, keepdims=True) + own) - _xlogx(rows) + _xlogx(cols + come.sum(1, keepdims=True) + own) - _xlogx(cols)
    for mine, other, table in ((to, come, n.T), (come, to, n)):  # only cells that the word has bigrams in change
        w, c = np.nonzero(mine)
        left = table[c]
        left[np.arange(len(w)), now[w]] -= mine[w, c]
        same = np.flatnonzero(c == now[w])
        left[same] -= other[w[same]]
        left[same, now[w[same]]] -= own[w[same], 0]
        change = _xlogx(left + mine[w, c][:, None]) - _xlogx(left)
        if len(w):
            starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            gain[w[starts]] += np.add.reduceat(change, starts)
    return np.argmax(gain[:, :-1], 1)


def _look_up(w: Words, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in ``head`` (sorted), and whether it is there."""
    at = np.minimum(np.searchsorted(head, w.hash), max(len(head) - 1, 0))
    return at, head[at] == w.hash if len(head) else np.zeros(len(w.hash), bool)


def _kinds(w: Words, at: np.ndarray, found: np.ndarray, kind: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The class of each word: its own if it is in the head, else its bucket's."""
    return np.where(found, kind[at] if len(kind) else 0, of[CORE + _bucket(w)])


def _contexts(head, kind, own, often, of):
    """For words with ``own``: place in the head, and their bigrams, each as the class after, K + the class before,
    or 2 K with itself. Of words in ``often`` (places in the head) a task gives sums, of others a byte for each bigram."""
    wide = 2 * K + 1
    slot = np.full(len(head), -1)
    slot[often] = np.arange(len(often))

    def binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        key = np.sort(np.concatenate(held))
        word = key // wide
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        cells = binary(np.append(starts, len(key)), (key % wide).astype(np.uint8))
        return pa.RecordBatch.from_arrays([pa.array(word[starts].astype(np.int32)), pa.array(np.zeros(len(starts), bool)), cells], ["word", "summed", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sums = np.zeros(len(often) * wide, np.int64)
        for b in batches:
            for _, _, off, data in chunks(b["text"]):
                w = Words(off, data, lower=True)
                at, found = _look_up(w, head)
                classes, _ = _with_ends(_kinds(w, at, found, kind, of), w, K - 1)
                word, _ = _with_ends(np.where(found & own[at], at, -1), w, -1)
                here = np.flatnonzero(word >= 0)
                me = word[here]  # an end stands after each text, and so before each
                after = np.where(word[here + 1] == me, 2 * K, classes[here + 1])
                first = word[here - 1] != me
                word = np.concatenate([me, me[first]])
                cell = np.concatenate([after, (K + classes[here - 1])[first]])
                place = slot[word]
                dense = place >= 0
                sums += np.bincount(place[dense] * wide + cell[dense], minlength=len(sums))
                held.append((word * wide + cell)[~dense])
                if sum(len(p) for p in held) > HELD:
                    yield out(held)
                    held = []
        if sum(len(p) for p in held):
            yield out(held)
        at = np.flatnonzero(sums.reshape(-1, wide).any(1))
        if len(at):
            cells = binary(np.arange(len(at) + 1) * 8 * wide, sums.reshape(-1, wide)[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(often)[at].astype(np.int32)), pa.array(np.ones(len(at), bool)), cells], ["word", "summed", "cells"])

    return run


def _assigned(n: np.ndarray, kind: np.ndarray):
    wide = 2 * K + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = np.zeros(0, np.int64), np.zeros((0, wide), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            word, summed, cells = b["word"].to_numpy(), b["summed"].to_numpy(zero_copy_only=False), b["cells"]
            ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
            flat = np.frombuffer(cells.buffers()[2], np.uint8)
            new = np.union1d(words, word)
            grown = np.zeros((len(new), wide), np.int64)
            grown[np.searchsorted(new, words)] = sums
            place = np.searchsorted(new, word)
            row = np.repeat(place, np.where(summed, 0, np.diff(ends)))
            single = flat[ends[0] : ends[-1]][np.repeat(~summed, np.diff(ends))]
            grown += np.bincount(row * wide + single, minlength=grown.size).reshape(grown.shape)
            for i in np.flatnonzero(summed):
                grown[place[i]] += np.frombuffer(flat[ends[i] : ends[i + 1]].tobytes(), np.int64)
            words, sums = new, grown
        for i in range(0, len(words), 128):
            w, c = words[i : i + 128], sums[i : i + 128].astype(float)
            best = best_classes(n, c[:, :K], c[:, K : 2 * K], c[:, 2 * K], kind[w].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(best.astype(np.int8))], ["word", "kind"])

    return run


def _class_bigrams(head, kind, of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(K * K, np.int64)
        for b in batches:
            for _, _, off, data in chunks(b["text"]):
                w = Words(off, data, lower=True)
                classes, _ = _with_ends(_kinds(w, *_look_up(w, head), kind, of), w, K - 1)
                before = np.concatenate([[K - 1], classes[:-1]])  # the class before a text is the end's
                n += np.bincount(before * K + classes, minlength=K * K)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(K * K)), pa.array(n)], ["cell", "n"])

    return run


def likelihood(n: np.ndarray) -> float:
    """The part of the training texts' log likelihood that depends on the classes, from the class bigrams."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(0)).sum() - _xlogx(n.sum(1)).sum())


def own_classes(train: DataFrame, head: np.ndarray, kind: np.ndarray, own: np.ndarray, often: np.ndarray, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``kind`` with the best class of each word of ``own``, and the class bigrams that follow. ``often`` are the
    places in ``head`` of words too frequent to be shuffled bigram by bigram."""
    if not own.any():
        return kind, n
    cells = train.mapInArrow(_contexts(head, kind, own, often, of), "word int, summed boolean, cells binary").repartition(1 + int(own.sum()) // TASK_WORDS, "word")
    got = cells.mapInArrow(_assigned(n, kind), "word int, kind tinyint").toArrow()
    kind = kind.copy()
    kind[got["word"].to_numpy()] = got["kind"].to_numpy()
    got = train.mapInArrow(_class_bigrams(head, kind, of), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(K * K)
    n[got["cell"].to_numpy()] = got["n"].to_numpy()
    return kind, n.reshape(K, K)


def _tail_contexts(head, kind, of):
    """For each word that is not in ``head``: its hash, class, and bigrams, a byte for each: the class after, K + the class
    before, 2 K more if that word is not in the head either, 4 K with itself. And pairs of such words that meet."""

    def out(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        word, now, cell = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(word, kind="stable")
        word, now, cell = word[order], now[order], cell[order]
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        cells = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(word)).astype(np.int32)), pa.py_buffer(cell)])
        return pa.RecordBatch.from_arrays([pa.array(word[starts].view(np.int64)), pa.nulls(len(starts), pa.int64()), pa.array(now[starts]), cells], ["h", "other", "old", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            for _, _, off, data in chunks(b["text"]):
                w = Words(off, data, lower=True)
                classes, lost, word = _tail_of(w, *_look_up(w, head), kind, of)
                here = np.flatnonzero(lost)  # an end stands after each text, and so before each
                me, now = word[here], classes[here].astype(np.int8)
                twice, again = lost[here + 1] & (word[here + 1] == me), lost[here - 1] & (word[here - 1] == me)
                after = np.where(twice, 4 * K, classes[here + 1] + 2 * K * lost[here + 1])
                before = (K + classes[here - 1] + 2 * K * lost[here - 1])[~again]
                held.append((np.concatenate([me, me[~again]]), np.concatenate([now, now[~again]]), np.concatenate([after, before]).astype(np.uint8)))
                met = here[lost[here + 1]]
                if len(met):
                    yield pa.RecordBatch.from_arrays([pa.array(word[met].view(np.int64)), pa.array(word[met + 1].view(np.int64)), pa.nulls(len(met), pa.int8()), pa.nulls(len(met), pa.binary())], ["h", "other", "old", "cells"])
                if sum(len(p[0]) for p in held) > HELD:
                    yield out(held)
                    held = []
        if sum(len(p[0]) for p in held):
            yield out(held)

    return run


def _tail_of(w: Words, at: np.ndarray, found: np.ndarray, kind: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token, ends included: its class, whether it is a word that is not in the head, and its hash."""
    classes, _ = _with_ends(_kinds(w, at, found, kind, of), w, K - 1)
    place = np.arange(len(w.hash)) + w.doc()
    lost, word = np.zeros(len(classes), bool), np.zeros(len(classes), np.uint64)
    lost[place], word[place] = ~found, w.hash
    return classes, lost, word


def _tail_assigned(n: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            if b.num_rows:
                cells = b["cells"]
                ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
                flat = np.frombuffer(cells.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy()
                parts.append((b["h"].to_numpy().copy(), b["old"].to_numpy().copy(), np.diff(ends), flat))
        if not parts:
            return
        h, old, many, flat = (np.concatenate(c) for c in zip(*parts, strict=True))
        words, first, at = np.unique(h, return_index=True, return_inverse=True)
        old, row = old[first].astype(np.int64), np.repeat(at, many)
        order = np.argsort(row, kind="stable")
        row, flat = row[order], flat[order]
        change, step, wide = np.zeros((K, K)), 1024, 4 * K + 1
        for lo in range(0, len(words), step):
            hi = min(lo + step, len(words))
            s, e = np.searchsorted(row, [lo, hi])
            c = np.bincount((row[s:e] - lo) * wide + flat[s:e], minlength=(hi - lo) * wide).reshape(hi - lo, wide).astype(float)
            after, before = c[:, :K], c[:, K : 2 * K]
            now = old[lo:hi]
            best = best_classes(n, after + c[:, 2 * K : 3 * K], before + c[:, 3 * K : 4 * K], c[:, 4 * K], now)
            for to, sign in ((best, 1), (now, -1)):  # bigrams with the head; those in the tail are counted by pairs
                np.add.at(change, to, sign * after)
                np.add.at(change.T, to, sign * before)
            z = hi - lo
            yield pa.RecordBatch.from_arrays([pa.array(words[lo:hi]), pa.array(now, pa.int8()), pa.array(best, pa.int8()), pa.nulls(z, pa.int32()), pa.nulls(z, pa.float64())], ["h", "old", "kind", "cell", "change"])
        z = K * K
        yield pa.RecordBatch.from_arrays([pa.nulls(z, pa.int64()), pa.nulls(z, pa.int8()), pa.nulls(z, pa.int8()), pa.array(np.arange(z), pa.int32()), pa.array(change.ravel())], ["h", "old", "kind", "cell", "change"])

    return run


def tail_classes(train: DataFrame, head: np.ndarray, kind: np.ndarray, of: np.ndarray, n: np.ndarray, words: int) -> tuple[DataFrame, np.ndarray]:
    """Of the ``words`` words of the training texts that are not in ``head``: hash and best class (h, kind), all moved at
    once, and the class bigrams that follow; the class of their bucket if that would lower the likelihood."""
    found = saved(train.mapInArrow(_tail_contexts(head, kind, of), "h long, other long, old tinyint, cells binary"), "contexts")
    own = found.filter("cells IS NOT NULL").select("h", "old", "cells").repartition(1 + words // TASK_TAIL, "h")
    moved = saved(own.mapInArrow(_tail_assigned(n), "h long, old tinyint, kind tinyint, cell int, change double"), "moved")
    kinds = moved.filter("h IS NOT NULL").select("h", "old", "kind")
    pairs = found.filter("other IS NOT NULL").select("h", "other").join(kinds, "h").select("other", F.col("old").alias("a"), F.col("kind").alias("x"))
    pairs = pairs.join(kinds.withColumnRenamed("h", "other"), "other")
    cells = F.array(*(F.struct((F.col(p).cast("int") * K + F.col(q)).alias("cell"), F.lit(c).alias("change")) for p, q, c in (("a", "old", -1.0), ("x", "kind", 1.0))))
    cells = pairs.select(F.explode(cells).alias("c")).select("c.*").union(moved.filter("cell IS NOT NULL").select("cell", "change"))
    got = cells.groupBy("cell").agg(F.sum("change").alias("change")).toArrow()
    discard(found)
    new = n.copy()
    new.ravel()[got["cell"].to_numpy()] += got["change"].to_numpy()
    better = likelihood(new) > likelihood(n)
    return kinds.select("h", F.col("kind" if better else "old").alias("kind")), new if better else n


def _scored(head, head_kind, of, log_t, log_size, head_n, total, distinct):
    """Of each text the sums over what the head decides; of its other words, once for each context, how often they stand
    between which classes (-1: a word that is not in the head either, counted as a pair with ``other``)."""
    scale = np.log10(total + 0.1 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in chunks(b["text"]):
                w = Words(off, data, lower=True)
                at, found = _look_up(w, head)
                kind, lost, word = _tail_of(w, at, found, head_kind, of)
                starts = w.off + np.arange(len(w.off))
                doc = np.repeat(np.arange(j - i), np.diff(starts))
                value = np.where(lost | lost[np.arange(len(lost)) - 1], 0.0, log_t[kind[np.arange(len(kind)) - 1], kind]) - np.where(lost, 0.0, log_size[kind])
                base = np.full(len(kind), -scale)
                place = np.arange(len(w.hash)) + w.doc()
                n = np.where(found, head_n[at] if len(head) else 0, 1).astype(float)
                value[place] += np.where(found, np.log10(np.maximum(n - DISCOUNT, 1e-9)), 0)
                base[place] += np.where(found, np.log10(n + 0.1), 0)
                rows = b["row"].slice(i, j - i)
                sums = [np.add.reduceat(x, starts[:-1]) for x in (value, base, (~lost).astype(np.int64))]
                here = np.flatnonzero(lost)
                before, after = (np.where(lost[here + s], -1, kind[here + s]) for s in (-1, 1))
                met = here[lost[here + 1]]
                for at_, a, c, other in ((here, before, after, None), (met, kind[met], kind[met + 1], word[met + 1])):
                    key = mix(word[at_] + doc[at_].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    key = mix(key + ((a + 1) * 256 + c + 1).astype(np.uint64)) if other is None else mix(key + mix(other))
                    _, first, m = np.unique(key, return_index=True, return_counts=True)
                    pick, z = at_[first], len(first)
                    yield pa.RecordBatch.from_arrays([rows.take(pa.array(doc[pick], pa.int64())), pa.array(word[pick].view(np.int64)), pa.nulls(z, pa.int64()) if other is None else pa.array(other[first].view(np.int64)), *(pa.array(x, pa.int8()) for x in (kind[pick], a[first], c[first])), pa.array(m, pa.int32()), *(pa.nulls(z, t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.int64()))], _COLS)
                z = j - i
                yield pa.RecordBatch.from_arrays([rows, *(pa.nulls(z, t) for t in (pa.int64(), pa.int64(), pa.int8(), pa.int8(), pa.int8(), pa.int32())), pa.array(w.n + 1, pa.int64()), *(pa.array(x, t) for x, t in zip(sums, (pa.float64(), pa.float64(), pa.int64()), strict=True))], _COLS)

    return run


_COLS = ["row", "h", "other", "kind", "before", "after", "m", "n_tokens", "score", "base", "known"]
_SCHEMA = "row long, h long, other long, kind tinyint, before tinyint, after tinyint, m int, n_tokens long, score double, base double, known long"


def _listed(values: np.ndarray) -> Column:
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in values.ravel()) + ")")


def class_lm_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Score every row of ``docs``; texts whose crc32(doc_id as text) modulo ``folds`` is not 0 train the model.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    (log10). A null or empty text is one end token; repeated rows each get the same
    result; without training texts every token is unknown and both scores stay finite. Texts of any
    length are scored whole; other columns, whatever their names, are not read; words of equal counts
    are ordered by their hash; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    train = docs.filter(in_fold(F.col("doc_id"), folds) != 0).select("text")
    counts = saved(train.mapInArrow(_counted, "h long, bucket smallint, n long").groupBy("h").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n")), "counts")
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).collect()[0])
    ends = sum(r[0] for r in counts.filter(F.col("h") == int(END)).select("n").collect())
    least = max(LEAST, RARE * total)
    top = counts.filter(F.col("h") != int(END)).select("h", "bucket", "n")
    often = top.filter(F.col("n") >= least)
    top = (often if often.count() > HEAD else top.orderBy(F.desc("n"), "h").limit(HEAD)).toArrow()
    head, head_n, bucket = np.asarray(top["h"].to_numpy()), np.asarray(top["n"].to_numpy()), np.asarray(top["bucket"].to_numpy()).astype(np.int64)
    order = np.lexsort((head, -head_n))
    head, head_n, bucket = head[order].view(np.uint64), head_n[order], bucket[order]
    ids = np.arange(min(CORE, len(head)))
    core = head[: len(ids)]
    by_hash = np.argsort(core)
    core, ids = core[by_hash], ids[by_hash]
    got = train.mapInArrow(_bigrams(core, ids), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(UNITS * UNITS)
    pairs[got["cell"].to_numpy()] = got["n"].to_numpy()
    pairs = pairs.reshape(UNITS, UNITS)
    of = exchange(pairs)

    head_kind = of[CORE + bucket].astype(np.int8)
    head_kind[: len(ids)] = of[: len(ids)]
    own = np.arange(len(head)) >= len(ids)
    order = np.argsort(head)
    head, head_n, bucket, head_kind, own, in_core = head[order], head_n[order], bucket[order], head_kind[order], own[order], order < len(ids)
    one = np.zeros((UNITS, K))
    one[np.arange(UNITS), of] = 1
    n, all_own, often = one.T @ pairs @ one, own | in_core, np.flatnonzero(in_core)
    for turn in range(ROUNDS):
        new_kind, new_n = own_classes(train, head, head_kind, all_own if turn else own, often, of, n)
        if likelihood(new_n) <= likelihood(n):
            break
        head_kind, n = new_kind, new_n
    tail_words = distinct - (ends > 0) - len(head)
    if tail_words:
        kinds, n = tail_classes(train, head, head_kind, of, n, tail_words)
    else:
        kinds = spark.createDataFrame([], "h long, kind tinyint")
    tail = saved(counts.select("h", "n").join(kinds.withColumnRenamed("kind", "own"), "h"), "tail")
    k = K
    size = n.sum(0)
    unigram = (size + 0.1) / (size.sum() + 0.1 * k)
    log_t = np.log10((n + BACKOFF * unigram) / (n.sum(1, keepdims=True) + BACKOFF))
    types = np.bincount(head_kind, minlength=k).astype(float)
    for c, m in tail.groupBy("own").count().collect():
        types[c] += m
    types[CLASSES] = 1
    # a class without known words: its unknown word has all of it
    unknown = np.where(types > 0, DISCOUNT * types, 1.0)
    log_size = np.log10(np.where(types > 0, np.maximum(size, 1), 1.0))
    end_value = float(np.log10(ends - DISCOUNT)) if ends else float(np.log10(unknown[CLASSES]))
    end_base = float(np.log10(ends + 0.1))

    rows = docs.select(F.xxhash64(F.lit(4), "doc_id", "text").alias("row"), "doc_id", "text")
    out = saved(rows.select("row", "text").mapInArrow(_scored(head, head_kind, of, log_t, log_size, head_n, total, distinct), _SCHEMA), "tokens")
    own = F.coalesce("own", "kind").cast("int")
    # the first word of a pair becomes a class before the second
    pairs = out.filter("other IS NOT NULL").join(tail.select("h", "own"), "h", "left").select("row", F.col("other").alias("h"), F.col("after").alias("kind"), own.cast("tinyint").alias("before"), F.lit(-1).cast("tinyint").alias("after"), "m", F.lit(0).alias("words"))
    alone = out.filter("h IS NOT NULL AND other IS NULL").select("row", "h", "kind", "before", "after", "m", F.col("m").alias("words"))
    tail = alone.union(pairs).join(tail, "h", "left").withColumn("own", own)
    moves, none = _listed(log_t), F.lit(0.0)
    step = F.when(F.col("before") >= 0, F.get(moves, F.col("before") * K + F.col("own"))).otherwise(none) + F.when(F.col("after") >= 0, F.get(moves, F.col("own") * K + F.col("after"))).otherwise(none)
    seen = F.col("n").isNotNull()
    emitted = F.when(seen, F.log10(F.col("n") - DISCOUNT)).otherwise(F.get(_listed(np.log10(unknown)), F.col("own"))) - F.get(_listed(log_size), F.col("own"))
    tail = tail.select("row", (F.col("m") * step + F.col("words") * emitted).alias("score"), (F.col("words") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("base"), F.when(seen, F.col("words")).otherwise(0).alias("known"))
    tail = tail.groupBy("row").agg(F.sum("score").alias("tail_score"), F.sum("base").alias("tail_base"), F.sum("known").alias("tail_known"))
    whole = out.filter("n_tokens IS NOT NULL").groupBy("row").agg(F.count("*").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.max("score").alias("score"), F.max("base").alias("base"), F.max("known").alias("known"))
    whole = whole.join(tail, "row", "left")
    done = whole.select("row", "n_tokens", (F.col("known") - (0 if ends else 1) + F.coalesce(F.col("tail_known") / F.col("copies"), F.lit(0))).cast("long").alias("n_known"), (F.col("base") + end_base + F.coalesce(F.col("tail_base") / F.col("copies"), F.lit(0.0))).alias("base_score"), (F.col("score") + end_value + F.coalesce(F.col("tail_score") / F.col("copies"), F.lit(0.0))).alias("score"))
    held = in_fold(F.col("doc_id"), folds) == 0
    keys = rows.select("row", F.col("doc_id").cast(kind))
    return keys.join(done, "row").select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm_scores(table(spark, sf_dir, "documents"))
