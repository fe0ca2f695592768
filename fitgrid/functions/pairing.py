"""Which of two lists of short texts are alike, for many at a time, and how many pair one to one from the most alike down.

Likeness is ``token_set_ratio`` of ``fuzzy``, to the last bit. It is worked out for slices of one list by all of the other: what words
two texts share by adding up words, then a bound from their characters, and the common subsequence only where that bound may count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .fuzzy import token_set_ratio

# Pairs of a slice, classes of characters that are counted, characters of a text whose places are bits of a number,
# pairs whose subsequences are counted at once.
SLICE, CLASSES, BITS, AT_ONCE = 1 << 18, 64, 64, 1 << 14


class Words:
    """Texts as lines of their sorted words, each word with a space behind it, so that the words of a line can be masked."""

    def __init__(self, texts: list[str]):
        self.texts, self.words = texts, [sorted(set(t.split())) for t in texts]
        self.lines = ["".join(f"{w} " for w in ws) for ws in self.words]
        self.n = np.array([len(s) for s in self.lines], np.int64)

    def held(self, lo: int, hi: int) -> dict[str, np.ndarray]:
        """Of each word of texts lo to hi: which of them have it, counted from lo, and where it begins in their lines."""
        at: dict[str, list[tuple[int, int]]] = {}
        for i, ws in enumerate(self.words[lo:hi]):
            begin = 0
            for w in ws:
                at.setdefault(w, []).append((i, begin))
                begin += len(w) + 1
        return {w: np.array(a, np.int64) for w, a in at.items()}

    def codes(self) -> np.ndarray:
        """Characters of all lines as numbers above 0, one line after the other."""
        return np.frombuffer("".join(self.lines).encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)


def _slices(x: Words, y: Words) -> Iterator[tuple[int, int]]:
    step = max(1, SLICE // max(1, len(y.texts)))
    return ((lo, min(lo + step, len(x.texts))) for lo in range(0, len(x.texts), step))


def _shared(mine: dict[str, np.ndarray], theirs: dict[str, np.ndarray], size: tuple[int, int], places: bool = False) -> tuple[np.ndarray, ...]:
    """Characters of the words that texts share, spaces behind them counted; their places in either line as bits too, if asked for."""
    out = [np.zeros(size, np.int64)] + [np.zeros(size, np.uint64) for _ in range(2 * places)]
    for w, a in mine.items():
        b = theirs.get(w)
        if b is None:
            continue
        where = np.ix_(a[:, 0], b[:, 0])
        out[0][where] += len(w) + 1
        if places:
            run = (1 << min(len(w) + 1, BITS)) - 1
            out[1][where] |= _bits(run, a[:, 1])[:, None]
            out[2][where] |= _bits(run, b[:, 1])
    return tuple(out)


def _bits(run: int, begin: np.ndarray) -> np.ndarray:
    """``run`` moved up to each place; lines that are longer than a number has bits are not measured by bits."""
    return np.uint64(run) << np.minimum(begin, BITS - 1).astype(np.uint64)


def _padded(w: Words, codes: np.ndarray) -> np.ndarray:
    """Codes of the characters of each line that has BITS at most, 0 behind its end; of longer ones nothing."""
    short = w.n <= BITS
    out = np.zeros((len(w.n), int(w.n[short].max(initial=1))), np.uint32)
    out[(np.arange(out.shape[1]) < w.n[:, None]) & short[:, None]] = codes[np.repeat(short, w.n)]
    return out


def _counts(w: Words, codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Characters of each line by class, a class a row."""
    flat = np.searchsorted(known, codes) % CLASSES * len(w.n) + np.repeat(np.arange(len(w.n)), w.n)
    return np.bincount(flat, minlength=CLASSES * len(w.n)).reshape(CLASSES, len(w.n)).astype(np.int32)


def _common(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, hide_x: np.ndarray, hide_y: np.ndarray) -> np.ndarray:
    """Characters of the longest common subsequence of lines ``x[i]`` and ``y[j]`` without the hidden places; lines of BITS at most."""
    known = np.unique(x)
    at = np.searchsorted(known, x)
    masks = np.zeros((len(x), len(known) + 1), np.uint64)  # the last column: characters that x has not
    rows, cols = np.nonzero(x)
    np.bitwise_or.at(masks, (rows, at[rows, cols]), np.uint64(1) << cols.astype(np.uint64))
    found = np.minimum(np.searchsorted(known, y), len(known) - 1)
    found = np.where((known[found] == y) & (y > 0), found, len(known))
    masks, width, out = masks.ravel(), len(known) + 1, np.empty(len(i), np.int64)
    for lo in range(0, len(i), AT_ONCE):
        part = slice(lo, lo + AT_ONCE)
        base, theirs, show_x, show_y = i[part] * width, found[j[part]], ~hide_x[part], ~hide_y[part]
        left = np.full(len(base), ~np.uint64(0))  # a 0 stands where a subsequence has grown by one
        for q in range(y.shape[1]):
            shown = np.uint64(0) - ((show_y >> np.uint64(q)) & np.uint64(1))
            hit = left & masks[base + theirs[:, q]] & show_x & shown
            left = (left + hit) | (left - hit)
        out[part] = BITS - np.bitwise_count(left).astype(np.int64)
    return out


def alike_pairs(gold: list[str], predicted: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``gold`` and in ``predicted`` and likeness of all pairs that are ``least`` alike or more."""
    x, y = Words(gold), Words(predicted)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not gold or not predicted:
        return found[0]
    all_x, all_y = x.codes(), y.codes()
    known = np.union1d(all_x, all_y)
    cx, cy, xs, ys = _counts(x, all_x, known), _counts(y, all_y, known), _padded(x, all_x), _padded(y, all_y)
    both, theirs = np.flatnonzero(cx.any(1) & cy.any(1)), y.held(0, len(predicted))
    for lo, hi in _slices(x, y):
        shared, hide_x, hide_y = _shared(x.held(lo, hi), theirs, (hi - lo, len(predicted)), True)
        n_x, n_y = x.n[lo:hi, None] - 1, y.n - 1
        total = n_x + n_y
        s = np.maximum(shared - 1, 0)
        # texts without words are alike to none
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(s > 0, np.maximum(200.0 * s / (s + n_x), 200.0 * s / (s + n_y)), 0.0)
            score[(shared > 0) & ((shared == n_x + 1) | (shared == n_y + 1))] = 100.0
            bag = np.zeros(shared.shape, np.int32)
            for c in both:
                bag += np.minimum(cx[c, lo:hi, None], cy[c])
            # a space stands behind either rest, and is common to both
            most = np.minimum(bag - 1 - shared, np.minimum(n_x, n_y) - shared)
            bound = np.where((n_x >= 0) & (n_y >= 0), 100.0 * (1 - (total - 2 * shared - 2 * most) / total), 0.0)
        i, j = np.nonzero((bound >= least) & (bound > score))
        bits = (x.n[lo + i] <= BITS) & (y.n[j] <= BITS)
        a, b = i[bits], j[bits]
        if len(a):
            common = _common(xs[lo:hi], ys, a, b, hide_x[a, b], hide_y[a, b]) - 1
            apart = total[a, b] - 2 * shared[a, b] - 2 * common
            score[a, b] = np.maximum(score[a, b], 100.0 * (1 - apart / total[a, b]))
        for a, b in zip(i[~bits].tolist(), j[~bits].tolist(), strict=True):
            score[a, b] = token_set_ratio(gold[lo + a], predicted[b])
        i, j = np.nonzero(score >= least)
        found.append((i + lo, j, score[i, j]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def matched(gold: list[str], predicted: list[str], least: float) -> int:
    """Pairs that are taken from the most alike down, each text once; ties go to the earlier text of ``gold``, then of ``predicted``.

    Texts whose words are all in the other make 100 and come first: what they leave is all that must be compared by characters."""
    x, y = Words(gold), Words(predicted)
    free_x, free_y, taken, theirs = np.ones(len(gold), bool), np.ones(len(predicted), bool), 0, y.held(0, len(predicted))
    for lo, hi in _slices(x, y):
        (shared,) = _shared(x.held(lo, hi), theirs, (hi - lo, len(predicted)))
        whole = (shared > 0) & ((shared == x.n[lo:hi, None]) | (shared == y.n))
        for i in np.flatnonzero(whole.any(1)):
            first = int((whole[i] & free_y).argmax())
            if whole[i, first] and free_y[first]:
                free_x[lo + i] = free_y[first] = False
                taken += 1
    g, p, score = alike_pairs([t for t, f in zip(gold, free_x, strict=True) if f], [t for t, f in zip(predicted, free_y, strict=True) if f], least)
    order = np.lexsort((p, g, -score))
    used_g, used_p = set(), set()
    for i, j in zip(g[order].tolist(), p[order].tolist(), strict=True):
        if i not in used_g and j not in used_p:
            used_g.add(i)
            used_p.add(j)
    return taken + len(used_g)
