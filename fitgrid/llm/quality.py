"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a text. Expectation
maximisation over the counts of vote patterns estimates how often each rule casts
each vote on good texts and on bad ones, and the share of good texts; no label is read.
Bad texts are of several kinds (wrong characters, repetition, wrong form, hardly any
text), as a text with one fault seldom has another: each kind is a class of its own, and
a rule's votes only say at the start which kind it looks for. So a rule that fires on texts
that are otherwise like the good ones is outvoted, however it is named.
A text is kept if the posterior probability that it is good is at least a half.
Eight rules have at most 3**8 patterns, so what goes to the driver is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .kernels import Words, chunks, mix, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: The kind of fault that each rule looks for, in the order of ``rules``.
CHARACTERS, REPETITION, FORM, LENGTH = range(4)
KINDS = (LENGTH, CHARACTERS, CHARACTERS, REPETITION, REPETITION, FORM, FORM, REPETITION)
ROUNDS = 1000
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_shout"]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {k: [] for k in _STATS}
        for i, j, off, data in chunks(b["text"]):
            w = Words(off, data)

            def per_text(mask, off=off):
                return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

            def per_words(mask, w=w):
                return np.diff(np.concatenate([[0], np.cumsum(mask)])[w.off])

            doc = w.doc().astype(np.uint64)
            in_text = mix(w.hash ^ (doc << np.uint64(32)))
            three = windows(in_text, 3)
            covered = np.zeros(len(w.hash) + 1, np.int64)
            if len(three):
                order = np.argsort(three, kind="stable")
                same = three[order][1:] == three[order][:-1]
                again = np.zeros(len(three), bool)
                again[order[1:][same]] = True
                again[order[:-1][same]] = True
                at = np.flatnonzero(again & (doc[: len(three)] == doc[2:]))
                np.add.at(covered, at, 1)
                np.add.at(covered, at + 3, -1)
            distinct = np.unique(in_text, return_index=True)[1]
            first = np.zeros(len(w.hash), bool)
            first[distinct] = True
            starts = (data & 0xC0) != 0x80
            upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
            shout = data[w.ends - 1] == ord("!") if len(w.ends) else np.zeros(0, bool)
            dup, lines = [], []
            for d in range(j - i):
                seen: set[bytes] = set()
                n = m = 0
                for line in data[off[d] : off[d + 1]].tobytes().split(b"\n"):
                    if line.split():
                        m += 1
                        n += line in seen
                        seen.add(line)
                dup.append(n)
                lines.append(m)
            spaces = per_text((data == 32) | ((data >= 9) & (data <= 13)))
            for k, v in (("n_words", w.n), ("word_chars", per_text(starts) - spaces), ("n_symbols", per_text(SYMBOLS[data])), ("n_dup_lines", dup), ("n_repeat_words", per_words(np.cumsum(covered[:-1]) > 0)), ("n_lines", lines), ("n_upper", per_text(upper)), ("n_letters", per_text(upper | lower)), ("n_distinct", per_words(first)), ("n_shout", per_words(shout))):
                out[k].extend(np.asarray(v).tolist())
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(out[k], pa.int64()) for k in _STATS)], ["doc_id", *_STATS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of ``_STATS`` for every row; null texts count as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_stats, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in _STATS))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes by name: bad, good, and between the two nothing."""
    mean = _ratio("word_chars", "n_words")
    symbols, dup, repeat = _ratio("n_symbols", "n_words"), _ratio("n_dup_lines", "n_lines"), _ratio("n_repeat_words", "n_words")
    upper, shout, distinct = _ratio("n_upper", "n_letters"), _ratio("n_shout", "n_words"), _ratio("n_distinct", "n_words")
    words = F.col("n_words")
    return {
        "length": _vote(words < 20, words >= 100),
        "word_length": _vote((mean < 3.5) | (mean > 7), mean.between(4, 6.5)),
        "symbols": _vote(symbols > 0.1, symbols < 0.02),
        "duplicate_lines": _vote(dup > 0.3, dup < 0.1),
        "repeated_words": _vote(repeat > 0.4, repeat < 0.1),
        "capitals": _vote(upper > 0.5, upper < 0.2),
        "shouting": _vote(shout > 0.2, shout < 0.02),
        "variety": _vote((distinct < 0.15) & (words < 2000), distinct > 0.35),
    }


def fit_votes(votes: np.ndarray, counts: np.ndarray, kinds: tuple[int, ...] | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) and their counts, with a class of good texts and one of each kind of bad ones.

    Gives P(vote | class) as (rules, classes, 3), the good class first, and each pattern's posterior of good. It starts
    from nine in ten for good where no rule says bad, else from one in ten and the rest by the kinds of the rules that
    do; one of smoothing keeps every probability positive. The good class is the one whose texts get the fewest bad
    votes, on which the rules are thus right more often than not.
    """
    m = votes.shape[1]
    kinds = np.array(kinds if kinds is not None else [0] * m)
    many = kinds.max() + 1
    bad = np.stack([(votes[:, kinds == k] == -1).sum(1) for k in range(many)], 1).astype(float)
    total = bad.sum(1, keepdims=True)
    worse = np.where(total > 0, 0.9 * bad / np.maximum(total, 1), 0.1 / many)
    post = np.concatenate([1 - worse.sum(1, keepdims=True), worse], 1)
    for _ in range(rounds):
        old, weight = post, post * counts[:, None]
        p = np.stack([(votes == v).T @ weight + 1.0 for v in (-1, 0, 1)], 2)
        p /= p.sum(2, keepdims=True)
        log = np.log((weight.sum(0) + 1) / (counts.sum() + many + 1)) + sum(np.log(p[r][:, votes[:, r] + 1]).T for r in range(m))
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        if np.abs(post - old).max() < 1e-9:
            break
    order = np.argsort(p[:, :, 0].sum(0), kind="stable")
    return p[:, order], post[:, order[0]]


def quality_posteriors(stats: DataFrame) -> DataFrame:
    """``stats`` with ``quality``, the posterior probability that the text is good, and the votes' pattern."""
    votes = rules()
    code = F.lit(0)
    for v in votes.values():
        code = code * 3 + v + 1
    coded = stats.withColumn("pattern", code.cast("int"))
    rows = coded.groupBy("pattern").count().collect()  # at most 3 ** rules
    if not rows:
        return coded.withColumn("quality", F.lit(0.5))
    rows.sort()
    pattern, counts = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows])
    m = len(votes)
    table = np.stack([pattern // 3 ** (m - 1 - r) % 3 - 1 for r in range(m)], 1)
    _, good = fit_votes(table, counts, KINDS)
    known = stats.sparkSession.createDataFrame([(int(a), float(b)) for a, b in zip(pattern, good, strict=True)], "pattern int, quality double")
    return coded.join(F.broadcast(known), "pattern")


def quality_filter(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept and the posterior ``quality``.

    base_failed: n_words < 50, or 100 * n_repeat_words > 50 * n_words. Null and empty
    texts have no words and fail. Repeated rows each count and each get the same result, texts of any length are
    read whole, a posterior of exactly a half is kept, and other columns, whatever their names, are not read.
    An empty table gives an empty result.
    """
    stats = saved(text_statistics(docs), "quality")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = quality_posteriors(stats).withColumn("base_failed", base)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), "quality", "pattern")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents"))
