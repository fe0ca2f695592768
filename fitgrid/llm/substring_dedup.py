"""Removal of repeated passages by level-wise doubling.

A window of ``width`` words can only repeat if a shorter window in it repeats, so
short windows are counted first and only those that repeat are extended. With
width 35 the levels are 9, 18 and 35 words (each the half, rounded up, of the next).

First level. Counting every 9-word window of a corpus would move many times the
corpus. Of the 9-word windows inside a 35-word one only that of least hash (leftmost
among equals) is counted: equal 35-word windows hold the same one at the same place,
so none is missed, and about one position in fourteen moves. Second level: such a
window is extended to twice its length to the right, if it begins in the first half
of the long window, else to the left; both are counted. Last level: the 35-word
windows whose short window survived are counted themselves, by a 64-bit hash of the
words. Every level counts over the whole table; each is smaller than the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved, table
from .kernels import chunks, parts, windows, Words

WIDTH = 35
_LOW = np.uint64((1 << 22) - 1)


def _levels(width: int) -> tuple[int, int]:
    mid = (width + 1) // 2
    return (mid + 1) // 2, mid


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    have = 1
    while have < k:
        step = min(have, k - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _anchors(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the anchor of each (word positions in the run), and the short windows' hashes."""
    short, _ = _levels(width)
    h = windows(w.hash, short)
    doc = w.doc()
    starts = np.arange(max(0, len(w.hash) - width + 1))
    starts = starts[starts + width <= w.off[1:][doc[starts]]]
    if not len(starts):
        return starts, starts, h
    # the low bits hold the position, from the run's first word, so that of equal hashes the leftmost is least
    if len(h) <= int(_LOW):
        least = _sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), width - short + 1)
        return starts, (least[starts] & _LOW).astype(np.int64), h
    key, at = h & ~_LOW, np.empty(len(starts), np.int64)
    for a in range(0, len(starts), 1 << 20):  # one very long text: in overlapping pieces
        s = starts[a : a + (1 << 20)]
        lo, hi = int(s[0]), int(s[-1]) + width
        part = (key[lo:hi] | np.arange(len(key[lo:hi]), dtype=np.uint64))
        at[a : a + len(s)] = (_sliding_min(part, width - short + 1)[s - lo] & _LOW).astype(np.int64) + lo
    return starts, at, h


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _first(width: int):
    """Per text its plain digest, and per distinct anchor its short hash and its two extensions."""
    short, mid = _levels(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in chunks(b["text"]):
                w = Words(off, data)
                starts, at, h = _anchors(w, width)
                near = at - starts <= width - mid
                doc = w.doc()
                q = np.unique(at)
                right, left = np.zeros(len(w.hash), bool), np.zeros(len(w.hash), bool)
                right[at[near]] = True
                left[at[~near]] = True
                wide = windows(w.hash, mid)
                r = np.where(right[q], wide[np.minimum(q, len(wide) - 1)], 0).view(np.int64) if len(q) else q
                lo = np.where(left[q], wide[np.maximum(q - (mid - short), 0)], 0).view(np.int64) if len(q) else q
                ids = b["row"].slice(i, j - i).take(pa.array(doc[q] if len(q) else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(q - w.off[doc[q]] if len(q) else [], pa.int32()), *(pa.array(x, pa.int64()) for x in (h[q].view(np.int64) if len(q) else [], r, lo))], ["row", "at", "h", "r", "l"])

    return run


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        n, sha = [], []
        for t in b["text"].to_pylist():
            words = (t or "").encode().split()
            n.append(len(words))
            sha.append(_sha(words))
        yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["row", "doc_id", "n_words", "sha"])


def _full(width: int):
    """The full windows of texts whose anchor survived on the side that the window needs."""
    _, mid = _levels(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in chunks(b["text"]):
                w = Words(off, data)
                starts, at, _ = _anchors(w, width)
                side = np.zeros((2, len(w.hash)), bool)
                for c, name in enumerate(("right", "left")):
                    lists = b[name].slice(i, j - i)
                    own = np.repeat(w.off[:-1], lists.value_lengths().fill_null(0).to_numpy())
                    side[c, lists.flatten().to_numpy() + own] = True
                near = at - starts <= width - mid
                keep = starts[np.where(near, side[0, at], side[1, at])] if len(starts) else starts
                full = windows(w.hash, width)[keep]
                doc = w.doc()[keep]
                ids = b["row"].slice(i, j - i).take(pa.array(doc, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keep - w.off[doc], pa.int32()), pa.array(full.view(np.int64), pa.int64())], ["row", "at", "h"])

    return run


def _cut(width: int):
    """Texts without the words that their repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            out = []
            for text, starts in zip(b["text"].to_pylist(), b["starts"], strict=True):
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                s = starts.values.to_numpy() if starts.is_valid else np.zeros(0, np.int64)
                np.add.at(gone, s, 1)
                np.add.at(gone, s + width, -1)
                keep = np.cumsum(gone[:-1]) == 0
                kept = [x for x, k in zip(words, keep.tolist(), strict=True) if k]
                out.append((int(len(words) - len(kept)), _sha(kept), b" ".join(kept).decode()))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["row", "n_removed", "sha", "text"])

    return run


def _repeated(df: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` (not 0, not null) is found in two rows or more."""
    many = df.filter(F.col(col) != 0).groupBy(col).agg(F.count("*").alias("times")).filter("times > 1").select(col)
    return df.join(many, col, "left_semi")


def _cleaned(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words, sha) of every row as it is; (row, n_removed, sha, text) of the rows that lose words.

    ``row`` is the hash of id and text, so that equal rows share one entry.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select(F.xxhash64(F.lit(35), "doc_id", "text").alias("row"), "doc_id", "text")
    anchors = saved(docs.mapInArrow(_first(width), "row long, at int, h long, r long, l long"), "anchors")
    one = saved(_repeated(anchors, "h").drop("h"), "level1")
    discard(anchors)
    right = _repeated(one.select("row", "at", "r"), "r").select("row", "at", F.lit(0).alias("side"))
    left = _repeated(one.select("row", "at", "l"), "l").select("row", "at", F.lit(1).alias("side"))
    two = right.union(left).groupBy("row").agg(F.collect_set(F.when(F.col("side") == 0, F.col("at"))).alias("right"), F.collect_set(F.when(F.col("side") == 1, F.col("at"))).alias("left"))
    two = saved(docs.join(two, "row").dropDuplicates(["row"]).select("row", "text", "right", "left", F.lit(1).alias("one")), "level2")
    discard(one)
    # a row that stands in the table twice counts twice
    times = docs.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").join(two.select("row"), "row", "left_semi")
    three = saved(two.select("row", "text", "right", "left").mapInArrow(_full(width), "row long, at int, h long"), "level3")
    again = three.join(times, "row").select("row", "at", "h")
    found = _repeated(three, "h").union(again)
    spans = saved(found.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("starts")), "spans")
    discard(three)
    cut = saved(two.select("row", "text").join(spans, "row").mapInArrow(_cut(width), "row long, n_removed long, sha string, text string"), "cut")
    discard(two, spans)
    plain = docs.mapInArrow(_plain, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, sha string")
    return plain, cut


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` (all columns) with ``text`` cut by every word that a repeated window covers.

    A text that loses words becomes its kept words, joined by one space; all others
    stay as they are, nulls and empty texts too. A row that stands in the table twice
    repeats itself. n_chars, where there, follows the new text.
    """
    _, cut = _cleaned(docs, width)
    row = F.xxhash64(F.lit(35), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))
    cut = cut.select(F.col("row").alias("__row"), F.col("text").alias("__text"))
    out = docs.withColumn("__row", row).join(cut, "__row", "left")
    new = {"text": F.coalesce("__text", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__text").isNotNull(), F.length("__text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*docs.columns)


def repeats_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; null and empty texts have no words.

    Texts of any length count whole; a window that stands twice, in one document or two, goes at all of its places, so there
    are no ties to break; rows that stand twice are two documents and remove each other's windows; null ids are documents of their
    own; other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    plain, cut = _cleaned(docs, width)
    cut = cut.select("row", "n_removed", F.col("sha").alias("cut_sha"))
    return plain.join(cut, "row", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(table(spark, sf_dir, "documents"))
