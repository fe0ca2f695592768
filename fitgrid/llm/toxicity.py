"""Toxicity by a character n-gram classifier with naive Bayes features.

Features are the distinct n-grams of 3 to 5 characters of the lower-cased text,
hashed to 2**20. The naive Bayes log-count ratio of each scales it, features whose
ratio may be chance are dropped, and a logistic regression with L2 penalty is fitted
on the scaled features. It is fitted on at most ``TRAIN_ROWS`` labelled rows, those
of least hash of the id; every text is scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, table
from .kernels import parts

BITS, ORDERS = 20, (3, 4, 5)
#: The most labelled rows that a fit takes.
TRAIN_ROWS = 4000
_CHARS = 1 << 18


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of all n-grams, by order; not distinct."""
    texts = [f" {' '.join(t.lower().split())} " for t in texts]
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(codes)]
    bad = np.concatenate([[0], np.cumsum(codes == 0)])
    h = codes * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :]
        if n in ORDERS and len(h):
            x = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
            whole = bad[n:] == bad[:-n]
            yield doc[: len(h)][whole], ((x >> np.uint32(32 - BITS)) ^ np.uint32(n))[whole]


def _runs(texts: list[str | None]) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= _CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def _packed(features: np.ndarray) -> bytes:
    """Sorted distinct features as compressed differences: what the driver collects stays small."""
    return zlib.compress(np.diff(features, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), "<u4"), dtype=np.int32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        blobs = [_packed(np.unique(np.concatenate([f for _, f in _grams([t or ""])] or [np.zeros(0, np.uint32)]))) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["toxic"], pa.array(blobs, pa.binary())], ["toxic", "features"])


def fit(rows: list[tuple[int, bytes]], rounds: int = 120, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, intercept) from (label, packed features) rows, unpacked one at a time."""
    if not rows or len({y for y, _ in rows}) < 2:  # one class or none: its share decides
        share = (sum(y for y, _ in rows) + 0.5) / (len(rows) + 1)
        return np.zeros(0, np.int32), np.zeros(0), float(np.log(share / (1 - share)) if rows else -1.0)
    y = np.array([r[0] for r in rows], float)
    size = 1 << BITS
    pos, both = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for label, blob in rows:
        f = _unpacked(blob)
        both[f] += 1
        if label:
            pos[f] += 1
    chosen = np.flatnonzero(both >= 3)
    pos, neg = pos[chosen], (both - pos)[chosen]
    ratio = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / ((1 - y).sum() + 2))
    sure = np.abs(ratio) > 2.5 * np.sqrt(1 / (pos + 1) + 1 / (neg + 1))
    chosen, ratio = chosen[sure], ratio[sure]
    if not len(chosen):
        return np.zeros(0, np.int32), np.zeros(0), float(np.log(y.mean() / (1 - y.mean())))
    new = np.full(size, -1, np.int32)
    new[chosen] = np.arange(len(chosen))
    picked = [(k := new[_unpacked(blob)])[k >= 0] for _, blob in rows]
    doc, col, r = np.repeat(np.arange(len(y)), [len(k) for k in picked]), np.concatenate(picked), ratio
    w, bias, past, vel = np.zeros(len(chosen)), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):  # Adam on the full gradient
        z = np.bincount(doc, (w * r)[col], len(y)) + bias
        err = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        g = np.append(np.bincount(col, err[doc], len(chosen)) * r + penalty * w, err.sum())
        past = 0.9 * past + 0.1 * g
        vel = 0.99 * vel + 0.01 * g * g
        step = 0.03 * (past / (1 - 0.9**t)) / (np.sqrt(vel / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return chosen.astype(np.int32), w * r, float(bias)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on labelled rows (labels: doc_id, toxic); rows without a label, id or text are left out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").dropDuplicates(["doc_id"])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    got = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(known), "doc_id").select("toxic", "text").mapInArrow(_features, "toxic int, features binary").toArrow()
    return fit(sorted(zip(got["toxic"].to_pylist(), got["features"].to_pylist(), strict=True)))


def _scorer(model: tuple[np.ndarray, np.ndarray, float]):
    """A function from a column of texts to their scores; null and empty texts get the intercept's score."""
    features, weights, bias = model
    wanted = np.zeros(1 << BITS, bool)
    wanted[features] = True
    weight = np.zeros(1 << BITS)
    weight[features] = weights

    def scores(column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for texts in _runs(column.to_pylist()):
            hits = []
            for doc, f in _grams(texts):
                at = np.flatnonzero(wanted[f])
                hits.append((doc[at].astype(np.int64) << BITS) | f[at])
            one = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
            z = np.bincount(one >> BITS, weight[one & ((1 << BITS) - 1)], len(texts)) + bias
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return np.concatenate(out)

    return scores


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row.

    Null and empty texts get the intercept's score, texts of any length are read whole, repeated rows get equal
    scores, other columns, whatever their names, are not read, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores(b["text"]), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], limit: float = 0.5) -> DataFrame:
    """Rows of ``docs`` (all columns) whose text scores below ``limit``: one pass, and no row is shuffled.

    Every row is judged by its own text, whatever its id (null ids, and ids with several texts, too).
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for b in parts(batches):
            yield b.filter(pa.array(scores(b.column(at)) < limit))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(in_fold(F.col("doc_id"), 5) != 0))
    held = in_fold(F.col("doc_id"), 5) == 0
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
