"""A persisted index of vectors: built beside the one in use, verified, and put in its place by one change of a pointer.

A version is a folder with the vectors by cell, the cells' centres and a manifest. ``CURRENT`` names the version in
use; it is replaced by a rename, so a reader finds the old version or the new one, and who has opened the old one keeps
reading it. A build that fails leaves neither files nor a changed pointer.

The index is an inverted file: centres are fitted on at most ``FIT_ROWS`` vectors, every vector is in the cell of its
nearest centre, and a search looks at the cells whose centres are nearest to the query.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matching import index_version

FIT_ROWS, ROUNDS = 4000, 10
#: Vectors of a cell that meet a query in one task.
TILE = 16_384
CURRENT, MANIFEST = "CURRENT", "manifest.json"


class BuildError(RuntimeError):
    """A build that was given up; what was in use before still is."""


@dataclass(frozen=True)
class Index:
    """A version that has been opened: its vectors (vec_id, label, v, cell), centres and manifest."""

    vectors: DataFrame
    centres: np.ndarray
    manifest: dict


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    """The whole text or nothing of it: written aside, then renamed over what is there."""
    jvm = spark._jvm
    aside, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(aside, _path(spark, path)[0], how)


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def centres_of(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit vectors, from every so-manieth of them, by rounds of assignment and mean."""
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def _unit(blob: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector is of numbers and not zero, and these at length 1."""
    rows = [i for i, v in enumerate(blob) if v.is_valid and v.values.null_count == 0 and len(v.values)]
    x = np.stack([np.asarray(blob[i].values.to_numpy(zero_copy_only=False), float) for i in rows]) if rows else np.zeros((0, 0))
    norm = np.sqrt((x * x).sum(1)) if rows else np.zeros(0)
    fine = np.isfinite(norm) & (norm > 0)
    return np.array(rows, np.int64)[fine], x[fine] / norm[fine, None]


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _unit(b["v"])
            cell = np.argmax(x @ centres.T, axis=1) if len(at) else np.zeros(0, np.int64)
            some = b.select(["vec_id", "label"]).take(pa.array(at))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * centres.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*some.columns, lists, pa.array(cell, pa.int32())], ["vec_id", "label", "v", "cell"])

    return run


def build(vectors: DataFrame, path: str, meta: dict, cells: int = 64) -> str:
    """Builds the index of ``vectors`` (vec_id, label, v) under ``path`` and puts it in use; its version.

    ``meta`` says what it was built from; a version of the same is made anew. Vectors must be of one dimension; those
    that are null, zero or hold null or non-finite components are left out and counted. Without any the build fails."""
    spark = vectors.sparkSession
    version = f"{index_version(meta)}-{uuid.uuid4().hex[:8]}"
    home = f"{path}/{version}"
    try:
        used = vectors.select("vec_id", "label", F.col("v").cast("array<double>").alias("v"))
        dims = [r[0] for r in used.select(F.size("v")).filter("v IS NOT NULL").distinct().limit(2).collect()]
        if len(dims) != 1:
            raise BuildError(f"vectors of one dimension are needed, found {sorted(dims)}")
        sample = used.filter("v IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow()  # bounded by FIT_ROWS
        _, x = _unit(sample["v"].combine_chunks())
        if not len(x):
            raise BuildError("no vector can be indexed")
        centres = centres_of(x, min(cells, len(x)))
        kinds = {f.name: f.dataType.simpleString() for f in used.schema}
        placed = used.mapInArrow(_assigned(centres), f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<double>, cell int")
        placed.repartition("cell").write.partitionBy("cell").parquet(f"{home}/vectors")
        rows, all_ = spark.read.parquet(f"{home}/vectors").count(), used.count()
        manifest = {"version": version, "rows": rows, "left_out": all_ - rows, "dimension": dims[0], "cells": len(centres), "centres": centres.tolist(), "built_from": meta}
        _write(spark, f"{home}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
        if json.loads(_read(spark, f"{home}/{MANIFEST}"))["rows"] != rows or not rows:
            raise BuildError("the written index is not what was built")
    except Exception as e:
        _delete(spark, home)
        raise e if isinstance(e, BuildError) else BuildError(str(e)[:300]) from e
    _write(spark, f"{path}/{CURRENT}", version)
    return version


def open_index(spark: SparkSession, path: str, expected: dict | None = None) -> tuple[Index | None, list[str]]:
    """The version in use, and warnings: index_missing, or index_stale if it was built from something else than ``expected``."""
    version = _read(spark, f"{path}/{CURRENT}")
    text = version and _read(spark, f"{path}/{version}/{MANIFEST}")
    if not text:
        return None, ["index_missing"]
    manifest = json.loads(text)
    stale = expected is not None and index_version(expected) != index_version(manifest["built_from"])
    return Index(spark.read.parquet(f"{path}/{version}/vectors"), np.array(manifest["centres"]), manifest), ["index_stale"] if stale else []


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes all versions but the one in use and the ``keep`` - 1 newest others; those that went."""
    version = _read(spark, f"{path}/{CURRENT}")
    p, fs = _path(spark, path)
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() != version), reverse=True)
    gone = [name for _, name in found[max(keep - 1, 0) :]]
    for name in gone:
        _delete(spark, f"{path}/{name}")
    return gone


def _probes(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _unit(b["q"])
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes] if len(at) else np.zeros((0, probes), np.int64)
            n = near.shape[1]
            some = b.select(["query"]).take(pa.array(np.repeat(at, n)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) * n + 1) * centres.shape[1], pa.int32()), pa.array(np.repeat(x, n, axis=0).ravel()))
            yield pa.RecordBatch.from_arrays([*some.columns, lists, pa.array(near.ravel(), pa.int32())], ["query", "q", "cell"])

    return run


def nearest_labels(index: Index, queries: DataFrame, probes: int = 8) -> DataFrame:
    """The greatest cosine of each query (query, q) with a vector of each label in the ``probes`` cells nearest to it, itself left
    out: query, label, s. Queries that are no usable vector have no row."""
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *index.vectors.schema]}
    asked = queries.select("query", F.col("q").cast("array<double>").alias("q")).mapInArrow(_probes(index.centres, probes), f"query {kind['query']}, q array<double>, cell int")
    tiles = index.vectors.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))  # a row a cell
    held = index.vectors.join(F.broadcast(tiles), "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int").alias("tile"), "vec_id", "label", "v")
    asked = asked.join(F.broadcast(tiles), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "query", "q")

    def met(key, mine, theirs):
        out = [pa.array([], mine["query"].type), pa.array([], theirs["label"].type), pa.array([], pa.float64())]
        if mine.num_rows and theirs.num_rows:
            q, x = (np.array(t[c].combine_chunks().values).reshape(t.num_rows, -1) for t, c in ((mine, "q"), (theirs, "v")))
            ids, labels = theirs["vec_id"].to_numpy(), theirs["label"].combine_chunks().dictionary_encode()
            code, known = labels.indices.to_numpy(zero_copy_only=False), labels.dictionary
            fine = ~np.isnan(code.astype(float))
            asked_by = mine["query"].to_numpy()
            rows, cols, best = [], [], []
            for s in range(0, len(q), 256):
                p = q[s : s + 256] @ x.T
                p[asked_by[s : s + 256, None] == ids] = -np.inf
                for k in range(len(known)):
                    top = p[:, fine & (code == k)].max(1)
                    hit = np.flatnonzero(top > -np.inf)
                    rows.append(hit + s)
                    cols.append(np.full(len(hit), k))
                    best.append(top[hit])
            if rows:
                out = [mine["query"].combine_chunks().take(pa.array(np.concatenate(rows))), known.take(pa.array(np.concatenate(cols))), pa.array(np.concatenate(best))]
        return pa.table(out, names=["query", "label", "s"])

    at = ["cell", "tile"]
    found = asked.groupBy(*at).cogroup(held.toDF(*held.columns).groupBy(*at)).applyInArrow(met, f"query {kind['query']}, label {kind['label']}, s double")
    return found.groupBy("query", "label").agg(F.max("s").alias("s"))
