"""Near-duplicate embeddings by tiled comparison in PCA order.

Vectors are rotated onto their principal axes, so that the first few dimensions hold
most of a product. Within a label, vectors are dealt to bands of their angles to the first two
axes, a band as wide as the angle of the threshold: angles to an axis differ by no more than the
vectors' own angle, so only neighbouring bands can hold pairs that link, and tiles of all others
never meet. Each pair of tiles (parts of a band) that may link is
one task: products of the leading dimensions first, and a pair is given up as soon as
what it has plus the product of the two suffix norms (Cauchy-Schwarz) stays under the
threshold. The cosine of the pairs that remain is taken from the vectors as they
came, in double precision. A tile returns a count per vector and a forest, never pairs.
Equal vectors are collapsed first, so that a vector in thousands of copies is one.
The rotation only orders the work; it is found on at most ``FIT_ROWS`` vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, saved, table

FIT_ROWS, TILE, STEPS = 2000, 2048, (8, 24)
#: Rows of a tile that are multiplied at once.
STRIP = 256


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as little-endian doubles, their dimension and a digest; unusable ones are left out."""
    for b in batches:
        at, dims, blobs, marks = [], [], [], []
        for row, v in enumerate(b["embedding"]):
            if not v.is_valid or not v.values.null_count == 0:
                continue
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), "<f8")
            if len(x) and np.isfinite(x).all() and x.any() and np.isfinite(x @ x) and x @ x > 0:
                at.append(row)
                dims.append(len(x))
                blobs.append(x.tobytes())
                marks.append(hashlib.blake2b(blobs[-1], digest_size=16).digest())
        pick = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([b["vec_id"].take(pick), b["label"].take(pick), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary()), pa.array(marks, pa.binary())], ["vec_id", "label", "dim", "v", "mark"])


def rotation(x: np.ndarray) -> np.ndarray:
    """Columns: the principal axes of unit vectors, the widest first (about the origin, as cosines are)."""
    _, axes = np.linalg.eigh(x.T @ x)
    return axes[:, ::-1]


def band_width(limit: float) -> float:
    """The angle of the threshold and a margin for rounding; not so narrow that bands outnumber vectors."""
    return max(float(np.arccos(np.clip(limit, -1, 1))), 0.02) + 1e-6


def _bands(limit: float, axes: dict[int, np.ndarray]):
    """Adds the bands of a vector's angles to the first two axes of its dimension."""
    width = band_width(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b["dim"].to_numpy()
            bands = np.zeros((2, len(dims)), np.int32)
            blobs = b["v"]
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(blobs.take(pa.array(at)).to_pylist()), "<f8").reshape(len(at), d)
                lead = (x / np.sqrt((x * x).sum(1, keepdims=True))) @ axes.get(d, np.eye(d))[:, :2]
                bands[: lead.shape[1], at] = np.floor(np.arccos(np.clip(lead, -1, 1)) / width).T
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bands[0]), pa.array(bands[1])], [*b.schema.names, "p", "q"])

    return run


def close_pairs(a: np.ndarray, b: np.ndarray, limit: float, axes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of a, j of b) of cosine >= limit, a strip of ``a`` at a time."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    ra, rb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    cuts = [0, *(s for s in STEPS if s < a.shape[1]), a.shape[1]]

    def tail(r):
        return [np.sqrt(np.maximum(0, (r[:, c:] ** 2).sum(1))) for c in cuts]

    ta, tb = tail(ra), tail(rb)
    for lo in range(0, len(a), STRIP):
        hi = min(lo + STRIP, len(a))
        got = ra[lo:hi, : cuts[1]] @ rb[:, : cuts[1]].T
        i, j = np.nonzero(got + ta[1][lo:hi, None] * tb[1][None, :] >= limit - 1e-9)
        got = got[i, j]
        for c, (x, y) in enumerate(zip(cuts[1:], cuts[2:], strict=False)):
            part = np.empty(len(i))
            for s in range(0, len(i), 1 << 16):
                e = slice(s, s + (1 << 16))
                part[e] = np.einsum("ij,ij->i", ra[lo:hi, x:y][i[e]], rb[:, x:y][j[e]])
            got = got + part
            keep = got + ta[c + 2][lo:hi][i] * tb[c + 2][j] >= limit - 1e-9
            i, j, got = i[keep], j[keep], got[keep]
        exact = np.empty(len(i))
        for s in range(0, len(i), 1 << 16):
            e = slice(s, s + (1 << 16))
            exact[e] = np.einsum("ij,ij->i", a[lo:hi][i[e]], b[j[e]]) / (na[lo:hi][i[e]] * nb[j[e]])
        keep = exact >= limit
        yield i[keep] + lo, j[keep]


def _tiles(limit: float, axes: dict[int, np.ndarray]):
    def run(t: pa.Table) -> pa.Table:
        tile = t["tile"].to_numpy()
        order = np.lexsort((t["rep"].to_numpy(), tile))
        tile, rep, copies = tile[order], t["rep"].to_numpy()[order], t["copies"].to_numpy()[order]
        blobs = t["v"].combine_chunks().take(pa.array(order))
        x = np.frombuffer(b"".join(blobs.to_pylist()), "<f8").reshape(len(rep), -1)
        first, second = t["i"][0].as_py(), t["j"][0].as_py()
        a, b = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        if len(a) and len(b):
            for i, j in close_pairs(x[a], x[b], limit, axes.get(x.shape[1], np.eye(x.shape[1]))):
                p, q = a[i], b[j]
                if first == second:
                    p, q = p[p != q], q[p != q]
                np.add.at(links, p, copies[q])
                if first != second:
                    np.add.at(links, q, copies[p])
                while True:  # labels of a strip's links, to their least
                    low = np.minimum(root[p], root[q])
                    if (root[p] == low).all() and (root[q] == low).all():
                        break
                    np.minimum.at(root, root[p], low)
                    np.minimum.at(root, root[q], low)
                    np.minimum.at(root, p, low)
                    np.minimum.at(root, q, low)
                    root = root[root]
        while (root[root] != root).any():
            root = root[root]
        some = np.flatnonzero(links)
        return pa.table({"rep": pa.array(rep[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(rep[root[some]], pa.int64())})

    return run


def embedding_duplicates(vectors: DataFrame, limit: float = 0.93, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id long, label, embedding): vec_id, n_links, component_id, kept.

    Vectors are compared within equal labels of equal dimension. Null labels, null or
    zero vectors, null or non-finite components and null ids link with nothing; a null
    id has a null component and is kept. Rows of equal vectors link with each other.
    Pairs at the threshold link. The rows of an id with several vectors get the most links and the smallest
    component that one of these has; components are not joined by an id. Other columns, whatever their
    names, are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL")
    kind = vectors.schema["label"].dataType.simpleString()
    read = saved(usable.mapInArrow(_read, f"vec_id long, label {kind}, dim int, v binary, mark binary"), "vectors")
    classes = read.groupBy("label", "dim", "mark").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = saved(classes, "copies")
    heads = classes.join(read.select("label", "dim", "mark", F.col("vec_id").alias("rep"), "v").dropDuplicates(["label", "dim", "mark", "rep"]), ["label", "dim", "mark", "rep"])
    fit = read.orderBy(F.xxhash64("mark"), "vec_id").limit(FIT_ROWS).select("dim", "v").toArrow()
    by: dict[int, list[bytes]] = {}
    for d, v in zip(fit["dim"].to_pylist(), fit["v"].to_pylist(), strict=True):
        by.setdefault(d, []).append(v)
    axes = {}
    for d, vs in by.items():
        x = np.frombuffer(b"".join(vs), "<f8").reshape(-1, d)
        axes[d] = rotation(x / np.sqrt((x * x).sum(1, keepdims=True)))
    heads = heads.select("label", "dim", "mark", "rep", "copies", "v")
    placed = saved(heads.mapInArrow(_bands(limit, axes), f"label {kind}, dim int, mark binary, rep long, copies long, v binary, p int, q int"), "bands")
    cell = ["label", "dim", "p", "q"]
    sizes = saved(placed.groupBy(*cell).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "cells")
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("dp"), F.lit(j).alias("dq")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    near = sizes.select(*cell, F.col("tiles").alias("other_tiles"), step.alias("s"))
    near = near.select("label", "dim", (F.col("p") + F.col("s.dp")).alias("p"), (F.col("q") + F.col("s.dq")).alias("q"), F.col("p").alias("op"), F.col("q").alias("oq"), "other_tiles")

    def code(p, q, t):  # bands are fewer than 256, tiles fewer than 2 ** 40
        return F.shiftleft(F.col(p).cast("long"), 52).bitwiseOR(F.shiftleft(F.col(q).cast("long"), 42)).bitwiseOR(t.cast("long"))

    dealt = placed.join(sizes, cell).withColumn("tile", code("p", "q", F.pmod(F.xxhash64("mark"), F.col("tiles"))))
    # a tile meets each tile of its cell and of the cells around it, as the first of the two or the second
    paired = dealt.join(near, cell).select("label", "dim", "rep", "copies", "v", "tile", "op", "oq", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)).alias("t"))
    paired = paired.withColumn("o", code("op", "oq", F.col("t")))
    paired = paired.select("label", "dim", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "rep", "copies", "v", "tile")
    found = saved(paired.groupBy("label", "dim", "i", "j").applyInArrow(_tiles(limit, axes), "rep long, links long, root long"), "tiles")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    comp = components(edges).select(F.col("id").alias("rep"), "component")
    own = read.select("vec_id", "label", "dim", "mark").join(classes, ["label", "dim", "mark"]).join(links, "rep", "left").join(comp, "rep", "left")
    own = own.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    # a row that stands twice is two vectors of one id
    own = own.groupBy("vec_id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = vectors.select("vec_id").join(own, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))
