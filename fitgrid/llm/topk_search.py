"""Exact top-k inner products by dual-tree search over cover trees.

The upper levels of one cover tree, found on at most ``FIT_ROWS`` vectors, deal queries and
data together to cells (the nearest centre); every vector is in a cell, and a cell knows
its covering radius. Equal vectors are one point, with the smallest ids that can matter.
A cell's points are dealt to tiles, and a task builds a cover tree over a tile and one over
the queries that visit it: a pair of nodes is given up as soon as the greatest product
that its centres and covering radii allow (q.p <= c.d + |c| s + |d| r + r s) lies below
the worst k-th score of the queries in it. First all queries visit their own cell; the
k-th scores they take from there rule out most of the other cells before anything moves, by the
same bound on whole groups of queries. Scores are products of integers and are computed exactly:
in floating point only where no sum can leave the range in which integers are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, saved, table

#: Vectors on which the cells are found, and the most cells; points of a tile, queries of a group, groups that visit a tile in one task.
FIT_ROWS, CELLS, TILE, GROUP, VISITS = 2000, 64, 4096, 512, 32
#: Points of a node that is not split further; a node's radius by that of its children.
LEAF, SHRINK = 32, 1.3
#: Points of a leaf that small children share.
BUNCH = 512


def _read(scale: int):
    """Vectors in whole numbers, eight bytes each, with a digest; those that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, blobs = [], []
            for row, (i, v) in enumerate(zip(b["vec_id"], b["embedding"], strict=True)):
                if not i.is_valid or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                    if not np.isfinite(x).all() or not float(x @ x) < 2.0**62:
                        continue
                at.append(row)
                blobs.append(x.astype("<i8").tobytes())
            pick = pa.array(at, pa.int64())
            marks = [hashlib.blake2b(v, digest_size=16).digest() for v in blobs]
            yield pa.RecordBatch.from_arrays([b["row"].take(pick), b["vec_id"].take(pick), b["asks"].take(pick), pa.array([len(v) // 8 for v in blobs], pa.int32()), pa.array(blobs, pa.binary()), pa.array(marks, pa.binary())], ["row", "vec_id", "asks", "dim", "v", "mark"])

    return run


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), dim).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact. No partial sum exceeds the product of the norms (Cauchy-Schwarz)."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    top = np.sqrt((a * a).sum(1).max() * (b * b).sum(1).max()) if a.shape[1] else 0.0
    if top < 2.0**23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if top < 2.0**52:
        return (a @ b.T).astype(np.int64)
    with np.errstate(over="ignore"):  # sums wrap, and end in range
        return a.astype(np.int64) @ b.astype(np.int64).T


class CoverTree:
    """Points in nodes whose radius shrinks by SHRINK from level to level: each point of a node is within the radius of its
    centre, and centres of siblings are further apart than that. Children of few points share leaves around their parent's
    centre. ``order`` puts a node's points side by side."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.kids: list[list[int]] = []
        parts: list[np.ndarray] = []
        at = 0

        def put(points: np.ndarray, centre: int, far: np.ndarray) -> int:
            nonlocal at
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(far.max()) * (1 + 1e-9))
            self.span.append((at, at + len(points)))
            self.kids.append([])
            if len(points) <= leaf or not far.any():
                parts.append(points)
                at += len(points)
                return node
            reach, left, small = far.max() / SHRINK, np.arange(len(points)), []
            while len(left):  # the first that is not covered yet is the centre of the next child
                d = np.sqrt(((x[points[left]] - x[points[left[0]]]) ** 2).sum(1))
                near = d <= reach
                own = left[near]
                if len(own) > leaf // 4:
                    self.kids[node].append(put(points[own], int(points[left[0]]), d[near]))
                else:
                    small.append(own)
                left = left[~near]
            own = np.concatenate(small) if small else left
            for s in range(0, len(own), BUNCH):
                part = own[s : s + BUNCH]
                self.centre.append(centre)
                self.radius.append(float(far[part].max()) * (1 + 1e-9))
                self.span.append((at, at + len(part)))
                self.kids.append([])
                self.kids[node].append(len(self.centre) - 1)
                parts.append(points[part])
                at += len(part)
            return node

        if len(x):
            put(np.arange(len(x)), 0, np.sqrt(((x - x[0]) ** 2).sum(1)))
        self.order = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.centres = x[self.centre]
        self.norms = np.sqrt((self.centres**2).sum(1))
        self.radius = np.array(self.radius)

    def cut(self, most: int) -> np.ndarray:
        """Centres of the lowest level that has at most ``most`` nodes."""
        level = [0] if self.centre else []
        while True:
            lower = [k for n in level for k in (self.kids[n] or [n])]
            if len(lower) > most or lower == level:
                return np.unique(self.centres[level], axis=0)
            level = lower


class Best:
    """The k best ids so far of each query: score descending, then vec_id, then row. ``ids`` are those of a point, in order."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.rows = k, [[] for _ in range(n)]
        self.worst = floor.astype(np.float64)  # a score below this cannot be among the k

    def add(self, q: int, scores: np.ndarray, points: np.ndarray, ids: list) -> None:
        near = np.flatnonzero(scores >= self.worst[q])
        if not len(near):
            return
        if len(near) > self.k:  # of as many points, those under the k-th cannot be
            near = near[scores[near] >= np.partition(scores[near], len(near) - self.k)[len(near) - self.k]]
        new = [(-int(scores[i]), *own) for i in near for own in ids[points[i]]]
        self.rows[q] = sorted(self.rows[q] + new)[: self.k]
        if len(self.rows[q]) == self.k:
            self.worst[q] = max(self.worst[q], -self.rows[q][-1][0])


def dual_search(queries: CoverTree, data: CoverTree, ids: list, best: Best) -> int:
    """Fills ``best`` with all that ``data`` has for ``queries``; returns the pairs of points that were multiplied."""
    if not queries.centre or not data.centre:
        return 0

    def most(q: int, ds: list[int]) -> np.ndarray:
        c, r, s = queries.centres[q], queries.radius[q], data.radius[ds]
        top = data.centres[ds] @ c + queries.norms[q] * s + data.norms[ds] * r + r * s
        return top + 1e-9 * (queries.norms[q] + r) * (data.norms[ds] + s) + 1e-6

    def worst(q: int) -> float:
        lo, hi = queries.span[q]
        return best.worst[queries.order[lo:hi]].min()

    done, lengths = 0, np.sqrt((queries.x**2).sum(1))
    stack = [(most(0, [0])[0], 0, 0)]
    while stack:
        top, q, d = stack.pop()
        if top < worst(q):
            continue
        split_q, split_d = bool(queries.kids[q]), bool(data.kids[d])
        if split_d and (not split_q or data.radius[d] >= queries.radius[q]):
            kids = data.kids[d]
            tops = most(q, kids)
            for i in np.argsort(tops, kind="stable"):  # the most promising is taken next
                stack.append((tops[i], q, kids[i]))
        elif split_q:
            stack.extend((most(k, [d])[0], k, d) for k in queries.kids[q])
        else:
            qs, ps = queries.order[slice(*queries.span[q])], data.order[slice(*data.span[d])]
            own, norm = queries.x[qs], lengths[qs]  # each query by itself, before any product
            reach = own @ data.centres[d] + norm * data.radius[d]
            qs = qs[reach + 1e-9 * norm * (data.norms[d] + data.radius[d]) + 1e-6 >= best.worst[qs]]
            scores = products(queries.x[qs], data.x[ps])
            done += scores.size
            for i, row in zip(qs, scores, strict=True):
                best.add(int(i), row, ps, ids)
    return done


def _placed(cells: dict[int, np.ndarray]):
    """Adds the nearest centre of the vector's dimension, the distance and the norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b["dim"].to_numpy()
            cell, far, norm = np.zeros(len(dims), np.int32), np.zeros(len(dims)), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x, c = _matrix(b["v"].take(pa.array(at)).to_pylist(), d), cells.get(d, np.zeros((1, d)))
                cell[at] = np.argmin((c * c).sum(1)[None, :] - 2 * (x @ c.T), axis=1)
                far[at] = np.sqrt(((x - c[cell[at]]) ** 2).sum(1))
                norm[at] = np.sqrt((x * x).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far), pa.array(norm)], [*b.schema.names, "cell", "far", "norm"])

    return run


_FOUND = "asker binary, score long, vec_id long, row long"


def _searched(k: int):
    """A tile's points, and the groups of queries that visit it."""

    def run(key, visits, points):
        dim = key[0].as_py()
        out: list[list] = [[], [], [], []]
        data = CoverTree(_matrix(points["v"].to_pylist(), dim))
        ids = [[(i["vec_id"], i["row"]) for i in own] for own in points["ids"].to_pylist()]
        names, x, floor = visits["mark"].to_pylist(), _matrix(visits["v"].to_pylist(), dim), visits["floor"].to_numpy()
        groups = visits["grp"].to_numpy()
        for g in np.unique(groups):
            at = np.flatnonzero(groups == g)
            best = Best(len(at), k, floor[at])
            dual_search(CoverTree(x[at]), data, ids, best)
            for i, rows in zip(at, best.rows, strict=True):
                for s, v, r in rows:
                    for col, value in zip(out, (names[i], -s, v, r), strict=True):
                        col.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["asker", "score", "vec_id", "row"])

    return run


def _visiting(cells: dict[int, np.ndarray], known: dict[int, list[tuple[int, float]]]):
    """The cells that a group of queries must still visit: those whose bound reaches the worst k-th score of the group."""

    def run(key, group):
        dim, home = key[0].as_py(), key[1].as_py()
        x, floor = _matrix(group["v"].to_pylist(), dim), group["floor"].to_numpy()
        mine = cells.get(dim, np.zeros((1, dim)))[home]
        r, c, worst = np.sqrt(((x - mine) ** 2).sum(1).max()), np.sqrt(mine @ mine), floor.min()
        at = []
        for cell, s in known.get(dim, []):
            d = cells.get(dim, np.zeros((1, dim)))[cell]
            norm = np.sqrt(d @ d)
            if cell != home and mine @ d + c * s + norm * r + r * s + 1e-9 * (c + r) * (norm + s) + 1e-6 >= worst:
                at.append(cell)
        rows, n = group.num_rows, len(at)
        take = np.tile(np.arange(rows), n)
        return group.select(["dim", "mark", "v", "grp", "floor"]).take(pa.array(take)).append_column("cell", pa.array(np.repeat(np.array(at, np.int32), rows), pa.int32()))

    return run


def top_k(vectors: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best candidates of each row of ``vectors`` (vec_id, embedding, asks boolean) that asks: query_id, rank from 1,
    vec_id, score.

    Components become floor(scale * x); scores are inner products of these. Every row but the query's own is a candidate,
    those of the same vec_id too; ties go to the smaller vec_id, then to any row. Vectors of different dimension have no
    product and do not meet; a query with fewer candidates than k has them all. Left out are vectors that are null or hold
    null or non-finite components, null ids, and vectors whose squared norm reaches 2**62 after scaling, whose scores
    need not fit a long. Rows that stand twice are two candidates (and ask twice). No query, no row.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.col("asks"), F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("embedding"))
    read = saved(rows.mapInArrow(_read(scale), "row long, vec_id long, asks boolean, dim int, v binary, mark binary"), "vectors")
    # one more than k of equal vectors: a query may be among them
    rank = F.row_number().over(Window.partitionBy("dim", "mark").orderBy("vec_id", "row"))
    points = read.withColumn("n", rank).filter(F.col("n") <= k + 1).groupBy("dim", "mark").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("ids"), F.any_value("v").alias("v"))
    asked = read.filter("asks").select("dim", "mark").distinct().withColumn("asks", F.lit(True))
    points = points.join(asked, ["dim", "mark"], "left").select("dim", "mark", "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    fit = read.orderBy(F.xxhash64("mark"), "row").limit(FIT_ROWS).select("dim", "v").toArrow()  # bounded by FIT_ROWS
    by: dict[int, list[bytes]] = {}
    for d, v in zip(fit["dim"].to_pylist(), fit["v"].to_pylist(), strict=True):
        by.setdefault(d, []).append(v)
    cells = {d: CoverTree(_matrix(v, d)).cut(CELLS) for d, v in by.items()}
    points = saved(points.mapInArrow(_placed(cells), "dim int, mark binary, v binary, ids array<struct<vec_id:long,row:long>>, asks boolean, cell int, far double, norm double"), "points")
    sizes = points.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count_if("asks").alias("asks"))
    sizes = saved(sizes.withColumns({"tiles": F.ceil(F.col("n") / TILE).cast("int"), "groups": F.greatest(F.ceil(F.col("asks") / GROUP), F.lit(1)).cast("int")}), "cells")
    known: dict[int, list[tuple[int, float]]] = {}
    for r in sizes.select("dim", "cell", "far").collect():  # CELLS rows a dimension
        known.setdefault(r["dim"], []).append((r["cell"], r["far"] * (1 + 1e-9)))
    sizes = F.broadcast(sizes.select("dim", "cell", "tiles", "groups"))
    spread = F.xxhash64("mark", F.lit(1))
    data = points.join(sizes, ["dim", "cell"]).select("dim", "cell", F.pmod(spread, F.col("tiles")).cast("int").alias("tile"), "v", "ids")
    queries = points.filter("asks").join(sizes, ["dim", "cell"]).select("dim", "cell", "mark", "v", F.pmod(spread, F.col("groups")).cast("int").alias("part"))
    queries = queries.withColumn("grp", F.xxhash64("dim", "cell", "part"))

    def searched(visits: DataFrame) -> DataFrame:
        """Visits (dim, cell, mark, v, grp, floor) to all tiles of the cell, VISITS groups at a time about."""
        groups = visits.groupBy("dim", "cell").agg(F.approx_count_distinct("grp").alias("g")).select("dim", "cell", F.ceil(F.col("g") / VISITS).cast("int").alias("turns"))
        groups = F.broadcast(groups)  # CELLS rows a dimension
        visits = visits.join(groups, ["dim", "cell"]).join(sizes, ["dim", "cell"]).withColumn("turn", F.pmod(F.xxhash64("grp"), F.col("turns")).cast("int"))
        visits = visits.select("dim", "cell", "turn", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "mark", "v", "grp", "floor")
        met = data.join(groups, ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "tile", "v", "ids")
        met = met.toDF(*met.columns)  # both sides come from the same points
        at = ["dim", "cell", "turn", "tile"]
        return visits.groupBy(*at).cogroup(met.groupBy(*at)).applyInArrow(_searched(k + 1), _FOUND)

    best = Window.partitionBy("asker").orderBy(F.col("score").desc(), "vec_id", "row")

    def best_of(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)

    home = saved(best_of(searched(queries.withColumn("floor", F.lit(-np.inf)))), "home")
    floors = home.filter(F.col("place") == k + 1).select(F.col("asker").alias("mark"), F.col("score").cast("double").alias("floor"))
    asking = queries.join(floors, "mark", "left").select("dim", "cell", "mark", "v", "part", "grp", F.coalesce("floor", F.lit(-np.inf)).alias("floor"))
    visits = asking.groupBy("dim", "cell", "part").applyInArrow(_visiting(cells, known), "dim int, mark binary, v binary, grp long, floor double, cell int")
    visits = saved(visits, "visits")
    found = saved(best_of(home.drop("place").unionByName(searched(visits))), "best")
    discard(home, visits)
    mine = read.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), F.col("mark").alias("asker"))
    theirs = mine.join(found.drop("place"), "asker").filter("row <> own")
    place = F.row_number().over(Window.partitionBy("own").orderBy(F.col("score").desc(), "vec_id", "row"))
    return theirs.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").withColumn("asks", F.col("vec_id") % 100 == 0))
