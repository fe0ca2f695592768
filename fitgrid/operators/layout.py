"""Reading order of the text blocks of pages: the widest gutter between columns, and the bands that wide blocks cut.

Blocks are rows (page, pos, x0, y0, x1, y1), ``pos`` telling blocks of a page apart. A gutter is looked for point by point
in the middle of the page, all points and blocks of a page at once, in one pass over pages. A page's blocks meet in
one task: it is a page of text. Bands and order are windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.shared import saved

# Shares of the page's width, points of the page.
FULL_WIDTH, SEARCH_FROM, SEARCH_TO = 0.6, 0.25, 0.75
LEAST_GUTTER, STEP = 4.0, 1.0


def gutter(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, width: float) -> float | None:
    """The x of a page's widest gutter.

    A point is in a gutter if blocks lie wholly on either side of it, at the same height somewhere, and no narrow
    block across it shares a height with one that is beside it. The first of equally wide runs of points is taken, in its middle;
    runs under LEAST_GUTTER are gaps between words.
    """
    lo, hi = width * SEARCH_FROM, width * SEARCH_TO
    x = (lo + STEP * np.arange(int((hi - lo) / STEP) + 1))[:, None]
    left, right = x1 <= x, x0 >= x
    high, low = (np.where(side, y0, np.inf).min(1) for side in (left, right)), (np.where(side, y1, -np.inf).max(1) for side in (left, right))
    (l_top, r_top), (l_end, r_end) = high, low
    fine = (l_top < r_end) & (r_top < l_end)
    if fine.any():
        meet = (y0[:, None] < y1) & (y0 < y1[:, None])
        across = (x0 < x) & (x < x1) & (x1 - x0 <= FULL_WIDTH * width)
        at = np.flatnonzero(fine)
        fine[at] = ~(across[at] & ((left | right)[at].astype(np.float32) @ meet.astype(np.float32) > 0)).any(1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], fine, [0]])))
    first, last = edge[::2], edge[1::2] - 1
    wide = (last - first) * STEP
    if not len(wide) or wide.max() < LEAST_GUTTER:
        return None
    best = int(np.argmax(wide))
    return float((x[first[best], 0] + x[last[best], 0]) / 2)


def gutters(blocks: DataFrame, width: float) -> DataFrame:
    """The gutter of each page that has one: page, gutter. Blocks with a null edge are on no side."""
    pages = blocks.filter("x0 + x1 + y0 + y1 IS NOT NULL").groupBy("page").agg(F.flatten(F.collect_list(F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))))).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, flat = b["edges"].offsets.to_numpy(), b["edges"].values.to_numpy()
            found = [gutter(*flat[s:e].reshape(-1, 4).T, width) for s, e in zip(off[:-1], off[1:], strict=True)]
            has = pa.array([i for i, g in enumerate(found) if g is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([b["page"].take(has), pa.array([g for g in found if g is not None], pa.float64())], ["page", "gutter"])

    kind = blocks.schema["page"].dataType.simpleString()
    return pages.mapInArrow(run, f"page {kind}, gutter double")


def reading_order(blocks: DataFrame, width: float) -> DataFrame:
    """``blocks`` with ``gutter`` (NULL on a page of one column) and ``place``, from 1 on each page, as a person reads it.

    Without a gutter from top to bottom, then from left to right. With one, the blocks across it cut the page into bands; of
    a band the left column comes first, then the right one, then the block that ends it. A block goes to the bands that
    hold its middle: should the middles of two blocks across come in another order than their tops, their bands overlap, and what
    is in both is read twice, as rows of two places. Blocks at one place come by ``pos``.
    """
    top, middle = F.bround("y0", 1), (F.col("y0") + F.col("y1")) / 2
    df = blocks.join(gutters(blocks, width), "page", "left")
    side = F.when(F.col("gutter").isNull() | (F.col("x1") <= F.col("gutter")), 0).when(F.col("x0") >= F.col("gutter"), 1).otherwise(2)
    df = saved(df.withColumns({"__side": side, "__top": top, "__middle": middle}), "sides")  # read for the bands and for what is in them
    across = df.filter("__side = 2").select("page", "__top", "x0", "pos", F.col("__middle").alias("__to"))
    w = Window.partitionBy("page").orderBy("__top", "x0", "pos")
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    cut = across.withColumns({"__band": F.row_number().over(w), "__from": F.coalesce(F.lag("__to").over(w), low)})
    last = cut.groupBy("page").agg((F.max("__band") + 1).alias("__band"), F.max_by("__to", "__band").alias("__from")).withColumn("__to", high)
    bands = cut.select("page", "__band", "__from", "__to").unionByName(last)
    apart = df.filter("__side < 2").join(bands, "page", "left").filter("__band IS NULL OR (__middle >= __from AND __middle < __to)")
    ends = df.filter("__side = 2").join(cut.select("page", "pos", "__band"), ["page", "pos"])
    columns = [*blocks.columns, "gutter", "__side", "__top", F.coalesce("__band", F.lit(1)).alias("__band")]
    order = Window.partitionBy("page").orderBy("__band", "__side", "__top", "x0", "pos")
    return apart.select(*columns).unionByName(ends.select(*columns)).withColumn("place", F.row_number().over(order)).drop("__side", "__top", "__band")
