"""Gold and predicted texts paired one to one, the most alike first.

Texts of a group are shuffled once and paired in the task that reads the group, if all its pairs fit there. Larger groups are dealt
to tiles of some gold by some predicted texts, and the greedy order needs no single task: a pair that is the best both for its gold
and for its predicted text is taken by any order from the best down, so rounds of mutual best pairs end in the same pairs. No pair
that is not alike is ever written or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.shared import discard, saved

from ..functions.blocks import match_key
from ..functions.pairing import alike_pairs, matched

# The least likeness of a pair; the most pairs, texts and bytes of texts of a group that one task pairs; the most
# texts and bytes of a tile's side; what a task does, in pairs, of which a text and a group cost as much as so many, and the most
# tasks; rows of a batch.
LEAST = 85.0
CELLS, ROWS, BYTES = 1 << 23, 1 << 16, 1 << 23
TILE_ROWS, TILE_BYTES = 1 << 13, 1 << 22
TASK, TEXT, GROUP, MOST = 1 << 23, 64, 2048, 1 << 12
BATCH = 1 << 14


def distinct_keys(df: DataFrame, by: str, pos: str, text: str) -> DataFrame:
    """(by, at, key): each key of a group once, ``at`` its place in order of first appearance; empty keys are none."""
    keys = df.select(by, F.col(pos).alias("__pos"), match_key(F.col(text)).alias("key")).filter("key <> ''").groupBy(by, "key").agg(F.min("__pos").alias("__pos"))
    return keys.select(by, F.row_number().over(Window.partitionBy(by).orderBy("__pos", "key")).alias("at"), "key")


def _sides(batches: Iterable[pa.RecordBatch], key: int) -> Iterator[tuple[tuple, tuple[list, list]]]:
    """The first ``key`` columns of rows that are sorted by them, and what stands behind the next, which is 0 or 1: rows of either side."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for of, own in groupby(rows, key=itemgetter(*range(key)) if key > 1 else lambda row: row[:1]):
        sides: tuple[list, list] = ([], [])
        for row in own:
            sides[row[key]].append(row[key + 1 :])
        yield of, sides


def _tiles(least: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(by, g, p, score) of tiles (by, tile, tile, side, at, key)."""

    def run(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field(0).type
        for of, (gold, predicted) in _sides((b for part in ([first], batches) for b in part), 3):
            g, p, score = alike_pairs([r[1] for r in gold], [r[1] for r in predicted], least)
            at_g, at_p = pa.array([r[0] for r in gold], pa.int32()), pa.array([r[0] for r in predicted], pa.int32())
            for lo in range(0, len(g), BATCH):
                part = slice(lo, lo + BATCH)
                n = len(g[part])
                by = pa.array(of[:1], kind).take(pa.array([0] * n, pa.int32()))
                yield pa.RecordBatch.from_arrays([by, at_g.take(pa.array(g[part])), at_p.take(pa.array(p[part])), pa.array(score[part])], ["by", "g", "p", "score"])

    return run


def _counted(least: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(by, tp, fp, fn) of whole groups (by, side, key), keys in order of appearance."""

    def run(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kind, out = first.schema.field(0).type, []

        def batch():
            by, *counts = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(by, kind), *(pa.array(c, pa.int64()) for c in counts)], ["by", "tp", "fp", "fn"])

        for (by,), sides in _sides((b for part in ([first], batches) for b in part), 1):
            gold, predicted = (list(dict.fromkeys(k for (k,) in side if k)) for side in sides)  # empty keys are none
            if not gold and not predicted:
                continue
            tp = matched(gold, predicted, least)
            out.append((by, tp, len(predicted) - tp, len(gold) - tp))
            if len(out) == BATCH:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return run


def alike(gold: DataFrame, predicted: DataFrame, by: str, least: float = LEAST) -> DataFrame:
    """(by, g, p, score) of the distinct keys (by, at, key) of a group that are ``least`` alike or more."""
    if least < 85:
        raise ValueError("pairs are kept at a likeness of 85 or more")

    def tiles(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(by).agg(F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum(F.octet_length("key")) / TILE_BYTES)).cast("int").alias(name))

    def dealt(df: DataFrame, side: int) -> DataFrame:
        own, other = ("__g", "__p") if side == 0 else ("__p", "__g")
        met = df.join(sizes.hint("merge"), by).withColumns({own: F.col("at") % F.col(own), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        return met.select(by, "__g", "__p", F.lit(side).alias("__side"), "at", "key")

    # by merge: a kept table of keys is small on disk, what is made of it is not, and must not go through the driver
    sizes = tiles(gold, "__g").join(tiles(predicted, "__p").hint("merge"), by)
    # by number: tiles are work, not bytes, by which their tasks would be drawn together
    n = sizes.agg(F.sum(F.col("__g").cast("long") * F.col("__p"))).first()[0] or 1
    df = dealt(gold, 0).unionByName(dealt(predicted, 1)).repartition(min(n, MOST), by, "__g", "__p").sortWithinPartitions(by, "__g", "__p", "__side", "at")
    return df.mapInArrow(_tiles(least), f"`{by}` {gold.schema[by].dataType.simpleString()}, g int, p int, score double")


def one_to_one(pairs: DataFrame, by: str) -> DataFrame:
    """The pairs (by, g, p, score) that are taken from the best down, each g and p once; ties go to the smaller g, then p."""
    left, taken, held = saved(pairs, "pairs"), [], None
    while left.limit(1).count():
        order = (F.col("score").desc(), F.col("g"), F.col("p"))
        mine, theirs = (F.row_number().over(Window.partitionBy(by, c).orderBy(*order)) for c in ("g", "p"))
        taken.append(saved(left.withColumns({"__g": mine, "__p": theirs}).filter("__g = 1 AND __p = 1").select(*pairs.columns), "taken"))
        rest = left.join(taken[-1].select(by, "g").hint("merge"), [by, "g"], "left_anti").join(taken[-1].select(by, "p").hint("merge"), [by, "p"], "left_anti")
        held, left = left, saved(rest.select(*pairs.columns), "pairs")
        discard(held)
    return reduce(DataFrame.unionByName, taken) if taken else left


def _in_rounds(gold: DataFrame, predicted: DataFrame, by: str, least: float) -> DataFrame:
    """(by, tp, fp, fn) of groups of any size."""
    g, p = saved(distinct_keys(gold, by, "pos", "text"), "gold"), saved(distinct_keys(predicted, by, "pos", "text"), "predicted")
    hits = one_to_one(alike(g, p, by, least), by).groupBy(by).agg(F.count("*").alias("tp"))
    n_g, n_p = g.groupBy(by).agg(F.count("*").alias("__g")), p.groupBy(by).agg(F.count("*").alias("__p"))
    df = n_g.join(n_p, by, "full").join(hits, by, "left").na.fill(0, ["__g", "__p", "tp"])
    return df.select(by, "tp", (F.col("__p") - F.col("tp")).alias("fp"), (F.col("__g") - F.col("tp")).alias("fn"))


def pair_counts(gold: DataFrame, predicted: DataFrame, by: str, least: float = LEAST) -> DataFrame:
    """(by, tp, fp, fn) of gold and predicted texts (by, pos, text)."""
    if least < 85:
        raise ValueError("pairs are kept at a likeness of 85 or more")
    sides = [df.select(by, F.lit(i).alias("__side"), "pos", "text") for i, df in enumerate((gold, predicted))]
    rows = sides[0].unionByName(sides[1])
    n_g, n_p = (F.count(F.when(F.col("__side") == i, 1)) for i in (0, 1))
    # texts without a group are never paired, and go by joins, where NULL meets nothing
    large = F.col(by).isNull() | (n_g.cast("double") * n_p > CELLS) | (n_g + n_p > ROWS) | (F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) > BYTES)
    sizes = saved(rows.groupBy(by).agg(large.alias("__large"), (n_g.cast("double") * n_p + TEXT * (n_g + n_p) + GROUP).alias("__work")).withColumnRenamed(by, "__by"), "sizes")
    work, any_large = sizes.agg(F.sum(F.when(~F.col("__large"), F.col("__work"))), F.max("__large")).first()
    rounds = None
    if any_large:
        large, within = sizes.filter("__large").select("__by"), F.col(by).eqNullSafe(F.col("__by"))
        rounds = _in_rounds(gold.join(large, within, "left_semi"), predicted.join(large, within, "left_semi"), by, least)
        rows = rows.join(large, within, "left_anti")
    keys = rows.select(by, "__side", "pos", match_key(F.col("text")).alias("key"))
    # by number: pairs are work, not bytes, by which the tasks of groups would be drawn together
    keys = keys.repartition(min(1 + int((work or 0) // TASK), MOST), by).sortWithinPartitions(by, "__side", "pos", "key").select(by, "__side", "key")
    df = keys.mapInArrow(_counted(least), f"`{by}` {gold.schema[by].dataType.simpleString()}, tp long, fp long, fn long")
    return df if rounds is None else df.unionByName(rounds)
