"""Packing texts into sequences by linear grouping and best fit.

Only the histogram of piece lengths (at most ``size`` entries) goes to the driver,
and the plan is made on it: large lengths are rounded up within groups of equal
cardinality, a linear programme over configurations of the few rounded sizes is
solved by column generation, actual lengths take the places of the rounded ones (but the smallest of each configuration), and
what is left, the small lengths among it, goes by best fit, the longest first. The
plan is a list of runs (a configuration of lengths and how often it occurs), so it
does not grow with the number of texts. Pieces then find their place by their rank
among the pieces of their length, which is counted distributed.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

SIZE, GROUPS = 2048, 64
#: Lengths over SIZE divided by one of these are large and grouped, the rest small; the plan of fewest sequences is taken.
SMALL = (2, 3, 4, 6)
#: Pieces of one length and bucket that a task ranks, about.
BUCKET_ROWS = 20_000
#: Texts outside this set, and those that name a special token, take the slower library.
_PLAIN = re.compile("[^\t\n\x20-\x7e¡-¬®-ɏ]")
_SPECIAL = "<|endoftext|>"
_encoders: dict[tuple[str, str | None], tuple] = {}


def _encoder(vocabulary: str, ranks: str | None):
    """Encodes texts as ids. The rank file, if given, holds the same vocabulary; it is four times as fast on plain texts."""
    import base64
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (vocabulary, ranks) not in _encoders:
        from tokenizers import Tokenizer

        slow, quick = Tokenizer.from_file(public_tokenizers.path(vocabulary)), None
        if ranks:
            import tiktoken

            with open(public_tokenizers.path(ranks), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        _encoders[vocabulary, ranks] = slow, quick
    slow, quick = _encoders[vocabulary, ranks]

    def encode(text: str) -> list[int]:
        if quick is None or _SPECIAL in text or _PLAIN.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return quick.encode_ordinary(text)

    return encode


def _pieces(vocabulary: str, ranks: str | None, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, ranks)
        for b in batches:
            at, out = [], []
            for row, text in enumerate(b["text"]):
                ids = np.array([*encode(text.as_py() or ""), 0], np.dtype("<u4"))
                first = (len(ids) - 1) % size + 1
                cuts = [0, *range(first, len(ids) + 1, size)]
                for p, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(row)
                    out.append((p, x, y - x, zlib.crc32(ids[x:y].tobytes())))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _best_configuration(value: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """The configuration of greatest value that fits: by number of items, over all fillings."""
    most = size // int(sizes.min())
    best, back = np.full((most + 1, size + 1), -np.inf), np.zeros((most + 1, size + 1), np.int64)
    best[0, 0] = 0
    for k in range(1, most + 1):
        for g, s in enumerate(sizes):
            got = best[k - 1, : size + 1 - s] + value[g]
            better = got > best[k, s:]
            best[k, s:][better] = got[better]
            back[k, s:][better] = g
    k, fill = np.unravel_index(int(np.argmax(best)), best.shape)
    out = np.zeros(len(sizes))
    while k:
        g = back[k, fill]
        out[g] += 1
        k, fill = k - 1, fill - sizes[g]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, size: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Whole multiples of configurations from the linear programme, rounded down: (items of each size, times)."""
    g = len(sizes)
    basis = np.diag((size // sizes).astype(float))
    inverse = np.linalg.inv(basis)
    x = inverse @ demand
    cost = np.ones(g)
    for _ in range(rounds):
        dual = cost @ inverse
        if dual.min() < -1e-9:  # a surplus column
            new, c = np.zeros(g), 0.0
            new[int(np.argmin(dual))] = -1
        else:
            new, c = _best_configuration(dual, sizes, size), 1.0
            if dual @ new <= 1 + 1e-7:
                break
        step = inverse @ new
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        x = x - ratio[leave] * step
        x[leave] = ratio[leave]
        basis[:, leave], cost[leave] = new, c
        inverse = np.linalg.inv(basis)
    return [(basis[:, i].astype(int), int(x[i] + 1e-9)) for i in range(g) if cost[i] and x[i] >= 1]


def _grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Large lengths, the longest first, in groups of equal cardinality; each a list of [length, count]."""
    each = max(1, -(-sum(counts.values()) // groups))
    out, room = [[]], each
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = each
            k = min(n, room)
            out[-1].append([length, k])
            n, room = n - k, room - k
    return [x for x in out if x]


def plan(counts: dict[int, int], size: int = SIZE, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths, times) that hold ``counts`` pieces of each length, no run longer than ``size``."""
    return min((_plan(counts, size, groups, small) for small in SMALL), key=lambda runs: sum(times for _, times in runs))


def _plan(counts: dict[int, int], size: int, groups: int, small: int) -> list[tuple[tuple[int, ...], int]]:
    runs = [((size,), counts[size])] if counts.get(size) else []
    rest = {k: v for k, v in counts.items() if v and k < size}
    large = {k: v for k, v in rest.items() if k * small > size}
    open_runs: dict[int, list[list]] = defaultdict(list)  # by room left: [lengths, times]
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], times: int) -> None:
        room = size - sum(lengths)
        if not open_runs[room]:
            insort(rooms, room)
        open_runs[room].append([lengths, times])

    if large:
        parts = _grouped(large, groups)
        sizes = np.array([p[0][0] for p in parts])
        demand = np.array([float(sum(k for _, k in p)) for p in parts])
        left = [list(map(list, p)) for p in parts]
        for items, times in sorted(configurations(sizes, demand, size), key=lambda c: tuple(-c[0])):
            if items.sum() > 1:  # the smallest place of a configuration goes to the text that fits it best, below
                items = items.copy()
                items[np.flatnonzero(items)[-1]] -= 1
            slots = [g for g in range(len(sizes)) for _ in range(items[g])]
            while times:
                heads = [(g, int(items[g])) for g in range(len(sizes)) if items[g]]
                if any(sum(k for _, k in left[g]) < m for g, m in heads):
                    break
                k = min([times, *(left[g][0][1] // m for g, m in heads)])
                if k:
                    lengths = tuple(left[g][0][0] for g in slots)
                    for g, m in heads:
                        left[g][0][1] -= k * m
                else:
                    k, took = 1, []
                    for g in slots:
                        while not left[g][0][1]:
                            left[g].pop(0)
                        left[g][0][1] -= 1
                        took.append(left[g][0][0])
                    lengths = tuple(took)
                for g, _ in heads:
                    while left[g] and not left[g][0][1]:
                        left[g].pop(0)
                put(lengths, k)
                times -= k
        rest = {k: v for k, v in rest.items() if k not in large}
        for p in left:
            for length, n in p:
                if n:
                    rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):  # best fit
        n = rest[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = size // length
                if n >= each:
                    put((length,) * each, n // each)
                    n %= each
                if n:
                    put((length,) * n, 1)
                break
            room = rooms[at]
            lengths, times = open_runs[room].pop()
            if not open_runs[room]:
                rooms.pop(at)
            k = min(n, times)
            if k < times:
                put(lengths, times - k)
            put((*lengths, length), k)
            n -= k
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for many in open_runs.values():
        for lengths, times in many:
            merged[tuple(sorted(lengths, reverse=True))] += times
    return runs + sorted(merged.items(), reverse=True)


def _places(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, of that length in a sequence, first sequence, offset)."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, times in runs:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            m = lengths.count(length)
            out.append((length, used[length], used[length] + m * times, m, sequence, offset))
            used[length] += m * times
            offset += m * length
        sequence += times
    return out


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, copy.

    A text is its ids and then id 0; null and empty texts are the 0 alone. Only texts
    of more than ``size`` ids are cut, the first piece taking the remainder. Repeated
    rows are packed once each and numbered by ``copy`` from 0; texts of any length are taken whole; ties go by a hash of
    id, piece and ids; other columns, whatever their names, are not read; null ids are carried; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    pieces = saved(docs.mapInArrow(_pieces(vocabulary, ranks, size), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    places = spark.createDataFrame(_places(plan(counts, size)), "p_length long, lo long, hi long, m long, sequence long, at long")
    buckets = 1 + sum(counts.values()) // BUCKET_ROWS
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumns({"__key": key, "__bucket": F.pmod(key, F.lit(buckets))})
    before = dealt.groupBy("length", "__bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("count")).drop("count")
    within = Window.partitionBy("length", "__bucket").orderBy("__key", "doc_id", "piece", "ids_crc32")
    same = Window.partitionBy("length", "__bucket", "__key", "doc_id", "piece", "ids_crc32").orderBy("start")
    ranked = dealt.withColumn("__rank", F.row_number().over(within) - 1).withColumn("copy", F.row_number().over(same) - 1).join(before, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("before"))
    # a few places a length, however many pieces: the plan is made of runs
    out = ranked.join(F.broadcast(places), (F.col("length") == F.col("p_length")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    turn = F.col("__rank") - F.col("lo")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(turn / F.col("m"))).cast("long").alias("sequence_id"), (F.col("at") + turn % F.col("m") * F.col("length")).cast("long").alias("offset"), "copy")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
