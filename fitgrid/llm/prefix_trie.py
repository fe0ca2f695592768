"""The trie of conversations' openings, by heavy-path decomposition.

A node is the sequence of a conversation's first turns. Turns are known by a digest; a
node's key is the exclusive or of two 64-bit hashes of (depth, digest) over its turns, so
keys of all openings are running sums, and a node's parent is its key without its own
turn. Turns are numbered and summed in parts, so a conversation may be longer than a
task can hold. Of the children of a node the one with most members continues the
node's path, all others begin paths of their own: a path has at most half of the
members of the node it hangs on, so there are at most log2(conversations) paths above
any node. The paths of a conversation are read off its own light nodes. Then, level by
level from the lowest paths up, sums run along each path from its end (in parts of
``CHUNK`` nodes), and the sum at its head is attached to the node it hangs on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitgrid.operators.running import numbered

from .common import saved, table

#: Turns of a conversation, or nodes of a path, that one window sums; members whose ids are joined to one text.
CHUNK, JOINED = 1024, 4096
_KEY, _UP = ["k1", "k2"], ["p1", "p2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, place from 1, digest, chars) in order of turn, nulls first, then digest of role and text.

    Null roles and texts are empty; turns without a conv_id belong to no conversation and are left out; a turn that stands
    twice is two turns. Texts of any length are digested whole; ``chars`` are code points.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.char_length(text).alias("chars"))
    return numbered(turns.filter("conv_id IS NOT NULL"), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")]).drop("turn")


def shared_openings(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of the first conversation of its group of ``group`` ids, then its own after
    its first h, h being crc32(conv_id) % ``most``. Turns (conv_id, depth from 1, digest, chars), and all conv_ids: one may
    be left without turns."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    first = turns.filter((F.col("conv_id") % group == 0) & (F.col("place") < most))
    had = first.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("had"))
    ids = turns.select("conv_id").distinct()
    taken = F.least(F.col("h").cast("long"), F.coalesce("had", F.lit(0)))
    own = turns.withColumns({"h": h, "base": base}).filter("place > h").join(had, "base", "left").select("conv_id", (F.col("place") - F.col("h") + taken).alias("depth"), "digest", "chars")
    opening = first.select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "digest", "chars")
    opened = ids.withColumns({"h": h, "base": base}).join(opening, "base").filter("depth <= h").select("conv_id", "depth", "digest", "chars")
    return own.unionByName(opened), ids


def _summed(df: DataFrame, of: list[str], at: Column, sums: dict[str, Column], add=F.sum, join=lambda a, b: a + b, down: bool = False) -> DataFrame:
    """``df`` with running sums over ``at`` (from 0, without gaps) within ``of``: within parts of CHUNK, then what the parts
    before (``down``: after) it hold. Ties and nulls do not occur in ``at``."""
    df = df.withColumns({"__at": at, "__part": F.floor(at / CHUNK)} | {f"__{k}": v for k, v in sums.items()})
    order = F.col("__at").desc() if down else F.col("__at")
    inner = Window.partitionBy(*of, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = df.groupBy(*of, "__part").agg(*(add(f"__{k}").alias(f"__sum_{k}") for k in sums))
    outer = Window.partitionBy(*of).orderBy(F.col("__part").desc() if down else F.col("__part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*of, "__part", *(add(f"__sum_{k}").over(outer).alias(f"__before_{k}") for k in sums)).filter(" OR ".join(f"__before_{k} IS NOT NULL" for k in sums))
    df = df.withColumns({k: add(f"__{k}").over(inner) for k in sums}).join(parts, [*of, "__part"], "left")
    df = df.withColumns({k: join(F.col(k), F.coalesce(f"__before_{k}", F.lit(0))) for k in sums})
    return df.drop("__at", "__part", *(f"__{k}" for k in sums), *(f"__before_{k}" for k in sums))


def prefix_trie(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of ``turns`` (conv_id, depth from 1 without gaps, digest, chars) of the conversations ``ids``, and the node at
    which each conversation ends (k1, k2, conv_id).

    Nodes: k1, k2 (key), p1, p2 (the parent's), conv_id (smallest member), depth, n_convs, n_children, n_leaves,
    saved_tokens: over the subtree, the members but one of each node times the characters of its last text. Ties of the
    largest child go to the smaller conv_id. Conversations without turns are members of the root, which stands wherever there is
    a conversation; no conversation, no node.
    """
    own = turns.withColumns({"x1": F.xxhash64("depth", "digest"), "x2": F.xxhash64("digest", "depth")}).drop("digest")
    keyed = _summed(own, ["conv_id"], F.col("depth") - 1, {"k1": F.col("x1"), "k2": F.col("x2")}, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    keyed = saved(keyed.select("conv_id", "depth", *_KEY, F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "chars"), "openings")
    zero = F.lit(0).cast("long")
    last = keyed.groupBy("conv_id").agg(F.max_by(F.struct(*_KEY), "depth").alias("k"))
    ends = ids.join(last, "conv_id", "left").select(F.coalesce("k.k1", zero).alias("k1"), F.coalesce("k.k2", zero).alias("k2"), "conv_id")
    nodes = keyed.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").cast("long").alias("chars"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("depth"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("chars"))
    nodes = saved(nodes.unionByName(root), "nodes")
    # the largest child of each node
    kids = nodes.filter("depth > 0").groupBy(*_UP).agg(F.count("*").alias("n_children"), F.max_by(F.struct(*_KEY), F.struct("n_convs", (-F.col("conv_id")).alias("c"))).alias("heavy"))
    kids = saved(kids.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children", "heavy"), "children")
    light = nodes.filter("depth > 0").join(kids.select("heavy.k1", "heavy.k2"), _KEY, "left_anti").select(*_KEY)
    # a node's path is that of the last light node above it in any of its members; each has log2(members) of them at most
    above = keyed.select("conv_id", "depth", *_KEY).join(light, _KEY).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", *_KEY))).alias("light"))
    upto = F.filter(F.coalesce("light", F.array()), lambda x: x["depth"] <= F.col("depth"))
    placed = nodes.join(kids.select(*_KEY, "n_children"), _KEY, "left").join(above, "conv_id", "left").withColumn("upto", upto)
    head = F.try_element_at("upto", F.lit(-1))
    placed = placed.select("conv_id", "depth", *_KEY, *_UP, "n_convs", F.coalesce("n_children", zero).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("weight"), F.size("upto").alias("level"), *(F.coalesce(head[c], zero).alias(n) for c, n in (("depth", "top"), ("k1", "h1"), ("k2", "h2"))))
    placed = saved(placed, "paths")
    lowest = placed.agg(F.max("level")).first()[0]
    done, attached = [], None
    for level in range(-1 if lowest is None else lowest, -1, -1):
        rows = placed.filter(F.col("level") == level)
        leaves, weight = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), F.col("weight")
        if attached is not None:
            rows = rows.join(attached, _KEY, "left")
            leaves, weight = leaves + F.coalesce("more_leaves", zero), weight + F.coalesce("more_weight", zero)
        done.append(saved(_summed(rows, ["h1", "h2"], F.col("depth") - F.col("top"), {"n_leaves": leaves, "saved_tokens": weight}, down=True), f"level-{level}"))
        attached = done[-1].filter("depth = top AND depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_weight"))
    columns = [*_KEY, *_UP, "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if not done:
        return placed.withColumns({"n_leaves": zero, "saved_tokens": zero}).select(*columns), ends
    return reduce(DataFrame.unionByName, (d.select(*columns) for d in done)), ends


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv_id): up to JOINED ids of a node as one text, with the first of them."""
    now, held = None, []

    def sent():
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*now, held[0])] + [pa.array([",".join(map(str, held))])], [*_KEY, "first", "ids"])

    rows: list[pa.RecordBatch] = []
    for b in batches:
        for k1, k2, c in zip(*(b[n].to_pylist() for n in (*_KEY, "conv_id")), strict=True):
            if held and ((k1, k2) != now or len(held) == JOINED):
                rows.append(sent())
                held = []
            now = (k1, k2)
            held.append(c)
        if rows:
            yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
            rows = []
    if held:
        yield sent()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, first, ids): the hash of a node's ids, of which one piece is held at a time."""
    now, found, out = None, None, []
    for b in batches:
        for k1, k2, ids in zip(b["k1"].to_pylist(), b["k2"].to_pylist(), b["ids"], strict=True):
            if (k1, k2) != now:
                if now is not None:
                    out.append((*now, found.hexdigest()))
                now, found = (k1, k2), hashlib.sha256()
            else:
                found.update(b",")
            found.update(ids.as_py().encode())
        yield _digests(out)
        out = []
    if now is not None:
        yield _digests([(*now, found.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], [*_KEY, "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined conv_ids that end at each node, ascending. They are sorted and joined by ranges, so that a
    node where a third of all conversations end is joined by many tasks; one then hashes its pieces in order."""
    pieces = ends.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(_joined, "k1 long, k2 long, first long, ids string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")


def conversation_nodes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie's nodes with their parents' conv_id and the digest of the conversations that end there."""
    nodes, ends = prefix_trie(turns, ids)
    up = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(up, _UP, "left").join(ends_digest(ends), _KEY, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int | None = None, most: int = 6) -> DataFrame:
    """One row per node of the trie of ``conversations`` (conv_id, turn, role, text), rebuilt by ``shared_openings`` if
    ``group`` is given: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Order, nulls, repeated turns and long texts are as in ``ordered_turns``, ties and conversations without turns as in
    ``prefix_trie``. Columns of other names are ignored; an empty table gives an empty result.
    """
    turns = saved(ordered_turns(conversations), "turns")
    if group:
        turns, ids = shared_openings(turns, group, most)
    else:
        turns, ids = turns.withColumnRenamed("place", "depth"), turns.select("conv_id").distinct()
    return conversation_nodes(turns, ids)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), group=100)
