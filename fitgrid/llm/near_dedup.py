"""MinHash near-duplicate detection with fast similarity sketching.

Sketch: in round i every shingle is hashed to a coordinate and a value in [i, i+1);
each coordinate keeps the least. After ``coords`` rounds, round i fills coordinate
i - coords from all shingles, so every coordinate is filled after at most twice as
many rounds; a long text stops after one or two. The sketch is cut into bands.
Documents that agree on a band meet in a bucket, and every link is confirmed on the
full shingle sets.

A document is a doc_id: one that stands with several texts is linked by each of them. What is
compared are classes of equal shingle sets, named by the least row key (a hash of id and text) in them.

Hot groups. Equal shingle sets are collapsed first. In a bucket the members are
compared with a centre only (a star), a few times with other centres. Links inside a
component add nothing, so what remains are the documents of buckets that still hold
several components. Among those every pair of different components that can link is
found exactly by prefix filtering: of n shingles ordered by how few of these documents
have them, two sets that link share one of the first n - ceil(n * percent / 100) + 1.
A passage that thousands of texts share is never among these unless they consist of it.

Before texts are fetched for a pair, a bitmap filter bounds it: each set keeps the
parity of its hashes in 512 bins, common hashes cancel in the exclusive or of two such
bitmaps, and so its ones are no more than the hashes that only one of the sets has.
It never drops a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, saved, table
from .kernels import mix, shingle_sets

COORDS, ROWS = 96, 4
#: Rounds of stars before the rest is compared pair by pair.
STARS = 3
#: Pairs of a star that one task confirms, about; it gets the centre's text once.
MEETS = 2000
#: 64-bit words of a set's parity bitmap.
WORDS = 8


def sketch(u: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit hashes (not empty)."""
    out = np.full(coords, np.iinfo(np.uint64).max, np.uint64)
    for i in range(2 * coords):
        x = mix(u + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (x & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
        if i < coords:
            at = ((x >> np.uint64(32)) * np.uint64(coords)) >> np.uint64(32)
            np.minimum.at(out, at.astype(np.intp), value)
        else:
            out[i - coords] = min(out[i - coords], value.min())
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


def bands(s: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = s.reshape(-1, rows)
    h = mix(np.arange(len(parts), dtype=np.uint64) + np.uint64(1))
    for c in range(rows):
        h = mix(h ^ parts[:, c] * np.uint64(0xD6E8FEB86659FD93))
    return h.view(np.int64)


def parities(u: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Whether each of 64 * words bins holds an odd number of the hashes, as bits."""
    at = mix(u ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(64 * words)
    odd = (np.bincount(at.astype(np.intp), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def may_link(n: Column, bits: Column, other_n: Column, other_bits: Column, percent: int) -> Column:
    """False only for two sets that cannot link, by their sizes and parity bitmaps."""
    apart = sum((F.bit_count(bits[i].bitwiseXOR(other_bits[i])) for i in range(1, WORDS)), F.bit_count(bits[0].bitwiseXOR(other_bits[0])))
    sizes = 100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)
    return sizes & ((100 + percent) * apart <= (100 - percent) * (n + other_n))


def _sketched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, band, bits = [], [], [], []
            for u in shingle_sets(b["text"], k):
                n.append(len(u))
                digest.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
                band.append(bands(sketch(u)) if len(u) else None)
                bits.append(parities(u) if len(u) else None)
            yield pa.RecordBatch.from_arrays([b["key"], b["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["key", "doc_id", "n_shingles", "digest", "bands", "bits"])

    return run


def _overlaps(k: int):
    """Sorted (a, part, b, text): the text of a centre, without b, comes before those that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = None
        for batch in batches:
            a, b, out = batch["a"].to_pylist(), batch["b"].to_pylist(), []
            for i, v in enumerate(shingle_sets(batch["text"], k)):
                if b[i] is None:
                    u = v
                    continue
                big, small = (u, v) if len(u) >= len(v) else (v, u)
                at = np.minimum(np.searchsorted(big, small), max(len(big) - 1, 0))
                out.append((a[i], b[i], len(u), len(v), int((big[at] == small).sum()) if len(small) else 0))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "n_a", "n_b", "common"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, d, linked) of pairs (a, b) of keys of ``texts`` (key, text) from the full shingle sets; d the Jaccard distance.
    A centre with more than MEETS pairs is dealt to several tasks."""
    hot = pairs.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") > MEETS).select("a", F.ceil(F.col("m") / MEETS).alias("parts"))
    dealt = pairs.select("a", "b").join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    members = dealt.join(texts.select(F.col("key").alias("b"), "text"), "b").select("a", "part", "b", "text")
    centres = dealt.select("a", "part").distinct().join(texts.select(F.col("key").alias("a"), "text"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    both = members.unionByName(centres).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    got = both.select("a", "b", "text").mapInArrow(_overlaps(k), "a long, b long, n_a long, n_b long, common long")
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return got.select("a", "b", (1 - F.col("common") / union).alias("d"), (100 * F.col("common") >= percent * union).alias("linked"))


def _shingled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b["text"], k))
            rows = np.repeat(np.arange(len(sets)), [len(u) for u in sets])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(rows, pa.int64())), pa.array(flat.view(np.int64), pa.int64())], ["rep", "shingle"])

    return run


def _prefix_pairs(left: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (rep, n, component, bits) of different components that share a prefix shingle and may link."""
    left = saved(left, "left")
    every = saved(texts.join(left.select(F.col("rep").alias("key")), "key", "left_semi").select("key", "text").mapInArrow(_shingled(k), "rep long, shingle long"), "shingles")
    common = every.groupBy("shingle").agg(F.count("*").alias("m")).filter("m > 1")
    shared = every.join(common, "shingle").join(left.drop("bits"), "rep")
    # shingles of one document alone come first in its order and meet nothing
    own = Window.partitionBy("rep")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.count("*").over(own))
    placed = shared.withColumns({"place": F.row_number().over(own.orderBy("m", "shingle")), "room": prefix, "alone": F.col("n") - F.count("*").over(own)})
    first = placed.filter("place <= room").select("rep", "n", "component", "shingle", (F.col("n") - F.col("alone") - F.col("place")).alias("after"))
    first = saved(first, "prefixes")
    mixed = first.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("shingle")
    first = first.join(mixed, "shingle").join(left.select("rep", "bits"), "rep")
    x, y = (first.select("shingle", *(F.col(c).alias(p + c) for c in ("rep", "n", "component", "after", "bits"))) for p in "xy")
    # of the first shingle that two sets share: they can share it and what comes after it, no more
    enough = (100 + percent) * (1 + F.least("xafter", "yafter")) >= percent * (F.col("xn") + F.col("yn"))
    near = enough & (F.col("xrep") < F.col("yrep")) & (F.col("xcomponent") != F.col("ycomponent")) & may_link(F.col("xn"), F.col("xbits"), F.col("yn"), F.col("ybits"), percent)
    return x.join(y, "shingle").filter(near).select(F.col("xrep").alias("a"), F.col("yrep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text): doc_id, n_shingles, component_id, kept.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of
    k-word shingles. Null or empty texts have empty sets and link with nothing; a null
    doc_id links with nothing and is kept, with a null component. Repeated rows get the
    same result; a doc_id with several texts is one document, linked by each of them, with the
    n_shingles of each row's own text. Texts of any length count whole; ties at the threshold link;
    an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    sk = saved(docs.mapInArrow(_sketched(k), "key long, doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"), "sketches")
    full = sk.filter("doc_id IS NOT NULL AND n_shingles > 0")
    reps = saved(full.groupBy("digest").agg(F.min("key").alias("rep"), F.min("doc_id").alias("low")), "classes")
    several = full.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.max("digest").alias("other")).filter("digest <> other").select("doc_id")
    same = full.select("doc_id", "digest").join(several, "doc_id").join(reps, "digest").select("doc_id", "rep").distinct()
    same = saved(same.join(same.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b")), "same")
    heads = full.join(reps, (full.digest == reps.digest) & (full.key == reps.rep), "left_semi")
    rows = heads.select(F.col("key").alias("rep"), F.col("n_shingles").alias("n"), "bits", F.explode("bands").alias("key")).dropDuplicates(["rep", "key"])
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    members = saved(rows.join(shared, "key"), "members")
    texts = saved(docs.join(members.select(F.col("rep").alias("key")).distinct(), "key", "left_semi").select("key", "text").dropDuplicates(["key"]), "candidates")
    nodes = members.select(F.col("rep").alias("id")).union(same.select("a")).union(same.select("b")).distinct()

    def labelled(links: DataFrame) -> DataFrame:
        found = components(links)
        return saved(nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels")

    tried, labels = None, labelled(same) if same.limit(1).count() else saved(nodes.withColumn("component", F.col("id")), "labels")
    for turn in range(STARS + 1):
        m = members.join(labels.withColumnRenamed("id", "rep"), "rep")
        mixed = m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("rep", F.struct(F.xxhash64("rep", F.lit(turn)), "rep")).alias("centre"), F.min_by(F.struct("n", "bits"), F.struct(F.xxhash64("rep", F.lit(turn)), "rep")).alias("of")).filter("lo < hi")
        m = m.join(mixed.select("key", "centre", "of"), "key")
        home = labels.select(F.col("id").alias("centre"), F.col("component").alias("home"))
        m = m.join(home, "centre")
        if turn < STARS:
            near = may_link(F.col("n"), F.col("bits"), F.col("of.n"), F.col("of.bits"), percent)
            pairs = m.filter("component <> home").filter(near).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
        else:
            pairs = _prefix_pairs(m.select("rep", "n", "component", "bits").dropDuplicates(["rep"]), texts, k, percent)
        if tried is not None:
            done = tried.select("a", "b").union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")  # few: those of different components only
        if not pairs.limit(1).count():
            if turn < STARS:
                continue
            break
        new = saved(verify(pairs, texts, k, percent), "checked")
        tried = new if tried is None else tried.union(new)
        labels = labelled(tried.filter("linked").select("a", "b").union(same))

    # components are named by keys; their documents' least id is theirs
    named = labels.select(F.col("id").alias("rep"), "component").join(reps.select("rep", "low"), "rep")
    least = named.groupBy("component").agg(F.min("low").alias("linked"))
    named = named.select("rep", "component").join(least, "component").select("rep", "linked")
    discard(members, texts)
    out = sk.join(reps, "digest", "left").join(named, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("linked", "low", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
