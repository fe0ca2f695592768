"""Alignment of the tokens of two tokenizers, counted in dense matrices striped by token id.

One pass encodes every text both ways and keeps, per document, what only the document
decides: its token counts, groups and links (an A and a B token whose byte ranges end
together), the latter as distinct pairs with their number. Pairs are counted by stripes
of B ids (id modulo ``STRIPES``, so frequent ids, which lie side by side, spread): tasks
add up what they have read before anything moves, and each stripe adds the sums to one
dense matrix of its B ids by all A ids (``np.add.at``); a row's maximum is the best count
of that B id. Then the links of the documents go to the stripe they belong to, where
the same matrix stands: a link's count and whether it is the best are two reads of it.
Only a matrix is in memory, links stream past it; a stripe with more than ``TASK_LINKS``
links is dealt to several tasks, each with the matrix of its own.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved, table
from .packing import _PLAIN

#: Stripes of B ids: a matrix has 1 / STRIPES of the B ids as rows (100 MB for 32,000 and 50,257 ids).
STRIPES = 128
#: Links of a stripe that one task scores, about.
TASK_LINKS = 4_000_000
#: Bytes of text encoded at once (a longer text alone), and distinct pairs or links that a task gathers before it passes them on.
CHUNK_BYTES, GATHERED = 1 << 20, 1 << 20

_loaded: dict[tuple[str, str | None, str], tuple] = {}


def _byte_level() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Pair:
    """The two tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, a: str, ranks: str | None, b: str):
        import public_tokenizers
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(a))
        self.slow.encode_special_tokens = True
        self.quick = None
        if ranks:
            import base64

            import tiktoken

            with open(public_tokenizers.path(ranks), "rb") as f:
                held = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens={})
        self.sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        shown = _byte_level()
        self.a_bytes = [b""] * self.slow.get_vocab_size()
        for entry, i in self.slow.get_vocab().items():
            self.a_bytes[i] = bytes(map(shown.__getitem__, entry)) if all(c in shown for c in entry) else entry.encode()
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # what an id prints as: A before another A or before |, B before another B or before ;
        self.shown = [b"%d%s" % (i, end) for i in range(len(self.a_bytes)) for end in (b",", b"|")] + [b"%d%s" % (i, end) for i in range(len(self.b_bytes)) for end in (b",", b";")]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space + text by A (the rank file where it is known to agree), of text by B."""
        a: list = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if self.quick is None or _PLAIN.search(t):
                slow.append(i)
            else:
                a[i] = self.quick.encode_ordinary(" " + t)
        for i, e in zip(slow, self.slow.encode_batch([" " + texts[i] for i in slow], add_special_tokens=False), strict=True):
            a[i] = e.ids
        return a, self.sp.encode(texts, num_threads=1)


def _pair(*names) -> Pair:
    if names not in _loaded:
        _loaded[names] = Pair(*names)
    return _loaded[names]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array(list(map(len, ids)), np.int64)
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum())), n


def aligned(pair: Pair, texts: list[str | None]) -> dict[str, list | np.ndarray]:
    """Of each text n_a, n_b, n_groups, groups_sha256; of all the links (doc, a, b), in the order of the texts."""
    n, digests = len(texts), [""] * len(texts)
    at = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = pair.encode([texts[i] for i in at])
    fine = []
    for k, i in enumerate(at):
        whole = b" " + texts[i].encode()
        if b"".join(map(pair.a_bytes.__getitem__, ids_a[k])) == whole and b"".join(map(pair.b_bytes.__getitem__, ids_b[k])) == whole:
            fine.append(k)
    a, n_a = _flat([ids_a[k] for k in fine])
    b, n_b = _flat([ids_b[k] for k in fine])
    del ids_a, ids_b
    at = np.array([at[k] for k in fine], np.int64)
    # every text has as many bytes by A as by B, so offsets may run through all of them
    end_a, end_b = np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b])
    stands = np.zeros((2, int(end_a[-1]) + 1 if len(a) else 1), bool)
    stands[0, end_a], stands[1, end_b] = True, True
    last_a, last_b = stands[1, end_a], stands[0, end_b]
    i, j = np.flatnonzero(last_a), np.flatnonzero(last_b)  # the tokens that end the groups
    doc = np.searchsorted(np.cumsum(n_a), i, "right")
    before_a, before_b = np.concatenate([[0], i + 1]), np.concatenate([[0], j + 1])  # tokens before each group
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + before_b[np.cumsum(last_a) - last_a]] = 2 * a + last_a
    order[np.arange(len(b)) + before_a[np.cumsum(last_b) - last_b + 1]] = 2 * (len(pair.a_bytes) + b) + last_b
    cut = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    for k, i_doc in enumerate(at.tolist()):
        digests[i_doc] = hashlib.sha256(b"".join(map(pair.shown.__getitem__, order[cut[k] : cut[k + 1]].tolist()))[:-1]).hexdigest()
    out: dict = {"groups_sha256": digests, "doc": at[doc], "a": a[i], "b": b[j]}
    for name, count in (("n_a", n_a), ("n_b", n_b), ("n_groups", np.bincount(doc, minlength=len(at)))):
        out[name] = np.zeros(n, np.int64)
        out[name][at] = count
    return out


class Codes:
    """Pairs as one number: stripe (B id modulo STRIPES), row (B id by STRIPES), A id."""

    def __init__(self, n_a: int, n_b: int):
        self.width, self.rows = n_a, -(-n_b // STRIPES)
        self.cells = self.width * self.rows
        self.kind = np.dtype("<u4" if STRIPES * self.cells <= 1 << 32 else "<u8")

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b % STRIPES) * self.cells + (b // STRIPES) * self.width + a

    def read(self, blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, self.kind)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the length."""
    return np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _encoded(names: tuple, codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*names)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            chunk = np.cumsum(sizes) // CHUNK_BYTES
            cuts = _runs(chunk)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                got = aligned(pair, part["text"].to_pylist())
                code = codes.of(got["a"], got["b"])
                both, times = np.unique((got["doc"].astype(np.uint64) << np.uint64(40)) | code.astype(np.uint64), return_counts=True)
                ends = np.searchsorted(both, np.arange(1, hi - lo + 1).astype(np.uint64) << np.uint64(40))
                code = (both & np.uint64((1 << 40) - 1)).astype(codes.kind)
                times = times.astype("<u4")
                starts = np.concatenate([[0], ends[:-1]])
                spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part["key"], part["doc_id"], *(pa.array(got[k], pa.int64()) for k in ("n_a", "n_b", "n_groups")), pa.array(got["groups_sha256"]), pa.array([code[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([times[x:y].tobytes() for x, y in spans], pa.binary())],
                    ["key", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "times"],
                )

    return run


def _partial(codes: Codes):
    """What a task has read of each stripe: distinct pairs and their numbers."""

    def merged(held):
        code, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        times = np.zeros(len(code), np.int64)
        np.add.at(times, where, np.concatenate([t for _, t in held]).astype(np.int64))
        return code, times

    def sent(code, times):
        stripe = code // codes.cells
        cuts = _runs(stripe)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array([int(stripe[x]) for x, _ in spans], pa.int32()), pa.array([code[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([times[x:y].tobytes() for x, y in spans], pa.binary())], ["stripe", "codes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for c, t in zip(batch["codes"], batch["times"], strict=True):
                held.append((codes.read(c.as_py()), np.frombuffer(t.as_py(), "<u4")))
                n += len(held[-1][0])
                if n > 2 * GATHERED:
                    held = [merged(held)]
                    n = len(held[0][0])
                    if n > GATHERED:
                        yield sent(*held[0])
                        held, n = [], 0
        if n:
            yield sent(*merged(held))

    return run


def _counted(codes: Codes):
    """Rows of a stripe stand together: one dense matrix at a time, of which the cells that are not 0 go out."""

    def sent(stripe, dense):
        cells = np.flatnonzero(dense)
        for s in range(0, len(cells), GATHERED):
            part = cells[s : s + GATHERED]
            yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([(part + stripe * codes.cells).astype(codes.kind).tobytes()], pa.binary()), pa.array([dense[part].tobytes()], pa.binary()), pa.array([int(dense[part].sum())], pa.int64())], ["stripe", "codes", "counts", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dense = None, np.zeros(codes.cells, np.int64)
        for batch in batches:
            for s, c, t in zip(batch["stripe"].to_pylist(), batch["codes"], batch["counts"], strict=True):
                if s != now:
                    if now is not None:
                        yield from sent(now, dense)
                        dense[:] = 0
                    now = s
                np.add.at(dense, codes.read(c.as_py()).astype(np.int64) - s * codes.cells, np.frombuffer(t.as_py(), "<i8"))
        if now is not None:
            yield from sent(now, dense)

    return run


_DEALT = ["stripe", "block", "kind", "docs", "runs", "codes", "times"]


def _dealt(codes: Codes):
    """The links of a run of documents by stripe: documents, links of each, pairs and their numbers."""

    def sent(held):
        doc = np.repeat(np.array([k for k, _, _ in held], np.int64), [len(c) for _, c, _ in held])
        code = np.concatenate([c for _, c, _ in held])
        times = np.concatenate([t for _, _, t in held])
        stripe = (code // codes.cells).astype(np.int16)
        order = np.argsort(stripe, kind="stable")
        doc, code, times, stripe = doc[order], code[order], times[order], stripe[order]
        cuts = _runs(stripe)
        cols: list[list] = [[] for _ in _DEALT]
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            r = _runs(doc[x:y])
            for col, v in zip(cols, (int(stripe[x]), held[0][0], 1, doc[x:y][r[:-1]].tobytes(), np.diff(r).astype("<u4").tobytes(), code[x:y].tobytes(), times[x:y].tobytes()), strict=True):
                col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], _DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for k, c, t in zip(batch["key"].to_pylist(), batch["codes"], batch["times"], strict=True):
                code = codes.read(c.as_py())
                if len(code):
                    held.append((k, code, np.frombuffer(t.as_py(), "<u4")))
                    n += len(code)
                if n > GATHERED:
                    yield sent(held)
                    held, n = [], 0
        if held:
            yield sent(held)

    return run


def _scored(codes: Codes):
    """The counts of a stripe come first, as its matrix; then its links, whose documents get their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dense, best = None, np.zeros(codes.cells, np.int64), None
        for batch in batches:
            rows = []
            for s, block, kind, docs, runs, code, times in zip(*(batch[k] for k in _DEALT), strict=True):
                s = s.as_py()
                if s != now:
                    dense[:] = 0
                    now, best = s, None
                at = codes.read(code.as_py()).astype(np.int64) - s * codes.cells
                if kind.as_py() == 0:
                    dense[at] = np.frombuffer(times.as_py(), "<i8")
                    continue
                if best is None:
                    best = dense.reshape(codes.rows, codes.width).max(axis=1)
                n, t = dense[at], np.frombuffer(times.as_py(), "<u4").astype(np.int64)
                starts = np.cumsum(r := np.frombuffer(runs.as_py(), "<u4").astype(np.int64)) - r
                rows.append((block.as_py(), docs.as_py(), np.add.reduceat(t * (n == best[at // codes.width]), starts).tobytes(), np.add.reduceat(t * n, starts).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 3))], ["block", "docs", "n_best", "count_sum"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block stand together: sums of its documents over the stripes."""

    def sent(held):
        docs, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sums = np.zeros((2, len(docs)), np.int64)
        for k in (0, 1):
            np.add.at(sums[k], where, np.concatenate([h[k + 1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(sums[0]), pa.array(sums[1])], ["key", "n_best", "count_sum"])

    now, held = None, []
    for batch in batches:
        for block, *cols in zip(batch["block"].to_pylist(), *(batch[k] for k in ("docs", "n_best", "count_sum")), strict=True):
            if block != now and held:
                yield sent(held)
                held = []
            now = block
            held.append([np.frombuffer(c.as_py(), "<i8") for c in cols])
    if held:
        yield sent(held)


def token_alignment(docs: DataFrame, a: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` is a byte-level vocabulary that encodes space + text, ``b`` a piece model that puts the space there itself;
    ``ranks`` may name the rank file of ``a`` (faster on Latin texts, same ids). Links, counts and the digest are those of
    the module. Null and empty texts, and those that do not come back whole from either side's tokens, have zeros and an
    empty digest. Texts of any length are encoded whole, each in one piece. Every token has a byte at least, so a place
    where both end is one link and ``n_links`` equals ``n_groups``. Best counts may tie: all links that have them are best.
    Repeated rows count as often as they stand and stay rows of their own, null ids too; other columns are ignored; an
    empty table gives an empty result.
    """
    pair = _pair(a, ranks, b)
    codes = Codes(len(pair.a_bytes), len(pair.b_bytes))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = saved(rows.mapInArrow(_encoded((a, ranks, b), codes), "key long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, codes binary, times binary"), "aligned")
    sums = docs.select("codes", "times").mapInArrow(_partial(codes), "stripe int, codes binary, counts binary")
    counts = saved(sums.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_counted(codes), "stripe int, codes binary, counts binary, links long"), "counts")
    tasks = counts.groupBy("stripe").agg(F.ceil(F.sum("links") / TASK_LINKS).cast("int").alias("tasks"))  # a row a stripe
    links = docs.select("key", "codes", "times").mapInArrow(_dealt(codes), "stripe int, block long, kind int, docs binary, runs binary, codes binary, times binary")
    links = links.join(F.broadcast(tasks), "stripe").withColumn("task", F.pmod(F.xxhash64("block"), F.col("tasks")).cast("int"))
    held = counts.join(F.broadcast(tasks), "stripe").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    none = F.lit(None).cast("binary")
    held = held.select("stripe", F.lit(0).cast("long").alias("block"), F.lit(0).alias("kind"), none.alias("docs"), none.alias("runs"), "codes", F.col("counts").alias("times"), "task")
    meets = links.select(*_DEALT, "task").unionByName(held).repartition("stripe", "task").sortWithinPartitions("stripe", "task", "kind").select(*_DEALT)
    parts = meets.mapInArrow(_scored(codes), "block long, docs binary, n_best binary, count_sum binary")
    found = saved(parts.repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "key long, n_best long, count_sum long"), "sums")
    discard(counts)
    out = docs.join(found, "key", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))
