"""Matching raw skills to concepts in tiers, and what belongs to it: cache keys, versions, recall, checked verdicts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize

# How many candidates a result keeps, and the codes whose results are not worth keeping.
MOST_CANDIDATES = 5
UNCACHEABLE = ("empty_skill", "no_candidates", "llm_unavailable", "index_unavailable", "llm_choice_not_in_candidates", "llm_item_missing", "llm_invalid_output")
VERSION_KEYS = ("model", "build", "taxonomy", "thresholds")
#: Products that are held at once, and values of queries and labels that a task holds before it gives them on.
PRODUCTS, HELD = 1 << 21, 1 << 22


def matched(asked: DataFrame, aliases: DataFrame, nearest: DataFrame, threshold: float | None = None, cache: DataFrame | None = None) -> DataFrame:
    """One row per row of ``asked`` (with ``raw``): norm, tier, concept_id, distance, candidates, warnings.

    Each normal form is matched once: from the ``cache`` (norm, concept_id, distance; a null concept was rejected); by
    exactly one alias (alias_norm, canonical_id), several being ambiguous; by its nearest concepts (norm, canonical_id,
    distance; one row a concept), taken if the first is within ``threshold``. What stays open is unmatched.
    """
    asked = asked.withColumn("norm", normalize(F.col("raw")))
    todo = asked.select("norm").filter("norm <> ''").distinct()
    none = F.array().cast("array<string>")
    hits = aliases.select(F.col("alias_norm").alias("norm"), "canonical_id").distinct().groupBy("norm").agg(F.array_sort(F.collect_set("canonical_id")).alias("exact"))
    near = nearest.groupBy("norm").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "canonical_id"))), 1, MOST_CANDIDATES).alias("near"))
    df = todo.join(hits, "norm", "left").join(near, "norm", "left")
    if cache is None:
        df = df.withColumns({"cached": F.lit(False), "c_id": F.lit(None).cast("string"), "c_distance": F.lit(None).cast("double")})
    else:
        df = df.join(cache.select("norm", F.lit(True).alias("cached"), F.col("concept_id").alias("c_id"), F.col("distance").alias("c_distance")), "norm", "left")
    exact, several = F.size("exact") == 1, F.size("exact") > 1
    first = F.get("near", 0)
    close = F.coalesce(first["distance"] <= (threshold if threshold is not None else -1.0), F.lit(False))
    cached = F.coalesce("cached", F.lit(False))
    ids = F.transform("near", lambda x: x["canonical_id"])

    def by_tier(cache_: Column, exact_: Column, several_: Column, near_: Column, open_: Column) -> Column:
        return F.when(cached, cache_).when(exact, exact_).when(several, several_).when(close, near_).otherwise(open_)

    null = F.lit(None)
    unsure = F.array_compact(F.array(F.when(F.col("near").isNull(), "no_candidates"), F.when(F.col("near").isNotNull() & F.lit(threshold is None), "no_vector_threshold"), F.when(F.col("near").isNotNull(), "llm_unavailable")))
    df = df.select(
        "norm",
        by_tier(F.when(F.col("c_id").isNotNull(), "cache").otherwise("unmatched"), F.lit("exact"), F.lit("unmatched"), F.lit("vector"), F.lit("unmatched")).alias("tier"),
        by_tier(F.col("c_id"), F.get("exact", 0), null, first["canonical_id"], null).alias("concept_id"),
        by_tier(F.col("c_distance"), F.lit(0.0), null, first["distance"], null).alias("distance"),
        by_tier(none, F.col("exact"), F.slice("exact", 1, MOST_CANDIDATES), ids, F.coalesce(ids, none)).alias("candidates"),
        by_tier(none, none, F.array(F.lit("ambiguous_alias"), F.lit("llm_unavailable")), none, unsure).alias("warnings"),
    )
    blank = F.col("norm") == ""
    out = asked.join(df, "norm", "left")
    return out.withColumns({"tier": F.when(blank, "unmatched").otherwise(F.col("tier")), "candidates": F.when(blank, none).otherwise(F.col("candidates")), "warnings": F.when(blank, F.array(F.lit("empty_skill"))).otherwise(F.col("warnings"))})


def is_cacheable(warnings: Column) -> Column:
    return ~F.arrays_overlap(warnings, F.array(*map(F.lit, UNCACHEABLE)))


def cache_key(index: str, prompt: str, norm: Column) -> Column:
    """Versions first, so that a new index or prompt never serves an old result."""
    return F.concat_ws("|", F.lit(index), F.lit(prompt), norm)


def index_version(meta: dict) -> str:
    """A short fingerprint of what an index was built from."""
    text = json.dumps({k: meta.get(k) for k in VERSION_KEYS}, sort_keys=True, ensure_ascii=False, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _by_dimension(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of each dimension and their vectors; null vectors and such with null components are in none."""
    off, values = lists.offsets.to_numpy(), lists.values
    holes = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    dims = np.where(lists.is_valid().to_numpy(zero_copy_only=False) & (holes[off[1:]] == holes[off[:-1]]), np.diff(off), -1)
    flat = values.to_numpy(zero_copy_only=False)
    return {int(d): (at := np.flatnonzero(dims == d), flat[off[at][:, None] + np.arange(d)]) for d in np.unique(dims[dims >= 0])}


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed in the order of the components as ``scoring.dot`` sums them."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[0])
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def best_products(q: np.ndarray, x: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each row of ``q`` the largest ``_dots`` with a row of ``x``, pairs in ``own`` (row of q, row of x) left out.

    A matrix product tells which pairs are within its rounding of the largest; those are summed again in order. NaN
    counts as the largest; -inf where no pair is left.
    """
    out, d = np.full(len(q), -np.inf), q.shape[1]
    small_q, small_x = (np.abs(m).max(1, initial=0) < 1e150 for m in (q, x))  # others take no part in the matrix product
    plain, q0 = np.flatnonzero(small_x), np.where(small_q[:, None], q, 0)
    slack = 4 * (d + 2) * np.finfo(float).eps * np.sqrt((q0 * q0).sum(1)) * np.sqrt((x[plain] ** 2).sum(1)).max(initial=0)
    place = np.full(len(x), -1)
    place[plain] = np.arange(len(plain))
    strip, part = max(1, PRODUCTS // max(len(plain), 1)), max(1, PRODUCTS // max(d, 1))
    for lo in range(0, len(q) if len(plain) else 0, strip):
        p = q0[lo : lo + strip] @ x[plain].T
        p[~small_q[lo : lo + strip]] = -np.inf
        here = (own[0] >= lo) & (own[0] < lo + strip) & small_x[own[1]]
        p[own[0][here] - lo, place[own[1][here]]] = -np.inf
        most = p.max(1)
        some = np.flatnonzero(most > -np.inf)
        i, j = np.nonzero(p[some] >= (most - slack[lo : lo + strip])[some, None])
        for s in range(0, len(i), part):
            a, b = lo + some[i[s : s + part]], plain[j[s : s + part]]
            np.maximum.at(out, a, _dots(q[a], x[b]))
    if not (small_q.all() and small_x.all()):
        with np.errstate(all="ignore"):
            for j in range(len(x)):
                rest = np.ones(len(q), bool) if not small_x[j] else ~small_q
                rest[own[0][own[1] == j]] = False
                out[rest] = np.maximum(out[rest], _dots(q[rest], x[j : j + 1]))
    return out


def _best_of_labels(queries: pa.Table):
    ids, dims = queries["query"].to_numpy(), _by_dimension(queries["q"].combine_chunks())
    many = len(ids)
    order = np.argsort(ids, kind="stable")

    def own(vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = (np.searchsorted(ids, vec, side, sorter=order) for side in ("left", "right"))
        n = hi - lo
        return order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(vec)), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def out(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            for label, (pairs, known, best) in held.items():
                at = np.flatnonzero(pairs)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([queries["query"].combine_chunks().take(rows), queries["expected"].combine_chunks().take(rows), pa.repeat(pa.scalar(label, kind), len(at)), pa.array(best[at], pa.float64(), mask=known[at] == 0)], ["query", "expected", "label", "s"])
            held.clear()

        for b in batches if many else ():
            codes = pc.dictionary_encode(b["label"], null_encoding="encode")
            vec, by, label_of = b["vec_id"].to_numpy(), _by_dimension(b["v"]), codes.indices.to_numpy()
            for code, label in enumerate(codes.dictionary.to_pylist()):
                pairs, known, best = held.setdefault(label, (np.zeros(many, np.int64), np.zeros(many, np.int64), np.full(many, -np.inf)))
                rows = np.flatnonzero(label_of == code)
                pairs += len(rows) - np.bincount(own(vec[rows])[0], minlength=many)
                for d in dims.keys() & by.keys():
                    (mine, q), (at, x) = dims[d], by[d]
                    pick = label_of[at] == code
                    place = np.full(many, -1)
                    place[mine] = np.arange(len(mine))
                    i, j = own(vec[at[pick]])
                    i, j = place[i[place[i] >= 0]], j[place[i] >= 0]
                    known[mine] += np.count_nonzero(pick) - np.bincount(i, minlength=len(mine))
                    best[mine] = np.maximum(best[mine], best_products(q, x[pick], (i, j)))
                if len(held) * many > HELD:
                    yield from out(b["label"].type)
        if held:
            yield from out(b["label"].type)

    return run


#: Queries and vectors that one task multiplies: their blocks hold about so many bytes of components.
QUERY_BYTES, VECTOR_BYTES = 4 << 20, 32 << 20


def _blocks(df: DataFrame, vector: str, most: int) -> int:
    """In how many blocks of about ``most`` bytes the vectors go."""
    held = df.agg(F.coalesce(F.sum(16 + 8 * F.size(vector).cast("long")), F.lit(0))).first()[0]
    return 1 + held // most


def best_of_labels(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The largest product of each query (query, expected, q) with a vector (vec_id, label, v) of each label, itself left
    out: query, expected, label, s. Every pair counts. Products are NULL where a vector or a component is, or where
    dimensions differ. Queries and vectors are dealt to blocks of bounded bytes, and each pair of blocks is a task that keeps the
    largest product a query and label: neither side is collected or broadcast, whatever its size.
    """
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *vectors.schema]}
    asked = queries.select("query", "expected", F.col("q").cast("array<double>")).filter("query IS NOT NULL")
    known = vectors.select("vec_id", "label", F.col("v").cast("array<double>")).filter("vec_id IS NOT NULL")
    n_q, n_v = _blocks(asked, "q", QUERY_BYTES), _blocks(known, "v", VECTOR_BYTES)
    n_v = max(n_v, vectors.sparkSession.sparkContext.defaultParallelism // n_q)
    # by all columns, so that rows of one id spread too
    asked = asked.withColumns({"__q": F.pmod(F.xxhash64(*asked.columns), F.lit(n_q)), "__v": F.explode(F.sequence(F.lit(0), F.lit(n_v - 1)).cast("array<bigint>"))})
    known = known.withColumns({"__v": F.pmod(F.xxhash64(*known.columns), F.lit(n_v)), "__q": F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<bigint>"))})

    def met(key, mine, theirs):
        found = list(_best_of_labels(mine)(iter(theirs.combine_chunks().to_batches())))
        if found:
            return pa.Table.from_batches(found)
        return pa.table([pa.array([], mine["query"].type), pa.array([], mine["expected"].type), pa.array([], theirs["label"].type), pa.array([], pa.float64())], names=["query", "expected", "label", "s"])

    best = asked.groupBy("__q", "__v").cogroup(known.groupBy("__q", "__v")).applyInArrow(met, f"query {kind['query']}, expected {kind['expected']}, label {kind['label']}, s double")
    return best.groupBy("query", "expected", "label").agg(F.max("s").alias("s"))


def recall_at(outcomes: DataFrame, k: int) -> Column:
    """Share of queries (place of the expected answer, NULL if it is not there) answered among the first ``k``."""
    return F.try_divide(F.count_if(F.col("place") <= k).cast("double"), F.count("*"))


def checked_verdicts(verdicts: DataFrame, known: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The first verdict (by, pos, path, verdict) on each known path (by, path); and counts of those dropped and paths left."""
    df = verdicts.withColumn("path", F.trim("path")).join(known.select(by, "path", F.lit(True).alias("__known")), [by, "path"], "left")
    df = df.withColumn("__n", F.row_number().over(Window.partitionBy(by, "path").orderBy("pos")))
    kept = df.filter("__known AND __n = 1").drop("__known", "__n")
    dropped = df.groupBy(by).agg(F.count_if(F.col("__known").isNull()).alias("unknown"), F.count_if(F.col("__known") & (F.col("__n") > 1)).alias("duplicates"))
    left = known.join(kept.select(by, "path"), [by, "path"], "left_anti").groupBy(by).agg(F.count("*").alias("unjudged"))
    return kept, dropped.join(left, by, "full").na.fill(0, ["unknown", "duplicates", "unjudged"])


def migration_states(files: DataFrame, log: DataFrame) -> DataFrame:
    """State of each version: applied, changed (another checksum), pending, or missing (applied, but no file)."""
    df = files.select("version", "name", "checksum").join(log.select("version", F.col("name").alias("__name"), F.col("checksum").alias("__sum")), "version", "full")
    state = F.when(F.col("checksum").isNull(), "missing").when(F.col("__sum").isNull(), "pending").when(F.col("checksum") == F.col("__sum"), "applied").otherwise("changed")
    return df.select("version", F.coalesce("name", "__name").alias("name"), state.alias("state"))


def with_skills(candidates: DataFrame, added: DataFrame, removed: DataFrame, most: int = 20, longest: int = 60) -> DataFrame:
    """Candidates (candidate_id, keys) with the first ``most`` added keys (candidate_id, pos, key) and without removed ones."""
    w = Window.partitionBy("candidate_id").orderBy("pos")
    new = added.filter(F.length(F.col("key").cast("string")) <= longest).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).groupBy("candidate_id").agg(F.collect_set("key").alias("__add"))
    gone = removed.groupBy("candidate_id").agg(F.collect_set("key").alias("__gone"))
    kind = candidates.schema["keys"].dataType
    none = F.array().cast(kind)
    df = candidates.join(new, "candidate_id", "left").join(gone, "candidate_id", "left")
    keys = F.array_union(F.array_except("keys", F.coalesce("__gone", none)), F.coalesce("__add", none))
    return df.withColumn("keys", keys).drop("__add", "__gone")
