"""Offline comparison of rankings: rubric, variants, folds, what they choose, and whether the gain is clear."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrid.shared import discard, saved

from .alerts import bootstrap_mean
from .evaluate import ndcg, spearman
from .learned import weights_of
from .running import numbered
from .scoring import W_SEMANTIC, W_SKILL, linear_fit

# Fixed values of the rubric, of fitting and of verdicts.
STRONG_SHARE, PARTIAL_SHARE, WEAK_SHARE = 0.8, 0.5, 0.25
PRIOR_SKILL, PRIOR_STRENGTH, MIN_ROWS, MIN_PER_LABEL, RIDGE = round(W_SKILL / (W_SKILL + W_SEMANTIC), 2), 20.0, 30, 5, 1e-3
MIN_SESSIONS, TIE = 20, 1e-9


def grade(relation: Column, share: Column) -> Column:
    """Grade 0 to 3 of a pair from its families' relation (same, adjacent, unrelated) and the share of required skills."""
    bucket = F.when(share >= STRONG_SHARE, 3).when(share >= PARTIAL_SHARE, 2).when(share >= WEAK_SHARE, 1).otherwise(0)
    return F.when(relation == "same", bucket).when(relation == "adjacent", F.greatest(bucket - 1, F.lit(0))).otherwise(F.when(bucket == 3, 1).otherwise(0))


def by_variant(pairs: DataFrame, variants: DataFrame, score: Column, grade_: str) -> DataFrame:
    """NDCG and Spearman of each variant for each candidate: pairs (candidate_id, vacancy_id, grade) scored once a variant
    (a small table: variant and its parameters), by one plan. The pairs are kept once, as four branches read them."""
    df = saved(pairs, "pairs").crossJoin(F.broadcast(variants)).withColumns({"__score": score, "__key": F.concat_ws("|", "variant", "candidate_id")})
    gains = ndcg(df, "__key", [F.desc_nulls_last("__score"), F.asc("vacancy_id")], grade_)
    ranks = spearman(df, "__key", "__score", grade_)
    keys = df.select("__key", "variant", "candidate_id").distinct()
    return keys.join(gains, "__key").join(ranks, "__key").select("variant", "candidate_id", "ndcg", "spearman", "n")


def tuned(results: DataFrame, folds: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """Held-out results and the variant that each fold chose: the one with the best mean Spearman on the other folds'
    candidates, of equals the first by ``order``. Folds: candidate_id, fold."""
    df = results.join(folds, "candidate_id")
    sums = df.groupBy("variant", "fold").agg(F.sum("spearman").alias("s"), F.count("spearman").alias("n"))
    all_ = Window.partitionBy("variant")
    rest = sums.withColumn("train", F.try_divide(F.sum("s").over(all_) - F.coalesce("s", F.lit(0.0)), F.sum("n").over(all_) - F.col("n")))
    best = Window.partitionBy("fold").orderBy(F.desc_nulls_last(F.round("train", 12)), order)
    chosen = rest.withColumn("__n", F.row_number().over(best)).filter("__n = 1").select("fold", "variant")
    return df.join(F.broadcast(chosen), ["fold", "variant"]), chosen


def compared(results: DataFrame, base: str, other: str) -> DataFrame:
    """One row a candidate with the difference of two variants' Spearman, where both are defined."""
    a, b = (results.filter(F.col("variant") == v).select("candidate_id", F.col("spearman").alias(n)) for v, n in ((base, "a"), (other, "b")))
    return a.join(b, "candidate_id").select("candidate_id", (F.col("b") - F.col("a")).alias("difference")).filter("difference IS NOT NULL")


def decision(low: float | None, chosen: list[str]) -> dict:
    """Change only for a gain whose interval is above zero; else keep what there is."""
    winner = max(dict.fromkeys(chosen), key=chosen.count)
    change = low is not None and low > 0
    return {"recommendation": f"change to {winner}" if change else "keep current", "most_chosen": winner, "folds_choosing_it": chosen.count(winner), "folds": len(chosen)}


def verdict(low: Column, high: Column, sessions: Column) -> Column:
    return F.when(sessions < MIN_SESSIONS, "inconclusive").when(low > 0, "learned_better").when(high < 0, "linear_better").otherwise("inconclusive")


def session_ranks(rows: DataFrame, fit: Column) -> DataFrame:
    """Rated cards (session, vacancy_id, band_rank, label) in the order a user would have seen; sessions without a useful
    card do not count."""
    df = rows.withColumn("__fit", fit)
    useful = df.groupBy("session").agg(F.sum("label").alias("useful")).filter("useful > 0").select("session")
    order = Window.partitionBy("session").orderBy(F.coalesce("band_rank", F.lit(0)), F.desc_nulls_last("__fit"), "vacancy_id")
    return df.join(useful, "session", "left_semi").withColumn("place", F.row_number().over(order)).drop("__fit")


WEIGHTS = np.arange(101) / 100
_SUMS = ("g0", "g1", "h00", "h01", "h11", "loss")


def _sums_at(at: dict[int, np.ndarray], last: bool):
    """Gradients and Hessians, or at the end the log loss, of a task's rows for every model and weight, ``at`` being intercepts and slopes of each
    weight. A model is named by the fold that it does not see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((len(_SUMS), len(WEIGHTS))) for k in at}
        for b in batches:
            fold, skill, semantic, y = (b[c].to_numpy() for c in ("fold", "skill", "semantic", "label"))
            for s in range(0, len(y), 4096):
                part = slice(s, s + 4096)
                for k, ab in at.items():
                    seen = fold[part] != k
                    x = skill[part][seen, None] * WEIGHTS + semantic[part][seen, None] * (1 - WEIGHTS)
                    z, label = ab[:, 0] + ab[:, 1] * x, y[part][seen, None]
                    if last:
                        total[k][-1] += (np.logaddexp(0, z) - label * z).sum(0)
                        continue
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    r, q = p - label, p * (1 - p)
                    qx = q * x
                    total[k][:-1] += np.stack([r.sum(0), np.einsum("ij,ij->j", r, x), q.sum(0), qx.sum(0), np.einsum("ij,ij->j", qx, x)])
        for k, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(WEIGHTS), pa.int32()), pa.array(range(len(WEIGHTS)), pa.int32()), *map(pa.array, sums)], ["model", "at", *_SUMS])

    return run


def _fits(used: DataFrame, models: dict[int, float]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Slopes, never below 0, and log losses of each model (with its share of good labels) for each weight: Newton's method on sums,
    a row of six numbers a model and weight each round, whatever the number of rows. A small ridge holds the slope."""
    base = {k: math.log(share / (1 - share)) for k, share in models.items()}
    at = {k: np.column_stack([np.full(len(WEIGHTS), b), np.zeros(len(WEIGHTS))]) for k, b in base.items()}

    def sums(last: bool = False) -> dict[int, np.ndarray]:
        rows = used.mapInArrow(_sums_at(at, last), "model int, at int, " + ", ".join(f"{c} double" for c in _SUMS)).groupBy("model", "at").agg(*(F.sum(c).alias(c) for c in _SUMS)).collect()
        out = {k: np.zeros((len(_SUMS), len(WEIGHTS))) for k in at}
        for r in rows:
            out[r["model"]][:, r["at"]] = [r[c] for c in _SUMS]
        return out

    for _ in range(50 if models else 0):
        found, most = sums(), 0.0
        for k, (g0, g1, h00, h01, h11, _) in found.items():
            g1, h00, h11 = g1 + RIDGE * at[k][:, 1], h00 + 1e-12, h11 + RIDGE + 1e-12
            det = h00 * h11 - h01 * h01
            move = np.column_stack([(h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det])
            at[k] = at[k] - np.clip(move, -5, 5)
            most = max(most, float(np.abs(move).max()))
        if most < 1e-9:
            break
    for k in at:
        at[k][at[k][:, 1] < 0] = base[k], 0.0
    found = sums(last=True) if models else {}
    return {k: (at[k][:, 1], found[k][-1]) for k in at}


def skill_weights(rows: DataFrame, prior: float = PRIOR_SKILL, strength: float = PRIOR_STRENGTH, folds: int = 0) -> dict[int, tuple[float, float, float]]:
    """By model: the weight of skill against semantic, on a grid of hundredths, that explains labels best (skill, semantic, label,
    and ``fold`` if there are folds), its slope and its objective: log loss and ``strength`` times the squared distance from
    the prior. Rows without one of the three do not count. Model k is fitted on the rows that are not of fold k, model -1 on all; those
    with too few rows, or of one label, are left out."""
    fold = F.col("fold").cast("int") if folds else F.lit(-2)
    used = rows.select(fold.alias("fold"), *(F.col(c).cast("double").alias(c) for c in ("skill", "semantic", "label"))).dropna()
    used = saved(used.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism), "rated")  # read once a round, by all cores
    counts = {r["fold"]: (r["n"], r["good"]) for r in used.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()}
    models = {}
    for k in range(folds) if folds else (-1,):
        n, good = (sum(c[i] for f, c in counts.items() if f != k) for i in (0, 1))
        if n >= MIN_ROWS and min(good, n - good) >= MIN_PER_LABEL:
            models[k] = good / n
    out = {}
    for k, (slopes, losses) in _fits(used, models).items():
        objective = losses + strength * (WEIGHTS - prior) ** 2
        best = min(range(len(WEIGHTS)), key=lambda i: (round(objective[i], 9), abs(WEIGHTS[i] - prior)))
        out[k] = float(WEIGHTS[best]), float(slopes[best]), float(objective[best])
    discard(used)
    return out


def skill_weight(rows: DataFrame, prior: float = PRIOR_SKILL, strength: float = PRIOR_STRENGTH) -> DataFrame:
    """The weight (w, slope, objective) that ``skill_weights`` finds on all rows; no row where there are too few."""
    return rows.sparkSession.createDataFrame(list(skill_weights(rows, prior, strength).values()), "w double, slope double, objective double")


def compared_scorers(cards: DataFrame, folds: int = 5, k: int = 10, strength: float = PRIOR_STRENGTH, seed: int = 0) -> DataFrame:
    """The fixed weights against fitted ones on rated cards (session, vacancy_id, band_rank, label, skill, semantic), one row.

    Sessions are dealt to folds by a hash, as many to each; the cards of a fold are ranked with weights fitted on all others. NDCG
    and Spearman of a session are taken by either; sessions without a useful card are skipped, and so are folds whose
    training cards are too few. The verdict needs MIN_SESSIONS and a 95 % bootstrap interval of the mean difference that excludes 0.
    """
    sessions = cards.select("session").distinct()
    n = sessions.count()
    folds = max(2, min(folds, n))
    dealt = numbered(sessions, [], [F.xxhash64("session", F.lit(seed)), "session"]).select("session", ((F.col("place") - 1) % folds).cast("int").alias("fold"))
    cards = saved(cards.join(dealt, "session"), "cards")
    found = skill_weights(cards, strength=strength, folds=folds)
    none = F.lit(None).cast("double")
    fixed = linear_fit(F.col("skill"), F.col("semantic"), none)
    learned = none
    for f, (w, *_) in found.items():
        learned = F.when(F.col("fold") == f, linear_fit(F.col("skill"), F.col("semantic"), none, weights_of(w))).otherwise(learned)
    cards = cards.filter(F.col("fold").isin(list(found)))

    def of(fit: Column, name: str) -> DataFrame:
        df = session_ranks(cards, fit)
        both = ndcg(df, "session", [F.asc("place")], "label", k).join(spearman(df.withColumn("__up", -F.col("place")), "session", "__up", "label"), "session")
        return both.select("session", F.col("ndcg").alias(name), F.col("spearman").alias(f"{name}_spearman"))

    both = saved(of(fixed, "linear").join(of(learned, "learned"), "session").select("*", (F.col("learned") - F.col("linear")).alias("d"), F.lit(0).alias("all")), "scored")
    interval = bootstrap_mean(both, "all", "session", "d", seed=seed)
    means = [F.avg(c).alias(c) for c in ("linear", "learned", "linear_spearman", "learned_spearman")]
    df = both.agg(F.count("*").alias("sessions"), *means, F.avg("d").alias("difference"), F.count_if(F.col("d") > TIE).alias("wins"), F.count_if(F.abs("d") <= TIE).alias("ties"), F.count_if(F.col("d") < -TIE).alias("losses"))
    df = df.join(interval.select("low", "high"), how="left").withColumns({"folds": F.lit(folds), "skipped_folds": F.lit(folds - len(found)), "skipped_sessions": F.lit(n) - F.col("sessions")})
    return df.withColumns({"verdict": verdict(F.col("low"), F.col("high"), F.col("sessions")), "weights": F.array(*(F.lit(w) for w, *_ in found.values())).cast("array<double>")})
