"""Similarity of a candidate's texts to vacancies: comparable or not, best text, calibrated score.

Vectors are unit length, so a dot product is the cosine. Wherever vectors cannot be compared the score is NULL and a
code says why, in a fixed order of reasons.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import calibrated, dot

# Reasons why a pair has no score, first match wins; and what an uncalibrated score carries.
PROBLEMS = ("no_candidate_text", "no_vacancy_embedding", "stale_vacancy_embedding", "stale_vacancy_text", "dimension_mismatch")
UNCALIBRATED = "uncalibrated"


def unit(v: Column) -> Column:
    """The vector at length 1; one of zeros stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def problem(vectors: Column, embedding: Column, same_model: Column, same_text: Column) -> Column:
    """Why a candidate's ``vectors`` and a vacancy's ``embedding`` cannot be compared; NULL if they can."""
    checks = (F.size(F.coalesce(vectors, F.array().cast("array<array<double>>"))) == 0, F.coalesce(F.size(embedding), F.lit(0)) <= 0, ~F.coalesce(same_model, F.lit(False)), ~F.coalesce(same_text, F.lit(False)), F.size(embedding) != F.size(F.get(vectors, 0)))
    found = F
    for check, code in zip(checks, PROBLEMS, strict=True):
        found = found.when(check, F.lit(code))
    return found


def scored(pairs: DataFrame, aggregation: str = "max", floor: float | None = None, ceil: float | None = None) -> DataFrame:
    """Pairs (vectors: array of a candidate's vectors, embedding, same_model, same_text) with ``items`` (one similarity a
    text), ``raw`` (the largest, or the mean of the two largest), ``best`` (place of the largest, the first of equals),
    ``semantic`` and ``semantic_warning``."""
    if aggregation not in ("max", "top2_mean"):
        raise ValueError("aggregation is max or top2_mean")
    df = pairs.withColumn("semantic_warning", problem(F.col("vectors"), F.col("embedding"), F.col("same_model"), F.col("same_text")))
    ok = F.col("semantic_warning").isNull()
    df = df.withColumn("items", F.when(ok, F.transform("vectors", lambda v: dot(v, F.col("embedding")))))
    top = F.slice(F.sort_array("items", asc=False), 1, 1 if aggregation == "max" else 2)
    df = df.withColumns({"raw": F.aggregate(top, F.lit(0.0), lambda acc, x: acc + x) / F.size(top), "best": F.array_position("items", F.array_max("items")) - 1})
    df = df.withColumn("raw", F.when(ok, F.col("raw")))
    plain = F.lit(UNCALIBRATED) if floor is None or ceil is None else F.lit(None).cast("string")
    return df.withColumns({"semantic": calibrated(F.col("raw"), floor, ceil), "semantic_warning": F.coalesce("semantic_warning", plain)})


def calibration(pairs: DataFrame, related: Column, similarity: str) -> DataFrame:
    """Floor and ceiling of similarity: the medians of unrelated and of related pairs, at four places."""
    return pairs.agg(F.round(F.median(F.when(~related, F.col(similarity))), 4).alias("floor"), F.round(F.median(F.when(related, F.col(similarity))), 4).alias("ceil"))


def read_calibration(text: str, model: str) -> tuple[float, float] | None:
    """Floor and ceiling from a file's JSON; None where it is unreadable, of another model, or no interval."""
    try:
        found = json.loads(text)
        floor, ceil = found["floor"], found["ceil"]
        numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in (floor, ceil))
        return (float(floor), float(ceil)) if numbers and floor < ceil and found.get("embedding_version") == model else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
