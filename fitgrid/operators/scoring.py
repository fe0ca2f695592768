"""Scoring of candidates against vacancies as column expressions.

A pair row holds the counts of skills; everything from there on is arithmetic on
columns, so that re-scoring "with one skill more" is the same expression on other counts.
NULL means unknown and is never read as zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
W_SKILL, W_SEMANTIC, W_EXPERIENCE = 0.40, 0.45, 0.15
STRONG_FIT, STRONG_COVERAGE, PARTIAL_FIT, PARTIAL_COVERAGE = 0.70, 0.8, 0.65, 0.5
MARGIN_MONTHS = 30
REQUIRED, PREFERRED = 1.0, 0.5
BANDS = ("strong", "partial", "weak", "unscored")


@dataclass(frozen=True)
class Weights:
    skill: float = W_SKILL
    semantic: float = W_SEMANTIC
    experience: float = W_EXPERIENCE

    def __post_init__(self):
        parts = (self.skill, self.semantic, self.experience)
        if min(parts) < 0 or abs(sum(parts) - 1) > 1e-9:
            raise ValueError("weights must be non-negative and add up to 1")


def overlap_score(required_matched: Column, required: Column, preferred_matched: Column, preferred: Column) -> Column:
    """Matched weight over all weight; NULL where a vacancy lists no skills."""
    return F.try_divide(REQUIRED * required_matched + PREFERRED * preferred_matched, REQUIRED * required + PREFERRED * preferred)


def coverage(matched: Column, count: Column) -> Column:
    return F.try_divide(matched.cast("double"), count.cast("double"))


def experience_fit(years: Column, months: Column) -> Column:
    """1 with the years asked for, in a straight line to 0 at MARGIN_MONTHS short; NULL if either is unknown or no years are asked."""
    fit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (years * 12 - months) / MARGIN_MONTHS))
    return F.when((years != 0) & years.isNotNull() & months.isNotNull(), fit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def calibrated(raw: Column, floor: float | None = None, ceil: float | None = None) -> Column:
    value = raw if floor is None or ceil is None else (raw - floor) / (ceil - floor)
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def linear_fit(skill: Column, semantic: Column, experience: Column, weights: Weights = Weights()) -> Column:
    """Weighted mean of the known parts; NULL where neither skills nor past work are known."""
    parts = ((weights.skill, skill), (weights.semantic, semantic), (weights.experience, experience))
    top = sum((F.coalesce(w * v, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    known = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, v in parts), F.lit(0.0))
    return F.when(skill.isNotNull() | semantic.isNotNull(), F.try_divide(top, known))


def band_rank(fit: Column, cover: Column) -> Column:
    """Index in BANDS. A vacancy without skills is at most partial."""
    return (
        F.when(fit.isNull(), 3)
        .when(cover.isNull(), F.when(fit >= PARTIAL_FIT, 1).otherwise(2))
        .when((fit >= STRONG_FIT) & (cover >= STRONG_COVERAGE), 0)
        .when((fit >= PARTIAL_FIT) & (cover >= PARTIAL_COVERAGE), 1)
        .otherwise(2)
    )


def band_name(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(b) for b in BANDS)), rank + 1)


def capped(rank: Column, cap: Column) -> Column:
    """A cap only ever worsens a band."""
    return F.greatest(rank, F.coalesce(cap, F.lit(0)))


def fit_warnings(skill: Column, semantic: Column, fit: Column, before_cap: Column) -> Column:
    first = F.when(fit.isNull(), F.lit("unscored")).when(semantic.isNull(), F.lit("semantic_missing")).when(skill.isNull(), F.lit("skill_missing"))
    return F.array_compact(F.array(first, F.when((before_cap == 0) & semantic.isNull(), F.lit("band_without_semantic"))))
