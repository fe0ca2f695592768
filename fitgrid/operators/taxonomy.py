"""Building a skill taxonomy: released rows, labels, aliases, display names, and what is ambiguous in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize

# Kinds of aliases from the strongest on, and how short a form must be to match only exactly.
KINDS = ("preferred", "alt", "hidden", "stripped", "custom")
EXACT_ONLY = 2
BASE_LANGUAGE = "en"
PARENTHESIS = r"^(.*\S)\s*\([^()]*\)\s*$"


def released(rows: DataFrame, order: list[Column], kind: str = "KnowledgeSkillCompetence") -> DataFrame:
    """Released rows of the wanted kind, one per uri: the latest modified, of equally late ones the first by ``order``."""
    w = Window.partitionBy("uri").orderBy(F.desc("modified"), *order)
    kept = rows.filter((F.col("concept_type") == kind) & (F.col("status") == "released"))
    return kept.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def split_labels(cell: Column) -> Column:
    """Labels of a cell, one a line, blank ones left out."""
    return F.filter(F.transform(F.split(cell, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.trim(x)), lambda x: x != "")


def aliases(labels: DataFrame) -> DataFrame:
    """Labels (canonical_id, label, lang, kind) as aliases with their normal form, and whether it matches only exactly."""
    norm = normalize(F.col("label"))
    return labels.select("canonical_id", F.trim("label").alias("alias"), norm.alias("alias_norm"), "lang", "kind").filter("alias <> ''").withColumn("exact_only", F.length("alias_norm") <= EXACT_ONLY)


def _strength() -> list[Column]:
    return [F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), (F.col("lang") != BASE_LANGUAGE).cast("int"), F.col("lang"), F.col("alias")]


def deduped(found: DataFrame) -> DataFrame:
    """One alias per concept and normal form: the strongest kind, then the base language, then by language and spelling."""
    w = Window.partitionBy("canonical_id", "alias_norm").orderBy(*_strength())
    return found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def stripped(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases that a trailing parenthesis hides ("Python" for "Python (language)"), and the collisions left out.

    A form that another concept has already, or that several concepts would get, is a collision:
    (alias_norm, canonical_ids). One that its own concept has is not needed.
    """
    inner = F.regexp_extract("alias", PARENTHESIS, 1)
    cut = found.filter(~F.col("kind").isin("stripped", "custom")).withColumn("label", inner).filter("label <> ''")
    cut = aliases(cut.select("canonical_id", "label", "lang", F.lit("stripped").alias("kind")))
    own = found.select("canonical_id", "alias_norm").distinct()
    cut = deduped(cut.join(own, ["canonical_id", "alias_norm"], "left_anti"))
    claims = cut.select("alias_norm", "canonical_id").union(own.join(cut.select("alias_norm").distinct(), "alias_norm", "left_semi").select("alias_norm", "canonical_id"))
    claims = claims.groupBy("alias_norm").agg(F.array_sort(F.collect_set("canonical_id")).alias("canonical_ids"))
    contested = claims.filter(F.size("canonical_ids") > 1)
    return cut.join(contested.select("alias_norm"), "alias_norm", "left_anti").select(*found.columns), contested


def display_name(en: Column, other: Column, id_: Column) -> Column:
    return F.coalesce(F.nullif(en, F.lit("")), F.nullif(other, F.lit("")), id_)


def named(found: DataFrame, concepts: DataFrame) -> DataFrame:
    """Aliases with their concept's display name; the id where the concept is unknown or has no name."""
    return found.join(concepts.select("canonical_id", "name_en", "name_uk"), "canonical_id", "left").withColumn("canonical_name", display_name(F.col("name_en"), F.col("name_uk"), F.col("canonical_id"))).drop("name_en", "name_uk")


def with_second_names(concepts: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts with the preferred name of a second language, and the number of labels of unknown concepts."""
    second = labels.select("canonical_id", F.col("label").alias("name_uk"))
    unknown = second.join(concepts.select("canonical_id"), "canonical_id", "left_anti").agg(F.count("*").alias("unknown"))
    return concepts.join(second, "canonical_id", "left"), unknown


def manifest(found: DataFrame) -> DataFrame:
    """One row of counts: concepts, aliases, those by kind, those that match only exactly, normal forms with several concepts."""
    per = found.groupBy("alias_norm").agg(F.count_distinct("canonical_id").alias("c"))
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    counts = found.agg(F.count_distinct("canonical_id").alias("concepts"), F.count("*").alias("aliases"), *kinds, F.count_if("exact_only").alias("exact_only"))
    return counts.crossJoin(F.broadcast(per.agg(F.count_if(F.col("c") > 1).alias("ambiguous"))))


def strong_norms(found: DataFrame, concepts: DataFrame) -> DataFrame:
    """Normal forms with whether they name a digital or custom concept, or are custom themselves."""
    strong = concepts.filter(F.col("is_digital") | (F.col("source") == "custom")).select("canonical_id", F.lit(True).alias("__s"))
    return found.join(strong, "canonical_id", "left").groupBy("alias_norm").agg(F.bool_or(F.coalesce("__s", F.lit(False)) | (F.col("kind") == "custom")).alias("strong"))
