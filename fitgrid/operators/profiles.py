"""What a candidate's profile says: months of work, skills merged from mentions, the latest title, texts to embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from .records import covered_months

#: Fixed value: longer texts are cut by the embedding model.
MAX_TEXT_CHARS = 1500


def month_number(text: Column, is_end: bool, today: Column) -> Column:
    """Months since year 0 of "YYYY-MM", "YYYY" (January, or December for an end) or "present"; NULL if unknown."""
    year, month = F.substring(text, 1, 4).try_cast("int"), F.regexp_extract(text, r"^\d{4}-(\d{1,2})$", 1).try_cast("int")
    known = F.when(text.rlike(r"^\d{4}(-\d{1,2})?$"), year * 12 + F.coalesce(month, F.lit(12 if is_end else 1)) - 1)
    return F.when(text == "present", F.year(today) * 12 + F.month(today) - 1).otherwise(known)


def months_worked(jobs: DataFrame, by: str, today: Column) -> DataFrame:
    """``months`` of the union of a profile's jobs (start, end), NULL if none can be counted, with the jobs that cannot:
    without a start, without an end, or ending before they start."""
    df = jobs.withColumns({"first": month_number(F.col("start"), False, today), "last": month_number(F.col("end"), True, today)})
    no_start, no_end = F.col("first").isNull(), F.col("last").isNull()
    counts = df.groupBy(by).agg(F.count_if(no_start).alias("no_start"), F.count_if(~no_start & no_end).alias("no_end"), F.count_if(F.col("last") < F.col("first")).alias("reversed"))
    return counts.join(covered_months(df.filter("last >= first").select(by, "first", "last"), by), by, "left")


def months_for_fit(months: Column, n_jobs: Column, n_undated: Column) -> Column:
    """What the experience rule may rely on: 0 without jobs, NULL where a job cannot be dated."""
    return F.when(n_jobs == 0, 0).when(n_undated == 0, months)


def merged_skills(mentions: DataFrame, by: str) -> DataFrame:
    """One skill per normal form of a profile's mentions (by, pos, name, kind, found_in, quote): the first spelling, places
    and quotes in the order they came, and hard if any mention says so."""
    df = mentions.withColumn("norm", normalize(F.col("name"))).filter("norm <> ''")

    def in_order(col: str) -> Column:
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", col))), lambda x: x[col]))

    first = F.min_by(F.trim("name"), "pos")
    return df.groupBy(by, "norm").agg(first.alias("name"), F.when(F.bool_or(F.col("kind") == "hard"), "hard").otherwise("soft").alias("kind"), in_order("found_in").alias("found_in"), in_order("quote").alias("quotes"), F.min("pos").alias("pos"))


def latest_title(jobs: DataFrame, by: str) -> DataFrame:
    """The title of the job that is still held, else that ended last, else that began last, else the first; of equals the
    first, and jobs without a title do not count."""
    rank = F.when(F.col("end") == "present", 3).when(F.col("end") != "", 2).when(F.col("start") != "", 1).otherwise(0)
    date = F.when(rank == 3, F.coalesce("start", F.lit(""))).when(rank == 2, F.col("end")).when(rank == 1, F.col("start")).otherwise("")
    named = jobs.withColumn("__title", F.trim("title")).filter("__title <> ''")
    return named.groupBy(by).agg(F.max_by("__title", F.struct(rank, date, -F.col("pos"))).alias("title"))


def joined_lines(*parts: Column) -> Column:
    """The parts that say something, one a line."""
    clean = F.filter(F.transform(F.array(*parts), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(clean, "\n")


def candidate_texts(jobs: DataFrame, skills: DataFrame, by: str) -> DataFrame:
    """A text per job with its path, jobs that say nothing left out; a profile without any gives its skills' names.
    Jobs: by, pos, title, company, description, quote; skills: by, pos, name. ``truncated``: too long for the model."""
    of_jobs = jobs.select(by, F.concat(F.lit("experience["), F.col("pos"), F.lit("]")).alias("path"), joined_lines("title", "company", F.coalesce(F.nullif(F.col("description"), F.lit("")), "quote")).alias("text")).filter("text <> ''")
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("name").alias("name")))), lambda x: x["name"])
    rest = skills.filter(F.trim("name") != "").join(of_jobs.select(by).distinct(), by, "left_anti").groupBy(by).agg(F.array_join(names, ", ").alias("text"))
    out = of_jobs.unionByName(rest.select(by, F.lit("skills").alias("path"), "text"))
    return out.withColumn("truncated", F.length("text") > MAX_TEXT_CHARS)


def vacancy_text(title: Column, responsibilities: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.concat(F.array(title), F.coalesce(responsibilities, F.array().cast("array<string>"))), lambda p: F.trim(p)), lambda p: p != ""), "\n")


def skill_paths(skills: DataFrame, used: DataFrame, by: str) -> DataFrame:
    """Every raw skill of a profile with the place it stands in: ``skills[i]`` and ``experience[j].skills_used[k]``."""
    own = skills.select(by, F.concat(F.lit("skills["), F.col("pos"), F.lit("]")).alias("path"), F.col("name").alias("raw"))
    return own.unionByName(used.select(by, F.concat(F.lit("experience["), F.col("job"), F.lit("].skills_used["), F.col("pos"), F.lit("]")).alias("path"), F.col("name").alias("raw")))


def top_tags(tags: DataFrame, known: DataFrame, most: int = 100) -> DataFrame:
    """The most frequent tags (tag, pos) by normal form, with the spelling used most (of equals the first), and whether a
    taxonomy (alias_norm) covers them."""
    df = tags.withColumns({"norm": normalize(F.col("tag")), "spelling": F.trim("tag")}).filter("norm <> ''")
    per = df.groupBy("norm", "spelling").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = per.groupBy("norm").agg(F.sum("n").alias("n"), F.max_by("spelling", F.struct("n", -F.col("first"))).alias("spelling")).orderBy(F.desc("n"), "norm").limit(most)
    return top.join(known.select(F.col("alias_norm").alias("norm"), F.lit(True).alias("covered")).distinct(), "norm", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def coverage(top: DataFrame) -> DataFrame:
    """The share of top tags that are covered, and the same weighted by how often they occur."""
    covered = F.col("covered")
    return top.agg(F.try_divide(F.count_if(covered).cast("double"), F.count("*")).alias("coverage"), F.try_divide(F.sum(F.when(covered, F.col("n")).otherwise(0)).cast("double"), F.sum("n")).alias("weighted"))
