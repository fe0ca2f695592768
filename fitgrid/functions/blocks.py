"""Texts as blocks with offsets, keys of headings and strings, rows of files, and short lists for people."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import COUNTRIES
from .text import NICHES, normalize

# Marks around headings, marks that only spell, marks that separate, and texts of warnings with their codes.
LEADING = r"^(?:(?:\d{1,2}|[ivx]{1,4})[.)]|[•●▪■◦○♦►▸*·–—-])\s*"
TRAILING = r"\s*[:–—-]+$"
APOSTROPHES, HEADING_MARKS = r"['’ʼ`]", r"(?U)[^\w\s&/|,]"
SPELLING, SEPARATORS = r"[.'’]", r"[,;:()\[\]{}/\\|\-–—_\"“”]+"
EXPERIENCE_CODES = (("no start date", "experience_no_start"), ("no end date", "experience_no_end"), ("ends before it starts", "experience_reversed"))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it names several times and that is worked out once."""
    return F.transform(F.array(value), f)[0]


def plain_blocks(text: Column) -> Column:
    """Array of (text, start, end): one block a line that is not blank, ``start`` and ``end`` in the text itself."""
    lines = F.split(text, "\n")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))
    step = F.aggregate(lines, begin, lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.when(x.rlike(r"\S"), F.concat(acc["out"], F.array(F.struct(x.alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end"))))).otherwise(acc["out"]).alias("out")))
    return step["out"]


def assembled(blocks: DataFrame, by: str, order: str) -> DataFrame:
    """Blocks (by, order, text) with their offsets in the text that joins them by blank lines."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return blocks.withColumns({"start": start, "end": start + F.length("text")})


def heading_key(text: Column) -> Column:
    """A heading in lower case without its marks; letters set apart are drawn together."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), LEADING, ""), TRAILING, "")
    key = once(key, lambda k: F.when(k.rlike(r"^\s*\S(?:\s+\S){2,}\s*$"), F.regexp_replace(k, r"\s+", "")).otherwise(k))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(key, APOSTROPHES, ""), HEADING_MARKS, " "), r"\s+", " "))


def match_key(text: Column) -> Column:
    """The normal form without marks that only spell, separators as spaces."""
    key = F.regexp_replace(F.replace(normalize(text), F.lit("&amp;"), F.lit("&")), SPELLING, "")
    return F.trim(F.regexp_replace(F.regexp_replace(key, SEPARATORS, " "), r"\s+", " "))


def warning_code(text: Column) -> Column:
    """A stable code for a warning's free text."""
    of_jobs = F
    for fragment, code in EXPERIENCE_CODES:
        of_jobs = of_jobs.when(text.contains(fragment), F.lit(code))
    of_jobs = F.when(text.startswith("experience "), of_jobs)
    return F.when(text.startswith("quote not found:"), "quote_not_found").when(text.startswith("possible personal data in output at"), "possible_personal_data").otherwise(F.coalesce(of_jobs, F.lit("extraction_warning")))


def known_country(code: Column) -> Column:
    found = F.upper(F.trim(code))
    return F.when(found.isin(*COUNTRIES), found)


def known_niches(codes: Column) -> Column:
    """The known industries among ``codes``, in the table's order."""
    return F.array_intersect(F.array(*map(F.lit, NICHES)), F.coalesce(codes, F.array().cast("array<string>")))


def shown(items: Column, most: int = 6) -> Column:
    """The first items, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def csv_row(*cols: Column) -> Column:
    """A row of a CSV file: booleans as true and false, NULL as nothing, quotes where they are needed."""
    quoted = [F.when(c.cast("string").rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c.cast("string"), F.lit(""))) for c in cols]
    return F.concat_ws(",", *quoted)


def read_feedback(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rated cards of a JSON-lines file (line, text), and the numbers of lines that are none: not JSON, without session or
    vacancy, a score outside 0 to 1, or a label that is not 0 or 1. Blank lines are skipped."""
    kind = "session STRING, vacancy_id STRING, skill DOUBLE, semantic DOUBLE, band STRING, label INT"
    df = lines.filter(F.trim("text") != "").select("line", F.from_json("text", kind, {"mode": "PERMISSIVE"}).alias("r")).select("line", "r.*")

    def share(c: str) -> Column:
        return F.col(c).isNull() | F.col(c).between(0, 1)

    good = F.coalesce((F.col("session") != "") & (F.col("vacancy_id") != "") & F.col("label").isin(0, 1) & share("skill") & share("semantic"), F.lit(False))
    return df.filter(good), df.filter(~good).select("line")
