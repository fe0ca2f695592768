"""Files: taxonomy tables, custom skills with their errors, documents of word processors, the newest cached feed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.taxonomy import aliases, deduped

# Fixed values of the custom skills' file.
CUSTOM, LANGUAGES, SLUG, URI = "custom:skill/", ("en", "uk"), r"^[a-z0-9]+(?:-[a-z0-9]+)*$", r"^https?://data\.europa\.eu/esco/skill/[0-9A-Za-z.-]+$"
ESCO = {"conceptType": "concept_type", "conceptUri": "uri", "preferredLabel": "preferred", "altLabels": "alt", "hiddenLabels": "hidden", "status": "status", "modifiedDate": "modified", "description": "description"}
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, whose cells may hold lines and quotes; a mark of the byte order is no part of it."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns)).na.fill("")


def read_esco(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a skills table under the names that ``operators.taxonomy`` uses, with their place in the file."""
    df = read_csv(spark, path)
    return df.select(*(F.col(c).alias(n) for c, n in ESCO.items() if c in df.columns), F.monotonically_increasing_id().alias("pos"))


def custom_skills(rows: DataFrame, concepts: DataFrame, custom: str = CUSTOM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New concepts and aliases of a custom table (pos, canonical_id, canonical_name, alias, lang) and all its errors.

    A row names a new concept (``custom`` and a slug; its first row has the name, later ones the same or none) or extends
    a known one (concepts: canonical_id, name_en), with an alias and, if any, its very name. An alias that several
    concepts would have is an error too; nothing is used while there are any.
    """
    df = rows.select("pos", *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("canonical_id", "canonical_name", "alias", "lang")))
    df = df.join(concepts.select("canonical_id", F.col("name_en").alias("__name"), F.lit(True).alias("__known")), "canonical_id", "left")
    own, first = F.col("canonical_id").startswith(custom), Window.partitionBy("canonical_id").orderBy("pos")
    df = df.withColumns({"__first": F.first("canonical_name").over(first), "__slug": F.regexp_replace("canonical_id", "^" + custom.replace(".", r"\."), "")})
    name = F.col("canonical_name")
    problem = (
        F.when(~F.col("lang").isin(*LANGUAGES), "language")
        .when(own & ~F.col("__slug").rlike(SLUG), "slug")
        .when(own & (F.col("__first") == ""), "name_missing")
        .when(own & (name != "") & (name != F.col("__first")), "name_conflict")
        .when(~own & ~F.col("canonical_id").rlike(URI), "canonical_id")
        .when(~own & F.col("__known").isNull(), "unknown_uri")
        .when(~own & (F.col("alias") == ""), "alias_missing")
        .when(~own & (name != "") & ~name.eqNullSafe(F.col("__name")), "name_mismatch")
    )
    df = df.withColumn("problem", problem)
    good = df.filter("problem IS NULL")
    concepts_ = good.filter(own).groupBy("canonical_id").agg(F.min_by("canonical_name", "pos").alias("name_en")).withColumns({"is_digital": F.lit(True), "source": F.lit("custom")})
    labels = good.select("canonical_id", F.col("alias").alias("label"), "lang").union(good.filter(own & (name != "")).select("canonical_id", name, "lang"))
    found = deduped(aliases(labels.withColumn("kind", F.lit("custom"))))
    several = found.groupBy("alias_norm").agg(F.count_distinct("canonical_id").alias("n")).filter("n > 1")
    errors = df.filter("problem IS NOT NULL").select("pos", "problem", F.col("canonical_id").alias("about")).unionByName(several.select(F.lit(None).cast("long").alias("pos"), F.lit("alias_conflict").alias("problem"), F.col("alias_norm").alias("about")))
    return concepts_, found, errors


def _paragraphs(data: bytes) -> list[tuple[str, bool]]:
    """Text and boldness (of most of it) of the paragraphs of a document, tables row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(WORDS + "p"):
        text, bold = "", 0
        for run in p.iter(WORDS + "r"):
            piece = "".join("\t" if n.tag == WORDS + "tab" else "\n" if n.tag == WORDS + "br" else n.text or "" for n in run if n.tag in (WORDS + "t", WORDS + "tab", WORDS + "br"))
            mark = run.find(f"{WORDS}rPr/{WORDS}b")
            bold += len(piece) if mark is not None and mark.get(WORDS + "val", "1") not in ("0", "false") else 0
            text += piece
        if text.strip():
            out.append((text, 2 * bold > len(text)))
    return out


def docx_blocks(files: DataFrame) -> DataFrame:
    """Blocks (path, at, text, bold) of documents read as ``binaryFile`` (path, content); what is no document has none and
    an ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, i, t, bold, None) for i, (t, bold) in enumerate(_paragraphs(bytes(content)))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows.append((path, None, None, None, "unreadable"))
            frame = pd.DataFrame(rows, columns=["path", "at", "text", "bold", "error"])
            yield frame.astype({"at": "Int32", "bold": "boolean"})

    return files.select("path", "content").mapInPandas(run, "path string, at int, text string, bold boolean, error string")


def newest_cache(files: DataFrame, source: str, usable: Column) -> DataFrame:
    """Of cached feeds (path ending in ``<source>-<UTC stamp>.json``, body) the newest usable one, or no row."""
    stamp = F.regexp_extract("path", rf"(?:^|/){source}-(\d{{8}}T\d{{6}}Z)\.json$", 1)
    return files.withColumn("stamp", stamp).filter((F.col("stamp") != "") & usable).orderBy(F.desc("stamp")).limit(1)
