"""A corpus pipeline over ``documents``: each stage applies one operator to all that the stage before it kept.

Toxic documents go, one document of each group of near copies stays, repeated
passages are cut, sources are mixed to target weights (every text is drawn once at
least, those of small sources up to twice), and the texts are packed into sequences.
All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrid.llm.common import discard, saved, table
from fitgrid.llm.mixing import mixed_documents
from fitgrid.llm.near_dedup import near_duplicates
from fitgrid.llm.packing import pack
from fitgrid.llm.substring_dedup import remove_repeats
from fitgrid.llm.toxicity import drop_toxic, train

#: The most passes over a source.
REPEATS = 2.0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores as toxic go, each by its own text, null ids too; null and empty texts get the model's
    intercept, repeated rows one verdict. An empty table gives none. Columns of any names are carried."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not their group's smallest doc_id go; of rows with one doc_id one stays; null ids stay, and so do
    texts without words, which are like nothing. Texts of any length count whole. An empty table gives none."""
    found = saved(near_duplicates(docs), "near")
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti")
    twice = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.limit(1).count():
        out = out.join(twice, "doc_id", "left_anti").unionByName(out.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand elsewhere too are cut; every row stays, with null and empty texts as they are."""
    return remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is drawn once at least, those of small sources up to REPEATS times; null sources are one source, texts
    without words are drawn in every pass begun, repeated rows as often as they stand. An empty table gives none."""
    return mixed_documents(docs, repeats=REPEATS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, those drawn twice told apart by ``copy``; null and empty texts are one id. Which sequence a
    piece is in follows from its length and a hash: the mixture's order is that of documents, not of sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("minhash_near_dedup", minhash_near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: No stage but the base of some can be said in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            discard(before)  # written whole by the stage after it
    return STAGES[-1][1](spark, docs, sf_dir)
