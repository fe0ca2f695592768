"""Nearest concepts by a persisted index, and how many of the exact ones it finds."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from fitgrid.shared import shared_dir

from ..operators import vector_index as I
from ..operators.matching import best_of_labels
from .ranking import _t

#: Cells of the index, and those that a search looks at.
CELLS, PROBES = 64, 32


def _first(df, k=5):
    w = Window.partitionBy("query").orderBy(F.desc(F.round("s", 9)), "label")
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def _indexed(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    home = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    I.build(v, home, {"model": "table", "source": sf_dir}, CELLS)
    index, _ = I.open_index(spark, home)
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("expected"), F.col("v").alias("q"))
    return v, q, I.nearest_labels(index, q, PROBES)


def indexed_concepts(spark, sf_dir):
    """The five nearest concepts of every twentieth vector, from the index."""
    return _first(_indexed(spark, sf_dir)[2]).select("query", "place", "label", F.round("s", 6).alias("similarity"))


def index_recall(spark, sf_dir):
    """The share of the exact five nearest concepts that the index gives among its five."""
    v, q, found = _indexed(spark, sf_dir)
    exact = _first(best_of_labels(v, q)).select("query", "label")
    hit = exact.join(_first(found).select("query", "label", F.lit(1).alias("hit")), ["query", "label"], "left")
    return hit.agg(F.count_distinct("query").alias("queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall_at_5"))


QUERIES = {f.__name__: f for f in (indexed_concepts, index_recall)}
#: An index is not exact; a test holds it to all pairs where every cell is looked at, and its recall to 0.9.
ORACLES: dict[str, str] = {}
