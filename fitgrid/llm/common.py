"""What the operators share: inputs, tables in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local one will do only if all
    runs on this machine (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fitgrid-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Has a finished write give up its shuffle files at once, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_fold(col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component the smallest id.

    Each round takes the smallest label among neighbours and then that label's own
    label (pointer jumping), so long chains halve; labels live in the shared folder.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    held = labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        root = labels.select(F.col("id").alias("new"), F.col("component").alias("up"))
        step = saved(hooked.join(root, "new").select("id", F.least("new", "up").alias("component"), (F.least("new", "up") != F.col("old")).alias("moved")), "labels")
        discard(held)  # the step has all that is needed of the labels before it
        held, labels = step, step.select("id", "component")
        if not step.filter("moved").limit(1).count():
            discard(both)
            return labels
