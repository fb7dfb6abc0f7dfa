"""Connected components of an edge table, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary folder, a cluster an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` with its rows written to the shared checkpoint folder, so that no later step repeats it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: compressed, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (columns a and b, long); component is its least node.

    Alternates large-star and small-star steps: every step is one minimum per node, combined before
    the shuffle, and one join that adaptive execution can split where a node has very many edges.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        pulled = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(pulled.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # finished when every node has one edge, and no edge leads to a node that has one itself
        total, nodes = after.agg(F.count("*"), F.count_distinct("u")).first()
        edges = after
        if total == nodes and after.select("u").join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
