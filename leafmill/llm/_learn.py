"""What the learned operators share: folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(column: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo ``folds``; null ids belong to fold 1, so they are never held out."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string")) % folds, F.lit(1))


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) once per id outside fold 0; an id with both labels counts as 1, null labels are left out."""
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    return rows.filter("id is not null and y is not null").filter(fold("id") != 0).groupBy("id").agg(F.max("y").alias("y"))


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows, chosen by a hash of the id: the same ones in every run."""
    return rows.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(limit)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
