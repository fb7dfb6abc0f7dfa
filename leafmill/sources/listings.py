"""Text listings of other programs as tables.  Inputs are lines: (path, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import object_id, parse_size

_IMAGE_LINE = r"^/[^:]*:\s*([^,]*?)\s*,\s*([0-9]+)\s+x\s+([0-9]+)(?:\s.*)?$"


def whole(text: Column, most: int) -> Column:
    """A number without sign up to ``most``; null for anything else."""
    n = F.when(text.rlike("^[0-9]{1,18}$"), text).try_cast("long")
    return F.when(n <= most, n)


def page_counts(lines: DataFrame) -> DataFrame:
    """(path, page_count) from the first line that begins with ``Pages:``; 0 without one or without a number."""
    said = F.when(F.col("line").startswith("Pages:"), F.col("line"))
    first = lines.groupBy("path").agg(F.min_by(said, F.when(said.isNotNull(), F.col("line_no"))).alias("said"))
    return first.select("path", F.coalesce(whole(F.trim(F.substring("said", 7, F.length("said"))), 2**62), F.lit(0)).alias("page_count"))


def image_references(lines: DataFrame) -> DataFrame:
    """(path, obj_num, gen, width, height, pages, occurrences): images by the pages that name them.

    A line ``page N:`` opens a page; lines ``/Name: 3 0 R, W x H`` below it name images.  Lines before the first
    page do not count, an image keeps the size of its first line.
    """
    line = F.trim("line")
    header = F.when(line.startswith("page ") & line.contains(":"), F.coalesce(whole(F.trim(F.substring_index(F.substring(line, 6, F.length(line)), ":", 1)), 4294967295), F.lit(0)))
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("page", F.last(header, ignorenulls=True).over(so_far)).filter(line.rlike(_IMAGE_LINE) & (F.col("page") > 0))
    number, gen = object_id(F.regexp_extract(line, _IMAGE_LINE, 1))
    width, height = (whole(F.regexp_extract(line, _IMAGE_LINE, k), 4294967295) for k in (2, 3))
    rows = rows.select("path", "line_no", "page", number.alias("obj_num"), gen.alias("gen"), width.alias("width"), height.alias("height"))
    rows = rows.filter("obj_num is not null and width is not null and height is not null")
    return rows.groupBy("path", "obj_num", "gen").agg(
        F.min_by("width", "line_no").alias("width"), F.min_by("height", "line_no").alias("height"), F.array_sort(F.collect_set("page")).alias("pages"), F.count("*").alias("occurrences")
    )


def image_listing(lines: DataFrame) -> DataFrame:
    """Rows of an image table in text: at least 16 columns, type ``image`` (no masks), the first line of every object."""
    cell = lambda k: F.get("cells", F.lit(k))
    rows = lines.withColumn("cells", F.split(F.trim("line"), r"\s+")).filter((F.size("cells") >= 16) & (cell(2) == "image"))
    rows = rows.select(
        "path", "line_no", whole(cell(0), 4294967295).alias("page"), whole(cell(1), 2**62).alias("num"), whole(cell(3), 4294967295).alias("width"), whole(cell(4), 4294967295).alias("height"),
        cell(5).alias("color_space"), whole(cell(7), 255).cast("int").alias("bits"), cell(8).alias("encoding"), whole(cell(10), 4294967295).alias("obj_num"),
        whole(cell(11), 65535).cast("int").alias("gen"), parse_size(cell(14)).alias("pdf_size"),
    )
    rows = rows.dropna(subset=["page", "num", "width", "height", "bits", "obj_num", "gen"])
    first = F.row_number().over(Window.partitionBy("path", "obj_num", "gen").orderBy("line_no"))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n", "line_no")
