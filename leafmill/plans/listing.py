"""Queries of the list, formatting and paging operators over the driver's tables, with the SQL they must match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import compress as C
from leafmill.operators import rewrite as W
from leafmill.operators import tables as O
from leafmill.sources import listings as L

from .catalog import query
from .relational import cents, read


@query("""
WITH p AS (SELECT p_partkey, p_size AS part, (p_partkey % 7) * 10 AS total FROM part)
SELECT p_partkey, CASE WHEN total = 0 THEN 0.0 ELSE round(part * 100.0::DOUBLE / total, 9) END::DOUBLE AS percent, CASE WHEN total = 0 THEN 0.0 ELSE round((1 - part::DOUBLE / total) * 100.0::DOUBLE, 9) END::DOUBLE AS saved FROM p
""")
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, total = F.col("p_size"), (F.col("p_partkey") % 7) * 10
    return read(spark, sf_dir, "part").select("p_partkey", F.round(T.percent(part, total), 9).alias("percent"), F.round(T.compression_ratio(total, part), 9).alias("saved"))


_PATHS = "'out/img-' || p_partkey || '.' || (CASE p_partkey % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'png' WHEN 3 THEN 'webp' ELSE 'txt' END)"


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.when(k % 5 == 0, "jpg").when(k % 5 == 1, "JPEG").when(k % 5 == 2, "png").when(k % 5 == 3, "webp").otherwise("txt")
    return read(spark, sf_dir, "part").select(F.concat(F.lit("out/img-"), k.cast("string"), F.lit("."), ext).alias("path"))


@query(f"""
SELECT ps_key AS number, {_PATHS} AS file, CASE p_partkey % 5 WHEN 2 THEN 'png' WHEN 3 THEN 'webp' ELSE 'jpeg' END AS format
FROM part JOIN (SELECT DISTINCT l_partkey AS ps_key FROM lineitem WHERE l_quantity > 45) ON ps_key = p_partkey WHERE p_partkey % 5 <> 4
""")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows and exported files meet by the number in the file's name."""
    listing = read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("number")).distinct()
    return O.with_listing(listing, exported(spark, sf_dir), "number", "path").select("number", "file", "format")


@query(f"SELECT {_PATHS} AS path, CASE p_partkey % 5 WHEN 2 THEN 'png' WHEN 3 THEN 'webp' ELSE 'jpeg' END AS format, true AS force FROM part")
def user_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.user_replacements(exported(spark, sf_dir))


@query(f"SELECT {_PATHS} AS image_path, md5(p_name) AS data_md5 FROM part WHERE p_partkey % 3 = 0 AND p_size > 10")
def compressed_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries fetch the bytes of the file that they name."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    key = T.trailing_number(F.col("path"))
    files = exported(spark, sf_dir).withColumn("p_partkey", key).join(parts, "p_partkey")
    have = files.filter("p_size > 10").select("path", F.col("p_name").cast("binary").alias("content"))
    entries = files.filter("p_partkey % 3 = 0").select(F.col("path").alias("image_path"))
    return C.with_bytes(entries, have).select("image_path", F.md5("data").alias("data_md5"))


@query("SELECT p_partkey, array_to_string([p_size::VARCHAR, '/' || p_brand], ' ') || ' Do' AS op FROM part")
def operator_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    operands = F.array(F.col("p_size").cast("string"), F.concat(F.lit("/"), "p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", T.operator_text(operands, F.lit("Do")).alias("op"))


_NAMES = ", ".join(f"('{k}', '{v}', '{T.DISPLAY[k]}')" for k, v in T.COLOURS.items())


@query(f"""
WITH c AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'images' WHEN 1 THEN 'fonts' WHEN 2 THEN 'structure' ELSE o_orderstatus END AS category FROM orders)
SELECT category, coalesce(colour, '{T.GREY}') AS colour, coalesce(display, category) AS display FROM c LEFT JOIN (VALUES {_NAMES}) AS t(category, colour, display) USING (category)
""")
def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    category = F.when(k == 0, "images").when(k == 1, "fonts").when(k == 2, "structure").otherwise(F.col("o_orderstatus"))
    rows = read(spark, sf_dir, "orders").select(category.alias("category")).distinct()
    return rows.select("category", T.colour(F.col("category")).alias("colour"), T.display_name(F.col("category")).alias("display"))


@query("""
SELECT * FROM (VALUES ('xmp_metadata', 0, true, true), ('info', 1, true, true), ('javascript', 2, true, true), ('embedded_files', 3, true, true), ('thumbnails', 4, true, true), ('annotations', 5, false, false),
  ('structure_tree', 6, false, false), ('page_labels', 7, true, true), ('piece_info', 8, true, true), ('mark_info', 9, false, false), ('compress_streams', 10, true, true), ('garbage', 11, true, true)) AS t(key, position, "default", safe)
""")
def prune_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.option_table(spark)


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 10, p_partkey::VARCHAR)::INTEGER AS position FROM part")
def image_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By page, then by id as text: 10 stands before 2."""
    rows = read(spark, sf_dir, "part").withColumn("page", F.col("p_partkey") % 10)
    return O.by_page_and_name(rows, "page", "p_partkey", by=["p_size"]).select("p_partkey", "position")


@query("""
WITH r AS (SELECT p_size, p_partkey, p_partkey % 7 AS page, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'raw' END AS form FROM part),
     f AS (SELECT p_size, form, min(p_partkey) AS first_seen FROM r GROUP BY p_size, form),
     g AS (SELECT p_size, string_agg(form, ',' ORDER BY first_seen) AS formats FROM f GROUP BY p_size),
     d AS (SELECT p_size, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM (SELECT DISTINCT p_size, page FROM r) GROUP BY p_size)
SELECT p_size, pages, formats FROM g JOIN d USING (p_size)
""")
def pages_and_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_size", "p_partkey", (k % 7).alias("page"), F.when(k % 3 == 0, "png").when(k % 3 == 1, "jpeg").otherwise("raw").alias("form"))
    out = O.distinct_pages(rows, ["p_size"], "page", "form", "p_partkey")
    return out.select("p_size", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.array_join("formats", ",").alias("formats"))


@query("""
WITH s AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS size FROM orders GROUP BY o_custkey), t AS (SELECT o_custkey, size, size / sum(size::DOUBLE) OVER () AS share FROM s)
SELECT o_custkey, size FROM t WHERE share >= 0.001
""")
def shown_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with at least a thousandth of all orders' value."""
    sums = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("size"))
    return O.shown_segments(O.share_of_total(sums, "size")).select("o_custkey", "size")


@query("""
WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE p_size END AS pdf_size, p_partkey % 40 AS file_size FROM part)
SELECT p_partkey, coalesce(pdf_size, file_size)::BIGINT AS size, greatest(file_size - coalesce(pdf_size, file_size), 0)::BIGINT AS estimate FROM s
""")
def sizes_and_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pdf_size, file_size = F.when(k % 4 == 1, 0).when(k % 4 != 0, F.col("p_size")), k % 40
    size = O.effective_size(pdf_size, file_size).cast("long")
    return read(spark, sf_dir, "part").select("p_partkey", size.alias("size"), O.estimated_size(file_size, size).cast("long").alias("estimate"))


@query("""
WITH r AS (SELECT p_size AS bucket, p_partkey % 20 AS fp, p_partkey, p_partkey % 9 + 1 AS size FROM part), g AS (SELECT bucket, fp, count(*) AS n, sum(size) - min(size) AS savings, min(p_partkey) AS first_member FROM r GROUP BY bucket, fp HAVING count(*) > 1)
SELECT bucket, first_member, savings::BIGINT AS savings, row_number() OVER (PARTITION BY bucket ORDER BY savings DESC, first_member)::INTEGER AS position FROM g
""")
def duplicate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by savings, largest first."""
    rows = read(spark, sf_dir, "part").select(F.col("p_size").alias("bucket"), (F.col("p_partkey") % 20).alias("fp"), "p_partkey", (F.col("p_partkey") % 9 + 1).alias("size"))
    groups = O.duplicate_groups(rows, ["bucket"], F.col("fp"), "size", "p_partkey")
    return O.ranked(groups, ["bucket"], [F.desc("savings"), F.col("first_member")]).select("bucket", "first_member", "savings", "position")


def lines(spark: SparkSession, sf_dir: str, line) -> DataFrame:
    """Three files with a line of text for every part."""
    return read(spark, sf_dir, "part").select((F.col("p_size") % 3).cast("string").alias("path"), F.col("p_partkey").alias("line_no"), line.alias("line"))


@query("""
WITH r AS (SELECT (p_size % 3)::VARCHAR AS path, p_partkey, p_size, p_partkey % 300 AS obj_num FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 10 <> 0),
     f AS (SELECT *, row_number() OVER (PARTITION BY path, obj_num ORDER BY p_partkey) AS n FROM r)
SELECT path, p_partkey % 9 + 1 AS page, p_partkey AS num, p_size::BIGINT AS width, p_size::BIGINT + 1 AS height, 'rgb' AS color_space, 8 AS bits, 'jpeg' AS encoding, obj_num, 0 AS gen, p_size::BIGINT * 1024 AS pdf_size FROM f WHERE n = 1
""")
def image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text table of images: masks and short lines are left out, an object counts once."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "smask").otherwise("image")
    end = F.when(k % 10 == 0, "").otherwise(" 9%")
    line = F.concat(F.concat_ws("   ", F.lit(" "), k % 9 + 1, k, kind, "p_size", F.col("p_size") + 1, F.lit("rgb 3 8 jpeg no"), k % 300, F.lit("0 72 72"), F.concat("p_size", F.lit("K"))), end)
    return L.image_listing(lines(spark, sf_dir, line))


@query("""
WITH r AS (SELECT (p_size % 3)::VARCHAR AS path, p_partkey, p_partkey % 200 AS obj_num, p_size, CASE WHEN p_partkey % 6 = 0 THEN p_partkey % 11 END AS opens FROM part),
     p AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY path ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM r),
     i AS (SELECT * FROM p WHERE opens IS NULL AND page > 0 AND p_partkey % 7 <> 0)
SELECT path, obj_num, 0 AS gen, arg_min(p_size, p_partkey)::BIGINT AS width, (arg_min(p_size, p_partkey) + 1)::BIGINT AS height, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, count(*) AS occurrences FROM i GROUP BY path, obj_num
""")
def image_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text listing of pages and their images; some lines name none."""
    k = F.col("p_partkey")
    image = F.concat(F.lit("  /Im"), k, F.lit(": "), k % 200, F.lit(" 0 R, "), F.col("p_size"), F.lit(" x "), F.col("p_size") + 1)
    line = F.when(k % 6 == 0, F.concat(F.lit("page "), k % 11, F.lit(": 3 0 R"))).when(k % 7 == 0, F.concat(F.lit("  /Im"), k, F.lit(": none"))).otherwise(image)
    out = L.image_references(lines(spark, sf_dir, line))
    return out.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("""
WITH f AS (SELECT (p_size % 3)::VARCHAR AS path, min(p_partkey) FILTER (p_partkey > 20) AS first_line FROM part GROUP BY 1)
SELECT path, CASE WHEN first_line % 2 = 0 THEN coalesce(first_line, 0) ELSE 0 END AS page_count FROM f
""")
def listed_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that tells the number of pages, if it is a number."""
    k = F.col("p_partkey")
    value = F.when(k % 2 == 0, F.concat(F.lit("  "), k)).otherwise(" many")
    return L.page_counts(lines(spark, sf_dir, F.when(k > 20, F.concat(F.lit("Pages:"), value)).otherwise("Title: Pages: 7")))
