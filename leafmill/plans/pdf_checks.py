"""Queries over PDF files whose features follow from a row's key, so that SQL can say what each operator must find.

One supplier (or part) is one file; see each ``make``.
"""

from __future__ import annotations

import base64
import zlib
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import compress as C
from leafmill.operators import documents as D
from leafmill.operators import extract as E
from leafmill.operators import pages as G
from leafmill.operators import rewrite as W
from leafmill.operators import tables as O
from leafmill.sources import pdf_tables as P
from leafmill.sources.pdf_file import Document, Name, Ref, Stream, serialise

from .catalog import query
from .lineage import written
from .pdf_queries import build, skeleton
from .relational import read

CATALOG, PAGE = Ref(1, 0), Ref(3, 0)


def supplier() -> Column:
    return F.col("path").cast("long").alias("s_suppkey")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.col("s_suppkey").alias("s"))


def attach(doc: Document, objects: dict[int, Any]) -> Document:
    """Adds objects that the catalog refers to."""
    for num, value in objects.items():
        doc.objects[Ref(num, 0)] = value
    doc.objects[CATALOG]["Extra"] = [Ref(n, 0) for n in objects]
    return doc


# --- analysis


def with_fonts(row: dict) -> Document:
    s, objects = row["s"], {}
    for i in range(s % 4):
        objects[10 + 3 * i] = {"Type": Name("Font"), "Subtype": Name("Type1" if i % 2 else "TrueType"), "BaseFont": Name(f"Font{i}x{s}"), "FontDescriptor": Ref(11 + 3 * i, 0)}
        objects[11 + 3 * i] = {"Type": Name("FontDescriptor"), "FontFile2": Ref(12 + 3 * i, 0)}
        if (s + i) % 3:
            size = 20 + (s * 7 + i * 13) % 300
            objects[12 + 3 * i] = Stream({"Length1": size}, b"f" * size)
    return attach(skeleton(b""), objects)


@query("""
WITH f AS (SELECT s_suppkey, i, 'Font' || i || 'x' || s_suppkey AS name, CASE WHEN i % 2 = 1 THEN 'Type1' ELSE 'TrueType' END AS subtype, (s_suppkey + i) % 3 <> 0 AS embedded
           FROM supplier, range(4) t(i) WHERE i < s_suppkey % 4)
SELECT s_suppkey, 10 + 3 * i AS obj_num, name, subtype, embedded,
       81 + length(subtype) + length(name) + 55 + CASE WHEN embedded THEN 53 + 20 + (s_suppkey * 7 + i * 13) % 300 ELSE 0 END AS size FROM f
""")
def pdf_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = D.fonts(P.object_table(written(P.parse_files(build(suppliers(spark, sf_dir), with_fonts)))))
    return fonts.select(supplier(), "obj_num", "name", "subtype", "embedded", "size")


@query("""
SELECT s_suppkey, 12 + 3 * i AS obj_num, (s_suppkey + i) % 3 <> 0 AS there FROM supplier, range(4) t(i) WHERE i < s_suppkey % 4
""")
def pdf_font_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font programs by reference, and whether the reference leads anywhere."""
    objects = P.object_table(written(P.parse_files(build(suppliers(spark, sf_dir), with_fonts))))
    there = objects.filter(D.is_font_program()).select("path", "obj_num", "gen", F.lit(True).alias("there"))
    found = D.font_programs(objects).join(there, ["path", "obj_num", "gen"], "left")
    return found.select(supplier(), "obj_num", F.coalesce("there", F.lit(False)).alias("there"))


def with_everything(row: dict) -> Document:
    s = row["s"]
    objects: dict[int, Any] = {}
    for i in range(s % 3):
        objects[20 + i] = Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 1, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, b"i" * (10 + i))
    if s % 2:
        objects[30] = Stream({"Length1": 5}, b"fonts")
        objects[31] = {"Type": Name("FontDescriptor"), "FontFile2": Ref(30, 0)}
    if s % 3 == 0:
        objects[40] = Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, b"<x/>")
    if s % 5 == 0:
        objects[50] = Stream({"Subtype": Name("Form")}, b"q Q")
    doc = attach(skeleton(b"q" * (s % 50)), objects)
    doc.objects[Ref(60, 0)] = {"Title": b"t"}
    doc.trailer["Info"] = Ref(60, 0)
    return doc


_COUNTS = """
WITH c AS (SELECT s_suppkey, s_suppkey % 3 AS images, s_suppkey % 2 AS fonts, (s_suppkey % 3 = 0)::INTEGER AS xml, (s_suppkey % 5 = 0)::INTEGER AS forms, (s_suppkey % 50 > 0)::INTEGER AS content FROM supplier)
"""


@query(f"""{_COUNTS}
SELECT s_suppkey, 'images' AS category, images::BIGINT AS n, (images * 190 + (images = 2)::INTEGER)::BIGINT AS size FROM c
UNION ALL SELECT s_suppkey, 'fonts', fonts, fonts * 58 FROM c
UNION ALL SELECT s_suppkey, 'content', content, CASE WHEN content = 1 THEN 26 + s_suppkey % 50 ELSE 0 END FROM c
UNION ALL SELECT s_suppkey, 'forms', forms, forms * 48 FROM c
UNION ALL SELECT s_suppkey, 'metadata', 1 + xml, 14 + xml * 68 FROM c
UNION ALL SELECT s_suppkey, 'structure', 3 + fonts, 0 FROM c
UNION ALL SELECT s_suppkey, 'other_streams', 1 - content, (1 - content) * 26 FROM c
UNION ALL SELECT s_suppkey, 'unused', 1, 0 FROM c
""")
def pdf_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = P.object_table(written(P.parse_files(build(suppliers(spark, sf_dir), with_everything), with_content=False)))
    size = F.when(F.col("category").isin("structure", "unused"), 0).otherwise(F.col("size")).cast("long")
    return D.components(objects).select(supplier(), "category", "n", size.alias("size"))


@query(f"""{_COUNTS}
SELECT s_suppkey, 'images' AS category, images::BIGINT AS n, (images * 256)::BIGINT AS size FROM c
UNION ALL SELECT s_suppkey, 'fonts', fonts, fonts * 256 FROM c
UNION ALL SELECT s_suppkey, 'content', 1, 256 FROM c
UNION ALL SELECT s_suppkey, 'forms', forms, forms * 256 FROM c
UNION ALL SELECT s_suppkey, 'metadata', xml, xml * 256 FROM c
UNION ALL SELECT s_suppkey, 'structure', 4 + fonts, 0 FROM c
UNION ALL SELECT s_suppkey, 'unused', 1, 64 FROM c
""")
def pdf_components_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = P.object_table(written(P.parse_files(build(suppliers(spark, sf_dir), with_everything), with_content=False)))
    size = F.when(F.col("category") == "structure", 0).otherwise(F.col("size")).cast("long")
    return D.components(objects, "large").select(supplier(), "category", "n", size.alias("size"))


@query(f"""{_COUNTS}
SELECT s_suppkey, 0::BIGINT AS other_count, true AS rest_counted, images + fonts * 2 + xml + forms + 6 AS total_objects,
       (14 + xml * 68 + 15)::BIGINT AS potential_savings, 1::BIGINT AS unused_objects, 0::BIGINT AS duplicate_groups, fonts::BIGINT AS fonts FROM c
""")
def pdf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = written(P.parse_files(build(suppliers(spark, sf_dir), with_everything)))
    facts = D.summary(parsed)
    rest = D.other_of_file(facts, D.components(P.object_table(parsed), "large"))
    whole = D.analyse(parsed).select("path", F.col("total_objects").alias("total"), "potential_savings", F.col("unused_objects").alias("unused"), "duplicate_groups")
    known = facts.select("path", "total_objects", "file_size", "n_fonts").join(rest, "path").join(whole, "path")
    small = F.col("other_size") < F.col("file_size")
    return known.select(
        supplier(), "other_count", small.alias("rest_counted"), F.col("total").alias("total_objects"), "potential_savings", F.col("unused").alias("unused_objects"), "duplicate_groups", F.col("n_fonts").alias("fonts"),
    )


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'failed' WHEN 2 THEN 'encrypted' ELSE 'ok' END AS parse_status, CASE WHEN s_suppkey % 4 <> 1 THEN 1 END AS page_count,
       CASE WHEN s_suppkey % 4 <> 1 THEN '1.7' END AS pdf_version, CASE WHEN s_suppkey % 4 = 1 THEN 9 + length(s_suppkey::VARCHAR) ELSE 0 END AS size_of_text, s_suppkey % 4 <> 1 AS complete_tail FROM supplier
""")
def pdf_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound files, text that is no PDF, encrypted files, and files whose end is cut off."""

    def make(row: dict) -> bytes:
        doc, kind = skeleton(b"q Q"), row["s"] % 4
        if kind == 1:
            return b"no file %d." % row["s"]
        if kind == 2:
            doc.objects[Ref(9, 0)] = {"Filter": Name("Standard")}
            doc.trailer["Encrypt"] = Ref(9, 0)
        data = serialise(doc)
        return data[: data.rindex(b"startxref")] if kind == 3 else data

    found = P.file_table(P.parse_files(build(suppliers(spark, sf_dir), make), with_content=False))
    size = F.when(F.col("parse_status") == "failed", F.col("file_size")).otherwise(0)
    return found.select(supplier(), "parse_status", "page_count", "pdf_version", size.cast("long").alias("size_of_text"), "complete_tail")


def with_pages(row: dict) -> Document:
    """1 to 3 pages; page 2 inherits resources from the tree, page 3 has a box by reference."""
    s = row["s"]
    doc = Document(trailer={"Root": CATALOG})
    pages = [Ref(10 + k, 0) for k in range(1 + s % 3)]
    image = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 10 + s % 7, "Height": 5.0, "ColorSpace": [Name("ICCBased"), Ref(99, 0)], "Filter": [Name("ASCIIHexDecode"), Name("FlateDecode")], "DecodeParms": [{"Predictor": 12, "Columns": 1}, None]}
    doc.objects |= {CATALOG: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, Ref(2, 0): {"Type": Name("Pages"), "Kids": pages, "Count": len(pages), "Resources": {"XObject": {"Own": Ref(20, 0)}}}}
    doc.objects |= {Ref(20, 0): Stream(image, b"00>"), Ref(21, 0): Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 3, "Height": s, "BitsPerComponent": 1}, b"z" * (s % 9)), Ref(30, 0): [0, 0, 100, s]}
    for k, r in enumerate(pages):
        page = {"Type": Name("Page"), "Parent": Ref(2, 0)}
        if k != 1:
            page["Resources"] = {"XObject": {"Own": Ref(20, 0), "Other": Ref(21, 0)}}
        if k == 0:
            page["MediaBox"] = [0, 0, 200 + s % 5, 300.5]
        if k == 2:
            page["MediaBox"] = Ref(30, 0)
        doc.objects[r] = page
    return doc


@query("""
SELECT s_suppkey, k + 1 AS page, 10 + k AS obj_num, CASE k WHEN 0 THEN 200.0 + s_suppkey % 5 WHEN 1 THEN 595.0 ELSE 100.0 END::DOUBLE AS width, CASE k WHEN 0 THEN 300.5 WHEN 1 THEN 842.0 ELSE s_suppkey END::DOUBLE AS height
FROM supplier, range(3) t(k) WHERE k < 1 + s_suppkey % 3
""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.page_table(P.parse_files(build(suppliers(spark, sf_dir), with_pages), with_content=False))
    return pages.select(supplier(), "page", "obj_num", F.col("mediabox")[2].alias("width"), F.col("mediabox")[3].alias("height"))


@query("""
SELECT s_suppkey, k + 1 AS page, name, CASE name WHEN 'Own' THEN 20 ELSE 21 END AS obj_num
FROM supplier, range(3) t(k), (VALUES ('Own'), ('Other')) n(name) WHERE k < 1 + s_suppkey % 3 AND (k <> 1 OR name = 'Own')
""")
def pdf_page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by page, inherited ones too."""
    return P.page_xobject_table(P.parse_files(build(suppliers(spark, sf_dir), with_pages), with_content=False)).select(supplier(), "page", "name", "obj_num")


@query("""
SELECT s_suppkey, 20 AS obj_num, 10 + s_suppkey % 7 AS width, 5 AS height, 'ICCBased' AS color_space, 8 AS bits, 'ASCIIHexDecode,FlateDecode' AS filters, 12 AS predictor, 3 AS pdf_size FROM supplier
UNION ALL SELECT s_suppkey, 21, 3, s_suppkey, 'Unknown', 1, '', 1, s_suppkey % 9 FROM supplier
""")
def pdf_image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = P.object_table(P.parse_files(build(suppliers(spark, sf_dir), with_pages), with_content=False, only_images=True))
    return D.images(objects).select(supplier(), "obj_num", "width", "height", "color_space", "bits", F.array_join("filters", ",").alias("filters"), "predictor", "pdf_size")


@query("""
SELECT s_suppkey, 20 AS obj_num, 1 + s_suppkey % 3 AS occurrences, array_to_string(range(1, 2 + s_suppkey % 3), ',') AS pages, 10 + s_suppkey % 7 AS width FROM supplier WHERE s_suppkey % 3 > 0
UNION ALL SELECT s_suppkey, 21, 2, '1,3', 3 FROM supplier WHERE s_suppkey % 3 = 2
""")
def pdf_reused_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.reused_images(written(P.parse_files(build(suppliers(spark, sf_dir), with_pages))))
    return found.select(supplier(), "obj_num", "occurrences", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "width")


@query("""
SELECT s_suppkey, (1 + (1 + 1 + s_suppkey % 3) + 1 + (1 + s_suppkey % 3) + 2 + (s_suppkey % 3 = 2)::INTEGER * 3)::BIGINT AS edges, 'Root' AS trailer_key,
       (2 + 1 + s_suppkey % 3 + 2 + (s_suppkey % 3 = 2)::INTEGER)::BIGINT AS reached FROM supplier
""")
def pdf_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, roots, and what a level-by-level walk from the catalog reaches (dangling references lead nowhere)."""
    parsed = written(P.parse_files(build(suppliers(spark, sf_dir), with_pages), with_content=False))
    edges = P.edge_table(parsed)
    node = lambda n: F.concat_ws(":", "path", n)
    there = P.object_table(parsed).select("path", F.col("obj_num").alias("dst_num"))
    known = edges.join(there, ["path", "dst_num"], "left_semi").select(node("src_num").alias("src"), node("dst_num").alias("dst"))
    roots = P.root_table(parsed)
    seen = O.reachable(known, roots.select(node("obj_num").alias("node")))
    reached = seen.groupBy(F.split("node", ":")[0].alias("path")).agg(F.count("*").alias("reached"))
    counted = edges.groupBy("path").agg(F.count("*").alias("edges"))
    return counted.join(roots.select("path", "trailer_key"), "path").join(reached, "path").select(supplier(), "edges", "trailer_key", "reached")


# --- rewriting

SWITCHES = ["xmp_metadata", "info", "javascript", "embedded_files", "thumbnails", "annotations", "structure_tree", "page_labels", "piece_info", "mark_info"]


def with_extras(row: dict) -> Document:
    s, doc = row["s"], skeleton(b"q Q")
    catalog, page = doc.objects[CATALOG], doc.objects[PAGE]
    for key, divisor, rest, value in (
        ("Metadata", 2, 0, Ref(40, 0)), ("Names", 3, 0, Ref(41, 0)), ("AcroForm", 5, 0, {}), ("OpenAction", 7, 0, [Ref(3, 0)]), ("MarkInfo", 2, 1, {"Marked": True}),
        ("StructTreeRoot", 3, 1, Ref(42, 0)), ("PageLabels", 4, 0, {"Nums": []}), ("PieceInfo", 4, 1, {}),
    ):
        if s % divisor == rest:
            catalog[key] = value
    for key, divisor, value in (("Thumb", 2, Ref(43, 0)), ("Annots", 3, []), ("PieceInfo", 5, {})):
        if s % divisor == 0:
            page[key] = value
    doc.objects |= {Ref(40, 0): Stream({"Type": Name("Metadata")}, b"<x/>"), Ref(41, 0): {"EmbeddedFiles": {"Names": []}, "Dests": {}}, Ref(42, 0): {"K": 1}, Ref(43, 0): Stream({}, b"t")}
    doc.objects[Ref(44, 0)] = {"Title": b"t", "Author": b"a"} if s % 2 == 0 else {}
    doc.trailer["Info"] = Ref(44, 0)
    return doc


def _left(keys: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {condition} THEN '{key}' END" for key, condition in keys.items())
    return f"array_to_string(list_sort(list_filter([{cases}], lambda k: k IS NOT NULL)), ',')"


_CATALOG_LEFT = _left({
    "Type": "true", "Pages": "true", "Metadata": "k % 2 = 0 AND switch <> 'xmp_metadata'", "Names": "k % 3 = 0 AND switch <> 'javascript'", "AcroForm": "k % 5 = 0 AND switch <> 'javascript'",
    "OpenAction": "k % 7 = 0 AND switch <> 'javascript'", "MarkInfo": "k % 2 = 1 AND switch NOT IN ('mark_info', 'structure_tree')", "StructTreeRoot": "k % 3 = 1 AND switch <> 'structure_tree'",
    "PageLabels": "k % 4 = 0 AND switch <> 'page_labels'", "PieceInfo": "k % 4 = 1 AND switch <> 'piece_info'",
})
_PAGE_LEFT = _left({
    "Type": "true", "Parent": "true", "Contents": "true", "Resources": "true", "Thumb": "k % 2 = 0 AND switch <> 'thumbnails'", "Annots": "k % 3 = 0 AND switch <> 'annotations'",
    "PieceInfo": "k % 5 = 0 AND switch <> 'piece_info'",
})


@query(f"""
WITH w AS (SELECT s_suppkey, s_suppkey AS k, unnest({SWITCHES}) AS switch FROM supplier)
SELECT s_suppkey, switch, CASE switch
         WHEN 'xmp_metadata' THEN (k % 2 = 0)::INTEGER WHEN 'info' THEN (k % 2 = 0)::INTEGER WHEN 'javascript' THEN (k % 3 = 0)::INTEGER + (k % 5 = 0)::INTEGER + (k % 7 = 0)::INTEGER
         WHEN 'embedded_files' THEN (k % 3 = 0)::INTEGER WHEN 'thumbnails' THEN (k % 2 = 0)::INTEGER WHEN 'annotations' THEN (k % 3 = 0)::INTEGER
         WHEN 'structure_tree' THEN (k % 2 = 1)::INTEGER + (k % 3 = 1)::INTEGER WHEN 'page_labels' THEN (k % 4 = 0)::INTEGER
         WHEN 'piece_info' THEN (k % 4 = 1)::INTEGER + (k % 5 = 0)::INTEGER ELSE (k % 2 = 1)::INTEGER END AS changed,
       {_CATALOG_LEFT} AS catalog_keys, {_PAGE_LEFT} AS page_keys, CASE WHEN k % 2 = 0 AND switch <> 'info' THEN 'Author,Title' ELSE '' END AS info_keys,
       CASE WHEN switch = 'embedded_files' AND k % 3 = 0 THEN 'Dests' ELSE 'Dests,EmbeddedFiles' END AS name_keys
FROM w
""")
def pdf_prune_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every switch alone: how much it changes, and which keys are left."""
    rows = suppliers(spark, sf_dir).select("path", "s", F.explode(F.array(*[F.lit(x) for x in SWITCHES])).alias("switch"))
    rows = rows.select(F.concat_ws("/", "path", "switch").alias("path"), "s", F.array("switch").alias("on"))
    pruned = written(W.prune_files(build(rows, with_extras), switches="on"))
    objects = P.parse_files(pruned, with_content=False).filter("record = 'object' and obj_num in (1, 3, 41, 44)")
    keys = F.array_join(F.array_sort(F.json_object_keys("dict")), ",")
    left = objects.groupBy("path").agg(*[F.max(F.when(F.col("obj_num") == n, keys)).alias(c) for n, c in ((1, "catalog_keys"), (3, "page_keys"), (44, "info_keys"), (41, "name_keys"))])
    parts = F.split("path", "/")
    return pruned.select("path", "changed").join(left, "path").select(parts[0].cast("long").alias("s_suppkey"), parts[1].alias("switch"), "changed", "catalog_keys", "page_keys", "info_keys", "name_keys")


def with_streams(row: dict) -> Document:
    s = row["s"]
    plain = b"ab" * (s % 100)
    return attach(skeleton(b""), {
        20: Stream({}, plain), 21: Stream({"Filter": Name("FlateDecode")}, zlib.compress(plain)), 22: Stream({"Subtype": Name("Image")}, b"i" * 500),
        23: Stream({"Subtype": Name("Type1C")}, b"f" * 500), 24: Stream({"Filter": [Name("ASCIIHexDecode")]}, plain.hex().encode() + b">"),
    })


@query("""
WITH t AS (SELECT s_suppkey, repeat('ab', (s_suppkey % 100)::INTEGER) AS plain FROM supplier)
SELECT s_suppkey, 20 AS obj_num, CASE WHEN length(plain) > 100 THEN 'FlateDecode' ELSE '' END AS filters, CASE WHEN length(plain) > 100 THEN 1 ELSE 0 END AS changed, md5(plain) AS decoded_md5 FROM t
UNION ALL SELECT s_suppkey, 21, 'FlateDecode', CASE WHEN length(plain) > 100 THEN 1 ELSE 0 END, md5(plain) FROM t
UNION ALL SELECT s_suppkey, 22, '', CASE WHEN length(plain) > 100 THEN 1 ELSE 0 END, md5(repeat('i', 500)) FROM t
UNION ALL SELECT s_suppkey, 23, '', CASE WHEN length(plain) > 100 THEN 1 ELSE 0 END, md5(repeat('f', 500)) FROM t
UNION ALL SELECT s_suppkey, 24, 'ASCIIHexDecode', CASE WHEN length(plain) > 100 THEN 1 ELSE 0 END, md5(plain) FROM t
""")
def pdf_compress_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suppliers(spark, sf_dir).withColumn("on", F.array(F.lit("compress_streams")))
    pruned = written(W.prune_files(build(rows, with_streams), switches="on"))
    found = E.streams(pruned).filter("obj_num between 20 and 24").join(pruned.select("path", "changed"), "path")
    return found.select(supplier(), "obj_num", F.array_join("filters", ",").alias("filters"), "changed", F.md5("decoded").alias("decoded_md5"))


def with_placed(row: dict) -> Document:
    """Four drawings of two images, at heights 0, s, 2s, 3s modulo 80."""
    s = row["s"]
    body = b"\n".join(b"q 1 0 0 1 5 %d cm /Im%d Do Q" % (s * j % 80, j % 2) for j in range(4))
    doc = skeleton(body, [b"one", b"twotwo"])
    doc.objects[Ref(7, 0)].dict |= {"Width": 2, "Height": 3}
    return doc


@query("""
WITH d AS (SELECT s_suppkey, j, (s_suppkey * j) % 80 AS y FROM supplier, range(4) t(j)), h AS (SELECT *, j % 2 = 1 AND y BETWEEN 10 AND 50 AS hit FROM d)
SELECT s_suppkey, 'ok' AS status, count(*) FILTER (hit) AS changed, (count(*) FILTER (hit) > 0)::INTEGER AS affected_pages, count(*) FILTER (NOT hit) AS drawings,
       array_to_string(list_sort(list((j::VARCHAR || ':' || y::VARCHAR)) FILTER (NOT hit)), ' ') AS places, 7 - (count(*) FILTER (hit) = 2)::INTEGER AS objects FROM h GROUP BY s_suppkey
""")
def pdf_remove_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings of 2 x 3 images between heights 10 and 50 go; the image goes with its last one."""
    done = written(W.remove_images_from_files(build(suppliers(spark, sf_dir), with_placed), [(2, 3), (0, 9)], 10, 50))
    drawn = written(G.placements(done))
    # heights tell which of the four drawings is left
    j = F.explode(F.sequence(F.lit(0), F.lit(3)))
    all_ = done.select("path", "status", "changed", "affected_pages", F.col("path").cast("long").alias("s"), j.alias("j"))
    left = drawn.groupBy("path", "name", "y").agg(F.count("*").alias("n"))
    mine = all_.withColumns({"name": F.concat(F.lit("Im"), (F.col("j") % 2).cast("string")), "y": ((F.col("s") * F.col("j")) % 80).cast("double")})
    kept = mine.join(left, ["path", "name", "y"]).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "j", F.col("y").cast("long")))), " ").alias("places"))
    counts = drawn.groupBy("path").agg(F.count("*").alias("drawings"))
    plain = P.parse_files(done, with_content=False).filter("record = 'object' and coalesce(type, '') not in ('ObjStm', 'XRef')")
    objects = plain.groupBy("path").agg(F.count("*").alias("objects"))
    out = done.select("path", "status", "changed", "affected_pages").join(counts, "path").join(kept, "path").join(objects, "path")
    return out.select(supplier(), "status", "changed", "affected_pages", "drawings", "places", "objects")


@query("""
WITH m AS (SELECT s_suppkey, unnest([true, false]) AS merged, s_suppkey % 3 AS kind, s_suppkey % 2 = 0 AS forced FROM supplier),
     r AS (SELECT *, kind = 0 OR kind = 1 OR forced AS done FROM m)
SELECT s_suppkey, merged, done::INTEGER AS changed, CASE WHEN done THEN 4 ELSE 1 END AS width, CASE WHEN done THEN 6 ELSE 1 END AS height,
       CASE WHEN NOT done THEN 'DeviceGray' WHEN kind = 0 THEN 'DeviceGray' ELSE 'DeviceRGB' END AS color_space, CASE WHEN NOT done THEN '' WHEN kind = 2 THEN 'DCTDecode' ELSE 'FlateDecode' END AS filters,
       merged OR NOT done AS has_mask, CASE WHEN done THEN CASE kind WHEN 0 THEN md5(repeat('g', 24)) WHEN 1 THEN md5(repeat('c', 72)) ELSE md5(repeat('j', 400)) END ELSE md5(repeat('o', 300)) END AS data_md5
FROM r
""")
def pdf_replace_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray, colour or JPEG bytes in place of a mask-bearing image, if smaller or forced; by merging dictionaries or with new ones."""

    def make(row: dict) -> Document:
        doc = skeleton(b"/Im0 Do", [b"o" * 300])
        doc.objects[Ref(6, 0)].dict |= {"SMask": Ref(77, 0), "Decode": [0, 1]}
        return doc

    rows = suppliers(spark, sf_dir)
    kind = F.col("s") % 3
    data = F.when(kind == 0, F.repeat(F.lit("g"), 24)).when(kind == 1, F.repeat(F.lit("c"), 72)).otherwise(F.repeat(F.lit("j"), 400)).cast("binary")
    new = rows.select("path", F.lit(6).cast("long").alias("obj_num"), F.lit(0).alias("gen"), F.when(kind == 0, "gray").when(kind == 1, "rgb").otherwise("jpeg").alias("kind"), data.alias("data"), F.lit(4).alias("width"), F.lit(6).alias("height"), (F.col("s") % 2 == 0).alias("force"))
    files = build(rows, make)
    out = None
    for merge in (True, False):
        done = written(W.replace_images_in_files(files, new, merge))
        objects = P.object_table(P.parse_files(done)).filter("obj_num = 6").withColumn("has_mask", D.entry("SMask").isNotNull())
        image = D.images(objects).join(objects.select("path", "has_mask"), "path").join(E.streams(done).filter("obj_num = 6").select("path", "decoded"), "path").join(done.select("path", "changed"), "path")
        some = image.select(supplier(), F.lit(merge).alias("merged"), "changed", "width", "height", "color_space", F.array_join("filters", ",").alias("filters"), "has_mask", F.md5("decoded").alias("data_md5"))
        out = some if out is None else out.unionByName(some)
    return out


# --- codecs, previews


def run_lengths(data: bytes) -> bytes:
    """Literal runs of up to 100 bytes."""
    parts = [data[k : k + 100] for k in range(0, len(data), 100)]
    return b"".join(bytes([len(p) - 1]) + p for p in parts) + b"\x80"


def predicted(data: bytes, columns: int) -> bytes:
    """PNG rows with the five predictors in turn."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, columns).astype(np.int64)
    out, above = bytearray(), np.zeros(columns, np.int64)
    for n, row in enumerate(rows):
        left, corner = np.append(0, row[:-1]), np.append(0, above[:-1])
        estimate = left + above - corner
        a, b, c = abs(estimate - left), abs(estimate - above), abs(estimate - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = [np.zeros(columns, np.int64), left, above, (left + above) // 2, nearest][n % 5]
        out += bytes([n % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    return bytes(out)


def with_filters(row: dict) -> Document:
    """Filter chain by key modulo 10 over whole groups of four bytes of the name."""
    text = row["p_name"].encode()
    data, chain = text[: len(text) // 4 * 4], row["p_partkey"] % 10
    rows = np.frombuffer(data, np.uint8).reshape(-1, 4)
    a85, ahx, flate, runs = base64.a85encode(data) + b"~>", data.hex().encode() + b">", zlib.compress(data), run_lengths(data)
    steps = {
        0: ([], data), 1: (["ASCIIHexDecode"], ahx), 2: (["ASCII85Decode"], a85), 3: (["RunLengthDecode"], runs), 4: (["FlateDecode"], flate),
        5: (["ASCII85Decode", "FlateDecode"], base64.a85encode(flate) + b"~>"), 6: (["ASCIIHexDecode", "RunLengthDecode"], runs.hex().encode() + b">"), 7: (["LZWDecode"], data),
        8: (["FlateDecode"], zlib.compress(predicted(data, 4))), 9: (["FlateDecode"], zlib.compress(np.diff(rows, axis=1, prepend=np.uint8(0)).tobytes())),
    }
    names, body = steps[chain]
    entries: dict[str, Any] = {"Filter": [Name(n) for n in names]} if names else {}
    if chain in (8, 9):
        entries["DecodeParms"] = {"Predictor": 15 if chain == 8 else 2, "Columns": 4}
    return attach(skeleton(b""), {20: Stream(entries, body), 21: Stream({"Subtype": Name("Image"), "Filter": Name("DCTDecode")}, b"\xff\xd8" + data), 22: Stream({"Filter": Name("JBIG2Decode")}, data)})


@query("""
WITH t AS (SELECT p_partkey, substr(p_name, 1, (length(p_name) // 4 * 4)::INTEGER) AS plain FROM part)
SELECT p_partkey, 20 AS obj_num, p_partkey % 10 <> 7 AS supported, md5(plain) AS decoded_md5 FROM t UNION ALL SELECT p_partkey, 22, true, md5(plain) FROM t
""")
def pdf_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey", "p_name")
    found = E.streams(build(rows, with_filters)).filter("obj_num in (20, 22)")
    return found.select(F.col("path").cast("long").alias("p_partkey"), "obj_num", "supported", F.md5("decoded").alias("decoded_md5"))


def with_pixels(row: dict) -> Document:
    """Gray images 2 pixels wide: shades, black and white, a JPEG, and one that is too short."""
    s = row["s"]
    shades = bytes((s * (k + 1)) % 256 for k in range(4))
    doc = skeleton(b"", [shades, bytes(255 * (s >> k & 1) for k in range(4)), b"\xff\xd8jpeg", b"x"])
    for k in range(4):
        doc.objects[Ref(6 + k, 0)].dict |= {"Width": 2, "Height": 2}
    doc.objects[Ref(8, 0)].dict["Filter"] = Name("DCTDecode")
    return doc


@query("""
WITH s AS (SELECT s_suppkey, s_suppkey AS k, list_transform(range(4), lambda i: (s_suppkey * (i + 1)) % 256) AS g FROM supplier)
SELECT s_suppkey, 6 AS obj_num, 'png' AS format, CASE WHEN len(list_filter(g, lambda x: x NOT IN (0, 255))) = 0 THEN 'bits' ELSE 'gray' END AS kind, 2 AS width, false AS chosen_before, g[1] AS first_sample FROM s
UNION ALL SELECT s_suppkey, 7, 'png', 'bits', 2, true, 255 * (k % 2) FROM s
UNION ALL SELECT s_suppkey, 8, 'jpeg', NULL, NULL, false, NULL FROM s
UNION ALL SELECT s_suppkey, 9, 'raw', NULL, NULL, false, NULL FROM s
""")
def pdf_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction, previews of what can be decoded, and which chosen images have one already."""
    found = written(E.extract_images(build(suppliers(spark, sf_dir), with_pixels)))
    pngs = found.filter("format = 'png'")
    made = written(C.compress(pngs, C.CompressOptions()))
    before = made.filter("obj_num = 7")
    chosen = C.selected(found, found.select(*C.KEY), before).select(*C.KEY, F.col("has_preview").alias("chosen_before"))
    rest = C.without_preview(pngs, before)
    all_ = C.upsert(before, C.compress(rest, C.CompressOptions())).select(*C.KEY, "kind", F.col("width").alias("w"))
    first = E.samples(found).filter("format = 'png'").select(*C.KEY, F.conv(F.hex(F.substring("samples", 1, 1)), 16, 10).cast("long").alias("first_sample"))
    out = found.select(*C.KEY, "format").join(all_, C.KEY, "left").join(chosen, C.KEY, "left").join(first, C.KEY, "left")
    return out.select(supplier(), "obj_num", "format", "kind", F.col("w").alias("width"), F.coalesce("chosen_before", F.lit(False)).alias("chosen_before"), "first_sample")


def with_doubles(row: dict) -> Document:
    """Images of one size: 6 and 7 equal, 8 as long but different, 9 of another size."""
    s = row["s"]
    doc = skeleton(b"", [b"a" * (s % 40 + 1)] * 2 + [b"b" * (s % 40 + 1), b"c" * 5, b"d" * 50, b"d" * 50])
    doc.objects[Ref(9, 0)].dict["Width"] = 7
    for n in (10, 11):
        doc.objects[Ref(n, 0)].dict["Height"] = 3
    return doc


@query("""
SELECT s_suppkey, 1 AS position, '10 0,11 0' AS members, 50 AS savings, 5 AS candidates, md5(repeat('a', (s_suppkey % 40 + 1)::INTEGER)) AS bytes_md5 FROM supplier
UNION ALL SELECT s_suppkey, 2, '6 0,7 0', s_suppkey % 40 + 1, 5, md5(repeat('a', (s_suppkey % 40 + 1)::INTEGER)) FROM supplier
""")
def pdf_late_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by size from a parse without content, their bytes fetched late, and groups in order of savings."""
    files = build(suppliers(spark, sf_dir), with_doubles)
    light = written(P.parse_files(files, with_content=False))
    late = D.candidate_bytes(P.object_table(light), files).groupBy("path").agg(F.count("*").alias("candidates"), F.max(F.when(F.col("obj_num") == 6, F.md5("content"))).alias("bytes_md5"))
    groups = D.listed_duplicates(P.object_table(written(P.parse_files(files))))
    return groups.join(late, "path").select(supplier(), "position", F.array_join(F.col("members")["id"], ",").alias("members"), "savings", "candidates", "bytes_md5")


@query("""
SELECT s_suppkey, obj_num, CASE obj_num WHEN 20 THEN false WHEN 21 THEN true WHEN 22 THEN false WHEN 23 THEN false WHEN 24 THEN false END AS compressed FROM supplier, (VALUES (20), (21), (22), (23), (24)) n(obj_num)
""")
def pdf_compressed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = P.object_table(P.parse_files(build(suppliers(spark, sf_dir), with_streams), with_content=False)).filter("obj_num between 20 and 24")
    return objects.select(supplier(), "obj_num", D.already_compressed().alias("compressed"))


_GRAY = "floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE)::INTEGER"


def _level(channel: str, levels: int) -> str:
    return f"floor(floor({channel}::DOUBLE / 255 * {levels - 1} + 0.5::DOUBLE) / {levels - 1} * 255 + 0.5::DOUBLE)::INTEGER"


@query(f"""
WITH c AS (SELECT s_suppkey, (s_suppkey * 5) % 256 AS r, (s_suppkey * 11) % 256 AS g, CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey * 5) % 256 ELSE (s_suppkey * 17) % 256 END AS b FROM supplier),
     m AS (SELECT s_suppkey, 'none' AS mode, r, g, b FROM c UNION ALL SELECT s_suppkey, 'grayscale', {_GRAY}, {_GRAY}, {_GRAY} FROM c
           UNION ALL SELECT s_suppkey, 'binary', 255 * ({_GRAY} >= 180)::INTEGER, 255 * ({_GRAY} >= 180)::INTEGER, 255 * ({_GRAY} >= 180)::INTEGER FROM c
           UNION ALL SELECT s_suppkey, '64', {_level("r", 4)}, {_level("g", 4)}, {_level("b", 4)} FROM c UNION ALL SELECT s_suppkey, '16', {_level("r", 4)}, {_level("g", 2)}, {_level("b", 2)} FROM c)
SELECT s_suppkey, mode, CASE WHEN r <> g OR g <> b THEN 'rgb' WHEN r IN (0, 255) THEN 'bits' ELSE 'gray' END AS kind,
       CASE WHEN r <> g OR g <> b THEN printf('%02X%02X%02X', r, g, b) WHEN r = 0 THEN '00' WHEN r = 255 THEN '80' ELSE printf('%02X', r) END AS samples FROM m
""")
def pdf_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel through every kind of colour reduction."""

    def make(row: dict) -> Document:
        s = row["s"]
        r = s * 5 % 256
        doc = skeleton(b"", [bytes((r, s * 11 % 256, r if s % 4 == 0 else s * 17 % 256))])
        doc.objects[Ref(6, 0)].dict["ColorSpace"] = Name("DeviceRGB")
        return doc

    found = written(E.extract_images(build(suppliers(spark, sf_dir), make)))
    out = None
    for mode in ("none", "grayscale", "binary", "64", "16"):
        some = C.compress(found, C.CompressOptions(colours=mode)).select(supplier(), F.lit(mode).alias("mode"), "kind", F.hex("data").alias("samples"))
        out = some if out is None else out.unionByName(some)
    return out


@query("""
WITH s AS (SELECT s_suppkey, floor(((s_suppkey % 256) + (s_suppkey * 2) % 256 + (s_suppkey * 3) % 256 + (s_suppkey * 4) % 256) / 4.0::DOUBLE + 0.5::DOUBLE)::INTEGER AS v FROM supplier)
SELECT s_suppkey, CASE WHEN v IN (0, 255) THEN 'bits' ELSE 'gray' END AS kind, CASE v WHEN 0 THEN '00' WHEN 255 THEN '80' ELSE printf('%02X', v) END AS samples, 1 AS width, 1 AS height FROM s
""")
def pdf_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shades at half the size: their average."""
    found = E.extract_images(build(suppliers(spark, sf_dir), with_pixels)).filter("obj_num = 6")
    return C.compress(found, C.CompressOptions(scale=0.5)).select(supplier(), "kind", F.hex("data").alias("samples"), "width", "height")


@query("SELECT s_suppkey, CASE WHEN (s_suppkey * 7) % 900 + 1 > 400 THEN 400 ELSE (s_suppkey * 7) % 900 + 1 END AS width, CASE WHEN (s_suppkey * 7) % 900 + 1 > 800 THEN 1 WHEN (s_suppkey * 7) % 900 + 1 > 400 THEN round_even(800.0 / ((s_suppkey * 7) % 900 + 1), 0)::INTEGER ELSE 2 END AS height FROM supplier")
def pdf_preview_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of images two pixels high and up to 900 wide."""

    def make(row: dict) -> Document:
        width = row["s"] * 7 % 900 + 1
        doc = skeleton(b"", [b"p" * (2 * width)])
        doc.objects[Ref(6, 0)].dict |= {"Width": width, "Height": 2}
        return doc

    return C.preview_pngs(E.extract_images(build(suppliers(spark, sf_dir), make))).select(supplier(), "width", "height")
