"""Analysis of parsed PDF files: categories, fonts, unreachable objects, duplicate images, summaries.

Inputs are the parsed table of :mod:`leafmill.sources.pdf_tables` (write it once, read it often).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import display_name
from leafmill.sources import pdf_tables as P

from . import tables as O

# The categories in order, font program markers, keys of an information dictionary, and filters
# that count as compressed.
CATEGORIES = ["images", "fonts", "content", "forms", "metadata", "structure", "other_streams", "unused"]
LARGE_CATEGORIES = ["images", "fonts", "content", "forms", "metadata", "structure", "unused"]
FONT_SUBTYPES = ["Type1C", "OpenType", "CIDFontType0C"]
INFO_KEYS = ["Creator", "Producer", "Title", "Author", "Subject", "Keywords", "CreationDate", "ModDate"]
COMPRESSED = ["FlateDecode", "LZWDecode", "DCTDecode", "CCITTFaxDecode", "JPXDecode", "RunLengthDecode"]
COMPRESSED_IN_ARRAY = ["FlateDecode", "LZWDecode"]
FONT_FILES = ["FontFile", "FontFile2", "FontFile3"]


def entry(key: str, kind: str = "string") -> Column:
    return F.try_variant_get("dict", f"$.{key}", kind)


def is_font_program(with_length1: bool = True) -> Column:
    out = F.coalesce(F.col("subtype").isin(FONT_SUBTYPES), F.lit(False)) | F.coalesce(F.col("type") == "FontFile", F.lit(False))
    return out | F.coalesce(F.col("has_length1"), F.lit(False)) if with_length1 else out


def category() -> Column:
    """First rule that holds; null for plain reachable values, which belong to no category."""
    stream, dictionary = F.col("kind") == "stream", F.col("kind") == "dictionary"
    info = None
    for key in INFO_KEYS:
        has = entry(key, "variant").isNotNull()
        info = has if info is None else info | has
    return (
        F.when(stream & (F.col("subtype") == "Image"), "images")
        .when(stream & is_font_program(), "fonts")
        .when(stream & (F.col("type") == "Metadata"), "metadata")
        .when(stream & (F.col("subtype") == "Form"), "forms")
        .when(stream & entry("Length", "variant").isNotNull() & (F.col("stream_len") > 0), "content")
        .when(stream, "other_streams")
        .when(~F.col("reachable"), "unused")
        .when(dictionary & info, "metadata")
        .when(dictionary, "structure")
    )


def font_programs(objects: DataFrame) -> DataFrame:
    """Distinct objects that a descriptor names as its font program."""
    found = None
    for key in FONT_FILES:
        some = objects.select("path", entry(key).alias("ref")).filter("ref rlike '^[0-9]+ [0-9]+ R$'")
        found = some if found is None else found.unionByName(some)
    return found.select("path", F.split("ref", " ")[0].cast("long").alias("obj_num"), F.split("ref", " ")[1].cast("int").alias("gen")).distinct()


def large_category(objects: DataFrame) -> DataFrame:
    """Objects with the category of the rule for large files: font programs by reference, all other streams content."""
    marked = objects.join(font_programs(objects).withColumn("program", F.lit(True)), ["path", "obj_num", "gen"], "left")
    stream = F.col("kind") == "stream"
    rule = (
        F.when(stream & (F.col("subtype") == "Image"), "images")
        .when(stream & (F.col("subtype") == "Form"), "forms")
        .when(stream & ((F.col("subtype") == "Metadata") | (F.col("type") == "Metadata")), "metadata")
        .when(stream & F.col("program"), "fonts")
        .when(stream, "content")
        .when(~F.col("reachable"), "unused")
        .otherwise("structure")
    )
    return marked.withColumn("category", rule).drop("program")


def components(objects: DataFrame, rule: str = "small") -> DataFrame:
    """Count and size of every category of every file, zero-filled, in fixed order."""
    if rule == "small":
        out = O.category_rollup(objects.withColumn("c", category()).filter("c is not null"), F.col("c"), F.col("size_est"), CATEGORIES, ["path"])
    else:
        out = O.category_rollup(large_category(objects), F.col("category"), F.col("size_est_json"), LARGE_CATEGORIES, ["path"])
    return out.withColumn("display", display_name(F.col("category")))


def unused_objects(objects: DataFrame) -> DataFrame:
    return objects.filter("not reachable").groupBy("path").agg(F.count("*").alias("unused_objects"), F.sum("size_est").alias("unused_size"))


def fonts(objects: DataFrame) -> DataFrame:
    """Font dictionaries with name, subtype, whether a program is embedded (its reference resolves), and size
    (font, descriptor and programs)."""
    key = ["path", "obj_num", "gen"]
    font = objects.filter("kind = 'dictionary' and type = 'Font'").select(*key, F.ltrim(F.coalesce(entry("BaseFont"), F.lit("Unknown")), F.lit("/")).alias("name"), F.coalesce("subtype", F.lit("Unknown")).alias("subtype"), entry("FontDescriptor").alias("dref"), F.col("size_est").alias("own"))
    sizes = objects.select("path", F.concat_ws(" ", "obj_num", "gen", F.lit("R")).alias("ref"), F.col("size_est").alias("size"), "kind", *[entry(k).alias(k) for k in FONT_FILES])
    descriptor = sizes.filter("kind = 'dictionary'").select("path", F.col("ref").alias("dref"), F.col("size").alias("dsize"), *FONT_FILES)
    out = font.join(descriptor, ["path", "dref"], "left")
    programs = sizes.filter("kind = 'stream'").select("path", "ref", "size")
    for k in FONT_FILES:
        out = out.join(programs.withColumnsRenamed({"ref": k, "size": f"size_{k}"}), ["path", k], "left")
    total = F.col("own") + F.coalesce("dsize", F.lit(0))
    embedded = F.lit(False)
    for k in FONT_FILES:
        total = total + F.coalesce(f"size_{k}", F.lit(0))
        embedded = embedded | F.col(f"size_{k}").isNotNull()
    return out.select(*key, "name", "subtype", embedded.alias("embedded"), total.alias("size"))


def images(objects: DataFrame) -> DataFrame:
    """Image headers: size, colour space (first name of an array, else Unknown), bits, filters, predictor."""
    space = F.coalesce(F.try_variant_get("dict", "$.ColorSpace[0]", "string"), entry("ColorSpace"), F.lit("/Unknown"))
    predictor = F.coalesce(F.try_variant_get("dict", "$.DecodeParms[0].Predictor", "int"), F.try_variant_get("dict", "$.DecodeParms.Predictor", "int"), F.lit(1))
    rows = objects.filter("kind = 'stream' and subtype = 'Image'")
    return rows.select(
        "path", "obj_num", "gen", entry("Width", "double").cast("long").alias("width"), entry("Height", "double").cast("long").alias("height"),
        F.when(space.startswith("/"), F.ltrim(space, F.lit("/"))).otherwise("Unknown").alias("color_space"), F.coalesce(entry("BitsPerComponent", "double").cast("int"), F.lit(8)).alias("bits"),
        "filters", predictor.alias("predictor"), F.col("stream_len").alias("pdf_size"),
    )


def fingerprint() -> Column:
    """Of the bytes and the dictionary: equal pixels under different dictionaries differ."""
    return F.sha2(F.concat(F.coalesce("content", F.lit(b"")), F.to_json("dict").cast("binary")), 256)


def duplicate_images(objects: DataFrame) -> DataFrame:
    """Groups of images with equal bytes and dictionary in one file, with members by size and savings."""
    rows = objects.filter("kind = 'stream' and subtype = 'Image'")
    rows = rows.withColumns({"width": entry("Width", "int"), "height": entry("Height", "int"), "object_id": F.concat_ws(" ", "obj_num", "gen")})
    return O.duplicate_members(rows, ["path", "width", "height"], fingerprint(), "stream_len", "object_id")


def reused_images(parsed: DataFrame) -> DataFrame:
    """Images that several page resources name, outside duplicate groups: occurrences and pages."""
    objects = P.object_table(parsed)
    used = P.page_xobject_table(parsed).join(images(objects).select("path", "obj_num", "gen", "width", "height", "pdf_size"), ["path", "obj_num", "gen"])
    counted = used.groupBy("path", "obj_num", "gen", "width", "height", "pdf_size").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("page")).alias("pages")).filter("occurrences > 1")
    grouped = duplicate_images(objects).select("path", F.explode("members.id").alias("object_id"))
    return counted.withColumn("object_id", F.concat_ws(" ", "obj_num", "gen")).join(grouped, ["path", "object_id"], "left_anti")


def listed_duplicates(objects: DataFrame) -> DataFrame:
    """Duplicate groups of every file in order: largest savings first, then by first member."""
    order = Window.partitionBy("path").orderBy(F.desc("savings"), F.col("members")[0]["id"])
    return duplicate_images(objects).withColumn("position", F.row_number().over(order))


def candidate_bytes(objects: DataFrame, files: DataFrame, with_content: bool = True) -> DataFrame:
    """Images that share width and height with another one of their file, with their bytes.

    ``objects`` may come from a parse without content: the bytes of the candidates alone are then fetched
    from ``files``, in a second pass over the files that have any.
    """
    sized = images(objects).select("path", "obj_num", "gen", "width", "height")
    several = Window.partitionBy("path", "width", "height")
    chosen = sized.withColumn("n", F.count("*").over(several)).filter("n > 1").drop("n")
    some = files.join(chosen.select("path").distinct(), "path", "left_semi")
    again = P.parse_files(some, with_content=with_content, only_images=True).filter("kind = 'stream'")
    return chosen.join(again.select("path", "obj_num", "gen", "stream_len", "content"), ["path", "obj_num", "gen"])


def already_compressed() -> Column:
    """A single filter of the list, or an array that holds one of the two general ones."""
    single = entry("Filter").isin(["/" + f for f in COMPRESSED])
    return F.coalesce(single, F.lit(False)) | F.coalesce((F.size("filters") > 0) & ~entry("Filter").startswith("/") & F.arrays_overlap("filters", F.array(*[F.lit(f) for f in COMPRESSED_IN_ARRAY])), F.lit(False))


def other_of_file(files: DataFrame, parts: DataFrame) -> DataFrame:
    """Bytes and objects of every file outside its categories: never negative."""
    known = parts.groupBy("path").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    left = files.join(known, "path", "left")
    return left.select(
        "path", F.greatest(F.col("file_size") - F.coalesce("size", F.lit(0)), F.lit(0)).alias("other_size"),
        F.greatest(F.col("total_objects") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("other_count"),
    )


def summary(parsed: DataFrame) -> DataFrame:
    """One row per file in one pass and one shuffle: status, objects, stream bytes, count and size of each category."""
    rows = parsed.withColumn("dict", F.try_parse_json("dict")).withColumn("category", category())
    object_ = F.col("record") == "object"
    first = ["file_size", "pdf_version", "page_count", "parse_status", "parse_error", "complete_tail"]
    sums = [
        F.count_if(object_).alias("total_objects"),
        F.count_if(object_ & ~F.col("reachable")).alias("unused_objects"),
        F.coalesce(F.sum(F.when(F.col("kind") == "stream", F.col("stream_len"))), F.lit(0)).alias("stream_bytes"),
    ]
    for c in CATEGORIES:
        mine = F.col("category") == c
        sums += [F.count_if(object_ & mine).alias(f"n_{c}"), F.coalesce(F.sum(F.when(object_ & mine, F.col("size_est"))), F.lit(0)).alias(f"size_{c}")]
    return rows.groupBy("path").agg(*[F.max(c).alias(c) for c in first], *sums)


def analyse(parsed: DataFrame, rule: str = "small") -> DataFrame:
    """One row per file: sizes, version, pages, components, fonts, unused objects, duplicates and possible savings."""
    objects = P.object_table(parsed)
    facts = summary(parsed)
    if rule == "small":
        parts = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(c).alias("category"), F.col(f"n_{c}").alias("n"), F.col(f"size_{c}").alias("size")) for k, c in enumerate(CATEGORIES)])
        out = facts.withColumns({"components": F.when(F.col("total_objects") > 0, parts), "potential_savings": F.col("size_unused") + F.col("size_metadata")})
    else:
        parts = components(objects, rule).groupBy("path").agg(
            F.array_sort(F.collect_list(F.struct("position", "category", "n", "size"))).alias("components"), F.sum(F.when(F.col("category") == "unused", F.col("size")).otherwise(0)).alias("potential_savings")
        )
        out = facts.join(parts, "path", "left")
    out = out.drop("stream_bytes", *[f"{k}_{c}" for c in CATEGORIES for k in ("n", "size")])
    listed = fonts(objects).groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "name", "subtype", "embedded", "size"))).alias("fonts"))
    doubles = duplicate_images(objects).groupBy("path").agg(F.count("*").alias("duplicate_groups"), F.sum("savings").alias("duplicate_savings"))
    for more in (listed, doubles):
        out = out.join(more, "path", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("potential_savings", "duplicate_groups", "duplicate_savings")}
    return out.withColumns(zero)
