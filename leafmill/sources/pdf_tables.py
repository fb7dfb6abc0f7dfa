"""PDF files as tables.

``read_files`` gives (path, content); ``parse_files`` turns them into one row per object with a row per
file beside it.  Parsing is a map over files, so a file is the unit of work; rows go out
in batches of bounded bytes.  A file that cannot be parsed is a row
with a status, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .pdf_file import ROOT_KEYS, Document, Name, PdfError, Ref, Stream, filter_lists, parse, references

OBJECT_SCHEMA = (
    "path string, record string, file_size long, pdf_version string, page_count int, parse_status string, parse_error string, complete_tail boolean, "
    "obj_num long, gen int, kind string, type string, subtype string, dict string, stream_len long, content binary, size_est long, size_est_json long, "
    "has_length1 boolean, refs array<struct<num:long,gen:int>>, root_of array<string>, reachable boolean, page int, "
    "mediabox array<double>, xobjects array<struct<name:string,num:long,gen:int>>, filters array<string>"
)
DEFAULT_BOX = [0.0, 0.0, 595.0, 842.0]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the PDF files in a folder, of any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")


def as_json(value: Any) -> Any:
    """Names as ``/X``, references as ``N G R``, strings as ``u:...``."""
    if isinstance(value, Name):
        return "/" + value
    if isinstance(value, Ref):
        return f"{value.num} {value.gen} R"
    if isinstance(value, bytes):
        return "u:" + (value[2:].decode("utf-16-be", "replace") if value[:2] == b"\xfe\xff" else value.decode("utf-8", "replace"))
    if isinstance(value, list):
        return [as_json(v) for v in value]
    if isinstance(value, dict):
        return {k: as_json(v) for k, v in value.items()}
    return value


def size_estimate(value: Any) -> int:
    """Rough size by kind, recursively."""
    if isinstance(value, Stream):
        return len(value.data) + size_estimate(value.dict)
    if isinstance(value, dict):
        return sum(len(k.encode()) + 4 + size_estimate(v) for k, v in value.items())
    if isinstance(value, list):
        return 8 + sum(map(size_estimate, value))
    if isinstance(value, Name):
        return len(value.encode()) + 4
    if isinstance(value, bytes):
        return len(value) + 4
    if isinstance(value, bool):
        return 5
    return 4 if value is None else 16


def json_size_estimate(value: Any) -> int:
    """Size by the JSON rule: streams by a whole-number Length (else 0) of at least 256, dictionaries by their text, at least 64."""
    if isinstance(value, Stream):
        n = value.dict.get("Length")
        return max(n if isinstance(n, int) and not isinstance(n, bool) else 0, 256)
    if isinstance(value, dict):
        return max(len(json.dumps(as_json(value), ensure_ascii=False, separators=(",", ":"))), 64)
    return 128


def kind_of(value: Any) -> str:
    for kind, types in (("stream", Stream), ("dictionary", dict), ("array", list), ("name", Name), ("string", bytes), ("boolean", bool), ("integer", int), ("real", float), ("reference", Ref)):
        if isinstance(value, types):
            return kind
    return "null"


def media_box(page: dict[str, Any], doc: Document) -> list[float]:
    box = doc.get(page.get("MediaBox"))
    values = [doc.get(x) for x in box] if isinstance(box, list) else []
    numbers = [float(x) for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
    return numbers if len(numbers) == 4 and len(values) == 4 else DEFAULT_BOX


def _rows(path: str, content: bytes, with_content: bool, only_images: bool) -> Iterator[dict[str, Any]]:
    tail = content[-512:]
    file = {"path": path, "record": "file", "file_size": len(content), "complete_tail": b"%%EOF" in tail or b"%PDF-" in tail}
    try:
        doc = parse(content)
    except (PdfError, RecursionError, ValueError, TypeError, IndexError) as e:
        yield file | {"parse_status": "failed", "parse_error": str(e)[:200] or type(e).__name__}
        return
    pages = doc.pages()
    number = {r: k + 1 for k, r in enumerate(pages)}
    status = "encrypted" if "Encrypt" in doc.trailer else "ok"
    yield file | {"pdf_version": doc.version, "page_count": doc.page_count() or len(pages), "parse_status": status}
    seen = doc.reachable()
    roots: dict[Ref, list[str]] = {}
    for key in ROOT_KEYS:
        if isinstance(doc.trailer.get(key), Ref):
            roots.setdefault(doc.trailer[key], []).append(key)
    for ref, value in doc.objects.items():
        d = value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else None
        kind = kind_of(value)
        name = {k: str(v) for k in ("Type", "Subtype") if d is not None and isinstance(v := doc.get(d.get(k)), Name)}
        if only_images and kind == "stream" and name.get("Subtype") != "Image":
            continue
        row = {"path": path, "record": "object", "obj_num": ref.num, "gen": ref.gen, "kind": kind, "type": name.get("Type"), "subtype": name.get("Subtype")}
        row |= {"size_est": size_estimate(value), "size_est_json": json_size_estimate(value), "reachable": ref in seen, "root_of": roots.get(ref), "page": number.get(ref)}
        row["refs"] = [{"num": r.num, "gen": r.gen} for r in sorted(set(references(value)))]
        if d is not None:
            row |= {"dict": json.dumps(as_json(d), ensure_ascii=False), "has_length1": "Length1" in d}
        if isinstance(value, Stream):
            row |= {"stream_len": len(value.data), "filters": filter_lists(doc, value.dict)[0]}
            if with_content:
                row["content"] = value.data
        if ref in number:
            row |= {"mediabox": media_box(d or {}, doc), "xobjects": [{"name": k, "num": r.num, "gen": r.gen} for k, r in doc.xobjects(ref).items()]}
        yield row


#: Bytes of rows in one Arrow batch; also what a row counts for beside its binary values.
BATCH_BYTES, ROW_BYTES = 16_000_000, 500


def map_files(files: DataFrame, schema: str, rows_of: Callable[..., Iterable[dict[str, Any]]], *extra: str) -> DataFrame:
    """Rows of every file, in Arrow batches of bounded bytes.  ``rows_of(path, content, *extra)`` gives dictionaries."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                path, content, *more = (v.as_py() for v in values)
                for row in rows_of(path, content or b"", *more):
                    rows.append(row)
                    held += ROW_BYTES + sum(len(v) for v in row.values() if isinstance(v, bytes))
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("path", "content", *extra).mapInArrow(run, schema)


def parse_files(files: DataFrame, with_content: bool = True, only_images: bool = False) -> DataFrame:
    """One row per file (``record`` = file) and one per object; see OBJECT_SCHEMA."""
    return map_files(files, OBJECT_SCHEMA, lambda path, content: _rows(path, content, with_content, only_images))


def opened(content: bytes) -> Document | None:
    """The document, None if it cannot be parsed."""
    try:
        return parse(content)
    except (PdfError, RecursionError, ValueError, TypeError, IndexError):
        return None


def file_table(parsed: DataFrame) -> DataFrame:
    return parsed.filter("record = 'file'").select("path", "file_size", "pdf_version", "page_count", "parse_status", "parse_error", "complete_tail")


def object_table(parsed: DataFrame) -> DataFrame:
    """Objects with their dictionary as VARIANT."""
    out = parsed.filter("record = 'object'").drop("record", "file_size", "pdf_version", "page_count", "parse_status", "parse_error", "complete_tail")
    return out.withColumn("dict", F.try_parse_json("dict"))


def edge_table(parsed: DataFrame) -> DataFrame:
    """Distinct references from object to object."""
    edges = parsed.filter("record = 'object'").select("path", F.col("obj_num").alias("src_num"), F.col("gen").alias("src_gen"), F.explode("refs").alias("r"))
    return edges.select("path", "src_num", "src_gen", F.col("r.num").alias("dst_num"), F.col("r.gen").alias("dst_gen"))


def root_table(parsed: DataFrame) -> DataFrame:
    roots = parsed.filter("root_of is not null").select("path", F.explode("root_of").alias("trailer_key"), "obj_num", "gen")
    return roots


def page_table(parsed: DataFrame) -> DataFrame:
    return parsed.filter("page is not null").select("path", "page", "obj_num", "gen", "mediabox")


def page_xobject_table(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter("page is not null").select("path", "page", F.explode("xobjects").alias("x"))
    return rows.select("path", "page", "x.name", F.col("x.num").alias("obj_num"), F.col("x.gen").alias("gen"))
