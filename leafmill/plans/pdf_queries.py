"""Queries over PDF files that are built from the driver's tables, so that SQL can say what must come out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from leafmill.operators import documents as D
from leafmill.operators import extract as E
from leafmill.operators import pages as G
from leafmill.operators import rewrite as W
from leafmill.sources import pdf_tables as P
from leafmill.sources.pdf_file import Document, Name, Ref, Stream, serialise

from .catalog import query
from .lineage import written
from .relational import read


def skeleton(content: bytes, images: list[bytes] = ()) -> Document:
    """Catalog 1, page tree 2, page 3, content 4, an orphan 5, and images from 6 on."""
    doc = Document(trailer={"Root": Ref(1, 0)})
    names = {f"Im{k}": Ref(6 + k, 0) for k in range(len(images))}
    doc.objects[Ref(1, 0)] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
    doc.objects[Ref(2, 0)] = {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1}
    doc.objects[Ref(3, 0)] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(4, 0), "Resources": {"XObject": names}}
    doc.objects[Ref(4, 0)] = Stream({}, content)
    doc.objects[Ref(5, 0)] = {"Orphan": True}
    for k, data in enumerate(images):
        entries = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 1, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}
        doc.objects[Ref(6 + k, 0)] = Stream(entries, data)
    return doc


def build(rows: DataFrame, make: Callable[[dict], Document | bytes]) -> DataFrame:
    """(path, content) and all other columns: one file per row; ``rows`` has a column ``path``."""
    names = rows.columns
    arrow = to_arrow_schema(rows.schema).append(pa.field("content", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                row = {k: v.as_py() for k, v in zip(names, values, strict=True)}
                made = make(row)
                row["content"] = made if isinstance(made, bytes) else serialise(made)
                out.append(row)
                held += P.ROW_BYTES + len(row["content"])
                if held > P.BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("content", BinaryType())]))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return build(rows, lambda r: skeleton(r["text"].encode()))


@query("""
SELECT doc_id, 'ok' AS parse_status, 1 AS page_count, 5::BIGINT AS total_objects, 1::BIGINT AS unused_objects, 3::BIGINT AS structure,
       octet_length(encode(text))::BIGINT AS content_bytes FROM documents
""")
def pdf_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.summary(P.parse_files(_documents(spark, sf_dir), with_content=False))
    return found.select(F.col("path").cast("long").alias("doc_id"), "parse_status", "page_count", "total_objects", "unused_objects", F.col("n_structure").alias("structure"), F.col("stream_bytes").alias("content_bytes"))


@query("SELECT doc_id, 'ok' AS status, 4::BIGINT AS objects, md5(text) AS content_md5 FROM documents")
def pdf_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    pruned = written(W.prune_files(_documents(spark, sf_dir)))
    counts = D.summary(P.parse_files(pruned, with_content=False)).select("path", F.col("total_objects").alias("objects"))
    texts = G.contents(pruned).select("path", F.md5("content").alias("content_md5"))
    out = pruned.select("path", "status").join(counts, "path").join(texts, "path")
    return out.select(F.col("path").cast("long").alias("doc_id"), "status", "objects", "content_md5")


@query("""
SELECT p_partkey, n.k + 1 AS nth, p_size::DOUBLE * n.k + p_partkey % 50 AS x, (p_partkey % 70)::DOUBLE AS y, p_size::DOUBLE AS scale
FROM part, (VALUES (0), (1), (2)) AS n(k)
""")
def pdf_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(row: dict) -> Document:
        s, key = row["p_size"], row["p_partkey"]
        draws = b" ".join(b"q %d 0 0 %d %d 0 cm /Im0 Do Q" % (s, s, s * k) for k in range(3))
        return skeleton(b"q 1 0 0 1 %d %d cm %s Q Q" % (key % 50, key % 70, draws), [b"\x00"])

    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey", "p_size")
    found = G.placements(build(rows, make))
    nth = F.floor((F.col("op_idx") - 2) / 4).cast("int")
    return found.select(F.col("path").cast("long").alias("p_partkey"), (nth + 1).alias("nth"), "x", "y", F.col("ctm")[0].alias("scale"))


@query("""
WITH d AS (SELECT n_chars % 50 AS bucket, md5(text) AS h, octet_length(encode(text)) AS n FROM documents)
SELECT bucket::BIGINT AS bucket, count(*)::BIGINT AS groups, sum(s)::BIGINT AS savings FROM (SELECT bucket, h, sum(n) - min(n) AS s FROM d GROUP BY bucket, h HAVING count(*) > 1) GROUP BY bucket
""")
def pdf_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").groupBy((F.col("n_chars") % 50).cast("string").alias("path")).agg(F.collect_list("text").alias("texts"))
    files = build(rows, lambda r: skeleton(b"", [t.encode() for t in r["texts"]]))
    groups = D.duplicate_images(P.object_table(P.parse_files(files)))
    return groups.groupBy(F.col("path").cast("long").alias("bucket")).agg(F.count("*").alias("groups"), F.sum("savings").alias("savings"))


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'raw' ELSE 'png' END AS format, coalesce(text, '') <> '' AS supported, md5(coalesce(text, '')) AS samples_md5 FROM documents")
def pdf_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as the samples of a gray image of one line, extracted to PNG and read back."""

    def make(row: dict) -> Document:
        doc = skeleton(b"", [row["text"].encode()])
        doc.objects[Ref(6, 0)].dict["Width"] = len(doc.objects[Ref(6, 0)].data)
        return doc

    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    found = E.samples(E.extract_images(build(rows, make)))
    return found.select(F.col("path").cast("long").alias("doc_id"), "format", "supported", F.md5("samples").alias("samples_md5"))
