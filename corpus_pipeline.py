"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, tokenise.

Each stage works on what its predecessor kept and returns the columns of ``documents``; the last one
returns token ids.  Stages:

* ``quality``: documents below the classifier's threshold go;
* ``near_duplicates``: of each component of the 5-word Jaccard join at 0.8 the document with the smallest id stays;
* ``repeats``: bytes of 100-byte strings that stand earlier go, and characters that such a run cuts go whole;
  a text that a repeat covered whole becomes empty and stays, ``n_chars`` follows texts that change;
* ``contamination``: documents that contain a benchmark item go;
* ``tokens``: token ids of the byte-level BPE, with the text that they decode to.

Rows with a null id pass ``near_duplicates`` and ``repeats`` unchanged.  Rows with equal ids and different texts
are different documents to them, rows with equal ids and texts one that stays or goes whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.bpe import bpe_round_trip
from leafmill.llm.decontaminate import drop_contaminated
from leafmill.llm.jaccard_join import drop_near_duplicates
from leafmill.llm.quality import fit_quality, keep_quality
from leafmill.llm.queries import tokenizer_path
from leafmill.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, shingle=5, threshold=(80, 100))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs, length_col="n_chars")


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(docs, tokenizer_path())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("contamination", contamination), ("tokens", tokens)]

#: A learned classifier and a tokenizer are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
