"""The registered queries of the corpus operators: digest columns over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .decontaminate import contained_items
from .jaccard_join import jaccard_components
from .licenses import build_index, scan_licenses
from .oracles import SQL
from .quality import fit_quality, quality_scores
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import fit_toxicity, toxicity_scores
from .url_filter import RULES, filter_urls, ruled
from .vector_search import top_inner_products


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return scan_licenses(docs, build_index(docs)).drop("places")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(_read(spark, sf_dir, "documents"), tokenizer_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, _read(spark, sf_dir, "labels")))


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"), shingle=4, threshold=(85, 100))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, _read(spark, sf_dir, "labels")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_licenses that SQL can express."""
    return op2_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_url_filter that SQL can express, and the verdict of the rule alone."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return ruled(pages, RULES).select("page_id", "host", "path", "rule", F.col("ruled").alias("rule_verdict"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_licenses": op2_licenses,
        "op3_bpe": op3_bpe,
        "op4_toxicity": op4_toxicity,
        "op5_vector_search": op5_vector_search,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_quality": op8_quality,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_url_filter": op10_url_filter,
        "license_base": license_base,
        "url_rules": url_rules,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
