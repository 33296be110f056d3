"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm.audit import AUDIT_SQL, filter_audit
from groundspark.llm.bpe import byte_bpe
from groundspark.llm.classifier import classified
from groundspark.llm.common import documents
from groundspark.llm.jaccard import similar_groups
from groundspark.llm.lines import deduplicated_lines
from groundspark.llm.media import media_columns
from groundspark.llm.mixing import MIX_SQL, mixed_words
from groundspark.llm.pii import personal_data
from groundspark.llm.ranked import RANKED_SQL, ranked_documents
from groundspark.llm.rules import quality_rules
from groundspark.llm.substring import deduplicated_words
from groundspark.llm.suffix import deduplicated_bytes
from groundspark.llm.urls import URL_SQL, url_verdicts


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_words(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_bytes(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = deduplicated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return lines.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_bpe": op5_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_media": op9_media,
    "op10_classifier": op10_classifier,
    "op11_url_filters": op11_url_filters,
    "op12_filter_audit": op12_filter_audit,
    "op13_ranked_search": op13_ranked_search,
}
SQL: dict[str, str] = {"op2_mixing": MIX_SQL, "op11_url_filters": URL_SQL, "op12_filter_audit": AUDIT_SQL, "op13_ranked_search": RANKED_SQL}
