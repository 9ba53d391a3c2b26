"""Queries of the ten operators over the driver's tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import common as C
from quirefold.llm import chat, decontam, htmltext, linededup, mixing, neardup, quality, rules, secrets, tokencount


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(C.table(spark, sf_dir, "documents").select("doc_id", "text"), C.table(spark, sf_dir, "labels"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.rated(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.leaks(docs, C.table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.rated(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rated(C.table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(C.table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_chat_format(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """path: the vocabulary file of the tokenizer, found beside the public tokenizers' module if not given."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    convs = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.formatted(convs, path or _tokenizer_file("byte_bpe_50k.json")))


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """path: the vocabulary file of the tokenizer, found beside the public tokenizers' module if not given."""
    return tokencount.counted(C.table(spark, sf_dir, "documents").select("doc_id", "text"), path or _tokenizer_file("word_bpe_49k.json"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = mixing.plan_mix(C.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return of.select(F.col("_doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_grade": op1_quality_grade,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_text": op6_html_text,
    "op7_secret_scan": op7_secret_scan,
    "op8_chat_format": op8_chat_format,
    "op9_token_counts": op9_token_counts,
    "op10_mix_sources": op10_mix_sources,
}
