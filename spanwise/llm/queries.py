"""Queries over the shared tables, one for each operator, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, language, mixing, neighbours, quality, resharding, secrets, toxicity
from .shared import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of domains: the language of each document that ``labels`` covers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.prefix_target_examples(turns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, _ = mixing.fit_rates(docs, mixing.classifier(docs, language_labels(spark, sf_dir)), mixing.tempered(0.5))
    out, (tokens, domain, rate, copies) = mixing.apply_rates(docs, model)
    return out.select("doc_id", F.col(tokens).alias("n_tokens"), F.col(domain).alias("domain"), F.round(rate, 6).alias("rate"), F.col(copies).alias("copies"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = neighbours.build_index(table(spark, sf_dir, "embeddings"))
    return neighbours.search(index, index.where("vec_id % 50 = 0").select("vec_id", "v"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.shard_report(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "resharded"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted_languages(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.shingle_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_mixing": op2_mixing,
    "op3_neighbours": op3_neighbours,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_resharding": op7_resharding,
    "op8_secrets": op8_secrets,
    "op9_language": op9_language,
    "op10_jaccard": op10_jaccard,
}

ORACLES: dict[str, str] = {
    "op1_chat": chat.ORACLE,
    "op3_neighbours": neighbours.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op10_jaccard": jaccard.ORACLE,
}
