"""The corpus pipeline: toxicity, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.

Nulls: null or empty texts are neither toxic, nor copies, nor contaminated, and
count as no tokens: they pass all stages once. Rows with a null doc_id link with
nothing and pass likewise unless toxic or contaminated. Equal rows are one
document from the second stage on; texts of one doc_id stand or fall each for
itself. Empty tables pass as empty; with an empty ``labels`` nothing is toxic and all
is one domain; with an empty ``benchmark`` nothing is contaminated. Very long texts
are scored whole. Extra columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import decontaminate, jaccard, mixing, resharding, toxicity
from spanwise.llm.queries import language_labels
from spanwise.llm.shared import Scratch, fresh, stage_table, unstage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score of 0.5 or more) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (score,) = fresh(docs, "__toxic")
    model = toxicity.fit_labelled(docs, labels)
    if not model.examples:  # its score is 0.5 for all: nothing is known to be toxic
        return docs
    scored = toxicity.score(docs, model, score)
    return scored.where(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least doc_id."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are hit by benchmark windows to a twentieth or more go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarcer languages repeat until expected tokens follow tempered weights; none is lost."""
    return mixing.mixed(docs, language_labels(spark, sf_dir))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard (of 40 of near-equal bytes) and slot, moving the fewest bytes from the files they lie in.

    Columns that are called so already keep their names; the stage's own ones get underscores before.
    """
    out = resharding.reshard(docs)
    shard_, slot = fresh(docs, "shard", "slot")
    return out.rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(out.shard).alias(shard_), F.col(out.slot).alias(slot))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: The stages train and apply models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; of the tables in the shared folder only the result's stays."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with Scratch(spark) as scratch:
            after = scratch.keep(stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if docs is not before:
            unstage(docs)
        docs = after
    return docs
