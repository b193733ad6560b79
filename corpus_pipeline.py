"""A training-corpus pipeline: five stages over documents.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. Stages that decide by id name rows without a doc_id, or with one that
repeats, by ids beyond all others: each row is judged by its own text, and a
row with an id of its own stays before them. The last stage's rows join back to
documents by doc_id and text_crc32; a document that the mix takes twice is two
equal rows there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import decontamination, jaccard_join, mixing, quality, sharding
from quayside.llm.common import materialize

BROADCAST_IDS = 4_000_000
#: Holds a row's id while it has another.
OWN = "corpus_pipeline_doc_id"


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows of these ids; up to BROADCAST_IDS ids the text
    stays where it was read."""
    gone = materialize(ids.select(F.col("doc_id").alias("gone")).where("gone is not null").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, docs["doc_id"] == gone["gone"], "left_anti")


def naming(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage over docs in which every row has an id of its own: while it
    runs, null and repeated ids are replaced by ids beyond all others."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        odd = materialize(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("odd")), "odd")
        rows = odd.count()
        if not rows:
            return stage(spark, docs, sf_dir)
        top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(-1))).first()[0]
        held = F.broadcast(odd) if rows <= BROADCAST_IDS else odd
        met = F.col("doc_id").eqNullSafe(F.col("odd"))
        # written, so that every read of a row finds the same id
        named = materialize(docs.join(held, met, "left_semi").withColumns({OWN: F.col("doc_id"), "doc_id": F.monotonically_increasing_id() + F.lit(top) + 1}), "loose")
        single = docs.join(held, met, "left_anti").withColumn(OWN, F.col("doc_id"))
        return stage(spark, single.unionByName(named), sf_dir).withColumn("doc_id", F.col(OWN)).drop(OWN)

    return run


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forest = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score_column(F.col("text"), forest) >= 0.3)


@naming
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; the least id of a group stays, once."""
    groups = materialize(jaccard_join.jaccard_components(docs, shingle=5, num=80, den=100), "groups")
    return without(docs, groups.where("doc_id <> component_id"))


@naming
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, decontamination.contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays as often as the mix takes it: not, once or twice."""
    return mixing.mixed_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier and the tree have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
