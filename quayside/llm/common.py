"""Small helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_own: str | None = None
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where
    it is unset, a local master gets a folder of its own that goes at exit; any
    other is an error, as executors would miss the driver's folder."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="quayside-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


@contextmanager
def shuffles_end_with_queries(spark: SparkSession) -> Iterator[None]:
    """While this is open Spark deletes a query's shuffle files as it ends."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back. This cuts the
    lineage: what is lost with an executor is read again from the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_end_with_queries(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the least
    node reachable. Alternating large-star and small-star rounds, each written
    to the shared folder; hubs cost a partial minimum and a join that adaptive
    execution can split, never one task's list. No edges: no rows."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        near = both.join(least, "a")
        if large:
            return near.where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        own = least.select(F.col("m").alias("a"), F.col("a").alias("b"))
        return near.select(F.col("m").alias("a"), "b").unionByName(own).where("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()

    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = state(e)
    while before[0]:
        last, e = e, materialize(star(star(e, True), False), name)
        release(last)
        now = state(e)
        if now == before:
            break
        before = now
    members = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return members.unionByName(roots)
