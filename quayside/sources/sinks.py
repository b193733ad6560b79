"""Keyed and partitioned writes over plain Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.joins import latest


def append_new(rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet, once each: insert, ignore duplicates."""
    return rows.dropDuplicates(keys).join(present.select(*keys), keys, "left_anti")


def upsert(rows: DataFrame, present: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The later version of each key by `order`."""
    return latest(present.unionByName(rows.select(*present.columns)), keys, order)


def changed_only(rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are new or differ from what is there in any column."""
    return rows.select(*present.columns).exceptAll(present).dropDuplicates(keys)


def stale(present: DataFrame, rows: DataFrame, keys: list[str], scope) -> DataFrame:
    """What a recompute of `scope` no longer gives, to be deleted."""
    return present.where(scope).join(rows.select(*keys), keys, "left_anti")


def write_cold(rows: DataFrame, path: str, time: str = "ts") -> None:
    """Append by date, market and symbol, for partition pruning."""
    rows.withColumn("date", F.to_date(time)).write.mode("append").partitionBy("date", "market", "symbol").parquet(path)


def overwrite_days(rows: DataFrame, path: str, time: str = "minute") -> None:
    """Replace only the days that rows hold."""
    rows.withColumn("date", F.to_date(time)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
