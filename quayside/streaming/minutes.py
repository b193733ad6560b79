"""Streams of trades to minutes, with the batch transformations.

Tumbling windows close by event time: the watermark is how late a trade may
be. Late trades within it change their minute again (update mode), and the
keyed sink overwrites the minute; a batch run over the same trades gives the
same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quayside.operators.minute import trade_minutes
from quayside.sources.events import KEY, decode, typed, wire_trades


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Landed message files as a stream, a bounded number per batch."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def trades_of(lines: DataFrame) -> DataFrame:
    return wire_trades(decode(lines))


def quarantine_of(lines: DataFrame) -> DataFrame:
    return decode(lines).where("fault is not null").select("value", "fault")


def minute_stream(trades: DataFrame, late: str = "5 seconds") -> DataFrame:
    """trade_minutes() over a stream: a trade delivered twice counts once while
    the watermark still covers it."""
    once = trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "market", "trade_id"])
    return trade_minutes(once)


def upsert_minutes(path: str):
    """A foreachBatch sink: partitions of the days in the batch are rewritten
    with the new rows over the old. Runs again with the same batch give the
    same files."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        staged = f"{path}_staged_{number}"
        new = batch.withColumn("day", F.to_date("minute")).persist()
        try:
            days = [r["day"] for r in new.select("day").distinct().collect()]  # one row per day of the batch
            if not days:
                return
            rows = new
            if files.exists(at):
                old = spark.read.schema(new.schema).parquet(path).where(F.col("day").isin(days)).join(new.select(*KEY, "minute"), [*KEY, "minute"], "left_anti")
                rows = new.unionByName(old.select(*new.columns))
            rows.write.mode("overwrite").parquet(staged)
            spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        finally:
            new.unpersist()
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)

    return write


def start(minutes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    w = minutes.writeStream.outputMode("update").foreachBatch(upsert_minutes(path)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")).start()


def sequence_gaps(trades: DataFrame) -> DataFrame:
    """Holes in trade ids per series over a stream, as each batch closes. A
    key's rows of a batch come in pieces of any order: they are gathered before
    they are compared. An id at or below the last one opens no hole, one that
    comes late into a hole that was told closes none. State is the last id."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pieces = [pdf["trade_id"].dropna().to_numpy("int64") for pdf in batches]
        ids = np.unique(np.concatenate(pieces)) if pieces else np.empty(0, "int64")
        if last is not None:
            ids = np.concatenate(([last], ids[ids > last]))
        at = np.flatnonzero(np.diff(ids) > 1)
        if len(ids):
            state.update((int(ids[-1]),))
        yield pd.DataFrame([(*key, int(ids[i]) + 1, int(ids[i + 1]) - 1) for i in at], columns=[*KEY, "from_id", "to_id"])

    return trades.groupBy(*KEY).applyInPandasWithState(run, "symbol string, market string, from_id long, to_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def books(lines: DataFrame) -> DataFrame:
    """Order books over a stream of snapshots and deltas: a snapshot replaces
    the book, a level of no quantity goes, an update older than the book is
    ignored, and a hole in update ids makes it unsynced until the next
    snapshot. One row per message: best levels, sizes, synced."""
    read = decode(lines)
    level = "array<array<string>>"
    s = typed(read, "md.orderbook_snapshot_l2").select(*KEY, F.col("event_time").alias("ts"), F.lit(True).alias("snapshot"), F.col("last_update_id").alias("first_id"), F.col("last_update_id").alias("last_id"), F.col("bids").cast(level).alias("bids"), F.col("asks").cast(level).alias("asks"))
    d = typed(read, "md.depth").select(*KEY, F.col("event_time").alias("ts"), F.lit(False).alias("snapshot"), F.col("first_update_id").alias("first_id"), F.col("final_update_id").alias("last_id"), F.col("bids_delta").alias("bids"), F.col("asks_delta").alias("asks"))
    return book_states(s.unionByName(d))


def book_states(messages: DataFrame) -> DataFrame:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            last, synced, bp, bq, ap, aq = state.get
            sides = {"bids": dict(zip(bp, bq)), "asks": dict(zip(ap, aq))}
        else:
            last, synced, sides = -1, False, {"bids": {}, "asks": {}}
        rows = []
        pieces = [pdf for pdf in batches if len(pdf)]  # of one batch, in any order
        for pdf in [pd.concat(pieces)] if pieces else []:
            for r in pdf.sort_values(["ts", "last_id", "snapshot"], kind="stable").itertuples(index=False):
                if r.snapshot:
                    sides, synced = {"bids": {}, "asks": {}}, True
                elif not synced or r.last_id <= last:
                    continue
                elif r.first_id > last + 1:
                    synced = False
                    rows.append((*key, r.ts, None, None, None, None, False))
                    continue
                for side in ("bids", "asks"):
                    levels = getattr(r, side)
                    for price, qty in [] if levels is None else levels:
                        if float(qty) > 0:
                            sides[side][float(price)] = float(qty)
                        else:
                            sides[side].pop(float(price), None)
                last = int(r.last_id)
                bid, ask = max(sides["bids"], default=None), min(sides["asks"], default=None)
                rows.append((*key, r.ts, bid, sides["bids"].get(bid), ask, sides["asks"].get(ask), True))
        state.update((last, synced, list(sides["bids"]), list(sides["bids"].values()), list(sides["asks"]), list(sides["asks"].values())))
        yield pd.DataFrame(rows, columns=[*KEY, "ts", "bid", "bid_qty", "ask", "ask_qty", "synced"])

    return messages.groupBy(*KEY).applyInPandasWithState(run, "symbol string, market string, ts timestamp, bid double, bid_qty double, ask double, ask_qty double, synced boolean", "last long, synced boolean, bp array<double>, bq array<double>, ap array<double>, aq array<double>", "append", GroupStateTimeout.NoTimeout)
