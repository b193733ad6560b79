"""Streams give what batch gives; state survives between batches."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from quayside.operators.minute import trade_minutes
from quayside.sources.events import decode, wire_trades
from quayside.streaming import minutes as sm


def line(i, second, price=10.0, qty=1.0):
    ts = (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({"schema_version": 1, "msg_type": "md.trade", "market": "spot", "symbol": "S0", "event_ts": ts, "data": {"agg_trade_id": i, "price": str(price), "qty_raw": str(qty), "aggressor_side": 1 if i % 2 else -1}})


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(line(i, i * 7, 10 + i) for i in range(20)) + "\nnot json\n")
    (folder / "b.txt").write_text("\n".join([line(3, 21, 13), *[line(i, i * 7, 10 + i) for i in range(22, 40)]]))
    return folder


def test_stream_equals_batch(spark, landed, tmp_path):
    stream = sm.minute_stream(sm.trades_of(sm.read_lines(spark, str(landed), 1)), "10 minutes")
    sm.start(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r["minute"], r["trade_count"], r["buy_qty"], r["open"], r["close"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = trade_minutes(wire_trades(decode(spark.read.text(str(landed)))).dropDuplicates(["trade_id"]))
    assert got == {(r["minute"], r["trade_count"], r["buy_qty"], r["open"], r["close"]) for r in batch.collect()}
    assert decode(spark.read.text(str(landed))).where("fault is not null").count() == 1


def test_sequence_gaps(spark, landed, tmp_path):
    q = sm.sequence_gaps(sm.trades_of(sm.read_lines(spark, str(landed)))).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["from_id"], r["to_id"]) for r in spark.table("gaps").collect()] == [(20, 21)]


def test_books(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    e = {"schema_version": 1, "market": "spot", "symbol": "S0"}
    rows = [
        {**e, "msg_type": "md.orderbook_snapshot_l2", "event_ts": "2024-01-01T00:00:00Z", "data": {"last_update_id": 10, "bids": [["9", "1"], ["8", "2"]], "asks": [["11", "1"]]}},
        {**e, "msg_type": "md.depth", "event_ts": "2024-01-01T00:00:01Z", "data": {"first_update_id": 11, "final_update_id": 12, "bids_delta": [["9", "0"]], "asks_delta": [["10", "3"]]}},
        {**e, "msg_type": "md.depth", "event_ts": "2024-01-01T00:00:02Z", "data": {"first_update_id": 15, "final_update_id": 16, "bids_delta": [], "asks_delta": []}},
    ]
    (folder / "a.txt").write_text("\n".join(map(json.dumps, rows)))
    q = sm.books(sm.read_lines(spark, str(folder))).writeStream.format("memory").queryName("books").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["bid"], r["ask"], r["synced"]) for r in spark.table("books").orderBy("ts").collect()]
    assert got == [(9.0, 11.0, True), (8.0, 10.0, True), (None, None, False)]


def test_gaps_of_a_large_shuffled_batch(spark, tmp_path):
    ids = [i for i in range(25_000) if i not in (7_000, 7_001)]
    random.Random(3).shuffle(ids)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(line(i, 1) for i in ids))
    trades = sm.trades_of(sm.read_lines(spark, str(folder)))
    q = sm.sequence_gaps(trades).writeStream.format("memory").queryName("many").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["from_id"], r["to_id"]) for r in spark.table("many").collect()] == [(7_000, 7_001)]


def test_books_of_a_large_shuffled_batch(spark, tmp_path):
    e = {"schema_version": 1, "market": "spot", "symbol": "S0"}
    rows = [{**e, "msg_type": "md.orderbook_snapshot_l2", "event_ts": "2024-01-01T00:00:00Z", "data": {"last_update_id": 0, "bids": [["9", "1"]], "asks": [["11", "1"]]}}]
    for i in range(1, 12_001):
        ts = (dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=i)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        rows.append({**e, "msg_type": "md.depth", "event_ts": ts, "data": {"first_update_id": i, "final_update_id": i, "bids_delta": [["9", str(i)]], "asks_delta": []}})
    random.Random(3).shuffle(rows)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(map(json.dumps, rows)))
    q = sm.books(sm.read_lines(spark, str(folder))).writeStream.format("memory").queryName("large").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("large").orderBy("ts").collect()
    assert len(got) == 12_001 and all(r["synced"] for r in got) and got[-1]["bid_qty"] == 12_000
