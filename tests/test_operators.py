"""Operators without SQL, and edge cases, on small inputs."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quayside.functions import stats
from quayside.operators import indicators as ind
from quayside.operators import joins
from quayside.operators import minute as mn
from quayside.operators import reduce as red
from quayside.sources import events as src
from quayside.sources import sinks

T0 = dt.datetime(2024, 1, 1)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def trades(spark):
    rows = [(i, "S0", "futures", at(m), p, q, s) for i, (m, p, q, s) in enumerate([(0, 10.0, 1.0, 1), (0.5, 11.0, 2.0, -1), (3, 12.0, 4.0, None), (3.2, 9.0, 1.0, -1)])]
    return spark.createDataFrame(rows, "trade_id long, symbol string, market string, ts timestamp_ntz, price double, qty double, side int")


def test_minutes_and_spine(trades):
    m = {r["minute"]: r for r in mn.history(mn.trade_minutes(trades)).collect()}
    assert sorted(m) == [at(i) for i in range(4)]
    assert (m[at(0)]["open"], m[at(0)]["close"], m[at(0)]["delta"]) == (10.0, 11.0, -1.0)
    assert m[at(1)]["qty"] == 0 and m[at(1)]["close"] is None and m[at(1)]["last_price"] == 11.0
    assert m[at(3)]["delta"] == 3.0 and m[at(3)]["cvd"] == 2.0


def test_empty_trades(spark, trades):
    assert mn.history(mn.trade_minutes(trades.where("false"))).count() == 0


def test_rolling_sum_is_a_frame_sum(spark):
    rows = [("S0", "spot", at(i), float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "symbol string, market string, minute timestamp_ntz, qty double")
    got = [r["s"] for r in mn.with_rolling(df, {"s": ("qty", 5)}).orderBy("minute").collect()]
    assert got == pytest.approx([sum(float(j % 7) for j in range(max(0, i - 4), i + 1)) for i in range(50)])


def test_vpin_splits_a_minute_over_buckets(spark):
    rows = [("S0", "spot", at(0), 120.0, 90.0, 30.0)]
    df = spark.createDataFrame(rows, "symbol string, market string, minute timestamp_ntz, qty double, buy_qty double, sell_qty double")
    got = mn.vpin(df, bucket=50.0, length=2).orderBy("bucket").collect()
    assert [(r["bucket"], r["imbalance"]) for r in got] == [(0, 25.0), (1, 25.0)]
    assert got[1]["vpin"] == pytest.approx(0.5)


def test_value_area_prefers_the_upper_side(spark):
    rows = [("S0", "spot", t, v, 0.0) for t, v in [(10, 5.0), (11, 10.0), (12, 5.0), (15, 1.0)]]
    p = spark.createDataFrame(rows, "symbol string, market string, tick long, buy_qty double, sell_qty double")
    r = ind.value_area(p, ["symbol", "market"]).collect()[0]
    assert (r["poc"], r["val"], r["vah"]) == (11, 11, 12)


def test_stack_needs_adjacent_ticks(spark):
    rows = [("S0", "spot", t, 9.0, 1.0) for t in (1, 2, 3, 5, 6)]
    p = spark.createDataFrame(rows, "symbol string, market string, tick long, buy_qty double, sell_qty double")
    got = ind.stacks(ind.footprint(p, ["symbol", "market"]), ["symbol", "market"], "buy_flag").collect()
    assert [(r["low_tick"], r["high_tick"]) for r in got] == [(1, 3)]


def test_pivots_and_ties(spark):
    highs = [1, 2, 3, 9, 3, 2, 1, 9, 9, 1, 1, 1]
    rows = [("S0", "spot", at(i * 60), float(h), float(h) - 0.5) for i, h in enumerate(highs)]
    b = spark.createDataFrame(rows, "symbol string, market string, bar timestamp_ntz, high double, low double")
    got = [r["bar"] for r in ind.pivots(b).where("pivot_high").orderBy("bar").collect()]
    assert got == [at(3 * 60), at(7 * 60)]


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("S0", at(1)), ("S0", at(5)), ("S1", at(1)), ("S0", at(0))], "symbol string, minute timestamp_ntz")
    right = spark.createDataFrame([("S0", at(1), 1.0, 1), ("S0", at(1), 2.0, 2), ("S0", at(4), 3.0, 3)], "symbol string, ts timestamp_ntz, v double, id long")
    got = {(r["symbol"], r["minute"]): r["v"] for r in joins.asof(left, right, ["symbol"], "minute", "ts", ["v"], "id").collect()}
    assert got == {("S0", at(1)): 2.0, ("S0", at(5)): 3.0, ("S1", at(1)): None, ("S0", at(0)): None}


def test_forward_labels(spark):
    def label(highs, lows, n=3):
        starts = spark.createDataFrame([("S0", at(0), 90.0, 110.0)], "symbol string, start timestamp_ntz, support double, resistance double")
        bars = spark.createDataFrame([("S0", at(i), float(h), float(lo), 100.0) for i, (h, lo) in enumerate(zip(highs, lows))], "symbol string, minute timestamp_ntz, high double, low double, close double")
        return joins.forward_labels(starts, bars, ["symbol"], "start", "minute", n).collect()[0]["label"]

    assert label([111, 100, 100], [100, 100, 80]) == "up_then_down"
    assert label([100, 100, 120], [80, 100, 100]) == "down_then_up"
    assert label([120, 100, 100], [80, 100, 100]) == "both"
    assert label([100, 100, 100], [95, 95, 95]) == "none"
    assert label([100, 100], [95, 95]) == "incomplete"


def test_statistics(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 10.0],), ([],), ([5.0] * 5,)], "v array<double>")
    got = df.select(stats.median(F.col("v")).alias("m"), stats.nearest_rank(F.col("v"), 0.9).alias("p"), stats.robust_z(F.lit(9.0), F.col("v"), 5).alias("z")).collect()
    assert got[0]["m"] == 2.5 and got[0]["p"] == 10.0 and got[0]["z"] is None
    assert got[1]["m"] is None and got[1]["p"] is None
    assert got[2]["z"] == 0.0
    assert [r["d"] for r in spark.range(1).select(stats.direction(F.lit(0.0)).alias("d")).collect()] == [1]


def test_decode_and_quarantine(spark):
    good = {"schema_version": 1, "msg_type": "md.trade", "market": "spot", "symbol": "S0", "event_ts": "2024-01-01T00:00:00Z", "data": {"agg_trade_id": 7, "price": "2.5", "qty_raw": "4", "is_buyer_maker": True}}
    bad = [{**good, "schema_version": 2}, {**good, "msg_type": "md.other"}, {**good, "market": "x"}, {**good, "event_ts": "?"}]
    lines = spark.createDataFrame([(json.dumps(x),) for x in [good, *bad]] + [("{",), (None,)], "value string")
    d = src.decode(lines)
    assert sorted(r["fault"] for r in d.where("fault is not null").collect()) == ["event_ts", "market", "msg_type", "schema_version", "unreadable", "unreadable"]
    t = src.wire_trades(d).collect()
    assert [(r["trade_id"], r["notional"], r["side"]) for r in t] == [(7, 10.0, -1)]


def test_force_order_sides(spark):
    row = {"schema_version": 1, "msg_type": "md.force_order", "market": "futures", "symbol": "S0", "event_ts": "2024-01-01T00:00:00Z"}
    lines = spark.createDataFrame([(json.dumps({**row, "data": {"order_side": s, "price": "10", "average_price": "11", "original_qty": "3", "filled_qty": "2"}}),) for s in ("BUY", "SELL")], "value string")
    assert sorted((r["liq_side"], r["notional"]) for r in src.wire_force_orders(src.decode(lines)).collect()) == [("long_liq", 22.0), ("short_liq", 22.0)]


def test_merge_events_and_zones(spark):
    e = spark.createDataFrame([("a", at(0), 100.0, 1.0), ("a", at(20), 100.1, 5.0), ("a", at(25), 200.0, 1.0), ("a", at(90), 100.0, 1.0)], "code string, ts timestamp_ntz, price double, score double")
    got = red.merge_events(e, ["code"]).orderBy("first", "price").collect()
    assert [(r["n"], r["score"]) for r in got] == [(2, 5.0), (1, 1.0), (1, 1.0)]
    z = spark.createDataFrame([("a", 99.0, 101.0), ("a", 99.01, 101.01), ("a", 120.0, 121.0)], "code string, low double, high double")
    assert [(r["low"], r["high"], r["members"]) for r in red.merge_zones(z, ["code"]).orderBy("low").collect()] == [(99.0, 101.01, 2), (120.0, 121.0, 1)]


def test_compare_and_checked(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(2, 2.1), (3, None), (4, 0.0)], "k int, v double")
    assert sorted((r["k"], r["kind"]) for r in red.compare(a, b, ["k"], ["v"]).collect()) == [(1, "left"), (2, "differs"), (4, "right")]
    good, bad = red.checked(a, {"positive": F.col("v") > 1})
    assert good.count() == 1 and bad.count() == 2


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1), (3, "d", 1)], "k int, v string, ver int")
    assert sorted((r["k"], r["v"]) for r in sinks.upsert(new, old, ["k"], ["ver"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r["k"] for r in sinks.append_new(new, old, ["k"]).collect()] == [3]
    assert [r["k"] for r in sinks.stale(old, new, ["k"], F.col("k") > 0).collect()] == [1]
    assert sorted(r["k"] for r in sinks.changed_only(new, old, ["k"]).collect()) == [2, 3]


def test_rollups_merge(spark):
    q = spark.createDataFrame([(i, "S0", "spot", T0 + dt.timedelta(milliseconds=i * 40), 10.0 + i, 1.0, 10.5 + i, 1.0) for i in range(6)], "update_id long, symbol string, market string, ts timestamp_ntz, bid double, bid_qty double, ask double, ask_qty double")
    whole = mn.quote_rollup(q).collect()
    parts = [mn.quote_rollup(q.where(c)).withColumn("latest", F.lit(i)) for i, c in enumerate(("update_id < 3", "update_id >= 3"))]
    merged = mn.merge_rollups(*parts).collect()
    assert [(r["updates"], r["spread_sum"], r["mid_avg"], r["bid"]) for r in merged] == [(r["updates"], r["spread_sum"], r["mid_avg"], r["bid"]) for r in whole]
