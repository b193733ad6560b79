"""Identity, merging, extremes and blocks against plain Python."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quayside.operators import features, minute, records, reductions


def test_uuid_of_a_name(spark):
    names = ["", "a", "ind|x|1", "é中"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["u"] for r in rows.select("n", records.name_uuid(F.col("n"), str(uuid.NAMESPACE_URL)).alias("u")).collect()}
    assert got == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def series(n, skip=0):
    r = random.Random(n)
    start = dt.datetime(2024, 1, 1, 23, 0) + dt.timedelta(minutes=skip)
    return [("S", "spot", start + dt.timedelta(minutes=i), float(r.randint(-50, 50))) for i in range(n)]


@pytest.mark.parametrize("n,skip", [(3000, 0), (3000, 777), (5, 0), (1, 3)])
def test_rolling_over_blocks(spark, n, skip):
    rows = series(n, skip)
    on = spark.createDataFrame(rows, "symbol string, market string, minute timestamp_ntz, v double")
    widths = (1, 7, 60, 1440, 2000)
    sums = minute.with_rolling(on, {f"s{w}": ("v", w) for w in widths})
    both = minute.with_extremes(sums, {f"{k}{w}": (k, "v", w) for k in ("min", "max") for w in widths}).orderBy("minute").collect()
    v = [x[3] for x in rows]
    assert len(both) == n
    for i, r in enumerate(both):
        for w in widths:
            own = v[max(0, i - w + 1) : i + 1]
            assert (r[f"s{w}"], r[f"min{w}"], r[f"max{w}"]) == (sum(own), min(own), max(own)), (i, w)


def test_registered_indicators(spark):
    @records.register_indicator("test_flow")
    def flow(history):
        return {"snapshot": history.groupBy("symbol").count()}

    with pytest.raises(ValueError):
        records.register_indicator("test_flow")(flow)
    on = spark.createDataFrame(series(3), "symbol string, market string, minute timestamp_ntz, v double")
    assert records.evaluate(on, ["test_flow"])["test_flow"]["snapshot"].first()["count"] == 3


def test_payloads_and_positions(spark):
    r = spark.range(1).select(records.merge_payload(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))).alias("m"), records.position(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0)).alias("p"), records.reward_risk(F.lit("LONG"), F.lit(10.0), F.lit(9.0), F.lit(12.0)).alias("rr"), records.reward_risk(F.lit("SHORT"), F.lit(10.0), F.lit(9.0), F.lit(12.0)).alias("bad"), reductions.pruned(F.struct(F.lit(1).alias("x"), F.lit(None).cast("int").alias("y"))).alias("j")).first()
    assert (r["m"], r["p"], r["rr"], r["bad"], r["j"]) == ({"a": "1", "b": "3"}, "unknown", 2.0, None, '{"x":1}')


def test_bursts_need_enough_rows(spark):
    rows = [("S", "spot", i, float(i % 5)) for i in range(40)]
    t = spark.createDataFrame(rows, "symbol string, market string, bar long, delta double")
    z = [r["burst_z"] for r in features.delta_emas(t, "bar").orderBy("bar").collect()]
    assert all(x is None for x in z[:21]) and all(x is not None for x in z[21:])
