from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from quayside.operators import depth


def test_depth_features(spark):
    t = [dt.datetime(2024, 1, 1, 0, 0, i) for i in range(3)]
    rows = [("S0", "spot", t[0], [(10.0, 3.0), (9.0, 1.0)], [(10.5, 1.0)]), ("S0", "spot", t[1], [(10.0, 1.0)], [(10.5, 1.0)]), ("S0", "spot", t[2], [], [(10.5, 1.0)])]
    df = spark.createDataFrame(rows, "symbol string, market string, ts timestamp_ntz, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>")
    got = depth.depth_features(df).orderBy("ts").collect()
    w = math.exp(-0.35)
    assert got[0]["obi_l1"] == 0.5 and got[0]["obi_k"] == pytest.approx(3 / 5)
    assert got[0]["obi_k_dw"] == pytest.approx((3 + w - 1) / (4 + w)) and got[0]["obi_k_dw_change"] is None
    assert got[0]["obi_k_dw_adj"] == pytest.approx(got[0]["obi_k_dw"] * 5 / 6 * 0.02)
    assert got[1]["obi_k_dw_change"] == pytest.approx(-got[0]["obi_k_dw"])
    assert got[2]["obi_l1"] is None and got[2]["obi_k"] == -1.0


def brute(vol):
    out = {}
    for t, v in vol.items():
        if v <= vol.get(t - 1, 0) or v <= vol.get(t + 1, 0):
            continue
        cols = []
        for step in (-1, 1):
            low, x, found = v, t, 0.0
            while min(vol) <= x + step <= max(vol):
                x += step
                low = min(low, vol.get(x, 0.0))
                if vol.get(x, 0.0) >= v:
                    found = low
                    break
            cols.append(found)
        out[t] = v - max(cols)
    return out


def test_prominences(spark):
    r = random.Random(1)
    for _ in range(3):
        vol = {t: float(v) for t, v in zip(r.sample(range(60), 40), r.sample(range(1, 200), 40))}
        df = spark.createDataFrame([("a", t, v) for t, v in vol.items()], "k string, tick long, volume double")
        assert {x["tick"]: x["prominence"] for x in depth.prominences(df, ["k"]).collect()} == pytest.approx(brute(vol))


def test_compact_payload(spark):
    df = spark.createDataFrame([(1, [1, 2], [3, 4]), (2, None, [])], "k int, levels array<int>, series array<int>")
    got = sorted(map(tuple, depth.compact_payload(df, ["levels"], ["series"]).collect()))
    assert got == [(1, 2, 2, 4), (2, 0, 0, None)]
