"""Initiation, absorption, exponential means and key levels on small inputs, at
the operators' own bounds."""

from __future__ import annotations

import datetime as dt

import pytest

from quayside.operators import indicators as ind
from quayside.operators import minute as mn

T0 = dt.datetime(2024, 1, 1)
FLAT = {"open": 100.0, "high": 100.05, "low": 99.95, "close": 100.0, "rd": 0.0, "poc": 100.0, "val": 99.0, "vah": 101.0, "avwap": 100.0, "stacked_buy": False, "stacked_sell": False, "spot_rd": 0.0, "spot_cvd": 0.0, "spot_push": 0.0}
KINDS = {"stacked_buy": "boolean", "stacked_sell": "boolean"}


def rows(spark, changed: dict[int, dict], n: int = 90, start: int = 0):
    names = ["symbol", "bar", "delta", *FLAT]
    data = []
    for i in range(n):
        r = {"symbol": "S0", "bar": T0 + dt.timedelta(minutes=start + i), "delta": 1.0 if i % 2 else -1.0, **FLAT, **changed.get(i, {})}
        data.append(tuple(r[c] for c in names))
    fields = ", ".join(f"{c} {KINDS.get(c, 'double')}" for c in [*names[2:]])
    return spark.createDataFrame(data, f"symbol string, bar timestamp_ntz, {fields}")


BREAK = {"open": 101.0, "high": 101.5, "low": 101.0, "close": 101.5, "delta": 50.0, "rd": 0.8, "stacked_buy": True, "spot_rd": 0.6, "spot_push": 10.0}
AFTER = {"open": 101.2, "high": 101.3, "low": 101.1, "close": 101.2, "delta": 1.0, "rd": 0.4, "spot_cvd": 3.0}


def started(**more):
    return {65: {**BREAK, **more}, **{i: AFTER for i in range(66, 90)}}


@pytest.mark.parametrize("start", [0, 1374, 1375, 1379, 2000])
def test_initiation_wherever_blocks_are_cut(spark, start):
    r = ind.initiation(rows(spark, started(), start=start)).collect()
    assert len(r) == 1
    e = r[0]
    deltas = [1.0 if i % 2 else -1.0 for i in range(6, 65)] + [50.0]
    mean = sum(deltas) / 60
    sd = (sum((d - mean) ** 2 for d in deltas) / 60) ** 0.5
    assert (e["direction"], e["bar"], e["confirm_at"]) == (1, T0 + dt.timedelta(minutes=start + 65), T0 + dt.timedelta(minutes=start + 71))
    assert e["z"] == pytest.approx((50 - mean) / sd)
    assert e["rd_mean"] == pytest.approx((0.8 + 5 * 0.4) / 6) and e["break_ticks"] == pytest.approx(50)
    assert (e["pivot"], e["delta_sum"], e["adverse"]) == (101.0, 55.0, 0.0)
    assert e["spot_rd_mean"] == pytest.approx(0.1) and e["spot_cvd_change"] == 3.0 and e["spot_break"] and e["spot_whale"]
    base = 0.3 * 1 + 0.3 * (2.8 / 6) / 0.5 + 0.2 + 0.2
    assert e["score"] == pytest.approx(0.8 * base + 0.15 * 0.1 + 0.05)


@pytest.mark.parametrize("more", [{"stacked_buy": False}, {"rd": 0.19}, {"close": 101.3}, {"close": 101.02, "high": 101.02}, {"delta": 1.0}])
def test_initiation_needs_every_condition(spark, more):
    assert ind.initiation(rows(spark, started(**more))).count() == 0


def test_initiation_must_hold_and_be_the_first_close_outside(spark):
    assert ind.initiation(rows(spark, {**started(), 68: {**AFTER, "close": 100.98}})).count() == 0
    assert ind.initiation(rows(spark, {**started(), 68: {**AFTER, "close": 100.99, "low": 100.9}})).collect()[0]["adverse"] == pytest.approx(10)
    assert ind.initiation(rows(spark, {**started(), 64: {**AFTER, "close": 101.03}})).count() == 0
    assert ind.initiation(rows(spark, started(), n=70)).count() == 0
    assert ind.initiation(rows(spark, started(), n=71)).count() == 1


def test_initiation_down(spark):
    down = {65: {"open": 99.0, "high": 99.0, "low": 98.5, "close": 98.5, "delta": -50.0, "rd": -0.8, "stacked_sell": True}, **{i: {"high": 98.9, "low": 98.7, "close": 98.8, "delta": -1.0} for i in range(66, 80)}}
    e = ind.initiation(rows(spark, down, n=80)).collect()
    assert [(x["direction"], x["pivot"], x["spot_break"], x["spot_whale"]) for x in e] == [(-1, 99.0, False, False)]


PUSH = {"open": 99.0, "high": 99.5, "low": 98.9, "close": 99.45, "delta": -20.0, "rd": -0.5, "stacked_sell": True, "val": 98.95, "spot_rd": 0.15, "spot_push": 50_000.0}
CALM = {"open": 99.4, "high": 99.6, "low": 99.3, "close": 99.4, "val": 98.95, "spot_cvd": 7.0, "spot_push": 1.0}


def pushed(at=(65, 66), **more):
    return {i: {**PUSH, **more} if i in at else CALM for i in range(min(at), 90)}


@pytest.mark.parametrize("start", [0, 1373, 1374, 1375])
def test_absorption_groups_neighbours(spark, start):
    r = ind.absorption(rows(spark, pushed(), start=start)).collect()
    assert len(r) == 1
    e, m = r[0], lambda i: T0 + dt.timedelta(minutes=start + i)
    assert (e["direction"], e["from_bar"], e["to_at"], e["confirm_at"]) == (1, m(65), m(67), m(68))
    assert (e["pivot"], e["price_high"], e["delta_sum"], e["stacked_buy"], e["stacked_sell"]) == (98.9, 99.5, -40.0, False, True)
    reject = 0.55 / 0.6
    # the second bar meets the first one's low
    assert e["reject"] == pytest.approx(reject) and e["key_distance"] == pytest.approx(0)
    base = 0.35 + 0.35 * (reject - 0.7) / 0.3 + 0.2 + 0.1 * 2 / 5
    assert e["spot_flow"] == pytest.approx(1) and e["spot_whale"] == 1 and e["spot_cvd_change"] == 7.0
    assert e["score"] == pytest.approx(0.85 * base + 0.15)


def test_absorption_keeps_groups_short_and_apart(spark):
    r = ind.absorption(rows(spark, {**pushed(tuple(range(10, 45)))})).orderBy("from_bar").collect()
    assert [((x["to_at"] - x["from_bar"]).seconds // 60) for x in r] == [30, 5]
    r = ind.absorption(rows(spark, pushed((60, 62)))).collect()
    assert len(r) == 2


@pytest.mark.parametrize("more", [{"stacked_sell": False}, {"rd": -0.14}, {"open": 99.46}, {"close": 99.3}, {"val": 98.0, "low": 98.5, "high": 99.9, "close": 99.8}])
def test_absorption_needs_every_condition(spark, more):
    assert ind.absorption(rows(spark, pushed((65,), **more))).count() == 0


def test_absorption_is_confirmed(spark):
    low = {i: {**CALM, "close": 99.1, "low": 99.0} for i in range(66, 90)}
    assert ind.absorption(rows(spark, {**pushed((65,)), **low})).count() == 0
    left = {68: {**CALM, "low": 98.88}}
    assert ind.absorption(rows(spark, {**pushed((65,)), **left})).count() == 0
    late = {66: {**CALM, "close": 99.1, "low": 99.0}, 67: {**CALM, "close": 99.1, "low": 99.0}}
    assert ind.absorption(rows(spark, {**pushed((65,)), **late})).collect()[0]["confirm_at"] == T0 + dt.timedelta(minutes=69)
    assert ind.absorption(rows(spark, pushed((65,)), n=68)).count() == 0


def test_no_rows(spark):
    none = rows(spark, {}).where("false")
    assert ind.initiation(none).count() == 0 and ind.absorption(none).count() == 0


def test_emas_are_folds(spark):
    n, periods = 3000, {"a": 2, "b": 13, "c": 200}
    prices = [100 + (i * 7919 % 101) / 10 for i in range(n)]
    gaps = [i for i in range(n) if i % 50 < 45]
    df = spark.createDataFrame([("S0", "spot", T0 + dt.timedelta(minutes=700 + i), prices[i]) for i in gaps] + [("S1", "spot", T0, 5.0)], "symbol string, market string, minute timestamp_ntz, price double")
    got = mn.emas(df, mn.minute_index(), "price", periods).orderBy("symbol", "minute").collect()
    for name, p in periods.items():
        want, e = [], None
        for i in gaps:
            e = prices[i] if e is None else prices[i] * 2 / (p + 1) + e * (1 - 2 / (p + 1))
            want.append(e)
        assert [r[name] for r in got[:-1]] == pytest.approx(want, rel=1e-12)
        assert got[-1][name] == pytest.approx(5.0)
    assert mn.emas(df.where("false"), mn.minute_index(), "price", periods).count() == 0


def test_filled_carries_over_days(spark):
    df = spark.createDataFrame([("S0", "spot", T0 + dt.timedelta(hours=12 * i), v) for i, v in enumerate([None, 1.0, None, None, 2.0, None])], "symbol string, market string, minute timestamp_ntz, v double")
    assert [r["v"] for r in mn.filled(df, ["v"]).orderBy("minute").collect()] == [None, 1.0, 1.0, 1.0, 2.0, 2.0]


def area_by_steps(vol: dict[int, float], share: float = 0.7):
    low, high, total = min(vol), max(vol), sum(vol.values())
    poc = max(vol, key=lambda t: (vol[t], t))
    lo = hi = poc
    got = vol[poc]
    while got < share * total and (lo > low or hi < high):
        up = vol.get(hi + 1, 0.0) if hi < high else -1.0
        down = vol.get(lo - 1, 0.0) if lo > low else -1.0
        if up >= down:
            hi, got = hi + 1, got + up
        else:
            lo, got = lo - 1, got + down
    return poc, lo, hi


def test_value_area_as_by_single_ticks(spark):
    import random

    draw, groups = random.Random(7), {}
    for k in range(120):
        groups[k] = {t: float(draw.randint(1, 6)) for t in draw.sample(range(-40, 40), draw.randint(1, 30))}
    p = spark.createDataFrame([(k, t, v, 0.0) for k, g in groups.items() for t, v in g.items()] + [(999, 1, 0.0, 0.0)], "k int, tick long, buy_qty double, sell_qty double")
    got = {r["k"]: (r["poc"], r["val"], r["vah"]) for r in ind.value_area(p, ["k"]).collect()}
    assert got == {k: area_by_steps(g) for k, g in groups.items()}


def test_key_levels_stacks(spark):
    def flags(ticks):
        p = spark.createDataFrame([("x", t, b, s) for t, b, s in ticks], "k string, tick long, buy_qty double, sell_qty double")
        r = ind.key_levels(p, ["k"]).collect()[0]
        return r["stacked_buy"], r["stacked_sell"]

    assert flags([(1, 4.0, 1.0), (2, 4.0, 1.0), (3, 4.0, 1.0)]) == (True, False)
    assert flags([(1, 4.0, 1.0), (2, 2.9, 1.0), (3, 4.0, 1.0)]) == (False, False)
    assert flags([(1, 3.0, 0.0), (3, 3.0, 0.0), (4, 3.0, 0.0)]) == (False, False)
    assert flags([(1, 1.0, 4.0), (2, 1.0, 4.0), (3, 0.0, 4.0)]) == (False, True)


def test_ema_regime_of_closed_bars(spark):
    n = 3 * 1440
    rising = [("S0", "futures", T0 + dt.timedelta(minutes=i), None if i % 3 else 100.0 + i, 100.0 + i - i % 3) for i in range(n)]
    df = spark.createDataFrame(rising, "symbol string, market string, minute timestamp_ntz, close double, last_price double")
    r = {x["at"]: x for x in ind.ema_regime(df).collect()}
    assert len(r) == n // 15
    first = r[T0 + dt.timedelta(minutes=15)]
    assert first["fast_4h"] is None and (first["trend_4h"], first["regime"]) == ("neutral", "neutral")
    one = r[T0 + dt.timedelta(minutes=240)]
    assert one["fast_4h"] == pytest.approx(337.0) and one["trend_4h"] == "neutral"
    assert r[T0 + dt.timedelta(minutes=480)]["trend_4h"] == "bull" and r[T0 + dt.timedelta(minutes=480)]["regime"] == "neutral"
    last = r[T0 + dt.timedelta(days=3)]
    assert last["regime"] == "bull" and last["band_low"] == last["ema_34"] and last["band_high"] == last["ema_13"]
