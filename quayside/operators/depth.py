"""Features of whole order books and of profile peaks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.stats import clip01, ratio
from quayside.sources.events import KEY

LEVELS, DECAY = 5, 0.35


def _total(levels: Column, weight=None) -> Column:
    """Quantity of the first LEVELS levels, weighted by their place."""
    top = F.slice(levels, 1, LEVELS)
    if weight is None:
        return F.aggregate(top, F.lit(0.0), lambda acc, x: acc + x["qty"])
    return F.aggregate(F.transform(top, lambda x, i: x["qty"] * weight(i)), F.lit(0.0), lambda acc, x: acc + x)


def depth_features(books: DataFrame) -> DataFrame:
    """books: (symbol, market, ts, bids, asks), arrays of (price, qty), best
    first. Imbalance of the first and of five levels, plain and weighted by
    e^(-0.35 i), its change since the previous book and its value damped by
    thin depth and wide spread. An empty side gives nulls."""
    w = Window.partitionBy(*KEY).orderBy("ts")
    bid, ask = F.try_element_at("bids", F.lit(1)), F.try_element_at("asks", F.lit(1))
    decay = lambda i: F.exp(-DECAY * i)
    b, a = _total(F.col("bids")), _total(F.col("asks"))
    wb, wa = _total(F.col("bids"), decay), _total(F.col("asks"), decay)
    spread = F.greatest(ask["price"] - bid["price"], F.lit(0.0))
    f = books.withColumns({"spread": spread, "depth": b + a, "obi_l1": ratio(bid["qty"] - ask["qty"], bid["qty"] + ask["qty"]), "obi_k": ratio(b - a, b + a), "obi_k_dw": ratio(wb - wa, wb + wa)})
    tight = F.when(F.col("spread") > 0, clip01(F.lit(0.01) / F.col("spread"))).otherwise(1.0)
    return f.withColumns({"obi_k_dw_change": F.col("obi_k_dw") - F.lag("obi_k_dw").over(w), "obi_k_dw_adj": F.col("obi_k_dw") * (F.col("depth") / (F.col("depth") + 1)) * tight})


def within(levels: DataFrame, mid: str, price: str, bid: str, ask: str, keys: list[str], shares: tuple[float, ...] = (0.01, 0.03)) -> DataFrame:
    """bid / (bid + ask) inside bands around the middle price."""
    def side(c: str, s: float) -> Column:
        return F.sum(F.when(F.abs(F.col(price) - F.col(mid)) <= F.col(mid) * s, F.col(c)).otherwise(0.0))

    return levels.groupBy(*keys).agg(*[ratio(side(bid, s), side(bid, s) + side(ask, s)).alias(f"imbalance_{int(s * 100)}pct") for s in shares])


def prominences(profile: DataFrame, keys: list[str], tick: str = "tick", value: str = "volume") -> DataFrame:
    """Peaks over both adjacent ticks with their topographic prominence: the
    height over the higher of the two saddles towards higher ground, a side
    without higher ground having saddle 0. A tick without volume is a gap of
    0. One group's profile per task, bounded by its price range."""
    fields = ", ".join(f"`{k}` {profile.schema[k].dataType.simpleString()}" for k in keys)

    def saddles(ticks: list[int], v: list[float]) -> list[float]:
        """Per place, the least value on the way to the next higher place
        before it, 0 if there is none: one pass with a stack of falling values."""
        out, stack = [], []  # (value, least value since the place below it)
        for i, x in enumerate(v):
            low = 0.0 if i and ticks[i] != ticks[i - 1] + 1 else x
            while stack and stack[-1][0] <= x:
                low = min(low, stack.pop()[1])
            out.append(min(low, stack[-1][0]) if stack else 0.0)
            stack.append((x, low))
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(tick)
        t, v = pdf[tick].tolist(), pdf[value].tolist()
        left = saddles(t, v)
        right = saddles([-x for x in reversed(t)], v[::-1])[::-1]
        near = dict(zip(t, v))
        rows = [(t[i], v[i], v[i] - max(left[i], right[i])) for i in range(len(t)) if v[i] > near.get(t[i] - 1, 0.0) and v[i] > near.get(t[i] + 1, 0.0)]
        out = pd.DataFrame(rows, columns=["tick", "value", "prominence"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return profile.groupBy(*keys).applyInPandas(run, f"{fields}, tick long, value double, prominence double")


def compact_payload(document: DataFrame, arrays: list[str], series: list[str]) -> DataFrame:
    """Documents for storage: arrays become counts, series their last entry."""
    out = document
    for c in arrays:
        out = out.withColumn(f"{c}_count", F.coalesce(F.size(c), F.lit(0))).drop(c)
    for c in series:
        out = out.withColumn(f"{c}_count", F.coalesce(F.size(c), F.lit(0))).withColumn(f"{c}_latest", F.try_element_at(c, F.lit(-1))).drop(c)
    return out
