"""Ranking, clustering and merging of levels, zones and events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], time: str, step_seconds: int) -> DataFrame:
    """Runs of rows that follow each other by exactly one step."""
    w = Window.partitionBy(*keys).orderBy(time)
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    runs = rows.withColumn("_run", at - F.row_number().over(w) * step_seconds)
    return runs.groupBy(*keys, "_run").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("rows")).drop("_run")


def id_gaps(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Holes in a sequence of ids: ids at or below an earlier one are
    duplicates or late and open no hole."""
    w = Window.partitionBy(*keys).orderBy(id_)
    last = F.lag(id_).over(w)
    return rows.select(*keys, id_).distinct().withColumn("after", last).where(F.col(id_) > F.col("after") + 1).select(*keys, (F.col("after") + 1).alias("from_id"), (F.col(id_) - 1).alias("to_id"))


def price_clusters(levels: DataFrame, keys: list[str], price: str, weight: str, gap: float) -> DataFrame:
    """Levels nearer than `gap` to the one below are one cluster; its middle is
    weighted, with a weight of 1 at least."""
    w = Window.partitionBy(*keys).orderBy(price)
    opens = F.coalesce((F.round(F.col(price) - F.lag(price).over(w), 9) > gap).cast("int"), F.lit(1))
    named = levels.withColumn("_opens", opens).withColumn("cluster", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    heavy = F.greatest(F.col(weight), F.lit(1.0))
    return named.groupBy(*keys, "cluster").agg(F.min(price).alias("low"), F.max(price).alias("high"), (F.sum(F.col(price) * heavy) / F.sum(heavy)).alias("middle"), F.sum(weight).alias("weight"), F.count("*").alias("levels"))


def walls(levels: DataFrame, keys: list[str], mid: str, bid: str, ask: str, price: str, share: float = 0.005, within: float = 0.15, top: int = 5) -> DataFrame:
    """Book levels within a band of the middle price in bins of a share of it:
    the greatest bids below and asks above, with liquidity-weighted prices."""
    near = levels.where(F.abs(F.col(price) - F.col(mid)) <= F.col(mid) * within)
    bins = near.groupBy(*keys, mid, F.floor(F.col(price) / (F.col(mid) * share)).alias("bin")).agg(F.sum(bid).alias("bid"), F.sum(ask).alias("ask"), (F.sum(F.col(price) * (F.col(bid) + F.col(ask))) / F.sum(F.col(bid) + F.col(ask))).alias("price"))
    sides = bins.select(*keys, mid, "bin", "price", F.explode(F.array(F.struct(F.lit("bid").alias("side"), F.col("bid").alias("size")), F.struct(F.lit("ask").alias("side"), F.col("ask").alias("size")))).alias("s")).select(*keys, mid, "bin", "price", "s.side", "s.size")
    right = ((F.col("side") == "bid") & (F.col("price") <= F.col(mid))) | ((F.col("side") == "ask") & (F.col("price") >= F.col(mid)))
    w = Window.partitionBy(*keys, "side").orderBy(F.desc("size"), "bin")
    return sides.where(right & (F.col("size") > 0)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def layer(distance: Column, near: float = 0.003, mid: float = 0.01) -> Column:
    return F.when(distance <= near, "near").when(distance <= mid, "mid").otherwise("far")


def keep_layers(rows: DataFrame, keys: list[str], distance: str, order: list, caps: dict[str, int] | None = None) -> DataFrame:
    """The best rows of each layer of distance."""
    caps = caps or {"near": 36, "mid": 18, "far": 12}
    named = rows.withColumn("layer", layer(F.col(distance)))
    rank = F.row_number().over(Window.partitionBy(*keys, "layer").orderBy(*order))
    cap = F.coalesce(*[F.when(F.col("layer") == k, v) for k, v in caps.items()])
    return named.withColumn("rank", rank).where(F.col("rank") <= cap)


def top_of_any(rows: DataFrame, keys: list[str], measures: dict[str, int], tie: str) -> DataFrame:
    """Rows among the k greatest of any measure, once each."""
    marked = rows.withColumns({f"_r_{m}": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(m), tie)) for m in measures})
    hit = None
    for m, k in measures.items():
        one = F.col(f"_r_{m}") <= k
        hit = one if hit is None else hit | one
    return marked.where(hit).drop(*[f"_r_{m}" for m in measures])


def merge_events(events: DataFrame, keys: list[str], minutes: int = 30, share: float = 0.0015) -> DataFrame:
    """Greedy merge in order of time: an event joins the first open group of
    its keys that began or grew at most `minutes` ago at nearly its price. The
    choice depends on all before, so a key's events are one sequence.
    events: (*keys, ts, price, score)."""
    fields = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[dict] = []
        for r in pdf.sort_values(["ts", "price", "score"]).itertuples(index=False):
            for g in groups:
                if (r.ts - g["last"]).total_seconds() <= minutes * 60 and abs(r.price - g["price"]) <= share * g["price"]:
                    g["last"], g["n"], g["score"] = r.ts, g["n"] + 1, max(g["score"], r.score)
                    g["low"], g["high"] = min(g["low"], r.price), max(g["high"], r.price)
                    break
            else:
                groups.append({"first": r.ts, "last": r.ts, "price": r.price, "low": r.price, "high": r.price, "n": 1, "score": r.score})
        out = pd.DataFrame(groups, columns=["first", "last", "price", "low", "high", "n", "score"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return events.groupBy(*keys).applyInPandas(run, f"{fields}, first timestamp_ntz, last timestamp_ntz, price double, low double, high double, n long, score double")


def merge_zones(zones: DataFrame, keys: list[str], share: float = 0.0002) -> DataFrame:
    """Chain merge by middle price: a zone joins the running one if its middle
    is within a share of the running middle, which then moves."""
    fields = ", ".join(f"`{k}` {zones.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        pdf = pdf.assign(mid=(pdf["low"] + pdf["high"]) / 2)
        for r in pdf.sort_values(["mid", "low", "high"]).itertuples(index=False):
            if out and abs(r.mid - (out[-1][0] + out[-1][1]) / 2) <= share * (out[-1][0] + out[-1][1]) / 2:
                out[-1] = [min(out[-1][0], r.low), max(out[-1][1], r.high), out[-1][2] + 1]
            else:
                out.append([r.low, r.high, 1])
        held = pd.DataFrame(out, columns=["low", "high", "members"])
        for k in reversed(keys):
            held.insert(0, k, pdf[k].iloc[0])
        return held

    return zones.groupBy(*keys).applyInPandas(run, f"{fields}, low double, high double, members long")


def bundle(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One document per key: a map from indicator code to its row as JSON."""
    rows = None
    for code, df in parts.items():
        rest = [c for c in df.columns if c not in keys]
        one = df.select(*keys, F.lit(code).alias("code"), F.to_json(F.struct(*rest)).alias("payload"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*keys).agg(F.count("*").alias("indicator_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "payload")))).alias("indicators"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-7) -> DataFrame:
    """Keys on one side only, or whose values differ by more than the
    tolerance relative to the greater (1 at least)."""
    x = a.select(*keys, F.struct(*columns).alias("x"))
    y = b.select(*keys, F.struct(*columns).alias("y"))
    met = x.join(y, keys, "full_outer")
    bad = F.lit(False)
    for c in columns:
        p, q = F.col("x")[c], F.col("y")[c]
        far = F.abs(p - q) > tolerance * F.greatest(F.lit(1.0), F.abs(p), F.abs(q))
        bad = bad | F.coalesce(far, p.isNull() != q.isNull())
    kind = F.when(F.col("y").isNull(), "left").when(F.col("x").isNull(), "right").when(bad, "differs")
    return met.withColumn("kind", kind).where("kind is not null").select(*keys, "kind", "x", "y")


def checked(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(sound rows, quarantine): rows that break a rule, with the broken ones."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)
