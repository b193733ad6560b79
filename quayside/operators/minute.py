"""Events to canonical minutes, the gap-free spine, and minute history.

One shuffle by (symbol, market, minute) makes the minutes. Long series are cut:
running values restart every day and carry what the days before add up to, and
trailing frames work on blocks that hold the end of the block before. No task
needs a whole series; only one row a day of it meets in a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.stats import ratio
from quayside.sources.events import KEY

WHALE = 10_000.0
TICKS = 100  # ticks per unit of price


def minute_of(ts: Column) -> Column:
    """Open of the minute, in the type of ts."""
    return F.window(ts, "1 minute")["start"]


def floor_to(ts: Column, minutes: int) -> Column:
    """Epoch-aligned open of an interval."""
    return F.window(ts, f"{minutes} minutes")["start"]


def tick(price: Column) -> Column:
    return F.round(price * TICKS).cast("long")


def trade_minutes(trades: DataFrame) -> DataFrame:
    """Counts, buy and sell quantity and notional, OHLC in order of arrival,
    and whale statistics; a missing side buys."""
    t = trades.withColumns({"minute": minute_of(F.col("ts")), "notional": F.col("price") * F.col("qty"), "buy": F.coalesce(F.col("side"), F.lit(1)) >= 0})
    order = F.struct("ts", "trade_id")
    zero = F.lit(0.0)
    return t.groupBy(*KEY, "minute").agg(
        F.count("*").alias("trade_count"),
        F.sum(F.when(F.col("buy"), F.col("qty")).otherwise(zero)).alias("buy_qty"),
        F.sum(F.when(~F.col("buy"), F.col("qty")).otherwise(zero)).alias("sell_qty"),
        F.sum(F.when(F.col("buy"), F.col("notional")).otherwise(zero)).alias("buy_notional"),
        F.sum(F.when(~F.col("buy"), F.col("notional")).otherwise(zero)).alias("sell_notional"),
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum((F.col("notional") >= WHALE).cast("long")).alias("whale_count"),
        F.sum(F.when(F.col("notional") >= WHALE, F.col("notional")).otherwise(zero)).alias("whale_notional"),
        F.sum(F.when((F.col("notional") >= WHALE) & F.col("buy"), F.col("notional")).otherwise(zero)).alias("whale_buy"),
        F.max(F.when(F.col("notional") >= WHALE, F.col("notional"))).alias("whale_max"),
    )


def spine(minutes: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Every minute of each series between its first and last."""
    ends = minutes.groupBy(*keys).agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 minute"))).alias("minute"))


def day_of(ts: str) -> Column:
    return F.to_date(F.col(ts))


def carried(rows: DataFrame, keys: list[str], day: str, sums: dict[str, str]) -> DataFrame:
    """(*keys, day, *sums): what the days before add up to. rows: any number a
    day; a day without rows has none here."""
    days = rows.groupBy(*keys, day).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return days.select(*keys, day, *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(n) for n in sums])


def in_blocks(rows: DataFrame, index: Column, reach: int, length: int = 1440) -> DataFrame:
    """rows with `_block`, of `length` indexes or more, and `_own`: each block
    also holds the last `reach` indexes of the one before, not own. Frames of
    up to `reach` rows back are whole for own rows."""
    length = max(length, reach)
    at = rows.withColumn("_i", index.cast("long")).withColumn("_own_block", F.floor(F.col("_i") / length))
    late = F.pmod("_i", F.lit(length)) >= length - reach
    blocks = F.when(late, F.array("_own_block", F.col("_own_block") + 1)).otherwise(F.array("_own_block"))
    return at.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == F.col("_own_block")).drop("_own_block")


def around(rows: DataFrame, index: Column, back: int, ahead: int, length: int = 1440) -> DataFrame:
    """rows with `_block`, of `length` indexes, and `_own`: each block also
    holds the `back` indexes before it and the `ahead` ones after, not own."""
    at = rows.withColumn("_i", index.cast("long"))
    blocks = F.sequence(F.floor((F.col("_i") - ahead) / length), F.floor((F.col("_i") + back) / length))
    return at.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == F.floor(F.col("_i") / length)).drop("_i")


def filled(rows: DataFrame, columns: list[str], keys: list[str] = KEY, order: str = "minute") -> DataFrame:
    """Nulls of `columns` take the last value before them. A day of a series
    meets in a task, and one row a day of all of it."""
    rows = rows.withColumn("_day", day_of(order))
    days = rows.groupBy(*keys, "_day").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_last_{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_from_{c}") for c in columns])
    run = Window.partitionBy(*keys, "_day").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(days, [*keys, "_day"]).withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(run), F.col(f"_from_{c}")) for c in columns}).drop("_day", *[f"_from_{c}" for c in columns])


def emas(rows: DataFrame, index: Column, value: str, periods: dict[str, int], keys: list[str] = KEY, order: str = "minute") -> DataFrame:
    """Exponential means {name: period of 2 or more}, alpha 2 / (period + 1),
    seeded with the first value. value: never null; index: at most one row
    each. A block's rows are weighted sums of their own; what comes in decays
    with their count. One row a block of a series is folded in one task."""
    keep = {name: 1 - 2 / (p + 1) for name, p in periods.items()}
    length = min(1440, *(int(500 / -math.log(k)) for k in keep.values()))
    run = Window.partitionBy(*keys, "_block").orderBy(order)
    at = rows.withColumn("_block", F.floor(index / length)).withColumn("_k", F.row_number().over(run))
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    own = {name: F.pow(F.lit(k), F.col("_k")) * F.sum(F.col(value) * (1 - k) * F.pow(F.lit(k), -F.col("_k"))).over(upto) for name, k in keep.items()}
    at = at.withColumns(own)
    ends = at.groupBy(*keys, "_block").agg(F.max("_k").alias("n"), F.min_by(value, "_k").alias("first"), *[F.max_by(name, "_k").alias(name) for name in keep])
    series = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "n", "first", *keep))).alias("s"))

    def carry(name: str, k: float) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(F.pow(F.lit(k), x["n"]) * F.element_at(acc, -1) + x[name]))
        return F.slice(F.aggregate("s", F.array(F.get("s", F.lit(0))["first"]), step), 1, F.size("s"))

    series = series.select(*keys, F.transform("s", lambda x: x["_block"]).alias("_block"), *[carry(name, k).alias(f"_in_{name}") for name, k in keep.items()])
    ins = [f"_in_{name}" for name in keep]
    blocks = series.select(*keys, F.explode(F.arrays_zip("_block", *ins)).alias("r")).select(*keys, "r.*")
    return at.join(blocks, [*keys, "_block"]).withColumns({name: F.col(name) + F.pow(F.lit(k), F.col("_k")) * F.col(f"_in_{name}") for name, k in keep.items()}).drop("_block", "_k", *ins)


def history(minutes: DataFrame) -> DataFrame:
    """Minutes on the spine: empty ones have zero quantities and null prices;
    delta, relative delta, running CVD, per-minute VWAP, last price."""
    on = spine(minutes).join(minutes, [*KEY, "minute"], "left")
    zeros = ["trade_count", "buy_qty", "sell_qty", "buy_notional", "sell_notional", "whale_count", "whale_notional", "whale_buy"]
    on = on.withColumns({c: F.coalesce(c, F.lit(0).cast(on.schema[c].dataType)) for c in zeros})
    on = on.withColumns({"qty": F.col("buy_qty") + F.col("sell_qty"), "notional": F.col("buy_notional") + F.col("sell_notional"), "delta": F.col("buy_qty") - F.col("sell_qty"), "_day": day_of("minute")})
    ends = minutes.groupBy(*KEY).agg(F.min(day_of("minute")).alias("a"), F.max(day_of("minute")).alias("b"))
    traded = minutes.groupBy(*KEY, day_of("minute").alias("_day")).agg(F.sum(F.col("buy_qty") - F.col("sell_qty")).alias("d"), F.max_by("close", F.when(F.col("close").isNotNull(), F.col("minute"))).alias("p"))
    before = Window.partitionBy(*KEY).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = ends.select(*KEY, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("_day")).join(traded, [*KEY, "_day"], "left")
    days = days.select(*KEY, "_day", F.coalesce(F.sum("d").over(before), F.lit(0.0)).alias("_cvd"), F.last("p", ignorenulls=True).over(before).alias("_price"))
    run = Window.partitionBy(*KEY, "_day").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return (
        on.join(days, [*KEY, "_day"])
        .withColumns(
            {
                "relative_delta": F.coalesce(ratio(F.col("delta"), F.col("qty")), F.lit(0.0)),
                "cvd": F.col("_cvd") + F.sum("delta").over(run),
                "vwap": ratio(F.col("notional"), F.col("qty")),
                "last_price": F.coalesce(F.last("close", ignorenulls=True).over(run), F.col("_price")),
            }
        )
        .drop("_day", "_cvd", "_price")
    )


def minute_index(minute: str = "minute") -> Column:
    return F.floor(F.unix_seconds(F.col(minute).cast("timestamp")) / 60)


def with_rolling(on: DataFrame, columns: dict[str, tuple[str, int]], keys: list[str] = KEY, order: str = "minute") -> DataFrame:
    """Sums of the last n minutes of a gap-free series, {name: (column, n)}, as
    differences of running sums that start anew with every block: constant work
    per row for any width, and no sum over a whole series to lose digits in."""
    sources = sorted({c for c, _ in columns.values()})
    cut = in_blocks(on, minute_index(order), max(n for _, n in columns.values()))
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    cut = cut.withColumns({f"_run_{c}": F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in sources})
    cut = cut.withColumns({name: F.col(f"_run_{c}") - F.coalesce(F.lag(f"_run_{c}", n).over(w), F.lit(0.0)) for name, (c, n) in columns.items()})
    return cut.where("_own").drop("_own", "_block", "_i", *[f"_run_{c}" for c in sources])


def with_extremes(on: DataFrame, columns: dict[str, tuple[str, str, int]], keys: list[str] = KEY, order: str = "minute") -> DataFrame:
    """Least or greatest value of the last n minutes, {name: ("min" or "max",
    column, n)}: of pieces of n minutes each, what a piece holds up to a row
    and what the piece before holds from n - 1 rows earlier on."""
    cut = in_blocks(on, minute_index(order), max(n for _, _, n in columns.values()))
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    for name, (kind, c, n) in columns.items():
        if n == 1:
            cut = cut.withColumn(name, F.col(c)).withColumns({"_from": F.col(c), "_piece": F.lit(0)})
            continue
        f, both = (F.min, F.least) if kind == "min" else (F.max, F.greatest)
        cut = cut.withColumn("_piece", F.floor(F.col("_i") / n))
        piece = Window.partitionBy(*keys, "_block", "_piece")
        back = piece.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
        cut = cut.withColumn("_from", f(c).over(back)).withColumn(name, f(c).over(piece.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        # a series that begins within the window: from its first row, if that is in a piece before
        start = F.when(F.first("_piece").over(run) < F.col("_piece"), F.first("_from").over(run))
        before = F.coalesce(F.lag("_from", n - 1).over(w), start)
        cut = cut.withColumn(name, F.when(F.pmod(F.col("_i") + 1, F.lit(n)) == 0, F.col(name)).otherwise(both(F.col(name), before)))
    return cut.where("_own").drop("_own", "_block", "_i", "_from", "_piece")


def profile(trades: DataFrame, minutes: int | None = None) -> DataFrame:
    """Volume by price tick, over all time or per interval: a long table, so
    profiles merge by adding rows up."""
    t = trades.withColumn("tick", tick(F.col("price"))).withColumn("buy", F.coalesce(F.col("side"), F.lit(1)) >= 0)
    keys = [*KEY]
    if minutes:
        t = t.withColumn("bucket", floor_to(F.col("ts"), minutes))
        keys.append("bucket")
    return t.groupBy(*keys, "tick").agg(F.sum(F.when(F.col("buy"), F.col("qty")).otherwise(0.0)).alias("buy_qty"), F.sum(F.when(~F.col("buy"), F.col("qty")).otherwise(0.0)).alias("sell_qty"))


def bars(on: DataFrame, minutes: int, ceil: bool = False) -> DataFrame:
    """Epoch-aligned bars of minutes; `expected` counts the minutes present.
    With ceil a bar is named by its end."""
    order = F.col("minute")
    b = on.withColumn("bar", floor_to(F.col("minute"), minutes))
    if ceil:
        b = b.withColumn("bar", F.col("bar") + F.make_dt_interval(mins=F.lit(minutes)))
    traded = F.col("close").isNotNull()
    return b.groupBy(*KEY, "bar").agg(
        F.min_by("open", F.when(traded, order)).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(traded, order)).alias("close"),
        F.sum("qty").alias("qty"),
        F.sum("notional").alias("notional"),
        F.sum("delta").alias("delta"),
        F.max_by("cvd", order).alias("cvd"),
        F.sum("trade_count").alias("trade_count"),
        F.count("*").alias("minutes"),
    )


# -- order book ------------------------------------------------------------


def book_samples(quotes: DataFrame) -> DataFrame:
    """Features of every best bid and offer update, with the change in order
    flow since the previous one."""
    order = F.struct("ts", "update_id")
    quotes = quotes.withColumn("_day", day_of("ts"))
    last = quotes.groupBy(*KEY, "_day").agg(F.max_by(F.struct("bid_qty", "ask_qty"), order).alias("_last"))
    days = last.select(*KEY, "_day", F.lag("_last").over(Window.partitionBy(*KEY).orderBy("_day")).alias("_before"))
    quotes = quotes.join(days, [*KEY, "_day"])
    w = Window.partitionBy(*KEY, "_day").orderBy("ts", "update_id")
    was = F.coalesce(F.lag(F.struct("bid_qty", "ask_qty")).over(w), F.col("_before"))
    b, a = F.col("bid_qty"), F.col("ask_qty")
    mid = (F.col("bid") + F.col("ask")) / 2
    obi = F.coalesce(ratio(b - a, b + a), F.lit(0.0))
    kb, ka = F.pow(b, 0.35), F.pow(a, 0.35)
    spread = F.greatest(F.col("ask") - F.col("bid"), F.lit(0.0))
    return quotes.withColumns(
        {
            "mid": mid,
            "spread": spread,
            "obi": obi,
            "microprice": F.coalesce(ratio(F.col("ask") * b + F.col("bid") * a, a + b), mid),
            "microprice_kappa": F.coalesce(ratio(F.col("ask") * kb + F.col("bid") * ka, ka + kb), mid),
            "microprice_adj": F.least(F.greatest(mid + 0.15 * obi * spread / 2, F.col("bid")), F.col("ask")),
            "ofi": F.coalesce((b - was["bid_qty"]) - (a - was["ask_qty"]), F.lit(0.0)),
        }
    ).drop("_day", "_before")


def book_minutes(quotes: DataFrame) -> DataFrame:
    s = book_samples(quotes).withColumn("minute", minute_of(F.col("ts")))
    sums = [F.sum(c).alias(f"{c}_sum") for c in ("spread", "obi", "microprice", "microprice_kappa", "microprice_adj", "ofi")]
    return s.groupBy(*KEY, "minute").agg(F.count("*").alias("sample_count"), *sums, F.max_by("obi", F.struct("ts", "update_id")).alias("obi_close"), F.max_by("mid", F.struct("ts", "update_id")).alias("mid_close"))


def quote_rollup(quotes: DataFrame, width: str = "250 milliseconds") -> DataFrame:
    """Mergeable rollup of quotes: count, spread sum, least and greatest where
    positive, mean mid, latest state."""
    q = quotes.withColumns({"spread": F.col("ask") - F.col("bid"), "mid": (F.col("ask") + F.col("bid")) / 2})
    positive = F.when(F.col("spread") > 0, F.col("spread"))
    order = F.struct("ts", "update_id")
    return q.groupBy(*KEY, F.window("ts", width)["start"].alias("bucket")).agg(F.count("*").alias("updates"), F.sum(positive).alias("spread_sum"), F.min(positive).alias("spread_min"), F.max("spread").alias("spread_max"), F.avg("mid").alias("mid_avg"), F.max_by("bid", order).alias("bid"), F.max_by("ask", order).alias("ask"))


def merge_rollups(*parts: DataFrame) -> DataFrame:
    """Rollups of the same buckets, each row with a `latest` order: counts and
    sums add, means weigh by count, the later state wins."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*KEY, "bucket").agg(F.sum("updates").alias("updates"), F.sum("spread_sum").alias("spread_sum"), F.min("spread_min").alias("spread_min"), F.max("spread_max").alias("spread_max"), (F.sum(F.col("mid_avg") * F.col("updates")) / F.sum("updates")).alias("mid_avg"), F.max_by("bid", "latest").alias("bid"), F.max_by("ask", "latest").alias("ask"), F.max("latest").alias("latest"))


def liquidation_levels(orders: DataFrame, minutes: int = 1) -> DataFrame:
    long_ = F.when(F.col("liq_side") == "long_liq", F.col("notional")).otherwise(0.0)
    short = F.when(F.col("liq_side") == "short_liq", F.col("notional")).otherwise(0.0)
    return orders.groupBy(*KEY, floor_to(F.col("ts"), minutes).alias("bucket"), tick(F.col("price")).alias("tick")).agg(F.sum(long_).alias("long_liq"), F.sum(short).alias("short_liq"))


def zero_liquidations(present: DataFrame, liquidations: DataFrame) -> DataFrame:
    """Minutes that have trades and a book but no liquidation row."""
    return present.join(liquidations.select(*KEY, "minute").distinct(), [*KEY, "minute"], "left_anti")


# -- volume buckets --------------------------------------------------------


def vpin(on: DataFrame, bucket: float = 50.0, length: int = 50) -> DataFrame:
    """Flow toxicity on volume buckets: each minute's quantity covers a range
    of cumulated volume and is split over the buckets it meets; the imbalance
    of the last `length` full buckets over their volume."""
    traded = on.where("qty > 0").withColumn("_day", day_of("minute"))
    w = Window.partitionBy(*KEY, "_day").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    m = traded.join(carried(traded, KEY, "_day", {"_sum": "qty"}), [*KEY, "_day"]).withColumn("upto", F.col("_sum") + F.sum("qty").over(w)).withColumn("from", F.col("upto") - F.col("qty"))
    first, last = F.floor(F.col("from") / bucket), F.ceil(F.col("upto") / bucket) - 1
    parts = m.withColumn("bucket", F.explode(F.sequence(first.cast("long"), F.greatest(first, last).cast("long"))))
    share = (F.least(F.col("upto"), (F.col("bucket") + 1) * bucket) - F.greatest(F.col("from"), F.col("bucket") * bucket)) / F.col("qty")
    filled = parts.groupBy(*KEY, "bucket").agg(F.sum(F.col("buy_qty") * share).alias("buy"), F.sum(F.col("sell_qty") * share).alias("sell"), F.max("minute").alias("minute"))
    full = filled.where(F.round(F.col("buy") + F.col("sell"), 6) >= bucket).withColumn("imbalance", F.abs(F.col("buy") - F.col("sell")))
    full = in_blocks(full, F.col("bucket"), length, 10_000)
    back = Window.partitionBy(*KEY, "_block").orderBy("bucket").rowsBetween(-(length - 1), 0)
    value = F.sum("imbalance").over(back) / (bucket * length)
    return full.withColumn("vpin", F.when(F.count("*").over(back) >= length, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)).where("_own").select(*KEY, "bucket", "minute", "buy", "sell", "imbalance", "vpin")
