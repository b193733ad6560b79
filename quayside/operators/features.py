"""Feature tables per trailing window, on blocks of the gap-free spine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.stats import ratio, zscore
from quayside.operators.minute import in_blocks, minute_index, with_extremes
from quayside.sources.events import KEY

WINDOWS = {"1m": 1, "15m": 15, "1h": 60, "4h": 240, "1d": 1440, "3d": 4320}
SUMS = ("buy_qty", "sell_qty", "qty", "notional", "delta", "whale_count", "whale_notional", "whale_buy")


def window_features(on: DataFrame, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """One row per minute and window: open, high, low and close, sums, relative
    delta, CVD at the end and its least-squares slope (null below 3 minutes),
    VWAP. `active_minutes` counts minutes with volume. Everything is a running
    value of one block partition, so a row costs the same for any width."""
    longest = max(windows.values())
    names = {f"{k}_{c}": (c, n) for k, n in windows.items() for c in (*SUMS, "active", "cvd", "xy")}
    high, low = F.coalesce("high", "last_price"), F.coalesce("low", "last_price")
    base = on.withColumns({"_h": high, "_l": low, "_o": F.coalesce("open", "close", "last_price"), "_c": F.coalesce("close", "last_price"), "active": (F.col("qty") > 0).cast("double")})
    base = with_extremes(base, {x: v for k, n in windows.items() for x, v in ((f"{k}_high", ("max", "_h", n)), (f"{k}_low", ("min", "_l", n)))})
    w = Window.partitionBy(*KEY, "_block").orderBy("minute")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cut = in_blocks(base, minute_index(), longest).withColumn("x", F.row_number().over(w)).withColumn("xy", F.col("x") * F.col("cvd"))
    cut = cut.withColumns({f"_run_{c}": F.sum(F.col(c).cast("double")).over(run) for c in (*SUMS, "active", "cvd", "xy")}).withColumn("_first", F.first("_o").over(run))
    value = lambda c, n: F.col(f"_run_{c}") - F.coalesce(F.lag(f"_run_{c}", n).over(w), F.lit(0.0))
    cut = cut.withColumns({name: value(c, n) for name, (c, n) in names.items()} | {f"{k}_open": F.coalesce(F.lag("_o", n - 1).over(w), F.col("_first")) for k, n in windows.items()})

    def row(k: str, n: int) -> Column:
        g = lambda c: F.col(f"{k}_{c}")
        rows = F.least(F.col("x"), F.lit(n)).cast("double")
        slope = (g("xy") - rows * (2 * F.col("x") - rows + 1) / 2 * g("cvd") / rows) / (rows * (rows * rows - 1) / 12)
        return F.struct(
            F.lit(k).alias("window_code"), g("open").alias("open"), g("high").alias("high"), g("low").alias("low"), F.col("_c").alias("close"), *[g(c).alias(c) for c in SUMS],
            F.coalesce(ratio(g("delta"), g("qty")), F.lit(0.0)).alias("relative_delta"), g("active").cast("long").alias("active_minutes"), F.col("cvd").alias("cvd_last"), F.when(rows >= 3, slope).alias("cvd_slope"), ratio(g("notional"), g("qty")).alias("avwap"),
        )

    return cut.where("_own").select(*KEY, "minute", F.explode(F.array(*[row(k, n) for k, n in windows.items()])).alias("r")).select(*KEY, "minute", "r.*")


def cvd_change(on: DataFrame, minutes: int = 10080) -> DataFrame:
    """CVD now less the CVD of the window's first minute."""
    w = Window.partitionBy(*KEY, "_block").orderBy("minute")
    cut = in_blocks(on, minute_index(), minutes)
    first = F.coalesce(F.lag("cvd", minutes - 1).over(w), F.first("cvd").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.withColumn("cvd_change", F.col("cvd") - first).where("_own").select(*KEY, "minute", "cvd", "cvd_change")


def delta_emas(rows: DataFrame, order: str, width: int = 60, fast: int = 5, slow: int = 20, back: int = 60) -> DataFrame:
    """EMAs of delta over the last `width` rows, seeded with the first of them,
    their difference (burst) and its z against the bursts before it: null below
    slow + 2 rows or 5 bursts."""
    frame = Window.partitionBy(*KEY).orderBy(order).rowsBetween(-(width - 1), 0)
    step = lambda acc, v, p: acc * (1 - 2.0 / (p + 1)) + v * (2.0 / (p + 1))
    seed = F.struct(F.col("v")[0].alias("f"), F.col("v")[0].alias("s"), F.array().cast("array<double>").alias("b"))

    def fold(acc: Column, v: Column) -> Column:
        f, s = step(acc["f"], v, fast), step(acc["s"], v, slow)
        return F.struct(f.alias("f"), s.alias("s"), F.concat(acc["b"], F.array(f - s)).alias("b"))

    r = rows.withColumn("v", F.collect_list("delta").over(frame)).withColumn("e", F.aggregate("v", seed, fold))
    n = F.size("e.b")
    prior = F.slice("e.b", F.greatest(n - back, F.lit(1)), F.least(n - 1, F.lit(back)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    r = r.withColumn("p", F.when(n >= slow + 2, prior)).withColumn("m", total(F.col("p")) / F.size("p"))
    sd = F.sqrt(total(F.transform("p", lambda b: (b - F.col("m")) * (b - F.col("m")))) / F.size("p"))
    burst = F.col("e.f") - F.col("e.s")
    return r.withColumn("sd", sd).select(*KEY, order, F.col("e.f").alias("ema_fast"), F.col("e.s").alias("ema_slow"), burst.alias("burst"), F.when(F.size("p") >= 5, F.when(F.col("sd") <= 1e-12, 0.0).otherwise((burst - F.col("m")) / F.col("sd"))).alias("burst_z"))


def book_features(minutes: DataFrame, back: int = 60) -> DataFrame:
    """Per minute of a book: means, z of order flow over the last minutes, the
    book's side against order flow's. Zero counts as positive. Frames reach
    over blocks of a day's minutes."""
    cut = in_blocks(minutes.withColumn("at", F.row_number().over(Window.partitionBy(*KEY).orderBy("minute"))), F.col("at"), back)
    frame = Window.partitionBy(*KEY, "_block").orderBy("minute").rowsBetween(-(back - 1), 0)
    mean = F.col("obi_sum") / F.col("sample_count")
    side = lambda c: F.when(c >= 0, 1).otherwise(-1)
    out = cut.withColumns({"obi": mean, "spread": F.col("spread_sum") / F.col("sample_count"), "ofi_z": zscore(F.col("ofi_sum"), frame)})
    return out.withColumns({"confirms": side(F.col("obi")) == side(F.col("ofi_sum")), "fill": F.least(F.greatest(F.col("sample_count") / 50, F.lit(0.0)), F.lit(1.0))}).where("_own").select(*KEY, "minute", "obi", "spread", "ofi_z", "confirms", "fill")
