"""Minute indicators: flows, bands, regimes, gaps, pivots and profiles.

Series are partitioned by (symbol, market). Wide trailing windows are
differences of running sums on the gap-free spine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.stats import clip01, direction, ratio, rows_back, slope
from quayside.operators.minute import around, bars, emas, filled, floor_to, minute_index, profile, with_rolling
from quayside.sources.events import KEY

WINDOWS = {"15m": 15, "1h": 60, "4h": 240, "1d": 1440, "3d": 4320}


def both_markets(df: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """futures beside spot: columns suffixed _f and _s."""
    f = df.where("market = 'futures'").select(*on, *[F.col(c).alias(f"{c}_f") for c in columns])
    s = df.where("market = 'spot'").select(*on, *[F.col(c).alias(f"{c}_s") for c in columns])
    return f.join(s, on)


def whale_trades(on: DataFrame, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """Large-trade sums per window in both markets, their gap and dominance."""
    names = {f"{c}_{k}": (c, n) for k, n in windows.items() for c in ("whale_notional", "whale_buy")}
    r = both_markets(with_rolling(on, names), ["symbol", "minute"], list(names))
    rows = F.array(*[F.struct(F.lit(k).alias("window_code"), *[F.col(f"whale_{c}_{k}_{m}").alias(f"{c}_{m}") for c in ("notional", "buy") for m in "fs"]) for k in windows])
    long = r.select("symbol", "minute", F.explode(rows).alias("r")).select("symbol", "minute", "r.*")
    delta = lambda m: 2 * F.col(f"buy_{m}") - F.col(f"notional_{m}")
    return long.withColumns({"delta_f": delta("f"), "delta_s": delta("s"), "gap": delta("f") - delta("s"), "dominance": F.coalesce(ratio(F.col("notional_f"), F.col("notional_f") + F.col("notional_s")), F.lit(0.5))})


def anchored_vwap(on: DataFrame, minutes: int = 10080) -> DataFrame:
    """Rolling VWAP of both markets over 7 days and their gap."""
    r = with_rolling(on, {"n7": ("notional", minutes), "q7": ("qty", minutes)}).withColumn("avwap", ratio(F.col("n7"), F.col("q7"), 1e-9))
    b = both_markets(r, ["symbol", "minute"], ["avwap", "vwap"])
    return b.withColumns({"gap": F.col("avwap_f") - F.col("avwap_s"), "minute_gap": F.col("vwap_f") - F.col("vwap_s")})


def rvwap_bands(on: DataFrame, windows: dict[str, int] | None = None, least: int = 5) -> DataFrame:
    """Volume-weighted mean of the typical price, its deviation, bands of one
    and two deviations and the last price's z, per window."""
    windows = windows or {k: WINDOWS[k] for k in ("15m", "4h", "1d")}
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    held = on.withColumns({"pq": typical * F.col("qty"), "ppq": typical * typical * F.col("qty"), "traded": (F.col("qty") > 0).cast("double")})
    names = {f"{c}_{k}": (c, n) for k, n in windows.items() for c in ("pq", "ppq", "qty", "traded")}
    r = with_rolling(held, names)
    rows = F.array(*[F.struct(F.lit(k).alias("window_code"), *[F.col(f"{c}_{k}").alias(c) for c in ("pq", "ppq", "qty", "traded")]) for k in windows])
    long = r.select(*KEY, "minute", "last_price", F.explode(rows).alias("r")).select(*KEY, "minute", "last_price", "r.*").where(F.round("traded") >= least)
    mean = F.col("pq") / F.col("qty")
    sigma = F.sqrt(F.greatest(F.col("ppq") / F.col("qty") - mean * mean, F.lit(0.0)))
    return long.select(*KEY, "minute", "window_code", mean.alias("rvwap"), sigma.alias("sigma"), (mean + sigma).alias("up1"), (mean - sigma).alias("down1"), (mean + 2 * sigma).alias("up2"), (mean - 2 * sigma).alias("down2"), ((F.col("last_price") - mean) / (sigma + 1e-12)).alias("z"))


def cvd_pack(on: DataFrame, minutes: int = 240, back: int = 64, trend: int = 30) -> DataFrame:
    """Flow per bar (named by its end) in both markets: slant of delta over
    range, z of delta against the prior bars, trend of CVD, lead and driver."""
    b = bars(on, minutes, ceil=True)
    span = F.col("high") - F.col("low")
    prior = rows_back(KEY, "bar", back, current=False)
    sd = F.stddev_pop("delta").over(prior)
    z = F.when(F.count("delta").over(prior) >= back, F.when(sd <= 1e-12, 0.0).otherwise((F.col("delta") - F.avg("delta").over(prior)) / sd))
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy("bar"))
    b = b.withColumns({"slant": F.when(span >= 0.01, F.col("delta") / span), "z": z, "at": at})
    b = b.withColumn("trend", slope(F.col("cvd"), F.col("at"), rows_back(KEY, "bar", trend)))
    d = both_markets(b, ["symbol", "bar"], ["delta", "cvd", "slant", "z", "trend"])
    lead = F.coalesce(ratio(F.abs("delta_s"), F.abs("delta_s") + F.abs("delta_f")), F.lit(0.5))
    return d.withColumn("lead", lead).withColumn("driver", F.when(F.col("lead") >= 0.6, "spot").when(F.col("lead") < 0.3, "futures").otherwise("mixed"))


def volume_pulse(on: DataFrame, width: int = 15, back: int = 60) -> DataFrame:
    """Rolling volume against the overlapping rolling volumes before it."""
    r = with_rolling(on, {"volume": ("qty", width)})
    prior = rows_back(KEY, "minute", back, current=False)
    sd, mean = F.stddev_pop("volume").over(prior), F.avg("volume").over(prior)
    z = F.when(F.count("volume").over(prior) >= back, F.when(sd <= 1e-9, 0.0).otherwise((F.col("volume") - mean) / sd))
    return r.withColumn("z", z).select(*KEY, "minute", "volume", "z", (F.col("z") >= 2).alias("z2"), (F.col("z") >= 3).alias("z3"))


def ema_regime(on: DataFrame, every: int = 15, frames: tuple[str, ...] = ("4h", "1d"), base: tuple[int, ...] = (13, 21, 34), fast: int = 100, slow: int = 200) -> DataFrame:
    """At every `every` minutes' end (`at`): EMAs of minute closes and their
    band; per frame the fast and slow EMA of the closes of its last closed bar,
    and its trend; the regime on which all frames agree. Untraded minutes close
    at the last price. EMAs within a trillionth of each other are even."""
    m = on.select(*KEY, "minute", F.coalesce("close", "last_price").alias("price")).where("price is not null")
    names = {f"ema_{p}": p for p in base}
    minute = F.expr("interval 1 minute")
    r = emas(m, minute_index(), "price", names).where(F.pmod(minute_index() + 1, F.lit(every)) == 0)
    r = r.select(*KEY, (F.col("minute") + minute).alias("at"), *names).withColumns({"band_low": F.least(*names), "band_high": F.greatest(*names)})
    for code in frames:
        n = WINDOWS[code]
        b = m.groupBy(*KEY, floor_to(F.col("minute"), n).alias("bar")).agg(F.max_by("price", "minute").alias("price"))
        b = emas(b, F.floor(minute_index("bar") / n), "price", {f"fast_{code}": fast, f"slow_{code}": slow}, order="bar")
        # bars have no gaps: the last closed one ends where the frame of `at` begins
        b = b.select(*KEY, (F.col("bar") + F.make_dt_interval(mins=F.lit(n))).alias("_end"), f"fast_{code}", f"slow_{code}")
        r = r.withColumn("_end", floor_to(F.col("at"), n)).join(b, [*KEY, "_end"], "left").drop("_end")
        ahead, even = F.col(f"fast_{code}") - F.col(f"slow_{code}"), F.abs(f"slow_{code}") * 1e-12
        r = r.withColumn(f"trend_{code}", F.when(ahead > even, "bull").when(ahead < -even, "bear").otherwise("neutral"))
    agreed = lambda kind: F.greatest(*[F.col(f"trend_{c}") != kind for c in frames], F.lit(False)) == F.lit(False)
    return r.withColumn("regime", F.when(agreed("bull"), "bull").when(agreed("bear"), "bear").otherwise("neutral"))


def fair_value_gaps(b: DataFrame, margin: float = 0.02, body: float = 0.6, impulse: float = 1.3, gap: tuple[float, float] = (0.15, 1.2), location: float = 0.7, length: int = 14, mitigated: float = 0.8, invalid_closes: int = 1) -> DataFrame:
    """Three-bar gaps wider than `margin` between the first and the third bar,
    whose middle bar is mostly body, closes near its end and is an impulse (its
    true range against the ATR before it), and whose width lies in `gap` ATRs.
    What bars from the third on do to a gap: the share filled, the bars that
    touch it, the closes beyond it at the end of the series. A middle bar that
    fails the bull test's close location is not tested for a bear gap."""
    w = Window.partitionBy(*KEY).orderBy("bar")
    t = true_range(b.where("close is not null"))
    frame = rows_back(KEY, "bar", length)
    t = t.withColumn("atr", F.when(F.count("tr").over(frame) >= length, F.avg("tr").over(frame)))
    g = t.withColumns({"h2": F.lag("high", 2).over(w), "l2": F.lag("low", 2).over(w), "o1": F.lag("open").over(w), "c1": F.lag("close").over(w), "h1": F.lag("high").over(w), "l1": F.lag("low").over(w), "tr1": F.lag("tr").over(w), "atr1": F.lag("atr").over(w), "atr2": F.lag("atr", 2).over(w)})
    span = F.col("h1") - F.col("l1") + 1e-12
    g = g.withColumns({"body": F.abs(F.col("c1") - F.col("o1")) / span, "impulse": F.col("tr1") / (F.col("atr2") + 1e-12)}).where((F.col("body") >= body) & (F.col("impulse") >= impulse))
    bull, bear = F.col("low") > F.col("h2") + margin, F.col("high") < F.col("l2") - margin
    g = g.withColumn("direction", F.when(bull, 1).when(bear, -1)).where("direction is not null")
    up = F.col("direction") == 1
    g = g.withColumns({"bottom": F.when(up, F.col("h2")).otherwise(F.col("high")), "top": F.when(up, F.col("low")).otherwise(F.col("l2")), "location": F.when(up, F.col("c1") - F.col("l1")).otherwise(F.col("h1") - F.col("c1")) / span})
    g = g.withColumn("width_atr", (F.col("top") - F.col("bottom")) / (F.col("atr1") + 1e-12)).where((F.col("location") >= location) & F.col("width_atr").between(*gap))
    g = g.select(*KEY, "bar", "direction", "bottom", "top", "body", "impulse", "location", "width_atr")
    later = b.where("close is not null").select(*KEY, F.col("bar").alias("at"), F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("close").alias("end"))
    met = g.join(later, KEY).where("at >= bar")
    beyond = F.when(up, F.col("end") < F.col("bottom") - margin).otherwise(F.col("end") > F.col("top") + margin)
    touch = F.when(up, F.col("lo") <= F.col("top")).otherwise(F.col("hi") >= F.col("bottom"))
    own = g.columns
    z = met.groupBy(*own).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(touch.cast("long")).alias("touches"), F.max(F.when(~beyond, F.col("at"))).alias("sound"), F.array_sort(F.collect_list(F.when(beyond, F.col("at")))).alias("out"))
    fill = clip01(F.when(up, F.col("top") - F.col("lo")).otherwise(F.col("hi") - F.col("bottom")) / (F.col("top") - F.col("bottom") + 1e-12))
    run = F.size(F.filter("out", lambda x: F.col("sound").isNull() | (x > F.col("sound"))))
    z = z.withColumns({"fill": fill, "run": run})
    state = F.when(F.col("run") >= invalid_closes, "invalidated").when(F.col("fill") >= 1, "fully_filled").when(F.col("fill") >= mitigated, "mitigated").when(F.col("fill") > 0, "partially_filled").otherwise("fresh")
    score = clip01(0.4 * F.col("body") + 0.3 * F.least(F.col("impulse") / 2, F.lit(1.0)) + 0.3 * F.col("location"))
    return z.withColumns({"state": state, "score": score}).select(*own, "touches", "fill", "state", "score")


def footprint(p: DataFrame, keys: list[str], least: float = 3.0) -> DataFrame:
    """Diagonal imbalances of a tick profile, their stacks, and unfinished
    auctions. A tick that is not adjacent counts as empty."""
    w = Window.partitionBy(*keys).orderBy("tick")
    below = F.when(F.lag("tick").over(w) == F.col("tick") - 1, F.lag("sell_qty").over(w)).otherwise(0.0)
    above = F.when(F.lead("tick").over(w) == F.col("tick") + 1, F.lead("buy_qty").over(w)).otherwise(0.0)
    rated = p.withColumns({"buy_flag": (F.col("buy_qty") > 0) & (F.col("buy_qty") / (below + 1e-12) >= least), "sell_flag": (F.col("sell_qty") > 0) & (F.col("sell_qty") / (above + 1e-12) >= least)})
    ends = Window.partitionBy(*keys)
    both = (F.col("buy_qty") > 0) & (F.col("sell_qty") > 0)
    return rated.withColumns({"unfinished_top": both & (F.col("tick") == F.max("tick").over(ends)), "unfinished_bottom": both & (F.col("tick") == F.min("tick").over(ends))})


def stacks(rated: DataFrame, keys: list[str], flag: str, least: int = 3) -> DataFrame:
    """Runs of at least `least` flagged ticks without a gap."""
    w = Window.partitionBy(*keys).orderBy("tick")
    runs = rated.where(flag).withColumn("run", F.col("tick") - F.row_number().over(w))
    return runs.groupBy(*keys, "run").agg(F.min("tick").alias("low_tick"), F.max("tick").alias("high_tick"), F.count("*").alias("ticks"), F.sum(F.col("buy_qty") + F.col("sell_qty")).alias("qty")).where(F.col("ticks") >= least).drop("run")


def profile_ranks(p: DataFrame, keys: list[str], top: int) -> DataFrame:
    """Ticks by volume, ties to the lower tick; the point of control is the
    greatest volume's highest tick. Local peaks exceed both neighbours."""
    p = p.withColumn("volume", F.round(F.col("buy_qty") + F.col("sell_qty"), 9))
    ranked = Window.partitionBy(*keys).orderBy(F.desc("volume"), "tick")
    poc = Window.partitionBy(*keys).orderBy(F.desc("volume"), F.desc("tick"))
    w = Window.partitionBy(*keys).orderBy("tick")
    near = lambda f, d: F.when(f("tick").over(w) == F.col("tick") + d, f("volume").over(w)).otherwise(0.0)
    p = p.withColumns({"rank": F.row_number().over(ranked), "is_poc": F.row_number().over(poc) == 1, "is_peak": (F.col("volume") > near(F.lag, -1)) & (F.col("volume") > near(F.lead, 1)), "share": F.col("volume") / F.sum("volume").over(Window.partitionBy(*keys))})
    return p.where((F.col("rank") <= top) | F.col("is_poc"))


def _ticks(p: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s): a group's traded ticks in order, one row's array; they are
    bounded by the price range."""
    volume = F.col("buy_qty") + F.col("sell_qty")
    return p.where(volume > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tick", F.col("buy_qty").alias("buy"), F.col("sell_qty").alias("sell"), volume.alias("v")))).alias("s"))


def _area(share: float) -> Column:
    """(lo, hi, got) of _ticks' `s`: places grown from the point of control,
    which is the greatest volume's highest tick, by the fuller neighbour."""
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["v"])
    poc = F.array_max(F.transform("s", lambda x, i: F.struct(x["v"].alias("v"), i.alias("i"))))
    state = lambda lo, hi, got: F.struct(lo.alias("lo"), hi.alias("hi"), got.alias("got"))

    def step(a: Column, _: Column) -> Column:
        up, down = F.get("s", a["hi"] + 1), F.get("s", a["lo"] - 1)
        # untraded ticks are passed on the upper side while the lower neighbour is untraded too
        up_v = F.when(up["tick"] == F.get("s", a["hi"])["tick"] + 1, up["v"]).otherwise(0.0)
        down_v = F.when(down["tick"] == F.get("s", a["lo"])["tick"] - 1, down["v"]).otherwise(0.0)
        done = (a["got"] >= share * F.col("total")) | (up.isNull() & down.isNull())
        rises = up.isNotNull() & (up_v >= down_v)
        return F.when(done, a).when(rises, state(a["lo"], a["hi"] + 1, a["got"] + up["v"])).otherwise(state(a["lo"] - 1, a["hi"], a["got"] + down["v"]))

    return total, poc, F.aggregate("s", state(F.col("poc")["i"], F.col("poc")["i"], F.col("poc")["v"]), step)


def value_area(p: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """(keys, poc, val, vah): grown from the point of control to `share` of the
    volume, upper side first on ties, through untraded ticks. Groups without
    volume have no row."""
    total, poc, area = _area(share)
    held = _ticks(p, keys).withColumns({"total": total, "poc": poc}).withColumn("area", area)
    return held.select(*keys, F.get("s", F.col("poc")["i"])["tick"].alias("poc"), F.get("s", F.col("area")["lo"])["tick"].alias("val"), F.get("s", F.col("area")["hi"])["tick"].alias("vah"))


def key_levels(p: DataFrame, keys: list[str], share: float = 0.7, least: float = 3.0, stack: int = 3) -> DataFrame:
    """value_area's columns and whether `stack` ticks in a row are imbalanced,
    buying against the tick below, selling against the one above."""
    held = _ticks(p, keys)
    beside = lambda x, i, by, side: F.when(F.get("s", i + by)["tick"] == x["tick"] + by, F.get("s", i + by)[side]).otherwise(0.0)

    def stacked(own: str, by: int, other: str) -> Column:
        flags = F.transform("s", lambda x, i: F.struct(x["tick"].alias("tick"), ((x[own] > 0) & (x[own] / (beside(x, i, by, other) + 1e-12) >= least)).alias("flag")))

        def step(a: Column, x: Column) -> Column:
            run = F.when(~x["flag"], 0).when((a["run"] > 0) & (x["tick"] == a["last"] + 1), a["run"] + 1).otherwise(1)
            return F.struct(run.alias("run"), x["tick"].alias("last"), F.greatest(a["most"], run).alias("most"))

        return F.aggregate(flags, F.struct(F.lit(0).alias("run"), F.lit(0).cast("long").alias("last"), F.lit(0).alias("most")), step)["most"] >= stack

    total, poc, area = _area(share)
    held = held.withColumns({"total": total, "poc": poc}).withColumn("area", area)
    tick = lambda i: F.get("s", i)["tick"]
    return held.select(*keys, tick(F.col("poc")["i"]).alias("poc"), tick(F.col("area")["lo"]).alias("val"), tick(F.col("area")["hi"]).alias("vah"), stacked("buy", -1, "sell").alias("stacked_buy"), stacked("sell", 1, "buy").alias("stacked_sell"))


def time_profile(on: DataFrame, session: int = 240, rows: int = 64) -> DataFrame:
    """Minutes spent per price bin of a session's range; every minute adds one
    to each bin its own range covers; ties of the point of control go low."""
    m = on.where("close is not null").withColumn("session", floor_to(F.col("minute"), session))
    w = Window.partitionBy(*KEY, "session")
    m = m.withColumns({"lo": F.min("low").over(w), "hi": F.max("high").over(w)}).withColumn("width", F.greatest((F.col("hi") - F.col("lo")) / rows, F.lit(0.01)))
    bin_ = lambda c: F.least(F.floor((F.col(c) - F.col("lo")) / F.col("width")), F.lit(rows - 1)).cast("int")
    counts = m.withColumn("bin", F.explode(F.sequence(bin_("low"), bin_("high")))).groupBy(*KEY, "session", "bin").agg(F.count("*").alias("tpo"))
    return counts.withColumn("is_poc", F.row_number().over(Window.partitionBy(*KEY, "session").orderBy(F.desc("tpo"), "bin")) == 1)


def true_range(b: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """`tr`: the bar's range or its reach from the close before; the first
    bar's own close stands in for the one before."""
    before = F.coalesce(F.lag("close").over(Window.partitionBy(*keys).orderBy("bar")), F.col("close"))
    return b.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(b: DataFrame, length: int) -> DataFrame:
    """Mean true range of the last `length` bars, null before there are so many."""
    frame = rows_back(KEY, "bar", length)
    return true_range(b).withColumn("atr", F.when(F.count("tr").over(frame) >= length, F.avg("tr").over(frame)))


def pivots(b: DataFrame, k: int = 3, high: str = "high", low: str = "low") -> DataFrame:
    """Swing highs and lows: beyond the k bars before, not exceeded by the k
    after; known k bars later."""
    w = Window.partitionBy(*KEY).orderBy("bar")
    left, right = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
    whole = (F.count("bar").over(left) == k) & (F.count("bar").over(right) == k)
    up = whole & (F.col(high) > F.max(high).over(left)) & (F.col(high) >= F.max(high).over(right))
    down = whole & (F.col(low) < F.min(low).over(left)) & (F.col(low) <= F.min(low).over(right))
    return b.withColumns({"pivot_high": up, "pivot_low": down, "known_at": F.lead("bar", k).over(w)})


def exhaustion(b: DataFrame, k: int = 3, push: float = 0.02, drop: float = 20.0, relative: float = 0.05, reject: float = 0.65, legs: tuple[int, int] = (3, 180), confirm: int = 5, tick: float = 0.01) -> DataFrame:
    """Successive swing highs at most legs[1] bars apart that rise in price
    while delta and relative delta fall and the bar closes away from its high
    (buying); confirmed by the first of the bars after that closes beyond the
    bar's other end. Lows mirror them (selling)."""
    w = Window.partitionBy(*KEY).orderBy("bar")
    numbered = b.withColumns({"i": F.row_number().over(w), "rd": F.coalesce(ratio(F.col("delta"), F.col("qty")), F.lit(0.0)), "next": F.collect_list(F.struct("bar", "close")).over(w.rowsBetween(1, confirm))})
    p = pivots(numbered, k)

    def side(flag: str, price: str, sign: int) -> DataFrame:
        x = p.where(flag).withColumns({f"from_{c}": F.lag(v).over(w) for c, v in (("bar", "bar"), ("price", price), ("delta", "delta"), ("rd", "rd"), ("i", "i"))})
        span = F.greatest(F.col("high") - F.col("low"), F.lit(tick)) + 1e-12
        end, other = (F.col("high") - F.col("close"), F.col("low")) if sign > 0 else (F.col("close") - F.col("low"), F.col("high"))
        x = x.withColumns({"move": sign * (F.col(price) - F.col("from_price")), "delta_drop": sign * (F.col("from_delta") - F.col("delta")), "rd_drop": sign * (F.col("from_rd") - F.col("rd")), "reject": end / span, "leg": F.col("i") - F.col("from_i")})
        x = x.where((F.round("move", 9) >= push) & (F.col("delta_drop") >= drop) & (F.round("rd_drop", 9) >= relative) & (F.round("reject", 9) >= reject) & F.col("leg").between(*legs))
        beyond = lambda e: sign * (other - e["close"]) >= 2 * tick
        x = x.withColumn("speed_at", F.array_position(F.transform("next", beyond), True)).where("speed_at > 0")
        x = x.withColumn("confirm_bar", F.element_at("next", F.col("speed_at").cast("int"))["bar"])
        score = 0.3 * clip01(F.col("move") / tick / 10) + 0.25 * clip01(F.col("delta_drop") / (3 * drop)) + 0.2 * clip01(F.col("rd_drop") / (3 * relative)) + 0.15 * clip01((F.col("reject") - reject) / (1 - reject)) + 0.1 * clip01(confirm / F.col("speed_at"))
        return x.select(*KEY, "from_bar", "bar", "confirm_bar", F.col(price).alias("price"), "delta_drop", "rd_drop", "reject", score.alias("score"), F.lit("buying" if sign > 0 else "selling").alias("kind"))

    return side("pivot_high", "high", 1).unionByName(side("pivot_low", "low", -1))


def divergences(b: DataFrame, k: int = 3, back: int = 20) -> DataFrame:
    """Price against CVD over successive pivots, in units of ATR and of the
    CVD's deviation: regular and hidden, bullish and bearish."""
    w = Window.partitionBy(*KEY).orderBy("bar")
    before = F.coalesce(F.lag("close").over(w), F.col("close"))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    p = pivots(b.where("close is not null").withColumn("tr", tr), k)
    frame = rows_back(KEY, "bar", back)
    p = p.withColumns({"atr": F.avg("tr").over(frame), "sd": F.stddev_pop("delta").over(frame)})

    def side(flag: str, price: str, sign: int) -> DataFrame:
        legs = p.where(flag).withColumns({"dp": F.col(price) - F.lag(price).over(w), "dc": F.col("cvd") - F.lag("cvd").over(w), "from_bar": F.lag("bar").over(w)})
        x, z = ratio(F.col("dp"), F.col("atr")), ratio(F.col("dc"), F.col("sd"))
        kind = F.when((x >= 0.5) & (z <= -0.5), "bearish_regular" if sign > 0 else "bullish_hidden").when((x <= -0.5) & (z >= 0.5), "bearish_hidden" if sign > 0 else "bullish_regular")
        return legs.withColumns({"price_move": x, "flow_z": z, "kind": kind}).where("kind is not null").select(*KEY, "from_bar", "bar", "kind", "price_move", "flow_z", "known_at")

    return side("pivot_high", "high", 1).unionByName(side("pivot_low", "low", -1))


def event_rows(on: DataFrame, p: DataFrame, minutes: int = 1, tick: float = 0.01, stack: int = 3) -> DataFrame:
    """Futures bars beside the spot bar of their time: prices from the last one
    where nothing traded; the point of control, value area and VWAP of the last
    bar that has them; imbalances of `stack` ticks. p: the bars' profile in ticks of
    `tick`, by (symbol, market, bucket)."""
    b = on.withColumnRenamed("minute", "bar") if minutes == 1 else bars(on, minutes)
    b = b.withColumns({"last": F.col("close"), "rd": F.coalesce(ratio(F.col("delta"), F.col("qty")), F.lit(0.0)), "avwap": ratio(F.col("notional"), F.col("qty"))})
    levels = key_levels(p, [*KEY, "bucket"], stack=stack).withColumnRenamed("bucket", "bar")
    b = filled(b.join(levels, [*KEY, "bar"], "left"), ["last", "poc", "val", "vah", "avwap"], order="bar")
    f = b.where("market = 'futures'")
    f = f.withColumns({c: F.coalesce(c, "last") for c in ("open", "high", "low", "close")})
    f = f.withColumns({c: F.coalesce(F.col(c) * tick, F.col(other)) for c, other in (("poc", "close"), ("val", "low"), ("vah", "high"))})
    f = f.select("symbol", "bar", "open", "high", "low", "close", "delta", "rd", "poc", "val", "vah", "avwap", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("stacked_buy", "stacked_sell")])
    s = b.where("market = 'spot'").select("symbol", "bar", F.col("rd").alias("spot_rd"), F.col("cvd").alias("spot_cvd"), (F.col("delta") * F.coalesce("last", F.lit(0.0))).alias("spot_push"))
    return f.join(s, ["symbol", "bar"])


def absorption(rows: DataFrame, minutes: int = 1, tick: float = 0.01, reject: float = 0.7, span: float = 4.0, least: float = 0.15, near: float = 6.0, confirm: int = 3, longest: int = 30, session: int = 1440, flow: float = 0.15, push: float = 100_000.0) -> DataFrame:
    """Of event_rows: bars that trade against stacked imbalances near a key
    level (point of control, value area, VWAP, extremes of `session` bars
    before) and close away from it. Neighbours of one direction are one event
    of at most `longest` bars, confirmed by the first of `confirm` bars that
    closes in its far half while none leaves it."""
    width = F.make_dt_interval(mins=F.lit(minutes))
    cut = around(rows, F.floor(minute_index("bar") / minutes), session, confirm)
    w = Window.partitionBy("symbol", "_block").orderBy("bar")
    before, after = w.rowsBetween(-session, -1), w.rowsBetween(1, confirm)
    t = cut.withColumns({"top": F.max("high").over(before), "floor": F.min("low").over(before), "next": F.collect_list(F.struct("bar", "close", "low", "high", "spot_cvd", "spot_push")).over(after)}).where("_own")
    range_ = F.greatest(F.col("high") - F.col("low"), F.lit(0.0))
    keys = [F.col("vah"), F.col("val"), F.col("poc"), F.col("avwap"), F.coalesce("top", "vah"), F.coalesce("floor", "val")]
    distance = lambda c: F.least(*[F.abs(F.col(c) - k) / tick for k in keys])
    t = t.withColumns({"up": (F.col("close") - F.col("low")) / (range_ + 1e-12), "down": (F.col("high") - F.col("close")) / (range_ + 1e-12), "d_low": distance("low"), "d_high": distance("high")})
    wide = F.round(range_ / tick, 6) >= span
    bull = F.col("stacked_sell") & wide & (F.col("rd") <= -least) & (F.col("close") > F.col("open")) & (F.round("up", 9) >= reject) & (F.round("d_low", 6) <= near)
    bear = F.col("stacked_buy") & wide & (F.col("rd") >= least) & (F.col("close") < F.col("open")) & (F.round("down", 9) >= reject) & (F.round("d_high", 6) <= near)
    t = t.withColumn("direction", F.when(bull & ~bear, 1).when(bear & ~bull, -1)).where("direction is not null")
    # only candidates of a series meet from here on
    place = F.floor(minute_index("bar") / minutes)
    t = t.withColumn("run", place - F.row_number().over(Window.partitionBy("symbol", "direction").orderBy("bar")))
    t = t.withColumn("piece", F.floor((F.row_number().over(Window.partitionBy("symbol", "direction", "run").orderBy("bar")) - 1) / longest))
    bullish = F.col("direction") == 1
    mean = lambda c: F.avg(c)
    g = t.groupBy("symbol", "direction", "run", "piece").agg(
        F.min("bar").alias("from_bar"),
        F.max("bar").alias("to_bar"),
        F.count("*").alias("n"),
        F.min("low").alias("price_low"),
        F.max("high").alias("price_high"),
        F.sum("delta").alias("delta_sum"),
        mean("rd").alias("rd_mean"),
        mean(F.when(bullish, F.col("up")).otherwise(F.col("down"))).alias("reject"),
        F.min(F.when(bullish, F.col("d_low")).otherwise(F.col("d_high"))).alias("key_distance"),
        F.max("stacked_buy").alias("stacked_buy"),
        F.max("stacked_sell").alias("stacked_sell"),
        mean("spot_rd").alias("spot_rd_mean"),
        F.sum("spot_push").alias("pushed"),
        F.max_by("spot_cvd", "bar").alias("cvd"),
        F.max_by("next", "bar").alias("next"),
    ).where(F.size("next") == confirm)
    half = 0.5 * F.greatest(F.col("price_high") - F.col("price_low"), F.lit(tick))
    # a billionth of a tick more: bounds are sums of prices
    slack = tick * (1 + 1e-9)
    held = F.when(bullish, F.array_min(F.transform("next", lambda x: x["low"])) >= F.col("price_low") - slack).otherwise(F.array_max(F.transform("next", lambda x: x["high"])) <= F.col("price_high") + slack)
    back = lambda x: F.when(bullish, x["close"] >= F.col("price_low") + half).otherwise(x["close"] <= F.col("price_high") - half)
    g = g.withColumn("j", F.array_position(F.transform("next", back), True).cast("int")).where(held & (F.col("j") > 0))
    confirmed = F.element_at("next", F.col("j"))
    g = g.withColumns({"confirm_at": confirmed["bar"] + width, "spot_cvd_change": confirmed["spot_cvd"] - F.col("cvd"), "spot_push": F.col("pushed") + F.aggregate(F.slice("next", F.lit(1), F.col("j")), F.lit(0.0), lambda a, x: a + x["spot_push"])})
    base = 0.35 * clip01(F.abs("rd_mean") / 0.5) + 0.35 * clip01((F.col("reject") - reject) / (1 - reject)) + 0.2 * clip01(1 - F.col("key_distance") / near) + 0.1 * clip01(F.col("n") / 5)
    g = g.withColumns({"score_base": base, "spot_flow": clip01(F.col("direction") * F.col("spot_rd_mean") / flow), "spot_whale": clip01(F.col("direction") * F.col("spot_push") / push)})
    score = 0.85 * F.col("score_base") + 0.1 * F.col("spot_flow") + 0.05 * F.col("spot_whale")
    return g.select("symbol", "direction", "from_bar", (F.col("to_bar") + width).alias("to_at"), "confirm_at", F.when(bullish, F.col("price_low")).otherwise(F.col("price_high")).alias("pivot"), "price_low", "price_high", "delta_sum", "rd_mean", "reject", "key_distance", "stacked_buy", "stacked_sell", "spot_rd_mean", "spot_cvd_change", "spot_flow", "spot_whale", "score_base", score.alias("score"))


def initiation(rows: DataFrame, minutes: int = 1, tick: float = 0.01, z_least: float = 1.5, least: float = 0.2, location: float = 0.7, back: int = 60, hold: int = 5, breaks: float = 2.0, holds: float = 1.0) -> DataFrame:
    """Of event_rows: the first close beyond the value area by `breaks` ticks,
    with unusual and one-sided delta, stacked imbalances of its side and a
    close near its end, that `hold` bars' closes and their delta keep."""
    cut = around(rows, F.floor(minute_index("bar") / minutes), back, hold)
    w = Window.partitionBy("symbol", "_block").orderBy("bar")
    last, after, event = w.rowsBetween(-(back - 1), 0), w.rowsBetween(1, hold), w.rowsBetween(0, hold)
    t = cut.withColumns(
        {
            "z": F.when(F.count("delta").over(last) >= back, (F.col("delta") - F.avg("delta").over(last)) / (F.stddev_pop("delta").over(last) + 1e-12)),
            "from_close": F.lag("close").over(w),
            "from_vah": F.lag("vah").over(w),
            "from_val": F.lag("val").over(w),
            "held": F.count("*").over(after),
            "least_close": F.min("close").over(after),
            "most_close": F.max("close").over(after),
            "delta_sum": F.sum("delta").over(event),
            "rd_mean": F.avg("rd").over(event),
            "price_low": F.min("low").over(event),
            "price_high": F.max("high").over(event),
            "spot_rd_mean": F.avg("spot_rd").over(event),
            "spot_cvd_change": F.last("spot_cvd").over(event) - F.col("spot_cvd"),
            "pushed": F.sum("spot_push").over(event),
        }
    ).where(F.col("_own") & (F.col("held") == hold))
    width = F.greatest(F.col("high") - F.col("low"), F.lit(tick)) + 1e-12
    out, keep = breaks * tick, holds * tick
    above = (F.col("close") > F.col("vah") + out) & (F.col("from_close") <= F.col("from_vah") + out)
    below = (F.col("close") < F.col("val") - out) & (F.col("from_close") >= F.col("from_val") - out)
    up = above & (F.col("z") >= z_least) & (F.col("rd") >= least) & F.col("stacked_buy") & ((F.col("close") - F.col("low")) / width >= location)
    down = below & (F.col("z") <= -z_least) & (F.col("rd") <= -least) & F.col("stacked_sell") & ((F.col("high") - F.col("close")) / width >= location)
    up_holds = (F.col("least_close") >= F.col("vah") - keep) & (F.col("delta_sum") > 0)
    down_holds = (F.col("most_close") <= F.col("val") + keep) & (F.col("delta_sum") < 0)
    t = t.withColumn("direction", F.when(up & ~down & up_holds, 1).when(down & ~up & down_holds, -1)).where("direction is not null")
    bullish = F.col("direction") == 1
    t = t.withColumns(
        {
            "pivot": F.when(bullish, F.col("vah")).otherwise(F.col("val")),
            "adverse": F.greatest(F.when(bullish, F.col("vah") - F.col("price_low")).otherwise(F.col("price_high") - F.col("val")), F.lit(0.0)) / tick,
            "spot_whale": F.col("direction") * F.col("pushed") > 0,
        }
    )
    t = t.withColumn("break_ticks", F.col("direction") * (F.col("close") - F.col("pivot")) / tick)
    base = 0.3 * clip01(F.abs("z") / 3) + 0.3 * clip01(F.abs("rd_mean") / 0.5) + 0.2 * clip01(F.col("break_ticks") / 6) + 0.2
    score = 0.8 * base + 0.15 * clip01(F.col("direction") * F.col("spot_rd_mean")) + 0.05 * F.col("spot_whale").cast("int")
    spot = (F.col("direction") * F.col("spot_rd_mean") >= 0.05) & (F.col("direction") * F.col("spot_cvd_change") >= 0)
    return t.select("symbol", "direction", "bar", (F.col("bar") + F.make_dt_interval(mins=F.lit((hold + 1) * minutes))).alias("confirm_at"), "pivot", "price_low", "price_high", "z", "rd_mean", "break_ticks", "delta_sum", "adverse", spot.alias("spot_break"), "spot_rd_mean", "spot_cvd_change", "spot_whale", score.alias("score"))


def funding(points: DataFrame, minutes: int = 1440) -> DataFrame:
    """Time-weighted rate per interval (the last value carries in and on), the
    state at its end, and the changes in it."""
    w = Window.partitionBy("symbol").orderBy("ts", "point_id")
    span = F.make_dt_interval(mins=F.lit(minutes))
    p = points.withColumns({"next_ts": F.lead("ts").over(w), "changed": F.when(F.abs(F.col("funding_rate") - F.lag("funding_rate").over(w)) <= 1e-12, 0).otherwise(1)})
    ends = p.groupBy("symbol").agg(F.max("ts").alias("end"))
    p = p.join(ends, "symbol").withColumn("until", F.coalesce("next_ts", floor_to(F.col("end"), minutes) + span))
    days = p.withColumn("bucket", F.explode(F.sequence(floor_to(F.col("ts"), minutes), floor_to(F.col("until") - F.expr("interval 1 microsecond"), minutes), span)))
    a, b = F.greatest(F.col("ts"), F.col("bucket")), F.least(F.col("until"), F.col("bucket") + span)
    days = days.withColumn("held", (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6)
    inside = (F.col("ts") >= F.col("bucket")).cast("int")
    return days.groupBy("symbol", "bucket").agg((F.sum(F.col("funding_rate") * F.col("held")) / F.sum("held")).alias("twa"), F.max_by("funding_rate", F.struct("ts", "point_id")).alias("last_rate"), F.max_by("mark_price", F.struct("ts", "point_id")).alias("mark_price"), F.sum(inside * F.col("changed")).alias("changes"))
