"""Market queries over the event table, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.operators import indicators as ind
from quayside.operators import minute as mn
from quayside.sources import events as src
from quayside.sources.events import KEY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def told(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, times as text: equal in either engine. The small shift
    keeps ties from turning on the order of a sum."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        if kind == "double":
            c = F.round(c + 1e-9, places) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


T = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def R(x: str) -> str:  # noqa: N802
    return f"round({x} + 1e-9, 6) + 0.0"


BASE = """
trades AS (SELECT event_id AS trade_id, 'S' || CAST(user_id % 4 AS VARCHAR) AS symbol, CASE WHEN event_id % 2 = 0 THEN 'futures' ELSE 'spot' END AS market, ts, value AS price,
  coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) + 1 AS qty, CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 1 ELSE -1 END AS side FROM events)"""
MINUTES = (
    BASE
    + """,
minutes AS (SELECT symbol, market, date_trunc('minute', ts) AS minute, count(*) AS trade_count, sum(CASE WHEN side >= 0 THEN qty ELSE 0 END) AS buy_qty, sum(CASE WHEN side < 0 THEN qty ELSE 0 END) AS sell_qty,
  sum(price * qty) AS notional, first(price ORDER BY ts, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, trade_id) AS close,
  sum(CASE WHEN price * qty >= 10000 THEN price * qty ELSE 0 END) AS whale_notional, sum(CASE WHEN price * qty >= 10000 AND side >= 0 THEN price * qty ELSE 0 END) AS whale_buy, sum(CASE WHEN price * qty >= 10000 THEN 1 ELSE 0 END) AS whale_count
  FROM trades GROUP BY ALL)"""
)
HISTORY = (
    MINUTES
    + """,
ends AS (SELECT symbol, market, min(minute) AS a, max(minute) AS b FROM minutes GROUP BY ALL),
spine AS (SELECT symbol, market, unnest(generate_series(a, b, INTERVAL 1 MINUTE)) AS minute FROM ends),
history AS (SELECT s.symbol, s.market, s.minute, coalesce(trade_count, 0) AS trade_count, coalesce(buy_qty, 0) AS buy_qty, coalesce(sell_qty, 0) AS sell_qty, coalesce(notional, 0) AS notional, open, high, low, close,
  coalesce(whale_notional, 0) AS whale_notional, coalesce(whale_buy, 0) AS whale_buy, coalesce(buy_qty, 0) + coalesce(sell_qty, 0) AS qty, coalesce(buy_qty, 0) - coalesce(sell_qty, 0) AS delta,
  sum(coalesce(buy_qty, 0) - coalesce(sell_qty, 0)) OVER w AS cvd, last_value(close IGNORE NULLS) OVER w AS last_price
  FROM spine s LEFT JOIN minutes m ON s.symbol = m.symbol AND s.market = m.market AND s.minute = m.minute
  WINDOW w AS (PARTITION BY s.symbol, s.market ORDER BY s.minute ROWS UNBOUNDED PRECEDING))"""
)


def bar_sql(minutes: int, ceil: bool = False) -> str:
    plus = f" + INTERVAL {minutes} MINUTE" if ceil else ""
    return f"""
bars AS (SELECT symbol, market, time_bucket(INTERVAL {minutes} MINUTE, minute, TIMESTAMP '1970-01-01'){plus} AS bar, first(open ORDER BY minute) FILTER (close IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY minute) FILTER (close IS NOT NULL) AS close, sum(qty) AS qty, sum(notional) AS notional, sum(delta) AS delta, last(cvd ORDER BY minute) AS cvd, sum(trade_count)::BIGINT AS trade_count, count(*) AS minutes FROM history GROUP BY ALL)"""


def minutes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.trade_minutes(src.trades(spark, sf_dir))


def history_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.history(minutes_of(spark, sf_dir))


@query(
    f"WITH {MINUTES} SELECT symbol, market, {T.format('minute')} AS minute, trade_count, {R('buy_qty')} AS buy_qty, {R('sell_qty')} AS sell_qty, {R('open')} AS open, {R('high')} AS high, {R('low')} AS low, {R('close')} AS close, whale_count::BIGINT AS whale_count, {R('whale_notional')} AS whale_notional FROM minutes"
)
def trade_minutes(spark, sf_dir):
    return told(minutes_of(spark, sf_dir).select(*KEY, "minute", "trade_count", "buy_qty", "sell_qty", "open", "high", "low", "close", "whale_count", "whale_notional"))


@query(f"WITH {HISTORY} SELECT symbol, market, {T.format('minute')} AS minute, {R('qty')} AS qty, {R('delta')} AS delta, {R('CASE WHEN qty > 0 THEN delta / qty ELSE 0 END')} AS relative_delta, {R('cvd')} AS cvd, {R('CASE WHEN qty > 0 THEN notional / qty END')} AS vwap, {R('last_price')} AS last_price FROM history")
def minute_flow(spark, sf_dir):
    """Trades to minutes, gap-free spine, delta, running CVD, last price."""
    return told(history_of(spark, sf_dir).select(*KEY, "minute", "qty", "delta", "relative_delta", "cvd", "vwap", "last_price"))


def _bars(name: str, minutes: int) -> None:
    def run(spark, sf_dir):
        return told(mn.bars(history_of(spark, sf_dir), minutes).select(*KEY, "bar", "open", "high", "low", "close", "qty", "delta", "cvd", "trade_count", "minutes"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {HISTORY}, {bar_sql(minutes)} SELECT symbol, market, {T.format('bar')} AS bar, {R('open')} AS open, {R('high')} AS high, {R('low')} AS low, {R('close')} AS close, {R('qty')} AS qty, {R('delta')} AS delta, {R('cvd')} AS cvd, trade_count, minutes FROM bars"


for _name, _minutes in (("bars_15m", 15), ("bars_1h", 60), ("bars_4h", 240), ("bars_1d", 1440), ("bars_3d", 4320)):
    _bars(_name, _minutes)


@query(
    f"""WITH {HISTORY}, {bar_sql(1440)}, s AS (SELECT symbol, market, bar, first_value(open) OVER w AS open, max(high) OVER w AS high, min(low) OVER w AS low, close, sum(qty) OVER w AS qty, count(*) OVER w AS n, min(bar) OVER w AS first_bar FROM bars WHERE close IS NOT NULL
    WINDOW w AS (PARTITION BY symbol, market ORDER BY bar ROWS 2 PRECEDING)) SELECT symbol, market, {T.format('first_bar')} AS open_bar, {R('open')} AS open, {R('high')} AS high, {R('low')} AS low, {R('close')} AS close, {R('qty')} AS qty FROM s WHERE n = 3"""
)
def sliding_3d(spark, sf_dir):
    """A bar of the last three daily bars, every day."""
    w = Window.partitionBy(*KEY).orderBy("bar").rowsBetween(-2, 0)
    b = mn.bars(history_of(spark, sf_dir), 1440).where("close is not null")
    s = b.select(*KEY, F.min("bar").over(w).alias("open_bar"), F.first("open").over(w).alias("open"), F.max("high").over(w).alias("high"), F.min("low").over(w).alias("low"), "close", F.sum("qty").over(w).alias("qty"), F.count("*").over(w).alias("n"))
    return told(s.where("n = 3").drop("n"))


def frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol, market ORDER BY minute ROWS {n - 1} PRECEDING)"


@query(
    f"""WITH {HISTORY}, w AS ({' UNION ALL '.join(f"SELECT symbol, market, minute, '{k}' AS window_code, sum(whale_notional) {frame(n)} AS notional, sum(whale_buy) {frame(n)} AS buy FROM history" for k, n in ind.WINDOWS.items())})
    SELECT f.symbol, {T.format('f.minute')} AS minute, f.window_code, {R('f.notional')} AS notional_f, {R('s.notional')} AS notional_s, {R('2 * f.buy - f.notional')} AS delta_f, {R('2 * s.buy - s.notional')} AS delta_s, {R('CASE WHEN f.notional + s.notional > 1e-9 THEN f.notional / (f.notional + s.notional) ELSE 0.5 END')} AS dominance
    FROM w f JOIN w s ON f.symbol = s.symbol AND f.minute = s.minute AND f.window_code = s.window_code WHERE f.market = 'futures' AND s.market = 'spot'"""
)
def whale_windows(spark, sf_dir):
    w = ind.whale_trades(history_of(spark, sf_dir))
    return told(w.select("symbol", "minute", "window_code", "notional_f", "notional_s", "delta_f", "delta_s", "dominance"))


@query(
    f"""WITH {HISTORY}, w AS (SELECT symbol, market, minute, sum(notional) {frame(10080)} AS n7, sum(qty) {frame(10080)} AS q7 FROM history), a AS (SELECT *, CASE WHEN q7 > 0.5 THEN n7 / q7 END AS avwap FROM w)
    SELECT f.symbol, {T.format('f.minute')} AS minute, {R('f.avwap')} AS avwap_f, {R('s.avwap')} AS avwap_s, {R('f.avwap - s.avwap')} AS gap FROM a f JOIN a s ON f.symbol = s.symbol AND f.minute = s.minute WHERE f.market = 'futures' AND s.market = 'spot'"""
)
def anchored_vwap(spark, sf_dir):
    """Rolling 7-day VWAP of both markets, every minute."""
    a = ind.anchored_vwap(history_of(spark, sf_dir))
    return told(a.select("symbol", "minute", "avwap_f", "avwap_s", "gap"))


@query(
    f"""WITH {HISTORY}, p AS (SELECT *, (high + low + close) / 3 AS t FROM history), w AS ({' UNION ALL '.join(f"SELECT symbol, market, minute, '{k}' AS window_code, last_price, sum(coalesce(t * qty, 0)) {frame(n)} AS pq, sum(coalesce(t * t * qty, 0)) {frame(n)} AS ppq, sum(qty) {frame(n)} AS q, sum(CASE WHEN qty > 0 THEN 1 ELSE 0 END) {frame(n)} AS n FROM p" for k, n in (('15m', 15), ('4h', 240), ('1d', 1440)))}), m AS (SELECT *, pq / q AS mean, sqrt(greatest(ppq / q - (pq / q) * (pq / q), 0)) AS sigma FROM w WHERE n >= 5)
    SELECT symbol, market, {T.format('minute')} AS minute, window_code, round(mean + 1e-7, 4) AS rvwap, round(sigma + 1e-6, 4) AS sigma, round(mean + sigma + 1e-6, 4) AS up1, round(mean - sigma + 1e-6, 4) AS down1, round(mean + 2 * sigma + 1e-6, 4) AS up2, round(mean - 2 * sigma + 1e-6, 4) AS down2, round((last_price - mean) / (sigma + 1e-12) + 1e-6, 4) + 0.0 AS z FROM m"""
)
def rvwap_bands(spark, sf_dir):
    b = ind.rvwap_bands(history_of(spark, sf_dir))
    return told(b.select(*KEY, "minute", "window_code", F.round(F.col("rvwap") + 1e-7, 4).alias("rvwap"), *[(F.round(F.col(c) + 1e-6, 4) + F.lit(0.0)).alias(c) for c in ("sigma", "up1", "down1", "up2", "down2", "z")]))


@query(
    f"""WITH {HISTORY}, {bar_sql(240, True)}, z AS (SELECT symbol, market, bar, delta, cvd, CASE WHEN high - low >= 0.01 THEN delta / (high - low) END AS slant, CASE WHEN count(*) OVER p >= 64 THEN CASE WHEN stddev_pop(delta) OVER p <= 1e-12 THEN 0 ELSE (delta - avg(delta) OVER p) / stddev_pop(delta) OVER p END END AS z
    FROM bars WINDOW p AS (PARTITION BY symbol, market ORDER BY bar ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING))
    SELECT f.symbol, {T.format('f.bar')} AS bar, {R('f.delta')} AS delta_f, {R('s.delta')} AS delta_s, {R('f.slant')} AS slant_f, {R('s.slant')} AS slant_s, {R('f.z')} AS z_f, {R('s.z')} AS z_s, CASE WHEN coalesce(abs(s.delta) / nullif(abs(s.delta) + abs(f.delta), 0), 0.5) >= 0.6 THEN 'spot' WHEN coalesce(abs(s.delta) / nullif(abs(s.delta) + abs(f.delta), 0), 0.5) < 0.3 THEN 'futures' ELSE 'mixed' END AS driver
    FROM z f JOIN z s ON f.symbol = s.symbol AND f.bar = s.bar WHERE f.market = 'futures' AND s.market = 'spot'"""
)
def cvd_pack(spark, sf_dir):
    return told(ind.cvd_pack(history_of(spark, sf_dir)).select("symbol", "bar", "delta_f", "delta_s", "slant_f", "slant_s", "z_f", "z_s", "driver"))


@query(
    f"""WITH {HISTORY}, t AS (SELECT *, sum(qty) OVER (PARTITION BY symbol, market ORDER BY minute ROWS UNBOUNDED PRECEDING) AS upto FROM history WHERE qty > 0),
    p AS (SELECT *, unnest(generate_series(floor((upto - qty) / 50)::BIGINT, greatest(floor((upto - qty) / 50)::BIGINT, ceil(upto / 50)::BIGINT - 1))) AS bucket FROM t),
    f AS (SELECT symbol, market, bucket, sum(buy_qty * (least(upto, (bucket + 1) * 50) - greatest(upto - qty, bucket * 50)) / qty) AS buy, sum(sell_qty * (least(upto, (bucket + 1) * 50) - greatest(upto - qty, bucket * 50)) / qty) AS sell, max(minute) AS minute FROM p GROUP BY ALL)
    SELECT symbol, market, bucket, {T.format('minute')} AS minute, {R('abs(buy - sell)')} AS imbalance, {R('CASE WHEN count(*) OVER b >= 50 THEN least(greatest(sum(abs(buy - sell)) OVER b / 2500, 0), 1) ELSE 0 END')} AS vpin FROM f WHERE round(buy + sell, 6) >= 50 WINDOW b AS (PARTITION BY symbol, market ORDER BY bucket ROWS 49 PRECEDING)"""
)
def volume_toxicity(spark, sf_dir):
    return told(mn.vpin(history_of(spark, sf_dir)).select(*KEY, "bucket", "minute", "imbalance", "vpin"))


@query(
    f"""WITH {HISTORY}, v AS (SELECT symbol, market, minute, sum(qty) {frame(15)} AS volume FROM history), z AS (SELECT *, CASE WHEN count(*) OVER p >= 60 THEN CASE WHEN stddev_pop(volume) OVER p <= 1e-9 THEN 0 ELSE (volume - avg(volume) OVER p) / stddev_pop(volume) OVER p END END AS z FROM v WINDOW p AS (PARTITION BY symbol, market ORDER BY minute ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
    SELECT symbol, market, {T.format('minute')} AS minute, {R('volume')} AS volume, round(z + 1e-7, 4) + 0.0 AS z FROM z"""
)
def volume_pulse(spark, sf_dir):
    v = ind.volume_pulse(history_of(spark, sf_dir))
    return told(v.select(*KEY, "minute", "volume", (F.round(F.col("z") + 1e-7, 4) + F.lit(0.0)).alias("z")))


def _frame_sql(code: str) -> str:
    n, step = ind.WINDOWS[code], lambda p: f"e.{p[0]} * (1 - 2.0::DOUBLE / {p[1] + 1}) + n.price * (2.0::DOUBLE / {p[1] + 1})"
    return f"""b{code} AS (SELECT symbol, market, bar, price, row_number() OVER (PARTITION BY symbol, market ORDER BY bar) AS i FROM (SELECT symbol, market, time_bucket(INTERVAL {n} MINUTE, minute, TIMESTAMP '1970-01-01') AS bar, arg_max(price, minute) AS price FROM m GROUP BY ALL)),
    e{code} AS (SELECT symbol, market, bar, i, price AS fast, price AS slow FROM b{code} WHERE i = 1 UNION ALL SELECT n.symbol, n.market, n.bar, n.i, {step(('fast', 100))}, {step(('slow', 200))} FROM e{code} e JOIN b{code} n ON n.symbol = e.symbol AND n.market = e.market AND n.i = e.i + 1),
    t{code} AS (SELECT symbol, market, bar + INTERVAL {n} MINUTE AS until, fast, slow, CASE WHEN fast - slow > abs(slow) * 1e-12 THEN 'bull' WHEN slow - fast > abs(slow) * 1e-12 THEN 'bear' ELSE 'neutral' END AS trend FROM e{code})"""


def _base_sql(p: int) -> str:
    return f"sum(pow(1 - 2.0::DOUBLE / {p + 1}, k) * CASE WHEN m.i = 1 THEN 1 ELSE 2.0::DOUBLE / {p + 1} END * m.price) AS ema_{p}"


# minutes more than 700 back weigh less than 1e-17 together
@query(
    f"""WITH RECURSIVE {HISTORY}, m AS (SELECT symbol, market, minute, coalesce(close, last_price) AS price, row_number() OVER (PARTITION BY symbol, market ORDER BY minute) AS i FROM history),
    a AS (SELECT *, unnest(generate_series(0, 700)) AS k FROM m WHERE (epoch(minute)::BIGINT // 60 + 1) % 15 = 0),
    x AS (SELECT a.symbol, a.market, a.minute + INTERVAL 1 MINUTE AS at, {_base_sql(13)}, {_base_sql(21)}, {_base_sql(34)} FROM a JOIN m ON m.symbol = a.symbol AND m.market = a.market AND m.i = a.i - a.k GROUP BY ALL), {_frame_sql('4h')}, {_frame_sql('1d')}
    SELECT x.symbol, x.market, {T.format('x.at')} AS at, {R('ema_13')} AS ema_13, {R('ema_21')} AS ema_21, {R('ema_34')} AS ema_34, {R('least(ema_13, ema_21, ema_34)')} AS band_low, {R('greatest(ema_13, ema_21, ema_34)')} AS band_high,
    {R('h.fast')} AS fast_4h, {R('h.slow')} AS slow_4h, coalesce(h.trend, 'neutral') AS trend_4h, {R('d.fast')} AS fast_1d, {R('d.slow')} AS slow_1d, coalesce(d.trend, 'neutral') AS trend_1d, CASE WHEN h.trend = d.trend THEN h.trend ELSE 'neutral' END AS regime
    FROM x LEFT JOIN t4h h ON h.symbol = x.symbol AND h.market = x.market AND h.until = time_bucket(INTERVAL 240 MINUTE, x.at, TIMESTAMP '1970-01-01') LEFT JOIN t1d d ON d.symbol = x.symbol AND d.market = x.market AND d.until = time_bucket(INTERVAL 1440 MINUTE, x.at, TIMESTAMP '1970-01-01')"""
)
def ema_regime(spark, sf_dir):
    return told(ind.ema_regime(history_of(spark, sf_dir)))


def _gap_sql(minutes: int) -> str:
    return f"""WITH {HISTORY}, {bar_sql(minutes)}, b AS (SELECT * FROM bars WHERE close IS NOT NULL), t AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) OVER w, close)), abs(low - coalesce(lag(close) OVER w, close))) AS tr FROM b WINDOW w AS (PARTITION BY symbol, market ORDER BY bar)),
    r AS (SELECT *, CASE WHEN count(*) OVER f >= 14 THEN avg(tr) OVER f END AS atr FROM t WINDOW f AS (PARTITION BY symbol, market ORDER BY bar ROWS 13 PRECEDING)),
    g AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(open) OVER w AS o1, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(tr) OVER w AS tr1, lag(atr) OVER w AS atr1, lag(atr, 2) OVER w AS atr2 FROM r WINDOW w AS (PARTITION BY symbol, market ORDER BY bar)),
    d AS (SELECT *, abs(c1 - o1) / (h1 - l1 + 1e-12) AS body, tr1 / (atr2 + 1e-12) AS impulse, CASE WHEN low > h2 + 0.02 THEN 1 WHEN high < l2 - 0.02 THEN -1 END AS direction FROM g),
    z AS (SELECT *, CASE WHEN direction = 1 THEN h2 ELSE high END AS bottom, CASE WHEN direction = 1 THEN low ELSE l2 END AS top, CASE WHEN direction = 1 THEN c1 - l1 ELSE h1 - c1 END / (h1 - l1 + 1e-12) AS location FROM d WHERE direction IS NOT NULL AND body >= 0.6 AND impulse >= 1.3),
    y AS (SELECT symbol, market, bar, direction, bottom, top, body, impulse, location, (top - bottom) / (atr1 + 1e-12) AS width_atr FROM z WHERE location >= 0.7 AND (top - bottom) / (atr1 + 1e-12) BETWEEN 0.15 AND 1.2),
    m AS (SELECT y.*, b.bar AS later, b.low AS lo, b.high AS hi, CASE WHEN direction = 1 THEN b.close < bottom - 0.02 ELSE b.close > top + 0.02 END AS beyond, CASE WHEN direction = 1 THEN b.low <= top ELSE b.high >= bottom END AS touch FROM y JOIN b ON b.symbol = y.symbol AND b.market = y.market AND b.bar >= y.bar),
    n AS (SELECT *, max(CASE WHEN NOT beyond THEN later END) OVER (PARTITION BY symbol, market, bar) AS sound FROM m),
    s AS (SELECT symbol, market, bar, direction, bottom, top, body, impulse, location, width_atr, sum(touch::INT)::BIGINT AS touches, sum((beyond AND (sound IS NULL OR later > sound))::INT) AS run, least(greatest(CASE WHEN direction = 1 THEN top - min(lo) ELSE max(hi) - bottom END / (top - bottom + 1e-12), 0), 1) AS fill FROM n GROUP BY symbol, market, bar, direction, bottom, top, body, impulse, location, width_atr)
    SELECT symbol, market, {T.format('bar')} AS bar, direction::INTEGER AS direction, {R('bottom')} AS bottom, {R('top')} AS top, {R('body')} AS body, {R('impulse')} AS impulse, {R('location')} AS location, {R('width_atr')} AS width_atr, touches, {R('fill')} AS fill,
    CASE WHEN run >= 1 THEN 'invalidated' WHEN fill >= 1 THEN 'fully_filled' WHEN fill >= 0.8 THEN 'mitigated' WHEN fill > 0 THEN 'partially_filled' ELSE 'fresh' END AS state, {R('least(greatest(0.4 * body + 0.3 * least(impulse / 2, 1) + 0.3 * location, 0), 1)')} AS score FROM s"""


def _gaps(name: str, minutes: int) -> None:
    def run(spark, sf_dir):
        return told(ind.fair_value_gaps(mn.bars(history_of(spark, sf_dir), minutes)))

    run.__name__ = name
    query(_gap_sql(minutes))(run)


for _name, _minutes in (("fair_value_gaps_15m", 15), ("fair_value_gaps", 240), ("fair_value_gaps_1d", 1440), ("fair_value_gaps_3d", 4320)):
    _gaps(_name, _minutes)


PROFILE_1D = BASE + """, profile AS (SELECT symbol, market, time_bucket(INTERVAL 1440 MINUTE, ts, TIMESTAMP '1970-01-01') AS bucket, round(price * 100)::BIGINT AS tick, sum(CASE WHEN side >= 0 THEN qty ELSE 0 END) AS buy_qty, sum(CASE WHEN side < 0 THEN qty ELSE 0 END) AS sell_qty FROM trades GROUP BY ALL)"""
PROFILE = BASE + """, profile AS (SELECT symbol, market, floor(price)::BIGINT AS tick, sum(CASE WHEN side >= 0 THEN qty ELSE 0 END) AS buy_qty, sum(CASE WHEN side < 0 THEN qty ELSE 0 END) AS sell_qty FROM trades GROUP BY ALL)"""


def unit_profile(spark, sf_dir) -> DataFrame:
    """Profile over all time in whole units of price."""
    return mn.profile(src.trades(spark, sf_dir).withColumn("price", F.floor("price") / 100))


@query(
    f"""WITH {PROFILE}, f AS (SELECT *, CASE WHEN lag(tick) OVER w = tick - 1 THEN lag(sell_qty) OVER w ELSE 0 END AS below, CASE WHEN lead(tick) OVER w = tick + 1 THEN lead(buy_qty) OVER w ELSE 0 END AS above, max(tick) OVER e AS hi, min(tick) OVER e AS lo FROM profile WINDOW w AS (PARTITION BY symbol, market ORDER BY tick), e AS (PARTITION BY symbol, market))
    SELECT symbol, market, tick, {R('buy_qty')} AS buy_qty, {R('sell_qty')} AS sell_qty, buy_qty > 0 AND buy_qty / (below + 1e-12) >= 3 AS buy_flag, sell_qty > 0 AND sell_qty / (above + 1e-12) >= 3 AS sell_flag, buy_qty > 0 AND sell_qty > 0 AND tick = hi AS unfinished_top, buy_qty > 0 AND sell_qty > 0 AND tick = lo AS unfinished_bottom FROM f"""
)
def footprint(spark, sf_dir):
    return told(ind.footprint(unit_profile(spark, sf_dir), KEY).select(*KEY, "tick", "buy_qty", "sell_qty", "buy_flag", "sell_flag", "unfinished_top", "unfinished_bottom"))


@query(
    f"""WITH {PROFILE}, f AS (SELECT *, CASE WHEN lag(tick) OVER w = tick - 1 THEN lag(sell_qty) OVER w ELSE 0 END AS below FROM profile WINDOW w AS (PARTITION BY symbol, market ORDER BY tick)), r AS (SELECT *, tick - row_number() OVER (PARTITION BY symbol, market ORDER BY tick) AS run FROM f WHERE buy_qty > 0 AND buy_qty / (below + 1e-12) >= 3)
    SELECT symbol, market, min(tick) AS low_tick, max(tick) AS high_tick, count(*) AS ticks, {R('sum(buy_qty + sell_qty)')} AS qty FROM r GROUP BY symbol, market, run HAVING count(*) >= 2"""
)
def imbalance_stacks(spark, sf_dir):
    return told(ind.stacks(ind.footprint(unit_profile(spark, sf_dir), KEY), KEY, "buy_flag", 2))


@query(
    f"""WITH {PROFILE_1D}, v AS (SELECT symbol, market, bucket, tick, round(buy_qty + sell_qty, 9) AS volume FROM profile), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, market, bucket ORDER BY volume DESC, tick) AS rank, row_number() OVER (PARTITION BY symbol, market, bucket ORDER BY volume DESC, tick DESC) = 1 AS is_poc, volume / sum(volume) OVER (PARTITION BY symbol, market, bucket) AS share FROM v)
    SELECT symbol, market, {T.format('bucket')} AS bucket, tick, {R('volume')} AS volume, rank::INTEGER AS rank, is_poc, {R('share')} AS share FROM r WHERE rank <= 5 OR is_poc"""
)
def volume_profile(spark, sf_dir):
    """Daily profile: top ticks and the point of control."""
    return told(ind.profile_ranks(mn.profile(src.trades(spark, sf_dir), 1440), [*KEY, "bucket"], 5).select(*KEY, "bucket", "tick", "volume", "rank", "is_poc", "share"))


def _area_sql(profile: str, keys: list[str]) -> str:
    """CTEs av and area (keys, poc, val, vah) over a profile's traded ticks."""
    k = ", ".join(keys)
    on = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in keys)
    rise = "u.i IS NOT NULL AND CASE WHEN u.tick = h.tick + 1 THEN u.v ELSE 0 END >= CASE WHEN d.tick = l.tick - 1 THEN d.v ELSE 0 END"
    return f"""av AS (SELECT {k}, tick, buy_qty + sell_qty AS v, row_number() OVER (PARTITION BY {k} ORDER BY tick) AS i, row_number() OVER (PARTITION BY {k} ORDER BY buy_qty + sell_qty DESC, tick DESC) AS r, sum(buy_qty + sell_qty) OVER (PARTITION BY {k}) AS total FROM {profile} WHERE buy_qty + sell_qty > 0),
    grown AS (SELECT {k}, tick AS poc, i AS lo, i AS hi, v AS got, total FROM av WHERE r = 1 UNION ALL SELECT {', '.join(f'a.{c}' for c in keys)}, a.poc, CASE WHEN {rise} THEN a.lo ELSE a.lo - 1 END, CASE WHEN {rise} THEN a.hi + 1 ELSE a.hi END, a.got + CASE WHEN {rise} THEN u.v ELSE d.v END, a.total
      FROM grown a JOIN av h ON {on('h', 'a')} AND h.i = a.hi JOIN av l ON {on('l', 'a')} AND l.i = a.lo LEFT JOIN av u ON {on('u', 'a')} AND u.i = a.hi + 1 LEFT JOIN av d ON {on('d', 'a')} AND d.i = a.lo - 1 WHERE a.got < 0.7::DOUBLE * a.total AND (u.i IS NOT NULL OR d.i IS NOT NULL)),
    ends_ AS (SELECT {k}, any_value(poc) AS poc, min(lo) AS lo, max(hi) AS hi FROM grown GROUP BY {k}),
    area AS (SELECT {', '.join(f'e.{c}' for c in keys)}, e.poc, l.tick AS val, h.tick AS vah FROM ends_ e JOIN av l ON {on('l', 'e')} AND l.i = e.lo JOIN av h ON {on('h', 'e')} AND h.i = e.hi)"""


@query(PROFILE.replace("\ntrades", "WITH RECURSIVE trades", 1) + f", {_area_sql('profile', KEY)} SELECT * FROM area")
def value_area(spark, sf_dir):
    return ind.value_area(unit_profile(spark, sf_dir), KEY)


@query(
    f"""WITH {MINUTES}, s AS (SELECT *, time_bucket(INTERVAL 240 MINUTE, minute, TIMESTAMP '1970-01-01') AS session FROM minutes), r AS (SELECT *, min(low) OVER w AS lo, greatest((max(high) OVER w - min(low) OVER w) / 64, 0.01) AS width FROM s WINDOW w AS (PARTITION BY symbol, market, session)),
    b AS (SELECT symbol, market, session, unnest(generate_series(least(floor((low - lo) / width), 63)::INTEGER, least(floor((high - lo) / width), 63)::INTEGER)) AS bin FROM r), c AS (SELECT symbol, market, session, bin, count(*) AS tpo FROM b GROUP BY ALL)
    SELECT symbol, market, {T.format('session')} AS session, bin::INTEGER AS bin, tpo, row_number() OVER (PARTITION BY symbol, market, session ORDER BY tpo DESC, bin) = 1 AS is_poc FROM c"""
)
def time_profile(spark, sf_dir):
    return told(ind.time_profile(minutes_of(spark, sf_dir)))


PIVOT = f"""{HISTORY}, {bar_sql(60)}, t AS (SELECT * FROM bars), p AS (SELECT *, count(*) OVER l = 3 AND count(*) OVER r = 3 AND high > max(high) OVER l AND high >= max(high) OVER r AS pivot_high, count(*) OVER l = 3 AND count(*) OVER r = 3 AND low < min(low) OVER l AND low <= min(low) OVER r AS pivot_low, lead(bar, 3) OVER o AS known_at
  FROM t WHERE close IS NOT NULL WINDOW o AS (PARTITION BY symbol, market ORDER BY bar), l AS (PARTITION BY symbol, market ORDER BY bar ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY symbol, market ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))"""


def hour_bars(spark, sf_dir) -> DataFrame:
    return mn.bars(history_of(spark, sf_dir), 60).where("close is not null")


@query(f"WITH {PIVOT} SELECT symbol, market, {T.format('bar')} AS bar, pivot_high, pivot_low, {T.format('known_at')} AS known_at FROM p WHERE pivot_high OR pivot_low")
def pivots(spark, sf_dir):
    return told(ind.pivots(hour_bars(spark, sf_dir)).where("pivot_high or pivot_low").select(*KEY, "bar", "pivot_high", "pivot_low", "known_at"))


def _exhaustion_sql(flag: str, price: str, sign: int, other: str, end: str, kind: str) -> str:
    return f"""SELECT symbol, market, {T.format('from_bar')} AS from_bar, {T.format('bar')} AS bar, {T.format('nexts[pos].bar')} AS confirm_bar, {R(price)} AS price, {R('delta_drop')} AS delta_drop, {R('rd_drop')} AS rd_drop, {R('reject')} AS reject,
    {R('0.3 * least(move / 0.01 / 10, 1) + 0.25 * least(delta_drop / 60, 1) + 0.2 * least(rd_drop / 0.15, 1) + 0.15 * least(greatest((reject - 0.65) / 0.35, 0), 1) + 0.1 * least(5.0 / pos, 1)')} AS score, '{kind}' AS kind
    FROM (SELECT *, list_position(list_transform(nexts, lambda e: {sign} * ({other} - e.close) >= 0.02), true) AS pos FROM (SELECT *, {sign} * ({price} - lag({price}) OVER w) AS move, {sign} * (lag(delta) OVER w - delta) AS delta_drop, {sign} * (lag(rd) OVER w - rd) AS rd_drop, ({end}) / (greatest(high - low, 0.01) + 1e-12) AS reject, i - lag(i) OVER w AS leg, lag(bar) OVER w AS from_bar FROM x WHERE {flag} WINDOW w AS (PARTITION BY symbol, market ORDER BY bar)))
    WHERE round(move, 9) >= 0.02 AND delta_drop >= 20 AND round(rd_drop, 9) >= 0.05 AND round(reject, 9) >= 0.65 AND leg BETWEEN 3 AND 180 AND pos > 0"""


@query(
    f"""WITH {PIVOT}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol, market ORDER BY bar) AS i, coalesce(delta / nullif(qty, 0), 0) AS rd, list(struct_pack(bar := bar, close := close)) OVER (PARTITION BY symbol, market ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nexts FROM p)
    {_exhaustion_sql('pivot_high', 'high', 1, 'low', 'high - close', 'buying')} UNION ALL {_exhaustion_sql('pivot_low', 'low', -1, 'high', 'close - low', 'selling')}"""
)
def exhaustion(spark, sf_dir):
    return told(ind.exhaustion(hour_bars(spark, sf_dir)))


@query(
    f"""WITH {HISTORY}, {bar_sql(60)}, t AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) OVER o, close)), abs(low - coalesce(lag(close) OVER o, close))) AS tr FROM bars WHERE close IS NOT NULL WINDOW o AS (PARTITION BY symbol, market ORDER BY bar)),
    p AS (SELECT *, count(*) OVER l = 3 AND count(*) OVER r = 3 AND high > max(high) OVER l AND high >= max(high) OVER r AS ph, count(*) OVER l = 3 AND count(*) OVER r = 3 AND low < min(low) OVER l AND low <= min(low) OVER r AS pl, avg(tr) OVER f AS atr, stddev_pop(delta) OVER f AS sd FROM t
    WINDOW l AS (PARTITION BY symbol, market ORDER BY bar ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY symbol, market ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), f AS (PARTITION BY symbol, market ORDER BY bar ROWS 19 PRECEDING)),
    h AS (SELECT symbol, market, bar, 1 AS sg, (high - lag(high) OVER o) / nullif(atr, 0) AS x, (cvd - lag(cvd) OVER o) / nullif(sd, 0) AS z FROM p WHERE ph WINDOW o AS (PARTITION BY symbol, market ORDER BY bar)), g AS (SELECT symbol, market, bar, -1 AS sg, (low - lag(low) OVER o) / nullif(atr, 0) AS x, (cvd - lag(cvd) OVER o) / nullif(sd, 0) AS z FROM p WHERE pl WINDOW o AS (PARTITION BY symbol, market ORDER BY bar)), u AS (SELECT * FROM h UNION ALL SELECT * FROM g)
    SELECT symbol, market, {T.format('bar')} AS bar, CASE WHEN x >= 0.5 AND z <= -0.5 THEN CASE WHEN sg > 0 THEN 'bearish_regular' ELSE 'bullish_hidden' END ELSE CASE WHEN sg > 0 THEN 'bearish_hidden' ELSE 'bullish_regular' END END AS kind, {R('x')} AS price_move, {R('z')} AS flow_z FROM u WHERE (x >= 0.5 AND z <= -0.5) OR (x <= -0.5 AND z >= 0.5)"""
)
def divergences(spark, sf_dir):
    return told(ind.divergences(hour_bars(spark, sf_dir)).select(*KEY, "bar", "kind", "price_move", "flow_z"))


#: Bars and ticks of the two event queries, whose stacks are two ticks: these tables
#: trade too seldom for stacks of three in a minute's ticks of 0.01.
COARSE = {"minutes": 120, "tick": 50.0}


def coarse_rows(spark, sf_dir) -> DataFrame:
    p = mn.profile(src.trades(spark, sf_dir).withColumn("price", F.floor(F.col("price") / COARSE["tick"]) / 100), COARSE["minutes"])
    return ind.event_rows(history_of(spark, sf_dir), p, **COARSE, stack=2)


def _stack_sql(name: str, own: str, side: str, other: str, move: int) -> str:
    return f"""{name} AS (SELECT DISTINCT symbol, market, bar FROM (SELECT symbol, market, bar, tick - row_number() OVER (PARTITION BY symbol, market, bar ORDER BY tick) AS run FROM (SELECT *, CASE WHEN {side}(tick) OVER w = tick + {move} THEN {side}({other}) OVER w ELSE 0 END AS beside FROM profile WINDOW w AS (PARTITION BY symbol, market, bar ORDER BY tick)) WHERE {own} > 0 AND {own} / (beside + 1e-12) >= 3) GROUP BY symbol, market, bar, run HAVING count(*) >= 2)"""


EVENT_ROWS = f"""WITH RECURSIVE {HISTORY}, {bar_sql(120)}, profile AS (SELECT symbol, market, time_bucket(INTERVAL 120 MINUTE, ts, TIMESTAMP '1970-01-01') AS bar, floor(price / 50)::BIGINT AS tick, sum(CASE WHEN side >= 0 THEN qty ELSE 0 END) AS buy_qty, sum(CASE WHEN side < 0 THEN qty ELSE 0 END) AS sell_qty FROM trades GROUP BY ALL),
    {_area_sql('profile', [*KEY, 'bar'])}, {_stack_sql('sb', 'buy_qty', 'lag', 'sell_qty', -1)}, {_stack_sql('ss', 'sell_qty', 'lead', 'buy_qty', 1)},
    fl AS (SELECT b.symbol, b.market, b.bar, b.open, b.high, b.low, b.close, b.delta, b.cvd, CASE WHEN b.qty > 1e-12 THEN b.delta / b.qty ELSE 0 END AS rd, last_value(b.close IGNORE NULLS) OVER w AS last, last_value(CASE WHEN b.qty > 1e-12 THEN b.notional / b.qty END IGNORE NULLS) OVER w AS avwap, last_value(a.poc IGNORE NULLS) OVER w AS poc, last_value(a.val IGNORE NULLS) OVER w AS val, last_value(a.vah IGNORE NULLS) OVER w AS vah, sb.bar IS NOT NULL AS stacked_buy, ss.bar IS NOT NULL AS stacked_sell
      FROM bars b LEFT JOIN area a ON a.symbol = b.symbol AND a.market = b.market AND a.bar = b.bar LEFT JOIN sb ON sb.symbol = b.symbol AND sb.market = b.market AND sb.bar = b.bar LEFT JOIN ss ON ss.symbol = b.symbol AND ss.market = b.market AND ss.bar = b.bar WINDOW w AS (PARTITION BY b.symbol, b.market ORDER BY b.bar ROWS UNBOUNDED PRECEDING)),
    er AS (SELECT f.symbol, f.bar, coalesce(f.open, f.last) AS open, coalesce(f.high, f.last) AS high, coalesce(f.low, f.last) AS low, coalesce(f.close, f.last) AS close, f.delta, f.rd, f.poc * 50.0::DOUBLE AS poc, f.val * 50.0::DOUBLE AS val, f.vah * 50.0::DOUBLE AS vah, f.avwap, f.stacked_buy, f.stacked_sell, s.rd AS spot_rd, s.cvd AS spot_cvd, s.delta * coalesce(s.last, 0) AS spot_push
      FROM fl f JOIN fl s ON f.symbol = s.symbol AND f.bar = s.bar WHERE f.market = 'futures' AND s.market = 'spot')"""


@query(
    f"""{EVENT_ROWS}, t AS (SELECT *, row_number() OVER o AS place, (close - low) / (greatest(high - low, 0) + 1e-12) AS up, (high - close) / (greatest(high - low, 0) + 1e-12) AS down, max(high) OVER p AS top, min(low) OVER p AS base, list(struct_pack(bar := bar, close := close, low := low, high := high, cvd := spot_cvd, push := spot_push)) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS nexts
      FROM er WINDOW o AS (PARTITION BY symbol ORDER BY bar), p AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1440 PRECEDING AND 1 PRECEDING)),
    d AS (SELECT *, least(abs(low - vah), abs(low - val), abs(low - poc), abs(low - avwap), abs(low - coalesce(top, vah)), abs(low - coalesce(base, val))) / 50 AS d_low, least(abs(high - vah), abs(high - val), abs(high - poc), abs(high - avwap), abs(high - coalesce(top, vah)), abs(high - coalesce(base, val))) / 50 AS d_high FROM t),
    c AS (SELECT *, stacked_sell AND (high - low) / 50 >= 2 AND rd <= -0.15 AND close > open AND up >= 0.7 AND d_low <= 6 AS bull, stacked_buy AND (high - low) / 50 >= 2 AND rd >= 0.15 AND close < open AND down >= 0.7 AND d_high <= 6 AS bear FROM d),
    k AS (SELECT *, CASE WHEN bull THEN 1 ELSE -1 END AS direction FROM c WHERE bull <> bear), r AS (SELECT *, place - row_number() OVER (PARTITION BY symbol, direction ORDER BY bar) AS run FROM k), q AS (SELECT *, (row_number() OVER (PARTITION BY symbol, direction, run ORDER BY bar) - 1) // 30 AS piece FROM r),
    g AS (SELECT symbol, direction, min(bar) AS from_bar, max(bar) AS to_bar, count(*) AS n, min(low) AS price_low, max(high) AS price_high, sum(delta) AS delta_sum, avg(rd) AS rd_mean, avg(CASE WHEN direction = 1 THEN up ELSE down END) AS reject, min(CASE WHEN direction = 1 THEN d_low ELSE d_high END) AS key_distance, bool_or(stacked_buy) AS stacked_buy, bool_or(stacked_sell) AS stacked_sell, avg(spot_rd) AS spot_rd_mean, sum(spot_push) AS pushed, arg_max(spot_cvd, bar) AS cvd, arg_max(nexts, bar) AS nexts FROM q GROUP BY symbol, direction, run, piece),
    j AS (SELECT *, list_position(list_transform(nexts, lambda x: CASE WHEN direction = 1 THEN x.close >= price_low + 0.5 * greatest(price_high - price_low, 50) ELSE x.close <= price_high - 0.5 * greatest(price_high - price_low, 50) END), true) AS j FROM g WHERE len(nexts) = 3),
    h AS (SELECT *, list_sum(list_transform(nexts[1:j], lambda x: x.push)) + pushed AS push FROM j WHERE j > 0 AND CASE WHEN direction = 1 THEN list_min(list_transform(nexts, lambda x: x.low)) >= price_low - 50 ELSE list_max(list_transform(nexts, lambda x: x.high)) <= price_high + 50 END),
    z AS (SELECT *, 0.35 * least(abs(rd_mean) / 0.5, 1) + 0.35 * least(greatest((reject - 0.7) / 0.3, 0), 1) + 0.2 * least(greatest(1 - key_distance / 6, 0), 1) + 0.1 * least(n / 5, 1) AS score_base, least(greatest(direction * spot_rd_mean / 0.15, 0), 1) AS spot_flow, least(greatest(direction * push / 100000, 0), 1) AS spot_whale FROM h)
    SELECT symbol, direction::INTEGER AS direction, {T.format('from_bar')} AS from_bar, {T.format('to_bar + INTERVAL 120 MINUTE')} AS to_at, {T.format('nexts[j].bar + INTERVAL 120 MINUTE')} AS confirm_at, {R('CASE WHEN direction = 1 THEN price_low ELSE price_high END')} AS pivot, {R('price_low')} AS price_low, {R('price_high')} AS price_high, {R('delta_sum')} AS delta_sum, {R('rd_mean')} AS rd_mean, {R('reject')} AS reject, {R('key_distance')} AS key_distance, stacked_buy, stacked_sell,
    {R('spot_rd_mean')} AS spot_rd_mean, {R('nexts[j].cvd - cvd')} AS spot_cvd_change, {R('spot_flow')} AS spot_flow, {R('spot_whale')} AS spot_whale, {R('score_base')} AS score_base, {R('0.85 * score_base + 0.1 * spot_flow + 0.05 * spot_whale')} AS score FROM z"""
)
def absorption(spark, sf_dir):
    """All conditions, on bars of 2 hours, ticks of 50 and stacks of two, from two
    ticks of range on."""
    return told(ind.absorption(coarse_rows(spark, sf_dir), **COARSE, span=2.0))


@query(
    f"""{EVENT_ROWS}, t AS (SELECT *, CASE WHEN count(*) OVER l >= 20 THEN (delta - avg(delta) OVER l) / (stddev_pop(delta) OVER l + 1e-12) END AS z, lag(close) OVER o AS c0, lag(vah) OVER o AS vah0, lag(val) OVER o AS val0, count(*) OVER a AS held, min(close) OVER a AS lc, max(close) OVER a AS mc, sum(delta) OVER e AS delta_sum, avg(rd) OVER e AS rd_mean, min(low) OVER e AS price_low, max(high) OVER e AS price_high, avg(spot_rd) OVER e AS spot_rd_mean, last_value(spot_cvd) OVER e - spot_cvd AS spot_cvd_change, sum(spot_push) OVER e AS pushed
      FROM er WINDOW o AS (PARTITION BY symbol ORDER BY bar), l AS (PARTITION BY symbol ORDER BY bar ROWS 19 PRECEDING), a AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), e AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    c AS (SELECT *, close > vah AND c0 <= vah0 AND z >= 0.3 AND rd >= 0.2 AND (close - low) / (greatest(high - low, 50) + 1e-12) >= 0.7 AS up, close < val AND c0 >= val0 AND z <= -0.3 AND rd <= -0.2 AND (high - close) / (greatest(high - low, 50) + 1e-12) >= 0.7 AS down FROM t WHERE held = 2),
    d AS (SELECT *, CASE WHEN up AND NOT down AND stacked_buy AND lc >= vah - 200 AND delta_sum > 0 THEN 1 WHEN down AND NOT up AND stacked_sell AND mc <= val + 200 AND delta_sum < 0 THEN -1 END AS direction FROM c),
    p AS (SELECT *, CASE WHEN direction = 1 THEN vah ELSE val END AS edge, direction * pushed > 0 AS spot_whale FROM d WHERE direction IS NOT NULL)
    SELECT symbol, direction::INTEGER AS direction, {T.format('bar')} AS bar, {T.format('bar + INTERVAL 360 MINUTE')} AS confirm_at, {R('edge')} AS pivot, {R('price_low')} AS price_low, {R('price_high')} AS price_high, {R('z')} AS z, {R('rd_mean')} AS rd_mean, {R('direction * (close - edge) / 50')} AS break_ticks, {R('delta_sum')} AS delta_sum, {R('greatest(CASE WHEN direction = 1 THEN vah - price_low ELSE price_high - val END, 0) / 50')} AS adverse,
    direction * spot_rd_mean >= 0.05 AND direction * spot_cvd_change >= 0 AS spot_break, {R('spot_rd_mean')} AS spot_rd_mean, {R('spot_cvd_change')} AS spot_cvd_change, spot_whale, {R('0.8 * (0.3 * least(abs(z) / 3, 1) + 0.3 * least(abs(rd_mean) / 0.5, 1) + 0.2 * least(greatest(direction * (close - edge) / 50 / 6, 0), 1) + 0.2) + 0.15 * least(greatest(direction * spot_rd_mean, 0), 1) + 0.05 * spot_whale::INT')} AS score FROM p"""
)
def initiation(spark, sf_dir):
    """All conditions, on bars of 2 hours, ticks of 50 and stacks of two, with
    lower bounds than the operator's own, which no bar of these tables meets."""
    return told(ind.initiation(coarse_rows(spark, sf_dir), **COARSE, z_least=0.3, back=20, hold=2, breaks=0.0, holds=4.0))


LIQ = """orders_ AS (SELECT event_id AS order_id, 'S' || CAST(user_id % 4 AS VARCHAR) AS symbol, CASE WHEN event_id % 2 = 0 THEN 'futures' ELSE 'spot' END AS market, ts, value AS price, value * (coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) + 1) AS notional, CASE WHEN user_id % 2 = 0 THEN 'short_liq' ELSE 'long_liq' END AS liq_side FROM events WHERE event_type = 'error')"""


@query(
    f"""WITH {LIQ}, l AS (SELECT symbol, market, time_bucket(INTERVAL 1440 MINUTE, ts, TIMESTAMP '1970-01-01') AS bucket, round(price * 100)::BIGINT AS tick, sum(CASE WHEN liq_side = 'long_liq' THEN notional ELSE 0 END) AS long_liq, sum(CASE WHEN liq_side = 'short_liq' THEN notional ELSE 0 END) AS short_liq FROM orders_ GROUP BY ALL)
    SELECT symbol, market, {T.format('bucket')} AS bucket, tick, {R('long_liq')} AS long_liq, {R('short_liq')} AS short_liq, {R('short_liq - long_liq')} AS net, {R('(long_liq + short_liq) / max(long_liq + short_liq) OVER (PARTITION BY symbol, market, bucket)')} AS score FROM l"""
)
def liquidation_density(spark, sf_dir):
    l = mn.liquidation_levels(src.force_orders(spark, sf_dir), 1440)  # noqa: E741
    w = Window.partitionBy(*KEY, "bucket")
    total = F.col("long_liq") + F.col("short_liq")
    return told(l.withColumns({"net": F.col("short_liq") - F.col("long_liq"), "score": total / F.max(total).over(w)}))


@query(
    f"""WITH {MINUTES}, {LIQ}, m AS (SELECT symbol, market, minute, trade_count FROM minutes WHERE market = 'futures')
    SELECT m.symbol, m.market, {T.format('m.minute')} AS minute, trade_count FROM m ANTI JOIN (SELECT DISTINCT symbol, market, date_trunc('minute', ts) AS minute FROM orders_) o ON m.symbol = o.symbol AND m.market = o.market AND m.minute = o.minute"""
)
def zero_liquidation_minutes(spark, sf_dir):
    present = minutes_of(spark, sf_dir).where("market = 'futures'").select(*KEY, "minute", "trade_count")
    liq = src.force_orders(spark, sf_dir).select(*KEY, mn.minute_of(F.col("ts")).alias("minute"))
    return told(mn.zero_liquidations(present, liq))


QUOTES = """quotes AS (SELECT event_id AS update_id, 'S' || CAST(user_id % 4 AS VARCHAR) AS symbol, CASE WHEN event_id % 2 = 0 THEN 'futures' ELSE 'spot' END AS market, ts, value AS bid, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) + 1 AS bid_qty, round(value + 0.01 * (1 + event_id % 7), 2) AS ask, CAST(1 + user_id % 50 AS DOUBLE) AS ask_qty FROM events WHERE event_type IN ('view', 'click')),
samples AS (SELECT *, greatest(ask - bid, 0) AS spread, (bid_qty - ask_qty) / (bid_qty + ask_qty) AS obi, (ask * bid_qty + bid * ask_qty) / (ask_qty + bid_qty) AS microprice, coalesce((bid_qty - lag(bid_qty) OVER w) - (ask_qty - lag(ask_qty) OVER w), 0) AS ofi FROM quotes WINDOW w AS (PARTITION BY symbol, market ORDER BY ts, update_id))"""


@query(f"WITH {QUOTES} SELECT symbol, market, {T.format(chr(100) + 'ate_trunc(' + chr(39) + 'minute' + chr(39) + ', ts)')} AS minute, count(*) AS sample_count, {R('sum(spread)')} AS spread_sum, {R('sum(obi)')} AS obi_sum, {R('sum(microprice)')} AS microprice_sum, {R('sum(ofi)')} AS ofi_sum, {R('last(obi ORDER BY ts, update_id)')} AS obi_close FROM samples GROUP BY ALL")
def book_minutes(spark, sf_dir):
    return told(mn.book_minutes(src.quotes(spark, sf_dir)).select(*KEY, "minute", "sample_count", "spread_sum", "obi_sum", "microprice_sum", "ofi_sum", "obi_close"))


FUND = """points AS (SELECT event_id AS point_id, 'S' || CAST(user_id % 4 AS VARCHAR) AS symbol, ts, round((value - 250) / 100000, 3) AS rate, value AS mark FROM events WHERE event_type = 'signup' AND event_id % 2 = 0)"""


@query(
    f"""WITH {FUND}, n AS (SELECT *, lead(ts) OVER w AS next_ts, CASE WHEN abs(rate - lag(rate) OVER w) <= 1e-12 THEN 0 ELSE 1 END AS changed FROM points WINDOW w AS (PARTITION BY symbol ORDER BY ts, point_id)), e AS (SELECT symbol, max(date_trunc('day', ts)) + INTERVAL 1 DAY AS stop FROM points GROUP BY symbol),
    u AS (SELECT n.*, coalesce(next_ts, stop) AS until FROM n JOIN e ON n.symbol = e.symbol), d AS (SELECT *, unnest(generate_series(date_trunc('day', ts), date_trunc('day', until - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)) AS bucket FROM u),
    h AS (SELECT *, epoch_us(least(until, bucket + INTERVAL 1 DAY)) / 1e6 - epoch_us(greatest(ts, bucket)) / 1e6 AS held FROM d)
    SELECT symbol, {T.format('bucket')} AS bucket, {R('sum(rate * held) / sum(held)')} AS twa, {R('last(rate ORDER BY ts, point_id)')} AS last_rate, {R('last(mark ORDER BY ts, point_id)')} AS mark_price, sum(CASE WHEN ts >= bucket THEN changed ELSE 0 END)::BIGINT AS changes FROM h GROUP BY ALL"""
)
def funding_twa(spark, sf_dir):
    return told(ind.funding(src.funding_points(spark, sf_dir)))


@query(
    f"""WITH {MINUTES}, {FUND} SELECT m.symbol, m.market, {T.format('m.minute')} AS minute, {R('p.rate')} AS funding_rate, {R('p.mark')} AS mark_price FROM minutes m ASOF LEFT JOIN points p ON m.symbol = p.symbol AND m.minute >= p.ts"""
)
def funding_asof(spark, sf_dir):
    """The latest funding point at or before each traded minute."""
    from quayside.operators.joins import asof

    m = minutes_of(spark, sf_dir).select(*KEY, "minute")
    return told(asof(m, src.funding_points(spark, sf_dir), ["symbol"], "minute", "ts", ["funding_rate", "mark_price"], "point_id"))
