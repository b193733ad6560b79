"""Feature-table queries, each with its DuckDB SQL."""

from __future__ import annotations

from quayside.operators import features as ft
from quayside.operators import minute as mn
from quayside.plans.market import HISTORY, KEY, QUOTES, R, T, bar_sql, history_of, query, told
from quayside.sources import events as src


def _window(k: str, n: int) -> str:
    w = f"OVER (PARTITION BY symbol, market ORDER BY minute ROWS {n - 1} PRECEDING)"
    return f"""SELECT symbol, market, minute, '{k}' AS window_code, first_value(coalesce(open, close, last_price)) {w} AS open, max(coalesce(high, last_price)) {w} AS high, min(coalesce(low, last_price)) {w} AS low, coalesce(close, last_price) AS close,
    sum(buy_qty) {w} AS buy_qty, sum(sell_qty) {w} AS sell_qty, sum(qty) {w} AS qty, sum(notional) {w} AS notional, sum(delta) {w} AS delta, sum(whale_notional) {w} AS whale_notional, sum(CASE WHEN qty > 0 THEN 1 ELSE 0 END) {w} AS active_minutes,
    cvd AS cvd_last, count(*) {w} AS n, regr_slope(cvd, x) {w} AS slope FROM x"""


def window_sql(windows: dict[str, int]) -> str:
    return f"""WITH {HISTORY}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol, market ORDER BY minute) AS x FROM history), w AS ({' UNION ALL '.join(_window(k, n) for k, n in windows.items())})
    SELECT symbol, market, {T.format('minute')} AS minute, window_code, {R('open')} AS open, {R('high')} AS high, {R('low')} AS low, {R('close')} AS close, {R('qty')} AS qty, {R('notional')} AS notional, {R('delta')} AS delta, {R('whale_notional')} AS whale_notional, {R('CASE WHEN qty > 0 THEN delta / qty ELSE 0 END')} AS relative_delta,
    active_minutes::BIGINT AS active_minutes, {R('cvd_last')} AS cvd_last, {R('CASE WHEN n >= 3 THEN slope END')} AS cvd_slope, {R('CASE WHEN qty > 0 THEN notional / qty END')} AS avwap FROM w"""


def _features(name: str, windows: dict[str, int]) -> None:
    def run(spark, sf_dir):
        f = ft.window_features(history_of(spark, sf_dir), windows)
        return told(f.select(*KEY, "minute", "window_code", "open", "high", "low", "close", "qty", "notional", "delta", "whale_notional", "relative_delta", "active_minutes", "cvd_last", "cvd_slope", "avwap"))

    run.__name__ = name
    query(window_sql(windows))(run)


_features("flow_features_short", {k: ft.WINDOWS[k] for k in ("1m", "15m", "1h")})
_features("flow_features_long", {k: ft.WINDOWS[k] for k in ("4h", "1d", "3d")})


@query(f"WITH {HISTORY} SELECT symbol, market, {T.format('minute')} AS minute, {R('cvd')} AS cvd, {R('cvd - first_value(cvd) OVER (PARTITION BY symbol, market ORDER BY minute ROWS 10079 PRECEDING)')} AS cvd_change FROM history")
def cvd_rolling_7d(spark, sf_dir):
    return told(ft.cvd_change(history_of(spark, sf_dir)))


@query(
    f"""WITH {HISTORY}, {bar_sql(60)}, v AS (SELECT symbol, market, bar, list(delta) OVER (PARTITION BY symbol, market ORDER BY bar ROWS 59 PRECEDING) AS v FROM bars),
    p AS (SELECT *, list_transform(range(1, len(v) + 1), lambda i: list_reduce(v[1:i], lambda a, x: a * (1 - 2.0::DOUBLE / 6) + x * (2.0::DOUBLE / 6)) - list_reduce(v[1:i], lambda a, x: a * (1 - 2.0::DOUBLE / 21) + x * (2.0::DOUBLE / 21))) AS b FROM v),
    q AS (SELECT *, b[greatest(len(b) - 60, 1):len(b) - 1] AS h FROM p)
    SELECT symbol, market, {T.format('bar')} AS bar, {R('list_reduce(v, lambda a, x: a * (1 - 2.0::DOUBLE / 6) + x * (2.0::DOUBLE / 6))')} AS ema_fast, {R('list_reduce(v, lambda a, x: a * (1 - 2.0::DOUBLE / 21) + x * (2.0::DOUBLE / 21))')} AS ema_slow, {R('b[-1]')} AS burst,
    {R('CASE WHEN len(b) >= 22 THEN CASE WHEN list_stddev_pop(h) <= 1e-12 THEN 0 ELSE (b[-1] - list_avg(h)) / list_stddev_pop(h) END END')} AS burst_z FROM q"""
)
def delta_emas(spark, sf_dir):
    """EMAs of hourly delta and the z of their difference."""
    return told(ft.delta_emas(mn.bars(history_of(spark, sf_dir), 60), "bar"))


@query(
    f"""WITH {QUOTES}, m AS (SELECT symbol, market, date_trunc('minute', ts) AS minute, count(*) AS n, sum(spread) AS spread, sum(obi) AS obi, sum(ofi) AS ofi FROM samples GROUP BY ALL), z AS (SELECT *, count(*) OVER w AS c, stddev_pop(ofi) OVER w AS sd, avg(ofi) OVER w AS mean FROM m WINDOW w AS (PARTITION BY symbol, market ORDER BY minute ROWS 59 PRECEDING))
    SELECT symbol, market, {T.format('minute')} AS minute, {R('obi / n')} AS obi, {R('spread / n')} AS spread, {R('CASE WHEN c >= 5 THEN CASE WHEN sd <= 1e-12 THEN 0 ELSE (ofi - mean) / sd END END')} AS ofi_z, (obi >= 0) = (ofi >= 0) AS confirms, {R('least(greatest(n / 50, 0), 1)')} AS fill FROM z"""
)
def orderbook_features(spark, sf_dir):
    return told(ft.book_features(mn.book_minutes(src.quotes(spark, sf_dir))))
