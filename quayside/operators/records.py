"""Selection, gating, identity and routing of rows and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.stats import ratio


def tail(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of every key: a limited sort per key, not a whole one."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def time_range(rows: DataFrame, order: str, from_, to) -> DataFrame:
    """[from, to); the bounds are literals, so they reach the scan."""
    return rows.where((F.col(order) >= from_) & (F.col(order) < to))


def position(price: Column, low: Column, high: Column) -> Column:
    return F.when(price.isNull() | low.isNull() | high.isNull(), "unknown").when(price > high, "above").when(price < low, "below").otherwise("inside")


def fresh(rows: DataFrame, time: str, now: Column, seconds: int = 300) -> DataFrame:
    """Rows at most so many seconds old."""
    return rows.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp")) <= seconds * 1_000_000)


def gate(bundles: DataFrame, time: str, symbols: list[str], minutes: list[int]) -> DataFrame:
    """Bundles of the symbols at the scheduled minutes of the hour."""
    return bundles.where(F.col("symbol").isin(symbols) & F.minute(time).isin(minutes))


def carry_levels(rows: DataFrame, levels: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """rows with the last known value of each level column, each carried on
    its own. levels: (*keys, time, *columns)."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(levels, [*keys, time], "left")
    return met.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def published(rows: DataFrame, kind: str, backfill: str) -> DataFrame:
    """One row per exchange: live, or replay for backfill; backfilled
    aggregates go to both."""
    routes = F.when(~F.col(backfill), F.array(F.lit("live"))).when(F.col(kind).startswith("md.agg."), F.array(F.lit("replay"), F.lit("live"))).otherwise(F.array(F.lit("replay")))
    return rows.withColumn("exchange", F.explode(routes))


def name_uuid(name: Column, namespace: str) -> Column:
    """Version-5 UUID of a name in a namespace (its UUID), from built-ins."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def retry_plan(outbox: DataFrame, attempts: str = "attempts", order: tuple[str, ...] = ("created", "id"), most: int = 60) -> DataFrame:
    """Claim order and seconds to the next attempt: 3 more each time, at most 60."""
    return outbox.withColumns({"claim": F.row_number().over(Window.partitionBy("shard").orderBy(*order)), "retry_seconds": F.least(3 * (F.col(attempts) + 1), F.lit(most))})


def segments(rows: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """A new segment after every gap of more than `seconds`."""
    w = Window.partitionBy(*keys).orderBy(time)
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    opens = F.coalesce((at - F.lag(at).over(w) > seconds).cast("long"), F.lit(0))
    return rows.withColumn("_opens", opens).withColumn("segment", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def first_incomplete(spine: DataFrame, sources: dict[str, DataFrame], keys: list[str], time: str) -> DataFrame:
    """Per key the first minute of the spine that a source lacks, and which
    sources lack it; none for whole keys. Each source is (*keys, time)."""
    met = spine
    for name, rows in sources.items():
        met = met.join(rows.select(*keys, time).distinct().withColumn(f"_{name}", F.lit(True)), [*keys, time], "left")
    missing = F.filter(F.array(*[F.when(F.col(f"_{n}").isNull(), F.lit(n)) for n in sources]), lambda x: x.isNotNull())
    return met.withColumn("missing", missing).where(F.size("missing") > 0).groupBy(*keys).agg(F.min(F.struct(time, "missing")).alias("m")).select(*keys, f"m.{time}", "m.missing")


def override(canonical: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Canonical rows; live rows where there is no canonical one."""
    return canonical.withColumn("origin", F.lit("canonical")).unionByName(live.join(canonical.select(*keys), keys, "left_anti").withColumn("origin", F.lit("live")))


def needed(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """What a supplement must fetch."""
    return wanted.join(present.select(*keys), keys, "left_anti")


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).join(b.select(*keys), keys, "left_anti").withColumn("only", F.lit("left")).unionByName(b.select(*keys).join(a.select(*keys), keys, "left_anti").withColumn("only", F.lit("right")))


def conflate(rows: DataFrame, keys: list[str], time: str, width: str, order: list[str]) -> DataFrame:
    """The latest row of every interval, and how many it stands for."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys, F.window(time, width)["start"].alias("bucket")).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"), F.count("*").alias("events")).select(*keys, "bucket", "events", "r.*")


def time_in_book(changes: DataFrame, keys: list[str], sample: str, price: str, qty: str) -> DataFrame:
    """Per bucket and price, the sum of quantities weighted by the samples each
    stays. changes: (*keys, sample, price, qty); a level that is not touched in
    a bucket counts nothing there."""
    last = F.max(sample).over(Window.partitionBy(*keys))
    nxt = F.lead(sample).over(Window.partitionBy(*keys, price).orderBy(sample))
    stays = F.coalesce(nxt, last + 1) - F.col(sample)
    return changes.withColumn("_stays", stays).groupBy(*keys, price).agg(F.sum(F.col(qty) * F.col("_stays")).alias("weighted"), F.sum("_stays").alias("samples"))


def reward_risk(direction: Column, entry: Column, stop: Column, target: Column) -> Column:
    """Reward over risk; null unless stop, entry and target are in order."""
    sound = F.when(direction == "LONG", (stop < entry) & (entry < target)).otherwise((target < entry) & (entry < stop))
    return F.when(sound, ratio(F.abs(target - entry), F.abs(entry - stop)))


def merge_payload(base: Column, other: Column) -> Column:
    """Two string maps; the base wins."""
    return F.map_concat(base, F.map_filter(other, lambda k, _: ~F.map_contains_key(base, k)))


# -- extension point -------------------------------------------------------

_INDICATORS: dict[str, Callable[[DataFrame], dict[str, DataFrame]]] = {}


def register_indicator(code: str) -> Callable:
    """Add an indicator: a function of the minute history that returns tables
    by output kind (snapshot, level, event, ...)."""

    def add(f: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable:
        if code in _INDICATORS:
            raise ValueError(f"{code} is registered already")
        _INDICATORS[code] = f
        return f

    return add


def evaluate(history: DataFrame, codes: list[str] | None = None) -> dict[str, dict[str, DataFrame]]:
    return {c: _INDICATORS[c](history) for c in (codes or sorted(_INDICATORS))}
