"""As-of, priority and label joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], tie: str | None = None) -> DataFrame:
    """Every left row with `columns` of the last right row of its keys at or
    before it, null if there is none. One shuffle of both sides by key: rows
    are merged in time order and the last right value is carried on. Of right
    rows at one time the greatest `tie` counts."""
    carried = F.struct(*[F.col(c) for c in columns])
    nothing = F.lit(None).cast(right.select(carried.alias("c")).schema["c"].dataType)
    order = F.col(tie).cast("long") if tie else F.lit(0)
    rows = F.struct(*[F.col(c) for c in left.columns])
    blank = F.lit(None).cast(left.select(rows.alias("r")).schema["r"].dataType)
    kind = left.schema[left_time].dataType
    merged = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_own"), F.lit(0).cast("long").alias("_tie"), rows.alias("_row"), nothing.alias("_c")).unionByName(
        right.select(*keys, F.col(right_time).cast(kind).alias("_t"), F.lit(0).alias("_own"), order.cast("long").alias("_tie"), blank.alias("_row"), carried.alias("_c"))
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_own", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("_c", F.last("_c", ignorenulls=True).over(w)).where("_own = 1").select("_row.*", "_c.*")


def by_priority(sources: list[DataFrame], keys: list[str], usable: str) -> DataFrame:
    """One row per key: of the sources that have a usable one, the first; if
    none is usable, the first source's row."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        rows = s if rows is None else rows.unionByName(s)
    columns = [c for c in rows.columns if c not in keys]
    rank = F.struct((~F.expr(usable)).cast("int").alias("bad"), F.col("_source"))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), rank).alias("_r")).select(*keys, "_r.*").drop("_source")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row per key by `order`, as a partial aggregate: no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def forward_labels(starts: DataFrame, bars: DataFrame, keys: list[str], start: str, bar: str, horizon: int) -> DataFrame:
    """What the `horizon` minute bars from each start do: first breach of the
    start's resistance or support, close move, whether the slice is complete.
    Starts are keyed to the days their slice may touch, so the range join is
    an equi-join with a filter."""
    day = lambda c: F.date_trunc("day", F.col(c))
    length = F.make_dt_interval(mins=F.lit(horizon))
    s = starts.withColumns({"_from": F.col(start), "_to": F.col(start) + length})
    s = s.withColumn("_day", F.explode(F.sequence(day("_from"), day("_to"), F.expr("interval 1 day"))))
    b = bars.select(*keys, F.col(bar).alias("_bar"), "high", "low", "close", day(bar).alias("_day"))
    met = s.join(b, [*keys, "_day"]).where((F.col("_bar") >= F.col("_from")) & (F.col("_bar") < F.col("_to")))
    up, down = F.when(F.col("high") > F.col("resistance"), F.col("_bar")), F.when(F.col("low") < F.col("support"), F.col("_bar"))
    ids = [c for c in starts.columns]
    out = met.groupBy(*ids).agg(F.min(up).alias("up_at"), F.min(down).alias("down_at"), F.max_by("close", "_bar").alias("last_close"), F.count("*").alias("bars"))
    label = (
        F.when(F.col("bars") < horizon, "incomplete")
        .when(F.col("up_at").isNull() & F.col("down_at").isNull(), "none")
        .when(F.col("down_at").isNull(), "up")
        .when(F.col("up_at").isNull(), "down")
        .when(F.col("up_at") < F.col("down_at"), "up_then_down")
        .when(F.col("down_at") < F.col("up_at"), "down_then_up")
        .otherwise("both")
    )
    return out.withColumn("label", label)
