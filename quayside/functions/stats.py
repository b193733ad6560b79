"""Statistics with explicit rules for short and flat inputs."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ratio(a: Column, b: Column, least: float = 1e-12) -> Column:
    """a / b, null where |b| is at most `least`."""
    return F.when(F.abs(b) > least, a / b)


def quotient(a: Column, b: Column) -> Column:
    """a / b by IEEE rules: infinite or NaN where b is 0, in ANSI mode too."""
    return F.when(b != 0, a / b).otherwise(a * F.pow(b, F.lit(-1.0)))


def direction(x: Column) -> Column:
    """+1 for zero and above, -1 below."""
    return F.when(x >= 0, 1).otherwise(-1)


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def rows_back(keys: list[str], order: str, n: int, current: bool = True) -> WindowSpec:
    """The last n rows, with or without the current one."""
    w = Window.partitionBy(*keys).orderBy(order)
    return w.rowsBetween(-(n - 1), 0) if current else w.rowsBetween(-n, -1)


def zscore(x: Column, frame: WindowSpec, least: int = 5) -> Column:
    """(x - mean) / population deviation of the frame; null below `least`
    values, 0 where the deviation is at most 1e-12."""
    sd = F.stddev_pop(x).over(frame)
    return F.when(F.count(x).over(frame) >= least, F.when(sd <= 1e-12, 0.0).otherwise((x - F.avg(x).over(frame)) / sd))


def slope(y: Column, x: Column, frame: WindowSpec, least: int = 3) -> Column:
    return F.when(F.count(y).over(frame) >= least, F.regr_slope(y, x).over(frame))


def median(values: Column) -> Column:
    """Of an array; the middle two average."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(s)
    return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)


def robust_z(x: Column, values: Column, least: int) -> Column:
    """(x - median) / (1.4826 MAD); null below `least` values, 0 where flat."""
    m = median(values)
    mad = median(F.transform(values, lambda v: F.abs(v - m)))
    scale = F.greatest(F.abs(m), F.lit(1.0))
    return F.when(F.size(values) >= least, F.when(mad <= 1e-9 * scale, 0.0).otherwise((x - m) / (1.4826 * mad)))


def nearest_rank(values: Column, p: float) -> Column:
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.try_element_at(s, F.round((F.size(s) - 1) * F.lit(p)).cast("int") + 1))
