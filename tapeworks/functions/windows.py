"""Row windows with a full-window guard, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

By = list[str]


def ordered(by: By, ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(ts)


def last_n(by: By, n: int, ts: str = "ts") -> WindowSpec:
    return ordered(by, ts).rowsBetween(-(n - 1), 0)


def running(by: By, ts: str = "ts") -> WindowSpec:
    return ordered(by, ts).rowsBetween(Window.unboundedPreceding, 0)


def rolling(f, x: Column | str, n: int, by: By, ts: str = "ts", least: int | None = None) -> Column:
    """An aggregate over the last n rows; null until there are ``least`` (n) values."""
    w = last_n(by, n, ts)
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(w) >= (n if least is None else least), f(x).over(w))


def zscore(x: Column | str, n: int, by: By, ts: str = "ts", limit: float | None = None) -> Column:
    """Distance from the rolling mean in rolling standard deviations (0 where those are 0)."""
    x = F.col(x) if isinstance(x, str) else x
    mean, sd = rolling(F.avg, x, n, by, ts), rolling(F.stddev_samp, x, n, by, ts)
    z = F.when(sd > 1e-10, (x - mean) / sd).when(sd.isNotNull(), 0.0)
    return F.greatest(F.least(z, F.lit(limit)), F.lit(-limit)) if limit else z


def slope(y: Column, i: Column, n: int, by: By, ts: str = "ts") -> Column:
    """Least-squares slope of the last n values against their row numbers."""
    w = last_n(by, n, ts)
    return F.when(F.count(y).over(w) >= n, F.regr_slope(y, i).over(w))


def percent_rank_below(x: Column | str, n: int, by: By, ts: str = "ts") -> Column:
    """Share in percent of the last n values that are strictly below the current one."""
    x = F.col(x) if isinstance(x, str) else x
    w = last_n(by, n, ts)
    a = F.collect_list(x).over(w)
    return F.when(F.count(x).over(w) >= n, 100.0 * F.size(F.filter(a, lambda v: v < F.element_at(a, -1))) / F.size(a))


def forward_fill(x: Column | str, by: By, ts: str = "ts") -> Column:
    return F.last(x, ignorenulls=True).over(running(by, ts))


def streak(flag: Column, by: By, ts: str = "ts") -> tuple[Column, Column]:
    """(group to partition by, whether inside): rows since the flag last changed share a group."""
    w = ordered(by, ts)
    return F.sum(F.when(flag, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)), flag
