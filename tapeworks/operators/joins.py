"""As-of joins and their kin, without range joins.

Both sides are put into one table, ordered by time within the key, and the last row
seen of the right side is carried along: one shuffle and one sort for any sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, by: list[str], ts: str, right_first: bool) -> tuple[DataFrame, list[str]]:
    values = [c for c in right.columns if c not in by]
    l = left.select(*by, F.col(ts).alias("_t"), F.lit(1 if right_first else 0).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"))  # noqa: E741
    r = right.select(*by, F.col(ts).alias("_t"), F.lit(0 if right_first else 1).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), F.struct(*values).alias("_right"))
    return l.unionByName(r), values


def _carried(by: list[str], backward: bool):
    """The last right row seen in the direction of time; forward too the frame grows from the
    partition's first row, since a frame that ends at its last row is read anew for every row."""
    order = [F.asc("_t"), F.asc("_side")] if backward else [F.desc("_t"), F.desc("_side")]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last("_right", ignorenulls=True).over(w)


def asof(left: DataFrame, right: DataFrame, by: list[str], ts: str = "ts", prefix: str = "r_", direction: str = "backward") -> DataFrame:
    """Every left row with the last right row at or before it (``forward``: the first at or after it)."""
    backward = direction == "backward"
    both, values = _merged(left, right, by, ts, backward)
    out = both.withColumn("_right", _carried(by, backward)).where("_left is not null")
    return out.select("_left.*", *[F.col(f"_right.{v}").alias(prefix + v) for v in values])


def asof_completed(left: DataFrame, bars: DataFrame, by: list[str], length: str, prefix: str = "r_") -> DataFrame:
    """The last bar of a coarser frequency that was over: its time is moved to its end."""
    return asof(left, bars.withColumn("ts", (F.col("ts") + F.expr(f"INTERVAL {length}")).cast("timestamp_ntz")), by, prefix=prefix)


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], tolerance_seconds: int, ts: str = "ts", prefix: str = "r_") -> DataFrame:
    """Every left row with the closest right row within a tolerance; ties take the earlier one."""
    values = [c for c in right.columns if c not in by]
    both, _ = _merged(left, right, by, ts, True)
    both = both.withColumn("_b", _carried(by, True))
    both = both.withColumn("_f", _carried(by, False)).where("_left is not null")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    before, after = micros("_t") - micros(f"_b.{ts}"), micros(f"_f.{ts}") - micros("_t")
    limit = F.lit(tolerance_seconds * 1_000_000)
    pick = F.when((before <= limit) & (after.isNull() | (before <= after)), F.col("_b")).when(after <= limit, F.col("_f"))
    return both.withColumn("_right", pick).select("_left.*", *[F.col(f"_right.{v}").alias(prefix + v) for v in values])


def previous_session(sessions: DataFrame, by: list[str], date: str, values: list[str], prefix: str = "prior_") -> DataFrame:
    """Each session with the values of the session before it."""
    w = Window.partitionBy(*by).orderBy(date)
    return sessions.select(*by, date, *[F.lag(v).over(w).alias(prefix + v) for v in values])


def missing_weekdays(df: DataFrame, date: str, by: list[str] | None = None) -> DataFrame:
    """by, d: weekdays between the first and the last date of each key that have no row."""
    by = by or []
    days = df.select(*by, F.col(date).cast("date").alias("d")).distinct()
    span = days.groupBy(*by).agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a is not null")
    every = span.select(*by, F.explode(F.sequence("a", "b")).alias("d")).where(F.weekday("d") < 5)
    return every.join(days, [*by, "d"], "left_anti")
