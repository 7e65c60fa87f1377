"""Join queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import joins as J
from ..operators.bars import clock_bars
from ..sources.tape import table, ticks
from .base import BARS_SQL, ONLY_TICKS, hour_bars, rounded


@register("""SELECT o.o_orderkey, o.o_totalprice, l.l_linenumber, l.l_extendedprice FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE l.l_discount IS NOT NULL AND o.o_totalprice IS NOT NULL""")
def j01_inner(spark, sf_dir):
    """Features joined with labels on their key, nulls dropped; filters and columns reach the scans."""
    o = table(spark, sf_dir, "orders").where("o_totalprice is not null").select("o_orderkey", "o_totalprice")
    li = table(spark, sf_dir, "lineitem").where("l_discount is not null").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_totalprice", "l_linenumber", "l_extendedprice")


_L1 = "l1 AS (SELECT symbol, date_trunc('hour', ts) AS ts, CAST(sum(bid_size) AS BIGINT) AS bid_size FROM ticks WHERE side = 'B' GROUP BY ALL)"


@register(f"{BARS_SQL}, {_L1} SELECT b.symbol, b.ts, b.close, coalesce(l1.bid_size, 0) AS bid_size, l1.symbol IS NOT NULL AS matched FROM bars b LEFT JOIN l1 USING (symbol, ts)")
def j02_left_fill(spark, sf_dir):
    l1 = ticks(spark, sf_dir).where("side = 'B'").groupBy("symbol", F.window("ts", "1 hour")["start"].cast("timestamp_ntz").alias("ts")).agg(F.sum("bid_size").alias("s"))
    return hour_bars(spark, sf_dir).join(l1, ["symbol", "ts"], "left").select("symbol", "ts", "close", F.coalesce("s", F.lit(0)).alias("bid_size"), F.col("s").isNotNull().alias("matched"))


def _sides(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return clock_bars(t, "1 hour").select("symbol", "ts"), t.select("symbol", "ts", "px")


@register(f"{BARS_SQL} SELECT b.symbol, b.ts, t.ts AS r_ts, t.px AS r_px FROM bars b ASOF LEFT JOIN ticks t ON b.symbol = t.symbol AND b.ts >= t.ts")
def j03_asof(spark, sf_dir):
    """The last tick at or before the start of each bar."""
    return J.asof(*_sides(spark, sf_dir), ["symbol"])


@register(f"{BARS_SQL} SELECT b.symbol, b.ts, t.ts AS r_ts, t.px AS r_px FROM bars b ASOF LEFT JOIN ticks t ON b.symbol = t.symbol AND b.ts <= t.ts")
def j03_asof_forward(spark, sf_dir):
    return J.asof(*_sides(spark, sf_dir), ["symbol"], direction="forward")


@register(f"{BARS_SQL}, t AS (SELECT event_id, symbol, ts FROM ticks), f AS (SELECT symbol, ts + INTERVAL 1 HOUR AS ts, close FROM bars) SELECT t.event_id, t.symbol, t.ts, f.ts AS r_ts, f.close AS r_close FROM t ASOF LEFT JOIN f ON t.symbol = f.symbol AND t.ts >= f.ts")
def j04_asof_completed(spark, sf_dir):
    """Each tick with the last hourly bar that was over."""
    t = ticks(spark, sf_dir)
    return J.asof_completed(t.select("event_id", "symbol", "ts"), clock_bars(t, "1 hour").select("symbol", "ts", "close"), ["symbol"], "1 HOUR")


@register(f"""{BARS_SQL}, p AS (SELECT symbol, ts FROM bars), b AS (SELECT p.*, t.ts AS bts, t.px AS bpx FROM p ASOF LEFT JOIN ticks t ON p.symbol = t.symbol AND p.ts >= t.ts),
f AS (SELECT p.*, t.ts AS fts, t.px AS fpx FROM p ASOF LEFT JOIN ticks t ON p.symbol = t.symbol AND p.ts <= t.ts),
d AS (SELECT *, epoch_us(ts) - epoch_us(bts) AS db, epoch_us(fts) - epoch_us(ts) AS df FROM b JOIN f USING (symbol, ts))
SELECT symbol, ts, CASE WHEN db <= 600000000 AND (df IS NULL OR db <= df) THEN bts WHEN df <= 600000000 THEN fts END AS r_ts,
  CASE WHEN db <= 600000000 AND (df IS NULL OR db <= df) THEN bpx WHEN df <= 600000000 THEN fpx END AS r_px FROM d""")
def j05_asof_nearest(spark, sf_dir):
    """The tick closest to the start of each bar, within ten minutes."""
    return J.asof_nearest(*_sides(spark, sf_dir), ["symbol"], 600)


@register(f"{BARS_SQL}, d AS (SELECT symbol, date_trunc('day', ts) AS ts, arg_max(close, ts) AS close FROM bars GROUP BY ALL) SELECT b.symbol, b.ts, d.ts AS r_ts, d.close AS r_close FROM bars b ASOF LEFT JOIN d ON b.symbol = d.symbol AND b.ts >= d.ts")
def j06_align_started(spark, sf_dir):
    """Each bar with the coarser bar that has started, finished or not."""
    b = hour_bars(spark, sf_dir).select("symbol", "ts", "close")
    day = b.groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max_by("close", "ts").alias("close"))
    return J.asof(b.select("symbol", "ts"), day, ["symbol"])


@register(f"{BARS_SQL} SELECT b.symbol, b.ts, t.event_id, epoch_us(t.ts) - epoch_us(b.ts) AS offset_us FROM bars b JOIN ticks t ON t.symbol = b.symbol AND t.ts >= b.ts AND t.ts < b.ts + INTERVAL 1 HOUR")
def j07_interval_map(spark, sf_dir):
    """Ticks of each bar by an equi-join on the truncated time, not by a range join."""
    t = ticks(spark, sf_dir).withColumn("bar", F.window("ts", "1 hour")["start"].cast("timestamp_ntz"))
    b = hour_bars(spark, sf_dir).select("symbol", F.col("ts").alias("bar"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return b.join(t, ["symbol", "bar"]).select("symbol", F.col("bar").alias("ts"), "event_id", (us("ts") - us("bar")).alias("offset_us"))


@register(f"""{ONLY_TICKS}, s AS (SELECT date_trunc('hour', ts) AS h, CASE WHEN count(*) > 20 THEN 'BUSY' ELSE 'CALM' END AS state FROM ticks WHERE symbol = 'view' GROUP BY ALL)
SELECT t.event_id, coalesce(s.state, 'UNKNOWN') AS state FROM ticks t LEFT JOIN s ON s.h = date_trunc('hour', t.ts)""")
def j08_left_unknown(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("h", F.window("ts", "1 hour")["start"])
    s = t.where("symbol = 'view'").groupBy("h").agg(F.when(F.count("*") > 20, "BUSY").otherwise("CALM").alias("state"))
    return t.join(s, "h", "left").select("event_id", F.coalesce("state", F.lit("UNKNOWN")).alias("state"))


@register(f"{BARS_SQL}, x AS (SELECT t.event_id, t.symbol, t.ts, b.close AS c FROM ticks t LEFT JOIN bars b ON b.symbol = t.symbol AND b.ts = date_trunc('minute', t.ts)) SELECT event_id, symbol, ts, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM x")
def j09_join_forward_fill(spark, sf_dir):
    """Prices joined back to rows by time, and carried forward where there is none."""
    b = hour_bars(spark, sf_dir).select("symbol", F.col("ts").alias("m"), "close")
    t = ticks(spark, sf_dir).withColumn("m", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return t.join(b, ["symbol", "m"], "left").select("event_id", "symbol", "ts", F.last("close", ignorenulls=True).over(w).alias("close"))


@register(f"{ONLY_TICKS}, m AS (SELECT symbol, date_trunc('day', ts) AS d, median(size) AS m FROM ticks GROUP BY ALL) SELECT t.event_id, t.size > m.m AS above FROM ticks t JOIN m ON m.symbol = t.symbol AND m.d = date_trunc('day', t.ts)")
def j10_group_statistic(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("d", F.col("ts").cast("date"))
    m = t.groupBy("symbol", "d").agg(F.median("size").alias("m"))
    return t.join(m, ["symbol", "d"]).select("event_id", (F.col("size") > F.col("m")).alias("above"))


@register(f"{BARS_SQL} SELECT symbol, ts, close FROM bars WHERE CAST(ts AS DATE) IN (SELECT CAST(o_orderdate AS DATE) + 9000 - 9000 FROM orders) OR CAST(ts AS DATE) IN (SELECT DATE '2024-01-05' + CAST(r_regionkey AS INTEGER) FROM region)")
def j11_date_set(spark, sf_dir):
    """Bars on the days of a small set, by a semi-join."""
    days = table(spark, sf_dir, "region").select(F.date_add(F.lit("2024-01-05").cast("date"), F.col("r_regionkey").cast("int")).alias("d"))
    days = days.union(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date"))).distinct()
    b = hour_bars(spark, sf_dir).withColumn("d", F.col("ts").cast("date"))
    return b.join(days, "d", "left_semi").select("symbol", "ts", "close")


@register("""WITH d AS (SELECT DISTINCT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT p, CAST(unnest(range(min(d), max(d) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM d GROUP BY p)
SELECT s.p AS o_orderpriority, s.d FROM s ANTI JOIN d ON s.p = d.p AND s.d = d.d WHERE isodow(s.d) < 6""")
def j12_missing_weekdays(spark, sf_dir):
    """Weekdays between the first and last date of each priority on which there is no order."""
    return J.missing_weekdays(table(spark, sf_dir, "orders"), "o_orderdate", ["o_orderpriority"])


_PNL = "d AS (SELECT symbol, CAST(ts AS DATE) AS day, CAST(sum(CASE WHEN side = 'B' THEN px ELSE -px END) AS DOUBLE) / 4 AS pnl FROM ticks GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM d)"


@register(f"{ONLY_TICKS}, {_PNL} SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE coalesce(corr(a.pnl, b.pnl), 0.0) END, 4) AS corr FROM n a JOIN n b ON a.i = b.i AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol")
def j13_pairwise_correlation(spark, sf_dir):
    """Correlation of daily P&L between strategies, matched by position."""
    d = ticks(spark, sf_dir).groupBy("symbol", F.col("ts").cast("date").alias("day")).agg((F.sum(F.when(F.col("side") == "B", F.col("px")).otherwise(-F.col("px"))) / F.lit(4.0)).alias("pnl"))
    n = d.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("day")))
    a, b = n.select(F.col("symbol").alias("a"), "i", F.col("pnl").alias("x")), n.select(F.col("symbol").alias("b"), "i", F.col("pnl").alias("y"))
    out = a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.when(F.count("*") < 2, 0.0).otherwise(F.coalesce(F.corr("x", "y"), F.lit(0.0))).alias("corr"))
    return rounded(out, ["corr"])


@register("SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS param_id, a, b, c FROM (SELECT unnest([10, 20, 40]) AS a) CROSS JOIN (SELECT unnest([1.0::DOUBLE, 1.5::DOUBLE]) AS b) CROSS JOIN (SELECT unnest(['none', 'adx']) AS c)")
def j14_parameter_grid(spark, sf_dir):
    """All combinations of parameters and filters, made on the driver."""
    from ..operators.validation import grid

    return grid(spark, {"a": [10, 20, 40], "b": [1.0, 1.5], "c": ["adx", "none"]})


@register(f"{BARS_SQL}, s AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM bars GROUP BY ALL) SELECT symbol, day, lag(high) OVER w AS prior_high, lag(low) OVER w AS prior_low, lag(close) OVER w AS prior_close FROM s WINDOW w AS (PARTITION BY symbol ORDER BY day)")
def j15_prior_session(spark, sf_dir):
    s = hour_bars(spark, sf_dir).groupBy("symbol", F.col("ts").cast("date").alias("day")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))
    return J.previous_session(s, ["symbol"], "day", ["high", "low", "close"])
