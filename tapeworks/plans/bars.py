"""Bar construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import bars as B
from ..sources.tape import ticks
from .base import BARS_SQL, ONLY_TICKS, hour_bars, rounded

_DAY = "CAST(ts AS DATE)"


@register(f"""{BARS_SQL}, keyed AS (SELECT *, {_DAY} AS day, (SELECT 1) AS one FROM bars),
t AS (SELECT symbol, date_trunc('hour', ts) AS ts, sum(px * size) AS m FROM ticks GROUP BY ALL)
SELECT k.symbol, k.ts, k.open, k.high, k.low, k.close, k.volume, k.vwap, k.buy_volume, k.sell_volume,
  CAST(sum(t.m) OVER w AS DOUBLE) / (4.0::DOUBLE * sum(k.volume) OVER w) AS session_vwap
FROM keyed k JOIN t USING (symbol, ts) WINDOW w AS (PARTITION BY k.symbol, k.day ORDER BY k.ts)""")
def bars_1h_vwap(spark, sf_dir):
    """Hourly bars with aggressive volumes and the session's vwap so far, in whole ticks until the last division."""
    from pyspark.sql import Window

    t = ticks(spark, sf_dir)
    money = t.groupBy("symbol", F.window("ts", "1 hour")["start"].cast("timestamp_ntz").alias("ts")).agg(F.sum(F.col("px") * F.col("size")).alias("m"))
    w = Window.partitionBy("symbol", F.col("ts").cast("date")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    b = B.clock_bars(t, "1 hour").join(money, ["symbol", "ts"])
    return b.select("symbol", "ts", "open", "high", "low", "close", "volume", "vwap", "buy_volume", "sell_volume", (F.sum("m").over(w) / (F.lit(4.0) * F.sum("volume").over(w))).alias("session_vwap"))


@register(f"""{BARS_SQL} SELECT symbol, date_trunc('day', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
  CAST(sum(volume) AS BIGINT) AS volume, round(sum(vwap * volume) / sum(volume), 4) AS vwap, round(sum(avg_bid * volume) / sum(volume), 4) AS avg_bid,
  CAST(sum(buy_volume) AS BIGINT) AS buy_volume FROM bars GROUP BY symbol, date_trunc('day', ts)""")
def a01_resample(spark, sf_dir):
    out = B.resample(hour_bars(spark, sf_dir), "1 day", weighted=("avg_bid",), summed=("buy_volume",))
    return rounded(out, ["vwap", "avg_bid"])


def _classified(name: str, how: str, buy: str, sell: str, ticks_sql: str = ONLY_TICKS) -> None:
    sql = f"{ticks_sql}, {B.bars_sql(buy=buy, sell=sell)} SELECT symbol, ts, close, volume, buy_volume, sell_volume, avg_bid, avg_ask, n_ticks FROM bars"

    def query(spark, sf_dir):
        return B.clock_bars(ticks(spark, sf_dir), "1 hour", how).select("symbol", "ts", "close", "volume", "buy_volume", "sell_volume", "avg_bid", "avg_ask", "n_ticks")

    register(sql, name)(query)


_classified("a02_bars_midpoint", "midpoint", "2 * px > bid + ask", "2 * px < bid + ask")
_classified("a03_bars_side_ba", "side_ba", "side = 'B'", "side = 'A'")
_classified("a04_bars_side_bs", "side_bs", "side = 'B'", "side = 'S'")
_classified("a13_bars_bbo", "bbo", "px >= ask", "px < ask AND px <= bid")
_classified("a05_bars_tick_rule", "tick_rule", "dpx > 0", "dpx < 0", ONLY_TICKS.replace("ticks AS (", "raw AS (", 1) + ", ticks AS (SELECT *, px - lag(px) OVER (PARTITION BY symbol ORDER BY ts) AS dpx FROM raw)")


@register(f"""{ONLY_TICKS}, d AS (SELECT *, px - lag(px) OVER (PARTITION BY symbol ORDER BY ts) AS dpx FROM ticks)
SELECT symbol, date_trunc('hour', ts) AS ts, count(*) AS n_ticks, CAST(sum(size) AS BIGINT) AS volume, round(sum(size) / count(*), 4) AS mean_size, median(size) AS median_size,
  round(sum(ask - bid) / (4.0::DOUBLE * count(*)), 4) AS mean_spread, CAST(max(ask - bid) AS DOUBLE) / 4 AS max_spread,
  count(*) FILTER (dpx > 0) AS upticks, count(*) FILTER (dpx < 0) AS downticks, CAST(sum(px * size) AS DOUBLE) / 4 AS dollar_volume,
  round(CAST(sum(bid_size) AS DOUBLE) / (sum(bid_size) + sum(size)), 4) AS depth_ratio,
  round(CAST(sum(bid * size + ask * bid_size) AS DOUBLE) / (4.0::DOUBLE * sum(size + bid_size)), 4) AS microprice,
  CAST(sum(CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END) AS BIGINT) AS delta,
  round(CAST(sum(CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END) AS DOUBLE) / sum(size), 4) AS imbalance
FROM d GROUP BY symbol, date_trunc('hour', ts)""")
def a06_microstructure(spark, sf_dir):
    return rounded(B.rich_bars(ticks(spark, sf_dir), "1 hour"), ["mean_size", "mean_spread", "depth_ratio", "microprice", "imbalance"])


@register(f"""{ONLY_TICKS}, m AS (SELECT *, date_trunc('hour', ts) AS bar, median(size) OVER (PARTITION BY symbol, date_trunc('hour', ts)) AS m FROM ticks)
SELECT symbol, bar AS ts, round(CAST(sum(CASE WHEN size > 2 * m THEN size ELSE 0 END) AS DOUBLE) / sum(size), 4) AS large_share FROM m GROUP BY symbol, bar""")
def a07_large_trades(spark, sf_dir):
    return rounded(B.large_trades(ticks(spark, sf_dir), "1 hour"), ["large_share"])


_BY_BAR = """SELECT symbol, bar, min(ts) AS ts, CAST(arg_min(px, ts) AS DOUBLE) / 4 AS open, CAST(max(px) AS DOUBLE) / 4 AS high, CAST(min(px) AS DOUBLE) / 4 AS low, CAST(arg_max(px, ts) AS DOUBLE) / 4 AS close,
  CAST(sum(size) AS BIGINT) AS volume, CAST(sum(px * size) AS DOUBLE) / (4.0::DOUBLE * sum(size)) AS vwap, count(*) AS n_ticks"""


@register(f"""{ONLY_TICKS}, k AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY symbol)) // 7200000000 AS bar FROM ticks)
{_BY_BAR} FROM k GROUP BY symbol, bar""")
def a08_anchored_bars(spark, sf_dir):
    return B.anchored_bars(ticks(spark, sf_dir), 7200)


def _threshold_sql(weight: str, threshold: int, extra: str = "") -> str:
    """The recursion itself: a running sum that starts anew after each bar's end."""
    return f"""{ONLY_TICKS.replace("WITH ", "WITH RECURSIVE ", 1)},
o AS (SELECT *, {weight} AS w, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM ticks),
r AS (SELECT symbol, i, 0 AS bar, CAST(w AS HUGEINT) AS acc FROM o WHERE i = 1
  UNION ALL SELECT o.symbol, o.i, CASE WHEN r.acc >= {threshold} THEN r.bar + 1 ELSE r.bar END, CASE WHEN r.acc >= {threshold} THEN o.w ELSE r.acc + o.w END
  FROM r JOIN o ON o.symbol = r.symbol AND o.i = r.i + 1),
k AS (SELECT o.*, CAST(r.bar AS BIGINT) AS bar FROM o JOIN r USING (symbol, i))
{_BY_BAR}{extra} FROM k GROUP BY symbol, bar HAVING sum(w) >= {threshold}"""


@register(_threshold_sql("px * size * 5", 4 * 20000, ", CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS micros"))
def a09_dollar_bars(spark, sf_dir):
    """Dollar bars of ticks: 20,000 a bar, without the unfinished last one."""
    return B.builder("dollar", threshold=20000)(ticks(spark, sf_dir)).drop("weight")


@register(_threshold_sql("size", 500))
def a10_volume_bars(spark, sf_dir):
    return B.builder("volume", threshold=500)(ticks(spark, sf_dir)).drop("weight", "micros")


@register(f"""{ONLY_TICKS}, k AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1) // 25 AS bar FROM ticks)
{_BY_BAR} FROM k GROUP BY symbol, bar HAVING count(*) = 25""")
def a11_tick_bars(spark, sf_dir):
    return B.tick_bars(ticks(spark, sf_dir), 25)


@register(f"""{BARS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)},
o AS (SELECT *, close * volume * 5 AS w, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars),
r AS (SELECT symbol, i, 0 AS bar, w AS acc FROM o WHERE i = 1
  UNION ALL SELECT o.symbol, o.i, CASE WHEN r.acc >= 100000 THEN r.bar + 1 ELSE r.bar END, CASE WHEN r.acc >= 100000 THEN o.w ELSE r.acc + o.w END
  FROM r JOIN o ON o.symbol = r.symbol AND o.i = r.i + 1),
k AS (SELECT o.*, CAST(r.bar AS BIGINT) AS bar FROM o JOIN r USING (symbol, i))
SELECT symbol, bar, min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume,
  round(sum(w), 2) AS dollar_volume, CAST(epoch(max(ts)) - epoch(min(ts)) AS DOUBLE) AS bar_duration_s
FROM k GROUP BY symbol, bar HAVING sum(w) >= 100000""")
def a12_dollar_bars_from_bars(spark, sf_dir):
    """Dollar bars of finer bars: close * volume * 5 summed to 100,000; the rest is not emitted."""
    from ..operators.bars import dollar_bars_of_bars

    return rounded(dollar_bars_of_bars(hour_bars(spark, sf_dir), 100000), ["dollar_volume"], 2)


@register(f"""{ONLY_TICKS} SELECT symbol, date_trunc('minute', ts) AS ts, CAST(arg_min(px, ts) AS DOUBLE) / 4 AS open, CAST(max(px) AS DOUBLE) / 4 AS high, CAST(min(px) AS DOUBLE) / 4 AS low, CAST(arg_max(px, ts) AS DOUBLE) / 4 AS close,
  CAST(sum(size) AS BIGINT) AS volume, round(CAST(sum(px * size) AS DOUBLE) / (4.0::DOUBLE * nullif(sum(size), 0)), 4) AS vwap FROM ticks GROUP BY symbol, date_trunc('minute', ts)""")
def s24_minute_view(spark, sf_dir):
    """The one-minute materialised view."""
    out = B.clock_bars(ticks(spark, sf_dir), "1 minute").select("symbol", "ts", "open", "high", "low", "close", "volume", "vwap")
    return rounded(out, ["vwap"])
