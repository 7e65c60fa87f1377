"""Clock, session and scalar queries, and the filter language."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import timeutil as T
from ..functions.rules import compile_rules, parse_rule
from ..functions.windows import forward_fill
from ..operators.outliers import accepted
from ..sources.tape import table, ticks
from .base import BARS_SQL, ONLY_TICKS, hour_bars, rounded

_ET = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
_SEC = lambda x: f"(hour({x}) * 3600 + minute({x}) * 60 + CAST(floor(second({x})) AS BIGINT))"


@register(f"{ONLY_TICKS} SELECT event_id, {_ET} AS eastern, {_SEC(_ET)} BETWEEN 34200 AND 57599 AS rth, {_SEC('ts')} >= 52200 AND {_SEC('ts')} < 75600 AS rth_utc, {_SEC('ts')} BETWEEN 34200 AND 57599 AS rth_naive FROM ticks")
def p01_sessions(spark, sf_dir):
    """Eastern clock, and the three definitions of the regular session."""
    ts = F.col("ts")
    return ticks(spark, sf_dir).select("event_id", T.eastern(ts).alias("eastern"), T.in_session(ts).alias("rth"), T.in_session(ts, "utc").alias("rth_utc"), T.in_session(ts, "naive").alias("rth_naive"))


@register(f"""{ONLY_TICKS}, m AS (SELECT event_id, hour({_ET}) * 60 + minute({_ET}) AS m FROM ticks)
SELECT event_id, CASE WHEN m >= 570 AND m < 660 THEN 'open' WHEN m >= 660 AND m < 870 THEN 'midday' WHEN m >= 870 AND m < 960 THEN 'close' END AS segment,
  CAST(floor((m - 570) / 15) AS INTEGER) AS slot, CASE WHEN m >= 570 THEN strftime(TIMESTAMP '2000-01-01' + to_minutes(CAST(m // 15 * 15 AS BIGINT)), '%H:%M') END AS label FROM m""")
def p05_segments_and_slots(spark, sf_dir):
    ts = F.col("ts")
    df = ticks(spark, sf_dir).select("event_id", T.segment(ts).alias("segment"), T.slot(ts).alias("slot"))
    return df.withColumn("label", F.when(F.col("slot") >= 0, T.slot_label(F.col("slot"))))


@register(f"{ONLY_TICKS} SELECT event_id, CAST(epoch_us(ts) * 1000 AS BIGINT) AS timestamp_ns, date_trunc('hour', ts) AS hour, time_bucket(INTERVAL 5 MINUTE, ts) AS five FROM ticks")
def p07_epoch_and_truncate(spark, sf_dir):
    ts = F.col("ts")
    return ticks(spark, sf_dir).select("event_id", (F.unix_micros(ts.cast("timestamp")) * 1000).alias("timestamp_ns"), F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour"), F.window(ts, "5 minutes")["start"].cast("timestamp_ntz").alias("five"))


@register(f"""{ONLY_TICKS}, e AS (SELECT event_id, {_SEC(_ET)} AS s, isodow({_ET}) - 1 AS d, CAST({_ET} AS DATE) AS day FROM ticks)
SELECT event_id, d < 5 AND s >= 34200 AND s < 57600 AS is_rth,
  CAST(CASE WHEN d < 5 AND s >= 34200 AND s < 57600 THEN 0 ELSE (CASE WHEN d < 5 AND s < 34200 THEN 0 WHEN d = 4 THEN 3 WHEN d = 5 THEN 2 ELSE 1 END) * 86400 + 34200 - s END AS BIGINT) AS to_open,
  CASE WHEN s < 34200 THEN day - 1 ELSE day END AS session FROM e""")
def p09_session_calendar(spark, sf_dir):
    ts = F.col("ts")
    return ticks(spark, sf_dir).select("event_id", (T.in_session(ts) & (F.weekday(T.eastern(ts)) < 5)).alias("is_rth"), T.seconds_to_open(ts).alias("to_open"), T.session_date(ts).alias("session"))


@register("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 0.25) * 0.25 AS half_up, CAST(round_even(l_extendedprice / 0.25, 0) AS DOUBLE) * 0.25 AS half_even FROM lineitem")
def p11_tick_rounding(spark, sf_dir):
    x = F.col("l_extendedprice") / 0.25
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.round(x) * 0.25).alias("half_up"), (F.bround(x) * 0.25).alias("half_even"))


@register(f"{BARS_SQL} SELECT symbol, ts, greatest(least(close - open, 5.0), -5.0) AS clipped, round(ln(greatest(close, 0.25)), 4) AS log_close, round(sqrt(abs(close - open)), 4) AS root, CAST(sign(close - open) AS DOUBLE) AS side, coalesce(nullif(close - open, 0), -1.0) AS filled FROM bars")
def p12_scalars(spark, sf_dir):
    move = F.col("close") - F.col("open")
    out = hour_bars(spark, sf_dir).select("symbol", "ts", F.greatest(F.least(move, F.lit(5.0)), F.lit(-5.0)).alias("clipped"), F.ln(F.greatest("close", F.lit(0.25))).alias("log_close"), F.sqrt(F.abs(move)).alias("root"), F.signum(move).alias("side"), F.coalesce(F.nullif(move, F.lit(0.0)), F.lit(-1.0)).alias("filled"))
    return rounded(out, ["log_close", "root"])


@register(f"{ONLY_TICKS}, x AS (SELECT event_id, symbol, ts, CASE WHEN side = 'B' THEN px END AS v FROM ticks) SELECT event_id, symbol, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM x")
def p13_forward_fill(spark, sf_dir):
    return ticks(spark, sf_dir).withColumn("b", F.when(F.col("side") == "B", F.col("px"))).select("event_id", "symbol", forward_fill("b", ["symbol"]).alias("v"))


@register(f"{ONLY_TICKS} SELECT event_id, round(sin({_SEC('ts')} / 86400.0 * 2 * pi()), 4) AS s, round(cos({_SEC('ts')} / 86400.0 * 2 * pi()), 4) AS c, {_SEC(_ET)} / 60.0::DOUBLE AS minutes FROM ticks")
def p14_cyclic_time(spark, sf_dir):
    ts = F.col("ts")
    s, c = T.cyclic(ts)
    return rounded(ticks(spark, sf_dir).select("event_id", s.alias("s"), c.alias("c"), (T.second_of_day(T.eastern(ts)) / 60).alias("minutes")), ["s", "c"])


@register(f"""{ONLY_TICKS.replace("WITH ", "WITH RECURSIVE ", 1)}, o AS (SELECT symbol, event_id, px, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM ticks),
r AS (SELECT symbol, event_id, i, px AS kept, true AS ok FROM o WHERE i = 1
  UNION ALL SELECT o.symbol, o.event_id, o.i, CASE WHEN 5 * abs(o.px - r.kept) <= 4 * r.kept THEN o.px ELSE r.kept END, 5 * abs(o.px - r.kept) <= 4 * r.kept FROM r JOIN o ON o.symbol = r.symbol AND o.i = r.i + 1)
SELECT event_id, symbol, ok FROM r""")
def p16_outlier_reject(spark, sf_dir):
    """Ticks further than 80 % from the last accepted price are rejected (in order)."""
    return accepted(ticks(spark, sf_dir), 0.8).select("event_id", "symbol", "ok")


@register(f"{BARS_SQL}, n AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) SELECT symbol, ts, close FROM n WHERE k BETWEEN 3 AND 12")
def p17_tail_slice(spark, sf_dir):
    """Ten bars of each symbol, two before the last."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return hour_bars(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k between 3 and 12").select("symbol", "ts", "close")


@register(f"{ONLY_TICKS} SELECT event_id, ts FROM ticks")
def p18_iso_strings(spark, sf_dir):
    """ISO strings with a Z, written and read."""
    t = ticks(spark, sf_dir).withColumn("text", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return t.select("event_id", F.to_timestamp_ntz(F.regexp_replace("text", "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("ts"))


RULES = [{"signal": "vol", "expr": ">= 20"}, {"signal": "move", "expr": "abs <= 3.5"}, {"signal": "vol", "expr": "passes"}, {"signal": "absent", "expr": "> 1"}, {"signal": "move", "expr": "false"}]


@register(f"""{BARS_SQL}, s AS (SELECT symbol, ts, CAST(volume AS DOUBLE) AS vol, close > open AS up, close - open AS move FROM bars)
SELECT symbol, ts, vol >= 20 AND abs(move) <= 3.5 AND up AS passes,
  concat_ws(';', CASE WHEN NOT vol >= 20 THEN 'vol >= 20' END, CASE WHEN NOT abs(move) <= 3.5 THEN 'move abs <= 3.5' END, CASE WHEN NOT up THEN 'vol passes' END) AS reasons FROM s""")
def f02_filter_rules(spark, sf_dir):
    """Rules over signal structs: missing signals and disabled rules are skipped, reasons collected."""
    b = hour_bars(spark, sf_dir)
    sig = lambda v, p: F.struct(v.cast("double").alias("value"), p.alias("passes"))
    b = b.withColumn("vol", sig(F.col("volume"), F.col("close") > F.col("open"))).withColumn("move", sig(F.col("close") - F.col("open"), F.lit(True)))
    ok, reasons = compile_rules([parse_rule(r) for r in RULES], b)
    return b.select("symbol", "ts", ok.alias("passes"), F.array_join(reasons, ";").alias("reasons"))


@register(f"""{BARS_SQL}, d AS (SELECT symbol, date_trunc('day', ts) + INTERVAL 1 DAY AS ts, CAST(sum(volume) AS DOUBLE) AS v FROM bars GROUP BY ALL)
SELECT b.symbol, b.ts, b.volume >= 10 AND coalesce(d.v >= 150, true) AS passes FROM bars b ASOF LEFT JOIN d ON d.symbol = b.symbol AND b.ts >= d.ts""")
def f03_two_timeframes(spark, sf_dir):
    """A rule on hourly bars, then one on the last finished day; no data for a stage skips it."""
    from ..operators.joins import asof_completed

    b = hour_bars(spark, sf_dir).withColumn("vol", F.struct(F.col("volume").cast("double").alias("value"), F.lit(True).alias("passes")))
    day = b.groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("volume").cast("double").alias("v"))
    joined = asof_completed(b, day, ["symbol"], "1 DAY")
    joined = joined.withColumn("dayvol", F.when(F.col("r_v").isNotNull(), F.struct(F.col("r_v").alias("value"), F.lit(True).alias("passes"))))
    ok, _ = compile_rules([parse_rule({"signal": "vol", "expr": ">= 10", "seq": 1}), parse_rule({"signal": "dayvol", "expr": ">= 150", "seq": 2})], joined)
    return joined.select("symbol", "ts", ok.alias("passes"))
