"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..sources.tape import ticks
from ..streaming import streams as S
from .base import BARS_SQL, ONLY_TICKS, hour_bars, rounded, shared_folder


def _source(spark, sf_dir):
    """Ticks written as a few files, and read as a stream."""
    path = shared_folder(spark, "ticks")
    t = ticks(spark, sf_dir).select("event_id", "symbol", F.col("ts").cast("timestamp").alias("ts"), "px", "size", "bid", "ask", "side")
    t.repartitionByRange(4, "ts").write.parquet(path)
    return S.read_ticks(spark, path, 4)


def _ran(spark, df):
    out = shared_folder(spark, "stream")
    S.run_once(df, f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data")


@register(f"""{ONLY_TICKS}, m AS (SELECT max(ts) - INTERVAL 10 SECOND AS m FROM ticks), b AS (SELECT symbol, date_trunc('hour', ts) AS ts, CAST(arg_min(px, ts) AS DOUBLE) / 4 AS open, CAST(max(px) AS DOUBLE) / 4 AS high, CAST(min(px) AS DOUBLE) / 4 AS low, CAST(arg_max(px, ts) AS DOUBLE) / 4 AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n_ticks FROM ticks GROUP BY ALL)
SELECT b.* FROM b, m WHERE b.ts + INTERVAL 1 HOUR <= m""")
def r03_stream_clock_bars(spark, sf_dir):
    """Hourly bars of a stream: those that the watermark has closed."""
    out = _ran(spark, S.clock_bars(_source(spark, sf_dir), "1 hour"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register()
def r04_stream_volume_bars(spark, sf_dir):
    """Volume bars of a stream; the open bar is kept as state."""
    out = _ran(spark, S.threshold_bars(_source(spark, sf_dir), 500, lambda rows: rows["size"]))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register()
def r10_stream_brackets(spark, sf_dir):
    """Paper trades resolved on the ticks of a stream."""
    out = _ran(spark, S.brackets(_source(spark, sf_dir), 40, 40, 86400))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("entry_ts", "exit_ts")})


def _bar_source(spark, sf_dir, parts: int = 3):
    """Hourly bars that arrive in order of time: a file for each of a few spans, one after the other."""
    path = shared_folder(spark, "bars")
    b = hour_bars(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    span = b.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    part = F.least(F.floor((F.unix_micros("ts") - span["a"]) * parts / (span["b"] - span["a"])), F.lit(parts - 1))
    for k in range(parts):
        b.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _tailed(spark, sf_dir, keep: int, f):
    out = shared_folder(spark, "tail")
    S.run_sink(_bar_source(spark, sf_dir), S.tail_sink(out, keep, f), f"{out}/state")
    return spark.read.parquet(f"{out}/out").drop("batch")


_SMA = "CASE WHEN count(*) OVER f >= 50 THEN avg(close) OVER f END"


@register(f"""{BARS_SQL}, x AS (SELECT symbol, ts, {_SMA} AS m, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) > 20 AS late, avg(volume) OVER g AS v, volume FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), g AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING))
SELECT symbol, ts, round(coalesce(100 * (close - m) / m, 0.0), 4) AS sma_trend, round(CASE WHEN late THEN volume / v ELSE 1.0 END, 4) AS rvol FROM x""")
def r06_rolling_state(spark, sf_dir):
    """Signals of each new bar of a stream from the last 500 bars of its symbol."""
    from ..operators.enrich import enrich
    from ..operators.signals import compute

    def f(bars):
        out = enrich(compute(bars.withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["sma_trend"], sma_trend={"n": 50}), ["relative_volume"])
        return out.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.round("sma_trend.value", 4).alias("sma_trend"), F.round("sig_rvol_value", 4).alias("rvol"))

    return _tailed(spark, sf_dir, 500, f).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register()
def q06_online_features(spark, sf_dir):
    """26 features of each new bar of a stream, scaled from five values on."""
    from ..operators.predictor import BARS_26, features_26_online

    out = _tailed(spark, sf_dir, 500, features_26_online)
    return rounded(out, BARS_26).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register()
def r09_online_regime(spark, sf_dir):
    """Regimes of each new bar of a stream by stored models, from the last 500 bars."""
    from ..operators.regime import apply_models, train

    models = train(hour_bars(spark, sf_dir).where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    models = spark.createDataFrame(models.collect(), models.schema)  # one row a symbol
    out = _tailed(spark, sf_dir, 500, lambda bars: apply_models(bars, models))
    return rounded(out, ["p_trending", "p_ranging", "p_highvol", "confidence"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register(f"{ONLY_TICKS} SELECT symbol, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n_ticks FROM ticks GROUP BY symbol")
def r02_timer_bars(spark, sf_dir):
    """Bars by arrival: one of each symbol and trigger; their sums are those of the tape."""
    out = shared_folder(spark, "timer")
    S.run_sink(_source(spark, sf_dir), S.timer_sink(out), f"{out}-state")
    bars = spark.read.parquet(out)
    return bars.groupBy("symbol").agg(F.sum("volume").alias("volume"), F.sum("n_ticks").alias("n_ticks"))


@register(f"""{BARS_SQL}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, min(ts) AS a, max(ts) AS b, count(*) AS n, sum(close - open) AS p FROM bars GROUP BY ALL), l AS (SELECT *, lead(day) OVER (PARTITION BY symbol ORDER BY day) AS later FROM d)
SELECT symbol, 'open' AS event, day, a AS ts, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS realised FROM l UNION ALL SELECT symbol, 'close', day, b, n, round(p, 4) FROM l WHERE later IS NOT NULL""")
def r07_session_events(spark, sf_dir):
    """Opens and closes of sessions of a stream, with what the session did; the last one is still open."""
    fills = _bar_source(spark, sf_dir).select("symbol", "ts", F.col("ts").cast("date").alias("day"), (F.col("close") - F.col("open")).alias("pnl"))
    out = _ran(spark, S.sessions(fills))
    return rounded(out, ["realised"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register(f"{ONLY_TICKS}, l AS (SELECT symbol, max(ts) AS last, count(*) AS n FROM ticks GROUP BY symbol) SELECT symbol, last, n, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last)) / 1e6 AS age, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last) > 3600000000 AS stale FROM l")
def r12_staleness(spark, sf_dir):
    """Age of each symbol's last tick at a moment."""
    out = S.staleness(ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "2024-02-01 00:00:00", 3600)
    return out.withColumn("last", F.col("last").cast("timestamp_ntz"))
