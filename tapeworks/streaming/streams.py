"""The same operators on unbounded input.

Clock bars are a watermarked window aggregate.  Bars that close on a threshold and
brackets that ticks resolve keep one small state row a key; state logic is the plain
functions that batch operators use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TICK_SCHEMA = "event_id long, symbol string, ts timestamp, px long, size long, bid long, ask long, side string"
_BAR = "symbol string, bar long, ts timestamp, open double, high double, low double, close double, volume long, n_ticks long"


def read_ticks(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files of ticks; each trigger takes at most ``files`` (back-pressure)."""
    return spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def clock_bars(ticks: DataFrame, freq: str, lateness: str = "10 seconds") -> DataFrame:
    """Clock-aligned bars, each given out once the watermark has passed its end; later ticks are dropped."""
    w = F.window("ts", freq)
    out = ticks.withWatermark("ts", lateness).groupBy("symbol", w.alias("w")).agg(
        (F.min_by("px", "ts") / 4.0).alias("open"), (F.max("px") / 4.0).alias("high"), (F.min("px") / 4.0).alias("low"), (F.max_by("px", "ts") / 4.0).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("n_ticks")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n_ticks")


def _ordered(key: str, frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat([f for f in frames if len(f)])
    return rows.sort_values("ts", kind="stable")


def threshold_bars(ticks: DataFrame, threshold: int, weight: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Bars that close with the tick that brings their weight to the threshold; the state is the open bar.

    Ticks of one trigger are put in order; across triggers the order of arrival counts.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, acc, bar = 0, 0.0, None
        if state.exists:
            number, acc, *rest = state.get
            bar = list(rest) if rest[5] else None
        rows = _ordered(key[0], frames)
        out = []
        for w, r in zip(weight(rows).tolist(), rows.itertuples(index=False), strict=True):
            p = r.px / 4.0
            if bar is None:
                bar = [r.ts, p, p, p, p, 0, 0]
            bar[2], bar[3], bar[4] = max(bar[2], p), min(bar[3], p), p
            bar[5] += r.size
            bar[6] += 1
            acc += w
            if acc >= threshold:
                out.append((key[0], number, *bar))
                number, acc, bar = number + 1, 0.0, None
        state.update((number, acc, *(bar or [pd.Timestamp(0), 0.0, 0.0, 0.0, 0.0, 0, 0])))
        yield pd.DataFrame(out, columns=["symbol", "bar", "ts", "open", "high", "low", "close", "volume", "n_ticks"])

    kept = "number long, acc double, ts timestamp, open double, high double, low double, close double, volume long, n_ticks long"
    return ticks.groupBy("symbol").applyInPandasWithState(step, _BAR, kept, "append", GroupStateTimeout.NoTimeout)


_FILL = "symbol string, entry_ts timestamp, exit_ts timestamp, side int, entry double, exit double, reason string"


def brackets(ticks: DataFrame, target_ticks: int, stop_ticks: int, lifetime_seconds: int) -> DataFrame:
    """A paper account on ticks: an aggressive tick opens a trade; the target is looked at before the stop, then expiry."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side, entry, at = state.get if state.exists else (0, 0, pd.Timestamp(0))
        out = []
        for r in _ordered(key[0], frames).itertuples(index=False):
            if side:
                gain = side * (r.px - entry)
                age = (r.ts - at).total_seconds()
                why, px = ("target", entry + side * target_ticks) if gain >= target_ticks else ("stop", entry - side * stop_ticks) if gain <= -stop_ticks else ("expired", r.px) if age >= lifetime_seconds else (None, 0)
                if why:
                    out.append((key[0], at, r.ts, side, entry / 4.0, px / 4.0, why))
                    side = 0
            elif r.side in ("A", "B"):
                side, entry, at = (1 if r.side == "B" else -1), int(r.px), r.ts
        state.update((side, entry, at))
        yield pd.DataFrame(out, columns=["symbol", "entry_ts", "exit_ts", "side", "entry", "exit", "reason"])

    return ticks.groupBy("symbol").applyInPandasWithState(step, _FILL, "side int, entry long, at timestamp", "append", GroupStateTimeout.NoTimeout)


def outcomes(predictions: DataFrame, prices: DataFrame, horizon_seconds: int, lateness: str = "10 seconds") -> DataFrame:
    """Predictions with the price at their horizon: a stream-stream join whose state the watermarks bound."""
    p = predictions.withColumn("due", (F.col("ts") + F.expr(f"INTERVAL {horizon_seconds} SECONDS"))).withWatermark("due", lateness).withColumnRenamed("symbol", "_s")
    q = prices.select("symbol", F.col("ts").alias("at"), F.col("close").alias("later")).withWatermark("at", lateness)
    return p.join(q, (F.col("_s") == F.col("symbol")) & (F.col("at") >= F.col("due")) & (F.col("at") < F.col("due") + F.expr("INTERVAL 1 HOUR"))).drop("_s")


def merge_into(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that merges bars into a table of numbered snapshots; a batch that comes again changes nothing."""
    from ..sources.store import upsert_bars

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("seq", F.lit(number).cast("long"))
        if number:
            stored = spark.read.parquet(f"{path}/v={number - 1}")
            out = upsert_bars(stored, new, keys)
        else:
            out = new.drop("seq")
        out.write.mode("overwrite").parquet(f"{path}/v={number}")

    return merge


def tail_sink(path: str, keep: int, f: Callable[[DataFrame], DataFrame], ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that runs a batch operator on the last ``keep`` rows of each symbol and gives out the new rows.

    The tail is a numbered snapshot, bounded by symbols times ``keep``; what ``f`` makes of
    tail and new rows is kept for the new ones, in a part for each batch.  A batch that
    comes again reads the snapshot before it and writes the same part.
    """
    from pyspark.sql import Window

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        both = batch.withColumn("_new", F.lit(True))
        if number:
            both = both.unionByName(spark.read.parquet(f"{path}/tail/v={number - 1}").withColumn("_new", F.lit(False)))
        last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(ts)))
        both = both.persist()
        try:
            new = both.where("_new").select("symbol", ts).distinct()
            f(both.drop("_new")).join(new, ["symbol", ts], "left_semi").write.mode("overwrite").parquet(f"{path}/out/batch={number}")
            both.drop("_new").withColumn("_n", last).where(F.col("_n") <= keep).drop("_n").write.mode("overwrite").parquet(f"{path}/tail/v={number}")
        finally:
            both.unpersist()

    return step


def run_sink(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that is there through a foreachBatch sink, then stop."""
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def timer_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for ``trigger(processingTime=...)``: what has arrived since the last trigger is one bar of each symbol, whatever its clock says."""

    def step(batch: DataFrame, number: int) -> None:
        bars = batch.groupBy("symbol").agg(F.min("ts").alias("ts"), (F.min_by("px", "ts") / 4.0).alias("open"), (F.max("px") / 4.0).alias("high"), (F.min("px") / 4.0).alias("low"), (F.max_by("px", "ts") / 4.0).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("n_ticks"))
        bars.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


_SESSION = "symbol string, event string, day date, ts timestamp, n long, realised double"


def sessions(fills: DataFrame) -> DataFrame:
    """Open and close events of each symbol's sessions from a stream of (symbol, ts, day, pnl): at a close the day's rows and P&L, which start anew."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, n, total, at = state.get if state.exists else (None, 0, 0.0, None)
        out = []
        for r in _ordered(key[0], frames).itertuples(index=False):
            if r.day != day:
                if day is not None:
                    out.append((key[0], "close", day, at, n, total))
                out.append((key[0], "open", r.day, r.ts, 0, 0.0))
                day, n, total = r.day, 0, 0.0
            n, total, at = n + 1, total + r.pnl, r.ts
        state.update((day, n, total, at))
        yield pd.DataFrame(out, columns=["symbol", "event", "day", "ts", "n", "realised"])

    return fills.groupBy("symbol").applyInPandasWithState(step, _SESSION, "day date, n long, total double, at timestamp", "append", GroupStateTimeout.NoTimeout)


def staleness(ticks: DataFrame, now, limit_seconds: int = 30) -> DataFrame:
    """symbol, last time, age in seconds at ``now`` and whether it is stale: a complete-mode aggregate on a stream, a plain one on a table."""
    out = ticks.groupBy("symbol").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    return out.withColumn("age", age).withColumn("stale", F.col("age") > limit_seconds)


def health(query: StreamingQuery) -> dict:
    """State, rows, rates and latency of a running query from its own progress reports."""
    reports = [p.json if hasattr(p, "json") else p for p in query.recentProgress]
    import json

    reports = [json.loads(p) if isinstance(p, str) else p for p in reports]
    took = sorted(p["durationMs"].get("triggerExecution", 0) for p in reports if p.get("durationMs"))
    return {"active": query.isActive, "error": str(query.exception()) if query.exception() else None, "batches": len(reports), "rows": sum(p["numInputRows"] for p in reports), "latency_ms": {"min": took[0], "max": took[-1], "p99": took[min(len(took) - 1, int(len(took) * 0.99))]} if took else None, "last": reports[-1]["timestamp"] if reports else None}


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there, then stop; a restart goes on from the checkpoint."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
