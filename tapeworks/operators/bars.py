"""Bars from ticks and from finer bars.

Clock bars are plain aggregates: first and last come from ``min_by``/``max_by`` on a
unique time, so partial aggregation applies and no sort is needed.  Bars that close
on a running total that starts anew after each (dollar and volume bars) depend on
where the bar before ended; they run as one pass over each key's ordered rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINT_VALUE = 5

#: Ways to tell who was aggressive: (bought, sold) of a tick.
CLASSIFY: dict[str, Callable[[], tuple[Column, Column]]] = {
    "midpoint": lambda: (2 * F.col("px") > F.col("bid") + F.col("ask"), 2 * F.col("px") < F.col("bid") + F.col("ask")),
    "side_ba": lambda: (F.col("side") == "B", F.col("side") == "A"),
    "side_bs": lambda: (F.col("side") == "B", F.col("side") == "S"),
    "bbo": lambda: (F.col("px") >= F.col("ask"), (F.col("px") < F.col("ask")) & (F.col("px") <= F.col("bid"))),
    "tick_rule": lambda: (F.col("_dpx") > 0, F.col("_dpx") < 0),
}


def _at(freq: str, ts: str = "ts") -> Column:
    return F.window(ts, freq)["start"].cast("timestamp_ntz")


def price(ticks: Column) -> Column:
    """Whole quarter ticks as a price."""
    return ticks / F.lit(4.0)


def clock_bars(ticks: DataFrame, freq: str, classify: str = "midpoint", by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Clock-aligned bars: OHLC, volume, vwap, aggressive volumes, mean quotes, ticks."""
    if classify == "tick_rule":
        w = Window.partitionBy(*by).orderBy("ts")
        ticks = ticks.withColumn("_dpx", F.col("px") - F.lag("px").over(w))
    bought, sold = CLASSIFY[classify]()
    size = F.col("size")
    agg = ticks.groupBy(*by, _at(freq).alias("ts")).agg(
        price(F.min_by("px", "ts")).alias("open"),
        price(F.max("px")).alias("high"),
        price(F.min("px")).alias("low"),
        price(F.max_by("px", "ts")).alias("close"),
        F.sum("size").alias("volume"),
        (F.sum(F.col("px") * size) / (F.lit(4.0) * F.sum("size"))).alias("vwap"),
        F.sum(F.when(bought, size).otherwise(0)).alias("buy_volume"),
        F.sum(F.when(sold, size).otherwise(0)).alias("sell_volume"),
        (F.sum("bid") / (F.lit(4.0) * F.count("*"))).alias("avg_bid"),
        (F.sum("ask") / (F.lit(4.0) * F.count("*"))).alias("avg_ask"),
        F.count("*").alias("n_ticks"),
    )
    return agg.where("volume > 0")


BARS_COLUMNS = """CAST(arg_min(px, ts) AS DOUBLE) / 4 AS open, max(px) / 4.0::DOUBLE AS high, min(px) / 4.0::DOUBLE AS low, CAST(arg_max(px, ts) AS DOUBLE) / 4 AS close,
         CAST(sum(size) AS BIGINT) AS volume, CAST(sum(px * size) AS DOUBLE) / (4.0::DOUBLE * sum(size)) AS vwap,
         CAST(sum(CASE WHEN {buy} THEN size ELSE 0 END) AS BIGINT) AS buy_volume, CAST(sum(CASE WHEN {sell} THEN size ELSE 0 END) AS BIGINT) AS sell_volume,
         CAST(sum(bid) AS DOUBLE) / (4.0::DOUBLE * count(*)) AS avg_bid, CAST(sum(ask) AS DOUBLE) / (4.0::DOUBLE * count(*)) AS avg_ask, count(*) AS n_ticks"""


def bars_sql(name: str = "bars", bucket: str = "date_trunc('hour', ts)", buy: str = "2 * px > bid + ask", sell: str = "2 * px < bid + ask") -> str:
    return f"{name} AS (SELECT symbol, {bucket} AS ts, {BARS_COLUMNS.format(buy=buy, sell=sell)} FROM ticks GROUP BY symbol, {bucket})"


def resample(bars: DataFrame, freq: str, by: tuple[str, ...] = ("symbol",), weighted: tuple[str, ...] = (), summed: tuple[str, ...] = ()) -> DataFrame:
    """Bars of a coarser frequency; vwap and ``weighted`` columns by volume, ``summed`` added up."""
    v = F.col("volume")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * v), F.sum(v)).alias(c)
    extra = [mean(c) for c in (("vwap", *weighted) if "vwap" in bars.columns else weighted)]
    return bars.groupBy(*by, _at(freq).alias("ts")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), *extra, *[F.sum(c).alias(c) for c in summed])


def anchored_bars(ticks: DataFrame, seconds: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Time bars counted from the first tick of each key, named by their own first tick."""
    first = ticks.groupBy(*by).agg(F.min("ts").alias("_first"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    keyed = ticks.join(first, list(by)).withColumn("bar", F.floor(gap / F.lit(seconds * 1_000_000)).cast("long"))
    return _by_bar(keyed, by)


def tick_bars(ticks: DataFrame, n: int, by: tuple[str, ...] = ("symbol",), partial: bool = False) -> DataFrame:
    """Bars of n ticks; the last one only if it is full, unless ``partial``."""
    w = Window.partitionBy(*by).orderBy("ts")
    keyed = ticks.withColumn("bar", F.floor((F.row_number().over(w) - 1) / n).cast("long"))
    out = _by_bar(keyed, by)
    return out if partial else out.where(F.col("n_ticks") == n)


def _by_bar(keyed: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return keyed.groupBy(*by, "bar").agg(
        F.min("ts").alias("ts"),
        price(F.min_by("px", "ts")).alias("open"),
        price(F.max("px")).alias("high"),
        price(F.min("px")).alias("low"),
        price(F.max_by("px", "ts")).alias("close"),
        F.sum("size").alias("volume"),
        (F.sum(F.col("px") * F.col("size")) / (F.lit(4.0) * F.sum("size"))).alias("vwap"),
        F.count("*").alias("n_ticks"),
    )


def threshold_groups(weights: np.ndarray, threshold: float, start: int = 0, carry: float = 0.0) -> tuple[np.ndarray, int, float]:
    """Number of the bar of each row: a bar ends with the row that brings its sum to the threshold; nothing carries over.

    The search jumps from bar to bar on the running sum, so its steps are bars, not rows.
    """
    total = np.cumsum(weights) + carry
    out = np.empty(len(weights), np.int64)
    at, base, bar = 0, 0.0, start
    while at < len(weights):
        end = int(np.searchsorted(total, base + threshold, "left"))
        if end >= len(weights):
            out[at:] = bar
            return out, bar, float(total[-1] - base)
        out[at : end + 1] = bar
        base, at, bar = float(total[end]), end + 1, bar + 1
    return out, bar, 0.0


def numbered(df: DataFrame, threshold: float, weight: Column, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``df`` with ``bar``, the number of the threshold bar of each row, and ``_w``, its weight.

    Rows of a key are read in order in bounded batches: only the open bar's number and
    sum are carried, so a key with very many rows needs no more memory than another.
    """
    by = list(by)
    ordered = df.withColumn("_w", weight.cast("double")).repartition(*by).sortWithinPartitions(*by, "ts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, bar, carry = None, 0, 0.0
        for pdf in batches:
            number = np.empty(len(pdf), np.int64)
            for k, rows in pdf.groupby(by, sort=False, dropna=False).indices.items():
                if k != key:
                    key, bar, carry = k, 0, 0.0
                number[rows], bar, carry = threshold_groups(pdf["_w"].to_numpy()[rows], threshold, bar, carry)
            yield pdf.assign(bar=number)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", bar long"
    return ordered.mapInPandas(run, schema)


def threshold_bars(ticks: DataFrame, threshold: int, weight: str, by: tuple[str, ...] = ("symbol",), partial: bool = False) -> DataFrame:
    """Dollar bars (weight ``px * size``, in whole units) or volume bars (``size``) of ticks.

    Which rows belong together is found in order; the bars are aggregated natively.
    """
    keyed = numbered(ticks.select(*by, "ts", "px", "size"), threshold, F.expr(weight), by)
    out = keyed.groupBy(*by, "bar").agg(F.min("ts").alias("ts"), price(F.min_by("px", "ts")).alias("open"), price(F.max("px")).alias("high"), price(F.min("px")).alias("low"), price(F.max_by("px", "ts")).alias("close"), F.sum("size").alias("volume"), (F.sum(F.col("px") * F.col("size")) / (F.lit(4.0) * F.sum("size"))).alias("vwap"), F.sum("_w").alias("weight"), F.count("*").alias("n_ticks"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros"))
    return out if partial else out.where(F.col("weight") >= threshold)


def dollar_bars_of_bars(bars: DataFrame, threshold: float, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Dollar bars of finer bars by close * volume * point value; what is left at the end is not emitted."""
    keyed = numbered(bars.select(*by, "ts", "open", "high", "low", "close", "volume"), threshold, F.col("close") * F.col("volume") * POINT_VALUE, by)
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    out = keyed.groupBy(*by, "bar").agg(F.min("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("_w").alias("dollar_volume"), seconds.alias("bar_duration_s"))
    return out.where(F.col("dollar_volume") >= threshold)


def rich_bars(ticks: DataFrame, freq: str) -> DataFrame:
    """Microstructure of a bar: sizes, spreads, up and down ticks, imbalance, depth ratio, microprice."""
    w = Window.partitionBy("symbol").orderBy("ts")
    spread = F.col("ask") - F.col("bid")
    t = ticks.withColumn("_d", F.col("px") - F.lag("px").over(w))
    size = F.col("size")
    agg = t.groupBy("symbol", _at(freq).alias("ts")).agg(
        F.count("*").alias("n_ticks"),
        F.sum("size").alias("volume"),
        (F.sum("size") / F.count("*")).alias("mean_size"),
        F.median("size").alias("median_size"),
        (F.sum(spread) / (F.lit(4.0) * F.count("*"))).alias("mean_spread"),
        price(F.max(spread)).alias("max_spread"),
        F.sum((F.col("_d") > 0).cast("long")).alias("upticks"),
        F.sum((F.col("_d") < 0).cast("long")).alias("downticks"),
        (F.sum(F.col("px") * size) / F.lit(4.0)).alias("dollar_volume"),
        (F.sum("bid_size") / (F.sum("bid_size") + F.sum("size"))).alias("depth_ratio"),
        (F.sum(F.col("bid") * size + F.col("ask") * F.col("bid_size")) / (F.lit(4.0) * F.sum(size + F.col("bid_size")))).alias("microprice"),
        F.sum(F.when(F.col("side") == "B", size).when(F.col("side") == "A", -size).otherwise(0)).alias("delta"),
    )
    return agg.withColumns({"upticks": F.coalesce("upticks", F.lit(0)), "downticks": F.coalesce("downticks", F.lit(0)), "imbalance": F.col("delta") / F.col("volume")})


def large_trades(ticks: DataFrame, freq: str, times: float = 2.0) -> DataFrame:
    """Share of a bar's volume in trades over ``times`` its median size."""
    keyed = ticks.withColumn("bar", _at(freq))
    median = keyed.groupBy("symbol", "bar").agg(F.median("size").alias("m"))
    large = F.when(F.col("size") > times * F.col("m"), F.col("size")).otherwise(0)
    return keyed.join(median, ["symbol", "bar"]).groupBy("symbol", F.col("bar").alias("ts")).agg((F.sum(large) / F.sum("size")).alias("large_share"))


def builder(kind: str, **options) -> Callable[[DataFrame], DataFrame]:
    """The bar transform of a configuration: time, clock, dollar, volume or tick."""
    if kind == "time":
        return lambda t: anchored_bars(t, options["seconds"])
    if kind == "clock":
        return lambda t: clock_bars(t, options["freq"], options.get("classify", "midpoint"))
    if kind == "tick":
        return lambda t: tick_bars(t, options["n"], partial=options.get("partial", False))
    if kind in ("dollar", "volume"):
        weight = f"px * size * {POINT_VALUE}" if kind == "dollar" else "size"
        return lambda t: threshold_bars(t, options["threshold"] * (4 if kind == "dollar" else 1), weight, partial=options.get("partial", False))
    raise ValueError(f"unknown kind of bar: {kind}")
