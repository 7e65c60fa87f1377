"""Volume profiles, value areas and intraday shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TICK = 0.25
DAY = ["symbol", "day"]


def volume_profile(bars: DataFrame) -> DataFrame:
    """Volume at each tick of the close: symbol, day, level (whole ticks), volume."""
    level = F.round(F.col("close") / TICK).cast("long")
    return bars.groupBy(*DAY, level.alias("level")).agg(F.sum("volume").cast("double").alias("volume"))


def tpo_profile(bars: DataFrame) -> DataFrame:
    """Each bar's volume spread evenly over the ticks from its low to its high; rounded, so that ties don't hang on the order of addition."""
    lo, hi = F.round(F.col("low") / TICK).cast("long"), F.round(F.col("high") / TICK).cast("long")
    n = hi - lo + 1
    return bars.select(*DAY, (F.col("volume") / n).alias("v"), F.explode(F.sequence(lo, hi)).alias("level")).groupBy(*DAY, "level").agg(F.round(F.sum("v"), 6).alias("volume"))


def expand(levels: np.ndarray, volumes: np.ndarray, share: float = 0.7, tie: str = "below") -> tuple[int, int, int]:
    """(poc, low, high) as levels: from the level of most volume (ties: the lowest), the larger neighbour is added until the share is held."""
    top = int(volumes.argmax())
    lo = hi = top
    held, want = volumes[top], share * volumes.sum()
    while held < want and (lo > 0 or hi < len(levels) - 1):
        below = volumes[lo - 1] if lo > 0 else -1.0
        above = volumes[hi + 1] if hi < len(levels) - 1 else -1.0
        if below > above or below == above and tie == "below":
            lo -= 1
            held += below
        else:
            hi += 1
            held += above
    return int(levels[top]), int(levels[lo]), int(levels[hi])


def daily_value_areas(profile: DataFrame, share: float = 0.7, tie: str = "below") -> DataFrame:
    """symbol, day, poc, val, vah, volume of each session. A session's levels are bounded by its price range."""
    kinds = {f.name: f.dataType.simpleString() for f in profile.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("level")
        poc, lo, hi = expand(pdf["level"].to_numpy(), pdf["volume"].to_numpy(), share, tie)
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "day": [pdf["day"].iloc[0]], "poc": [poc * TICK], "val": [lo * TICK], "vah": [hi * TICK], "volume": [float(pdf["volume"].sum())]})

    return profile.groupBy(*DAY).applyInPandas(run, f"symbol {kinds['symbol']}, day {kinds['day']}, poc double, val double, vah double, volume double")


def volatility_heatmap(bars: DataFrame, slot: Column, month: Column, per_day: int) -> DataFrame:
    """Annualised realised volatility by slot and month, from log returns within a session."""
    w = Window.partitionBy(*DAY).orderBy("ts")
    r = F.ln("close") - F.ln(F.lag("close").over(w))
    return bars.withColumn("r", r).where("r is not null").groupBy(slot.alias("slot"), month.alias("month")).agg((F.sqrt(F.avg(F.col("r") * F.col("r"))) * F.sqrt(F.lit(252.0 * per_day))).alias("rv"), F.count("*").alias("n"))


def dead_zone(cells: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Longest run of slots whose mean volatility is under the overall mean over ``threshold`` (ties: the first run)."""
    by_slot = cells.groupBy("slot").agg(F.avg("rv").alias("v"))
    mean = cells.agg(F.avg("rv").alias("m"))
    quiet = by_slot.join(F.broadcast(mean)).where(F.col("v") < F.col("m") / threshold)
    runs = quiet.withColumn("g", F.col("slot") - F.row_number().over(Window.orderBy("slot"))).groupBy("g").agg(F.min("slot").alias("first"), F.max("slot").alias("last"), F.count("*").alias("n"))
    return runs.orderBy(F.desc("n"), "first").limit(1).select("first", "last", "n")


def u_shape(cells: DataFrame, open_slots=(0, 3), mid=(8, 15), close=(22, 25)) -> DataFrame:
    """Mean volatility at the open, in the middle and at the close, and their ratios; empty cells are left out."""
    v = F.when(F.col("rv") > 0, F.col("rv"))
    part = lambda s: F.avg(F.when(F.col("slot").between(*s), v))
    out = cells.agg(part(open_slots).alias("open"), part(mid).alias("mid"), part(close).alias("close"))
    return out.withColumn("open_ratio", F.try_divide("open", "mid")).withColumn("close_ratio", F.try_divide("close", "mid"))


def spread_cost(bars: DataFrame, slot: Column) -> DataFrame:
    """Mean true range of each slot, and a tick as percent of it."""
    w = Window.partitionBy("symbol").orderBy("ts")
    before = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    out = bars.withColumn("tr", tr).groupBy(slot.alias("slot")).agg(F.avg("tr").alias("atr"), F.count("*").alias("n"))
    return out.withColumn("cost_pct", F.when(F.col("atr") > 0, 100 * TICK / F.col("atr")))
