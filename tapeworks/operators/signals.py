"""Signals as columns: one struct (value, passes, direction, ...) for each, by name.

Every signal here is a composition of window aggregates over bars keyed by symbol
(or symbol and session date), so it runs unchanged on many symbols at once.  Bars
have symbol, ts, open, high, low, close, volume, vwap, buy_volume, sell_volume,
avg_bid, avg_ask.  Recursive signals are in ``recursive``.

A signal is null-safe in its warm-up: value 0 (or its neutral), passes false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import eastern, minute_of_day, second_of_day
from ..functions.windows import last_n, ordered, percent_rank_below, rolling, running

BY = ["symbol"]
DAY = ["symbol", "day"]
TICK = 0.25

Signal = Callable[..., DataFrame]
REGISTRY: dict[str, Signal] = {}


def signal(name: str):
    """Register a signal: a function of bars (and parameters) that adds the struct column ``name``."""

    def add(f: Signal) -> Signal:
        REGISTRY[name] = f
        return f

    return add


def compute(bars: DataFrame, names: list[str], **configs: dict) -> DataFrame:
    """Bars with a struct column for each named signal; unknown names are an error."""
    from . import recursive  # noqa: F401  registers its own

    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown signals: {', '.join(unknown)}")
    for n in names:
        bars = REGISTRY[n](bars, **configs.get(n, {}))
    return bars


def result(value: Column, passes: Column, direction: Column | str = "none", **meta: Column) -> Column:
    direction = F.lit(direction) if isinstance(direction, str) else direction
    return F.struct(F.coalesce(value, F.lit(0.0)).alias("value"), F.coalesce(passes, F.lit(False)).alias("passes"), F.coalesce(direction, F.lit("none")).alias("direction"), *[c.alias(n) for n, c in meta.items()])


def with_day(bars: DataFrame) -> DataFrame:
    return bars if "day" in bars.columns else bars.withColumn("day", F.col("ts").cast("date"))


def _number(bars: DataFrame) -> DataFrame:
    return bars if "_i" in bars.columns else bars.withColumn("_i", F.row_number().over(ordered(BY)))


def _slope(y: str, n: int) -> Column:
    w = last_n(BY, n)
    return F.when(F.count(y).over(w) >= n, F.regr_slope(F.col(y), F.col("_i")).over(w))


def _drop(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


@signal("bollinger")
def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Distance from the mean in deviations; passes outside the bands, against the move."""
    df = bars.withColumn("_m", rolling(F.avg, "close", n, BY)).withColumn("_s", rolling(F.stddev_samp, "close", n, BY))
    df = df.withColumn("_p", F.lag("_s", 5).over(ordered(BY)))
    m, s, c = F.col("_m"), F.col("_s"), F.col("close")
    up, low = m + k * s, m - k * s
    value = F.when(s > 1e-10, (c - m) / s)
    return _drop(df.withColumn("bollinger", result(value, (c > up) | (c < low), F.when(c < low, "long").when(c > up, "short"), upper=up, lower=low, bandwidth=F.try_divide(up - low, m), pct_b=F.try_divide(c - low, up - low), band_expanding=F.coalesce(s > 1.1 * F.col("_p"), F.lit(False)))))


@signal("cvd_divergence")
def cvd_divergence(bars: DataFrame, n: int = 20, z: float = 1.5) -> DataFrame:
    """Slope of cumulative volume delta against that of price."""
    span = F.col("high") - F.col("low")
    bvc = F.when(span > 0, F.col("volume") * (2 * (F.col("close") - F.col("low")) / span - 1)).otherwise(0.0)
    delta = F.when(F.col("buy_volume") + F.col("sell_volume") > 0, (F.col("buy_volume") - F.col("sell_volume")).cast("double")).otherwise(bvc)
    df = _number(bars).withColumn("_d", delta).withColumn("_c", F.sum("_d").over(running(BY)))
    df = df.withColumn("_sc", _slope("_c", n)).withColumn("_sp", _slope("close", n))
    df = df.withColumn("_sd", rolling(F.stddev_samp, "_sc", n, BY, least=2))
    zz = F.when(F.col("_sd") > 1e-10, F.col("_sc") / F.col("_sd"))
    apart = F.signum("_sc") * F.signum("_sp") < 0
    return _drop(df.withColumn("cvd_divergence", result(zz, apart & (F.abs(zz) >= z), F.when(apart & (F.col("_sc") > 0), "long").when(apart, "short"), cvd_slope=F.col("_sc"), price_slope=F.col("_sp"))))


@signal("donchian_channel")
def donchian_channel(bars: DataFrame, n: int = 20, exit_n: int = 10, rank_n: int = 100, near_ticks: int = 2) -> DataFrame:
    """Channel of the bars before this one; passes on a close beyond it."""
    o = ordered(BY)
    full = F.count("high").over(o.rowsBetween(-n, -1)) >= n
    df = bars.withColumn("_u", F.when(full, F.max("high").over(o.rowsBetween(-n, -1)))).withColumn("_l", F.when(full, F.min("low").over(o.rowsBetween(-n, -1))))
    short = F.count("high").over(o.rowsBetween(-exit_n, -1)) >= exit_n
    df = df.withColumn("_xu", F.when(short, F.max("high").over(o.rowsBetween(-exit_n, -1)))).withColumn("_xl", F.when(short, F.min("low").over(o.rowsBetween(-exit_n, -1))))
    df = df.withColumn("_w", F.col("_u") - F.col("_l"))
    df = df.withColumn("_r", percent_rank_below("_w", rank_n, BY)).withColumn("_pw", F.lag("_w", 5).over(o))
    u, l, c, mid = F.col("_u"), F.col("_l"), F.col("close"), (F.col("_u") + F.col("_l")) / 2  # noqa: E741
    near = F.greatest(F.lit(near_ticks * TICK), 0.05 * F.col("_w"))
    return _drop(df.withColumn("donchian_channel", result(F.col("_w"), (c > u) | (c < l), F.when(c > u, "long").when(c < l, "short"), upper=u, lower=l, mid=mid, exit_upper=F.col("_xu"), exit_lower=F.col("_xl"), at_midline=F.coalesce(F.abs(c - mid) <= near, F.lit(False)), width_percentile=F.col("_r"), channel_expanding=F.coalesce(F.col("_w") > F.col("_pw"), F.lit(False)))))


def _session_open(bars: DataFrame) -> DataFrame:
    df = with_day(bars)
    return df.withColumn("_m", (second_of_day(F.col("ts"))) / 60).withColumn("_open", F.min("_m").over(Window.partitionBy(*DAY)))


@signal("initial_balance")
def initial_balance(bars: DataFrame, minutes: int = 60, near: float = 1.5) -> DataFrame:
    """Range of a session's first minutes; passes near an unbroken extreme after it."""
    df = _session_open(bars)
    inside = F.col("_m") < F.col("_open") + minutes
    w = Window.partitionBy(*DAY)
    df = df.withColumn("_hi", F.max(F.when(inside, F.col("high"))).over(w)).withColumn("_lo", F.min(F.when(inside, F.col("low"))).over(w))
    seen = running(DAY)
    df = df.withColumn("_up", F.max("high").over(seen)).withColumn("_dn", F.min("low").over(seen))
    hi, lo, c = F.col("_hi"), F.col("_lo"), F.col("close")
    dh, dl = F.abs(c - hi), F.abs(c - lo)
    whole = (F.col("_up") <= hi + 0.5) & (F.col("_dn") >= lo - 0.5)
    value = F.when(~inside, F.least(dh, dl))
    return _drop(df.withColumn("initial_balance", result(value, ~inside & whole & (value <= near), F.when(~inside & (dh <= dl), "short").when(~inside, "long"), ib_high=F.when(~inside, hi), ib_low=F.when(~inside, lo))))


@signal("mfi")
def mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Money flow index; below 20 long, above 80 short."""
    df = bars.withColumn("_t", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_pt", F.lag("_t").over(ordered(BY)))
    flow = F.col("_t") * F.col("volume")
    df = df.withColumn("_up", F.when(F.col("_pt").isNotNull(), F.when(F.col("_t") > F.col("_pt"), flow).otherwise(0.0))).withColumn("_dn", F.when(F.col("_pt").isNotNull(), F.when(F.col("_t") < F.col("_pt"), flow).otherwise(0.0)))
    ratio = rolling(F.sum, "_up", n, BY) / F.greatest(rolling(F.sum, "_dn", n, BY), F.lit(1e-10))
    value = F.coalesce(100 - 100 / (1 + ratio), F.lit(50.0))
    return _drop(df.withColumn("mfi", result(value, (value < 20) | (value > 80), F.when(value < 20, "long").when(value > 80, "short"))))


@signal("obv")
def obv(bars: DataFrame, n: int = 10) -> DataFrame:
    """Slope of on-balance volume."""
    df = _number(bars).withColumn("_pc", F.lag("close").over(ordered(BY)))
    step = F.when(F.col("close") > F.col("_pc"), F.col("volume")).when(F.col("close") < F.col("_pc"), -F.col("volume")).otherwise(0)
    df = df.withColumn("_s", step).withColumn("_o", F.sum("_s").over(running(BY)).cast("double")).withColumn("_k", F.round(_slope("_o", n), 9))  # a flat line is flat, whatever the last bit
    return _drop(df.withColumn("obv", result(F.col("_k"), F.abs("_k") > 0, F.when(F.col("_k") > 0, "long").when(F.col("_k") < 0, "short"), obv=F.col("_o"))))


@signal("orb_breakout")
def orb_breakout(bars: DataFrame, minutes: int = 15, least: int = 3) -> DataFrame:
    """Ticks beyond the opening range, after it."""
    df = _session_open(bars)
    inside = F.col("_m") <= F.col("_open") + minutes
    w = Window.partitionBy(*DAY)
    df = df.withColumn("_hi", F.max(F.when(inside, F.col("high"))).over(w)).withColumn("_lo", F.min(F.when(inside, F.col("low"))).over(w)).withColumn("_n", F.sum(inside.cast("int")).over(w))
    ready = ~inside & (F.col("_n") >= least)
    c, hi, lo = F.col("close"), F.col("_hi"), F.col("_lo")
    value = F.when(ready & (c > hi), (c - hi) / TICK).when(ready & (c < lo), (lo - c) / TICK)
    return _drop(df.withColumn("orb_breakout", result(value, value.isNotNull(), F.when(ready & (c > hi), "long").when(ready & (c < lo), "short"), or_high=F.when(ready, hi), or_low=F.when(ready, lo))))


@signal("prior_day_bias")
def prior_day_bias(bars: DataFrame, gap_ticks: int = 2, n: int = 5, share: float = 0.6) -> DataFrame:
    """Closes on one side of the vwap of the day before."""
    df = _prior(bars, {"_pv": F.sum(F.col("vwap") * F.col("volume")) / F.sum("volume")})
    gap = F.col("close") - F.col("_pv")
    above = rolling(F.avg, F.when(F.col("_pv").isNotNull(), (gap > 0).cast("double")), n, DAY)
    far = F.abs(gap) >= gap_ticks * TICK
    up, down = far & (gap > 0) & (above >= share), far & (gap < 0) & (1 - above >= share)
    return _drop(df.withColumn("prior_day_bias", result(gap / TICK, up | down, F.when(up, "long").when(down, "short"), share_above=above)))


def _prior(bars: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """Bars with aggregates of the session before."""
    df = with_day(bars)
    days = df.groupBy(*DAY).agg(*[c.alias(n) for n, c in aggregates.items()])
    w = Window.partitionBy(*BY).orderBy("day")
    return df.join(days.select(*DAY, *[F.lag(n).over(w).alias(n) for n in aggregates]), DAY)


@signal("prior_day_levels")
def prior_day_levels(bars: DataFrame, near: float = 1.5) -> DataFrame:
    """Distance to the high and low of the day before; the high is looked at first."""
    df = _prior(bars, {"_h": F.max("high"), "_l": F.min("low"), "_c": F.max_by("close", "ts")})
    dh, dl = F.abs(F.col("close") - F.col("_h")), F.abs(F.col("close") - F.col("_l"))
    return _drop(df.withColumn("prior_day_levels", result(F.least(dh, dl), (dh <= near) | (dl <= near), F.when(dh <= near, "short").when(dl <= near, "long"), pdh=F.col("_h"), pdl=F.col("_l"), pdc=F.col("_c"))))


@signal("relative_volume")
def relative_volume(bars: DataFrame, n: int = 20, high: float = 1.5, low: float = 0.5) -> DataFrame:
    """Volume against the mean of the bars before."""
    w = ordered(BY).rowsBetween(-(n - 1), -1)
    value = F.when(F.count("volume").over(w) >= n - 1, F.try_divide(F.col("volume"), F.avg("volume").over(w)))
    v = F.coalesce(value, F.lit(1.0))
    return bars.withColumn("relative_volume", result(v, v >= high, regime=F.when(v >= high, "high").when(v <= low, "low").otherwise("normal")))


@signal("session_time")
def session_time(bars: DataFrame) -> DataFrame:
    """Eastern minutes since midnight, with seconds as a fraction."""
    return bars.withColumn("session_time", result(second_of_day(eastern(F.col("ts"))) / 60, F.lit(True)))


@signal("sma_trend")
def sma_trend(bars: DataFrame, n: int = 200) -> DataFrame:
    """Percent above the moving average."""
    m = rolling(F.avg, "close", n, BY)
    value = 100 * (F.col("close") - m) / m
    return bars.withColumn("sma_trend", result(value, F.lit(True), F.when(value > 0, "long").when(value < 0, "short"), sma=m))


@signal("spread")
def spread(bars: DataFrame, z: float = 2.0, window: int = 500, least: int = 30) -> DataFrame:
    """Deviation of the quoted spread from its own recent mean; passes when it is not wide."""
    df = bars.withColumn("_s", F.when((F.col("avg_bid") > 0) & (F.col("avg_ask") > 0), F.col("avg_ask") - F.col("avg_bid")))
    m, s = rolling(F.avg, "_s", window, BY, least=least), rolling(F.stddev_samp, "_s", window, BY, least=least)
    value = F.when(s > 1e-10, (F.col("_s") - m) / s).when(s.isNotNull(), 0.0)
    return _drop(df.withColumn("spread", result(value, F.abs(value) <= z, unavailable=value.isNull())))


@signal("stochastic")
def stochastic(bars: DataFrame, n: int = 14, k: int = 3, d: int = 3) -> DataFrame:
    """Smoothed %K and %D; passes on a cross in an outer zone."""
    hi, lo = rolling(F.max, "high", n, BY), rolling(F.min, "low", n, BY)
    df = bars.withColumn("_h", hi).withColumn("_l", lo)
    df = df.withColumn("_r", F.when(F.col("_h") > F.col("_l"), 100 * (F.col("close") - F.col("_l")) / (F.col("_h") - F.col("_l"))).when(F.col("_h").isNotNull(), 50.0))
    df = df.withColumn("_k", rolling(F.avg, "_r", k, BY)).withColumn("_d", rolling(F.avg, "_k", d, BY))
    df = df.withColumn("_pk", F.lag("_k").over(ordered(BY))).withColumn("_pd", F.lag("_d").over(ordered(BY)))
    up = (F.col("_pk") <= F.col("_pd")) & (F.col("_k") > F.col("_d")) & (F.col("_k") < 20)
    down = (F.col("_pk") >= F.col("_pd")) & (F.col("_k") < F.col("_d")) & (F.col("_k") > 80)
    return _drop(df.withColumn("stochastic", result(F.col("_k"), up | down, F.when(up, "long").when(down, "short"), d=F.col("_d"))))


@signal("volume_exhaustion")
def volume_exhaustion(bars: DataFrame, n: int = 20, low: float = 0.4) -> DataFrame:
    """Volume far below its mean; against the side that was aggressive."""
    w = ordered(BY).rowsBetween(-(n - 1), -1)
    v = F.coalesce(F.when(F.count("volume").over(w) >= n - 1, F.try_divide(F.col("volume"), F.avg("volume").over(w))), F.lit(1.0))
    return bars.withColumn("volume_exhaustion", result(v, v < low, F.when(F.col("sell_volume") > F.col("buy_volume"), "long").when(F.col("buy_volume") > F.col("sell_volume"), "short")))


@signal("vwap_bias")
def vwap_bias(bars: DataFrame, n: int = 10, share: float = 0.7) -> DataFrame:
    """Share of closes on one side of the session's vwap; ties are long."""
    df = _session_vwap(bars)
    above = rolling(F.avg, (F.col("close") > F.col("_v")).cast("double"), n, BY)
    below = rolling(F.avg, (F.col("close") < F.col("_v")).cast("double"), n, BY)
    return _drop(df.withColumn("vwap_bias", result(F.greatest(above, below), F.greatest(above, below) >= share, F.when(above >= below, "long").otherwise("short"))))


def _session_vwap(bars: DataFrame) -> DataFrame:
    """_v, the session's vwap so far, from whole ticks."""
    df = with_day(bars)
    return df.withColumn("_v", F.sum(F.col("vwap") * F.col("volume")).over(running(DAY)) / F.sum("volume").over(running(DAY)))


@signal("vwap_deviation")
def vwap_deviation(bars: DataFrame, n: int = 20, z: float = 1.5) -> DataFrame:
    """Distance from the bar's vwap in deviations of that distance."""
    df = bars.withColumn("_d", F.col("close") - F.col("vwap"))
    s = rolling(F.stddev_samp, "_d", n, BY)
    value = F.when(s > 1e-10, F.col("_d") / s)
    return _drop(df.withColumn("vwap_deviation", result(value, F.abs(value) >= z, F.when(value < 0, "long").when(value > 0, "short"))))


@signal("vwap_session")
def vwap_session(bars: DataFrame, n: int = 20, kiss: int = 6, far: float = 1.5, flat: float = 0.003, steep: float = 0.008) -> DataFrame:
    """Session vwap of typical prices, its deviation, slope, mode, first kiss and age."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    v = F.col("volume")
    w = running(DAY)
    df = _number(with_day(bars)).withColumn("_t", typical)
    df = df.withColumn("_v", F.sum(F.col("_t") * v).over(w) / F.sum(v).over(w))
    df = df.withColumn("_var", F.sum(F.col("_t") * F.col("_t") * v).over(w) / F.sum(v).over(w) - F.col("_v") * F.col("_v"))
    df = df.withColumn("_sd", F.sqrt(F.greatest(F.col("_var"), F.lit(0.0)))).withColumn("_age", F.count("*").over(w))
    df = df.withColumn("_dev", F.when(F.col("_sd") > 1e-3, (F.col("close") - F.col("_v")) / F.col("_sd")).otherwise(0.0))
    s = last_n(DAY, n)
    df = df.withColumn("_k", F.when(F.count("_v").over(s) >= 2, F.regr_slope(F.col("_v"), F.col("_i")).over(s)))
    before = ordered(DAY).rowsBetween(-kiss, -1)
    df = df.withColumn("_was", F.max(F.when(F.abs("_dev") >= far, 1).otherwise(0)).over(before)).withColumn("_near", F.max(F.when(F.abs("_dev") < 0.5, 1).otherwise(0)).over(before))
    k = F.abs(F.coalesce("_k", F.lit(0.0)))
    mode = F.when((k < flat), "REVERSION").when(k > steep, "PULLBACK").otherwise("NEUTRAL")
    first = (F.abs("_dev") < 0.5) & (F.col("_was") == 1) & (F.col("_near") == 0)
    return _drop(df.withColumn("vwap_session", result(F.col("_dev"), F.lit(True), F.when(F.round("_dev", 6) < 0, "long").when(F.round("_dev", 6) > 0, "short"), vwap=F.col("_v"), sd=F.col("_sd"), slope=F.coalesce("_k", F.lit(0.0)), mode=mode, first_kiss=F.coalesce(first, F.lit(False)), session_age_bars=F.col("_age"))))


@signal("vwap_slope")
def vwap_slope(bars: DataFrame, n: int = 10, flat: float = 0.01) -> DataFrame:
    """Move of the session's vwap in mean ranges; passes when flat."""
    df = _session_vwap(bars)
    df = df.withColumn("_p", F.lag("_v", n).over(ordered(BY))).withColumn("_r", rolling(F.avg, F.col("high") - F.col("low"), n, BY))
    value = F.when(F.col("_r") > 0, (F.col("_v") - F.col("_p")) / (n * F.col("_r")))
    return _drop(df.withColumn("vwap_slope", result(value, F.abs(value) <= flat, F.when(value > 0, "long").when(value < 0, "short"))))


@signal("vpin")
def vpin(bars: DataFrame, bucket: int = 100, n: int = 50, high: float = 0.55, low: float = 0.38) -> DataFrame:
    """Mean imbalance of the last full buckets of equal volume.

    A bar's volume lies on the running total like a ruler; it is dealt to the buckets
    it covers in proportion, so nothing is sequential but a running sum.
    """
    span = F.col("high") - F.col("low")
    buy = F.when(span > 0, (F.col("close") - F.col("low")) / span).otherwise(0.5)
    total = F.sum("volume").over(running(BY))
    df = bars.withColumn("_e", total).withColumn("_b", F.col("_e") - F.col("volume")).withColumn("_buy", buy)
    first, last = F.floor(F.col("_b") / bucket), F.floor((F.col("_e") - 1) / bucket)
    part = df.where("volume > 0").select(*BY, "ts", "_b", "_e", "_buy", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("k"))
    got = F.least(F.col("_e"), (F.col("k") + 1) * bucket) - F.greatest(F.col("_b"), F.col("k") * bucket)
    filled = part.withColumn("_v", got).groupBy(*BY, "k").agg(F.sum(F.col("_v") * (2 * F.col("_buy") - 1)).alias("d"), F.sum("_v").alias("v"), F.max("ts").alias("ts")).where(F.col("v") == bucket)
    w = Window.partitionBy(*BY).orderBy("k").rowsBetween(-(n - 1), 0)
    rolled = filled.withColumn("vpin", F.avg(F.abs("d") / bucket).over(w)).groupBy(*BY, "ts").agg(F.max_by("vpin", "k").alias("_x"))
    df = bars.join(rolled, [*BY, "ts"], "left").withColumn("_x", F.last("_x", ignorenulls=True).over(running(BY)))
    x = F.col("_x")
    return _drop(df.withColumn("vpin", result(x, x > high, regime=F.when(x > high, "trending").when(x < low, "mean_reversion").otherwise("neutral"))))


@signal("poc_distance")
def poc_distance(bars: DataFrame, n: int = 30, near_ticks: int = 4) -> DataFrame:
    """Ticks from the price of most volume in the last bars (ties: the price seen first)."""
    w = last_n(BY, n)
    df = bars.withColumn("_a", F.collect_list(F.struct((F.bround(F.col("close") / TICK) * TICK).alias("p"), F.col("volume").alias("v"))).over(w))
    levels = F.array_distinct(F.transform("_a", lambda x: x["p"]))
    volume = lambda p: F.aggregate(F.filter("_a", lambda x: x["p"] == p), F.lit(0).cast("long"), lambda s, x: s + x["v"])
    ranked = F.transform(levels, lambda p, i: F.struct(volume(p).alias("v"), (-i).alias("i"), p.alias("p")))
    df = df.withColumn("_poc", F.array_max(ranked)["p"])
    value = (F.col("close") - F.col("_poc")) / TICK
    return _drop(df.withColumn("poc_distance", result(value, F.abs(value) >= near_ticks, F.when(value < 0, "long").when(value > 0, "short"), poc=F.col("_poc"))))


def minutes_since_midnight(bars: DataFrame) -> Column:
    return minute_of_day(eastern(F.col("ts")))
