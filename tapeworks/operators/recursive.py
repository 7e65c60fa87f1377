"""Signals that are recursions: each runs a kernel over one symbol's bars, in order.

A symbol's bars are the unit of work.  The kernels need the whole series only as
arrays of floats (a century of minutes is under 100 MB), and symbols run apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions import regimes as M
from ..functions.windows import last_n, ordered, percent_rank_below, rolling
from .signals import BY, TICK, _drop, _session_open, result, signal, with_day


def series(bars: DataFrame, columns: list[str], out: list[str], f: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], by: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Bars with the columns that ``f`` makes of each key's ordered columns (NaN becomes null).

    All other columns pass through as Arrow arrays, so there is no join back and the
    plan below is used once however many recursions are stacked.
    """
    keep = [c for c in bars.columns if c not in out]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table[ts]))
        made = f({c: pc.cast(table[c], pa.float64()).to_numpy().astype(float) for c in columns})
        for c in out:
            table = table.append_column(c, pa.array(np.asarray(made[c], float), pa.float64(), from_pandas=True))
        return table

    schema = T.StructType([*[bars.schema[c] for c in keep], *[T.StructField(c, T.DoubleType()) for c in out]])
    return bars.select(*keep).groupBy(*by).applyInArrow(run, schema)


def ema(bars: DataFrame, column: str, span: int, out: str, seed: str = "first") -> DataFrame:
    return series(bars, [column], [out], lambda a: {out: K.ema(a[column], span, seed)})


def atr_column(bars: DataFrame, n: int = 14, out: str = "_atr", seed: str = "grow") -> DataFrame:
    return series(bars, ["high", "low", "close"], [out], lambda a: {out: K.wilder(K.true_range(a["high"], a["low"], a["close"]), n, seed)})


@signal("atr")
def atr(bars: DataFrame, n: int = 14, lookback: int = 100, gap_aware: bool = True) -> DataFrame:
    """Average true range in ticks, with its percentile and regime; always passes.

    gap_aware: a bar more than three times the median interval of the first fifty bars
    after the one before it (ten minutes where there are two at most) has its own range only.
    """

    def f(a: dict) -> dict:
        tr = K.true_range(a["high"], a["low"], a["close"])
        if gap_aware and len(tr) > 1:
            apart = np.diff(a["_us"])
            limit = np.floor(np.median(apart[:49]) * 3) if len(tr) > 2 else 6e8
            tr[1:] = np.where(apart > limit, a["high"][1:] - a["low"][1:], tr[1:])
        return {"_atr": K.wilder(tr, n, "grow")}

    df = series(bars.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))), ["high", "low", "close", "_us"], ["_atr"], f)
    df = df.withColumn("_r", F.coalesce(percent_rank_below("_atr", lookback, BY), F.lit(50.0)))
    regime = F.when(F.col("_r") < 25, "LOW").when(F.col("_r") > 75, "HIGH").otherwise("NORMAL")
    return _drop(df.withColumn("atr", result(F.col("_atr") / TICK, F.lit(True), atr_raw=F.col("_atr"), atr_percentile=F.col("_r"), vol_regime=regime)))


@signal("adx")
def adx(bars: DataFrame, n: int = 14, least: float = 25.0) -> DataFrame:
    """Directional index; direction by the larger directional indicator."""

    def f(a: dict) -> dict:
        x, p, m = K.adx(a["high"], a["low"], a["close"], n)
        return {"_x": x, "_p": p, "_m": m}

    df = series(bars, ["high", "low", "close"], ["_x", "_p", "_m"], f)
    return _drop(df.withColumn("adx", result(F.col("_x"), F.col("_x") >= least, F.when(F.col("_p") > F.col("_m"), "long").when(F.col("_m") > F.col("_p"), "short"), plus_di=F.col("_p"), minus_di=F.col("_m"))))


@signal("ema_crossover")
def ema_crossover(bars: DataFrame, fast: int = 8, slow: int = 21) -> DataFrame:
    """Passes where the difference of two means changes sign; else direction tells their order."""
    df = series(bars, ["close"], ["_f", "_s"], lambda a: {"_f": K.ema(a["close"], fast), "_s": K.ema(a["close"], slow)})
    df = df.withColumn("_d", F.col("_f") - F.col("_s")).withColumn("_b", F.lag("_d").over(ordered(BY)))
    up, down = (F.col("_b") <= 0) & (F.col("_d") > 0), (F.col("_b") >= 0) & (F.col("_d") < 0)
    return _drop(df.withColumn("ema_crossover", result(F.col("_d"), up | down, F.when(F.col("_d") > 0, "long").when(F.col("_d") < 0, "short"), fast=F.col("_f"), slow=F.col("_s"), crossed=F.coalesce(up | down, F.lit(False)))))


RIBBON = (8, 13, 21, 34, 55)


@signal("ema_ribbon")
def ema_ribbon(bars: DataFrame, n: int = 14, reach: float = 1.0) -> DataFrame:
    """Five means in strict order, with price near the fastest two."""
    cols = [f"_e{s}" for s in RIBBON]

    def f(a: dict) -> dict:
        return {f"_e{s}": K.ema(a["close"], s) for s in RIBBON} | {"_atr": K.wilder(K.true_range(a["high"], a["low"], a["close"]), n)}

    df = series(bars, ["high", "low", "close"], [*cols, "_atr"], f)
    e = [F.col(c) for c in cols]
    up = (e[0] > e[1]) & (e[1] > e[2]) & (e[2] > e[3]) & (e[3] > e[4])
    down = (e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3]) & (e[3] < e[4])
    near = F.least(F.abs(F.col("close") - e[0]), F.abs(F.col("close") - e[1])) <= reach * F.col("_atr")
    return _drop(df.withColumn("ema_ribbon", result(e[0] - e[4], (up | down) & near, F.when(up, "long").when(down, "short"), is_fanned=(up | down).cast("double"), **{f"ema_{s}": F.col(f"_e{s}") for s in RIBBON})))


@signal("keltner_channel")
def keltner_channel(bars: DataFrame, n: int = 20, atr_n: int = 20, k: float = 1.5) -> DataFrame:
    """Mean with bands of average true ranges (seeded with a simple mean); always passes."""

    def f(a: dict) -> dict:
        tr = K.true_range(a["high"], a["low"], a["close"])
        return {"_m": K.ema(a["close"], n), "_a": np.r_[np.nan, K.wilder(tr[1:], atr_n, "sma")][: len(tr)]}

    df = series(bars, ["high", "low", "close"], ["_m", "_a"], f)
    m, a, c = F.col("_m"), F.col("_a"), F.col("close")
    return _drop(df.withColumn("keltner_channel", result(F.when(a > 0, (c - m) / a), F.lit(True), F.when(c > m + k * a, "long").when(c < m - k * a, "short"), upper=m + k * a, mid=m, lower=m - k * a)))


@signal("macd")
def macd(bars: DataFrame, fast: int = 12, slow: int = 26, smooth: int = 9, near: float = 0.5, lookback: int = 3) -> DataFrame:
    """Histogram; passes where the line came near zero and turned away again."""

    def f(a: dict) -> dict:
        line = K.ema(a["close"], fast, "sma") - K.ema(a["close"], slow, "sma")
        sig = np.full(len(line), np.nan)
        if len(line) >= slow:
            sig[slow - 1 :] = K.ema(line[slow - 1 :], smooth, "sma")
        return {"_l": line, "_s": sig}

    df = series(bars, ["close"], ["_l", "_s"], f)
    before = ordered(BY).rowsBetween(-lookback, -1)
    df = df.withColumn("_h", F.col("_l") - F.col("_s")).withColumn("_lo", F.min(F.abs("_l")).over(before)).withColumn("_p", F.lag("_l").over(ordered(BY)))
    up = (F.col("_lo") <= near) & (F.col("_l") > 0) & (F.col("_l") > F.col("_p")) & (F.col("_h") > 0)
    down = (F.col("_lo") <= near) & (F.col("_l") < 0) & (F.col("_l") < F.col("_p")) & (F.col("_h") < 0)
    return _drop(df.withColumn("macd", result(F.col("_h"), up | down, F.when(up, "long").when(down, "short"), line=F.col("_l"), signal=F.col("_s"), histogram=F.col("_h"))))


@signal("orb_range_size")
def orb_range_size(bars: DataFrame, minutes: int = 15, n: int = 14, low: float = 0.3, high: float = 1.5) -> DataFrame:
    """Opening range in average true ranges."""
    df = atr_column(_session_open(bars), n)
    w = Window.partitionBy("symbol", "day")
    inside = F.col("_m") <= F.col("_open") + minutes
    span = F.max(F.when(inside, F.col("high"))).over(w) - F.min(F.when(inside, F.col("low"))).over(w)
    value = F.when(~inside & (F.col("_atr") > 0), span / F.col("_atr"))
    return _drop(df.withColumn("orb_range_size", result(value, value.between(low, high), range=F.when(~inside, span))))


@signal("rsi_momentum")
def rsi_momentum(bars: DataFrame, n: int = 14, long: float = 50.0, short: float = 50.0) -> DataFrame:
    """Relative strength; long above, short below."""
    df = series(bars, ["close"], ["_r"], lambda a: {"_r": K.rsi(a["close"], n)})
    r = F.col("_r")
    return _drop(df.withColumn("rsi_momentum", result(r, (r > long) | (r < short), F.when(r > long, "long").when(r < short, "short"))))


@signal("value_area")
def value_area(bars: DataFrame, near: float = 2.0) -> DataFrame:
    """Distance to the value area of the session before."""
    from .profile import daily_value_areas, tpo_profile

    df = with_day(bars)
    areas = daily_value_areas(tpo_profile(df), tie="up")
    w = Window.partitionBy("symbol").orderBy("day")
    prior = areas.select("symbol", "day", *[F.lag(c).over(w).alias(f"_{c}") for c in ("poc", "vah", "val")])
    df = df.join(prior, ["symbol", "day"], "left")
    dh, dl, c = F.abs(F.col("close") - F.col("_vah")), F.abs(F.col("close") - F.col("_val")), F.col("close")
    hi, lo = dh <= near, dl <= near
    direction = F.when(hi & lo, F.when(c < F.col("_poc"), "long").otherwise("short")).when(hi, "short").when(lo, "long")
    return _drop(df.withColumn("value_area", result(F.least(dh, dl), hi | lo, direction, vah=F.col("_vah"), val=F.col("_val"), poc=F.col("_poc"))))


@signal("hmm_regime")
def hmm_regime(bars: DataFrame, states: int = 3, rounds: int = 10, fit_bars: int = 200) -> DataFrame:
    """State of a hidden Markov model of return and range, fitted and scaled on a symbol's first bars and filtered forward after them.

    Passes outside the wildest state; null, and passing, before the model is there.
    """

    def f(a: dict) -> dict:
        c = np.maximum(a["close"], 1e-9)
        x = np.column_stack([np.r_[0.0, np.diff(np.log(c))], np.log1p((a["high"] - a["low"]) / c)])
        out = {"_s": np.full(len(x), np.nan), "_p": np.full(len(x), np.nan)}
        if len(x) <= fit_bars:
            return out
        x = (x - x[:fit_bars].mean(0)) / (x[:fit_bars].std(0) + 1e-9)
        seen = x[:fit_bars]
        order = np.argsort(seen[:, 1], kind="stable")
        mu, var, start, move = K.fit_hmm(seen, np.array([seen[part].mean(0) for part in np.array_split(order, states)]), rounds)
        p = K.forward(K.gaussian_log_like(x, mu, var), start, move)[fit_bars:]
        rank = np.argsort(np.argsort(mu[:, 1]))
        out["_s"][fit_bars:], out["_p"][fit_bars:] = rank[p.argmax(1)].astype(float), p.max(1)
        return out

    df = series(bars, ["high", "low", "close"], ["_s", "_p"], f)
    return _drop(df.withColumn("hmm_regime", result(F.col("_s"), F.coalesce(F.col("_s") < states - 1, F.lit(True)), confidence=F.col("_p"))))


@signal("regime_v2")
def regime_v2(bars: DataFrame, fit_rows: int = 100, cfg: M.Config | None = None) -> DataFrame:
    """Regime in force at the bar before, its probabilities, position size and halt; passes unless halted or flat."""
    cfg = cfg or M.Config().small()
    made = [f"_{c}" for c in M.OUT]
    df = series(bars, ["open", "high", "low", "close", "volume"], made, lambda a: dict(zip(made, M.detected(a, cfg, fit_rows).T, strict=True)))
    warm = {"_regime": float(M.RANGING), "_halt": 1.0}
    df = df.withColumns({c: F.coalesce(F.lag(c).over(ordered(BY)), F.lit(warm.get(c, 0.0))) for c in made})
    size = F.when(F.col("_size") == 1.0, "full").when(F.col("_size") == 0.5, "half").otherwise("flat")
    p = {c[1:]: F.col(c) for c in ("_p_trending", "_p_ranging", "_p_highvol")}
    return _drop(df.withColumn("regime_v2", result(F.col("_regime"), (F.col("_halt") == 0) & (F.col("_size") > 0), confidence=F.col("_confidence"), **p, position_size=size, whipsaw_halt=F.col("_halt") > 0)))


def regime_features(bars: DataFrame, span: int = 50, z: int = 500, limit: float = 3.0) -> DataFrame:
    """Rolling volatility, order-flow imbalance and lag-1 autocorrelation, as clipped z-scores."""
    from ..functions.windows import zscore

    o = ordered(BY)
    df = bars.withColumn("_r", F.ln("close") - F.ln(F.lag("close").over(o))).withColumn("_b", F.lag("_r").over(o))
    bought = F.when(F.col("close") > F.col("open"), F.col("volume")).otherwise(0)
    sold = F.when(F.col("close") <= F.col("open"), F.col("volume")).otherwise(0)
    w = last_n(BY, span)
    df = df.withColumn("vol", rolling(F.stddev_samp, "_r", span, BY)).withColumn("ofi", F.abs(F.sum(bought).over(w) - F.sum(sold).over(w)) / F.greatest(F.sum("volume").over(w), F.lit(1)))
    w30 = last_n(BY, 30)
    df = df.withColumn("autocorr", F.when(F.count("_b").over(w30) >= 30, F.corr("_r", "_b").over(w30)))
    for c in ("vol", "ofi", "autocorr"):
        df = df.withColumn(f"{c}_z", zscore(c, z, BY, limit=limit))
    return _drop(df)


def column(name: str, field: str = "value") -> Column:
    return F.col(f"{name}.{field}")
