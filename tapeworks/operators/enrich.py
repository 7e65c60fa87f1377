"""Signals as flat ``sig_*`` columns, computed for all bars at once.

These are the columns that stored, enriched bars carry.  They differ from the signal
structs of the same names in a few published ways: no gap rule in the range, the
directional means grow into their windows, clock minutes without seconds, the spread
against all that came before.  ``structs`` turns them back into signal structs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import regimes as M
from ..functions.timeutil import eastern, minute_of_day
from ..functions.windows import last_n, ordered, running
from .recursive import series
from .signals import BY, DAY, TICK, _number, result, with_day

ENRICH: dict[str, Callable[..., DataFrame]] = {}


def _enrich(name: str):
    def add(f):
        ENRICH[name] = f
        return f

    return add


def enrich(bars: DataFrame, names: list[str], **configs: dict) -> DataFrame:
    """Bars with the flat columns of each named signal; an unknown name is an error."""
    if unknown := [n for n in names if n not in ENRICH]:
        raise ValueError(f"no flat columns for: {', '.join(unknown)}")
    for n in names:
        bars = ENRICH[n](bars, **configs.get(n, {}))
    return bars


def _clean(df: DataFrame, bars: DataFrame) -> DataFrame:
    return df.select(*bars.columns, *[c for c in df.columns if c.startswith("sig_") and c not in bars.columns])


@_enrich("atr")
def flat_atr(bars: DataFrame, n: int = 14, lookback: int = 100) -> DataFrame:
    df = series(bars, ["high", "low", "close"], ["sig_atr_raw"], lambda a: {"sig_atr_raw": K.wilder(K.true_range(a["high"], a["low"], a["close"]), n, "grow")})
    seen = F.collect_list("sig_atr_raw").over(last_n(BY, lookback))
    df = df.withColumn("sig_atr_percentile", F.when(F.row_number().over(ordered(BY)) == 1, 50.0).otherwise(100.0 * F.size(F.filter(seen, lambda x: x < F.element_at(seen, -1))) / F.size(seen)))
    share = F.col("sig_atr_percentile")
    return _clean(df.withColumns({"sig_atr_value": F.col("sig_atr_raw") / TICK, "sig_atr_vol_regime": F.when(share < 25, "LOW").when(share > 75, "HIGH").otherwise("NORMAL")}), bars)


@_enrich("vwap_session")
def flat_vwap(bars: DataFrame, n: int = 20, kiss: int = 6, far: float = 1.5, flat: float = 0.003, steep: float = 0.008) -> DataFrame:
    w, v = running(DAY), F.col("volume")
    df = _number(with_day(bars)).withColumn("_t", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumn("sig_vwap_vwap", F.sum(F.col("_t") * v).over(w) / F.sum(v).over(w)).withColumn("sig_vwap_session_age", F.count("*").over(w))
    df = df.withColumn("sig_vwap_sd", F.sqrt(F.greatest(F.sum(F.col("_t") * F.col("_t") * v).over(w) / F.sum(v).over(w) - F.col("sig_vwap_vwap") ** 2, F.lit(0.0))))
    wide = F.col("sig_vwap_sd") > 1e-3  # below, only what rounding leaves
    df = df.withColumn("sig_vwap_value", F.when(wide, (F.col("close") - F.col("sig_vwap_vwap")) / F.col("sig_vwap_sd")).otherwise(0.0))
    dev, last = F.col("sig_vwap_value"), last_n(DAY, n)
    df = df.withColumn("sig_vwap_slope", F.coalesce(F.when(F.count("*").over(last) >= 2, F.regr_slope("sig_vwap_vwap", "_i").over(last)), F.lit(0.0)))
    was = F.max(F.abs("sig_vwap_value")).over(ordered(DAY).rowsBetween(-kiss, -1)) >= far
    k = F.abs("sig_vwap_slope")
    return _clean(df.withColumns({"sig_vwap_direction": F.when(wide & (F.abs(dev) >= 1.0), F.when(dev < 0, "long").otherwise("short")).otherwise("none"), "sig_vwap_first_kiss": F.coalesce(wide & (F.abs(dev) < 0.5) & was, F.lit(False)), "sig_vwap_mode": F.when(k < flat, "REVERSION").when(k > steep, "PULLBACK").otherwise("NEUTRAL")}), bars)


@_enrich("relative_volume")
def flat_relative_volume(bars: DataFrame, n: int = 20, high: float = 1.5) -> DataFrame:
    o = ordered(BY)
    mean, late = F.avg("volume").over(o.rowsBetween(-(n - 1), -1)), F.row_number().over(o) > n
    df = bars.withColumn("sig_rvol_value", F.when(late & (mean > 1e-9), F.col("volume") / mean).otherwise(1.0))
    return df.withColumn("sig_rvol_passes", F.coalesce(late & (mean > 1e-9) & (F.col("sig_rvol_value") >= high), F.lit(False)))


@_enrich("spread")
def flat_spread(bars: DataFrame, z: float = 2.0, least: int = 30) -> DataFrame:
    """Without quotes the signal is unavailable and blocks."""
    if "avg_bid" not in bars.columns or "avg_ask" not in bars.columns:
        return bars.withColumns({"sig_spread_value": F.lit(0.0), "sig_spread_passes": F.lit(False), "sig_spread_unavailable": F.lit(True)})
    w = running(BY)
    df = bars.withColumn("_s", F.when(F.col("avg_ask") > F.col("avg_bid"), F.col("avg_ask") - F.col("avg_bid")))
    sd = F.stddev_samp("_s").over(w)
    ready = (F.count("_s").over(w) >= least) & (sd > 1e-12)
    df = df.withColumn("sig_spread_value", F.when(ready, (F.last("_s", ignorenulls=True).over(w) - F.avg("_s").over(w)) / sd).otherwise(0.0))
    return _clean(df.withColumn("sig_spread_passes", F.abs("sig_spread_value") < z), bars)


@_enrich("adx")
def flat_adx(bars: DataFrame, n: int = 14, least: float = 25.0) -> DataFrame:
    def f(a: dict) -> dict:
        zero = np.zeros(len(a["close"]))
        if len(zero) < 2:
            return {"sig_adx_value": zero, "sig_adx_plus_di": zero, "sig_adx_minus_di": zero}
        up, down = np.diff(a["high"]), -np.diff(a["low"])
        tr = K.wilder(K.true_range(a["high"], a["low"], a["close"])[1:], n, "grow")
        p, m = (100 * np.divide(K.wilder(np.where((x > y) & (x > 0), x, 0.0), n, "grow"), tr, out=np.zeros(len(tr)), where=tr > 0) for x, y in ((up, down), (down, up)))
        dx = 100 * np.divide(np.abs(p - m), p + m, out=np.zeros(len(tr)), where=p + m > 0)
        return {"sig_adx_value": np.r_[0.0, K.wilder(dx, n, "grow")], "sig_adx_plus_di": np.r_[0.0, p], "sig_adx_minus_di": np.r_[0.0, m]}

    df = series(bars, ["high", "low", "close"], ["sig_adx_value", "sig_adx_plus_di", "sig_adx_minus_di"], f)
    p, m = F.col("sig_adx_plus_di"), F.col("sig_adx_minus_di")
    return df.withColumns({"sig_adx_passes": F.col("sig_adx_value") >= least, "sig_adx_direction": F.when(p > m, "long").when(m > p, "short").otherwise("none")})


@_enrich("donchian_channel")
def flat_donchian(bars: DataFrame, n: int = 20, exit_n: int = 10) -> DataFrame:
    o = ordered(BY)
    ready = F.row_number().over(o) > max(n, exit_n) + 1
    level = lambda f, c, k: F.when(ready, f(c).over(o.rowsBetween(-k, -1)))
    df = bars.withColumns({"sig_dc_entry_upper": level(F.max, "high", n), "sig_dc_entry_lower": level(F.min, "low", n), "sig_dc_exit_upper": level(F.max, "high", exit_n), "sig_dc_exit_lower": level(F.min, "low", exit_n)})
    up, down = F.col("close") > F.col("sig_dc_entry_upper"), F.col("close") < F.col("sig_dc_entry_lower")
    return df.withColumns({"sig_dc_value": F.coalesce(F.col("sig_dc_entry_upper") - F.col("sig_dc_entry_lower"), F.lit(0.0)), "sig_dc_passes": F.coalesce(up | down, F.lit(False)), "sig_dc_direction": F.when(up, "long").when(down, "short").otherwise("none")})


@_enrich("session_time")
def flat_session_time(bars: DataFrame) -> DataFrame:
    return bars.withColumn("sig_session_time_value", minute_of_day(eastern(F.col("ts"))).cast("double"))


@_enrich("regime_v2")
def flat_regime(bars: DataFrame, fit_rows: int = 100, cfg: M.Config | None = None) -> DataFrame:
    """Filtered forward; until the model is there: ranging, no confidence, flat, halted."""
    cfg, made = cfg or M.Config().small(), [f"_{c}" for c in M.OUT]
    df = series(bars, ["open", "high", "low", "close", "volume"], made, lambda a: dict(zip(made, M.detected(a, cfg, fit_rows).T, strict=True)))
    p = {"sig_regime_v2_p_trending": "_p_trending", "sig_regime_v2_p_ranging": "_p_ranging", "sig_regime_v2_p_high_vol": "_p_highvol", "sig_regime_v2_confidence": "_confidence"}
    df = df.withColumns({k: F.col(c) for k, c in p.items()} | {"sig_regime_v2_value": F.col("_regime").cast("int"), "sig_regime_v2_position_size": F.when(F.col("_size") == 1, "full").when(F.col("_size") == 0.5, "half").otherwise("flat"), "sig_regime_v2_whipsaw_halt": F.col("_halt") > 0})
    return _clean(df, bars)


#: For each signal, the prefix of its flat columns and the columns that its struct carries beside the value.
PREFIX: dict[str, tuple[str, dict[str, str]]] = {
    "atr": ("sig_atr", {"atr_raw": "raw", "vol_regime": "vol_regime", "atr_percentile": "percentile"}),
    "vwap_session": ("sig_vwap", {"vwap": "vwap", "sd": "sd", "slope": "slope", "mode": "mode", "first_kiss": "first_kiss", "session_age_bars": "session_age"}),
    "relative_volume": ("sig_rvol", {}),
    "spread": ("sig_spread", {}),
    "adx": ("sig_adx", {"plus_di": "plus_di", "minus_di": "minus_di"}),
    "donchian_channel": ("sig_dc", {"upper": "entry_upper", "lower": "entry_lower", "exit_upper": "exit_upper", "exit_lower": "exit_lower"}),
    "session_time": ("sig_session_time", {}),
    "regime_v2": ("sig_regime_v2", {"confidence": "confidence", "position_size": "position_size", "p_trending": "p_trending", "p_ranging": "p_ranging", "p_high_vol": "p_high_vol"}),
}


def structs(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with a signal struct for each name whose flat columns are there; names without them are left out."""

    def one(name: str) -> Column:
        prefix, meta = PREFIX[name]
        col = lambda c: F.col(f"{prefix}_{c}")
        passes = col("passes") if f"{prefix}_passes" in df.columns else F.lit(True)
        if name == "regime_v2":
            passes = ~col("whipsaw_halt") & (col("position_size") != "flat")
        return result(col("value").cast("double"), passes, col("direction") if f"{prefix}_direction" in df.columns else "none", **{k: col(c) for k, c in meta.items()})

    return df.withColumns({n: one(n) for n in names if n in PREFIX and f"{PREFIX[n][0]}_value" in df.columns})
