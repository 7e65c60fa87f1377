"""Entry rules of the strategies as columns over enriched bars.

A strategy names its signals, filter rules, direction (a column of 1, -1, 0), target
and stop, exits, and a cap of signals a session.  States that last over bars (a
squeeze, an opening drive) are runs and session aggregates, so nothing is a loop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import compile_rules, parse_rule
from ..functions.timeutil import eastern, second_of_day
from ..functions.windows import ordered, running
from .exits import needed_signals
from .signals import BY, DAY, TICK, compute, with_day

Directions = Callable[[DataFrame], tuple[DataFrame, Column, Column, Column]]


@dataclass
class Strategy:
    name: str
    signals: list[str]
    entry: Directions  # bars -> (bars, side, target, stop)
    filters: list[tuple[str, str]] = field(default_factory=list)
    exits: list[dict] | None = None
    cap: int = 3
    per_direction: bool = False
    configs: dict[str, dict] = field(default_factory=dict)


REGISTRY: dict[str, Strategy] = {}


def _add(*args, **kw) -> None:
    s = Strategy(*args, **kw)
    REGISTRY[s.name] = s


def v(signal: str, name: str = "value") -> Column:
    return F.col(f"{signal}.{name}")


def passes(signal: str) -> Column:
    return F.coalesce(v(signal, "passes"), F.lit(False))


def way(signal: str) -> Column:
    d = v(signal, "direction")
    return F.when(d == "long", 1).when(d == "short", -1).otherwise(0)


def side(long: Column, short: Column) -> Column:
    return F.when(F.coalesce(long, F.lit(False)), 1).when(F.coalesce(short, F.lit(False)), -1).otherwise(0)


def _atr() -> Column:
    return v("atr", "atr_raw")


def _close() -> Column:
    return F.col("close")



def _atr_bracket(s: Column, target: float, stop: float) -> tuple[Column, Column]:
    return _close() + s * target * _atr(), _close() - s * stop * _atr()


def _by_atr(direction: Callable[[], Column], target: float, stop: float) -> Directions:
    def entry(df: DataFrame):
        s = direction()
        return df, s, *_atr_bracket(s, target, stop)

    return entry


_BRACKET = [{"type": "bracket_target"}, {"type": "bracket_stop"}]


def _timed(n: int, *more: dict) -> list[dict]:
    return [*_BRACKET, {"type": "time_stop", "max_bars": n}, *more]


def _vwap_band(df: DataFrame):
    s = side(v("vwap_session") <= -2.5, v("vwap_session") >= 2.5)
    far = F.when(s > 0, F.least(_close() - 1.0 * _atr(), F.col("low") - TICK)).otherwise(F.greatest(_close() + 1.0 * _atr(), F.col("high") + TICK))
    return df, s, v("vwap_session", "vwap"), far


_add("vwap_band_reversion", ["vwap_session", "adx", "atr", "relative_volume", "session_time"], _vwap_band, [("adx", "< 18.0"), ("relative_volume", ">= 0.3")], [{"type": "static_stop", "atr_multiple": 3.0}, {"type": "vwap_reversion_target", "target_sd_band": 1.0}, {"type": "time_stop", "max_bars": 12}])
_add("stoch_bb_fade", ["stochastic", "bollinger", "adx", "vwap_session", "relative_volume", "atr"], _by_atr(lambda: side((way("stochastic") > 0) & (_close() < v("bollinger", "lower")), (way("stochastic") < 0) & (_close() > v("bollinger", "upper"))), 1.5, 1.0), [("stochastic", "passes"), ("adx", "< 25.0"), ("relative_volume", ">= 0.5")], _timed(4, {"type": "adverse_momentum", "atr_multiple": 1.0, "max_bars": 2}, {"type": "signal_bound_exit", "signal": "adx", "upper_bound": 30.0}))
_add("macd_zero_line", ["macd", "sma_trend", "vwap_bias", "adx", "relative_volume", "atr"], _by_atr(lambda: F.when((way("macd") == way("sma_trend")) & (way("macd") == way("vwap_bias")), way("macd")).otherwise(0), 2.0, 1.0), [("adx", "> 20.0"), ("relative_volume", ">= 0.8"), ("macd", "passes")], _timed(9, {"type": "adverse_signal_exit", "signal": "macd", "field": "histogram"}, {"type": "adverse_momentum", "atr_multiple": 1.0, "max_bars": 3}))
_add("cvd_divergence", ["cvd_divergence", "volume_exhaustion", "adx", "vwap_bias", "spread", "atr"], _by_atr(lambda: F.when(way("cvd_divergence") == way("vwap_bias"), way("cvd_divergence")).otherwise(0), 1.5, 1.0), [("cvd_divergence", "passes"), ("adx", ">= 15.0"), ("adx", "<= 35.0"), ("spread", "<= 0.50")], _timed(10, {"type": "adverse_momentum", "atr_multiple": 1.0, "max_bars": 2}))


def _midline(df: DataFrame):
    up, lo = v("donchian_channel", "upper"), v("donchian_channel", "lower")
    wide = v("donchian_channel") >= 1.5 * _atr()
    at = v("donchian_channel", "at_midline") & wide
    s = side(at & (way("ema_crossover") > 0), at & (way("ema_crossover") < 0))
    return df, s, F.when(s > 0, up).otherwise(lo), F.when(s > 0, lo - 2 * TICK).otherwise(up + 2 * TICK)


_add("donchian_midline", ["donchian_channel", "adx", "ema_crossover", "atr", "relative_volume"], _midline, [("adx", ">= 22.0"), ("relative_volume", ">= 1.0")], _timed(30, {"type": "trailing_stop", "atr_multiple": 1.25, "activate_after_atr": 0.75}, {"type": "signal_bound_exit", "signal": "adx", "lower_bound": 18.0}))


def _after_run(df: DataFrame, flag: Column, least: int) -> tuple[DataFrame, Column]:
    """True on a row without the flag whose last ``least`` rows all had it."""
    w = ordered(BY).rowsBetween(-least, -1)
    run = (F.sum(flag.cast("int")).over(w) == least) & ~flag
    return df.withColumn("_run", F.coalesce(run, F.lit(False))), F.col("_run")


def _squeeze(df: DataFrame):
    tight = F.coalesce(v("donchian_channel", "width_percentile") <= 10.0, F.lit(False))
    df, out = _after_run(df, tight, 5)
    s = F.when(out & passes("donchian_channel") & (v("relative_volume") >= 2.0) & (F.signum(v("macd")) == way("donchian_channel")), way("donchian_channel")).otherwise(0)
    return df, s, *_atr_bracket(s, 5.0, 2.5)


_add("donchian_squeeze", ["donchian_channel", "relative_volume", "macd", "bollinger", "atr"], _squeeze, [], _timed(40, {"type": "trailing_stop", "atr_multiple": 2.0, "activate_after_atr": 2.0}))
_add("donchian_breakout_trend", ["donchian_channel", "adx", "relative_volume", "atr", "vwap_bias", "ema_crossover"], _by_atr(lambda: F.when(v("donchian_channel").between(2, 30) & (way("donchian_channel") == way("vwap_bias")), way("donchian_channel")).otherwise(0), 3.5, 1.75), [("donchian_channel", "passes"), ("adx", ">= 22.0"), ("relative_volume", ">= 1.5")], _timed(30, {"type": "price_vs_signal_exit", "signal": "donchian_channel", "long_field": "exit_lower", "short_field": "exit_upper"}))


def _fade(df: DataFrame):
    s = side((F.col("low") <= v("donchian_channel", "lower")) & (v("rsi_momentum") < 30), (F.col("high") >= v("donchian_channel", "upper")) & (v("rsi_momentum") > 70))
    vwap = v("vwap_session", "vwap")
    return df, s, F.when(s * (vwap - _close()) > 0, vwap).otherwise(_close() + s * 1.5 * _atr()), _close() - s * 1.25 * _atr()


_add("donchian_fade", ["donchian_channel", "adx", "rsi_momentum", "stochastic", "atr", "vwap_session", "relative_volume"], _fade, [("adx", "< 20.0")], _timed(20))
_add("mfi_obv_divergence", ["mfi", "obv", "adx", "atr", "relative_volume"], _by_atr(lambda: side((v("mfi") < 20) & (v("obv") > 0), (v("mfi") > 80) & (v("obv") < 0)), 1.5, 1.0), [("mfi", "passes"), ("relative_volume", ">= 0.7"), ("adx", "< 30.0")], _timed(3, {"type": "adverse_momentum", "atr_multiple": 1.0, "max_bars": 2}))


def _pullback(df: DataFrame):
    fast, crossed = v("ema_crossover", "fast"), v("ema_crossover", "crossed")
    up = (way("ema_crossover") > 0) & ~crossed & (F.col("low") <= fast + 0.5) & (_close() > F.col("open")) & (way("sma_trend") >= 0)
    down = (way("ema_crossover") < 0) & ~crossed & (F.col("high") >= fast - 0.5) & (_close() < F.col("open")) & (way("sma_trend") <= 0)
    s = side(up, down)
    return df, s, *_atr_bracket(s, 1.5, 1.0)


_add("micro_pullback", ["ema_crossover", "sma_trend", "adx", "atr", "relative_volume"], _pullback, [("adx", "> 25.0"), ("relative_volume", ">= 1.0")], _timed(5, {"type": "adverse_momentum", "threshold_points": 1.0}))


def _area_reversion(df: DataFrame, least: float = 5.0, calm: float = 20.0, minutes: int = 60, give_up: int = 120, buffer: int = 4):
    """A session that opens outside the area of the one before, comes back into it and stays for an hour.

    The states (open checked, watching, confirming, done) pass over a session's bars as a
    fold, which ends with the time of entry; nothing leaves the JVM.
    """
    df = with_day(df)
    hi, lo, poc = v("value_area", "vah"), v("value_area", "val"), v("value_area", "poc")
    clock = second_of_day(eastern(F.col("ts")))
    bar = F.struct("ts", clock.alias("s"), "close", hi.alias("hi"), lo.alias("lo"), (F.coalesce(v("adx"), F.lit(0.0)) < calm).alias("calm"))
    open_ = F.struct(F.lit("open").alias("state"), F.lit(0).alias("way"), F.lit(0).alias("since"), F.lit(None).cast("timestamp_ntz").alias("entry"))

    def step(a: Column, x: Column) -> Column:
        inside = (x["close"] >= x["lo"]) & (x["close"] <= x["hi"])
        late = x["s"] - 34200 > 60 * give_up
        to = lambda state, way=a["way"], since=a["since"], entry=a["entry"]: F.struct(F.lit(state).alias("state"), way.alias("way"), since.alias("since"), entry.alias("entry"))
        wide = x["hi"] - x["lo"] >= least
        first = F.when(~F.coalesce(wide, F.lit(False)), to("done")).when(x["close"] > x["hi"], to("watch", F.lit(-1))).when(x["close"] < x["lo"], to("watch", F.lit(1))).otherwise(to("done"))
        watch = F.when(~x["calm"], a).when(late, to("done")).when(inside, to("confirm", since=x["s"])).otherwise(a)
        confirm = F.when(~inside, to("watch")).when((x["s"] - a["since"] >= 60 * minutes) & x["calm"], to("done", entry=x["ts"])).otherwise(a)
        return F.when(a["state"] == "open", first).when(a["state"] == "watch", watch).when(a["state"] == "confirm", confirm).otherwise(a)

    found = df.groupBy(*DAY).agg(F.sort_array(F.collect_list(bar)).alias("_bars")).select(*DAY, F.aggregate("_bars", open_, step).alias("_end"))
    df = df.join(found.select(*DAY, F.col("_end.entry").alias("_entry"), F.col("_end.way").alias("_way")), DAY, "left")
    s = F.when(F.col("ts") == F.col("_entry"), F.col("_way")).otherwise(0)
    stop = F.when(s > 0, lo - buffer * TICK).otherwise(hi + buffer * TICK)
    return df, s, F.when(s * (poc - _close()) > 0, poc).otherwise(F.when(s > 0, hi).otherwise(lo)), stop


_add("value_area_reversion", ["value_area", "adx", "atr"], _area_reversion, [], None, 1)


def _switch(df: DataFrame):
    """Reversion to the vwap while the trend is weak, else a crossover that the last closes confirm."""
    w, before = ordered(BY).rowsBetween(-2, 0), F.lag("close").over(ordered(BY))
    df = df.withColumn("_up", F.coalesce(before < _close(), F.lit(False)).cast("int")).withColumn("_dn", F.coalesce(before > _close(), F.lit(False)).cast("int"))
    df = df.withColumn("_nup", F.sum("_up").over(w)).withColumn("_ndn", F.sum("_dn").over(w)).withColumn("_calm", v("adx") < 22.0)
    calm, crossed = F.col("_calm"), passes("ema_crossover")
    long = F.when(calm, (v("vwap_session") <= -2.0) & (v("rsi_momentum") <= 25)).otherwise(crossed & (way("ema_crossover") > 0) & (F.col("_nup") == 3))
    short = F.when(calm, (v("vwap_session") >= 2.0) & (v("rsi_momentum") >= 75)).otherwise(crossed & (way("ema_crossover") < 0) & (F.col("_ndn") == 3))
    s = side(long, short)
    target = F.when(calm, v("vwap_session", "vwap")).otherwise(_close() + s * 2.0 * _atr())
    return df, s, target, _close() - s * F.when(calm, 2.0).otherwise(1.0) * _atr()


_add("regime_switcher", ["hmm_regime", "vwap_session", "rsi_momentum", "adx", "bollinger", "ema_crossover", "atr", "relative_volume"], _switch, [("hmm_regime", "passes"), ("relative_volume", ">= 0.6")], None, 5, False, {"rsi_momentum": {"n": 5}})


def _wick(share: float) -> tuple[Column, Column]:
    """Rejection at the low (long) or high (short): the wick's share of the range."""
    span = F.col("high") - F.col("low")
    body_low, body_high = F.least("open", "close"), F.greatest("open", "close")
    return F.try_divide(body_low - F.col("low"), span) >= share, F.try_divide(F.col("high") - body_high, span) >= share


def _levels(df: DataFrame):
    low_wick, high_wick = _wick(0.6)
    pdh, pdl, pdc = (v("prior_day_levels", x) for x in ("pdh", "pdl", "pdc"))
    s = side((way("prior_day_levels") > 0) & low_wick & (v("rsi_momentum") < 45), (way("prior_day_levels") < 0) & high_wick & (v("rsi_momentum") > 55))
    to = F.bround((_close() + 0.25 * (pdc - _close())) / TICK) * TICK
    return df.withColumn("_r", pdh - pdl), s, to, _close() - s * 10 * TICK


_add("pdh_pdl_fade", ["prior_day_levels", "prior_day_bias", "rsi_momentum", "volume_exhaustion", "atr", "relative_volume"], _levels, [("prior_day_levels", "passes"), ("relative_volume", ">= 0.5")], _timed(4, {"type": "price_vs_signal_exit", "signal": "prior_day_levels", "long_field": "pdl", "short_field": "pdh", "offset": 2.0}))


def _gap(df: DataFrame, smallest: float = 0.10, largest: float = 0.50, minutes: int = 15, noon: int = 12):
    """A small gap from the close before is faded once the initial balance is known, until noon."""
    df = with_day(df)
    clock = second_of_day(eastern(F.col("ts")))
    df = df.withColumn("_o", F.first("open").over(running(DAY))).withColumn("_n", F.row_number().over(ordered(DAY)))
    df = df.withColumn("_ready", (F.col("_n") > 1) & (clock - 34200 >= 60 * minutes)).withColumn("_r", F.coalesce(F.sum(F.col("_ready").cast("int")).over(running(DAY)), F.lit(0)))
    # The balance holds the bars up to the first that is ready, that one too.
    early = F.col("_r") - F.col("_ready").cast("int") == 0
    df = df.withColumn("_hi", F.max(F.when(early, F.col("high"))).over(running(DAY))).withColumn("_lo", F.min(F.when(early, F.col("low"))).over(running(DAY)))
    pdc = v("prior_day_levels", "pdc")
    gap = F.col("_o") - pdc
    ready = F.col("_ready") & (clock < noon * 3600) & F.abs(100 * gap / pdc).between(smallest, largest)
    s = side(ready & (gap < 0), ready & (gap > 0))
    return df, s, pdc, _close() - s * F.greatest(F.least(0.75 * (F.col("_hi") - F.col("_lo")), 0.5 * F.abs(gap)), F.lit(2.0))


_add("gap_fill", ["adx", "atr", "prior_day_levels"], _gap, [("adx", "< 25.0")], None, 1)
_add("orb_breakout", ["orb_breakout", "orb_range_size", "adx", "relative_volume", "vpin", "atr"], _by_atr(lambda: F.when(v("orb_range_size", "range").between(2, 15), way("orb_breakout")).otherwise(0), 2.0, 1.0), [("orb_breakout", "passes"), ("adx", "> 20.0"), ("relative_volume", ">= 1.5"), ("vpin", "< 0.7")], _timed(60, {"type": "adverse_momentum", "atr_multiple": 1.0, "max_bars": 3}), 1, True)


def _ib(df: DataFrame):
    low_wick, high_wick = _wick(0.5)
    hi, lo = v("initial_balance", "ib_high"), v("initial_balance", "ib_low")
    s = side((way("initial_balance") > 0) & low_wick & (v("rsi_momentum") < 50), (way("initial_balance") < 0) & high_wick & (v("rsi_momentum") > 50))
    return df, s, (hi + lo) / 2, _close() - s * 2.5


_add("ib_fade", ["initial_balance", "adx", "rsi_momentum", "atr", "relative_volume"], _ib, [("initial_balance", "passes"), ("adx", "< 25.0"), ("relative_volume", ">= 0.5")], _timed(6, {"type": "price_vs_signal_exit", "signal": "initial_balance", "long_field": "ib_low", "short_field": "ib_high", "offset": 1.0}))


def _ttm(df: DataFrame):
    on = F.coalesce((v("bollinger", "upper") < v("keltner_channel", "upper")) & (v("bollinger", "lower") > v("keltner_channel", "lower")), F.lit(False))
    df, released = _after_run(df, on, 6)
    s = F.when(released, side((_close() > v("keltner_channel", "upper")) & (v("rsi_momentum") > 50), (_close() < v("keltner_channel", "lower")) & (v("rsi_momentum") < 50))).otherwise(0)
    return df, s, *_atr_bracket(s, 2.0, 1.0)


_add("ttm_squeeze", ["keltner_channel", "bollinger", "rsi_momentum", "relative_volume", "atr"], _ttm, [("relative_volume", ">= 1.2")], _timed(6, {"type": "price_vs_signal_exit", "signal": "keltner_channel", "long_field": "upper", "short_field": "lower", "max_bars": 3}))


def _bounce(df: DataFrame):
    poc = v("value_area", "poc")
    s = side((way("value_area") > 0) & (v("rsi_momentum") < 45), (way("value_area") < 0) & (v("rsi_momentum") > 55))
    return df, s, _close() + 0.75 * (poc - _close()), _close() - s * 1.0 * _atr()


_add("poc_va_bounce", ["value_area", "poc_distance", "rsi_momentum", "adx", "relative_volume", "atr"], _bounce, [("value_area", "passes"), ("adx", "< 28.0"), ("relative_volume", ">= 0.6")], _timed(5, {"type": "price_vs_signal_exit", "signal": "value_area", "long_field": "val", "short_field": "vah", "offset": 3.0}))


def _ribbon(df: DataFrame):
    e8, e21 = v("ema_ribbon", "ema_8"), v("ema_ribbon", "ema_21")
    o = ordered(BY)
    df = df.withColumn("_was", F.lag(_close() - e8).over(o))
    up = (way("ema_ribbon") > 0) & (F.col("_was") > 0) & (F.col("low") <= e8) & (_close() > e21) & (_close() > F.col("open"))
    down = (way("ema_ribbon") < 0) & (F.col("_was") < 0) & (F.col("high") >= e8) & (_close() < e21) & (_close() < F.col("open"))
    s = side(up, down)
    return df, s, _close() + s * 1.5 * _atr(), e21 - s * 2 * TICK


_add("ema_ribbon_pullback", ["ema_ribbon", "sma_trend", "adx", "relative_volume", "atr"], _ribbon, [("ema_ribbon", "passes"), ("adx", "> 22.0"), ("relative_volume", ">= 0.7")], _timed(6, {"type": "signal_bound_exit", "signal": "ema_ribbon", "field": "is_fanned", "lower_bound": 0.5}))


def gates(df: DataFrame, start: str = "09:30", end: str = "16:00", excluded: tuple[tuple[str, str], ...] = (), states: tuple[int, ...] = (), regime: str = "hmm_regime") -> Column:
    """Whether a strategy may signal at a bar: its Eastern clock from start to end, outside the excluded windows (ends count), in an allowed state."""
    seconds = lambda x: int(x[:2]) * 3600 + int(x[3:]) * 60
    clock = second_of_day(eastern(F.col("ts")))
    ok = clock.between(seconds(start), seconds(end))
    for a, b in excluded:
        ok &= ~clock.between(seconds(a), seconds(b))
    return ok & v(regime).isin(list(states)) if states else ok


def signals_of(df: DataFrame, side_: Column, confidence: Column, gate: Column, cap: int = 5, least: float = 0.6) -> DataFrame:
    """``df`` with a column side that the gate, the least confidence and the cap of a session let pass."""
    df = with_day(df).withColumn("_s", F.when(gate & (confidence >= least), side_).otherwise(0))
    used = F.sum(F.abs("_s")).over(running(DAY))
    return df.withColumn("_u", used).withColumn("side", F.when(F.col("_u") <= cap, F.col("_s")).otherwise(0).cast("int")).drop("_s", "_u")


def intents(bars: DataFrame, name: str, filters: list[tuple[str, str]] | None = None, configs: dict[str, dict] | None = None) -> DataFrame:
    """Bars with side, entry, target, stop and atr_entry of a strategy; side is 0 where it doesn't enter.

    A geometry on the wrong side of the entry gives no entry; beyond the cap of a
    session (of each direction, for some) there is none either.  ``configs`` overrides
    parameters of the strategy's signals; an unknown name is an error.
    """
    s = REGISTRY[name]
    if unknown := set(configs or {}) - set(s.signals):
        raise ValueError(f"{name} doesn't use {', '.join(sorted(unknown))}")
    need = sorted({*s.signals, "atr", *needed_signals(s.exits or [])})
    df = compute(with_day(bars), need, **{n: {**s.configs.get(n, {}), **(configs or {}).get(n, {})} for n in need})
    df, way_, target, stop = s.entry(df)
    rules = [parse_rule({"signal": a, "expr": b}) for a, b in (s.filters if filters is None else filters)]
    ok, _ = compile_rules(rules, df)
    df = df.withColumn("side", F.when(ok, way_).otherwise(0)).withColumn("entry", F.col("close")).withColumn("target", target).withColumn("stop", stop).withColumn("atr_entry", F.coalesce(_atr(), F.lit(0.0)))
    sane = (F.col("side") * (F.col("target") - F.col("entry")) > 0) & (F.col("side") * (F.col("entry") - F.col("stop")) > 0)
    df = df.withColumn("side", F.when(F.coalesce(sane, F.lit(False)), F.col("side")).otherwise(0))
    keys = [*DAY, "side"] if s.per_direction else DAY
    used = F.sum(F.abs("side")).over(Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_used", used).withColumn("side", F.when(F.col("_used") <= s.cap, F.col("side")).otherwise(0).cast("int"))
    return df.drop(*[c for c in df.columns if c.startswith("_")])
