"""Exit rules and trade geometry.

A rule is a small dict with a ``type`` and parameters, kept in the order declared;
the first that applies ends a trade.  ``compile_exits`` turns a list into one
function of a trade's state, which the replay calls on each bar; ``geometry`` is a
plain projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TICK = 0.25


@dataclass
class Position:
    """An open trade as exit rules see it."""

    side: int  # 1 long, -1 short
    fill: float
    atr: float
    target: float = 0.0
    stop: float = 0.0
    bars: int = 0
    peak: float = 0.0
    seen: dict = field(default_factory=dict)


Check = Callable[[Position, dict], str | None]


def _favourable(p: Position, bar: dict) -> float:
    return bar["high"] if p.side > 0 else bar["low"]


def _adverse(p: Position, bar: dict) -> float:
    return bar["low"] if p.side > 0 else bar["high"]


def _static_target(atr_multiple: float = 1.5) -> Check:
    return lambda p, b: "tp:static_target" if p.side * (_favourable(p, b) - p.fill) >= atr_multiple * p.atr > 0 else None


def _static_stop(atr_multiple: float = 1.0) -> Check:
    return lambda p, b: "stop:static_stop" if p.side * (p.fill - _adverse(p, b)) >= atr_multiple * p.atr > 0 else None


def _trailing_stop(atr_multiple: float = 1.2, activate_after_ticks: float = 4, activate_after_atr: float | None = None) -> Check:
    def check(p: Position, b: dict) -> str | None:
        need = activate_after_atr * p.atr if activate_after_atr is not None else activate_after_ticks * TICK
        if p.side * (b["close"] - p.fill) < need:
            return None
        best = _favourable(p, b)
        p.peak = best if not p.peak else max(p.peak, best) if p.side > 0 else min(p.peak, best)
        return "stop:trailing" if p.side * (p.peak - b["close"]) >= atr_multiple * p.atr else None

    return check


def _time_stop(max_bars: int = 12) -> Check:
    return lambda p, b: "stop:time" if p.bars >= max_bars else None


def _vwap_target(target_sd_band: float = 0.5, vwap_signal: str = "vwap_session") -> Check:
    def check(p: Position, b: dict) -> str | None:
        sd, vwap = b.get(f"{vwap_signal}.sd") or 0.0, b.get(f"{vwap_signal}.vwap") or 0.0
        return "tp:reversion_target" if sd > 0 and vwap and abs((_favourable(p, b) - vwap) / sd) <= target_sd_band else None

    return check


def _key(signal: str, name: str | None) -> str:
    return f"{signal}.{name or 'value'}"


def _adverse_signal(signal: str, field: str | None = None, long_threshold: float = 0.0, short_threshold: float = 0.0) -> Check:
    why = f"early:adverse_{signal}" + (f"_{field}" if field else "")

    def check(p: Position, b: dict) -> str | None:
        v = b.get(_key(signal, field))
        return why if v is not None and (v < long_threshold if p.side > 0 else v > short_threshold) else None

    return check


def _regime(hostile_regimes_long: list = (), hostile_regimes_short: list = (), min_bars_before_active: int = 2, hmm_signal: str = "hmm_regime") -> Check:
    hostile = {1: set(hostile_regimes_long), -1: set(hostile_regimes_short)}
    return lambda p, b: "early:regime_flip" if p.bars >= min_bars_before_active and b.get(f"{hmm_signal}.value") in hostile[p.side] else None


def _volatility(expansion_multiple: float = 1.8, min_bars_before_active: int = 3, atr_signal: str = "atr") -> Check:
    return lambda p, b: "early:vol_expansion" if p.bars >= min_bars_before_active and (b.get(f"{atr_signal}.atr_raw") or 0.0) > expansion_multiple * p.atr > 0 else None


def _bracket_target() -> Check:
    return lambda p, b: "tp:bracket_target" if p.target and p.side * (_favourable(p, b) - p.target) >= 0 else None


def _bracket_stop() -> Check:
    return lambda p, b: "stop:bracket_stop" if p.stop and p.side * (p.stop - _adverse(p, b)) >= 0 else None


def _momentum(atr_multiple: float | None = None, threshold_points: float | None = None, max_bars: int | None = None) -> Check:
    def check(p: Position, b: dict) -> str | None:
        if max_bars is not None and p.bars > max_bars:
            return None
        limit = threshold_points if threshold_points is not None else (atr_multiple or 1.0) * p.atr
        return "early:adverse_momentum" if limit > 0 and p.side * (p.fill - b["close"]) > limit else None

    return check


def _signal_bound(signal: str, field: str | None = None, lower_bound: float | None = None, upper_bound: float | None = None) -> Check:
    def check(p: Position, b: dict) -> str | None:
        v = b.get(_key(signal, field))
        out = v is not None and (lower_bound is not None and v < lower_bound or upper_bound is not None and v > upper_bound)
        return f"early:{signal}_bound" if out else None

    return check


def _price_vs_signal(signal: str, long_field: str, short_field: str, offset: float = 0.0, max_bars: int | None = None) -> Check:
    def check(p: Position, b: dict) -> str | None:
        v = b.get(f"{signal}.{long_field if p.side > 0 else short_field}")
        if v is None or max_bars is not None and p.bars > max_bars:
            return None
        return f"early:price_vs_{signal}" if p.side * (v - b["close"]) > offset else None

    return check


TYPES: dict[str, Callable[..., Check]] = {
    "static_target": _static_target,
    "static_stop": _static_stop,
    "trailing_stop": _trailing_stop,
    "time_stop": _time_stop,
    "vwap_reversion_target": _vwap_target,
    "adverse_signal_exit": _adverse_signal,
    "regime_exit": _regime,
    "volatility_expansion_exit": _volatility,
    "bracket_target": _bracket_target,
    "bracket_stop": _bracket_stop,
    "adverse_momentum": _momentum,
    "signal_bound_exit": _signal_bound,
    "price_vs_signal_exit": _price_vs_signal,
}


def compile_exits(rules: list[dict]) -> Check:
    """The first rule that applies, in the order declared; rules with ``enabled: False`` are left out."""
    checks: list[Check] = []
    for r in rules:
        r = dict(r)
        kind = r.pop("type")
        if kind not in TYPES:
            raise ValueError(f"unknown exit type: {kind}")
        if r.pop("enabled", True):
            checks.append(TYPES[kind](**r))

    def first(p: Position, bar: dict) -> str | None:
        for c in checks:
            if why := c(p, bar):
                return why
        return None

    return first


def exit_price(rules: list[dict], why: str, p: Position, bar: dict) -> tuple[float, str, bool]:
    """(price, reason, whether at market) of an exit: stops and targets fill at their own price, all else at the close."""
    rule = next((r for r in rules if r["type"] == {"tp:reversion_target": "vwap_reversion_target"}.get(why, why.split(":")[1])), {})
    k = rule.get("atr_multiple", 1.5 if why == "tp:static_target" else 1.0)
    if why == "tp:static_target":
        return p.fill + p.side * k * p.atr, "target", False
    if why == "tp:bracket_target":
        return p.target, "target", False
    if why == "tp:reversion_target":
        name = rule.get("vwap_signal", "vwap_session")
        return bar[f"{name}.vwap"] - p.side * rule.get("target_sd_band", 0.5) * bar[f"{name}.sd"], "target", False
    if why == "stop:static_stop":
        return p.fill - p.side * k * p.atr, why, True
    if why == "stop:bracket_stop":
        return p.stop, why, True
    return bar["close"], why, True


def needed_signals(rules: list[dict]) -> set[str]:
    """Signals that a list of rules reads."""
    fixed = {"vwap_reversion_target": ("vwap_signal", "vwap_session"), "volatility_expansion_exit": ("atr_signal", "atr"), "regime_exit": ("hmm_signal", "hmm_regime")}
    used = [r for r in rules if r.get("enabled", True)]
    return {r["signal"] for r in used if "signal" in r} | {r.get(*fixed[r["type"]]) for r in used if r["type"] in fixed}


def bracket_prices(rules: list[dict], side: int, fill: float, atr: float) -> tuple[float, float]:
    """Static target and stop as prices; (0, 0) without a usable range."""
    if atr <= 0:
        return 0.0, 0.0
    find = lambda kind, default: next((r.get("atr_multiple", default) for r in rules if r["type"] == kind and r.get("enabled", True)), 0.0)
    t, s = find("static_target", 1.5), find("static_stop", 1.0)
    return (fill + side * t * atr if t else 0.0), (fill - side * s * atr if s else 0.0)


def _distance(spec, default: str, atr: Column, width: Column, sd: Column) -> Column:
    """Distance in points of a geometry: a number is ticks, a string a kind, a dict a kind with its value."""
    if isinstance(spec, (int, float)):
        spec = {"type": "fixed_ticks", "value": spec}
    if isinstance(spec, str):
        spec = {"type": spec}
    spec = spec or {"type": default}
    kind, value = spec["type"], float(spec.get("value", 1.0))
    if kind == "fixed_ticks":
        return F.lit(value * TICK)
    if kind == "atr_multiple":
        return value * atr
    if kind == "or_width":
        return value * width
    if kind == "sd_band":
        return value * sd
    raise ValueError(f"unknown geometry: {kind}")


def geometry(side: Column, entry: Column, target, stop, atr: Column, width: Column, sd: Column, vwap: Column, broken: Column) -> tuple[Column, Column]:
    """(target, stop) prices of a trade: distances from the entry, or the vwap as target, or the first broken level as stop."""
    name = lambda s: s if isinstance(s, str) else s.get("type") if isinstance(s, dict) else None
    to = vwap if name(target) == "vwap" else entry + side * _distance(target, "atr_multiple", atr, width, sd)
    back = broken if name(stop) == "first_break" else entry - side * _distance(stop, "atr_multiple", atr, width, sd)
    return to, back
