"""Exit, replay, risk and strategy queries."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import replay as R
from ..operators import strategies as S
from ..operators.exits import geometry, needed_signals
from ..functions.timeutil import in_session
from ..operators.bars import bars_sql, clock_bars
from ..operators.signals import compute, with_day
from ..sources.tape import TICKS_SQL, ticks
from . import signals as _signals  # noqa: F401  its SQL is used here
from .base import BARS_SQL, ONLY_TICKS, hour_bars, rounded

_W = "w AS (PARTITION BY symbol ORDER BY ts)"


@register(f"""{BARS_SQL}, s AS (SELECT *, row_number() OVER w AS i, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS side FROM bars WINDOW {_W}), o AS (SELECT *, close + side * 10.0::DOUBLE AS target, close - side * 6.0::DOUBLE AS stop FROM s WHERE side <> 0),
j AS (SELECT o.symbol, o.ts, o.side, o.target, o.stop, p.i - o.i AS k, p.close, o.side * (o.stop - CASE WHEN o.side > 0 THEN p.low ELSE p.high END) >= 0 AS st, o.side * (CASE WHEN o.side > 0 THEN p.high ELSE p.low END - o.target) >= 0 AS tg FROM o JOIN s p ON p.symbol = o.symbol AND p.i > o.i AND p.i <= o.i + 12),
k AS (SELECT symbol, ts, any_value(side) AS side, any_value(target) AS target, any_value(stop) AS stop, min(k) FILTER (st OR tg) AS k, max(k) AS n, arg_max(close, k) AS close FROM j GROUP BY symbol, ts)
SELECT k.symbol, k.ts, CAST(k.side AS INTEGER) AS side, CASE WHEN j.st THEN 'stop' WHEN j.tg THEN 'target' ELSE 'expired' END AS reason, CAST(coalesce(k.k, k.n) AS INTEGER) AS bars, CASE WHEN j.st THEN k.stop WHEN j.tg THEN k.target ELSE k.close END AS exit
FROM k LEFT JOIN j ON j.symbol = k.symbol AND j.ts = k.ts AND j.k = k.k""")
def b03_first_touch(spark, sf_dir):
    """Brackets of every directional bar: what is touched first within twelve bars."""
    b = hour_bars(spark, sf_dir)
    side = F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1).otherwise(0)
    i = b.withColumn("side", side).where("side <> 0").withColumn("target", F.col("close") + F.col("side") * 10.0).withColumn("stop", F.col("close") - F.col("side") * 6.0)
    return R.first_touch(i, b, ["symbol"], 12)


@register(f"""{BARS_SQL}, t AS (SELECT symbol, ts, CASE WHEN close > open THEN 1 ELSE -1 END AS side, open AS entry, close AS exit, CASE WHEN volume > 60 THEN 2 ELSE 1 END AS slip FROM bars)
SELECT symbol, ts, exit - side * slip * 0.25::DOUBLE AS exit, side * (exit - side * slip * 0.25::DOUBLE - entry) * 5 AS gross, 0.7::DOUBLE + slip * 0.25 * 5 AS costs FROM t""")
def b05_fill_costs(spark, sf_dir):
    """Market exits with slippage in the price and again as cost."""
    b = hour_bars(spark, sf_dir)
    slip = R.slippage_ticks(F.col("volume") > 60, F.lit(False))
    side = F.when(F.col("close") > F.col("open"), 1).otherwise(-1)
    b = b.withColumn("slip", slip).withColumn("side", side).withColumn("exit", F.col("close") - side * slip * 0.25)
    return b.select("symbol", "ts", "exit", (F.col("side") * (F.col("exit") - F.col("open")) * R.POINT_VALUE).alias("gross"), (2 * F.lit(R.COMMISSION) + F.col("slip") * 0.25 * R.POINT_VALUE).alias("costs"))


@register(f"""{BARS_SQL}, n AS (SELECT *, CASE WHEN row_number() OVER w % 2 = 0 THEN 1 ELSE -1 END AS side FROM bars WINDOW {_W})
SELECT symbol, ts, close + side * 2.0::DOUBLE * (high - low) AS t_atr, close - side * 8 * 0.25::DOUBLE AS s_ticks, vwap AS t_vwap, low AS s_break, close - side * 1.5::DOUBLE * 4.0 AS s_width FROM n""")
def x15_geometry(spark, sf_dir):
    """Targets and stops of each kind, as a projection."""
    b = hour_bars(spark, sf_dir).withColumn("side", F.when(F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) % 2 == 0, 1).otherwise(-1))
    make = lambda t, s: geometry(F.col("side"), F.col("close"), t, s, F.col("high") - F.col("low"), F.lit(4.0), F.lit(1.0), F.col("vwap"), F.col("low"))
    t1, s1 = make({"type": "atr_multiple", "value": 2.0}, 8)
    t2, s2 = make("vwap", "first_break")
    _, s3 = make(4, {"type": "or_width", "value": 1.5})
    return b.select("symbol", "ts", t1.alias("t_atr"), s1.alias("s_ticks"), t2.alias("t_vwap"), s2.alias("s_break"), s3.alias("s_width"))


_CLOCK = "(hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') * 60 + minute(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')) BETWEEN 570 AND 959"


def _other_tape_sql(px: str, session: bool) -> str:
    """Hourly bars of the tape with other prices in whole ticks, in the regular session only if so asked."""
    tape = TICKS_SQL.replace("ticks AS (", "raw AS (", 1) + f", walk AS (SELECT *, {px} AS p FROM raw), ticks AS (SELECT event_id, symbol, ts, user_id, p AS px, size, p - (px - bid) AS bid, p + (ask - px) AS ask, bid_size, side FROM walk)"
    return f"WITH {tape}, {bars_sql('every')}, bars AS (SELECT * FROM every WHERE {_CLOCK if session else 'true'})"


def _other_tape(spark, sf_dir, px, session: bool):
    t = ticks(spark, sf_dir).withColumn("_p", px)
    t = t.withColumns({"bid": F.col("_p") - (F.col("px") - F.col("bid")), "ask": F.col("_p") + (F.col("ask") - F.col("px")), "px": F.col("_p")}).drop("_p")
    bars = clock_bars(t, "1 hour")
    return bars.where(in_session(F.col("ts"))) if session else bars


#: Prices held between 5000 and 5010, for rules that look at small moves; and a random walk, for trends and channels.
CALM_SQL = _other_tape_sql("20000 + px % 40", True)
WALK_SQL = _other_tape_sql("20000 + CAST(sum(px % 21 - 10) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT)", False)


#: A walk that takes ten times as long steps on two days of six, so that narrow channels break.
BURST_SQL = _other_tape_sql("20000 + CAST(sum((px % 21 - 10) * CASE WHEN CAST(floor(epoch(ts) / 172800) AS BIGINT) % 3 = 0 THEN 10 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT)", False)


def calm_bars(spark, sf_dir):
    return _other_tape(spark, sf_dir, 20000 + F.col("px") % 40, True)


def walk_bars(spark, sf_dir):
    steps = F.sum(F.col("px") % 21 - 10).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return _other_tape(spark, sf_dir, 20000 + steps, False)


def burst_bars(spark, sf_dir):
    long = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 172800) % 3 == 0
    steps = F.sum((F.col("px") % 21 - 10) * F.when(long, 10).otherwise(1)).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return _other_tape(spark, sf_dir, 20000 + steps, False)


#: Parameters for hourly bars, which are too coarse for opening ranges of minutes.
HOURLY = {"orb_breakout": {"orb_breakout": {"minutes": 240}, "orb_range_size": {"minutes": 240}}, "ib_fade": {"initial_balance": {"minutes": 180}}}
ON_CALM = ("gap_fill", "value_area_reversion", "poc_va_bounce", "ib_fade", "orb_breakout")
ON_WALK = ("stoch_bb_fade", "donchian_breakout_trend", "donchian_fade", "pdh_pdl_fade")


def _bars_for(spark, sf_dir, name: str):
    if name == "donchian_squeeze":
        return burst_bars(spark, sf_dir)
    return calm_bars(spark, sf_dir) if name in ON_CALM else walk_bars(spark, sf_dir) if name in ON_WALK else hour_bars(spark, sf_dir)


def _trades(spark, sf_dir, name: str):
    """Trades of a strategy on hourly bars without its clock filters."""
    s = S.REGISTRY[name]
    i = S.intents(_bars_for(spark, sf_dir, name), name, configs=HOURLY.get(name))
    fields = [f"{n}.{f.name}" for n in sorted(needed_signals(s.exits or [])) for f in i.schema[n].dataType.fields if f.dataType.simpleString() == "double"]
    i = i.withColumn("slip", R.slippage_ticks(F.col("volume") > 200, F.lit(False)))
    return R.replay(i, ["symbol"], s.exits, 1, 12, tuple(fields))


#: Signals that a strategy's SQL reads, by the query that states them.
_SIGNAL_SQL = {"atr": "sg01_atr", "adx": "sg02_adx", "boll": "sg03_bollinger", "cvd": "sg04_cvd_divergence", "ib3": "sg09_initial_balance", "macd": "sg11_macd", "pd": "sg18_prior_day_levels", "rib": "sg07_ema_ribbon", "sma": "sg23_sma_trend_200", "dc": "sg05_donchian_channel", "ema": "sg06_ema_crossover", "kc": "sg10_keltner_channel", "mfi": "sg12_mfi", "obv": "sg13_obv", "rvol": "sg20_relative_volume", "rsi": "sg21_rsi_momentum", "spread": "sg24_spread", "stoch": "sg25_stochastic", "bias": "sg29_vwap_bias", "vwap": "sg31_vwap_session"}


def _entry_sql(signals: str, ok: str, long: str, short: str, target: str, stop: str, cap: int = 3, before: str = "", base: str = BARS_SQL) -> str:
    """Entries of a strategy from the SQL of its signals, joined by symbol and time."""
    from ..catalog import _SQL

    names = signals.split()
    exact = lambda sql: re.sub(r"round\(([^()]*), 4\) AS", r"\1 AS", sql)  # noqa: E731  other fields of a signal as they are
    parts = ", ".join(f"{n} AS ({exact(_SQL[_SIGNAL_SQL[n]]).replace(BARS_SQL[5:], base[5:], 1)})" for n in names)
    joins = " ".join(f"JOIN {n} ON {n}.symbol = b.symbol AND {n}.ts = b.ts" for n in names)
    return f"""{base}, {parts},
j AS (SELECT b.symbol, b.ts, b.open, b.high, b.low, b.close, atr.atr_raw AS a, {ok} AS ok, {long} AS l, {short} AS s, {", ".join(f"{n}.value AS {n}_v" for n in names)}{before} FROM bars b {joins}),
d AS (SELECT *, CASE WHEN NOT ok THEN 0 WHEN coalesce(l, false) THEN 1 WHEN coalesce(s, false) THEN -1 ELSE 0 END AS side FROM j),
t AS (SELECT *, {target} AS target, {stop} AS stop FROM d),
c AS (SELECT *, CASE WHEN side * (target - close) > 0 AND side * (close - stop) > 0 THEN side ELSE 0 END AS way FROM t),
u AS (SELECT *, sum(abs(way)) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS n FROM c)
SELECT symbol, ts, CAST(way AS INTEGER) AS side, close AS entry, round(target, 4) AS target, round(stop, 4) AS stop FROM u WHERE way <> 0 AND n <= {cap}"""


def _bracket_sql(target: float, stop: float) -> tuple[str, str]:
    return f"close + side * {target} * a", f"close - side * {stop} * a"


def _strategy_sql() -> dict[str, str]:
    up, down = "direction = 'long'", "direction = 'short'"
    low_wick = lambda x: f"CASE WHEN b.high > b.low THEN (least(b.open, b.close) - b.low) / (b.high - b.low) >= {x} END"
    high_wick = lambda x: f"CASE WHEN b.high > b.low THEN (b.high - greatest(b.open, b.close)) / (b.high - b.low) >= {x} END"
    day = "(PARTITION BY b.symbol, CAST(b.ts AS DATE) ORDER BY b.ts)"
    gap = f"(first_value(b.open) OVER {day} - pd.pdc)"
    clock = "(epoch(b.ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') % 86400)"
    tight = "coalesce(dc.width_percentile <= 10, false)"
    released = f"sum(CASE WHEN {tight} THEN 1 ELSE 0 END) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 AND NOT {tight}"
    return {
        "donchian_squeeze": _entry_sql("atr rvol macd dc", "dc.passes AND rvol.value >= 2.0", f"{released} AND dc.{up} AND macd.value > 0", f"{released} AND dc.{down} AND macd.value < 0", *_bracket_sql(5.0, 2.5), base=BURST_SQL),
        "macd_zero_line": _entry_sql("atr adx rvol macd sma bias", "macd.passes AND adx.value > 20 AND rvol.value >= 0.8", f"macd.{up} AND sma.{up} AND bias.{up}", f"macd.{down} AND sma.{down} AND bias.{down}", *_bracket_sql(2.0, 1.0)),
        "micro_pullback": _entry_sql("atr adx rvol ema sma", "adx.value > 25 AND rvol.value >= 1.0", f"ema.{up} AND NOT ema.passes AND b.low <= ema.fast + 0.5 AND b.close > b.open AND sma.direction <> 'short'", f"ema.{down} AND NOT ema.passes AND b.high >= ema.fast - 0.5 AND b.close < b.open AND sma.direction <> 'long'", *_bracket_sql(1.5, 1.0)),
        "pdh_pdl_fade": _entry_sql("atr rvol pd rsi", "pd.passes AND rvol.value >= 0.5", f"pd.{up} AND {low_wick(0.6)} AND rsi.value < 45", f"pd.{down} AND {high_wick(0.6)} AND rsi.value > 55", "CAST(round_even((close + 0.25 * (pdc - close)) / 0.25, 0) AS DOUBLE) * 0.25", "close - side * 2.5", before=", pd.pdc AS pdc", base=WALK_SQL),
        # On hourly bars each bar after the first is past the balance's fifteen minutes, so the balance is the first two bars.
        "gap_fill": _entry_sql("atr adx pd", "adx.value < 25", f"{gap} < 0", f"{gap} > 0", "pdc", "close - side * greatest(least(0.75 * ib, 0.5 * abs(g)), 2.0)", 1, f", pd.pdc AS pdc, {gap} AS g, row_number() OVER {day} AS k, {clock} AS clock, greatest(first_value(b.high) OVER {day}, nth_value(b.high, 2) OVER {day}) - least(first_value(b.low) OVER {day}, nth_value(b.low, 2) OVER {day}) AS ib", CALM_SQL).replace("CASE WHEN NOT ok THEN 0", "CASE WHEN NOT ok OR k < 2 OR clock >= 43200 OR NOT coalesce(abs(100 * g / pdc) BETWEEN 0.1 AND 0.5, false) THEN 0"),
        "ib_fade": _entry_sql("atr adx rvol ib3 rsi", "ib3.passes AND adx.value < 25 AND rvol.value >= 0.5", f"ib3.{up} AND {low_wick(0.5)} AND rsi.value < 50", f"ib3.{down} AND {high_wick(0.5)} AND rsi.value > 50", "mid", "close - side * 2.5", before=", (ib3.ib_high + ib3.ib_low) / 2 AS mid", base=CALM_SQL),
        "ema_ribbon_pullback": _entry_sql("atr adx rvol rib", "rib.passes AND adx.value > 22 AND rvol.value >= 0.7", f"rib.{up} AND lag(b.close - rib.ema_8) OVER o > 0 AND b.low <= rib.ema_8 AND b.close > rib.ema_21 AND b.close > b.open", f"rib.{down} AND lag(b.close - rib.ema_8) OVER o < 0 AND b.high >= rib.ema_8 AND b.close < rib.ema_21 AND b.close < b.open", "close + side * 1.5 * a", "slow - side * 0.5", before=", rib.ema_21 AS slow").replace("OVER o ", "OVER (PARTITION BY b.symbol ORDER BY b.ts) "),
        "vwap_band_reversion": _entry_sql("atr adx rvol vwap", "adx.value < 18 AND rvol.value >= 0.3", "vwap.value <= -2.5", "vwap.value >= 2.5", "v", "CASE WHEN side > 0 THEN least(close - a, low - 0.25) ELSE greatest(close + a, high + 0.25) END", before=", vwap.vwap AS v"),
        "stoch_bb_fade": _entry_sql("atr adx rvol stoch boll", "stoch.passes AND adx.value < 25 AND rvol.value >= 0.5", f"stoch.{up} AND b.close < boll.lower", f"stoch.{down} AND b.close > boll.upper", *_bracket_sql(1.5, 1.0), base=WALK_SQL),
        "cvd_divergence": _entry_sql("atr adx cvd bias spread", "cvd.passes AND adx.value BETWEEN 15 AND 35 AND spread.value <= 0.5 AND NOT (spread.value = 0 AND NOT spread.passes)", f"cvd.{up} AND bias.{up}", f"cvd.{down} AND bias.{down}", *_bracket_sql(1.5, 1.0)),
        "donchian_midline": _entry_sql("atr adx rvol dc ema", "adx.value >= 22 AND rvol.value >= 1.0 AND dc.value >= 1.5 * atr.atr_raw AND coalesce(abs(b.close - (dc.upper + dc.lower) / 2) <= greatest(0.5, 0.05 * (dc.upper - dc.lower)), false)", f"ema.{up}", f"ema.{down}", "CASE WHEN side > 0 THEN up ELSE dn END", "CASE WHEN side > 0 THEN dn - 0.5 ELSE up + 0.5 END", before=", dc.upper AS up, dc.lower AS dn"),
        "donchian_breakout_trend": _entry_sql("atr adx rvol dc bias", "dc.passes AND adx.value >= 22 AND rvol.value >= 1.5 AND dc.value BETWEEN 2 AND 30", f"dc.{up} AND bias.{up}", f"dc.{down} AND bias.{down}", *_bracket_sql(3.5, 1.75), base=WALK_SQL),
        "donchian_fade": _entry_sql("atr adx dc rsi vwap", "adx.value < 20", "b.low <= dc.lower AND rsi.value < 30", "b.high >= dc.upper AND rsi.value > 70", "CASE WHEN side * (v - close) > 0 THEN v ELSE close + side * 1.5 * a END", "close - side * 1.25 * a", before=", vwap.vwap AS v", base=WALK_SQL),
        "mfi_obv_divergence": _entry_sql("atr adx rvol mfi obv", "mfi.passes AND rvol.value >= 0.7 AND adx.value < 30", "mfi.value < 20 AND obv.value > 0", "mfi.value > 80 AND obv.value < 0", *_bracket_sql(1.5, 1.0)),
        "ttm_squeeze": _entry_sql("atr rvol kc boll rsi", "rvol.value >= 1.2", "sum(CASE WHEN boll.upper < kc.upper AND boll.lower > kc.lower THEN 1 ELSE 0 END) OVER p = 6 AND NOT coalesce(boll.upper < kc.upper AND boll.lower > kc.lower, false) AND b.close > kc.upper AND rsi.value > 50", "sum(CASE WHEN boll.upper < kc.upper AND boll.lower > kc.lower THEN 1 ELSE 0 END) OVER p = 6 AND NOT coalesce(boll.upper < kc.upper AND boll.lower > kc.lower, false) AND b.close < kc.lower AND rsi.value < 50", *_bracket_sql(2.0, 1.0)).replace("OVER p", "OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"),
    }


def _strategy(key: str, name: str, sql: str | None) -> None:
    def query(spark, sf_dir):
        out = S.intents(_bars_for(spark, sf_dir, name), name, configs=HOURLY.get(name)).where("side <> 0")
        return rounded(out.select("symbol", "ts", "side", "entry", "target", "stop"), ["target", "stop"])

    query.__doc__ = f"Entries of {name}."
    register(sql, key)(query)


_SQLS = _strategy_sql()
for _n, _name in enumerate(["vwap_band_reversion", "stoch_bb_fade", "macd_zero_line", "cvd_divergence", "donchian_midline", "donchian_squeeze", "donchian_breakout_trend", "donchian_fade", "mfi_obv_divergence", "micro_pullback", "value_area_reversion", "regime_switcher", "pdh_pdl_fade", "gap_fill", "orb_breakout", "ib_fade", "ttm_squeeze", "poc_va_bounce", "ema_ribbon_pullback"], 1):
    _strategy(f"t{_n:02d}_{_name}", _name, _SQLS.get(_name))


@register()
def b01_replay(spark, sf_dir):
    """Trades of a momentum intent with static, trailing and time exits."""
    b = with_day(hour_bars(spark, sf_dir))
    b = compute(b, ["atr", "relative_volume"])
    side = F.when(F.col("close") > F.col("open"), 1).otherwise(-1)
    i = b.withColumn("side", F.when(F.col("relative_volume.passes"), side).otherwise(0)).withColumn("entry", F.col("close")).withColumn("atr_entry", F.coalesce("atr.atr_raw", F.lit(1.0))).withColumn("target", F.col("entry") + F.col("side") * F.col("atr_entry")).withColumn("stop", F.col("entry") - F.col("side") * F.col("atr_entry")).withColumn("slip", F.lit(1))
    rules = [{"type": "static_target", "atr_multiple": 1.5}, {"type": "static_stop"}, {"type": "trailing_stop"}, {"type": "time_stop", "max_bars": 6}]
    return rounded(R.replay(i, ["symbol"], rules), ["entry", "exit", "gross", "costs", "pnl"])


@register()
def b08_strategy_trades(spark, sf_dir):
    """Trades of a strategy with its own exits."""
    return rounded(_trades(spark, sf_dir, "donchian_breakout_trend"), ["entry", "exit", "gross", "costs", "pnl"])


def _strategy_trades(name: str) -> None:
    def query(spark, sf_dir):
        return rounded(_trades(spark, sf_dir, name), ["entry", "exit", "gross", "costs", "pnl"])

    query.__doc__ = f"Trades of {name} with its own exits."
    register(name=f"b08_{name}")(query)


for _name in S.REGISTRY:
    if _name != "donchian_breakout_trend":
        _strategy_trades(_name)


@register()
def b11_risk_path(spark, sf_dir):
    """Position, realised P&L and halt after each fill, anew each day."""
    t = ticks(spark, sf_dir).where("side <> 'N'").select("symbol", "ts", F.when(F.col("side") == "B", 1).otherwise(-1).alias("side"), (F.col("px") / 4.0).alias("px"))
    return rounded(R.risk_path(t, ["symbol"], max_loss=50.0), ["realised"])


@register(f"""{ONLY_TICKS.replace("WITH ", "WITH RECURSIVE ", 1)}, o AS (SELECT symbol, ts, CAST(ts AS DATE) AS day, CASE side WHEN 'B' THEN 1 ELSE -1 END AS side, px, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS i FROM ticks WHERE side <> 'N'),
r AS (SELECT symbol, day, ts, i, side AS pos FROM o WHERE i = 1 UNION ALL SELECT o.symbol, o.day, o.ts, o.i, r.pos + o.side FROM r JOIN o ON o.symbol = r.symbol AND o.day = r.day AND o.i = r.i + 1)
SELECT symbol, ts, CAST(pos AS INTEGER) AS position FROM r""")
def b11_positions(spark, sf_dir):
    """Net position after each fill, without a loss limit."""
    t = ticks(spark, sf_dir).where("side <> 'N'").select("symbol", "ts", F.when(F.col("side") == "B", 1).otherwise(-1).alias("side"), (F.col("px") / 4.0).alias("px"))
    return R.risk_path(t, ["symbol"], max_loss=1e18).select("symbol", "ts", "position")


@register(f"""{BARS_SQL}, e AS (SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS e, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS way, 0.5 + abs(close - open) / 200 AS confidence FROM bars),
g AS (SELECT *, CASE WHEN epoch(e) % 86400 BETWEEN 34200 AND 57600 AND NOT epoch(e) % 86400 BETWEEN 43200 AND 46800 AND confidence >= 0.6 THEN way ELSE 0 END AS s FROM e),
u AS (SELECT *, sum(abs(s)) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS u FROM g) SELECT symbol, ts, CAST(CASE WHEN u <= 2 THEN s ELSE 0 END AS INTEGER) AS side FROM u""")
def t20_base_gates(spark, sf_dir):
    """Session, excluded window, least confidence and daily cap of the common strategy base."""
    b = hour_bars(spark, sf_dir)
    way = F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1).otherwise(0)
    out = S.signals_of(b, way, 0.5 + F.abs(F.col("close") - F.col("open")) / 200, S.gates(b, excluded=(("12:00", "13:00"),)), cap=2)
    return out.select("symbol", "ts", "side")


def _simple_intents(spark, sf_dir, freq_bars):
    b = with_day(freq_bars)
    side = F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1).otherwise(0)
    return b.withColumn("side", side).withColumn("entry", F.col("close")).withColumn("target", F.col("close") + side * 10.0).withColumn("stop", F.col("close") - side * 6.0).withColumn("atr_entry", F.lit(4.0)).withColumn("slip", F.lit(1))


@register()
def b09_dual_replay(spark, sf_dir):
    """Entries on bars of four hours, fills and exits on hourly ones."""
    from ..operators.bars import clock_bars as clock
    from ..operators.simulators import dual_replay

    t = ticks(spark, sf_dir)
    coarse, fine = _simple_intents(spark, sf_dir, clock(t, "4 hours")), with_day(clock(t, "1 hour"))
    return rounded(dual_replay(coarse, fine, "4 hours", ["symbol"], [{"type": "bracket_target"}, {"type": "bracket_stop"}, {"type": "time_stop", "max_bars": 8}]), ["entry", "exit", "gross", "costs", "pnl"])


def _predicted(spark, sf_dir):
    from ..operators.simulators import predicted_trades

    b = with_day(hour_bars(spark, sf_dir))
    p = (F.col("volume") * 37 % 101) / F.lit(101.0)
    return predicted_trades(b.withColumn("p_up", p).withColumn("p_down", 1 - p), ["symbol"], 0.7, 200, 120, 6, 3)


@register()
def b10_predictor_trades(spark, sf_dir):
    """Trades of probabilities with a cooldown and an end after six bars."""
    return rounded(_predicted(spark, sf_dir), ["confidence", "gross", "costs", "pnl"])


@register(f"""{BARS_SQL}, t AS (SELECT symbol, ts, CAST(ts AS DATE) AS d, close - open AS pnl FROM bars), d AS (SELECT symbol, d, sum(pnl) AS p FROM t GROUP BY ALL), s AS (SELECT symbol, count(*) AS days, avg(p) / stddev_samp(p) * sqrt(252) AS sharpe, avg(p) / stddev_samp(p) FILTER (p < 0) * sqrt(252) AS sortino FROM d GROUP BY symbol),
e AS (SELECT symbol, ts, sum(pnl) OVER (PARTITION BY symbol ORDER BY ts) AS e FROM t), k AS (SELECT *, max(e) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM e), m AS (SELECT symbol, min(e - k) AS w, arg_min(k, struct_pack(a := e - k, b := ts)) AS k FROM k GROUP BY symbol),
n AS (SELECT symbol, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS wr, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl <= 0) AS pf, sum(pnl) AS net FROM t GROUP BY symbol)
SELECT symbol, n AS n_trades, round(wr, 4) AS win_rate, round(pf, 4) AS profit_factor, round(net, 4) AS net, round(w / (k + 1e-9) * 100, 4) AS max_drawdown_pct, days, round(sharpe, 4) AS sharpe, round(sortino, 4) AS sortino, round(CAST(n AS DOUBLE) / days, 4) AS trades_per_day FROM n JOIN s USING (symbol) JOIN m USING (symbol)""")
def g18_simulator_metrics(spark, sf_dir):
    """Metrics as simulators report them, of each bar's move as a trade."""
    from ..operators.simulators import simulator_metrics

    b = hour_bars(spark, sf_dir).select("symbol", F.col("ts").alias("entry_ts"), F.col("ts").alias("exit_ts"), (F.col("close") - F.col("open")).alias("pnl"))
    return rounded(simulator_metrics(b, ["symbol"]), ["win_rate", "profit_factor", "net", "max_drawdown_pct", "sharpe", "sortino", "trades_per_day"])


def _swept(spark, sf_dir):
    from ..operators.sweeps import bracket_sweep, split_spans

    spans = split_spans(spark, ("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-12-31"))
    return bracket_sweep(_simple_intents(spark, sf_dir, hour_bars(spark, sf_dir)), ["symbol"], {"target_atr": [1.5, 3.0], "stop_atr": [1.0, 2.5], "max_bars": [6, 12]}, spans)


@register()
def c10_split_sweep(spark, sf_dir):
    """Eight combinations of brackets over a train and a test span, and the best of the train span."""
    from ..operators.sweeps import split_choice

    out = split_choice(_swept(spark, sf_dir), 5)
    return rounded(out, [c for c, t in out.dtypes if t == "double"])


@register()
def c10_stability(spark, sf_dir):
    """How each combination does across spans."""
    from ..operators.sweeps import across_spans

    return rounded(across_spans(_swept(spark, sf_dir)), ["worst_sharpe", "mean_sharpe"])
