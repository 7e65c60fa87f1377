"""Published feature sets of the direction predictors, as stages of window expressions.

A feature set is a list of stages; a stage maps names to SQL expressions over the
columns before it, so all of it is whole-stage code and one sort by symbol and time.
Every feature is that of the bar before (``lag``), then its distance from its rolling
mean in rolling deviations (0 where those vanish or the window isn't full).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .bars import resample
from .joins import asof, asof_completed
from .recursive import series

Stages = list[dict[str, str]]
_BY = "PARTITION BY symbol ORDER BY ts"

#: Names of the features of each set, in their order.
BARS_26 = "return_1 return_5 return_15 realized_vol_20 hl_range hl_range_zscore volume_zscore_20 volume_zscore_50 volume_ratio_5 volume_accel up_vol_ratio_10 cvd_delta cvd_cumsum_10 cvd_cumsum_30 cvd_slope_10 close_position close_pos_zscore body_ratio obi_est obi_est_5 microprice_est microprice_vs_mid ofi_est_10 ofi_est_30 spread_proxy spread_zscore".split()
MINUTE_24 = "ofi_1m ofi_5m cvd_1m cvd_5m cvd_slope_5m obi_1m aggressive_ratio_1m trade_intensity_1m microprice_drift_1m vpin_20m volume_zscore_20m delta_zscore_20m buy_sell_ratio_1m volume_trend_10m return_1m return_5m realized_vol_20m autocorr_5m regime_p_trending regime_p_ranging regime_p_highvol regime_bars_in bb_pctb_5m rsi_14_5m".split()
FIVE_25 = "ofi_1bar ofi_3bar cvd_1bar cvd_3bar cvd_slope_5bar obi_1bar microprice_drift aggressive_ratio vpin_12bar return_1 return_3 return_6 realized_vol_12 autocorr_6 hl_range_zscore rsi_14 bb_pctb_20 stoch_k_14 donchian_pos_20 regime_p_trending regime_p_ranging regime_p_highvol tod_sin tod_cos session_segment".split()
L1_33 = "trade_count avg_trade_size trade_size_cv large_trade_pct aggressive_buy_pct aggressive_imbalance obi book_depth_ratio microprice_vs_mid actual_spread spread_max tick_up_pct price_impact vwap_distance return_1 return_5 realized_vol_20 hl_range volume_zscore_20 close_position body_ratio aggressive_imbalance_5 aggressive_imbalance_10 obi_5 obi_10 ofi_real_10 ofi_real_30 cvd_real_10 cvd_real_30 cvd_real_slope_10 spread_zscore trade_intensity_zscore aggressive_buy_pct_5".split()
FRAMES_30 = "ofi_10 ofi_30 obi_1 obi_5 microprice microprice_vs_mid cvd_delta_10 cvd_delta_30 cvd_slope volume_imbalance_10 volume_zscore_20 return_1 return_5 return_10 realized_vol_20 return_autocorr_10 spread spread_zscore_50 regime_p_trending regime_p_ranging regime_p_highvol regime_bars_in bb_pctb_1m rsi_14_1m atr_ratio_1m obv_slope_1m donchian_pos_5m stoch_k_14_5m bb_width_5m ema_cross_5m".split()
REGIME = ["regime_p_trending", "regime_p_ranging", "regime_p_highvol", "regime_bars_in"]
_TICK, _SMALL = "0.25D", "1e-9D"


def _over(n: int) -> str:
    return f"OVER ({_BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int) -> str:
    """An aggregate of the last n values, null before there are as many."""
    return f"CASE WHEN count({x}) {_over(n)} >= {n} THEN {f}({x}) {_over(n)} END"


def back(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({_BY})"


def zed(x: str, n: int, eps: str = _SMALL, least: int | None = None) -> str:
    sd = f"CASE WHEN count({x}) {_over(n)} >= {least or n} THEN stddev_samp({x}) {_over(n)} END"
    return f"CASE WHEN ({sd}) > {eps} THEN ({x} - avg({x}) {_over(n)}) / ({sd}) ELSE 0.0D END"


def slope(y: str, n: int) -> str:
    return f"CASE WHEN count({y}) {_over(n)} >= {n} THEN regr_slope({y}, n_) {_over(n)} END"


def _returns(*ks: int) -> dict[str, str]:
    return {f"r{k}": f"ln(close / {back('close', k)})" for k in ks}


def _flow(l1: bool) -> dict[str, str]:
    """Sizes on both sides and aggressive volumes: the bar's own, or told by where it closed."""
    if l1:
        return {"bid_": "coalesce(avg_bid_size, 0.0D)", "ask_": "coalesce(avg_ask_size, 0.0D)", "buy_": "CAST(coalesce(buy_volume, 0) AS DOUBLE)", "sell_": "CAST(coalesce(sell_volume, 0) AS DOUBLE)"}
    up = f"((close - low) / (high - low + {_SMALL}))"
    return {"bid_": f"volume * (1.0D - {up})", "ask_": f"volume * {up}", "buy_": f"volume * {up}", "sell_": f"volume * (1.0D - {up})"}


def _micro(half: str) -> str:
    return f"CASE WHEN bid_ + ask_ > 0 THEN (bid_ * (close + {half}) + ask_ * (close - {half})) / (bid_ + ask_) ELSE close END"


_OBI = "CASE WHEN bid_ + ask_ > 0 THEN (bid_ - ask_) / (bid_ + ask_) ELSE 0.0D END"
_OFI = f"coalesce(bid_ - {back('bid_')}, 0.0D) - coalesce(ask_ - {back('ask_')}, 0.0D)"
_START = {"n_": f"CAST(row_number() OVER ({_BY}) AS DOUBLE)", "v": "CAST(volume AS DOUBLE)", "hl": "high - low"}


def _sma_rsi(n: int = 14, flat: str = "50.0D") -> str:
    up, down = roll("avg", "gain_", n), roll("avg", "loss_", n)
    return f"CASE WHEN ({down}) > 1e-12D THEN 100.0D - 100.0D / (1.0D + ({up}) / ({down})) ELSE {flat} END"


def _pctb(n: int = 20) -> str:
    sd, mean = roll("stddev_samp", "close", n), roll("avg", "close", n)
    return f"CASE WHEN 4.0D * ({sd}) > 1e-12D THEN (close - (({mean}) - 2.0D * ({sd}))) / (4.0D * ({sd})) ELSE 0.5D END"


def _place(n: int, scale: str, flat: str) -> str:
    hi, lo = roll("max", "high", n), roll("min", "low", n)
    return f"CASE WHEN ({hi}) - ({lo}) > 1e-12D THEN (close - ({lo})) / (({hi}) - ({lo})) * {scale} ELSE {flat} END"


def stages_26(l1: bool = False) -> Stages:
    own = {"bid_": "coalesce(avg_bid_size, 0.0D)", "ask_": "coalesce(avg_ask_size, 0.0D)"} if l1 else {"bid_": f"v * (high - close) / (hl + {_SMALL})", "ask_": f"v * (close - low) / (hl + {_SMALL})"}
    total = f"(bid_ + ask_ + {_SMALL})"
    return [
        {**_START, **_returns(1, 5, 15)},
        {**own, "ticks_": f"hl / {_TICK}", "up_": "CASE WHEN close > open THEN v ELSE 0.0D END", "cvd_": f"v * (2.0D * (close - low) / (hl + {_SMALL}) - 1.0D)", "place_": f"(close - low) / (hl + {_SMALL})", "vz_": zed("v", 20)},
        {"ofi_": _OFI, "obi_": f"(bid_ - ask_) / {total}", "mp_": f"(bid_ * (close + hl / 2.0D) + ask_ * (close - hl / 2.0D)) / {total}", "cs_": roll("sum", "cvd_", 10)},
        {
            "return_1": "r1", "return_5": "r5", "return_15": "r15", "realized_vol_20": roll("stddev_samp", "r1", 20), "hl_range": "ticks_", "hl_range_zscore": zed("ticks_", 50),
            "volume_zscore_20": "vz_", "volume_zscore_50": zed("v", 50), "volume_ratio_5": f"CASE WHEN ({roll('avg', 'v', 5)}) > {_SMALL} THEN v / ({roll('avg', 'v', 5)}) ELSE 1.0D END", "volume_accel": f"vz_ - {back('vz_', 5)}",
            "up_vol_ratio_10": f"CASE WHEN ({roll('sum', 'v', 10)}) > 0 THEN ({roll('sum', 'up_', 10)}) / ({roll('sum', 'v', 10)}) ELSE 0.5D END",
            "cvd_delta": "cvd_", "cvd_cumsum_10": "cs_", "cvd_cumsum_30": roll("sum", "cvd_", 30), "cvd_slope_10": f"(cs_ - {back('cs_', 10)}) / 10.0D",
            "close_position": "place_", "close_pos_zscore": zed("place_", 20), "body_ratio": f"abs(close - open) / (hl + {_SMALL})",
            "obi_est": "obi_", "obi_est_5": roll("avg", "obi_", 5), "microprice_est": "mp_", "microprice_vs_mid": "mp_ - close", "ofi_est_10": roll("sum", "ofi_", 10), "ofi_est_30": roll("sum", "ofi_", 30), "spread_proxy": "ticks_", "spread_zscore": zed("ticks_", 50),
        },
    ]


def _intraday(l1: bool, returns: tuple[int, ...]) -> Stages:
    return [
        {**_START, **_returns(*returns), **_flow(l1)},
        {"delta_": "buy_ - sell_", "gain_": "CASE WHEN r1 IS NOT NULL THEN greatest(r1, 0.0D) END", "loss_": "CASE WHEN r1 IS NOT NULL THEN greatest(-r1, 0.0D) END", "prior_": back("r1"), "mp_": _micro(_TICK), "ofi_": _OFI, "vpin_": "CASE WHEN v > 0 THEN abs(buy_ - sell_) / v ELSE 0.0D END"},
        {"cum_": f"sum(delta_) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
    ]


def _autocorr(n: int) -> str:
    full = f"count(prior_) {_over(n)} >= {n} AND stddev_pop(r1) {_over(n)} > 1e-12D AND stddev_pop(prior_) {_over(n)} > 1e-12D"
    return f"CASE WHEN {full} THEN corr(r1, prior_) {_over(n)} END"


def stages_24(l1: bool = False) -> Stages:
    share = "CASE WHEN buy_ + sell_ > 0 THEN buy_ / (buy_ + sell_) ELSE 0.5D END"
    return [
        *_intraday(l1, (1, 5)),
        {
            "ofi_1m": "ofi_", "ofi_5m": roll("sum", "ofi_", 5), "cvd_1m": "delta_", "cvd_5m": roll("sum", "delta_", 5), "cvd_slope_5m": slope("cum_", 5), "obi_1m": _OBI, "aggressive_ratio_1m": share,
            "trade_intensity_1m": f"CASE WHEN ({roll('avg', 'v', 20)}) > 0 THEN v / ({roll('avg', 'v', 20)}) ELSE 1.0D END", "microprice_drift_1m": f"mp_ - {back('mp_')}", "vpin_20m": roll("avg", "vpin_", 20),
            "volume_zscore_20m": zed("v", 20, "0"), "delta_zscore_20m": zed("delta_", 20, "0"), "buy_sell_ratio_1m": "CASE WHEN sell_ > 0 THEN least(greatest(buy_ / sell_, 0.0D), 10.0D) ELSE 1.0D END", "volume_trend_10m": slope("v", 10),
            "return_1m": "r1", "return_5m": "r5", "realized_vol_20m": roll("stddev_samp", "r1", 20), "autocorr_5m": _autocorr(5), "bb_pctb_5m": _pctb(), "rsi_14_5m": _sma_rsi(),
        },
    ]


def stages_25(l1: bool = False) -> Stages:
    share = "CASE WHEN buy_ + sell_ > 0 THEN buy_ / (buy_ + sell_) ELSE 0.5D END"
    return [
        *_intraday(l1, (1, 3, 6)),
        {
            "ofi_1bar": "ofi_", "ofi_3bar": roll("sum", "ofi_", 3), "cvd_1bar": "delta_", "cvd_3bar": roll("sum", "delta_", 3), "cvd_slope_5bar": slope("cum_", 5), "obi_1bar": _OBI, "microprice_drift": f"mp_ - {back('mp_')}", "aggressive_ratio": share, "vpin_12bar": roll("avg", "vpin_", 12),
            "return_1": "r1", "return_3": "r3", "return_6": "r6", "realized_vol_12": roll("stddev_samp", "r1", 12), "autocorr_6": _autocorr(6), "hl_range_zscore": zed("hl", 12, "1e-12D"), "rsi_14": _sma_rsi(), "bb_pctb_20": _pctb(), "stoch_k_14": _place(14, "100.0D", "50.0D"), "donchian_pos_20": _place(20, "1.0D", "0.5D"),
        },
    ]


#: Minutes since 9:30 by the clock as it is, and what follows from them; never scaled.
CLOCK = {"m_": "CAST((hour(ts) - 9) * 60 + minute(ts) - 30 AS DOUBLE)", "tod_sin": "sin(m_ / 390.0D * 2.0D * pi())", "tod_cos": "cos(m_ / 390.0D * 2.0D * pi())", "session_segment": "CASE WHEN m_ < 60 THEN 0.0D WHEN m_ < 300 THEN 0.5D ELSE 1.0D END"}


def stages_33() -> Stages:
    both = f"(buy_volume + sell_volume + {_SMALL})"
    sizes = f"(avg_bid_size + avg_ask_size + {_SMALL})"
    return [
        {**_START, **_returns(1, 5), "bid_": "avg_bid_size", "ask_": "avg_ask_size"},
        {"imb_": f"(buy_volume - sell_volume) / {both}", "buyp_": f"buy_volume / {both}", "obi_": f"(bid_ - ask_) / {sizes}", "ofi_": _OFI, "cvd_": "CAST(buy_volume - sell_volume AS DOUBLE)", "count_": "CAST(n_ticks AS DOUBLE)"},
        {"cs_": roll("sum", "cvd_", 10)},
        {
            "trade_count": "count_", "avg_trade_size": "mean_size", "trade_size_cv": "CASE WHEN mean_size > 0 THEN coalesce(sd_size, 0.0D) / mean_size ELSE 0.0D END", "large_trade_pct": "large_share",
            "aggressive_buy_pct": "CASE WHEN v > 0 THEN buy_volume / v ELSE 0.0D END", "aggressive_imbalance": "imb_", "obi": "obi_", "book_depth_ratio": f"bid_ / (ask_ + {_SMALL})", "microprice_vs_mid": f"(microprice - mid) / {_TICK}",
            "actual_spread": f"mean_spread / {_TICK}", "spread_max": f"max_spread / {_TICK}", "tick_up_pct": "upticks / count_", "price_impact": "CASE WHEN v > 1 THEN abs(ln(close / open)) / ln(v) ELSE 0.0D END", "vwap_distance": f"(close - vwap) / {_TICK}",
            "return_1": "r1", "return_5": "r5", "realized_vol_20": roll("stddev_samp", "r1", 20), "hl_range": f"hl / {_TICK}", "volume_zscore_20": zed("v", 20), "close_position": f"(close - low) / (hl + {_SMALL})", "body_ratio": f"abs(close - open) / (hl + {_SMALL})",
            "aggressive_imbalance_5": roll("avg", "imb_", 5), "aggressive_imbalance_10": roll("avg", "imb_", 10), "obi_5": roll("avg", "obi_", 5), "obi_10": roll("avg", "obi_", 10), "ofi_real_10": roll("sum", "ofi_", 10), "ofi_real_30": roll("sum", "ofi_", 30),
            "cvd_real_10": "cs_", "cvd_real_30": roll("sum", "cvd_", 30), "cvd_real_slope_10": f"(cs_ - {back('cs_', 10)}) / 10.0D", "spread_zscore": zed("mean_spread", 50), "trade_intensity_zscore": zed("count_", 20), "aggressive_buy_pct_5": roll("avg", "buyp_", 5),
        },
    ]


#: What is scaled already and stays as it is, by set.
_PLAIN = {"26": {"volume_zscore_20", "volume_zscore_50", "close_pos_zscore", "hl_range_zscore", "obi_est_5", "spread_zscore"}, "33": {"volume_zscore_20", "spread_zscore", "trade_intensity_zscore"}}


def finished(stages: Stages, names: list[str], plain: set[str], z: int = 100, eps: str = _SMALL) -> Stages:
    """``stages`` with each feature lagged by a bar, then scaled unless it is ``plain``."""
    lagged = {f"{c}_": back(c) for c in names}
    return [*stages, lagged, {c: f"{c}_" if c in plain else zed(f"{c}_", z, eps) for c in names}]


def online(stages: Stages, names: list[str], plain: set[str], z: int = 100, least: int = 5) -> Stages:
    """``stages`` with each feature of the bar itself, scaled from ``least`` values on: what a live builder gives."""
    return [*stages, {f"{c}_": c for c in names}, {c: f"{c}_" if c in plain else zed(f"{c}_", z, least=least) for c in names}]


def features_26_online(bars: DataFrame) -> DataFrame:
    """symbol, ts and the 26 features at each bar's own close; null until their windows are full."""
    return staged(bars, online(stages_26(), BARS_26, _PLAIN["26"])).select("symbol", "ts", *BARS_26)


def staged(df: DataFrame, stages: Stages) -> DataFrame:
    for s in stages:
        df = df.withColumns({n: F.expr(x) for n, x in s.items()})
    return df


def staged_sql(source: str, stages: Stages) -> str:
    """The same stages as common table expressions ``f0``, ``f1``, ... of a relation."""
    out, before, have = [], source, set()
    for k, s in enumerate(stages):
        again = [n for n in s if n in have]
        star = f"* EXCLUDE ({', '.join(again)})" if again else "*"
        out.append(f"f{k} AS (SELECT {star}, {', '.join(f'{x} AS {n}' for n, x in s.items())} FROM {before})")
        before, have = f"f{k}", have | set(s)
    return re.sub(r"(?<=\d)D\b", "::DOUBLE", ", ".join(out))


def features_26(bars: DataFrame, l1: bool = False) -> DataFrame:
    """symbol, ts and the 26 features of bars."""
    return staged(bars, finished(stages_26(l1), BARS_26, _PLAIN["26"])).select("symbol", "ts", *BARS_26)


def _with_regime(df: DataFrame, regimes: DataFrame | None, names: list[str]) -> DataFrame:
    """The regime as of each bar and then the bar before's, or zeros."""
    if regimes is None:
        return df.withColumns({c: F.lit(0.0) for c in names})
    joined = asof(df, regimes.select("symbol", "ts", *names), ["symbol"], prefix="r_")
    return joined.withColumns({c: F.col(f"r_{c}") for c in names}).drop("r_ts", *[f"r_{c}" for c in names])


def features_24(bars: DataFrame, regimes: DataFrame | None = None, l1: bool = False) -> DataFrame:
    """symbol, ts and the 24 features of one-minute bars; ``regimes`` (symbol, ts, regime columns) at most as old as the bar."""
    df = _with_regime(staged(bars, stages_24(l1)), regimes, REGIME)
    return staged(df, finished([], MINUTE_24, set(), eps="1e-12D")).select("symbol", "ts", *MINUTE_24)


def features_25(bars: DataFrame, regimes: DataFrame | None = None, l1: bool = False) -> DataFrame:
    """symbol, ts and the 25 features of five-minute bars."""
    scaled = [c for c in FIVE_25 if c not in CLOCK]
    df = _with_regime(staged(bars, stages_25(l1)), regimes, REGIME[:3])
    df = staged(df, finished([], scaled, set(), eps="1e-12D"))
    for n, x in CLOCK.items():
        df = df.withColumn(n, F.expr(x))
    return df.select("symbol", "ts", *FIVE_25)


def features_33(bars: DataFrame) -> DataFrame:
    """symbol, ts and the 33 features of ``l1_bars``."""
    return staged(bars, finished(stages_33(), L1_33, _PLAIN["33"])).select("symbol", "ts", *L1_33)


def l1_bars(ticks: DataFrame, freq: str) -> DataFrame:
    """Bars with quotes' sizes, spreads, trade sizes and aggressive volumes, of ticks with bid_size and ask_size."""
    at = F.window("ts", freq)["start"].cast("timestamp_ntz")
    t = ticks.withColumn("_d", F.col("px") - F.lag("px").over(Window.partitionBy("symbol").orderBy("ts"))).withColumn("bar", at)
    size, price = F.col("size"), lambda x: x / F.lit(4.0)
    median = t.groupBy("symbol", "bar").agg(F.median("size").alias("_m"))
    t = t.join(median, ["symbol", "bar"])
    n = F.count("*")
    both = F.col("bid_size") + F.col("ask_size")
    return t.groupBy("symbol", F.col("bar").alias("ts")).agg(
        price(F.min_by("px", "ts")).alias("open"), price(F.max("px")).alias("high"), price(F.min("px")).alias("low"), price(F.max_by("px", "ts")).alias("close"), F.sum("size").alias("volume"), (F.sum(F.col("px") * size) / (F.lit(4.0) * F.sum("size"))).alias("vwap"),
        F.sum(F.when(F.col("side") == "B", size).otherwise(0)).alias("buy_volume"), F.sum(F.when(F.col("side") == "A", size).otherwise(0)).alias("sell_volume"), n.alias("n_ticks"), (F.sum("size") / n).alias("mean_size"), F.stddev_samp("size").alias("sd_size"),
        (F.sum(F.when(size > 2 * F.col("_m"), size).otherwise(0)) / F.sum("size")).alias("large_share"), (F.sum("bid_size") / n).alias("avg_bid_size"), (F.sum("ask_size") / n).alias("avg_ask_size"), (F.sum(F.col("ask") - F.col("bid")) / (F.lit(4.0) * n)).alias("mean_spread"), price(F.max(F.col("ask") - F.col("bid"))).alias("max_spread"),
        (F.coalesce(F.sum((F.col("_d") > 0).cast("long")), F.lit(0))).cast("double").alias("upticks"), (F.sum(F.col("bid") + F.col("ask")) / (F.lit(8.0) * n)).alias("mid"), (F.sum(F.col("bid") * F.col("ask_size") + F.col("ask") * F.col("bid_size")) / (F.lit(4.0) * F.sum(both))).alias("microprice"),
    )


def _tactical(bars: DataFrame) -> DataFrame:
    """Band position, index, range ratio and slope of signed volume of the middle frame."""
    step = f"close - {back('close')}"
    obv = f"sum(CASE WHEN step_ > 0 THEN v WHEN step_ < 0 THEN -v ELSE 0.0D END) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    atr = lambda n: roll("avg", "tr_", n)
    stages = [
        {**_START, "step_": step, "tr_": f"greatest(high - low, abs(high - {back('close')}), abs(low - {back('close')}))"},
        {"gain_": "CASE WHEN step_ > 0 THEN step_ ELSE 0.0D END", "loss_": "CASE WHEN step_ < 0 THEN -step_ ELSE 0.0D END", "obv_": obv},
        {"bb_pctb_1m": _pctb(), "rsi_14_1m": _sma_rsi(14, "100.0D"), "atr_ratio_1m": f"CASE WHEN ({atr(20)}) > 1e-12D THEN ({atr(5)}) / ({atr(20)}) ELSE 1.0D END", "obv_slope_1m": slope("obv_", 10)},
    ]
    return staged(bars, stages).select("symbol", "ts", "bb_pctb_1m", "rsi_14_1m", "atr_ratio_1m", "obv_slope_1m")


def _strategic(bars: DataFrame) -> DataFrame:
    """Channel position, stochastic, band width and distance of two means of the coarse frame."""
    df = series(bars, ["close"], ["e20_", "e50_"], lambda a: {"e20_": K.ema(a["close"], 20), "e50_": K.ema(a["close"], 50)})
    mean, sd, atr = roll("avg", "close", 20), roll("stddev_samp", "close", 20), roll("avg", "tr_", 14)
    stages = [
        {"tr_": f"greatest(high - low, abs(high - {back('close')}), abs(low - {back('close')}))"},
        {"donchian_pos_5m": _place(20, "1.0D", "0.5D"), "stoch_k_14_5m": _place(14, "100.0D", "50.0D"), "bb_width_5m": f"CASE WHEN ({mean}) > 1e-12D THEN 4.0D * ({sd}) / ({mean}) ELSE 0.0D END", "ema_cross_5m": f"CASE WHEN ({atr}) > 1e-12D THEN (e20_ - e50_) / ({atr}) ELSE 0.0D END"},
    ]
    return staged(df, stages).select("symbol", "ts", "donchian_pos_5m", "stoch_k_14_5m", "bb_width_5m", "ema_cross_5m")


def features_30(bars: DataFrame, middle: str = "1 minute", coarse: str = "5 minutes", regimes: DataFrame | None = None, l1: bool = False) -> DataFrame:
    """symbol, ts and the 30 features of fine bars and two coarser frames, of which only bars that were over count.

    The feature window isn't lagged: it is read at the close of its own bar.  Rows before
    all windows are full are left out.
    """
    mean10 = f"avg(r1z_) {_over(10)}"
    stages = [
        {**_START, **_returns(1, 5, 10), **_flow(l1)},
        {"delta_": "buy_ - sell_", "mp_": _micro(_TICK), "ofi_": _OFI, "ticks_": f"hl / {_TICK}", "obi_": _OBI, "r1z_": "coalesce(r1, 0.0D)"},
        {"cum_": f"sum(delta_) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "pairs_": f"r1z_ * {back('r1z_')}", "old_": back("r1z_", 9), "mean_": f"CASE WHEN n_ >= 10 THEN {mean10} END", "var_": f"CASE WHEN n_ >= 10 THEN var_pop(r1z_) {_over(10)} END"},
        {
            "ofi_10": roll("sum", "ofi_", 10), "ofi_30": roll("sum", "ofi_", 30), "obi_1": "obi_", "obi_5": roll("avg", "obi_", 5), "microprice": "mp_", "microprice_vs_mid": "mp_ - close", "cvd_delta_10": roll("sum", "delta_", 10), "cvd_delta_30": roll("sum", "delta_", 30), "cvd_slope": slope("cum_", 20),
            "volume_imbalance_10": f"CASE WHEN ({roll('sum', 'v', 10)}) > 0 THEN ({roll('sum', 'delta_', 10)}) / ({roll('sum', 'v', 10)}) ELSE 0.0D END", "volume_zscore_20": zed("v", 20, "0"),
            "return_1": "r1", "return_5": "r5", "return_10": "r10", "realized_vol_20": roll("stddev_samp", "r1", 20),
            # With m the mean of the ten: sum((x_i - m)(x_i+1 - m)) = sum(x_i x_i+1) - m (sum - x_last) - m (sum - x_first) + 9 m^2.
            "return_autocorr_10": f"CASE WHEN var_ > 1e-18D THEN (sum(pairs_) {_over(9)} - mean_ * (10.0D * mean_ - r1z_) - mean_ * (10.0D * mean_ - old_) + 9.0D * mean_ * mean_) / 9.0D / var_ WHEN var_ IS NOT NULL THEN 0.0D END",
            "spread": "ticks_", "spread_zscore_50": zed("ticks_", 50, "0"),
        },
    ]
    fine = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    df = staged(bars, stages)
    for freq, of in ((middle, _tactical), (coarse, _strategic)):
        extra = of(resample(bars.select(*fine), freq))
        names = extra.columns[2:]
        df = asof_completed(df, extra, ["symbol"], freq, prefix="f_").withColumnsRenamed({f"f_{c}": c for c in names}).drop("f_ts")
    df = _with_regime(df, regimes, REGIME)
    df = df.withColumns({f"{c}_": F.col(c) for c in FRAMES_30})
    out = staged(df, [{c: zed(f"{c}_", 100, "1e-12D") for c in FRAMES_30}])
    return out.where("n_ > 100").select("symbol", "ts", *FRAMES_30).na.drop(subset=FRAMES_30)


SETS: dict[str, tuple[Callable[..., DataFrame], list[str]]] = {"26": (features_26, BARS_26), "24": (features_24, MINUTE_24), "25": (features_25, FIVE_25), "33": (features_33, L1_33), "30": (features_30, FRAMES_30)}
