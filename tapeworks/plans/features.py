"""Label, feature and prediction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import features as X
from ..operators import predictor as P
from ..operators.recursive import regime_features
from ..sources.tape import table, ticks
from .base import BARS_SQL, ONLY_TICKS, hour_bars, rounded
from .signals import frame


def _barrier_sql(horizon: int, take: int, stop: int, vol_n: int, clip: tuple[float, float], touch: str) -> str:
    hi, lo = ("close", "close") if touch == "close" else ("high", "low")
    return f"""{BARS_SQL}, r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n, ln(close) - ln(lag(close) OVER w) AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
v AS (SELECT *, CASE WHEN count(r) OVER f >= {vol_n} THEN stddev_samp(r) OVER f END AS v FROM r WINDOW f AS {frame(vol_n)}),
s AS (SELECT *, CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE greatest(least(v / (median(v) OVER (PARTITION BY symbol)), {clip[1]}::DOUBLE), {clip[0]}::DOUBLE) END AS s FROM v),
b AS (SELECT *, close + {take} * 0.25 * s AS up, close - {stop} * 0.25 * s AS dn FROM s WHERE i <= n - {horizon}),
j AS (SELECT b.symbol, b.ts, b.close, p.i - b.i AS k, p.close AS pc, p.{hi} >= b.up AS u, p.{lo} <= b.dn AS d FROM b JOIN s p ON p.symbol = b.symbol AND p.i > b.i AND p.i <= b.i + {horizon}),
t AS (SELECT symbol, ts, min(k) FILTER (u OR d) AS k, arg_max(pc, k) - any_value(close) AS move FROM j GROUP BY symbol, ts),
h AS (SELECT t.symbol, t.ts, t.k, t.move, j.u, j.d, j.pc >= j.close AS above FROM t LEFT JOIN j ON j.symbol = t.symbol AND j.ts = t.ts AND j.k = t.k)
SELECT symbol, ts, CAST(CASE WHEN u AND d THEN CASE WHEN above THEN 1 ELSE -1 END WHEN u THEN 1 WHEN d THEN -1 ELSE sign(move) END AS TINYINT) AS label, CAST(coalesce(k, {horizon}) AS SMALLINT) AS "offset",
  CASE WHEN u AND d THEN 'both' WHEN u THEN 'tp' WHEN d THEN 'sl' ELSE 'vertical' END AS reason, CAST(CASE WHEN k IS NOT NULL THEN 1.0 ELSE least(1.0, abs(move) / ({take} * 0.25)) END AS FLOAT) AS weight FROM h"""


def _barrier(key: str, horizon: int, take: int, stop: int, vol_n: int, clip: tuple[float, float], touch: str) -> None:
    def query(spark, sf_dir):
        return X.triple_barrier(hour_bars(spark, sf_dir), horizon, take, stop, vol_n, clip, touch)

    register(_barrier_sql(horizon, take, stop, vol_n, clip, touch), key)(query)


_barrier("q01_triple_barrier_close", 15, 40, 30, 50, (0.5, 2.5), "close")
_barrier("q02_triple_barrier_range", 15, 60, 40, 60, (0.5, 3.0), "range")
_barrier("q03_triple_barrier_coarse", 6, 120, 80, 48, (0.5, 3.0), "range")


@register(f"""{BARS_SQL}, f AS (SELECT *, ln(close) - ln(lag(close) OVER w) AS ret_1, ln(close) - ln(lag(close, 5) OVER w) AS ret_5, high - low AS rng, close - open AS body, high - greatest(open, close) AS uw, close - vwap AS vd,
  CASE WHEN count(*) OVER f >= 20 THEN avg(close) OVER f END AS m, CASE WHEN count(*) OVER f >= 20 THEN stddev_samp(close) OVER f END AS s, CASE WHEN count(*) OVER f >= 20 THEN max(high) OVER f END AS hi, CASE WHEN count(*) OVER f >= 20 THEN min(low) OVER f END AS lo
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts), f AS {frame(20)}),
g AS (SELECT *, CASE WHEN count(ret_1) OVER f >= 20 THEN stddev_samp(ret_1) OVER f END AS vol FROM f WINDOW f AS {frame(20)})
SELECT symbol, ts, round(lag(ret_1) OVER w, 4) AS ret_1, round(lag(ret_5) OVER w, 4) AS ret_5, lag(rng) OVER w AS range, lag(body) OVER w AS body, lag(uw) OVER w AS upper_wick, round(lag(vd) OVER w, 4) AS vwap_dist, round(lag(vol) OVER w, 4) AS vol_20,
  round(lag(CASE WHEN s > 1e-10 THEN (close - (m - 2 * s)) / (4 * s) END) OVER w, 4) AS bb_pct, round(lag(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) END) OVER w, 4) AS donchian_pos
FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def q05_bar_features(spark, sf_dir):
    """Features of the bar before; a subset that SQL states plainly."""
    out = X.bar_features(hour_bars(spark, sf_dir)).select("symbol", "ts", "ret_1", "ret_5", "range", "body", "upper_wick", "vwap_dist", "vol_20", "bb_pct", "donchian_pos")
    return rounded(out, ["ret_1", "ret_5", "vwap_dist", "vol_20", "bb_pct", "donchian_pos"])


@register()
def q05_all_bar_features(spark, sf_dir):
    """The engine's own features of bars, rounded."""
    out = X.bar_features(hour_bars(spark, sf_dir)).select("symbol", "ts", *X.BAR_FEATURES)
    return rounded(out, X.BAR_FEATURES)


_L1_SQL = f"""{ONLY_TICKS}, d AS (SELECT *, 1 + (user_id * 7) % 40 AS ask_size, px - lag(px) OVER (PARTITION BY symbol ORDER BY ts) AS dpx, median(size) OVER (PARTITION BY symbol, date_trunc('hour', ts)) AS m FROM ticks),
bars AS (SELECT symbol, date_trunc('hour', ts) AS ts, CAST(arg_min(px, ts) AS DOUBLE) / 4 AS open, max(px) / 4.0::DOUBLE AS high, min(px) / 4.0::DOUBLE AS low, CAST(arg_max(px, ts) AS DOUBLE) / 4 AS close, CAST(sum(size) AS BIGINT) AS volume, CAST(sum(px * size) AS DOUBLE) / (4.0::DOUBLE * sum(size)) AS vwap,
  CAST(sum(CASE WHEN side = 'B' THEN size ELSE 0 END) AS BIGINT) AS buy_volume, CAST(sum(CASE WHEN side = 'A' THEN size ELSE 0 END) AS BIGINT) AS sell_volume, count(*) AS n_ticks, CAST(sum(size) AS DOUBLE) / count(*) AS mean_size, stddev_samp(size) AS sd_size, CAST(sum(CASE WHEN size > 2 * m THEN size ELSE 0 END) AS DOUBLE) / sum(size) AS large_share,
  CAST(sum(bid_size) AS DOUBLE) / count(*) AS avg_bid_size, CAST(sum(ask_size) AS DOUBLE) / count(*) AS avg_ask_size, CAST(sum(ask - bid) AS DOUBLE) / (4.0::DOUBLE * count(*)) AS mean_spread, CAST(max(ask - bid) AS DOUBLE) / 4 AS max_spread, CAST(count(*) FILTER (dpx > 0) AS DOUBLE) AS upticks,
  CAST(sum(bid + ask) AS DOUBLE) / (8.0::DOUBLE * count(*)) AS mid, CAST(sum(bid * ask_size + ask * bid_size) AS DOUBLE) / (4.0::DOUBLE * sum(bid_size + ask_size)) AS microprice FROM d GROUP BY symbol, date_trunc('hour', ts))"""


def _quoted(spark, sf_dir):
    """Hourly bars with the sizes of both quotes."""
    return P.l1_bars(ticks(spark, sf_dir).withColumn("ask_size", 1 + (F.col("user_id") * 7) % 40), "1 hour")


def _set_sql(source: str, stages, names: list[str], plain: set[str], eps: str = "1e-9D", rest: str = "", digits: int = 3) -> str:
    """SQL of a feature set over the bars of ``source``; window functions of later stages read the columns of earlier ones."""
    made = P.finished(stages, names, plain, eps=eps)
    last = f"f{len(made) - 1}"
    return f"""{source}, {P.staged_sql("bars", made)} SELECT symbol, ts, {", ".join(f"round({c}, {digits}) AS {c}" for c in names)}{rest} FROM {last}"""


_24 = [c for c in P.MINUTE_24 if c not in P.REGIME]
_25 = [c for c in P.FIVE_25 if c not in P.REGIME and c not in P.CLOCK]
_NONE = ", ".join(f"0.0::DOUBLE AS {c}" for c in P.REGIME)


@register(_set_sql(BARS_SQL, P.stages_26(), P.BARS_26, P._PLAIN["26"], digits=4))
def q05_features_26(spark, sf_dir):
    """26 features of bars with estimated quotes."""
    return rounded(P.features_26(hour_bars(spark, sf_dir)), P.BARS_26, 4)


@register(_set_sql(_L1_SQL, P.stages_24(True), _24, set(), "1e-12D", f", {_NONE}"))
def q07_features_24(spark, sf_dir):
    """24 features of the minute predictor, without regimes."""
    return rounded(P.features_24(_quoted(spark, sf_dir), l1=True), _24, 3)


@register(_set_sql(_L1_SQL, P.stages_25(True), _25, set(), "1e-12D", f", {', '.join(f'0.0::DOUBLE AS {c}' for c in P.REGIME[:3])}, round(sin(((hour(ts) - 9) * 60 + minute(ts) - 30) / 390.0::DOUBLE * 2 * pi()), 3) AS tod_sin, round(cos(((hour(ts) - 9) * 60 + minute(ts) - 30) / 390.0::DOUBLE * 2 * pi()), 3) AS tod_cos, CASE WHEN (hour(ts) - 9) * 60 + minute(ts) - 30 < 60 THEN 0.0::DOUBLE WHEN (hour(ts) - 9) * 60 + minute(ts) - 30 < 300 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS session_segment"))
def q08_features_25(spark, sf_dir):
    """25 features of the five-minute predictor, without regimes."""
    return rounded(P.features_25(_quoted(spark, sf_dir), l1=True), [*_25, "tod_sin", "tod_cos"], 3)


@register()
def q08_features_with_regimes(spark, sf_dir):
    """The same with the regimes of a detector that is fitted on each symbol's first bars."""
    from ..operators.regime import detect

    b = hour_bars(spark, sf_dir)
    return rounded(P.features_25(b, detect(b)), [c for c in P.FIVE_25 if c != "session_segment"], 3)


@register()
def q09_features_30(spark, sf_dir):
    """30 features of hourly bars with frames of four hours and a day."""
    return rounded(P.features_30(hour_bars(spark, sf_dir), "4 hours", "1 day"), P.FRAMES_30, 3)


@register(f"""{_L1_SQL}, {P.staged_sql("bars", P.finished(P.stages_33(), P.L1_33, P._PLAIN["33"]))} SELECT symbol, ts, {", ".join(f"round({c}, 3) AS {c}" for c in P.L1_33)} FROM f{len(P.stages_33()) + 1}""")
def q11_features_33(spark, sf_dir):
    """33 features of quotes and trades."""
    return rounded(P.features_33(_quoted(spark, sf_dir)), P.L1_33, 3)


@register(f"{BARS_SQL} SELECT symbol, ts, close, {', '.join(f'lag({c}, {k}) OVER w AS {c}_lag{k}' for k in (1, 2, 3) for c in ('close', 'volume'))} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
def q10_lagged_bars(spark, sf_dir):
    b = hour_bars(spark, sf_dir).select("symbol", "ts", "close", "volume")
    return X.lagged_features(b, ["close", "volume"], 3).drop("volume")


@register(f"""{ONLY_TICKS}, m AS (SELECT event_id, symbol, ts, (bid + ask) / 2.0::DOUBLE AS m FROM ticks), a AS (SELECT event_id, symbol, avg(m) OVER b AS b, avg(m) OVER f AS f, count(*) OVER f AS n FROM m WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
SELECT event_id, symbol, CAST(CASE WHEN f / b - 1 > 0.002 THEN 1 WHEN f / b - 1 < -0.002 THEN -1 ELSE 0 END AS INTEGER) AS label FROM a WHERE n = 10""")
def q12_smoothed_mid_labels(spark, sf_dir):
    return X.deeplob_labels(ticks(spark, sf_dir)).select("event_id", "symbol", F.col("label").cast("int").alias("label"))


@register(f"""{ONLY_TICKS}, n AS (SELECT event_id, symbol, row_number() OVER w AS i, sum(px) OVER f AS s, sum(size) OVER f AS z FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT event_id, symbol, CAST(50 AS INTEGER) AS n, CAST(s AS DOUBLE) AS px_sum, CAST(z AS DOUBLE) AS size_sum FROM n WHERE i >= 50 AND (i - 50) % 10 = 0""")
def q12_tick_sequences(spark, sf_dir):
    """Sequences of fifty ticks with a stride of ten, and sums over them."""
    s = X.sequences(ticks(spark, sf_dir), ["px", "size"], 50, 10)
    total = lambda k: F.aggregate("sequence", F.lit(0.0), lambda a, x: a + F.get(x, F.lit(k)))
    return s.select("event_id", "symbol", F.size("sequence").alias("n"), total(0).alias("px_sum"), total(1).alias("size_sum"))


@register(f"""{BARS_SQL}, n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, floor(count(*) OVER (PARTITION BY symbol) * 0.5) AS s, count(*) OVER (PARTITION BY symbol) AS c FROM bars), f AS (SELECT *, greatest(floor((c - s) / 5), 1) AS z FROM n)
SELECT symbol, ts, CAST(CASE WHEN i < s THEN 0 ELSE least(floor((i - s) / z) + 1, 5) END AS INTEGER) AS fold FROM f""")
def q13_walk_forward_folds(spark, sf_dir):
    return X.walk_forward(hour_bars(spark, sf_dir)).select("symbol", "ts", "fold")


@register()
def q13_direction_model(spark, sf_dir):
    """Boosted-tree predictions of the next bar's direction in every fold, each by a model of the folds before it."""
    data, parts = _labelled(spark, sf_dir), None
    for k in range(1, 6):
        _, p = X.train_direction(data, _MODEL, "up", k, 3, 2)
        p = p.select("symbol", "ts", F.lit(k).alias("fold"), F.col("up").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))
        parts = p if parts is None else parts.unionByName(p)
    return parts


@register()
def q14_importances(spark, sf_dir):
    """Importance of each feature in the final model of all folds."""
    model, _ = X.train_direction(_labelled(spark, sf_dir), _MODEL, "up", 6, 3, 2)
    rows = [(n, round(float(v), 4)) for n, v in zip(_MODEL, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")


@register("""WITH p AS (SELECT doc_id, (doc_id * 37 % 101) / 101.0::DOUBLE AS u FROM labels), e AS (SELECT doc_id, u, 1 - u AS d, (u * 4 - (1 - u) * 3 - 0.5) / 4 AS l, ((1 - u) * 4 - u * 3 - 0.5) / 4 AS s FROM p)
SELECT doc_id, round(greatest(l, s), 6) AS ev, CAST(CASE WHEN greatest(l, s) > 0.15 THEN CASE WHEN l >= s THEN 1 ELSE -1 END ELSE 0 END AS INTEGER) AS direction, round(greatest(0, ((CASE WHEN l >= s THEN u ELSE d END) * (4.0 / 3 + 1) - 1) / (4.0::DOUBLE / 3)) / 4, 6) AS kelly FROM e""")
def q18_expected_value(spark, sf_dir):
    p = table(spark, sf_dir, "labels").select("doc_id", ((F.col("doc_id") * 37 % 101) / F.lit(101.0)).alias("u"))
    ev, way, kelly = X.expected_value(F.col("u"), 1 - F.col("u"), 4.0, 3.0, 0.5)
    return rounded(p.select("doc_id", ev.alias("ev"), way.alias("direction"), kelly.alias("kelly")), ["ev", "kelly"], 6)


@register(f"""{BARS_SQL}, r AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars),
f AS (SELECT symbol, ts, CASE WHEN count(r) OVER f >= 50 THEN stddev_samp(r) OVER f END AS vol, abs(sum(CASE WHEN close > open THEN volume ELSE 0 END) OVER f - sum(CASE WHEN close <= open THEN volume ELSE 0 END) OVER f) / greatest(sum(volume) OVER f, 1) AS ofi FROM r WINDOW f AS {frame(50)})
SELECT symbol, ts, round(vol, 4) AS vol, round(ofi, 4) AS ofi FROM f""")
def m01_regime_features(spark, sf_dir):
    return rounded(regime_features(hour_bars(spark, sf_dir)).select("symbol", "ts", "vol", "ofi"), ["vol", "ofi"])


@register()
def m06_change_points(spark, sf_dir):
    """Change points by two detectors and a volatility test, and where two of three agree within five bars."""
    from ..operators.regime import agreement

    return agreement(hour_bars(spark, sf_dir))


@register()
def m08_hysteresis(spark, sf_dir):
    """Filtered states with hysteresis and minimum stay."""
    from ..operators.regime import states

    return states(hour_bars(spark, sf_dir))


@register()
def m03_principal_components(spark, sf_dir):
    """Explained variance of the centred feature matrix's first components."""
    from ..operators.regime import explained_variance

    return explained_variance(table(spark, sf_dir, "embeddings"), "embedding", 5)


@register("""WITH l AS (SELECT (doc_id * 37 % 101 - 50) / 5.0::DOUBLE AS z, quality AS y FROM labels), g AS (SELECT i, ln(0.1) + (ln(10.0) - ln(0.1)) * i / 40 AS t FROM range(41) r(i)),
a AS (SELECT i, t, avg(greatest(z / exp(t), 0) - z / exp(t) * y + ln(1 + exp(-abs(z / exp(t))))) AS v FROM l, g GROUP BY i, t), b AS (SELECT arg_min(t, struct_pack(v := v, i := i)) AS t, (ln(10.0) - ln(0.1)) / 40 AS s FROM a),
e AS (SELECT greatest(t - s, ln(0.1)) AS lo, least(t + s, ln(10.0)) AS hi FROM b), h AS (SELECT i, lo + (hi - lo) * i / 40 AS t FROM e, range(41) r(i)), c AS (SELECT i, t, avg(greatest(z / exp(t), 0) - z / exp(t) * y + ln(1 + exp(-abs(z / exp(t))))) AS v FROM l, h GROUP BY i, t)
SELECT round(exp(arg_min(t, struct_pack(v := v, i := i))), 4) AS temperature FROM c""")
def q15_temperature(spark, sf_dir):
    """Temperature of least log loss."""
    p = table(spark, sf_dir, "labels").select(((F.col("doc_id") * 37 % 101 - 50) / F.lit(5.0)).alias("z"), F.col("quality").alias("y"))
    return spark.createDataFrame([(round(X.temperature(p, "z", "y"), 4),)], "temperature double")


_MODEL = ["ret_1", "ret_5", "range", "body", "vwap_dist", "vol_20", "bb_pct", "donchian_pos"]


def _labelled(spark, sf_dir):
    from pyspark.sql import Window

    b = hour_bars(spark, sf_dir)
    b = b.withColumn("up", (F.lead("close").over(Window.partitionBy("symbol").orderBy("ts")) > F.col("close")).cast("double")).where("up is not null")
    return X.walk_forward(X.bar_features(b)).select("symbol", "ts", "up", "fold", "embargoed", *_MODEL).na.drop(subset=_MODEL)


@register()
def q17_robustness(spark, sf_dir):
    """Accuracy of a model trained on the later half, on the earlier half, and against flipped labels."""
    return rounded(X.robustness(_labelled(spark, sf_dir), _MODEL, "up"), ["accuracy", "ones"])


@register()
def sg33_tick_predictor(spark, sf_dir):
    """The predictor's signal: a model of all folds but the last two, its temperature from the one before the last, signals in the last."""
    from pyspark.ml.functions import vector_to_array

    data = _labelled(spark, sf_dir)
    model, held = X.train_direction(data, _MODEL, "up", 4, 5)
    p = held.withColumn("_p", vector_to_array("probability")[1])
    t = X.temperature(p.withColumn("z", F.ln(F.greatest("_p", F.lit(1e-12)) / F.greatest(1 - F.col("_p"), F.lit(1e-12)))), "z", "up")
    from pyspark.ml.feature import VectorAssembler

    last = VectorAssembler(inputCols=_MODEL, outputCol="_x", handleInvalid="skip").transform(data.where("fold = 5"))
    return rounded(X.predictor_signal(model.transform(last), t), ["p_up", "ev", "kelly"])


@register()
def m02_detector_features(spark, sf_dir):
    """The seven scaled features of the regime detector."""
    from ..functions.regimes import NAMES, Config
    from ..operators.regime import regime_inputs

    return rounded(regime_inputs(hour_bars(spark, sf_dir), Config().small()), list(NAMES))


@register()
def m03_projection(spark, sf_dir):
    """Features on their principal axes, enough for 95 % of the variance."""
    from ..functions.regimes import NAMES, Config
    from ..operators.regime import projected, regime_inputs

    out = projected(regime_inputs(hour_bars(spark, sf_dir), Config().small()), list(NAMES))
    return out.select("symbol", "ts", F.transform("components", lambda x: F.round(x, 3)).alias("components"))


@register()
def m04_detector(spark, sf_dir):
    """Probabilities, regime in force, size and halt of each bar."""
    from ..operators.regime import detect

    return rounded(detect(hour_bars(spark, sf_dir)), ["regime_p_trending", "regime_p_ranging", "regime_p_highvol", "confidence"])


@register()
def m04_detector_student(spark, sf_dir):
    """The same with Student's densities."""
    from dataclasses import replace

    from ..functions.regimes import Config
    from ..operators.regime import detect

    return rounded(detect(hour_bars(spark, sf_dir), replace(Config().small(), emission="studentt")), ["regime_p_trending", "regime_p_ranging", "regime_p_highvol", "confidence"])


@register()
def m10_walk_forward(spark, sf_dir):
    """Statistics of refitted detectors on three spans after their training."""
    from ..operators.regime import walk_forward

    return rounded(walk_forward(hour_bars(spark, sf_dir)), ["avg_confidence", "halt_fraction", "avg_stint", "trending", "ranging", "high_vol"])


@register(f"""{BARS_SQL}, s AS (SELECT symbol, CAST(ts AS DATE) AS d, count(*) AS n_bars, avg(CASE WHEN close > open THEN 1.0::DOUBLE ELSE 0.4 END) AS c, avg(CASE WHEN volume > 60 THEN 1.0::DOUBLE ELSE 0.0 END) AS h, CAST(count(*) AS DOUBLE) / 3 AS st, avg(CASE WHEN high - low < 20 THEN 1.0::DOUBLE ELSE 0.0 END) AS r FROM bars GROUP BY ALL),
a AS (SELECT symbol, CAST(sum(n_bars) AS BIGINT) AS n_bars, avg(c) AS avg_confidence, avg(h) AS halt_fraction, avg(st) AS avg_stint, avg(r) AS ranging FROM s GROUP BY symbol)
SELECT symbol, n_bars, round(avg_confidence, 4) AS avg_confidence, round(halt_fraction, 4) AS halt_fraction, round(avg_stint, 4) AS avg_stint, round(ranging, 4) AS ranging,
  concat_ws(',', CASE WHEN n_bars < 500 THEN 'oos_bars < 500' END, CASE WHEN avg_confidence < 0.55 THEN 'confidence < 0.55' END, CASE WHEN avg_confidence > 0.95 THEN 'confidence > 0.95' END, CASE WHEN halt_fraction > 0.4 THEN 'halt_fraction > 0.4' END, CASE WHEN avg_stint < 3 THEN 'stint < 3' END, CASE WHEN ranging < 0.1 THEN 'ranging < 0.1' END, CASE WHEN ranging > 0.7 THEN 'ranging > 0.7' END) AS failed FROM a""")
def g24_retrain_gates(spark, sf_dir):
    """Gates on statistics of the splits (here of days) of each symbol."""
    from ..operators.regime import gates

    b = hour_bars(spark, sf_dir)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    s = b.groupBy("symbol", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n_bars"), F.avg(F.when(F.col("close") > F.col("open"), 1.0).otherwise(0.4)).alias("avg_confidence"), share(F.col("volume") > 60).alias("halt_fraction"), (F.count("*") / 3).alias("avg_stint"), share(F.col("high") - F.col("low") < 20).alias("ranging"))
    out = gates(s, ["symbol"]).withColumn("failed", F.array_join("failed", ",")).drop("passed")
    return rounded(out, ["avg_confidence", "halt_fraction", "avg_stint", "ranging"])
