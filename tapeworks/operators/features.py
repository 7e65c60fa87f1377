"""Labels and features of the direction predictor, and its model.

Features are lagged by one bar, so none sees the bar it is used on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import last_n, ordered, rolling, running, zscore

BY = ["symbol"]
TICK = 0.25


def triple_barrier(bars: DataFrame, horizon: int, take: float, stop: float, vol_n: int, clip: tuple[float, float], touch: str = "close", by: list[str] | None = None) -> DataFrame:
    """label (1, 0, -1), offset, reason, weight: the first barrier that the next ``horizon`` bars touch.

    Barriers are ticks times the rolling volatility over its median, clipped.
    ``touch`` ``close`` looks at closes; ``range`` at highs and lows, and if both are
    touched the close decides ("both").  Without a touch the sign of the move counts.
    """
    by = by or BY
    o = Window.partitionBy(*by).orderBy("ts")
    df = bars.withColumn("_r", F.ln("close") - F.ln(F.lag("close").over(o)))
    df = df.withColumn("_v", rolling(F.stddev_samp, "_r", vol_n, by))
    median = df.groupBy(*by).agg(F.median("_v").alias("_mv"))
    df = df.join(median, by)
    scale = F.when(F.col("_v").isNotNull() & (F.col("_mv") > 0), F.greatest(F.least(F.col("_v") / F.col("_mv"), F.lit(clip[1])), F.lit(clip[0]))).otherwise(1.0)
    ahead = o.rowsBetween(1, horizon)
    df = df.withColumn("_up", F.col("close") + take * TICK * scale).withColumn("_dn", F.col("close") - stop * TICK * scale)
    df = df.withColumn("_path", F.collect_list(F.struct("close", "high", "low")).over(ahead)).where(F.size("_path") == horizon)

    def step(x: Column, i: Column) -> Column:
        hi, lo = (x["close"], x["close"]) if touch == "close" else (x["high"], x["low"])
        up, dn = hi >= F.col("_up"), lo <= F.col("_dn")
        label = F.when(up & dn, F.when(x["close"] >= F.col("close"), 1).otherwise(-1)).when(up, 1).when(dn, -1)
        return F.struct(label.alias("label"), (i + 1).alias("offset"), F.when(up & dn, "both").when(up, "tp").when(dn, "sl").alias("reason"))

    hit = F.get(F.filter(F.transform("_path", step), lambda s: s["label"].isNotNull()), F.lit(0))
    move = F.element_at("_path", -1)["close"] - F.col("close")
    df = df.withColumn("_hit", hit)
    label = F.coalesce("_hit.label", F.signum(move).cast("int"))
    weight = F.when(F.col("_hit").isNotNull(), 1.0).otherwise(F.least(F.lit(1.0), F.abs(move) / (take * TICK)))
    return df.select(*by, "ts", label.cast("byte").alias("label"), F.coalesce("_hit.offset", F.lit(horizon)).cast("short").alias("offset"), F.coalesce("_hit.reason", F.lit("vertical")).alias("reason"), weight.cast("float").alias("weight"))


def _lagged(df: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    w = ordered(by)
    keep = [c for c in df.columns if not c.startswith("_") and c not in names]
    return df.select(*keep, *[F.lag(n).over(w).alias(n) for n in names])


BAR_FEATURES = ["ret_1", "ret_5", "ret_20", "range", "body", "upper_wick", "lower_wick", "vol_20", "vol_ratio", "volume_z", "delta_share", "cvd_slope", "spread_z", "close_z", "bb_pct", "rsi_mean", "vwap_dist", "autocorr", "up_share", "donchian_pos", "tod_sin", "tod_cos"]


def bar_features(bars: DataFrame, n: int = 20, z: int = 100, by: list[str] | None = None) -> DataFrame:
    """Price, volume, flow and clock features of bars; all are those of the bar before."""
    by = by or BY
    o = ordered(by)
    c, v = F.col("close"), F.col("volume")
    back = lambda k: F.ln(c) - F.ln(F.lag("close", k).over(o))
    df = bars.withColumns({"ret_1": back(1), "ret_5": back(5), "ret_20": back(20), "range": F.col("high") - F.col("low"), "body": c - F.col("open"), "upper_wick": F.col("high") - F.greatest("open", "close"), "lower_wick": F.least("open", "close") - F.col("low"), "_i": F.row_number().over(o), "_ch": c - F.lag("close").over(o)})
    df = df.withColumns({"vol_20": rolling(F.stddev_samp, "ret_1", n, by), "_vol5": rolling(F.stddev_samp, "ret_1", 5, by), "volume_z": zscore(v.cast("double"), n, by), "delta_share": F.try_divide(F.col("buy_volume") - F.col("sell_volume"), v).cast("double"), "_cvd": F.sum(F.col("buy_volume") - F.col("sell_volume")).over(running(by)).cast("double"), "_up": F.greatest("_ch", F.lit(0.0)), "_dn": F.greatest(-F.col("_ch"), F.lit(0.0)), "_pr": F.lag("ret_1").over(o)})
    m, s = rolling(F.avg, "close", n, by), rolling(F.stddev_samp, "close", n, by)
    w = last_n(by, n)
    up, down = rolling(F.avg, "_up", 14, by), rolling(F.avg, "_dn", 14, by)
    hi, lo = rolling(F.max, "high", n, by), rolling(F.min, "low", n, by)
    angle = (F.hour("ts") * 60 + F.minute("ts")) / F.lit(1440.0) * F.lit(2 * math.pi)
    df = df.withColumns({
        "vol_ratio": F.when(F.col("vol_20") > 1e-12, F.col("_vol5") / F.col("vol_20")),
        "cvd_slope": F.when(F.count("_cvd").over(w) >= n, F.regr_slope("_cvd", "_i").over(w)),
        "spread_z": zscore(F.col("avg_ask") - F.col("avg_bid"), n, by, limit=3.0),
        "close_z": zscore("close", n, by, limit=3.0),
        "bb_pct": F.when(s > 1e-10, (c - (m - 2 * s)) / (4 * s)),
        "rsi_mean": F.when(down < 1e-10, F.lit(100.0)).otherwise(100 - 100 / (1 + up / F.greatest(down, F.lit(1e-10)))),
        "vwap_dist": c - F.col("vwap"),
        "autocorr": F.when(F.count("_pr").over(w) >= n, F.corr("ret_1", "_pr").over(w)),
        "up_share": rolling(F.avg, (F.col("_ch") > 0).cast("double"), n, by),
        "donchian_pos": F.when(hi > lo, (c - lo) / (hi - lo)),
        "tod_sin": F.sin(angle),
        "tod_cos": F.cos(angle),
    })
    return _lagged(df, BAR_FEATURES, by)


def lagged_features(df: DataFrame, columns: list[str], lags: int, by: list[str] | None = None) -> DataFrame:
    """Each column at the last ``lags`` rows."""
    o = ordered(by or BY)
    return df.select("*", *[F.lag(c, k).over(o).alias(f"{c}_lag{k}") for k in range(1, lags + 1) for c in columns])


def deeplob_labels(ticks: DataFrame, k: int = 10, alpha: float = 0.002, by: list[str] | None = None) -> DataFrame:
    """Smoothed-mid label: mean of the next k mids over the mean of the last k, beyond alpha either way."""
    o = ordered(by or BY)
    mid = (F.col("bid") + F.col("ask")) / 2
    df = ticks.withColumn("_m", mid).withColumn("_b", F.avg("_m").over(o.rowsBetween(-(k - 1), 0))).withColumn("_f", F.avg("_m").over(o.rowsBetween(1, k))).withColumn("_n", F.count("_m").over(o.rowsBetween(1, k)))
    change = F.col("_f") / F.col("_b") - 1
    return df.where(F.col("_n") == k).withColumn("label", F.when(change > alpha, 1).when(change < -alpha, -1).otherwise(0)).drop("_m", "_b", "_f", "_n")


def sequences(ticks: DataFrame, columns: list[str], length: int, stride: int, by: list[str] | None = None) -> DataFrame:
    """Every ``stride``-th row with its last ``length`` rows as array<array<double>>."""
    by = by or BY
    o = ordered(by)
    row = F.array(*[F.col(c).cast("double") for c in columns])
    df = ticks.withColumn("_i", F.row_number().over(o)).withColumn("sequence", F.collect_list(row).over(o.rowsBetween(-(length - 1), 0)))
    return df.where((F.col("_i") >= length) & ((F.col("_i") - length) % stride == 0)).drop("_i")


def walk_forward(df: DataFrame, folds: int = 5, train_share: float = 0.5, embargo: int = 20, by: list[str] | None = None) -> DataFrame:
    """fold (0: only ever trained on) and the first row to test, by position: expanding windows with an embargo before each test."""
    by = by or BY
    n = F.count("*").over(Window.partitionBy(*by))
    i = F.row_number().over(ordered(by)) - 1
    start = F.floor(n * train_share)
    size = F.greatest(F.floor((n - start) / folds), F.lit(1))
    fold = F.when(i < start, 0).otherwise(F.least(F.floor((i - start) / size) + 1, F.lit(folds)))
    df = df.withColumn("_i", i).withColumn("fold", fold.cast("int"))
    return df.withColumn("embargoed", (F.col("_i") >= start - embargo) & (F.col("fold") == 0) | (F.col("fold") > 0) & ((F.col("_i") - start) % size >= size - embargo)).drop("_i")


def train_direction(data: DataFrame, features: list[str], label: str, fold: int, rounds: int = 10, depth: int = 3):
    """A boosted-tree classifier trained on the folds before ``fold``; (model, predictions of that fold)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(data)
    model = GBTClassifier(labelCol=label, featuresCol="_x", maxIter=rounds, maxDepth=depth, seed=7).fit(ready.where((F.col("fold") < fold) & ~F.col("embargoed")))
    return model, model.transform(ready.where(F.col("fold") == fold))


def temperature(predictions: DataFrame, logit: str, label: str, steps: int = 40) -> float:
    """The temperature in [0.1, 10] of least log loss: one aggregate over a grid of them, one over a finer grid around the best."""
    z, y = F.col(logit), F.col(label).cast("double")

    def best(low: float, high: float) -> int:
        losses = []
        for i in range(steps + 1):
            s = z / F.lit(math.exp(low + (high - low) * i / steps))
            losses.append(F.avg(F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))))
        row = predictions.agg(*[x.alias(f"l{i}") for i, x in enumerate(losses)]).first()
        return min(range(steps + 1), key=lambda i: (row[i] if row[i] is not None else 0.0, i))

    low, high = math.log(0.1), math.log(10.0)
    step = (high - low) / steps
    at = low + step * best(low, high)
    low, high = max(low, at - step), min(high, at + step)
    return math.exp(low + (high - low) / steps * best(low, high))


def calibrated(p: Column, t: float) -> Column:
    """A probability whose logit is divided by a temperature."""
    z = F.ln(F.greatest(p, F.lit(1e-12)) / F.greatest(1 - p, F.lit(1e-12)))
    return 1 / (1 + F.exp(-z / F.lit(t)))


def predictor_signal(scored: DataFrame, t: float, take: float = 8.0, stop: float = 6.0, cost: float = 1.0, least: float = 0.15) -> DataFrame:
    """symbol, ts, p_up, ev, direction and kelly of a model's predictions (``probability`` of pyspark.ml)."""
    from pyspark.ml.functions import vector_to_array

    up = calibrated(vector_to_array("probability")[1], t)
    ev, way, kelly = expected_value(F.col("p_up"), 1 - F.col("p_up"), take, stop, cost, least)
    return scored.withColumn("p_up", up).select("symbol", "ts", "p_up", ev.alias("ev"), way.cast("int").alias("direction"), kelly.alias("kelly"))


def robustness(data: DataFrame, features: list[str], label: str, by: list[str] | None = None, rounds: int = 5) -> DataFrame:
    """Accuracy and share of ones of a model on rows it hasn't seen: trained on the later half and tested on the earlier one, forward, and forward with flipped labels.

    A model that has learnt something gives about one less its accuracy on flipped labels.
    """
    half = F.percent_rank().over(Window.partitionBy(*(by or BY)).orderBy("ts")) >= 0.5
    df = data.withColumn("_late", half)
    parts = None
    for name, late, flip in (("reverse", True, False), ("forward", False, False), ("flipped", False, True)):
        rows = df.withColumn("fold", F.when(F.col("_late") == late, 0).otherwise(1)).withColumn("embargoed", F.lit(False))
        _, p = train_direction(rows.withColumn("_y", F.col(label)), features, "_y", 1, rounds)
        truth = 1 - F.col("_y") if flip else F.col("_y")
        part = p.agg(F.count("*").alias("n"), F.avg((F.col("prediction") == truth).cast("double")).alias("accuracy"), F.avg(truth).alias("ones")).select(F.lit(name).alias("test"), "n", "accuracy", "ones")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def expected_value(up: Column, down: Column, take: float, stop: float, cost: float, least: float = 0.15) -> tuple[Column, Column, Column]:
    """(ev in units of the target, direction, quarter Kelly) of class probabilities."""
    long = (up * take - down * stop - cost) / take
    short = (down * take - up * stop - cost) / take
    ev = F.greatest(long, short)
    odds = take / stop
    p = F.when(long >= short, up).otherwise(down)
    kelly = F.greatest(F.lit(0.0), (p * (odds + 1) - 1) / odds) / 4
    return ev, F.when(ev > least, F.when(long >= short, 1).otherwise(-1)).otherwise(0), kelly
