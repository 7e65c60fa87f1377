"""Regime models: change points, hidden states, hysteresis, components.

A symbol's bars are the unit of work (see ``recursive``).  Models are fitted on a
symbol's first bars and then only filter forward, so no row depends on a later one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import regimes as M
from ..functions.windows import last_n, zscore
from .recursive import series
from .signals import BY

_BAR = ["open", "high", "low", "close", "volume"]


def _returns(close: np.ndarray) -> np.ndarray:
    return np.r_[0.0, np.diff(np.log(np.maximum(close, 1e-9)))]


def agreement(bars: DataFrame, within: int = 5, scale: int = 500) -> DataFrame:
    """bocpd, cusum, vol flags of each bar, and whether two of three fired within the last bars; returns are rolling z-scores."""

    def f(a: dict) -> dict:
        r = _returns(a["close"])
        x = np.nan_to_num(M.scaled(r[:, None], scale)[:, 0])
        return {"bocpd": K.bocpd(x).astype(float), "cusum": K.cusum(x, 0.5, 4.0).astype(float), "_r": np.abs(r)}

    df = series(bars.select("symbol", "ts", "close"), ["close"], ["bocpd", "cusum", "_r"], f)
    df = df.withColumn("vol", F.coalesce((F.abs(zscore("_r", 50, BY)) > 2).cast("double"), F.lit(0.0)))
    w = last_n(BY, within)
    votes = sum((F.max(c).over(w) for c in ("cusum", "vol")), F.max("bocpd").over(w))
    return df.select("symbol", "ts", F.col("bocpd").cast("int").alias("bocpd"), F.col("cusum").cast("int").alias("cusum"), F.col("vol").cast("int").alias("vol"), (votes >= 2).alias("change"))


def regime_inputs(bars: DataFrame, cfg: M.Config = M.Config()) -> DataFrame:
    """symbol, ts and the scaled features of the detector (null until all windows are full)."""
    names = list(M.NAMES[: 4 if cfg.tier == "t1" else 7])

    def f(a: dict) -> dict:
        out = np.full((len(a["close"]), len(names)), np.nan)
        z, at = M.features(a, cfg)
        out[at] = z
        return dict(zip(names, out.T, strict=True))

    return series(bars.select("symbol", "ts", *_BAR), _BAR, names, f).select("symbol", "ts", *names)


def detect(bars: DataFrame, cfg: M.Config | None = None, fit_rows: int = 100) -> DataFrame:
    """Probabilities, regime in force, size and halt of each bar; the model of each symbol is fitted on its first bars."""
    cfg = cfg or M.Config().small()
    names = list(M.OUT)
    df = series(bars.select("symbol", "ts", *_BAR), _BAR, names, lambda a: dict(zip(names, M.detected(a, cfg, fit_rows).T, strict=True)))
    out = df.select("symbol", "ts", *[F.col(c).alias(f"regime_{c}") if c.startswith("p_") or c == "bars_in" else c for c in names])
    size = F.when(F.col("size") == 1.0, "full").when(F.col("size") == 0.5, "half").otherwise("flat")
    return out.withColumns({"regime": F.col("regime").cast("int"), "changed": F.col("changed") > 0, "halt": F.col("halt") > 0, "size": size})


def train(bars: DataFrame, cfg: M.Config | None = None) -> DataFrame:
    """One row a symbol with its fitted model, as JSON: the only form in which models are kept."""
    from ..sources.models import to_json

    cfg = cfg or M.Config().small()

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table["ts"]))
        z, _ = M.features({c: pc.cast(table[c], pa.float64()).to_numpy().astype(float) for c in _BAR}, cfg)
        ok = len(z) >= 10 * cfg.states
        return pa.table({"symbol": table["symbol"].slice(0, 1), "rows": pa.array([len(z)], pa.int64()), "model": pa.array([to_json(M.fit(z, cfg)) if ok else None], pa.string())})

    return bars.select("symbol", "ts", *_BAR).groupBy("symbol").applyInArrow(run, "symbol string, rows long, model string")


def apply_models(bars: DataFrame, models: DataFrame) -> DataFrame:
    """symbol, ts, probabilities and regime of bars by stored models (symbol, model); symbols without one are left out."""
    from ..sources.models import from_json

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table["ts"]))
        model = from_json(table["model"][0].as_py())
        z, at = M.features({c: pc.cast(table[c], pa.float64()).to_numpy().astype(float) for c in _BAR}, model.cfg)
        p = model.probabilities(z) if len(z) else np.empty((0, 3))
        out = M.decided(p, z, model.cfg) if len(z) else np.empty((0, len(M.OUT)))
        rows = table.select(["symbol", "ts"]).take(pa.array(at, pa.int64()))
        for k, c in enumerate(("p_trending", "p_ranging", "p_highvol")):
            rows = rows.append_column(c, pa.array(p[:, k], pa.float64()))
        return rows.append_column("regime", pa.array(out[:, 3].astype(np.int32), pa.int32())).append_column("confidence", pa.array(out[:, 4], pa.float64()))

    kind = bars.schema["ts"].dataType.simpleString()
    rows = bars.select("symbol", "ts", *_BAR).join(F.broadcast(models.where("model is not null").select("symbol", "model")), "symbol")
    return rows.groupBy("symbol").applyInArrow(run, f"symbol string, ts {kind}, p_trending double, p_ranging double, p_highvol double, regime int, confidence double")


def walk_forward(bars: DataFrame, splits: int = 3, cfg: M.Config | None = None, least: int = 60) -> DataFrame:
    """Statistics of each symbol and split: the model is fitted on all before the split and filters it.

    n_bars, avg_confidence, halt_fraction, avg_stint, trending, ranging, high_vol.
    """
    cfg = cfg or M.Config().small()

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table["ts"]))
        z, _ = M.features({c: pc.cast(table[c], pa.float64()).to_numpy().astype(float) for c in _BAR}, cfg)
        rows, size = [], (len(z) - least) // splits if len(z) > least else 0
        for k in range(splits if size >= 10 else 0):
            lo = least + k * size
            hi = lo + size if k < splits - 1 else len(z)
            out = M.decided(M.fit(z[:lo], cfg).probabilities(z[:hi]), z[:hi], cfg)[lo:]
            state = out[:, 3].astype(int)
            stints = 1 + int((state[1:] != state[:-1]).sum())
            rows.append((k, len(out), float(out[:, 4].mean()), float(out[:, 8].mean()), len(out) / stints, *[float((state == s).mean()) for s in range(3)]))
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
        kinds = [pa.int32(), pa.int64(), *[pa.float64()] * 6]
        symbol = pa.array([table["symbol"][0].as_py()] * len(rows), pa.string())
        return pa.table([symbol, *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["symbol", "split", "n_bars", "avg_confidence", "halt_fraction", "avg_stint", "trending", "ranging", "high_vol"])

    return bars.select("symbol", "ts", *_BAR).groupBy("symbol").applyInArrow(run, "symbol string, split int, n_bars long, avg_confidence double, halt_fraction double, avg_stint double, trending double, ranging double, high_vol double")


#: Fixed values: (name, statistic, lower bound, upper bound) of the gates that a retrained model has to pass.
GATES = (("oos_bars", "n_bars", 500.0, None), ("confidence", "avg_confidence", 0.55, 0.95), ("halt_fraction", "halt_fraction", None, 0.40), ("stint", "avg_stint", 3.0, None), ("ranging", "ranging", 0.10, 0.70))


def gates(stats: DataFrame, by: list[str], bounds=GATES) -> DataFrame:
    """by, the statistics over all splits (bars summed, the others averaged), failed array<string> and passed."""
    agg = [(F.sum(c) if c == "n_bars" else F.avg(c)).alias(c) for _, c, _, _ in bounds]
    df = stats.groupBy(*by).agg(*agg)
    reasons = []
    for name, c, low, high in bounds:
        reasons += [F.when(F.col(c) < low, F.lit(f"{name} < {low:g}"))] if low is not None else []
        reasons += [F.when(F.col(c) > high, F.lit(f"{name} > {high:g}"))] if high is not None else []
    return df.withColumn("failed", F.array_compact(F.array(*reasons))).withColumn("passed", F.size("failed") == 0)


def states(bars: DataFrame, fit_rows: int = 100, cfg: M.Config | None = None) -> DataFrame:
    """State in force and confidence of each bar; -1 before the model is fitted."""
    out = detect(bars, cfg, fit_rows)
    return out.select("symbol", "ts", F.when(F.col("confidence") > 0, F.col("regime")).otherwise(-1).alias("state"), F.round("confidence", 4).alias("confidence"))


def explained_variance(df: DataFrame, column: str, k: int) -> DataFrame:
    """Share of variance of the first k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(df.select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("_x")))
    rows = [(i, float(x)) for i, x in enumerate(model.explainedVariance.toArray())]
    return df.sparkSession.createDataFrame(rows, "component int, share double")


def projected(df: DataFrame, columns: list[str], variance: float = 0.95) -> DataFrame:
    """``df`` with ``components array<double>``: the rows on the fewest principal axes that explain so much of the variance.

    The axes come from one aggregate of the columns' products, so only a small matrix is collected.
    """
    df = df.na.drop(subset=columns)
    n = len(columns)
    sums = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    if not sums["n"] or sums["n"] < 2:
        return df.withColumn("components", F.array().cast("array<double>"))
    cov = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    value, axes = np.linalg.eigh(cov)
    value, axes = value[::-1], axes[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(n)])
    keep = int(np.searchsorted(np.cumsum(value) / value.sum(), variance)) + 1
    part = lambda k: sum(((F.col(c) - sums[f"m{i}"]) * float(axes[i, k]) for i, c in enumerate(columns)), F.lit(0.0))
    return df.withColumn("components", F.array(*[part(k) for k in range(min(keep, n))]))
