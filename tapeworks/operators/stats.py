"""Statistical tests on log returns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K


def log_returns(bars: DataFrame, by: list[str], close: str = "close") -> DataFrame:
    """ret: log return from the row before; rows without one are left out."""
    w = Window.partitionBy(*by).orderBy("ts")
    return bars.withColumn("ret", F.ln(close) - F.ln(F.lag(close).over(w))).where("ret is not null")


def autocorrelation(returns: DataFrame, by: list[str], lags: list[int]) -> DataFrame:
    """acf at each lag, with the number of rows: one pass of lagged products against the mean."""
    mean = returns.groupBy(*by).agg(F.avg("ret").alias("_m"))
    w = Window.partitionBy(*by).orderBy("ts")
    d = returns.join(mean, by).withColumn("_d", F.col("ret") - F.col("_m")).select(*by, "ts", "_d")
    d = d.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in lags})
    sums = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_c{k}") for k in lags])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_c{k}"), F.col("_v")).alias("acf")) for k in lags])).alias("x")
    return sums.select(*by, "n", each).select(*by, "n", "x.lag", "x.acf")


def chi2_survival(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution, by the series or the continued fraction of the incomplete gamma."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def ljung_box(returns: DataFrame, by: list[str], lags: tuple[int, ...] = (1, 2, 5, 10, 20, 50)) -> DataFrame:
    """Q and p at each of the lags (left out where the lag is n - 1 or more)."""
    acf = autocorrelation(returns, by, list(range(1, max(lags) + 1)))
    w = Window.partitionBy(*by).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = acf.withColumn("q", F.col("n") * (F.col("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).over(w))

    @F.pandas_udf("double")
    def p(q: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chi2_survival(a, b) if a == a else None for a, b in zip(q, k, strict=True)], dtype=float)

    return q.where(F.col("lag").isin(list(lags)) & (F.col("lag") < F.col("n") - 1)).select(*by, "lag", "q", p("q", "lag").alias("p"))


def _per_series(returns: DataFrame, by: list[str], column: str, f: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    kinds = {x.name: x.dataType.simpleString() for x in returns.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")[column].to_numpy(float)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, **f(x)}])

    return returns.select(*by, "ts", column).groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + schema)


def hurst(returns: DataFrame, by: list[str], column: str = "ret") -> DataFrame:
    """Rescaled-range exponent, fluctuation exponent, and a class: below .45 reverting, above .55 trending."""

    def f(x: np.ndarray) -> dict:
        h = K.hurst_rs(x)
        return {"hurst": h, "dfa": K.dfa(x), "kind": "mean_reverting" if h < 0.45 else "trending" if h > 0.55 else "random_walk"}

    return _per_series(returns, by, column, f, "hurst double, dfa double, kind string")


#: Large-sample critical values of the test with a constant, at 1, 5 and 10 percent (public tables).
ADF_CRITICAL = {"1%": -3.43, "5%": -2.86, "10%": -2.57}


#: Quantiles of the statistic with a constant in large samples (public tables), for p-values between them.
_ADF_TABLE = ((-3.43, 0.01), (-3.12, 0.025), (-2.86, 0.05), (-2.57, 0.10), (-1.57, 0.50), (-0.44, 0.90), (-0.07, 0.95), (0.23, 0.975), (0.60, 0.99))


def adf_p(t: float) -> float:
    """p of the statistic, by straight lines between tabled quantiles; 0.01 and 0.99 stand for what lies beyond."""
    return float(np.interp(t, [a for a, _ in _ADF_TABLE], [p for _, p in _ADF_TABLE]))


def adf(series: DataFrame, by: list[str], column: str, most: int = 12) -> DataFrame:
    """Augmented Dickey-Fuller t statistic; lags by the information criterion."""

    def f(y: np.ndarray) -> dict:
        best = (math.inf, 0.0, 0)
        top = min(most, max(0, len(y) // 4 - 2))
        d = np.diff(y)
        for k in range(top + 1):
            rows = len(d) - top
            if rows < k + 4:
                break
            x = np.column_stack([np.ones(rows), y[top : top + rows], *[d[top - j : top - j + rows] for j in range(1, k + 1)]])
            t = d[top:]
            beta, *_ = np.linalg.lstsq(x, t, rcond=None)
            r = t - x @ beta
            s2 = r @ r / max(1, rows - x.shape[1])
            aic = rows * math.log(max(r @ r / rows, 1e-300)) + 2 * x.shape[1]
            cov = s2 * np.linalg.pinv(x.T @ x)
            if aic < best[0]:
                best = (aic, float(beta[1] / math.sqrt(max(cov[1, 1], 1e-300))), k)
        return {"statistic": best[1], "lags": best[2], "p": adf_p(best[1]), "stationary": best[1] < ADF_CRITICAL["5%"]}

    return _per_series(series, by, column, f, "statistic double, lags int, p double, stationary boolean")


def ks_normal(returns: DataFrame, by: list[str]) -> DataFrame:
    """Largest distance of standardised returns (population deviation) from the normal distribution, and its asymptotic p."""
    m = returns.groupBy(*by).agg(F.avg("ret").alias("_m"), F.stddev_pop("ret").alias("_s"), F.count("*").alias("n"))

    @F.pandas_udf("double")
    def phi(z: pd.Series) -> pd.Series:
        return 0.5 + 0.5 * pd.Series(np.frompyfunc(math.erf, 1, 1)(z.to_numpy() / math.sqrt(2)).astype(float))

    w = Window.partitionBy(*by).orderBy("ret", "ts")
    z = returns.join(m, by).where("_s > 0").withColumn("_k", F.row_number().over(w)).withColumn("_p", phi((F.col("ret") - F.col("_m")) / F.col("_s")))
    out = z.groupBy(*by).agg(F.max(F.greatest(F.col("_k") / F.col("n") - F.col("_p"), F.col("_p") - (F.col("_k") - 1) / F.col("n"))).alias("d"), F.max("n").alias("n"))
    each = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * F.col("n") * F.col("d") * F.col("d")))
    return out.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x))))


def ar1(returns: DataFrame, by: list[str]) -> DataFrame:
    """Slope of the return on the one before, its t statistic, and mean reversion (the slope's negative)."""
    w = Window.partitionBy(*by).orderBy("ts")
    df = returns.withColumn("_x", F.lag("ret").over(w)).where("_x is not null")
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("ret", "_x").alias("slope"), F.regr_r2("ret", "_x").alias("r2"))
    return out.withColumn("t", F.when(F.col("r2") < 1, F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))))).withColumn("mean_reversion", -F.col("slope"))


def crossing(points: DataFrame, x: str, y: str) -> DataFrame:
    """Where y first falls from above zero to zero or below, between neighbouring x."""
    w = Window.orderBy(x)
    df = points.withColumn("_nx", F.lead(x).over(w)).withColumn("_ny", F.lead(y).over(w)).where((F.col(y) > 0) & (F.col("_ny") <= 0))
    at = F.col(x) + (F.col("_nx") - F.col(x)) * F.col(y) / (F.col(y) - F.col("_ny"))
    return df.orderBy(x).limit(1).select(at.alias("crossing"))


#: Windows of the scale analysis.
SCALES = ("30 seconds", "2 minutes", "5 minutes", "15 minutes", "30 minutes", "1 hour")


def hurst_by_window(bars: DataFrame, by: list[str], windows: tuple[str, ...] = SCALES, least: int = 100) -> DataFrame:
    """by, window, n, hurst and kind of the returns of bars made coarser to each window; null below ``least`` returns."""
    from .bars import resample

    parts = None
    for w in windows:
        r = log_returns(resample(bars, w, by=tuple(by)), by).select(*by, "ts", "ret").withColumn("window", F.lit(w))
        parts = r if parts is None else parts.unionByName(r)

    def f(x: np.ndarray) -> dict:
        h = K.hurst_rs(x) if len(x) >= least else None
        return {"n": len(x), "hurst": h, "kind": "insufficient-data" if h is None else "mean-reverting" if h < 0.45 else "trending" if h > 0.55 else "random-walk"}

    return _per_series(parts, [*by, "window"], "ret", f, "n long, hurst double, kind string")


def ar1_by_window(bars: DataFrame, by: list[str], windows: tuple[str, ...] = SCALES) -> DataFrame:
    """by, window, n, slope, t and mean reversion of the returns of bars made coarser."""
    from .bars import resample

    parts = None
    for w in windows:
        r = log_returns(resample(bars, w, by=tuple(by)), by).select(*by, "ts", "ret").withColumn("window", F.lit(w))
        parts = r if parts is None else parts.unionByName(r)
    return ar1(parts, [*by, "window"])


def segmented_report(bars: DataFrame, lags: tuple[int, ...] = (1, 2, 5, 10, 20), windows: tuple[str, ...] = SCALES, least: int = 100) -> DataFrame:
    """The scale analysis of all bars and of each segment of the session, as rows (segment, symbol, measure, at, value).

    Measures: bars, acf at a lag and whether it is beyond 1.96 / sqrt(n), hurst and ar1 (mean reversion) at a window.
    """
    from ..functions.timeutil import segment

    both = bars.withColumn("segment", F.lit("all")).unionByName(bars.withColumn("segment", segment(F.col("ts"))).where("segment is not null"))
    by = ["segment", "symbol"]
    acf = autocorrelation(log_returns(both, by).select(*by, "ts", "ret"), by, list(lags))
    row = lambda df, measure, at, value: df.select(*by, F.lit(measure).alias("measure"), at.cast("string").alias("at"), value.cast("double").alias("value"))
    out = row(both.groupBy(*by).agg(F.count("*").alias("n")), "bars", F.lit(""), F.col("n"))
    out = out.unionByName(row(acf, "acf", F.col("lag"), F.col("acf"))).unionByName(row(acf, "acf_significant", F.col("lag"), (F.abs("acf") > 1.96 / F.sqrt("n")).cast("int")))
    out = out.unionByName(row(hurst_by_window(both, by, windows, least), "hurst", F.col("window"), F.col("hurst")))
    return out.unionByName(row(ar1_by_window(both, by, windows), "mean_reversion", F.col("window"), F.col("mean_reversion")))
