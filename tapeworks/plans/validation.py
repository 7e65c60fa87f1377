"""Validation and statistics queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import stats as T
from ..operators import validation as V
from .base import BARS_SQL, hour_bars, rounded

_RET = f"{BARS_SQL}, r AS (SELECT symbol, ts, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS ret FROM bars), q AS (SELECT * FROM r WHERE ret IS NOT NULL)"
_DAILY = f"{BARS_SQL}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(close - open) AS ret FROM bars GROUP BY ALL)"


def _returns(spark, sf_dir):
    return T.log_returns(hour_bars(spark, sf_dir), ["symbol"]).select("symbol", "ts", "ret")


def _daily(spark, sf_dir):
    return hour_bars(spark, sf_dir).groupBy("symbol", F.col("ts").cast("date").alias("day")).agg(F.sum(F.col("close") - F.col("open")).alias("ret"))


@register(f"""{BARS_SQL}, c AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM bars), n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM c),
g AS (SELECT *, CASE WHEN i < (n // 8 + 1) * (n % 8) THEN i // (n // 8 + 1) ELSE (n % 8) + (i - (n // 8 + 1) * (n % 8)) // (n // 8) END AS g FROM n),
p AS (SELECT a.g AS a, b.g AS b, row_number() OVER (ORDER BY a.g, b.g) - 1 AS fold FROM (SELECT DISTINCT g FROM g) a JOIN (SELECT DISTINCT g FROM g) b ON a.g < b.g)
SELECT CAST(fold AS INTEGER) AS fold_id, count(*) AS n_test, min(day) AS first, max(day) AS last FROM p JOIN g ON g.g = p.a OR g.g = p.b GROUP BY fold""")
def c01_cpcv_tests(spark, sf_dir):
    """Test days of the 28 folds of eight groups, two at a time."""
    days = hour_bars(spark, sf_dir).select(F.col("ts").cast("date").alias("day")).distinct()
    m = V.fold_membership(spark, days).where("role = 'test'")
    return m.groupBy("fold_id").agg(F.count("*").alias("n_test"), F.min("day").alias("first"), F.max("day").alias("last"))


@register()
def c01_cpcv_membership(spark, sf_dir):
    """Role of every day in every fold, purged and embargoed."""
    days = hour_bars(spark, sf_dir).select(F.col("ts").cast("date").alias("day")).distinct()
    return V.fold_membership(spark, days)


@register()
def c02_fold_sharpe(spark, sf_dir):
    """Sharpe ratios of each fold's train and test days, in one job."""
    from ..operators.metrics import sharpe

    d = _daily(spark, sf_dir).groupBy("day").agg(F.sum("ret").alias("ret"))
    m = V.fold_membership(spark, d.select("day").distinct())
    return rounded(m.join(d, "day").groupBy("fold_id", "role").agg(F.count("*").alias("n"), sharpe(F.col("ret")).alias("sharpe")), ["sharpe"])


_FOLD_SQL = f"{_DAILY}, f AS (SELECT symbol AS fold, avg(ret) FILTER (day(day) % 2 = 0) AS is_sharpe, avg(ret) FILTER (day(day) % 2 = 1) AS oos_sharpe, count(*) AS n_trades FROM d GROUP BY symbol)"


def _folds(spark, sf_dir):
    even = F.day("day") % 2 == 0
    return _daily(spark, sf_dir).groupBy(F.col("symbol").alias("fold")).agg(F.avg(F.when(even, F.col("ret"))).alias("is_sharpe"), F.avg(F.when(~even, F.col("ret"))).alias("oos_sharpe"), F.count("*").alias("n_trades"))


@register(f"{_FOLD_SQL}, m AS (SELECT median(is_sharpe) AS mi, median(oos_sharpe) AS mo FROM f) SELECT round(avg(CASE WHEN (is_sharpe > mi) <> (oos_sharpe > mo) THEN 1.0 ELSE 0.0 END), 6) AS pbo, avg(CASE WHEN (is_sharpe > mi) <> (oos_sharpe > mo) THEN 1.0 ELSE 0.0 END) < 0.10 AS passes FROM f, m")
def c03_pbo(spark, sf_dir):
    return rounded(V.pbo(_folds(spark, sf_dir)), ["pbo"], 6)


@register("WITH w AS (SELECT unnest(range((500 - 63 - 21) // 21 + 1)) AS i) SELECT CAST(i AS INTEGER) AS cycle, CAST(i * 21 AS INTEGER) AS train_first, CAST(i * 21 + 63 AS INTEGER) AS test_first, CAST(i * 21 + 84 AS INTEGER) AS test_end FROM w")
def c04_walk_forward_windows(spark, sf_dir):
    rows = [(c, a, d, e) for c, a, _, d, e in V.wfa_windows(500)]
    return spark.createDataFrame(rows, "cycle int, train_first int, test_first int, test_end int")


_RES = f"{_DAILY}, p AS (SELECT unnest(range(4)) AS param_id), r AS (SELECT week(day) AS cycle, param_id, round(sum(ret * ((hash_k + param_id) % 3)), 4) AS is_sharpe, count(*) AS n FROM (SELECT *, day(day) AS hash_k FROM d), p GROUP BY ALL)"


def _results(spark, sf_dir):
    d = _daily(spark, sf_dir)
    p = V.grid(spark, {"k": [0, 1, 2, 3]})
    out = d.join(F.broadcast(p)).groupBy(F.weekofyear("day").cast("long").alias("cycle"), "param_id").agg(F.sum(F.col("ret") * ((F.day("day") + F.col("param_id")) % 3)).alias("is_sharpe"), F.count("*").alias("n"))
    return rounded(out, ["is_sharpe"])


@register(f"{_RES} SELECT cycle, param_id, is_sharpe, n FROM (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY is_sharpe DESC, param_id) AS k FROM r) WHERE k = 1")
def c05_best_parameters(spark, sf_dir):
    return V.best_parameters(_results(spark, sf_dir))


@register(f"{_FOLD_SQL} SELECT count(*) AS cycles, round(avg(is_sharpe), 4) AS is_mean, round(avg(oos_sharpe), 4) AS oos_mean, round(corr(is_sharpe, oos_sharpe), 4) AS corr, round(sum(oos_sharpe * n_trades) / sum(n_trades), 4) AS oos_weighted, round(avg(oos_sharpe) / avg(is_sharpe), 4) AS efficiency FROM f")
def c06_walk_forward_summary(spark, sf_dir):
    return rounded(V.wfa_summary(_folds(spark, sf_dir)), ["is_mean", "oos_mean", "corr", "oos_weighted", "efficiency"])


@register()
def c07_deflated_sharpe(spark, sf_dir):
    out = V.deflated_sharpe(_daily(spark, sf_dir), ["symbol"])
    return rounded(out, ["sr", "skew", "kurt", "psr", "dsr"])


@register(f"""{_FOLD_SQL}, s AS (SELECT fold AS strategy_id, abs(is_sharpe) / 100 AS cpcv_pbo, oos_sharpe AS dsr FROM f)
SELECT strategy_id, CASE WHEN cpcv_pbo < 0.02 AND dsr > 0 THEN 'keep' ELSE 'retire' END AS decision, concat_ws(',', CASE WHEN NOT cpcv_pbo < 0.02 THEN 'cpcv_pbo' END, CASE WHEN NOT dsr > 0 THEN 'dsr' END) AS failed FROM s""")
def c08_decisions(spark, sf_dir):
    s = _folds(spark, sf_dir).select(F.col("fold").alias("strategy_id"), (F.abs("is_sharpe") / 100).alias("cpcv_pbo"), F.col("oos_sharpe").alias("dsr"))
    return V.decide(s, {"cpcv_pbo": ("<", 0.02), "dsr": (">", 0.0)}).select("strategy_id", "decision", F.array_join("failed", ",").alias("failed"))


@register(f"{_RES} SELECT cycle, param_id, round(is_sharpe * sqrt(n), 4) AS score FROM r WHERE n >= 3 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def c09_sweep_top(spark, sf_dir):
    """The ten best of a sweep by Sharpe times the root of trades (a top-k report)."""
    r = _results(spark, sf_dir)
    out = rounded(r.withColumn("score", V.sweep_score(F.col("is_sharpe"), F.col("n"), 3)).where("score is not null").select("cycle", "param_id", "score"), ["score"])
    return out.orderBy(F.desc("score"), "cycle", "param_id").limit(10)


@register(f"{BARS_SQL}, p AS (SELECT symbol AS name, close AS value FROM bars), c AS (SELECT name, CASE WHEN count(*) >= 2 AND abs(avg(value)) > 1e-10 THEN stddev_samp(value) / abs(avg(value)) END AS cv FROM p GROUP BY name) SELECT round(greatest(0, least(1, 1 - avg(cv))), 4) AS stability FROM c")
def g31_parameter_stability(spark, sf_dir):
    return rounded(V.stability(hour_bars(spark, sf_dir).select(F.col("symbol").alias("name"), F.col("close").alias("value"))), ["stability"])


@register(f"{_RET} SELECT symbol, ts, round(ret, 4) AS ret FROM q")
def h01_log_returns(spark, sf_dir):
    return rounded(_returns(spark, sf_dir), ["ret"])


@register(f"""{_RET}, d AS (SELECT symbol, ts, ret - avg(ret) OVER (PARTITION BY symbol) AS d FROM q), l AS (SELECT symbol, {', '.join(f'd * lag(d, {k}) OVER w AS c{k}' for k in (1, 2, 5, 10))}, d * d AS v FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s AS (SELECT symbol, count(*) AS n, {', '.join(f'sum(c{k}) / sum(v) AS a{k}' for k in (1, 2, 5, 10))} FROM l GROUP BY symbol)
{' UNION ALL '.join(f'SELECT symbol, n, {k} AS lag, round(a{k}, 4) AS acf FROM s' for k in (1, 2, 5, 10))}""")
def h07_autocorrelation(spark, sf_dir):
    return rounded(T.autocorrelation(_returns(spark, sf_dir), ["symbol"], [1, 2, 5, 10]), ["acf"])


@register()
def h02_ljung_box(spark, sf_dir):
    return rounded(T.ljung_box(_returns(spark, sf_dir), ["symbol"]), ["q", "p"])


@register()
def h03_adf(spark, sf_dir):
    return rounded(T.adf(hour_bars(spark, sf_dir).select("symbol", "ts", "close"), ["symbol"], "close"), ["statistic"])


@register()
def h04_hurst(spark, sf_dir):
    return rounded(T.hurst(_returns(spark, sf_dir), ["symbol"]), ["hurst", "dfa"])


@register()
def h05_ks_normality(spark, sf_dir):
    return rounded(T.ks_normal(_returns(spark, sf_dir), ["symbol"]), ["d", "p"])


@register(f"{_RET}, x AS (SELECT *, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM q) SELECT symbol, count(*) AS n, round(regr_slope(ret, x), 4) AS slope, round(-regr_slope(ret, x), 4) AS mean_reversion FROM x WHERE x IS NOT NULL GROUP BY symbol")
def h09_ar1(spark, sf_dir):
    return rounded(T.ar1(_returns(spark, sf_dir), ["symbol"]).select("symbol", "n", "slope", "mean_reversion"), ["slope", "mean_reversion"])


@register("WITH p AS (SELECT unnest([1.0::DOUBLE, 2, 5, 10, 30]) AS x, unnest([0.4::DOUBLE, 0.2, 0.1, -0.3, 0.2]) AS y), n AS (SELECT *, lead(x) OVER (ORDER BY x) AS nx, lead(y) OVER (ORDER BY x) AS ny FROM p) SELECT round(x + (nx - x) * y / (y - ny), 6) AS crossing FROM n WHERE y > 0 AND ny <= 0 ORDER BY x LIMIT 1")
def h10_crossing_point(spark, sf_dir):
    p = spark.createDataFrame([(1.0, 0.4), (2.0, 0.2), (5.0, 0.1), (10.0, -0.3), (30.0, 0.2)], "x double, y double")
    return rounded(T.crossing(p, "x", "y"), ["crossing"], 6)


@register()
def h06_compare_bar_types(spark, sf_dir):
    """Normality and dependence of the returns of time, tick and volume bars, side by side."""
    from ..operators.bars import builder
    from ..sources.tape import ticks

    t = ticks(spark, sf_dir)
    parts = []
    for kind, options in (("clock", {"freq": "1 hour"}), ("tick", {"n": 10}), ("volume", {"threshold": 200})):
        b = builder(kind, **options)(t).select("symbol", "ts", "close")
        parts.append(T.log_returns(b, ["symbol"]).select(F.lit(kind).alias("kind"), "symbol", "ts", "ret"))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = both.groupBy("kind").agg(F.count("*").alias("n"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"))
    return rounded(out, ["skew", "kurt"])


@register()
def h08_hurst_by_window(spark, sf_dir):
    """Exponent and class of returns at windows of one to twelve hours."""
    return rounded(T.hurst_by_window(hour_bars(spark, sf_dir), ["symbol"], ("1 hour", "4 hours", "12 hours"), 50), ["hurst"])


@register()
def h11_segmented_report(spark, sf_dir):
    """The scale analysis of all bars and of each segment of the session."""
    return rounded(T.segmented_report(hour_bars(spark, sf_dir), windows=("1 hour", "4 hours"), least=50), ["value"])
