"""Validation: folds, walk-forward windows, overfitting and deflated statistics, search."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """All combinations, numbered in order."""
    names = list(parameters)
    rows = [(i, *c) for i, c in enumerate(itertools.product(*parameters.values()))]
    kinds = {int: "int", float: "double", str: "string", bool: "boolean"}
    schema = "param_id long, " + ", ".join(f"{n} {kinds[type(parameters[n][0])]}" for n in names)
    return spark.createDataFrame(rows, schema)


def cpcv_folds(days: int, groups: int = 8, test: int = 2, purge: int = 1, embargo: float = 0.01) -> list[tuple[int, int, str]]:
    """(fold, day, role) of combinatorial purged cross-validation over day numbers.

    Contiguous groups, the remainder to the first; train days within ``purge`` of a run
    of test days go, and after each run an embargo of a share of the train days (at
    least one day).
    """
    size, rest = divmod(days, groups)
    bounds = [0]
    for g in range(groups):
        bounds.append(bounds[-1] + size + (1 if g < rest else 0))
    group_of = [g for g in range(groups) for _ in range(bounds[g], bounds[g + 1])]
    out = []
    for fold, chosen in enumerate(itertools.combinations(range(groups), test)):
        tests = {d for d in range(days) if group_of[d] in chosen}
        ends = [d for d in sorted(tests) if d + 1 not in tests]
        starts = [d for d in sorted(tests) if d - 1 not in tests]
        gone = {d + k for d in ends for k in range(1, purge + 1)} | {d - k for d in starts for k in range(1, purge + 1)}
        train = [d for d in range(days) if d not in tests and d not in gone]
        hold = max(1, int(embargo * len(train)))
        for e in ends:
            after = [d for d in train if d > e][:hold]
            gone |= {d for d in after if d - e <= purge + hold}
        out += [(fold, d, "test") for d in sorted(tests)] + [(fold, d, "train") for d in train if d not in gone]
    return out


def fold_membership(spark: SparkSession, days: DataFrame, **options) -> DataFrame:
    """fold_id, day, role of a table of distinct days (numbered in order; a calendar is small)."""
    n = days.count()
    numbered = days.withColumn("_i", F.row_number().over(Window.orderBy("day")) - 1)
    folds = spark.createDataFrame(cpcv_folds(n, **options), "fold_id int, _i int, role string")
    return folds.join(F.broadcast(numbered), "_i").select("fold_id", "day", "role")


def wfa_windows(days: int, train: int = 63, test: int = 21) -> list[tuple[int, int, int, int, int]]:
    """(cycle, train first, train end, test first, test end), ends exclusive; steps of the test length."""
    return [(i, i * test, i * test + train, i * test + train, i * test + train + test) for i in range(max(0, (days - train - test) // test + 1))]


def pbo(folds: DataFrame) -> DataFrame:
    """Share of folds whose rank against the median differs between in-sample and out-of-sample; 0 if both are constant."""
    m = folds.agg(F.median("is_sharpe").alias("mi"), F.median("oos_sharpe").alias("mo"), F.stddev_pop("is_sharpe").alias("si"), F.stddev_pop("oos_sharpe").alias("so"))
    flip = ((F.col("is_sharpe") > F.col("mi")) != (F.col("oos_sharpe") > F.col("mo"))).cast("double")
    flat = (F.col("si") < 1e-10) & (F.col("so") < 1e-10)
    out = folds.join(F.broadcast(m)).agg(F.avg(F.when(flat, 0.0).otherwise(flip)).alias("pbo"))
    return out.withColumn("passes", F.col("pbo") < 0.10)


def best_parameters(results: DataFrame, cycle: str = "cycle") -> DataFrame:
    """The parameter of each cycle with the best in-sample value (ties: the first)."""
    w = Window.partitionBy(cycle).orderBy(F.desc("is_sharpe"), "param_id")
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def wfa_summary(cycles: DataFrame) -> DataFrame:
    """Means, efficiency (out over in), correlation from three cycles on, and the trade-weighted out-of-sample mean."""
    i, o, n = F.col("is_sharpe"), F.col("oos_sharpe"), F.col("n_trades")
    out = cycles.agg(F.count("*").alias("cycles"), F.avg(i).alias("is_mean"), F.avg(o).alias("oos_mean"), F.when(F.count("*") >= 3, F.corr(i, o)).alias("corr"), F.try_divide(F.sum(o * n), F.sum(n)).alias("oos_weighted"))
    return out.withColumn("efficiency", F.when(F.abs("is_mean") > 1e-10, F.col("oos_mean") / F.col("is_mean")).otherwise(0.0))


def stability(parameters: DataFrame) -> DataFrame:
    """1 less the mean coefficient of variation of (name, value) rows, within [0, 1]; single values are left out."""
    cv = parameters.groupBy("name").agg(F.when((F.count("value") >= 2) & (F.abs(F.avg("value")) > 1e-10), F.stddev_samp("value") / F.abs(F.avg("value"))).alias("cv"))
    return cv.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(F.avg("cv"), F.lit(0.0)))).alias("stability"))


def moments(returns: DataFrame, by: list[str], x: str = "ret") -> DataFrame:
    """n, Sharpe ratio of a period, skewness and excess kurtosis (population moments) of each key."""
    return returns.groupBy(*by).agg(F.count(x).alias("n"), F.when(F.stddev_samp(x) > 1e-12, F.avg(x) / F.stddev_samp(x)).otherwise(0.0).alias("sr"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))


_N = NormalDist()


def probabilistic_sharpe(sr: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    """Probability that the true ratio is above a benchmark."""
    if n < 2:
        return 0.0
    var = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return _N.cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(max(var, 1e-12)))


def expected_max_sharpe(trials: int, spread: float) -> float:
    """Expected best of so many independent ratios of a deviation."""
    if trials < 2:
        return 0.0
    g = 0.5772156649015329
    return spread * ((1 - g) * _N.inv_cdf(1 - 1 / trials) + g * _N.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(returns: DataFrame, by: list[str], trials: int | None = None, x: str = "ret") -> DataFrame:
    """PSR and DSR of each key; the number of trials is that of keys unless given. A row a key comes to the function."""
    m = moments(returns, by, x)
    kinds = {f.name: f.dataType.simpleString() for f in m.schema.fields}
    spread = m.agg(F.coalesce(F.stddev_samp("sr"), F.lit(0.0)).alias("_s"), F.count("*").alias("_k"))
    psr = F.udf(lambda sr, n, s, k: probabilistic_sharpe(sr, n, s or 0.0, k or 0.0), "double")
    dsr = F.udf(lambda sr, n, s, k, d, t: probabilistic_sharpe(sr, n, s or 0.0, k or 0.0, expected_max_sharpe(trials or t, d)), "double")
    out = m.join(F.broadcast(spread)).withColumn("psr", psr("sr", "n", "skew", "kurt")).withColumn("dsr", dsr("sr", "n", "skew", "kurt", "_s", "_k"))
    return out.select(*by, *[c for c in kinds if c not in by], "psr", "dsr")


GATES = {"cpcv_pbo": ("<", 0.10), "dsr": (">", 0.95), "wfa_efficiency": (">", 0.5), "param_stability_score": (">", 0.5), "total_oos_trades": (">=", 30)}


def decide(strategies: DataFrame, gates: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """keep or retire, with the gates that failed."""
    gates = GATES if gates is None else gates
    ops = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    failed = F.filter(F.array(*[F.when(~F.coalesce(ops[o](F.col(c), F.lit(x)), F.lit(False)), F.lit(c)) for c, (o, x) in gates.items()]), lambda r: r.isNotNull())
    return strategies.withColumn("failed", failed).withColumn("decision", F.when(F.size("failed") == 0, "keep").otherwise("retire"))


def retire_correlated(strategies: DataFrame, correlations: DataFrame, limit: float = 0.7) -> DataFrame:
    """Of two kept strategies that move together, the one of the smaller deflated ratio retires (ties: the later name)."""
    s = strategies.select("strategy_id", "dsr", "decision")
    a, b = s.select(F.col("strategy_id").alias("a"), F.col("dsr").alias("da"), F.col("decision").alias("ka")), s.select(F.col("strategy_id").alias("b"), F.col("dsr").alias("db"), F.col("decision").alias("kb"))
    both = correlations.where(F.abs("corr") > limit).join(a, "a").join(b, "b").where("ka = 'keep' and kb = 'keep'")
    weaker = both.select(F.when(F.col("da") >= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("_w")).distinct()
    return strategies.join(weaker, strategies["strategy_id"] == F.col("_w"), "left").withColumn("decision", F.when(F.col("_w").isNotNull(), "retire").otherwise(F.col("decision"))).drop("_w")


def sweep_score(sharpe: Column, trades: Column, least: int = 10) -> Column:
    """Sharpe times the root of the trades; nothing below a number of trades."""
    return F.when(trades >= least, sharpe * F.sqrt(trades)).otherwise(F.lit(None).cast("double"))
