"""Trade, evaluation and cost metrics, and data quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sharpe(x: Column, n: Column | None = None, year: float = 252.0) -> Column:
    """Annualised mean over sample deviation; 0 for fewer than two values or no deviation."""
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= 2) & (sd > 1e-10), F.avg(x) / sd * math.sqrt(year)).otherwise(0.0)


def sortino(x: Column, target: float = 0.0, year: float = 252.0) -> Column:
    """Annualised mean excess over the root mean square of what is below the target."""
    d = F.sqrt(F.avg(F.when(x < target, (x - target) * (x - target))))
    return F.when((F.count(x) >= 2) & (d > 1e-10), (F.avg(x) - target) / d * math.sqrt(year)).otherwise(0.0)


def profit_factor(x: Column) -> Column:
    """Gains over losses; infinite without losses, 0 without either."""
    win, loss = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(F.sum(F.when(x <= 0, -x)), F.lit(0.0))
    return F.when(loss > 0, win / loss).when(win > 0, F.lit(float("inf"))).otherwise(0.0)


def trade_metrics(trades: DataFrame, by: list[str], pnl: str = "pnl", commission: str | None = None) -> DataFrame:
    """Count, wins, win rate, totals, averages, extremes, profit factor, expectancy of each key's trades."""
    x = F.col(pnl)
    win, loss = F.when(x > 0, x), F.when(x <= 0, x)
    return trades.groupBy(*by).agg(
        F.count("*").alias("n_trades"),
        F.count(win).alias("n_wins"),
        F.count(loss).alias("n_losses"),
        (F.count(win) / F.count("*")).alias("win_rate"),
        F.sum(x).alias("net"),
        F.coalesce(F.sum(win), F.lit(0.0)).alias("gross_win"),
        F.coalesce(F.sum(loss), F.lit(0.0)).alias("gross_loss"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.max(x).alias("best"),
        F.min(x).alias("worst"),
        profit_factor(x).alias("profit_factor"),
        F.avg(x).alias("expectancy"),
    )


def equity(trades: DataFrame, by: list[str], order: list[str], capital: float, pnl: str = "pnl") -> DataFrame:
    """Equity after each trade, its peak so far and the drawdown in percent of it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = trades.withColumn("equity", F.lit(capital) + F.sum(pnl).over(w)).withColumn("peak", F.greatest(F.lit(capital), F.max("equity").over(w)))
    return df.withColumn("drawdown_pct", 100 * (F.col("peak") - F.col("equity")) / F.col("peak"))


def drawdown(trades: DataFrame, by: list[str], order: list[str], capital: float, pnl: str = "pnl") -> DataFrame:
    """Largest drawdown, and the longest run of trades under water."""
    e = equity(trades, by, order, capital, pnl).withColumn("_under", F.col("equity") < F.col("peak"))
    w = Window.partitionBy(*by).orderBy(*order)
    e = e.withColumn("_g", F.sum(F.when(F.col("_under"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = e.groupBy(*by, "_g").agg(F.sum(F.col("_under").cast("long")).alias("_n"), F.max("drawdown_pct").alias("_d"))
    return runs.groupBy(*by).agg(F.max("_d").alias("max_drawdown_pct"), F.max("_n").alias("longest_under_water"))


def daily_pnl(trades: DataFrame, by: list[str], exit_ts: str, pnl: str = "pnl") -> DataFrame:
    """P&L of each exit date and its running sum."""
    d = trades.groupBy(*by, F.col(exit_ts).cast("date").alias("date")).agg(F.sum(pnl).alias("pnl"))
    return d.withColumn("total", F.sum("pnl").over(Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value, and their share."""
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_t"))
    return out.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_t")).alias("share"))


def transition_matrix(states: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """Share of each next state among the moves out of a state."""
    w = Window.partitionBy(*by).orderBy(order)
    moves = states.withColumn("to", F.lead(state).over(w)).where("to is not null").groupBy(F.col(state).alias("from"), "to").agg(F.count("*").alias("n"))
    return moves.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def persistence(states: DataFrame, by: list[str], order: str, state: str, horizon: int) -> DataFrame:
    """Share of rows whose state is the same ``horizon`` rows later."""
    later = F.lead(state, horizon).over(Window.partitionBy(*by).orderBy(order))
    return states.withColumn("_l", later).where("_l is not null").groupBy(*by).agg(F.avg((F.col(state) == F.col("_l")).cast("double")).alias("persistence"))


def stints(states: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """Number, mean and median length of unbroken stays in each state."""
    w = Window.partitionBy(*by).orderBy(order)
    df = states.withColumn("_c", F.when(F.col(state) == F.lag(state).over(w), 0).otherwise(1)).withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy(*by, state, "_g").agg(F.count("*").alias("n"))
    return runs.groupBy(*by, state).agg(F.count("*").alias("stints"), F.avg("n").alias("mean_length"), F.median("n").alias("median_length"))


def reliability(predictions: DataFrame, bins: int = 15) -> DataFrame:
    """Rows, mean confidence and accuracy in equal bins (low, high] of ``confidence`` against ``correct``."""
    b = F.greatest(F.ceil(F.col("confidence") * bins) - 1, F.lit(0)).cast("int")
    return predictions.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def calibration_error(predictions: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error: mean gap of confidence and accuracy, weighted by rows."""
    r = reliability(predictions, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def brier(predictions: DataFrame, probabilities: list[str], label: str) -> DataFrame:
    """Mean squared distance of class probabilities from the label's one-hot vector."""
    parts = [(F.col(p) - F.when(F.col(label) == k, 1.0).otherwise(0.0)) for k, p in enumerate(probabilities)]
    return predictions.agg(F.avg(sum((x * x for x in parts[1:]), parts[0] * parts[0])).alias("brier"))


def threshold_sweep(predictions: DataFrame, thresholds: list[float], win: float = 1.0, loss: float = 1.0) -> DataFrame:
    """For each threshold of confidence: trades, precision, recall and estimated P&L. The thresholds are a fixed short list, one pass over the rows."""
    aggs = []
    for i, t in enumerate(thresholds):
        on = F.col("confidence") >= t
        aggs.append(F.struct(F.lit(t).alias("threshold"), F.count(F.when(on, 1)).alias("n"), F.sum(F.when(on & F.col("correct"), 1).otherwise(0)).alias("hits"), F.count("*").alias("total"), F.sum(F.when(F.col("correct"), 1).otherwise(0)).alias("right")).alias(f"t{i}"))
    one = predictions.agg(*aggs)
    out = one.select(F.explode(F.array(*[f"t{i}" for i in range(len(thresholds))])).alias("x")).select("x.*")
    return out.select("threshold", "n", (F.col("n") / F.col("total")).alias("trade_share"), F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0).alias("precision"), F.when(F.col("right") > 0, F.col("hits") / F.col("right")).otherwise(0.0).alias("recall"), (F.col("hits") * F.lit(win) - (F.col("n") - F.col("hits")) * F.lit(loss)).alias("pnl"))


def costs(spark: SparkSession, brokers: dict[str, float], targets: list[int], stops: list[int], slip_ticks: int = 1, tick_value: float = 1.25) -> DataFrame:
    """Net win and loss, break-even win rate for each broker, target and stop (ticks)."""
    rows = [(b, c, t, s) for b, c in sorted(brokers.items()) for t in targets for s in stops]
    df = spark.createDataFrame(rows, "broker string, commission double, target int, stop int")
    cost = F.col("commission") * 2 + slip_ticks * tick_value
    df = df.withColumn("net_win", F.col("target") * tick_value - cost).withColumn("net_loss", F.col("stop") * tick_value + cost)
    return df.withColumn("breakeven", F.when(F.col("net_win") > 0, F.col("net_loss") / (F.col("net_win") + F.col("net_loss"))).otherwise(1.0))


def uniqueness(labels: DataFrame, by: list[str], index: str, life: str) -> DataFrame:
    """Mean of one over the number of labels alive at each bar of a label's life, over the global mean.

    A sweep of +1 and -1 gives concurrency at each bar, prefix sums its inverse's mean.
    """
    w = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    starts = labels.select(*by, F.col(index).alias("_i"), F.lit(1).alias("_d"))
    ends = labels.select(*by, (F.col(index) + F.col(life)).alias("_i"), F.lit(-1).alias("_d"))
    steps = starts.union(ends).groupBy(*by, "_i").agg(F.sum("_d").alias("_d"))
    alive = steps.withColumn("c", F.sum("_d").over(w)).withColumn("_n", F.lead("_i").over(Window.partitionBy(*by).orderBy("_i")))
    each = alive.withColumn("_inv", F.when(F.col("c") > 0, (F.col("_n") - F.col("_i")) / F.col("c")).otherwise(0.0)).withColumn("_sum", F.sum("_inv").over(w) - F.col("_inv")).select(*by, "_i", "_sum")
    a = each.select(*by, F.col("_i").alias("_a"), F.col("_sum").alias("_sa"))
    b = each.select(*by, F.col("_i").alias("_b"), F.col("_sum").alias("_sb"))
    out = labels.withColumn("_a", F.col(index)).withColumn("_b", F.col(index) + F.col(life)).join(a, [*by, "_a"]).join(b, [*by, "_b"])
    out = out.withColumn("uniqueness", (F.col("_sb") - F.col("_sa")) / F.col(life))
    mean = out.agg(F.avg("uniqueness").alias("_m"))
    return out.join(F.broadcast(mean)).withColumn("weight", F.col("uniqueness") / F.col("_m")).drop("_a", "_b", "_sa", "_sb", "_m")


def quality_report(bars: DataFrame, gap_seconds: int = 30, n: int = 300, sigmas: float = 5.0) -> DataFrame:
    """For each symbol: rows, range, days, duplicate times, gaps within a day, outliers of the rolling mean."""
    w = Window.partitionBy("symbol").orderBy("ts")
    roll = w.rowsBetween(-(n - 1), 0)
    df = bars.withColumn("_p", F.lag("ts").over(w)).withColumn("_m", F.avg("close").over(roll)).withColumn("_s", F.stddev_samp("close").over(roll)).withColumn("_c", F.count("*").over(roll))
    gap = (F.col("_p").cast("date") == F.col("ts").cast("date")) & (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_p").cast("timestamp")) > gap_seconds * 1_000_000)
    odd = (F.col("_c") >= n) & (F.abs(F.col("close") - F.col("_m")) > sigmas * F.col("_s"))
    return df.groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct(F.col("ts").cast("date")).alias("days"), (F.count("*") - F.count_distinct("ts")).alias("duplicates"), F.sum(F.when(gap, 1).otherwise(0)).alias("gaps"), F.sum(F.when(odd, 1).otherwise(0)).alias("outliers"))
