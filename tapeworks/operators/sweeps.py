"""Sweeps of a strategy's parameters over spans of time, all combinations in one job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import profit_factor, sharpe
from .replay import replay
from .validation import grid


def split_spans(spark: SparkSession, train: tuple[str, str], test: tuple[str, str]) -> DataFrame:
    """(span, first, last) of a train and a test span, ends included."""
    return spark.createDataFrame([("train", *train), ("test", *test)], "span string, a string, b string").select("span", F.to_date("a").alias("first"), F.to_date("b").alias("last"))


def stability_spans(spark: SparkSession, first_year: int, last_year: int, years: int = 2) -> DataFrame:
    """(span, first, last) of consecutive windows of whole years."""
    rows = [(f"{y}-{min(y + years - 1, last_year)}", f"{y}-01-01", f"{min(y + years - 1, last_year)}-12-31") for y in range(first_year, last_year + 1, years)]
    return spark.createDataFrame(rows, "span string, a string, b string").select("span", F.to_date("a").alias("first"), F.to_date("b").alias("last"))


def score(sharpe_: Column, trades: Column, wanted: int = 100) -> Column:
    """Sharpe times the root of the trades, less for fewer trades than wanted; 0 for no profit."""
    n = F.greatest(trades, F.lit(1))
    return F.when(sharpe_ > 0, sharpe_ * F.sqrt(n) * F.least(n / wanted, F.lit(1.0))).otherwise(0.0)


def bracket_sweep(intents: DataFrame, by: list[str], parameters: dict[str, list], spans: DataFrame, wanted: int = 100) -> DataFrame:
    """Results of each span and combination of target_atr, stop_atr and max_bars: trades, win rate, net, Sharpe, profit factor, score.

    ``intents`` as for ``replay``.  Spans and combinations are short lists, so they are
    broadcast; each (key, span, combination) is replayed on its own.
    """
    spark = intents.sparkSession
    if spans.count() * math.prod(map(len, parameters.values())) > 100_000:
        raise ValueError("a grid this large would not be a short list")
    combos = grid(spark, parameters)
    day = F.col("day")
    rows = intents.join(F.broadcast(spans), (day >= F.col("first")) & (day <= F.col("last"))).crossJoin(F.broadcast(combos))
    rows = rows.withColumn("target", F.col("entry") + F.col("side") * F.col("target_atr") * F.col("atr_entry")).withColumn("stop", F.col("entry") - F.col("side") * F.col("stop_atr") * F.col("atr_entry"))
    key = [*by, "span", "param_id"]
    parts = None
    for bars in sorted(set(parameters["max_bars"])):  # a rule of the whole replay, so one for each value of a short list
        rules = [{"type": "bracket_target"}, {"type": "bracket_stop"}, {"type": "time_stop", "max_bars": bars}]
        part = replay(rows.where(F.col("max_bars") == bars).where("atr_entry > 0 or side = 0"), key, rules)
        parts = part if parts is None else parts.unionByName(part)
    days = parts.groupBy("span", "param_id", F.col("exit_ts").cast("date").alias("d")).agg(F.sum("pnl").alias("p")).groupBy("span", "param_id").agg(sharpe(F.col("p")).alias("sharpe"))
    x = F.col("pnl")
    out = parts.groupBy("span", "param_id").agg(F.count("*").alias("n_trades"), F.avg((x > 0).cast("double")).alias("win_rate"), F.sum(x).alias("net"), profit_factor(x).alias("profit_factor")).join(days, ["span", "param_id"])
    return out.withColumn("score", score(F.col("sharpe"), F.col("n_trades"), wanted)).join(F.broadcast(combos), "param_id")


def split_choice(results: DataFrame, top: int = 30) -> DataFrame:
    """The best combinations of the train span (a top-k report) with their results in the test span."""
    cols = ["n_trades", "win_rate", "net", "sharpe", "profit_factor", "score"]
    train = results.where("span = 'train'").orderBy(F.desc("score"), "param_id").limit(top)
    test = results.where("span = 'test'").select("param_id", *[F.col(c).alias(f"test_{c}") for c in cols])
    return train.select("param_id", *cols).join(test, "param_id", "left")


def across_spans(results: DataFrame) -> DataFrame:
    """For each combination: spans, spans with a profit, worst and mean Sharpe."""
    return results.groupBy("param_id").agg(F.count("*").alias("spans"), F.sum((F.col("net") > 0).cast("int")).alias("profitable"), F.min("sharpe").alias("worst_sharpe"), F.avg("sharpe").alias("mean_sharpe"))
