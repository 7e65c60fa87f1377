"""Adapters from stored tables to tick tapes.

``ticks`` reads ``events`` as a tape: the event type is the symbol, prices are whole
quarter ticks, quotes and sides follow from the user.  All sums stay in whole ticks
and are divided once at the end, so results don't depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK = 0.25

TICKS_SQL = """ticks AS (
  SELECT event_id, event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, user_id,
         CAST(greatest(floor(value * 4), 1) AS BIGINT) AS px,
         1 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS size,
         CAST(greatest(floor(value * 4), 1) AS BIGINT) - (1 + user_id % 2) AS bid,
         CAST(greatest(floor(value * 4), 1) AS BIGINT) + (1 + user_id % 3) AS ask,
         1 + user_id % 50 AS bid_size,
         CASE user_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'N' END AS side
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, symbol, ts, user_id, px, size, bid, ask (whole ticks), bid_size, side."""
    e = table(spark, sf_dir, "events")
    px = F.greatest(F.floor(F.col("value") * 4), F.lit(1)).cast("long")
    user = F.col("user_id")
    return e.select(
        "event_id",
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "user_id",
        px.alias("px"),
        (1 + F.get_json_object("props", "$.k").cast("long")).alias("size"),
        (px - (1 + user % 2)).alias("bid"),
        (px + (1 + user % 3)).alias("ask"),
        (1 + user % 50).alias("bid_size"),
        F.when(user % 3 == 0, "B").when(user % 3 == 1, "A").otherwise("N").alias("side"),
    )


def daily_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a daily tape of returnflag symbols, with a tiebreak for equal dates."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 4).cast("long").alias("px"), F.col("l_quantity").cast("long").alias("size"))
