"""Scheduled economic events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Public release dates of 2024, as (month, day).
FOMC_2024 = [(1, 31), (3, 20), (5, 1), (6, 12), (7, 31), (9, 18), (11, 7), (12, 18)]
NFP_2024 = [(1, 5), (2, 2), (3, 8), (4, 5), (5, 3), (6, 7), (7, 5), (8, 2), (9, 6), (10, 4), (11, 1), (12, 6)]
CPI_2024 = [(1, 11), (2, 13), (3, 12), (4, 10), (5, 15), (6, 12), (7, 11), (8, 14), (9, 11), (10, 10), (11, 13), (12, 11)]


def events_2024(spark: SparkSession) -> DataFrame:
    """d, kind of the year's events; other years have none."""
    rows = [(f"2024-{m:02d}-{d:02d}", kind) for kind, days in (("FOMC", FOMC_2024), ("NFP", NFP_2024), ("CPI", CPI_2024)) for m, d in days]
    return spark.createDataFrame(rows, "d string, kind string").select(F.col("d").cast("date").alias("d"), "kind")
