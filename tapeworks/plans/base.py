"""Inputs that several queries share, and their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import bars_sql, clock_bars
from ..sources.tape import TICKS_SQL, ticks


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock_bars(ticks(spark, sf_dir), "1 hour")


#: Common table expressions ``ticks`` and ``bars`` (hourly), to be followed by more or by a SELECT.
BARS_SQL = f"WITH {TICKS_SQL}, {bars_sql()}"
ONLY_TICKS = f"WITH {TICKS_SQL}"


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share; on one machine, where none is set, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that executors share")
        shared = f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
