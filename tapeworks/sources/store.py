"""Stored bars: partitioned Parquet, CSV ingestion, merges and naming."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CSV_SCHEMA = "timestamp double, open double, high double, low double, close double, volume long, vwap double"


def epoch_to_timestamp(seconds: Column) -> Column:
    """Whole seconds since 1970 of a float, as a timestamp; the fraction is cut off."""
    return F.timestamp_seconds(seconds.cast("long")).cast("timestamp_ntz")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a CSV file with a header; timestamps are epoch seconds."""
    df = spark.read.schema(CSV_SCHEMA).csv(path, header=True)
    return df.withColumn("timestamp", epoch_to_timestamp(F.col("timestamp")))


def existing_years(spark: SparkSession, path: str) -> list[int]:
    """Years with a partition, from the listing alone."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return sorted(int(s.getPath().getName()[5:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("year="))


def write_years(df: DataFrame, path: str, ts: str = "timestamp", skip_existing: bool = True) -> None:
    """One partition a year, sorted by time; years that are there already are left alone.

    A year is split by month over the tasks, so no task holds a whole year.
    """
    df = df.withColumn("year", F.year(ts))
    if skip_existing and (have := existing_years(df.sparkSession, path)):
        df = df.where(~F.col("year").isin(have))
    df.repartition("year", F.month(ts)).sortWithinPartitions(ts).write.mode("append").partitionBy("year").option("compression", "zstd").parquet(path)


def read_years(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Partitions of a range of years; an error if there is none."""
    if not any(first <= y <= last for y in existing_years(spark, path)):
        raise FileNotFoundError(f"no year from {first} to {last} in {path}")
    return spark.read.parquet(path).where(F.col("year").between(first, last))


def cache_name(frequency: str, l1: bool = False, dollars: int | None = None, signals: Iterable[str] = ()) -> str:
    """Canonical name of a cached table of bars."""
    if dollars:
        return f"bars_dollar_{dollars // 1000}k"
    signals = sorted(signals)
    if signals:
        return f"enriched_{frequency}_{'_'.join(signals)}"
    return f"bars_l1_{frequency}" if l1 else f"bars_{frequency}"


def normalise(df: DataFrame, renames: dict[str, str], wanted: list[str]) -> DataFrame:
    """Renamed columns, of which those that exist are kept in the wanted order."""
    df = df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns})
    return df.select(*[c for c in wanted if c in df.columns])


def upsert_bars(stored: DataFrame, batches: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Stored bars merged with later ones: open, close and vwap are the newest, high and low the extremes, volume the sum.

    ``seq`` orders what arrived; stored rows come first.
    """
    both = stored.withColumn(seq, F.lit(-1).cast("long")).unionByName(batches)
    newest = lambda c: F.max_by(c, seq).alias(c)
    return both.groupBy(*keys).agg(newest("open"), F.max("high").alias("high"), F.min("low").alias("low"), newest("close"), F.sum("volume").alias("volume"), newest("vwap"))


def insert_missing(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is there already are ignored."""
    return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti"))


def update_fields(stored: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Given fields replaced where there is a change with a value."""
    c = changes.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = stored.join(c, stored[key] == F.col("_k"), "left")
    return joined.select(*[F.coalesce(F.col(f"_{x}"), stored[x]).alias(x) if x in fields else stored[x] for x in stored.columns])


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fill_vwap(df: DataFrame) -> DataFrame:
    """A missing vwap is the mean of the four prices."""
    return df.withColumn("vwap", F.coalesce("vwap", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4))
