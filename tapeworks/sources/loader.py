"""Loading bars for a run: a cache of tables by name over the yearly store, session filters, warm-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeutil import in_session
from ..operators.bars import dollar_bars_of_bars, resample
from .results import _fs
from .store import cache_name, read_years


class BarCache:
    """Tables of bars under their canonical names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str) -> bool:
        fs, p = _fs(self.spark, f"{self._at(name)}/_SUCCESS")
        return fs.exists(p)

    def load(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise FileNotFoundError(name)
        return self.spark.read.parquet(self._at(name))

    def save(self, name: str, bars: DataFrame) -> DataFrame:
        """Write a table in parts by year, and read it back; a table that was not finished is written anew."""
        bars.withColumn("year", F.year("ts")).repartition("year", F.month("ts")).sortWithinPartitions("ts").write.mode("overwrite").partitionBy("year").parquet(self._at(name))
        return self.load(name)


def load_bars(spark: SparkSession, store: str, cache: str, first: str, last: str, freq: str | None = None, dollars: float | None = None) -> DataFrame:
    """Bars (symbol, ts, open, high, low, close, volume) of the days ``first`` to ``last``, both whole.

    Read from the cache if the table is there; else the store's bars are made coarser, or
    into dollar bars, and kept.  The cached table holds all years of the store, so any span
    can be read from it; its own years prune the read.
    """
    bars_cache = BarCache(spark, cache)
    name = cache_name(freq or "1s", dollars=int(dollars) if dollars else None)
    if bars_cache.exists(name):
        df = bars_cache.load(name)
    else:
        df = read_years(spark, store, 1, 9999).drop("year")
        df = df.withColumnRenamed("timestamp", "ts") if "timestamp" in df.columns else df
        df = df if "symbol" in df.columns else df.withColumn("symbol", F.lit(""))
        if dollars:
            df = bars_cache.save(name, dollar_bars_of_bars(df, dollars))
        elif freq:
            df = bars_cache.save(name, resample(df, freq))
    a, b = F.lit(first).cast("date"), F.date_add(F.lit(last).cast("date"), 1)
    if "year" in df.columns:
        df = df.where(F.col("year").between(int(first[:4]), int(last[:4]))).drop("year")
    return df.where((F.col("ts") >= a.cast("timestamp_ntz")) & (F.col("ts") < b.cast("timestamp_ntz")))


def warm_up(bars: DataFrame, freq: str, n: int = 500) -> DataFrame:
    """The last n coarser bars of each symbol's regular sessions: what a live run starts from."""
    if not 0 < n <= 500:
        raise ValueError("a warm-up has 1 to 500 bars")
    coarse = resample(bars.where(in_session(F.col("ts"))), freq)
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return coarse.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def append_session(book: DataFrame, path: str, ts: str = "ts") -> None:
    """Rows of the regular session added to a table with a part for each date; a date's rows may come in several calls."""
    book.where(in_session(F.col(ts))).withColumn("date", F.col(ts).cast("date")).write.mode("append").partitionBy("date").parquet(path)
