import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeworks.functions import timeutil as T
from tapeworks.operators.bars import builder
from tapeworks.operators.signals import compute
from tapeworks.plans.base import hour_bars
from tapeworks.sources import store as S
from tapeworks.sources.tape import ticks
from tapeworks.streaming import streams


def test_years(spark, sf, tmp_path):
    path = f"file://{tmp_path}/bars"
    df = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderdate").alias("timestamp"), "o_totalprice")
    early = df.where(F.year("timestamp") < 1996)
    S.write_years(early, path)
    n = spark.read.parquet(path).count()
    S.write_years(df, path)
    assert spark.read.parquet(path).count() == df.count() and n == early.count()
    S.write_years(df, path)
    assert spark.read.parquet(path).count() == df.count()
    got = S.read_years(spark, path, 1995, 1996)
    assert {r.year for r in got.select("year").distinct().collect()} == {1995, 1996}
    assert "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().toString()
    with pytest.raises(FileNotFoundError):
        S.read_years(spark, path, 1900, 1901)


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("timestamp,open,high,low,close,volume,vwap\n1704186600.9,1,2,0.5,1.5,10,\n")
    (r,) = S.fill_vwap(S.read_csv(spark, str(p))).collect()
    assert r.timestamp == dt.datetime(2024, 1, 2, 9, 10) and r.vwap == 1.25


def test_names():
    assert S.cache_name("5s") == "bars_5s" and S.cache_name("5s", l1=True) == "bars_l1_5s"
    assert S.cache_name("", dollars=50000) == "bars_dollar_50k" and S.cache_name("1m", signals=["b", "a"]) == "enriched_1m_a_b"


def test_daylight_saving(spark):
    rows = [(dt.datetime(2024, 1, 3, 14, 30), True), (dt.datetime(2024, 7, 3, 13, 30), True), (dt.datetime(2024, 7, 3, 20, 0), False), (dt.datetime(2024, 3, 11, 13, 30), True), (dt.datetime(2024, 3, 8, 13, 30), False), (dt.datetime(2024, 11, 4, 14, 29, 59), False)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, want boolean")
    assert df.where(T.in_session(F.col("ts")) != F.col("want")).count() == 0
    with pytest.raises(ValueError):
        T.in_session(F.col("ts"), "moon")


def test_builders_and_signals(spark, sf):
    t = ticks(spark, sf)
    assert builder("tick", n=10)(t).where("n_ticks <> 10").count() == 0
    assert builder("volume", threshold=100)(t).where("volume < 100").count() == 0
    assert builder("volume", threshold=100, partial=True)(t).agg(F.sum("volume")).first()[0] == t.agg(F.sum("size")).first()[0]
    with pytest.raises(ValueError):
        builder("moon")
    with pytest.raises(ValueError):
        compute(hour_bars(spark, sf), ["moon"])
    b = builder("clock", freq="1 hour")(t)
    assert b.where("high < greatest(open, close) or low > least(open, close)").count() == 0


def test_no_look_ahead(spark, sf):
    """Signals of a bar don't change when later bars are taken away."""
    names = ["bollinger", "donchian_channel", "vwap_session", "atr", "rsi_momentum", "vpin", "stochastic", "prior_day_levels"]
    b = hour_bars(spark, sf)
    cut = dt.datetime(2024, 1, 15)
    full = compute(b, names).where(F.col("ts") < F.lit(cut).cast("timestamp_ntz")).select("symbol", "ts", *[F.round(F.col(n)["value"], 6).alias(n) for n in names])
    part = compute(b.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz")), names).select("symbol", "ts", *[F.round(F.col(n)["value"], 6).alias(n) for n in names])
    assert full.exceptAll(part).count() == 0 and part.count() > 0


def test_asof_plan_has_no_nested_loop(spark, sf):
    from tapeworks import catalog

    plan = catalog.queries()["j03_asof"](spark, sf)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stream_equals_batch(spark, sf):
    from tapeworks import catalog

    stream = catalog.queries()["r04_stream_volume_bars"](spark, sf)
    batch = builder("volume", threshold=500)(ticks(spark, sf))
    cols = ["symbol", "bar", "ts", "open", "high", "low", "close", "volume", "n_ticks"]
    assert sorted(map(tuple, stream.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_merge_sink_is_idempotent(spark, tmp_path):
    day = dt.datetime(2024, 1, 2)
    cols = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long, vwap double"
    merge = streams.merge_into(f"file://{tmp_path}/m", ["symbol", "ts"])
    merge(spark.createDataFrame([("a", day, 1.0, 2.0, 0.5, 1.5, 10, 1.2)], cols), 0)
    second = spark.createDataFrame([("a", day, 1.4, 3.0, 1.0, 2.5, 5, 2.0), ("b", day, 1.0, 1.0, 1.0, 1.0, 1, 1.0)], cols)
    merge(second, 1)
    merge(second, 1)
    got = {r.symbol: r for r in spark.read.parquet(f"file://{tmp_path}/m/v=1").collect()}
    assert (got["a"].open, got["a"].high, got["a"].low, got["a"].close, got["a"].volume) == (1.4, 3.0, 0.5, 2.5, 15) and got["b"].volume == 1
