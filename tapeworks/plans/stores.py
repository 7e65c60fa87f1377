"""Source and store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators.outliers import sampled
from ..sources import store as S
from ..sources.loader import append_session, load_bars, warm_up
from ..sources.results import phase_report, resumable
from ..sources.tape import daily_tape, table, ticks
from .base import BARS_SQL, ONLY_TICKS, hour_bars, rounded, shared_folder


@register("SELECT event_id, make_timestamp(CAST(floor(epoch_us(CAST(ts AS TIMESTAMP)) / 1e6) AS BIGINT) * 1000000) AS ts FROM events")
def s02_epoch_seconds(spark, sf_dir):
    """Seconds as a float, cut to whole ones, as timestamps."""
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("event_id", S.epoch_to_timestamp(sec).alias("ts"))


@register("SELECT year(o_orderdate) AS year, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997 GROUP BY ALL")
def s04_year_range(spark, sf_dir):
    """A store with a part for each year, of which a range of years is read; counted by year."""
    path = shared_folder(spark, "years")
    S.write_years(table(spark, sf_dir, "orders"), path, "o_orderdate")
    o = S.read_years(spark, path, 1995, 1997)
    return o.groupBy(F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@register(f"""{BARS_SQL}, d AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts))
SELECT * FROM d WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-18'""")
def s05_load_bars(spark, sf_dir):
    """Bars of a span of days made coarser from the yearly store, kept under their name, and read again from there."""
    path = shared_folder(spark, "store")
    S.write_years(hour_bars(spark, sf_dir).select("symbol", "ts", "open", "high", "low", "close", "volume"), path, "ts")
    for _ in range(2):  # the second time from the cache
        out = load_bars(spark, path, f"{path}-cache", "2024-01-03", "2024-01-17", "4 hours")
    return out.select("symbol", "ts", "open", "high", "low", "close", "volume")


@register(f"{ONLY_TICKS}, e AS (SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS e FROM ticks) SELECT symbol, CAST(ts AS DATE) AS date, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM e WHERE epoch(e) % 86400 >= 34200 AND epoch(e) % 86400 < 57600 GROUP BY ALL")
def s19_session_append(spark, sf_dir):
    """Book rows of the regular session appended in two calls to a table with a part for each date."""
    path = shared_folder(spark, "book")
    t = ticks(spark, sf_dir).select("event_id", "symbol", "ts", "bid", "ask", "size")
    for k in range(2):
        append_session(t.where(F.col("event_id") % 2 == k), path)
    return spark.read.parquet(path).groupBy("symbol", "date").agg(F.count("*").alias("n"), F.sum("size").alias("volume"))


@register(f"""{BARS_SQL}, e AS (SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS e FROM bars), d AS (SELECT symbol, time_bucket(INTERVAL 2 HOUR, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM e WHERE epoch(e) % 86400 >= 34200 AND epoch(e) % 86400 < 57600 GROUP BY symbol, time_bucket(INTERVAL 2 HOUR, ts))
SELECT symbol, ts, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM d) WHERE k <= 50""")
def s23_warm_up(spark, sf_dir):
    """The last fifty coarser bars of each symbol's sessions."""
    return warm_up(hour_bars(spark, sf_dir).drop("vwap"), "2 hours", 50)


@register(f"{BARS_SQL} SELECT symbol, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY symbol")
def s26_resumable_results(spark, sf_dir):
    """Results of each symbol written as JSON, beside a Markdown report, and read again instead of worked out anew."""
    import json

    path = shared_folder(spark, "report")
    b = hour_bars(spark, sf_dir)
    names = sorted(r["symbol"] for r in b.select("symbol").distinct().collect())
    run = lambda s: b.where(F.col("symbol") == s).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))
    phase_report(spark, path, {"summary": run}, names)

    def never(_):
        raise AssertionError("worked out again")

    found = resumable(spark, f"{path}/summary", names, never)
    return spark.createDataFrame([(r["symbol"], r["n"], r["volume"]) for s in names for r in found[s]], "symbol string, n long, volume long")


@register(f"{ONLY_TICKS} SELECT symbol, ts, px AS price, size FROM ticks")
def s07_normalise(spark, sf_dir):
    """Renamed columns; wanted ones that don't exist are left out."""
    return S.normalise(ticks(spark, sf_dir), {"px": "price"}, ["symbol", "ts", "price", "size", "venue"])


@register("SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08' AND event_type = 'view'")
def s09_pushdown_scan(spark, sf_dir):
    """A time range and three columns; both reach the scan."""
    e = table(spark, sf_dir, "events")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-08"))
    return e.where((F.col("ts") >= lo) & (F.col("ts") < hi) & (F.col("event_type") == "view")).select("event_id", "user_id", "value")


@register(f"""{BARS_SQL}, m AS (SELECT max(ts) AS m FROM bars) SELECT symbol, ts, open, high, low, close, volume FROM bars, m WHERE ts >= m - INTERVAL 5 DAY AND symbol = 'view'""")
def s11_last_days(spark, sf_dir):
    """The last five days of one symbol."""
    b = hour_bars(spark, sf_dir)
    last = b.agg(F.max("ts").alias("m"))
    return b.where("symbol = 'view'").join(F.broadcast(last), F.col("ts") >= F.col("m") - F.expr("INTERVAL 5 DAYS")).select("symbol", "ts", "open", "high", "low", "close", "volume")


_HALF = """old AS (SELECT symbol, date_trunc('day', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, arg_max(vwap, ts) AS vwap, -1 AS seq FROM bars WHERE hour(ts) < 12 GROUP BY ALL),
new AS (SELECT symbol, date_trunc('day', ts) AS ts, open, high, low, close, volume, vwap, hour(ts) AS seq FROM bars WHERE hour(ts) >= 12)"""


@register(f"{BARS_SQL}, {_HALF}, u AS (SELECT * FROM old UNION ALL SELECT * FROM new) SELECT symbol, ts, arg_max(open, seq) AS open, max(high) AS high, min(low) AS low, arg_max(close, seq) AS close, CAST(sum(volume) AS BIGINT) AS volume, arg_max(vwap, seq) AS vwap FROM u GROUP BY symbol, ts")
def s12_upsert_bars(spark, sf_dir):
    """Mornings are stored, afternoon bars of the same day merged into them."""
    b = hour_bars(spark, sf_dir).select("symbol", "ts", "open", "high", "low", "close", "volume", "vwap")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    old = b.where(F.hour("ts") < 12).groupBy("symbol", day.alias("d")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.max_by("vwap", "ts").alias("vwap")).withColumnRenamed("d", "ts")
    new = b.where(F.hour("ts") >= 12).withColumn("seq", F.hour("ts").cast("long")).withColumn("ts", day)
    return S.upsert_bars(old, new, ["symbol", "ts"])


@register("""WITH st AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, 'N' AS o_orderstatus, 0.0 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0),
i AS (SELECT * FROM st UNION ALL SELECT * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM st))
SELECT i.o_orderkey, i.o_orderstatus, CASE WHEN i.o_orderkey % 5 = 0 THEN i.o_orderkey / 2.0::DOUBLE ELSE CAST(i.o_totalprice AS DOUBLE) END AS o_totalprice FROM i""")
def s13_insert_then_update(spark, sf_dir):
    """Rows inserted where the key is new, then fields updated by key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    both = S.insert_missing(o.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"])
    changes = o.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_orderkey") / 2.0).alias("o_totalprice"))
    return S.update_fields(both, changes, "o_orderkey", ["o_totalprice"])


@register(f"{ONLY_TICKS} SELECT event_id, '{{\"side\":\"' || side || '\",\"size\":' || size || '}}' AS meta FROM ticks")
def s14_metadata_json(spark, sf_dir):
    return ticks(spark, sf_dir).select("event_id", F.to_json(F.struct("side", "size")).alias("meta"))


@register("SELECT symbol, ts, l_orderkey, l_linenumber, px FROM (SELECT l_returnflag AS symbol, l_shipdate AS ts, l_orderkey, l_linenumber, CAST(round(l_extendedprice * 4) AS BIGINT) AS px, row_number() OVER (PARTITION BY l_returnflag, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1")
def s15_keep_last(spark, sf_dir):
    """The last row of each symbol and time; equal times are told apart by key and line."""
    return S.keep_last(daily_tape(spark, sf_dir), ["symbol", "ts"], [F.col("l_orderkey"), F.col("l_linenumber")]).select("symbol", "ts", "l_orderkey", "l_linenumber", "px")


@register("SELECT event_type AS symbol, max(CAST(ts AS TIMESTAMP)) AS high_water FROM events GROUP BY event_type")
def s16_high_water_mark(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("symbol").agg(F.max("ts").alias("high_water"))


@register(f"{BARS_SQL} SELECT symbol, ts, round(coalesce(CASE WHEN volume % 2 = 0 THEN vwap END, (open + high + low + close) / 4), 4) AS vwap FROM bars")
def s17_fill_vwap(spark, sf_dir):
    b = hour_bars(spark, sf_dir).withColumn("vwap", F.when(F.col("volume") % 2 == 0, F.col("vwap")))
    return rounded(S.fill_vwap(b).select("symbol", "ts", "vwap"), ["vwap"])


@register(f"""{ONLY_TICKS.replace("WITH ", "WITH RECURSIVE ", 1)}, o AS (SELECT symbol, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM ticks),
r AS (SELECT symbol, event_id, i, t AS last, true AS kept FROM o WHERE i = 1
  UNION ALL SELECT o.symbol, o.event_id, o.i, CASE WHEN o.t - r.last >= 3600000000 THEN o.t ELSE r.last END, o.t - r.last >= 3600000000 FROM r JOIN o ON o.symbol = r.symbol AND o.i = r.i + 1)
SELECT event_id, symbol FROM r WHERE kept""")
def s18_interval_sampling(spark, sf_dir):
    """A tick is kept if an hour has passed since the last one kept."""
    return sampled(ticks(spark, sf_dir), 3600).where("kept").select("event_id", "symbol")


@register(f"{ONLY_TICKS} SELECT symbol, CAST(ts AS DATE) AS d, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM ticks GROUP BY symbol, CAST(ts AS DATE)")
def s20_json_history(spark, sf_dir):
    """Days of ticks as JSON documents with an array, and read back."""
    docs = ticks(spark, sf_dir).groupBy("symbol", F.col("ts").cast("date").alias("d")).agg(F.to_json(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), "size"))).alias("j"))
    rows = docs.select("symbol", F.explode(F.from_json("j", "array<struct<t:string,size:bigint>>")).alias("x"))
    at = F.to_timestamp_ntz(F.regexp_replace("x.t", "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return rows.groupBy("symbol", at.cast("date").alias("d")).agg(F.count("*").alias("n"), F.sum("x.size").alias("volume"))


@register(f"{ONLY_TICKS} SELECT event_id, bid / 4.0::DOUBLE AS bid, ask / 4.0::DOUBLE AS ask, px / 4.0::DOUBLE AS last FROM ticks WHERE event_id % 10 <> 0")
def s21_quote_frames(spark, sf_dir):
    """Frames ``a[{...}]`` parsed to ticks; broken frames are left out."""
    t = ticks(spark, sf_dir)
    entry = F.to_json(F.struct(F.struct(F.col("event_id").alias("id"), (F.col("bid") / 4.0).alias("bid"), (F.col("ask") / 4.0).alias("ask"), (F.col("px") / 4.0).alias("last")).alias("quote")))
    frame = F.when(F.col("event_id") % 10 == 0, F.lit("a[{broken")).otherwise(F.concat(F.lit("a["), entry, F.lit("]")))
    parsed = t.select(F.from_json(F.regexp_replace(frame, "^a", ""), "array<struct<quote:struct<id:bigint,bid:double,ask:double,last:double>>>").alias("q"))
    return parsed.select(F.explode("q").alias("x")).where("x.quote.id is not null").select(F.col("x.quote.id").alias("event_id"), "x.quote.bid", "x.quote.ask", "x.quote.last")


@register(f"{BARS_SQL} SELECT symbol, 'bar' AS kind, ts, close, volume FROM bars WHERE volume > 5 AND close > 0 UNION ALL SELECT symbol, 'tick', ts, close, 0 FROM bars WHERE volume > 5 AND close > 0")
def s22_live_records(spark, sf_dir):
    """Fixed-point records give a bar and a tick of size 0; small volumes are dropped."""
    raw = hour_bars(spark, sf_dir).select("symbol", "ts", (F.col("close") * 1_000_000_000).cast("long").alias("fixed"), "volume")
    good = raw.withColumn("close", F.col("fixed") / 1e9).where("volume > 5 and close > 0")
    bar = good.select("symbol", F.lit("bar").alias("kind"), "ts", "close", "volume")
    return bar.unionByName(good.select("symbol", F.lit("tick").alias("kind"), "ts", "close", F.lit(0).cast("long").alias("volume")))


@register("SELECT CAST(l_shipdate AS DATE) AS d, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY CAST(l_shipdate AS DATE)")
def s25_daily_ohlcv(spark, sf_dir):
    """Daily bars in SQL; rows of a day are ordered by key and line."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("tape_lineitem")
    return spark.sql("SELECT CAST(l_shipdate AS DATE) AS d, min_by(l_extendedprice, struct(l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, max_by(l_extendedprice, struct(l_orderkey, l_linenumber)) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM tape_lineitem GROUP BY 1")


@register("SELECT DISTINCT year(o_orderdate) AS year FROM orders INTERSECT SELECT DISTINCT year(l_shipdate) FROM lineitem")
def x02_years_in_both(spark, sf_dir):
    """Years that both stores hold."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"))
    return o.intersect(table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("year")))
