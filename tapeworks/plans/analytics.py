"""Profile, quality, metric and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import metrics as M
from ..operators import profile as P
from ..sources.tape import table, ticks
from .base import BARS_SQL, ONLY_TICKS, hour_bars, rounded

_D = "d AS (SELECT *, CAST(ts AS DATE) AS day, hour(ts) AS slot, day(ts) // 8 AS month FROM bars)"


def _days(spark, sf_dir):
    return hour_bars(spark, sf_dir).withColumn("day", F.col("ts").cast("date"))


_SLOT, _MONTH = F.hour, lambda c: F.floor(F.day(c) / 8).cast("int")
_HEAT = f"""{_D}, r AS (SELECT slot, month, ln(close) - ln(lag(close) OVER (PARTITION BY symbol, day ORDER BY ts)) AS r FROM d),
cells AS (SELECT slot, month, sqrt(avg(r * r)) * sqrt(252.0::DOUBLE * 24) AS rv, count(*) AS n FROM r WHERE r IS NOT NULL GROUP BY slot, month)"""


def _cells(spark, sf_dir):
    return P.volatility_heatmap(_days(spark, sf_dir), _SLOT("ts"), _MONTH("ts"), 24)


@register(f"{BARS_SQL}, {_HEAT} SELECT CAST(slot AS INTEGER) AS slot, CAST(month AS INTEGER) AS month, round(rv, 4) AS rv, n FROM cells")
def g01_volatility_heatmap(spark, sf_dir):
    return rounded(_cells(spark, sf_dir), ["rv"])


@register(f"""{BARS_SQL}, {_HEAT}, s AS (SELECT slot, avg(rv) AS v FROM cells GROUP BY slot), q AS (SELECT slot FROM s WHERE v < (SELECT avg(rv) FROM cells) / 1.02),
g AS (SELECT slot, slot - row_number() OVER (ORDER BY slot) AS g FROM q)
SELECT CAST(min(slot) AS INTEGER) AS first, CAST(max(slot) AS INTEGER) AS last, count(*) AS n FROM g GROUP BY g ORDER BY 3 DESC, 1 LIMIT 1""")
def g02_dead_zone(spark, sf_dir):
    """The longest run of quiet slots (a top-1 report)."""
    return P.dead_zone(_cells(spark, sf_dir), 1.02)


@register(f"""{BARS_SQL}, {_HEAT}, a AS (SELECT avg(rv) FILTER (slot BETWEEN 0 AND 3 AND rv > 0) AS open, avg(rv) FILTER (slot BETWEEN 8 AND 15 AND rv > 0) AS mid, avg(rv) FILTER (slot BETWEEN 20 AND 23 AND rv > 0) AS close FROM cells)
SELECT round(open, 4) AS open, round(mid, 4) AS mid, round(close, 4) AS close, round(open / mid, 4) AS open_ratio, round(close / mid, 4) AS close_ratio FROM a""")
def g03_u_shape(spark, sf_dir):
    return rounded(P.u_shape(_cells(spark, sf_dir), close=(20, 23)), ["open", "mid", "close", "open_ratio", "close_ratio"])


@register(f"""{BARS_SQL}, {_D}, t AS (SELECT slot, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT CAST(slot AS INTEGER) AS slot, round(avg(tr), 4) AS atr, count(*) AS n, round(100 * 0.25 / avg(tr), 4) AS cost_pct FROM t GROUP BY slot""")
def g04_spread_cost(spark, sf_dir):
    return rounded(P.spread_cost(hour_bars(spark, sf_dir), F.hour("ts")), ["atr", "cost_pct"])


@register(f"{BARS_SQL} SELECT symbol, CAST(ts AS DATE) AS day, CAST(round(close * 4) AS BIGINT) AS level, CAST(sum(volume) AS DOUBLE) AS volume FROM bars GROUP BY ALL")
def g05_volume_profile(spark, sf_dir):
    return P.volume_profile(_days(spark, sf_dir))


def area_sql(profile: str, tie_below: bool) -> str:
    """Value areas as a recursion over the sorted levels of each session."""
    choose = "below >= above" if tie_below else "below > above"
    return f"""{BARS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, p AS ({profile}),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY level) AS i, sum(volume) OVER (PARTITION BY symbol, day) AS total, count(*) OVER (PARTITION BY symbol, day) AS c,
  row_number() OVER (PARTITION BY symbol, day ORDER BY volume DESC, level) AS k FROM p),
r AS (SELECT symbol, day, i AS top, i AS lo, i AS hi, volume AS held, total, c FROM n WHERE k = 1
  UNION ALL SELECT symbol, day, top, CASE WHEN {choose} THEN lo - 1 ELSE lo END, CASE WHEN {choose} THEN hi ELSE hi + 1 END, held + CASE WHEN {choose} THEN below ELSE above END, total, c FROM (
    SELECT r.*, coalesce(b.volume, -1) AS below, coalesce(a.volume, -1) AS above FROM r LEFT JOIN n b ON b.symbol = r.symbol AND b.day = r.day AND b.i = r.lo - 1 LEFT JOIN n a ON a.symbol = r.symbol AND a.day = r.day AND a.i = r.hi + 1
    WHERE r.held < 0.7 * r.total AND (r.lo > 1 OR r.hi < r.c))),
f AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY hi - lo DESC) AS z FROM r)
SELECT f.symbol, f.day, t.level * 0.25::DOUBLE AS poc, l.level * 0.25::DOUBLE AS val, h.level * 0.25::DOUBLE AS vah, round(f.total, 4) AS volume FROM f
JOIN n t ON t.symbol = f.symbol AND t.day = f.day AND t.i = f.top JOIN n l ON l.symbol = f.symbol AND l.day = f.day AND l.i = f.lo JOIN n h ON h.symbol = f.symbol AND h.day = f.day AND h.i = f.hi WHERE z = 1"""


@register(area_sql("SELECT symbol, CAST(ts AS DATE) AS day, CAST(round(close * 4) AS BIGINT) AS level, CAST(sum(volume) AS DOUBLE) AS volume FROM bars GROUP BY ALL", True))
def g07_daily_value_areas(spark, sf_dir):
    return rounded(P.daily_value_areas(P.volume_profile(_days(spark, sf_dir))), ["volume"])


@register(f"""{BARS_SQL}, x AS (SELECT symbol, CAST(ts AS DATE) AS day, volume / (CAST(high * 4 AS BIGINT) - CAST(low * 4 AS BIGINT) + 1) AS v, unnest(range(CAST(low * 4 AS BIGINT), CAST(high * 4 AS BIGINT) + 1)) AS level FROM bars)
SELECT symbol, day, level, round(sum(v), 6) AS volume FROM x GROUP BY ALL""")
def g08_tpo_profile(spark, sf_dir):
    return P.tpo_profile(_days(spark, sf_dir))


def _calendar_sql() -> str:
    from ..operators import calendar as C

    return " UNION ALL ".join(f"SELECT DATE '2024-{m:02d}-{d:02d}' AS d, '{kind}' AS kind" for kind, days in (("FOMC", C.FOMC_2024), ("NFP", C.NFP_2024), ("CPI", C.CPI_2024)) for m, d in days)


@register(f"""{BARS_SQL}, e AS (SELECT d, min(kind) AS kind FROM ({_calendar_sql()}) GROUP BY d) SELECT b.symbol, b.ts, coalesce(e.kind, 'none') AS kind FROM bars b LEFT JOIN e ON e.d = CAST(b.ts AS DATE)""")
def g09_event_calendar(spark, sf_dir):
    """Bars marked with the year's fixed event days, from a small table; of two events on a day the first by name."""
    from ..operators.calendar import events_2024

    days = events_2024(spark).groupBy("d").agg(F.min("kind").alias("kind"))
    return _days(spark, sf_dir).join(F.broadcast(days), F.col("day") == F.col("d"), "left").select("symbol", "ts", F.coalesce("kind", F.lit("none")).alias("kind"))


@register(f"""{BARS_SQL}, x AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s, count(*) OVER w AS c FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, count(*) AS n, min(ts) AS first, max(ts) AS last, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (CAST(p AS DATE) = CAST(ts AS DATE) AND epoch_us(ts) - epoch_us(p) > 5400000000) AS gaps, count(*) FILTER (c >= 20 AND abs(close - m) > 2.0 * s) AS outliers FROM x GROUP BY symbol""")
def g10_quality_report(spark, sf_dir):
    return M.quality_report(hour_bars(spark, sf_dir), 5400, 20, 2.0)


_STATES = "s AS (SELECT symbol, ts, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS state, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars)"


def _states(spark, sf_dir):
    return hour_bars(spark, sf_dir).select("symbol", "ts", F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").otherwise("flat").alias("state"))


@register(f"{BARS_SQL}, {_STATES} SELECT state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY state")
def g11_distribution(spark, sf_dir):
    return rounded(M.distribution(_states(spark, sf_dir), "state"), ["share"], 6)


_TRADES = f"""{ONLY_TICKS}, trades AS (SELECT symbol, event_id, ts, user_id, CAST(px - lag(px) OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) / 4 * (CASE side WHEN 'B' THEN 1 WHEN 'A' THEN -1 ELSE 0 END) * 5 - 0.7 AS pnl FROM ticks),
tr AS (SELECT * FROM trades WHERE pnl IS NOT NULL)"""


def _trades(spark, sf_dir):
    """A stand-in for trades: each tick's move taken by its side, less costs."""
    w = Window.partitionBy("symbol").orderBy("ts")
    side = F.when(F.col("side") == "B", 1).when(F.col("side") == "A", -1).otherwise(0)
    return ticks(spark, sf_dir).withColumn("pnl", (F.col("px") - F.lag("px").over(w)) / F.lit(4.0) * side * 5 - F.lit(0.7)).where("pnl is not null").select("symbol", "event_id", "ts", "user_id", "side", "pnl")


_METRICS = ["win_rate", "net", "gross_win", "gross_loss", "avg_win", "avg_loss", "profit_factor", "expectancy"]


@register(f"""{_TRADES} SELECT symbol, count(*) AS n_trades, count(*) FILTER (pnl > 0) AS n_wins, count(*) FILTER (pnl <= 0) AS n_losses, round(count(*) FILTER (pnl > 0) / count(*), 4) AS win_rate, round(sum(pnl), 4) AS net,
round(coalesce(sum(pnl) FILTER (pnl > 0), 0.0), 4) AS gross_win, round(coalesce(sum(pnl) FILTER (pnl <= 0), 0.0), 4) AS gross_loss, round(coalesce(avg(pnl) FILTER (pnl > 0), 0.0), 4) AS avg_win, round(coalesce(avg(pnl) FILTER (pnl <= 0), 0.0), 4) AS avg_loss,
max(pnl) AS best, min(pnl) AS worst, round(coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl <= 0), 4) AS profit_factor, round(avg(pnl), 4) AS expectancy FROM tr GROUP BY symbol""")
def g12_trade_metrics(spark, sf_dir):
    return rounded(M.trade_metrics(_trades(spark, sf_dir), ["symbol"]), _METRICS)


@register(f"""{_TRADES}, d AS (SELECT symbol, CAST(ts AS DATE) AS date, sum(pnl) AS pnl FROM tr GROUP BY ALL)
SELECT symbol, round(CASE WHEN count(*) >= 2 AND stddev_samp(pnl) > 1e-10 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252) ELSE 0.0 END, 4) AS sharpe, round(avg(pnl) / sqrt(avg(pnl * pnl) FILTER (pnl < 0)) * sqrt(252), 4) AS sortino FROM d GROUP BY symbol""")
def g13_sharpe_sortino(spark, sf_dir):
    d = M.daily_pnl(_trades(spark, sf_dir), ["symbol"], "ts")
    return rounded(d.groupBy("symbol").agg(M.sharpe(F.col("pnl")).alias("sharpe"), M.sortino(F.col("pnl")).alias("sortino")), ["sharpe", "sortino"])


@register(f"""{_TRADES}, e AS (SELECT *, 1e6 + sum(pnl) OVER w AS equity FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY ts)), p AS (SELECT *, greatest(1e6, max(equity) OVER (PARTITION BY symbol ORDER BY ts)) AS peak FROM e),
g AS (SELECT *, sum(CASE WHEN round(equity, 6) < round(peak, 6) THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM p), u AS (SELECT symbol, g, count(*) FILTER (round(equity, 6) < round(peak, 6)) AS n, max(100 * (peak - equity) / peak) AS d FROM g GROUP BY ALL)
SELECT symbol, round(max(d), 4) AS max_drawdown_pct, CAST(max(n) AS BIGINT) AS longest_under_water FROM u GROUP BY symbol""")
def g15_drawdown(spark, sf_dir):
    return rounded(M.drawdown(_trades(spark, sf_dir), ["symbol"], ["ts"], 1e6), ["max_drawdown_pct"])


@register(f"{_TRADES}, d AS (SELECT symbol, CAST(ts AS DATE) AS date, sum(pnl) AS pnl FROM tr GROUP BY ALL) SELECT symbol, date, round(pnl, 4) AS pnl, round(sum(pnl) OVER (PARTITION BY symbol ORDER BY date), 4) AS total FROM d")
def g17_daily_pnl(spark, sf_dir):
    return rounded(M.daily_pnl(_trades(spark, sf_dir), ["symbol"], "ts"), ["pnl", "total"])


@register(f"{BARS_SQL}, {_STATES}, l AS (SELECT *, lead(state, 3) OVER (PARTITION BY symbol ORDER BY ts) AS l FROM s) SELECT symbol, round(avg(CASE WHEN state = l THEN 1.0 ELSE 0.0 END), 6) AS persistence FROM l WHERE l IS NOT NULL GROUP BY symbol")
def g20_persistence(spark, sf_dir):
    return rounded(M.persistence(_states(spark, sf_dir), ["symbol"], "ts", "state", 3), ["persistence"], 6)


@register(f"""{BARS_SQL}, {_STATES}, m AS (SELECT state AS "from", lead(state) OVER (PARTITION BY symbol ORDER BY ts) AS "to" FROM s) SELECT "from", "to", count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY "from"), 6) AS p FROM m WHERE "to" IS NOT NULL GROUP BY "from", "to" """)
def g21_transition_matrix(spark, sf_dir):
    return rounded(M.transition_matrix(_states(spark, sf_dir), ["symbol"], "ts", "state"), ["p"], 6)


@register(f"""{BARS_SQL}, {_STATES}, c AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS c FROM s), g AS (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM c), r AS (SELECT symbol, state, g, count(*) AS n FROM g GROUP BY ALL)
SELECT symbol, state, count(*) AS stints, round(avg(n), 6) AS mean_length, median(n) AS median_length FROM r GROUP BY symbol, state""")
def g22_stints(spark, sf_dir):
    return rounded(M.stints(_states(spark, sf_dir), ["symbol"], "ts", "state"), ["mean_length"], 6)


@register(f"""{BARS_SQL}, {_STATES} SELECT s.state, count(*) AS n, round(avg(b.high - b.low), 4) AS mean_range, median(b.volume) AS median_volume, round(stddev_pop(b.close - b.open), 4) AS move_sd FROM s JOIN bars b USING (symbol, ts) GROUP BY s.state""")
def g23_regime_metrics(spark, sf_dir):
    b = hour_bars(spark, sf_dir).withColumn("state", F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").otherwise("flat"))
    out = b.groupBy("state").agg(F.count("*").alias("n"), F.avg(F.col("high") - F.col("low")).alias("mean_range"), F.median("volume").alias("median_volume"), F.stddev_pop(F.col("close") - F.col("open")).alias("move_sd"))
    return rounded(out, ["mean_range", "move_sd"])


_PRED = "p AS (SELECT doc_id, (doc_id * 37 % 101) / 101.0::DOUBLE AS confidence, quality = 1 AS correct FROM labels)"


def _predictions(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("doc_id") * 37 % 101) / F.lit(101.0)).alias("confidence"), (F.col("quality") == 1).alias("correct"), "quality")


_BINS = f"WITH {_PRED}, b AS (SELECT CAST(greatest(ceil(confidence * 15) - 1, 0) AS INTEGER) AS bin, count(*) AS n, avg(confidence) AS confidence, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM p GROUP BY 1)"


@register(f"{_BINS} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM b")
def g25_calibration_error(spark, sf_dir):
    return rounded(M.calibration_error(_predictions(spark, sf_dir)), ["ece"], 6)


@register(f"WITH {_PRED} SELECT round(avg(power(1 - confidence - CASE WHEN correct THEN 0 ELSE 1 END, 2) + power(confidence - CASE WHEN correct THEN 1 ELSE 0 END, 2)), 6) AS brier FROM p")
def g26_brier(spark, sf_dir):
    p = _predictions(spark, sf_dir).withColumn("p0", 1 - F.col("confidence"))
    return rounded(M.brier(p, ["p0", "confidence"], "quality"), ["brier"], 6)


@register(f"{_BINS} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b")
def g27_reliability(spark, sf_dir):
    return rounded(M.reliability(_predictions(spark, sf_dir)), ["confidence", "accuracy"], 6)


@register(f"""WITH {_PRED}, t AS (SELECT (50 + 2 * unnest(range(21))) / 100.0::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (confidence >= threshold) AS n, count(*) FILTER (confidence >= threshold AND correct) AS hits, count(*) AS total, count(*) FILTER (correct) AS r FROM t, p GROUP BY threshold)
SELECT threshold, n, round(n / total, 6) AS trade_share, round(CASE WHEN n > 0 THEN hits / n ELSE 0 END, 6) AS precision, round(hits / r, 6) AS recall, hits * 1.0::DOUBLE - (n - hits) * 0.75::DOUBLE AS pnl FROM c""")
def g28_threshold_sweep(spark, sf_dir):
    out = M.threshold_sweep(_predictions(spark, sf_dir), [(50 + 2 * i) / 100 for i in range(21)], 1.0, 0.75)
    return rounded(out, ["trade_share", "precision", "recall"], 6)


@register("""WITH g AS (SELECT * FROM (VALUES ('a', 0.35::DOUBLE), ('b', 0.59), ('c', 0.85), ('d', 1.19)) v(broker, commission), (SELECT unnest([4, 6, 8]) AS target), (SELECT unnest([3, 4, 6]) AS stop)),
n AS (SELECT *, target * 1.25::DOUBLE - (commission * 2 + 1.25) AS net_win, stop * 1.25::DOUBLE + (commission * 2 + 1.25) AS net_loss FROM g)
SELECT broker, commission, target, stop, round(net_win, 4) AS net_win, round(net_loss, 4) AS net_loss, round(CASE WHEN net_win > 0 THEN net_loss / (net_win + net_loss) ELSE 1 END, 6) AS breakeven FROM n""")
def g29_cost_model(spark, sf_dir):
    out = M.costs(spark, {"a": 0.35, "b": 0.59, "c": 0.85, "d": 1.19}, [4, 6, 8], [3, 4, 6])
    return rounded(rounded(out, ["net_win", "net_loss"]), ["breakeven"], 6)


@register(f"""{ONLY_TICKS}, g AS (SELECT symbol, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS us FROM ticks), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us) AS k, count(*) OVER (PARTITION BY symbol) AS c FROM g WHERE us IS NOT NULL)
SELECT symbol, min(us) AS min_us, max(us) AS max_us, round(CAST(sum(us) AS DOUBLE) / count(*), 2) AS mean_us, max(us) FILTER (k = greatest(CAST(floor(c * 0.99) AS BIGINT), 1)) AS p99_us FROM n GROUP BY symbol""")
def g30_latency(spark, sf_dir):
    """Gaps between ticks: extremes, mean and the nearest-rank 99th percentile."""
    w = Window.partitionBy("symbol").orderBy("ts")
    g = ticks(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))).where("us is not null")
    n = g.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("us"))).withColumn("c", F.count("*").over(Window.partitionBy("symbol")))
    rank = F.greatest(F.floor(F.col("c") * 0.99), F.lit(1))
    out = n.groupBy("symbol").agg(F.min("us").alias("min_us"), F.max("us").alias("max_us"), (F.sum("us") / F.count("*")).alias("mean_us"), F.max(F.when(F.col("k") == rank, F.col("us"))).alias("p99_us"))
    return rounded(out, ["mean_us"], 2)


@register(f"""{_TRADES}, e AS (SELECT CAST(user_id % 4 AS BIGINT) AS reason, pnl FROM tr) SELECT reason, count(*) AS n, round(sum(pnl), 4) AS net FROM e GROUP BY reason""")
def g19_exit_reasons(spark, sf_dir):
    t = _trades(spark, sf_dir).withColumn("reason", F.col("user_id") % 4)
    return rounded(t.groupBy("reason").agg(F.count("*").alias("n"), F.sum("pnl").alias("net")), ["net"])


@register(f"""{BARS_SQL}, n AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, 2 + volume % 5 AS life FROM bars), a AS (SELECT symbol, i, unnest(range(i, i + life)) AS b, life FROM n), c AS (SELECT symbol, b, count(*) AS c FROM a GROUP BY ALL),
u AS (SELECT a.symbol, a.i, avg(1.0::DOUBLE / c.c) AS u FROM a JOIN c USING (symbol, b) GROUP BY ALL) SELECT symbol, i, round(u, 6) AS uniqueness, round(u / (SELECT avg(u) FROM u), 5) AS weight FROM u""")
def g33_sample_uniqueness(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("ts")
    lab = hour_bars(spark, sf_dir).select("symbol", F.row_number().over(w).cast("long").alias("i"), (2 + F.col("volume") % 5).alias("life"))
    out = M.uniqueness(lab, ["symbol"], "i", "life").select("symbol", "i", "uniqueness", "weight")
    return rounded(rounded(out, ["uniqueness"], 6), ["weight"], 5)


@register("SELECT CAST(vec_id % 7 AS BIGINT) AS k, count(*) AS n, round(avg(list_sum(list_transform(embedding, lambda x: x * x))), 4) AS norm2 FROM embeddings GROUP BY 1")
def d15_feature_matrix(spark, sf_dir):
    """Squared norms of a feature matrix, by group."""
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x * x).cast("double"))
    return rounded(table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 7).alias("k")).agg(F.count("*").alias("n"), F.avg(sq).alias("norm2")), ["norm2"])
