"""Signal queries: one for each signal, with SQL for those that SQL states plainly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators.enrich import enrich, structs
from ..operators.signals import REGISTRY, compute
from .base import BARS_SQL, hour_bars

_W = "w AS (PARTITION BY symbol ORDER BY ts)"


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def before(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _query(name: str, digits: int = 4, meta: tuple[str, ...] = (), **config):
    def query(spark, sf_dir):
        out = compute(hour_bars(spark, sf_dir), [name], **{name: config})
        s = F.col(name)
        return out.select("symbol", "ts", F.round(s["value"].cast("double"), digits).alias("value"), s["passes"].alias("passes"), s["direction"].alias("direction"), *[F.round(s[m], digits).alias(m) for m in meta])

    return query


def _signal(key: str, name: str, sql: str | None = None, meta: tuple[str, ...] = (), digits: int = 4, **config) -> None:
    register(f"{BARS_SQL}, {sql}" if sql else None, key)(_query(name, digits, meta, **config))


def _final(value: str, passes: str, direction: str, source: str, meta: str = "") -> str:
    return f"SELECT symbol, ts, round(coalesce(CAST({value} AS DOUBLE), 0.0), 4) AS value, coalesce({passes}, false) AS passes, coalesce({direction}, 'none') AS direction{meta} FROM {source}"


def _dir(long: str, short: str) -> str:
    return f"CASE WHEN {long} THEN 'long' WHEN {short} THEN 'short' END"


_signal("sg03_bollinger", "bollinger", f"x AS (SELECT *, CASE WHEN count(*) OVER f >= 20 THEN avg(close) OVER f END AS m, CASE WHEN count(*) OVER f >= 20 THEN stddev_samp(close) OVER f END AS s FROM bars WINDOW f AS {frame(20)}) "
        + _final("CASE WHEN s > 1e-10 THEN (close - m) / s END", "close > m + 2 * s OR close < m - 2 * s", _dir("close < m - 2 * s", "close > m + 2 * s"), "x", ", round(m + 2 * s, 4) AS upper, round(m - 2 * s, 4) AS lower"), ("upper", "lower"))

_DELTA = "CASE WHEN buy_volume + sell_volume > 0 THEN CAST(buy_volume - sell_volume AS DOUBLE) WHEN high > low THEN volume * (2 * (close - low) / (high - low) - 1) ELSE 0 END"
_signal("sg04_cvd_divergence", "cvd_divergence", f"""n AS (SELECT *, row_number() OVER w AS i, sum({_DELTA}) OVER (PARTITION BY symbol ORDER BY ts) AS c FROM bars WINDOW {_W}),
s AS (SELECT *, CASE WHEN count(*) OVER f >= 20 THEN regr_slope(c, i) OVER f END AS sc, CASE WHEN count(*) OVER f >= 20 THEN regr_slope(close, i) OVER f END AS sp FROM n WINDOW f AS {frame(20)}),
z AS (SELECT *, CASE WHEN count(sc) OVER f >= 2 THEN stddev_samp(sc) OVER f END AS sd FROM s WINDOW f AS {frame(20)}) """
        + _final("CASE WHEN sd > 1e-10 THEN sc / sd END", "sign(sc) * sign(sp) < 0 AND abs(CASE WHEN sd > 1e-10 THEN sc / sd END) >= 1.5", _dir("sign(sc) * sign(sp) < 0 AND sc > 0", "sign(sc) * sign(sp) < 0"), "z"), digits=4)

_signal("sg05_donchian_channel", "donchian_channel", f"""x AS (SELECT *, CASE WHEN count(*) OVER b >= 20 THEN max(high) OVER b END AS u, CASE WHEN count(*) OVER b >= 20 THEN min(low) OVER b END AS l,
  CASE WHEN count(*) OVER c >= 10 THEN max(high) OVER c END AS xu, CASE WHEN count(*) OVER c >= 10 THEN min(low) OVER c END AS xl FROM bars WINDOW b AS {before(20)}, c AS {before(10)}),
y AS (SELECT *, list(u - l) OVER f AS ws, count(u - l) OVER f AS n FROM x WINDOW f AS {frame(100)}) """
        + _final("u - l", "close > u OR close < l", _dir("close > u", "close < l"), "y", ", u AS upper, l AS lower, xu AS exit_upper, xl AS exit_lower, round(CASE WHEN n >= 100 THEN 100.0::DOUBLE * len(list_filter(ws, lambda w: w < u - l)) / len(ws) END, 4) AS width_percentile"), ("upper", "lower", "exit_upper", "exit_lower", "width_percentile"))

_SESSION = "o AS (SELECT *, CAST(ts AS DATE) AS day, epoch(ts) / 60 % 1440 AS m, min(epoch(ts) / 60 % 1440) OVER (PARTITION BY symbol, CAST(ts AS DATE)) AS o FROM bars)"
for _key, _n in (("sg09_initial_balance", 180), ("sg09_initial_balance_60", 60)):
    _signal(_key, "initial_balance", f"""{_SESSION}, x AS (SELECT *, max(high) FILTER (m < o + {_n}) OVER d AS hi, min(low) FILTER (m < o + {_n}) OVER d AS lo, max(high) OVER r AS up, min(low) OVER r AS dn, m < o + {_n} AS inside FROM o
  WINDOW d AS (PARTITION BY symbol, day), r AS (PARTITION BY symbol, day ORDER BY ts)) """
            + _final("CASE WHEN NOT inside THEN least(abs(close - hi), abs(close - lo)) END", "NOT inside AND up <= hi + 0.5 AND dn >= lo - 0.5 AND least(abs(close - hi), abs(close - lo)) <= 1.5", _dir("false", "NOT inside AND abs(close - hi) <= abs(close - lo)").replace(" END", " WHEN NOT inside THEN 'long' END"), "x", ", CASE WHEN NOT inside THEN hi END AS ib_high, CASE WHEN NOT inside THEN lo END AS ib_low"), ("ib_high", "ib_low"), minutes=_n)

_signal("sg12_mfi", "mfi", f"""t AS (SELECT *, (high + low + close) / 3 AS t, lag((high + low + close) / 3) OVER w AS p FROM bars WINDOW {_W}),
u AS (SELECT *, CASE WHEN p IS NOT NULL THEN CASE WHEN t > p THEN t * volume ELSE 0 END END AS up, CASE WHEN p IS NOT NULL THEN CASE WHEN t < p THEN t * volume ELSE 0 END END AS dn FROM t),
v AS (SELECT *, CASE WHEN count(up) OVER f >= 14 THEN 100 - 100 / (1 + sum(up) OVER f / greatest(sum(dn) OVER f, 1e-10)) ELSE 50 END AS v FROM u WINDOW f AS {frame(14)}) """
        + _final("v", "v < 20 OR v > 80", _dir("v < 20", "v > 80"), "v"))

_signal("sg13_obv", "obv", f"""p AS (SELECT *, row_number() OVER w AS i, lag(close) OVER w AS p FROM bars WINDOW {_W}), o AS (SELECT *, CAST(sum(CASE WHEN close > p THEN volume WHEN close < p THEN -volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) AS o FROM p),
k AS (SELECT *, CASE WHEN count(*) OVER f >= 10 THEN round(regr_slope(o, i) OVER f, 9) END AS k FROM o WINDOW f AS {frame(10)}) """ + _final("k", "abs(k) > 0", _dir("k > 0", "k < 0"), "k", ", o AS obv"), ("obv",))

_signal("sg14_orb_breakout", "orb_breakout", f"""{_SESSION}, x AS (SELECT *, max(high) FILTER (m <= o + 240) OVER d AS hi, min(low) FILTER (m <= o + 240) OVER d AS lo, count(*) FILTER (m <= o + 240) OVER d >= 3 AND m > o + 240 AS ready FROM o WINDOW d AS (PARTITION BY symbol, day)) """
        + _final("CASE WHEN ready AND close > hi THEN (close - hi) / 0.25 WHEN ready AND close < lo THEN (lo - close) / 0.25 END", "ready AND (close > hi OR close < lo)", _dir("ready AND close > hi", "ready AND close < lo"), "x"), minutes=240)

_signal("sg17_prior_day_bias", "prior_day_bias", f"""d AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(vwap * volume) / sum(volume) AS v FROM bars GROUP BY ALL), q AS (SELECT symbol, day, lag(v) OVER (PARTITION BY symbol ORDER BY day) AS pv FROM d),
g AS (SELECT b.*, day, close - pv AS gap FROM bars b JOIN q ON q.symbol = b.symbol AND q.day = CAST(b.ts AS DATE)), a AS (SELECT *, CASE WHEN count(gap) OVER f >= 5 THEN avg(CASE WHEN gap > 0 THEN 1.0 WHEN gap <= 0 THEN 0.0 END) OVER f END AS above FROM g WINDOW f AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) """
        + _final("gap / 0.25", "abs(gap) >= 0.5 AND ((gap > 0 AND above >= 0.6) OR (gap < 0 AND 1 - above >= 0.6))", _dir("abs(gap) >= 0.5 AND gap > 0 AND above >= 0.6", "abs(gap) >= 0.5 AND gap < 0 AND 1 - above >= 0.6"), "a"))

_signal("sg18_prior_day_levels", "prior_day_levels", """d AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM bars GROUP BY ALL), q AS (SELECT symbol, day, lag(h) OVER w AS h, lag(l) OVER w AS l, lag(c) OVER w AS c FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
x AS (SELECT b.symbol, ts, abs(close - h) AS dh, abs(close - l) AS dl, h, l, c FROM bars b JOIN q ON q.symbol = b.symbol AND q.day = CAST(b.ts AS DATE)) """ + _final("least(dh, dl)", "dh <= 1.5 OR dl <= 1.5", "CASE WHEN dh <= 1.5 THEN 'short' WHEN dl <= 1.5 THEN 'long' END", "x", ", h AS pdh, l AS pdl, c AS pdc"), ("pdh", "pdl", "pdc"))

_REL = f"x AS (SELECT *, coalesce(CASE WHEN count(*) OVER f >= 19 THEN volume / avg(volume) OVER f END, 1.0) AS v FROM bars WINDOW f AS {before(19)}) "
_signal("sg20_relative_volume", "relative_volume", _REL + _final("v", "v >= 1.5", "NULL", "x"))
_signal("sg27_volume_exhaustion", "volume_exhaustion", _REL + _final("v", "v < 0.4", _dir("sell_volume > buy_volume", "buy_volume > sell_volume"), "x"))

_signal("sg22_session_time", "session_time", "x AS (SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS e FROM bars) " + _final("hour(e) * 60 + minute(e)", "true", "NULL", "x"))
for _key, _n in (("sg23_sma_trend", 50), ("sg23_sma_trend_200", 200)):
    _signal(_key, "sma_trend", f"x AS (SELECT *, CASE WHEN count(*) OVER f >= {_n} THEN avg(close) OVER f END AS m FROM bars WINDOW f AS {frame(_n)}) " + _final("100 * (close - m) / m", "true", _dir("100 * (close - m) / m > 0", "100 * (close - m) / m < 0"), "x"), n=_n)
_signal("sg24_spread", "spread", f"""p AS (SELECT *, avg_ask - avg_bid AS sp FROM bars WHERE avg_bid > -1e9), q AS (SELECT *, CASE WHEN avg_bid > 0 AND avg_ask > 0 THEN sp END AS s FROM p),
x AS (SELECT *, CASE WHEN count(s) OVER f >= 30 THEN avg(s) OVER f END AS m, CASE WHEN count(s) OVER f >= 30 THEN stddev_samp(s) OVER f END AS sd FROM q WINDOW f AS {frame(500)}) """
        + _final("CASE WHEN sd > 1e-10 THEN (s - m) / sd WHEN sd IS NOT NULL THEN 0 END", "abs(CASE WHEN sd > 1e-10 THEN (s - m) / sd WHEN sd IS NOT NULL THEN 0 END) <= 2", "NULL", "x"))

_signal("sg25_stochastic", "stochastic", f"""h AS (SELECT *, CASE WHEN count(*) OVER f >= 14 THEN max(high) OVER f END AS h, CASE WHEN count(*) OVER f >= 14 THEN min(low) OVER f END AS l FROM bars WINDOW f AS {frame(14)}),
r AS (SELECT *, CASE WHEN h > l THEN 100 * (close - l) / (h - l) WHEN h IS NOT NULL THEN 50 END AS r FROM h), k AS (SELECT *, CASE WHEN count(r) OVER f >= 3 THEN avg(r) OVER f END AS k FROM r WINDOW f AS {frame(3)}),
d AS (SELECT *, CASE WHEN count(k) OVER f >= 3 THEN avg(k) OVER f END AS d FROM k WINDOW f AS {frame(3)}), x AS (SELECT *, lag(k) OVER w AS pk, lag(d) OVER w AS pd FROM d WINDOW {_W}) """
        + _final("k", "(pk <= pd AND k > d AND k < 20) OR (pk >= pd AND k < d AND k > 80)", _dir("pk <= pd AND k > d AND k < 20", "pk >= pd AND k < d AND k > 80"), "x"))

_SV = "v AS (SELECT *, sum(vwap * volume) OVER d / sum(volume) OVER d AS v FROM bars WINDOW d AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts))"
_signal("sg29_vwap_bias", "vwap_bias", f"{_SV}, x AS (SELECT *, CASE WHEN count(*) OVER f >= 10 THEN avg(CASE WHEN round(close - v, 9) > 0 THEN 1.0 ELSE 0.0 END) OVER f END AS a, CASE WHEN count(*) OVER f >= 10 THEN avg(CASE WHEN round(close - v, 9) < 0 THEN 1.0 ELSE 0.0 END) OVER f END AS b FROM v WINDOW f AS {frame(10)}) "
        + _final("greatest(a, b)", "greatest(a, b) >= 0.7", "CASE WHEN a >= b THEN 'long' ELSE 'short' END", "x"))
_signal("sg30_vwap_deviation", "vwap_deviation", f"x AS (SELECT *, close - vwap AS d, CASE WHEN count(*) OVER f >= 20 THEN stddev_samp(close - vwap) OVER f END AS s FROM bars WINDOW f AS {frame(20)}), z AS (SELECT *, CASE WHEN s > 1e-10 THEN d / s END AS z FROM x) " + _final("z", "abs(z) >= 1.5", _dir("z < 0", "z > 0"), "z"))

_signal("sg31_vwap_session", "vwap_session", f"""t AS (SELECT *, CAST(ts AS DATE) AS day, (high + low + close) / 3 AS t, row_number() OVER w AS i FROM bars WINDOW {_W}),
v AS (SELECT *, sum(t * volume) OVER d / sum(volume) OVER d AS v, sum(t * t * volume) OVER d / sum(volume) OVER d AS q, count(*) OVER d AS age FROM t WINDOW d AS (PARTITION BY symbol, day ORDER BY ts)),
s AS (SELECT *, sqrt(greatest(q - v * v, 0)) AS sd FROM v), x AS (SELECT *, CASE WHEN sd > 1e-3 THEN (close - v) / sd ELSE 0 END AS dev FROM s) """
        + _final("dev", "true", _dir("round(dev, 6) < 0", "round(dev, 6) > 0"), "x", ", round(v, 4) AS vwap, age AS session_age_bars"), ("vwap", "session_age_bars"))
_signal("sg32_vwap_slope", "vwap_slope", f"{_SV}, x AS (SELECT *, v - lag(v, 10) OVER w AS dv, CASE WHEN count(*) OVER f >= 10 THEN avg(high - low) OVER f END AS r FROM v WINDOW {_W}, f AS {frame(10)}), z AS (SELECT *, CASE WHEN r > 0 THEN dv / (10 * r) END AS z FROM x) " + _final("z", "abs(z) <= 0.01", _dir("z > 0", "z < 0"), "z"))

_signal("sg28_vpin", "vpin", f"""e AS (SELECT *, sum(volume) OVER (PARTITION BY symbol ORDER BY ts) AS e, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS buy FROM bars),
p AS (SELECT symbol, ts, e - volume AS b, e, buy, unnest(range(CAST((e - volume) // 100 AS BIGINT), CAST((e - 1) // 100 AS BIGINT) + 1)) AS k FROM e),
f AS (SELECT symbol, k, sum((least(e, (k + 1) * 100) - greatest(b, k * 100)) * (2 * buy - 1)) AS d, sum(least(e, (k + 1) * 100) - greatest(b, k * 100)) AS v, max(ts) AS ts FROM p GROUP BY symbol, k HAVING sum(least(e, (k + 1) * 100) - greatest(b, k * 100)) = 100),
r AS (SELECT symbol, ts, k, avg(abs(d) / 100) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS x FROM f), l AS (SELECT symbol, ts, arg_max(x, k) AS x FROM r GROUP BY ALL),
j AS (SELECT b.symbol, b.ts, last_value(l.x IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM bars b LEFT JOIN l USING (symbol, ts)) """ + _final("x", "x > 0.55", "NULL", "j"))


def _ema_sql(column: str, n: int, out: str, base: str = "n") -> str:
    a = 2.0 / (n + 1)
    return f"{out} AS (SELECT symbol, i, {column} AS v FROM {base} WHERE i = 1 UNION ALL SELECT n.symbol, n.i, {a!r}::DOUBLE * n.{column} + {1 - a!r}::DOUBLE * p.v FROM {out} p JOIN {base} n ON n.symbol = p.symbol AND n.i = p.i + 1)"


def _recursive(key: str, name: str, sql: str, meta: tuple[str, ...] = (), **config) -> None:
    register(BARS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + sql, key)(_query(name, 4, meta, **config))


_N = f"n AS (SELECT *, row_number() OVER w AS i, lag(close) OVER w AS pc FROM bars WINDOW {_W})"
_TR = "t AS (SELECT *, coalesce(greatest(high - low, abs(high - pc), abs(low - pc)), high - low) AS tr FROM n)"


def _wilder_sql(out: str, column: str, n: int, base: str) -> str:
    return f"{out} AS (SELECT symbol, i, {column} AS v FROM {base} WHERE i = 1 UNION ALL SELECT x.symbol, x.i, CASE WHEN x.i <= {n} THEN (p.v * (x.i - 1) + x.{column}) / x.i ELSE (p.v * {n - 1} + x.{column}) / {n} END FROM {out} p JOIN {base} x ON x.symbol = p.symbol AND x.i = p.i + 1)"


_GAP = f"""g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS d, count(*) OVER (PARTITION BY symbol) AS c FROM n), m AS (SELECT symbol, floor(3 * median(d)) AS m FROM g WHERE i BETWEEN 2 AND 50 GROUP BY symbol),
t AS (SELECT g.*, CASE WHEN d > CASE WHEN c > 2 THEN m ELSE 6e8 END THEN high - low ELSE coalesce(greatest(high - low, abs(high - pc), abs(low - pc)), high - low) END AS tr FROM g LEFT JOIN m USING (symbol))"""
_recursive("sg01_atr", "atr", f"{_N}, {_GAP}, {_wilder_sql('a', 'tr', 14, 't')}, j AS (SELECT n.symbol, n.ts, a.v FROM n JOIN a USING (symbol, i)) " + _final("v / 0.25", "true", "NULL", "j", ", round(v, 4) AS atr_raw"), ("atr_raw",))
_recursive("sg06_ema_crossover", "ema_crossover", f"{_N}, {_ema_sql('close', 8, 'f')}, {_ema_sql('close', 21, 's')}, d AS (SELECT n.symbol, n.ts, f.v - s.v AS d, f.v AS fast FROM n JOIN f USING (symbol, i) JOIN s USING (symbol, i)), x AS (SELECT *, lag(d) OVER w AS b FROM d WINDOW {_W}) "
           + _final("d", "(b <= 0 AND d > 0) OR (b >= 0 AND d < 0)", _dir("d > 0", "d < 0"), "x", ", round(fast, 4) AS fast"), ("fast",))
_recursive("sg07_ema_ribbon", "ema_ribbon", f"{_N}, {_TR}, {_wilder_sql('a', 'tr', 14, 't')}, {', '.join(_ema_sql('close', k, f'e{k}') for k in (8, 13, 21, 34, 55))}, j AS (SELECT n.symbol, n.ts, n.close, a.v AS atr, e8.v AS a, e13.v AS b, e21.v AS c, e34.v AS d, e55.v AS e FROM n JOIN a USING (symbol, i) JOIN e8 USING (symbol, i) JOIN e13 USING (symbol, i) JOIN e21 USING (symbol, i) JOIN e34 USING (symbol, i) JOIN e55 USING (symbol, i)) "
           + _final("a - e", "((a > b AND b > c AND c > d AND d > e) OR (a < b AND b < c AND c < d AND d < e)) AND least(abs(close - a), abs(close - b)) <= atr", _dir("a > b AND b > c AND c > d AND d > e", "a < b AND b < c AND c < d AND d < e"), "j", ", round(a, 4) AS ema_8, round(c, 4) AS ema_21"), ("ema_8", "ema_21"))
_recursive("sg21_rsi_momentum", "rsi_momentum", f"""{_N}, d AS (SELECT symbol, i - 1 AS i, ts, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS dn FROM n WHERE i > 1),
s AS (SELECT symbol, 14 AS i, sum(up) / 14 AS u, sum(dn) / 14 AS w FROM d WHERE i <= 14 GROUP BY symbol HAVING count(*) = 14),
r AS (SELECT symbol, CAST(i AS BIGINT) AS i, u, w FROM s UNION ALL SELECT d.symbol, d.i, (r.u * 13 + d.up) / 14, (r.w * 13 + d.dn) / 14 FROM r JOIN d ON d.symbol = r.symbol AND d.i = r.i + 1),
x AS (SELECT n.symbol, n.ts, CASE WHEN r.i IS NULL THEN 50.0 WHEN r.w < 1e-10 THEN 100 ELSE 100 - 100 / (1 + r.u / r.w) END AS v FROM n LEFT JOIN r ON r.symbol = n.symbol AND r.i = n.i - 1) """ + _final("v", "v > 50 OR v < 50", _dir("v > 50", "v < 50"), "x"))

def _seeded(out: str, base: str, column: str, first: int, n: int, step: str) -> str:
    """A recursion over ``base (symbol, i, column)`` that begins with the mean of n values, the first at row ``first``."""
    return f"""{out}_0 AS (SELECT symbol, CAST({first + n - 1} AS BIGINT) AS i, avg({column}) AS v FROM {base} WHERE i BETWEEN {first} AND {first + n - 1} GROUP BY symbol HAVING count({column}) = {n}),
{out} AS (SELECT * FROM {out}_0 UNION ALL SELECT x.symbol, x.i, {step} FROM {out} p JOIN {base} x ON x.symbol = p.symbol AND x.i = p.i + 1)"""


def _smooth(column: str, n: int) -> str:
    return f"{2.0 / (n + 1)!r}::DOUBLE * x.{column} + {1 - 2.0 / (n + 1)!r}::DOUBLE * p.v"


_recursive("sg10_keltner_channel", "keltner_channel", f"""{_N}, {_TR}, {_ema_sql('close', 20, 'm')}, {_seeded('a', 't', 'tr', 2, 20, '(p.v * 19 + x.tr) / 20')},
j AS (SELECT n.symbol, n.ts, n.close, m.v AS m, a.v AS a FROM n JOIN m USING (symbol, i) LEFT JOIN a USING (symbol, i)) """
           + _final("CASE WHEN a > 0 THEN (close - m) / a END", "true", _dir("close > m + 1.5 * a", "close < m - 1.5 * a"), "j", ", round(m + 1.5 * a, 4) AS upper, round(m - 1.5 * a, 4) AS lower"), ("upper", "lower"))

_recursive("sg11_macd", "macd", f"""{_N}, {_seeded('f', 'n', 'close', 1, 12, _smooth('close', 12))}, {_seeded('s', 'n', 'close', 1, 26, _smooth('close', 26))}, l AS (SELECT symbol, i, f.v - s.v AS l FROM f JOIN s USING (symbol, i)), {_seeded('g', 'l', 'l', 26, 9, _smooth('l', 9))},
j AS (SELECT n.symbol, n.ts, l.l, l.l - g.v AS h FROM n LEFT JOIN l USING (symbol, i) LEFT JOIN g USING (symbol, i)), x AS (SELECT *, lag(l) OVER w AS p, min(abs(l)) OVER b AS lo FROM j WINDOW {_W}, b AS {before(3)}) """
           + _final("h", "lo <= 0.5 AND ((l > 0 AND l > p AND h > 0) OR (l < 0 AND l < p AND h < 0))", _dir("lo <= 0.5 AND l > 0 AND l > p AND h > 0", "lo <= 0.5 AND l < 0 AND l < p AND h < 0"), "x", ", round(l, 4) AS line"), ("line",))

_recursive("sg15_orb_range_size", "orb_range_size", f"""{_N}, {_TR}, {_wilder_sql('a', 'tr', 14, 't')}, o AS (SELECT n.*, a.v AS atr, CAST(ts AS DATE) AS day, epoch(ts) / 60 % 1440 AS m, min(epoch(ts) / 60 % 1440) OVER (PARTITION BY symbol, CAST(ts AS DATE)) AS o FROM n JOIN a USING (symbol, i)),
x AS (SELECT *, m <= o + 15 AS inside, max(high) FILTER (m <= o + 15) OVER d - min(low) FILTER (m <= o + 15) OVER d AS span FROM o WINDOW d AS (PARTITION BY symbol, day)), y AS (SELECT *, CASE WHEN NOT inside AND atr > 0 THEN span / atr END AS v FROM x) """
           + _final("v", "v BETWEEN 0.3 AND 1.5", "NULL", "y"))

_signal("sg16_poc_distance", "poc_distance", f"""n AS (SELECT *, row_number() OVER w AS i FROM bars WINDOW {_W}), l AS (SELECT a.symbol, a.i, b.close AS p, sum(b.volume) AS v, min(b.i) AS f FROM n a JOIN n b ON b.symbol = a.symbol AND b.i BETWEEN a.i - 29 AND a.i GROUP BY ALL),
q AS (SELECT symbol, i, p, row_number() OVER (PARTITION BY symbol, i ORDER BY v DESC, f) AS k FROM l), x AS (SELECT n.symbol, n.ts, (n.close - q.p) / 0.25 AS d, q.p AS poc FROM n JOIN q USING (symbol, i) WHERE k = 1) """
        + _final("d", "abs(d) >= 4", _dir("d < 0", "d > 0"), "x", ", poc"), ("poc",))

_recursive("sg02_adx", "adx", f"""{_N.replace("lag(close) OVER w AS pc", "lag(close) OVER w AS pc, high - lag(high) OVER w AS um, lag(low) OVER w - low AS dm, count(*) OVER (PARTITION BY symbol) AS c")},
d AS (SELECT symbol, i - 1 AS i, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END AS pl, CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END AS mi FROM n WHERE i > 1),
r AS (SELECT symbol, i, tr, CAST(pl AS DOUBLE) AS pl, CAST(mi AS DOUBLE) AS mi FROM d WHERE i = 1 UNION ALL SELECT d.symbol, d.i, (r.tr * 13 + d.tr) / 14, (r.pl * 13 + d.pl) / 14, (r.mi * 13 + d.mi) / 14 FROM r JOIN d ON d.symbol = r.symbol AND d.i = r.i + 1),
u AS (SELECT symbol, i, CASE WHEN tr > 1e-10 THEN 100 * pl / tr ELSE 0 END AS p, CASE WHEN tr > 1e-10 THEN 100 * mi / tr ELSE 0 END AS m FROM r), y AS (SELECT *, CASE WHEN p + m > 1e-10 THEN 100 * abs(p - m) / (p + m) ELSE 0 END AS dx FROM u),
a AS (SELECT symbol, i, dx AS v FROM y WHERE i = 1 UNION ALL SELECT y.symbol, y.i, (a.v * 13 + y.dx) / 14 FROM a JOIN y ON y.symbol = a.symbol AND y.i = a.i + 1),
x AS (SELECT n.symbol, n.ts, CASE WHEN n.i > 28 AND n.c > 28 THEN a.v ELSE 0 END AS v, CASE WHEN n.i > 28 AND n.c > 28 THEN u.p ELSE 0 END AS p, CASE WHEN n.i > 28 AND n.c > 28 THEN u.m ELSE 0 END AS m FROM n LEFT JOIN u ON u.symbol = n.symbol AND u.i = n.i - 1 LEFT JOIN a ON a.symbol = n.symbol AND a.i = n.i - 1) """
           + _final("v", "v >= 25", _dir("p > m", "m > p"), "x", ", round(p, 4) AS plus_di, round(m, 4) AS minus_di"), ("plus_di", "minus_di"))

for _key, _name in [("sg08_hmm_regime", "hmm_regime"), ("sg19_regime_v2", "regime_v2"), ("sg26_value_area", "value_area")]:
    _signal(_key, _name)


#: The signals that a struct column exists for, in alphabetical order.
def _all_signals() -> list[str]:
    compute(None, [])
    return sorted(REGISTRY)


@register()
def v00_enrich_all(spark, sf_dir):
    """All signals at once, values only."""
    names = _all_signals()
    out = compute(hour_bars(spark, sf_dir), names)
    return out.select("symbol", "ts", *[F.round(F.col(n)["value"], 4).alias(f"sig_{n}_value") for n in names])


def _flat(key: str, name: str, columns: dict[str, int | None], sql: str | None) -> None:
    """A query of a signal's flat columns; those with a number of digits are rounded."""

    def query(spark, sf_dir):
        out = enrich(hour_bars(spark, sf_dir), [name])
        return out.select("symbol", "ts", *[(F.round(c, d) if d is not None else F.col(c)).alias(c) for c, d in columns.items()])

    register(sql, key)(query)


def _cols(columns: dict[str, int | None]) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" if d is not None else c for c, d in columns.items())


_V1 = {"sig_atr_value": 4, "sig_atr_raw": 4, "sig_atr_percentile": 4, "sig_atr_vol_regime": None}
_flat("v01_flat_atr", "atr", _V1, BARS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_N}, {_TR}, {_wilder_sql('a', 'tr', 14, 't')}, j AS (SELECT n.symbol, n.ts, n.i, a.v AS sig_atr_raw, a.v / 0.25 AS sig_atr_value FROM n JOIN a USING (symbol, i)),
l AS (SELECT *, list(sig_atr_raw) OVER f AS w FROM j WINDOW f AS {frame(100)}), p AS (SELECT *, CASE WHEN i = 1 THEN 50.0::DOUBLE ELSE 100.0::DOUBLE * len(list_filter(w, lambda x: x < sig_atr_raw)) / len(w) END AS sig_atr_percentile FROM l),
r AS (SELECT *, CASE WHEN sig_atr_percentile < 25 THEN 'LOW' WHEN sig_atr_percentile > 75 THEN 'HIGH' ELSE 'NORMAL' END AS sig_atr_vol_regime FROM p) SELECT symbol, ts, {_cols(_V1)} FROM r""")

_V2 = {"sig_vwap_vwap": 4, "sig_vwap_sd": 3, "sig_vwap_value": 3, "sig_vwap_session_age": None, "sig_vwap_direction": None, "sig_vwap_first_kiss": None}
_flat("v02_flat_vwap", "vwap_session", _V2, f"""{BARS_SQL}, t AS (SELECT *, CAST(ts AS DATE) AS day, (high + low + close) / 3 AS t FROM bars), v AS (SELECT *, sum(t * volume) OVER d / sum(volume) OVER d AS sig_vwap_vwap, sum(t * t * volume) OVER d / sum(volume) OVER d AS q, count(*) OVER d AS sig_vwap_session_age FROM t WINDOW d AS (PARTITION BY symbol, day ORDER BY ts)),
s AS (SELECT *, sqrt(greatest(q - sig_vwap_vwap * sig_vwap_vwap, 0)) AS sig_vwap_sd FROM v), e AS (SELECT *, CASE WHEN sig_vwap_sd > 1e-3 THEN (close - sig_vwap_vwap) / sig_vwap_sd ELSE 0.0 END AS sig_vwap_value FROM s),
x AS (SELECT *, CASE WHEN sig_vwap_sd > 1e-3 AND abs(sig_vwap_value) >= 1 THEN CASE WHEN sig_vwap_value < 0 THEN 'long' ELSE 'short' END ELSE 'none' END AS sig_vwap_direction, coalesce(sig_vwap_sd > 1e-3 AND abs(sig_vwap_value) < 0.5 AND max(abs(sig_vwap_value)) OVER (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) >= 1.5, false) AS sig_vwap_first_kiss FROM e) SELECT symbol, ts, {_cols(_V2)} FROM x""")

_V3 = {"sig_rvol_value": 4, "sig_rvol_passes": None}
_flat("v03_flat_relative_volume", "relative_volume", _V3, f"""{BARS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, avg(volume) OVER b AS m FROM bars WINDOW b AS {before(19)}), x AS (SELECT *, CASE WHEN i > 20 THEN volume / m ELSE 1.0 END AS sig_rvol_value, i > 20 AND volume / m >= 1.5 AS sig_rvol_passes FROM m) SELECT symbol, ts, {_cols(_V3)} FROM x""")

_V4 = {"sig_spread_value": 4, "sig_spread_passes": None}
_flat("v04_flat_spread", "spread", _V4, f"""{BARS_SQL}, s AS (SELECT *, CASE WHEN avg_ask > avg_bid THEN avg_ask - avg_bid END AS s FROM bars), z AS (SELECT *, CASE WHEN count(s) OVER r >= 30 AND stddev_samp(s) OVER r > 1e-12 THEN (last_value(s IGNORE NULLS) OVER r - avg(s) OVER r) / stddev_samp(s) OVER r ELSE 0.0 END AS sig_spread_value FROM s WINDOW r AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x AS (SELECT *, abs(sig_spread_value) < 2 AS sig_spread_passes FROM z) SELECT symbol, ts, {_cols(_V4)} FROM x""")

_V5 = {"sig_adx_value": 4, "sig_adx_plus_di": 4, "sig_adx_minus_di": 4, "sig_adx_passes": None, "sig_adx_direction": None}
_flat("v05_flat_adx", "adx", _V5, BARS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_N.replace("lag(close) OVER w AS pc", "lag(close) OVER w AS pc, high - lag(high) OVER w AS um, lag(low) OVER w - low AS dm")},
d AS (SELECT symbol, i - 1 AS i, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CAST(CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END AS DOUBLE) AS pl, CAST(CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END AS DOUBLE) AS mi FROM n WHERE i > 1),
{_wilder_sql('wt', 'tr', 14, 'd')}, {_wilder_sql('wp', 'pl', 14, 'd')}, {_wilder_sql('wm', 'mi', 14, 'd')}, u AS (SELECT symbol, i, CASE WHEN wt.v > 0 THEN 100 * wp.v / wt.v ELSE 0.0 END AS p, CASE WHEN wt.v > 0 THEN 100 * wm.v / wt.v ELSE 0.0 END AS m FROM wt JOIN wp USING (symbol, i) JOIN wm USING (symbol, i)),
y AS (SELECT *, CASE WHEN p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0.0 END AS dx FROM u), {_wilder_sql('a', 'dx', 14, 'y')},
x AS (SELECT n.symbol, n.ts, coalesce(a.v, 0.0) AS sig_adx_value, coalesce(u.p, 0.0) AS sig_adx_plus_di, coalesce(u.m, 0.0) AS sig_adx_minus_di, coalesce(a.v, 0.0) >= 25 AS sig_adx_passes, CASE WHEN u.p > u.m THEN 'long' WHEN u.m > u.p THEN 'short' ELSE 'none' END AS sig_adx_direction FROM n LEFT JOIN u ON u.symbol = n.symbol AND u.i = n.i - 1 LEFT JOIN a ON a.symbol = n.symbol AND a.i = n.i - 1) SELECT symbol, ts, {_cols(_V5)} FROM x""")

_V6 = {"sig_dc_value": 4, "sig_dc_entry_upper": None, "sig_dc_entry_lower": None, "sig_dc_exit_upper": None, "sig_dc_exit_lower": None, "sig_dc_passes": None, "sig_dc_direction": None}
_flat("v06_flat_donchian", "donchian_channel", _V6, f"""{BARS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) > 21 AS ok, max(high) OVER b AS u, min(low) OVER b AS l, max(high) OVER c AS xu, min(low) OVER c AS xl FROM bars WINDOW b AS {before(20)}, c AS {before(10)}),
x AS (SELECT *, CASE WHEN ok THEN u END AS sig_dc_entry_upper, CASE WHEN ok THEN l END AS sig_dc_entry_lower, CASE WHEN ok THEN xu END AS sig_dc_exit_upper, CASE WHEN ok THEN xl END AS sig_dc_exit_lower, CASE WHEN ok THEN u - l ELSE 0.0 END AS sig_dc_value, ok AND (close > u OR close < l) AS sig_dc_passes, CASE WHEN ok AND close > u THEN 'long' WHEN ok AND close < l THEN 'short' ELSE 'none' END AS sig_dc_direction FROM n) SELECT symbol, ts, {_cols(_V6)} FROM x""")

_V7 = {"sig_session_time_value": None}
_flat("v07_flat_session_time", "session_time", _V7, f"{BARS_SQL}, x AS (SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS e FROM bars) SELECT symbol, ts, CAST(hour(e) * 60 + minute(e) AS DOUBLE) AS sig_session_time_value FROM x")
_flat("v08_flat_regime", "regime_v2", {"sig_regime_v2_value": None, "sig_regime_v2_confidence": 4, "sig_regime_v2_p_trending": 4, "sig_regime_v2_p_ranging": 4, "sig_regime_v2_p_high_vol": 4, "sig_regime_v2_position_size": None, "sig_regime_v2_whipsaw_halt": None}, None)


@register(f"""{BARS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) > 21 AS ok, max(high) OVER b AS u, min(low) OVER b AS l FROM bars WINDOW b AS {before(20)})
SELECT symbol, ts, round(CASE WHEN ok THEN u - l ELSE 0.0 END, 4) AS value, ok AND (close > u OR close < l) AS passes, CASE WHEN ok AND close > u THEN 'long' WHEN ok AND close < l THEN 'short' ELSE 'none' END AS direction, CASE WHEN ok THEN u END AS upper FROM n""")
def v09_structs(spark, sf_dir):
    """A signal struct made again from its flat columns."""
    s = F.col("donchian_channel")
    out = structs(enrich(hour_bars(spark, sf_dir), ["donchian_channel"]), ["donchian_channel", "adx"])
    return out.select("symbol", "ts", F.round(s["value"], 4).alias("value"), s["passes"].alias("passes"), s["direction"].alias("direction"), s["upper"].alias("upper"))
