"""Queries that SQL can't state, and new operators, against plain versions of themselves."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks import catalog
from tapeworks.operators import simulators as SIM
from tapeworks.operators import strategies as S
from tapeworks.operators import sweeps as SW
from tapeworks.operators.signals import compute, with_day
from tapeworks.plans import simulation as P
from tapeworks.plans.base import hour_bars
from tapeworks.sources import results as R
from tapeworks.sources.loader import BarCache, load_bars, warm_up
from tapeworks.sources.store import write_years

T0 = dt.datetime(2025, 6, 2, 14, 30)


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_symbol(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["symbol"], r["ts"])):
        out.setdefault(r["symbol"], []).append(r)
    return out


def test_replay(spark, sf):
    """Trades of static, trailing and time exits, one position at a time, by a loop over bars."""
    b = compute(with_day(hour_bars(spark, sf)), ["atr", "relative_volume"])
    data = by_symbol(rows(b.select("symbol", "ts", "day", "open", "high", "low", "close", F.coalesce("atr.atr_raw", F.lit(1.0)).alias("a"), F.col("relative_volume.passes").alias("go"))))
    want = []
    for symbol, bars in data.items():
        orders, trade, day, last = [], None, None, None

        def close(px, b, why, market, symbol=symbol):
            if market:
                px -= trade["s"] * 0.25
            gross = trade["s"] * (px - trade["e"]) * 5
            want.append((symbol, trade["t"], b["ts"], trade["s"], trade["e"], px, why, gross - 0.7 - (1.25 if market else 0)))

        for i, x in enumerate(bars):
            if day is not None and x["day"] != day:
                if trade:
                    close(last["close"], last, "session_close", True)
                orders, trade = [], None
            day, last = x["day"], x
            keep = []
            for o in orders:
                if i - o["i"] > 12:
                    continue
                if not trade and (x["low"] <= o["e"] if o["s"] > 0 else x["high"] >= o["e"]):
                    trade = {**o, "t": x["ts"], "f": i, "peak": 0.0}
                else:
                    keep.append(o)
            orders = keep
            if trade:
                s, e, a = trade["s"], trade["e"], trade["a"]
                best, worst = (x["high"], x["low"]) if s > 0 else (x["low"], x["high"])
                if s * (best - e) >= 1.5 * a > 0:
                    close(e + s * 1.5 * a, x, "target", False)
                    trade = None
                elif s * (e - worst) >= a > 0:
                    close(e - s * a, x, "stop:static_stop", True)
                    trade = None
                else:
                    if s * (x["close"] - e) >= 1.0:
                        trade["peak"] = best if not trade["peak"] else max(trade["peak"], best) if s > 0 else min(trade["peak"], best)
                        if s * (trade["peak"] - x["close"]) >= 1.2 * a:
                            close(x["close"], x, "stop:trailing", True)
                            trade = None
                    if trade and i - trade["f"] >= 6:
                        close(x["close"], x, "stop:time", True)
                        trade = None
            if x["go"] and not trade:
                orders.append({"s": 1 if x["close"] > x["open"] else -1, "e": x["close"], "a": x["a"], "i": i})
        if trade:
            close(last["close"], last, "session_close", True)
    got = [(r["symbol"], r["entry_ts"], r["exit_ts"], r["side"], r["entry"], r["exit"], r["reason"], r["pnl"]) for r in rows(catalog.queries()["b01_replay"](spark, sf))]
    key = lambda t: (t[0], t[1], t[2])
    assert len(got) == len(want) > 20
    for a, b_ in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b_[:4] and a[6] == b_[6]
        assert a[4:6] == pytest.approx(b_[4:6], abs=1e-3) and a[7] == pytest.approx(b_[7], abs=1e-3)


def test_area_reversion(spark, sf):
    """The states of a session, one bar after the other."""
    b = compute(with_day(P.calm_bars(spark, sf)), ["value_area", "adx", "atr"])
    e = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    data = by_symbol(rows(b.select("symbol", "ts", "day", "close", "value_area.vah", "value_area.val", "value_area.poc", F.col("adx.value").alias("adx"), (F.hour(e) * 60 + F.minute(e)).alias("m"))))
    want = []
    for symbol, bars in data.items():
        day, state = None, ""
        for x in bars:
            if x["day"] != day:
                day, state = x["day"], "open"
            c, hi, lo = x["close"], x["vah"], x["val"]
            inside = hi is not None and lo <= c <= hi
            if state == "open":
                state = "done" if hi is None or hi - lo < 5 or inside else "watch"
                way = -1 if hi is not None and c > hi else 1
            elif state == "watch" and x["adx"] < 20:
                state, since = ("confirm", x["m"]) if inside else (state, 0)
                state = "done" if x["m"] - 570 > 120 else state
            elif state == "confirm":
                if not inside:
                    state = "watch"
                elif x["m"] - since >= 60 and x["adx"] < 20:
                    state = "done"
                    target = x["poc"] if way * (x["poc"] - c) > 0 else hi if way > 0 else lo
                    stop = lo - 1 if way > 0 else hi + 1
                    if way * (target - c) > 0 and way * (c - stop) > 0:
                        want.append((symbol, x["ts"], way, target, stop))
    got = [(r["symbol"], r["ts"], r["side"], r["target"], r["stop"]) for r in rows(S.intents(P.calm_bars(spark, sf), "value_area_reversion").where("side <> 0"))]
    assert sorted(got) == sorted(want)


def test_unknown_override(spark, sf):
    with pytest.raises(ValueError):
        S.intents(hour_bars(spark, sf), "gap_fill", configs={"rsi_momentum": {"n": 5}})


def bar(i, low, high, close, up=0.5, day=0, symbol="a"):
    return (symbol, T0 + dt.timedelta(minutes=i), day, float(high), float(low), float(close), up, 1 - up)


def predicted(spark, data, **kw):
    df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, day int, high double, low double, close double, p_up double, p_down double")
    kw = {"threshold": 0.6, "take_ticks": 8, "stop_ticks": 4, "horizon": 3, "cooldown": 2, **kw}
    return sorted((r.symbol, (r.entry_ts - T0).seconds // 60, (r.exit_ts - T0).seconds // 60, r.side, r.exit, r.reason, r.bars) for r in SIM.predicted_trades(df, ["symbol"], **kw).collect())


def test_predicted_trades(spark):
    quiet = [bar(i, 99.5, 100.5, 100) for i in range(20, 30)]
    assert predicted(spark, [bar(0, 99, 101, 100, 0.7), bar(1, 99.5, 102.5, 102), *quiet]) == [("a", 0, 1, 1, 102.0, "target", 1)]
    assert predicted(spark, [bar(0, 99, 101, 100, 0.7), bar(1, 98, 103, 102), *quiet]) == [("a", 0, 1, 1, 98.75, "stop", 1)]
    assert predicted(spark, [bar(0, 99, 101, 100, 0.3), bar(1, 99.5, 100.5, 100), bar(2, 99.5, 100.5, 100), bar(3, 99.5, 100.5, 99.75), *quiet]) == [("a", 0, 3, -1, 100.0, "expiry", 3)]
    assert predicted(spark, [bar(0, 99, 101, 100, 0.7), bar(1, 99.5, 100.5, 100.5, day=1), *[bar(i, 99.5, 100.5, 100, day=1) for i in range(5, 9)]]) == [("a", 0, 1, 1, 100.25, "session_close", 1)]
    # A cooldown of two bars and no entry in the last three.
    again = [bar(i, 99.9, 100.1, 100, 0.7) for i in range(9)]
    assert [t[1] for t in predicted(spark, again, horizon=2)] == [0, 2, 4, 6]
    assert predicted(spark, [bar(0, 99, 101, 100, 0.7), bar(1, 99, 101, 100)]) == []


def test_dual_replay(spark):
    coarse = [("a", T0 + dt.timedelta(minutes=30 + 5 * k), 1 if k == 0 else 0, 100.0, 102.0, 98.0, 2.0, 1) for k in range(3)]
    c = spark.createDataFrame(coarse, "symbol string, ts timestamp_ntz, side int, entry double, target double, stop double, atr_entry double, slip int")
    fine = [("a", T0 + dt.timedelta(minutes=30 + i), 0, *x) for i, x in enumerate([(103.0, 97.0, 100.0)] * 5 + [(100.5, 99.5, 100.0), (101.0, 99.8, 100.5), (102.5, 100.0, 102.0)] + [(102.0, 101.0, 101.5)] * 3)]
    f = spark.createDataFrame(fine, "symbol string, ts timestamp_ntz, day int, high double, low double, close double")
    (t,) = SIM.dual_replay(c, f, "5 minutes", ["symbol"]).collect()
    # Wild bars of the entry's own five minutes neither fill nor close it.
    assert (t.entry_ts, t.exit_ts, t.reason, t.exit) == (T0 + dt.timedelta(minutes=35), T0 + dt.timedelta(minutes=37), "target", 102.0)


def test_simulator_metrics(spark):
    pnl = [(0, 10.0), (0, -4.0), (1, -8.0), (2, 3.0), (3, -1.0)]
    df = spark.createDataFrame([("a", T0 + dt.timedelta(days=d, minutes=i), T0 + dt.timedelta(days=d, minutes=i + 1), p) for i, (d, p) in enumerate(pnl)], "symbol string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, pnl double")
    (r,) = SIM.simulator_metrics(df, ["symbol"]).collect()
    days = [6.0, -8.0, 3.0, -1.0]
    assert r.sharpe == pytest.approx(statistics.mean(days) / statistics.stdev(days) * math.sqrt(252))
    assert r.sortino == pytest.approx(statistics.mean(days) / statistics.stdev([-8.0, -1.0]) * math.sqrt(252))
    assert (r.n_trades, r.days, r.profit_factor, r.trades_per_day) == (5, 4, 1.0, 1.25) and r.max_drawdown_pct == pytest.approx(-120.0)


def test_sweep(spark, sf):
    spans = SW.stability_spans(spark, 2024, 2025, 1)
    i = P._simple_intents(spark, sf, hour_bars(spark, sf))
    out = {r.param_id: r for r in SW.bracket_sweep(i, ["symbol"], {"target_atr": [1.0, 2.0], "stop_atr": [1.5], "max_bars": [4]}, spans).collect()}
    from tapeworks.operators.replay import replay

    for k, times in enumerate((1.0, 2.0)):
        own = i.withColumn("target", F.col("entry") + F.col("side") * times * F.col("atr_entry")).withColumn("stop", F.col("entry") - F.col("side") * 1.5 * F.col("atr_entry"))
        t = [r.pnl for r in replay(own, ["symbol"], [{"type": "bracket_target"}, {"type": "bracket_stop"}, {"type": "time_stop", "max_bars": 4}]).collect()]
        assert out[k].n_trades == len(t) and out[k].net == pytest.approx(sum(t)) and out[k].win_rate == pytest.approx(sum(p > 0 for p in t) / len(t))


def test_reports(spark, tmp_path):
    path, calls = f"file://{tmp_path}/r", []

    def run(name):
        calls.append(name)
        return spark.createDataFrame([(1.5, float("nan"), "x|y")], "a double, b double, c string")

    first = R.phase_report(spark, path, {"one": run}, ["s", "t"])
    assert R.phase_report(spark, path, {"one": run}, ["s", "t", "u"]).count("x\\|y") == 3 and calls == ["s", "t", "u"]
    assert first.startswith("## one\n\n| strategy | a | b | c |") and R.read_text(spark, f"{path}/report.md").count("\n") >= 6
    assert R.to_yaml({"a": {"b": [1, {"c": "x"}]}, "d": []}) == 'a:\n  b:\n    - 1\n    -\n      c: "x"\nd: []\n'
    assert R.to_markdown([]) == "No rows.\n"
    with pytest.raises(ValueError):
        R.rows_of(spark.range(R.REPORT_ROWS + 1))


def test_loading(spark, sf, tmp_path):
    b = hour_bars(spark, sf).select("symbol", "ts", "open", "high", "low", "close", "volume")
    store, cache = str(tmp_path / "store"), str(tmp_path / "cache")
    write_years(b, store, "ts")
    day = load_bars(spark, store, cache, "2024-01-05", "2024-01-06", "1 day").collect()
    assert {str(r.ts.date()) for r in day} <= {"2024-01-05", "2024-01-06"} and day
    assert BarCache(spark, cache).exists("bars_1 day") and not BarCache(spark, cache).exists("bars_5 s")
    with pytest.raises(FileNotFoundError):
        BarCache(spark, cache).load("bars_x")
    assert all(r.n <= 7 for r in warm_up(b, "1 day", 7).groupBy("symbol").agg(F.count("*").alias("n")).collect())
    with pytest.raises(ValueError):
        warm_up(b, "1 day", 501)


def test_statistics(spark, sf):
    ret = {k: np.array([r["ret"] for r in v]) for k, v in by_symbol(rows(catalog.queries()["h01_log_returns"](spark, sf))).items()}
    for r in rows(catalog.queries()["h02_ljung_box"](spark, sf)):
        x = ret[r["symbol"]] - ret[r["symbol"]].mean()
        n = len(x)
        q = n * (n + 2) * sum(((x[k:] * x[:-k]).sum() / (x * x).sum()) ** 2 / (n - k) for k in range(1, r["lag"] + 1))
        assert r["q"] == pytest.approx(q, rel=1e-2, abs=1e-2)
        sample = np.random.default_rng(1).chisquare(r["lag"], 100_000)
        assert r["p"] == pytest.approx((sample > q).mean(), abs=0.01)
    for r in rows(catalog.queries()["h05_ks_normality"](spark, sf)):
        x = np.sort((ret[r["symbol"]] - ret[r["symbol"]].mean()) / ret[r["symbol"]].std())
        cdf = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])
        n = len(x)
        assert r["d"] == pytest.approx(max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max()), abs=2e-3)
    for r in rows(catalog.queries()["h03_adf"](spark, sf)):
        assert (r["statistic"] < -2.86) == r["stationary"] == (r["p"] < 0.05)
    whole = {(r["symbol"]): r for r in rows(catalog.queries()["h04_hurst"](spark, sf))}
    for r in rows(catalog.queries()["h08_hurst_by_window"](spark, sf)):
        if r["window"] == "1 hour":
            assert r["hurst"] == pytest.approx(whole[r["symbol"]]["hurst"], abs=1e-3) and r["n"] == len(ret[r["symbol"]])


def test_folds(spark, sf):
    """Sharpe ratios of the train and test days of each fold, from its days."""
    b = rows(hour_bars(spark, sf))
    pnl = {}
    for r in b:
        pnl[r["ts"].date()] = pnl.get(r["ts"].date(), 0.0) + r["close"] - r["open"]
    days = {}
    for r in rows(catalog.queries()["c01_cpcv_membership"](spark, sf)):
        days.setdefault((r["fold_id"], r["role"]), set()).add(r["day"])
    assert len(days) == 56
    for fold in range(28):
        test, train = days[fold, "test"], days[fold, "train"]
        assert not test & train
        order = sorted(pnl)
        at = {d: i for i, d in enumerate(order)}
        assert all(abs(at[d] - at[t]) > 1 for d in train for t in test)
    for r in rows(catalog.queries()["c02_fold_sharpe"](spark, sf)):
        x = [pnl[d] for d in days[r["fold_id"], r["role"]]]
        assert r["n"] == len(x) and r["sharpe"] == pytest.approx(statistics.mean(x) / statistics.stdev(x) * math.sqrt(252), abs=1e-3)


def test_streamed_bars_and_brackets(spark, sf):
    """The stateful streams against one pass over the ticks in the order of their files."""
    from tapeworks.sources.tape import ticks

    data = by_symbol(rows(ticks(spark, sf)))
    got = by_symbol(rows(catalog.queries()["r04_stream_volume_bars"](spark, sf)))
    for symbol, bars in got.items():
        assert all(r["volume"] >= 500 and r["low"] <= min(r["open"], r["close"]) <= max(r["open"], r["close"]) <= r["high"] for r in bars)
        assert 0 <= sum(t["size"] for t in data[symbol]) - sum(r["volume"] for r in bars) < 500 + max(t["size"] for t in data[symbol])
    for r in rows(catalog.queries()["r10_stream_brackets"](spark, sf)):
        gain = r["side"] * (r["exit"] - r["entry"])
        assert r["reason"] == "expired" or gain == (10.0 if r["reason"] == "target" else -10.0)
        assert r["entry_ts"] < r["exit_ts"]


def test_online_features_are_those_of_the_table(spark, sf):
    from tapeworks.operators.predictor import BARS_26, features_26_online

    whole = {(r["symbol"], r["ts"]): r for r in rows(features_26_online(hour_bars(spark, sf)))}
    got = rows(catalog.queries()["q06_online_features"](spark, sf))
    assert len(got) == len(whole)
    for r in got:
        for c in BARS_26:
            a, b = r[c], whole[r["symbol"], r["ts"]][c]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-3))


def test_robustness_and_signal(spark, sf):
    found = {r["test"]: r for r in rows(catalog.queries()["q17_robustness"](spark, sf))}
    assert set(found) == {"reverse", "forward", "flipped"} and found["flipped"]["ones"] == pytest.approx(1 - found["forward"]["ones"], abs=1e-3)
    for r in rows(catalog.queries()["sg33_tick_predictor"](spark, sf)):
        up = r["p_up"]
        long, short = (up * 8 - (1 - up) * 6 - 1) / 8, ((1 - up) * 8 - up * 6 - 1) / 8
        assert r["ev"] == pytest.approx(max(long, short), abs=1e-3)
        assert r["direction"] == (0 if r["ev"] < 0.1499 else 1 if long >= short else -1) or abs(r["ev"] - 0.15) < 1e-3
