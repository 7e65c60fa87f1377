import datetime as dt

import pytest

from tapeworks.operators.exits import Position, bracket_prices, compile_exits
from tapeworks.operators.replay import Book, RiskState, replay, trade_result

T0 = dt.datetime(2025, 6, 2, 14, 30)


def bar(i, low, high, close, side=0, entry=5000.0, target=5002.0, stop=4998.0, day=0, **more):
    return {"ts": T0 + dt.timedelta(minutes=i), "day": day, "low": low, "high": high, "close": close, "side": side, "entry": entry, "target": target, "stop": stop, "atr_entry": 2.0, "slip": 1, **more}


def run(*bars, exits=None, expiry=12):
    b = Book(exits, 1, expiry)
    for x in bars:
        b.bar(x)
    b.end_session()
    return b.take()


def test_target_and_costs():
    (t,) = run(bar(0, 4999, 5001, 5000, 1), bar(1, 4999.5, 5001, 5000), bar(2, 5000, 5002.5, 5002))
    assert t[5] == "target" and t[4] == 5002 and t[7] == 10.0 and t[9] == pytest.approx(9.3)


def test_stop_with_slippage_charged_twice():
    (t,) = run(bar(0, 4999, 5001, 5000, 1), bar(1, 4999.5, 5001, 5000), bar(2, 4997, 5000, 4998))
    assert t[5] == "stop" and t[4] == 4997.75 and t[8] == pytest.approx(0.7 + 1.25)
    assert trade_result(1, 5000, 4998, True, 3)[0] == 4997.25


def test_no_fill_on_the_signal_bar():
    assert run(bar(0, 4990, 5010, 5000, 1), bar(1, 5001, 5001.5, 5001)) == []


def test_fill_and_exit_on_one_bar_and_stop_first():
    (t,) = run(bar(0, 4999, 5001, 5000, 1), bar(1, 4997, 5003, 5000))
    assert t[5] == "stop" and t[0] == t[1]


def test_short_side():
    (t,) = run(bar(0, 4999, 5001, 5000, -1, target=4998.0, stop=5002.0), bar(1, 4999, 5000.5, 5000), bar(2, 4997.5, 5000, 4998))
    assert t[5] == "target" and t[7] == 10.0


def test_expiry_and_session_close():
    (t,) = run(bar(0, 4999, 5001, 5000, 1), bar(1, 4999.5, 5001, 5000), bar(2, 4999.5, 5001, 5000.5), expiry=2)
    assert t[5] == "expired"
    (t,) = run(bar(0, 4999, 5001, 5000, 1), bar(1, 4999.5, 5001, 5000.25), bar(2, 4999, 5001, 5000, day=1))
    assert t[5] == "session_close" and t[1] == T0 + dt.timedelta(minutes=1)


def position(side=1, **kw):
    return Position(side, 5600.0, 5.0, **kw)


@pytest.mark.parametrize(
    ("rule", "p", "b", "want"),
    [
        ({"type": "static_target", "atr_multiple": 1.0}, position(), {"high": 5605, "low": 5600, "close": 5603}, "tp:static_target"),
        ({"type": "static_stop", "atr_multiple": 1.0}, position(-1), {"high": 5605, "low": 5600, "close": 5603}, "stop:static_stop"),
        ({"type": "static_stop", "atr_multiple": 1.2}, position(), {"high": 5605, "low": 5595, "close": 5603}, None),
        ({"type": "time_stop", "max_bars": 5}, position(bars=5), {"high": 1, "low": 1, "close": 1}, "stop:time"),
        ({"type": "bracket_target"}, position(target=5604.0), {"high": 5605, "low": 5595, "close": 5600}, "tp:bracket_target"),
        ({"type": "bracket_target"}, position(), {"high": 5605, "low": 5595, "close": 5600}, None),
        ({"type": "bracket_stop"}, position(-1, stop=5604.0), {"high": 5605, "low": 5595, "close": 5600}, "stop:bracket_stop"),
        ({"type": "adverse_momentum", "threshold_points": 1.0, "max_bars": 2}, position(bars=2), {"high": 1, "low": 1, "close": 5598}, "early:adverse_momentum"),
        ({"type": "adverse_momentum", "threshold_points": 1.0, "max_bars": 2}, position(bars=3), {"high": 1, "low": 1, "close": 5598}, None),
        ({"type": "signal_bound_exit", "signal": "adx", "lower_bound": 18.0}, position(), {"adx.value": 17.0}, "early:adx_bound"),
        ({"type": "adverse_signal_exit", "signal": "macd", "field": "line"}, position(-1), {"macd.line": 0.1}, "early:adverse_macd_line"),
        ({"type": "regime_exit", "hostile_regimes_long": [2]}, position(bars=2), {"hmm_regime.value": 2}, "early:regime_flip"),
        ({"type": "volatility_expansion_exit"}, position(bars=3), {"atr.atr_raw": 9.5}, "early:vol_expansion"),
        ({"type": "price_vs_signal_exit", "signal": "d", "long_field": "lo", "short_field": "hi", "offset": 1.0}, position(), {"d.lo": 5590, "close": 5588.5}, "early:price_vs_d"),
        ({"type": "vwap_reversion_target", "target_sd_band": 0.5}, position(), {"vwap_session.sd": 4.0, "vwap_session.vwap": 5604.0, "high": 5603}, "tp:reversion_target"),
        ({"type": "time_stop", "max_bars": 0, "enabled": False}, position(), {}, None),
    ],
)
def test_exit_rules(rule, p, b, want):
    assert compile_exits([rule])(p, b) == want


def test_trailing_stop_and_order():
    check = compile_exits([{"type": "trailing_stop", "atr_multiple": 1.0, "activate_after_ticks": 4}, {"type": "time_stop", "max_bars": 0}])
    p = position()
    assert check(p, {"high": 5610, "low": 5600, "close": 5609}) == "stop:time" and p.peak == 5610
    assert check(p, {"high": 5606, "low": 5600, "close": 5604}) == "stop:trailing"
    with pytest.raises(ValueError):
        compile_exits([{"type": "nothing"}])
    assert bracket_prices([{"type": "static_target"}, {"type": "static_stop"}], 1, 100, 2.0) == (103.0, 98.0)
    assert bracket_prices([], 1, 100, 0.0) == (0.0, 0.0)


@pytest.mark.parametrize(
    ("rule", "last", "want"),
    [
        ({"type": "static_target", "atr_multiple": 1.5}, {"low": 5000, "high": 5010, "close": 5008}, ("target", 5003.0, 15.0, 0.7)),
        ({"type": "static_stop", "atr_multiple": 1.0}, {"low": 4990, "high": 5002, "close": 5001}, ("stop:static_stop", 4997.75, -11.25, 1.95)),
        ({"type": "bracket_target"}, {"low": 5000, "high": 5010, "close": 5008}, ("target", 5002.0, 10.0, 0.7)),
        ({"type": "bracket_stop"}, {"low": 4990, "high": 5001, "close": 5001}, ("stop:bracket_stop", 4997.75, -11.25, 1.95)),
        ({"type": "vwap_reversion_target", "target_sd_band": 0.5}, {"low": 5000, "high": 5004, "close": 5001, "vwap_session.vwap": 5004.0, "vwap_session.sd": 2.0}, ("target", 5003.0, 15.0, 0.7)),
        ({"type": "time_stop", "max_bars": 1}, {"low": 5000, "high": 5001, "close": 5001}, ("stop:time", 5000.75, 3.75, 1.95)),
    ],
)
def test_fill_price_of_each_reason(rule, last, want):
    (t,) = run(bar(0, 4999, 5001, 5000, 1), bar(1, 4999.5, 5000.5, 5000), {**bar(2, 0, 0, 0), **last}, exits=[rule])
    assert (t[5], t[4], t[7], pytest.approx(t[8])) == want


def test_short_static_prices():
    (t,) = run(bar(0, 4999, 5001, 5000, -1), bar(1, 4999.5, 5000.5, 5000), bar(2, 4990, 5001, 4992), exits=[{"type": "static_target", "atr_multiple": 2.0}])
    assert (t[5], t[4], t[7]) == ("target", 4996.0, 20.0)


def test_risk():
    r = RiskState(max_position=1, max_loss=10.0, max_signals=2)
    assert r.allow(False) == "session" and r.allow(True) is None
    r.fill(1, 100.0)
    assert r.allow(True) == "position"
    r.fill(-1, 89.0)
    assert r.realised == -11 and r.halted and r.allow(True) == "halted"


def test_replay_table(spark):
    rows = [(s, T0 + dt.timedelta(minutes=i), 0, hi, lo, c, side, 5000.0, 5002.0, 4998.0, 2.0, 1) for s in ("a", "b") for i, (lo, hi, c, side) in enumerate([(4999.0, 5001.0, 5000.0, 1), (4999.5, 5001.0, 5000.0, 0), (5000.0, 5002.5, 5002.0, 0)])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, day int, high double, low double, close double, side int, entry double, target double, stop double, atr_entry double, slip int")
    out = replay(df, ["symbol"]).collect()
    assert sorted((r.symbol, r.reason, r.pnl) for r in out) == [("a", "target", pytest.approx(9.3)), ("b", "target", pytest.approx(9.3))]
    assert replay(df.limit(0), ["symbol"]).collect() == []
