"""Feature sets against plain series arithmetic on one symbol."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tapeworks.operators import predictor as P

N = 400
T0 = dt.datetime(2024, 1, 2, 9, 30)


def bars(n=N, seed=42):
    r = np.random.default_rng(seed)
    c = 5000 + np.cumsum(r.normal(0, 2, n))
    o = np.r_[5000.0, c[:-1]]
    hi, lo = np.maximum(o, c) + np.abs(r.normal(0, 1, n)), np.minimum(o, c) - np.abs(r.normal(0, 1, n))
    buy, sell = r.integers(0, 100, n), r.integers(1, 100, n)
    return pd.DataFrame({"symbol": "a", "ts": [T0 + dt.timedelta(minutes=5 * i) for i in range(n)], "open": o, "high": hi, "low": lo, "close": c, "volume": buy + sell, "buy_volume": buy, "sell_volume": sell, "avg_bid_size": r.uniform(1, 50, n), "avg_ask_size": r.uniform(1, 50, n), "vwap": (o + c) / 2})


def z(x, n=100, eps=1e-9):
    m, s = x.rolling(n).mean(), x.rolling(n).std()
    return pd.Series(np.where(s > eps, (x - m) / s, 0.0))


def fit(y, n):
    k = np.arange(n) - (n - 1) / 2
    return y.rolling(n).apply(lambda w: (k * (w - w.mean())).sum() / (k * k).sum(), raw=True)


def lagged(raw, plain=(), eps=1e-9):
    return {k: v.shift(1) if k in plain else z(v.shift(1), eps=eps) for k, v in raw.items()}


def compare(got, want, tolerance=1e-6):
    for k, v in want.items():
        a, b = got[k].to_numpy(float), np.asarray(v, float)
        assert np.array_equal(np.isnan(a), np.isnan(b)), k
        assert np.allclose(a, b, atol=tolerance, rtol=1e-6, equal_nan=True), k


def run(spark, f, b, **kw):
    return f(spark.createDataFrame(b).withColumn("ts", P.F.col("ts").cast("timestamp_ntz")), **kw).toPandas().sort_values("ts").reset_index(drop=True)


def common(b, l1):
    c, h, l, v = b.close, b.high, b.low, b.volume.astype(float)  # noqa: E741
    up = (c - l) / (h - l + 1e-9)
    bid, ask, buy, sell = (b.avg_bid_size, b.avg_ask_size, b.buy_volume * 1.0, b.sell_volume * 1.0) if l1 else (v * (1 - up), v * up, v * up, v * (1 - up))
    r = np.log(c / c.shift(1))
    ofi = bid.diff().fillna(0) - ask.diff().fillna(0)
    mp = (bid * (c + 0.25) + ask * (c - 0.25)) / (bid + ask)
    gain, loss = r.clip(lower=0).rolling(14).mean(), (-r).clip(lower=0).rolling(14).mean()
    m, s = c.rolling(20).mean(), c.rolling(20).std()
    return c, h, l, v, bid, ask, buy, sell, r, ofi, mp, 100 - 100 / (1 + gain / loss).where(loss > 1e-12), ((c - m + 2 * s) / (4 * s)).where(s > 0, 0.5)


def corr(r, n):
    return pd.Series([np.corrcoef(r[i - n : i], r[i - n + 1 : i + 1])[0, 1] if i >= n and np.isfinite(r[i - n : i + 1]).all() else np.nan for i in range(len(r))])


def test_26(spark):
    b = bars()
    c, h, l, v = b.close, b.high, b.low, b.volume.astype(float)  # noqa: E741
    hl = h - l
    r = np.log(c / c.shift(1))
    cvd = v * (2 * (c - l) / (hl + 1e-9) - 1)
    cs = cvd.rolling(10).sum()
    bid, ask = v * (h - c) / (hl + 1e-9), v * (c - l) / (hl + 1e-9)
    obi = (bid - ask) / (bid + ask + 1e-9)
    ofi = bid.diff().fillna(0) - ask.diff().fillna(0)
    vz = z(v, 20)
    mp = (bid * (c + hl / 2) + ask * (c - hl / 2)) / (bid + ask + 1e-9)
    raw = {"return_15": np.log(c / c.shift(15)), "realized_vol_20": r.rolling(20).std(), "hl_range_zscore": z(hl / 0.25, 50), "volume_zscore_20": vz, "volume_accel": vz - vz.shift(5), "up_vol_ratio_10": (v.where(c > b.open, 0).rolling(10).sum() / v.rolling(10).sum()).fillna(0.5), "cvd_cumsum_30": cvd.rolling(30).sum(), "cvd_slope_10": (cs - cs.shift(10)) / 10, "close_pos_zscore": z((c - l) / (hl + 1e-9), 20), "obi_est_5": obi.rolling(5).mean(), "microprice_vs_mid": mp - c, "ofi_est_10": ofi.rolling(10).sum()}
    got = run(spark, P.features_26, b)
    assert list(got.columns) == ["symbol", "ts", *P.BARS_26] and len(P.BARS_26) == 26
    compare(got, lagged(raw, P._PLAIN["26"]))


@pytest.mark.parametrize("l1", [False, True])
def test_24(spark, l1):
    b = bars(seed=3)
    c, h, l, v, bid, ask, buy, sell, r, ofi, mp, rsi, pctb = common(b, l1)  # noqa: E741
    raw = {"ofi_5m": ofi.rolling(5).sum(), "cvd_slope_5m": fit((buy - sell).cumsum(), 5), "obi_1m": (bid - ask) / (bid + ask), "aggressive_ratio_1m": buy / (buy + sell), "trade_intensity_1m": (v / v.rolling(20).mean()).fillna(1.0), "microprice_drift_1m": mp.diff(), "vpin_20m": ((buy - sell).abs() / v).rolling(20).mean(), "delta_zscore_20m": z(buy - sell, 20, 0), "buy_sell_ratio_1m": (buy / sell).clip(0, 10).where(sell > 0, 1.0), "volume_trend_10m": fit(v, 10), "autocorr_5m": corr(r.to_numpy(), 5), "rsi_14_5m": rsi.fillna(50.0), "bb_pctb_5m": pctb}
    got = run(spark, P.features_24, b, l1=l1)
    assert list(got.columns[2:]) == P.MINUTE_24 and len(P.MINUTE_24) == 24
    compare(got, lagged(raw, eps=1e-12), 1e-4)
    assert (got.regime_p_trending == 0).all()


def test_25_and_regimes(spark):
    b = bars(seed=4)
    c, h, l, v, bid, ask, buy, sell, r, ofi, mp, rsi, pctb = common(b, False)  # noqa: E741
    hi, lo = h.rolling(14).max(), l.rolling(14).min()
    raw = {"ofi_3bar": ofi.rolling(3).sum(), "return_6": np.log(c / c.shift(6)), "realized_vol_12": r.rolling(12).std(), "hl_range_zscore": z(h - l, 12, 1e-12), "stoch_k_14": ((c - lo) / (hi - lo) * 100).fillna(50.0), "donchian_pos_20": ((c - l.rolling(20).min()) / (h.rolling(20).max() - l.rolling(20).min())).fillna(0.5), "autocorr_6": corr(r.to_numpy(), 6), "rsi_14": rsi.fillna(50.0)}
    state = pd.DataFrame({"symbol": "a", "ts": b.ts[::3].reset_index(drop=True)}).assign(regime_p_trending=lambda x: np.sin(np.arange(len(x))), regime_p_ranging=0.2, regime_p_highvol=0.3)
    regimes = spark.createDataFrame(state).withColumn("ts", P.F.col("ts").cast("timestamp_ntz"))
    got = run(spark, P.features_25, b, regimes=regimes)
    raw["regime_p_trending"] = state.regime_p_trending.repeat(3).reset_index(drop=True)[: len(b)]
    compare(got, lagged(raw, eps=1e-12), 1e-4)
    minutes = (b.ts.dt.hour - 9) * 60 + b.ts.dt.minute - 30
    compare(got, {"tod_sin": np.sin(minutes / 390 * 2 * np.pi), "session_segment": np.select([minutes < 60, minutes < 300], [0.0, 0.5], 1.0)})


def test_33_rolling(spark):
    b = bars(seed=5).assign(n_ticks=lambda x: x.volume // 2 + 1, mean_size=2.0, sd_size=1.0, large_share=0.1, mean_spread=lambda x: x.high - x.low, max_spread=0.5, upticks=1.0, mid=lambda x: x.close, microprice=lambda x: x.close + 0.1)
    imb = (b.buy_volume - b.sell_volume) / (b.buy_volume + b.sell_volume + 1e-9)
    cs = (b.buy_volume - b.sell_volume).rolling(10).sum()
    raw = {"aggressive_imbalance_5": imb.rolling(5).mean(), "cvd_real_slope_10": (cs - cs.shift(10)) / 10, "spread_zscore": z(b.high - b.low, 50), "trade_intensity_zscore": z(b.n_ticks * 1.0, 20), "vwap_distance": (b.close - b.vwap) / 0.25}
    got = run(spark, P.features_33, b)
    assert list(got.columns[2:]) == P.L1_33 and len(P.L1_33) == 33
    compare(got, lagged(raw, P._PLAIN["33"]), 1e-5)


def test_30(spark):
    b = bars(1500, seed=6)
    got = run(spark, P.features_30, b, middle="15 minutes", coarse="1 hour").set_index("ts")
    assert list(got.columns[1:]) == P.FRAMES_30 and len(P.FRAMES_30) == 30
    r = np.log(b.close / b.close.shift(1)).fillna(0).to_numpy()
    auto = []
    for i in range(len(r)):
        d = r[i - 9 : i + 1] - r[i - 9 : i + 1].mean() if i >= 9 else np.full(10, np.nan)
        auto.append((d[:-1] * d[1:]).sum() / 9 / (d * d).mean())
    f = b.set_index("ts").resample("15min").agg({"high": "max", "low": "min", "close": "last"})
    m, s = f.close.rolling(20).mean(), f.close.rolling(20).std()
    pctb = ((f.close - m + 2 * s) / (4 * s)).fillna(0.5)
    pctb.index += pd.Timedelta("15min")
    frame = pd.merge_asof(b[["ts"]], pctb.rename("x").reset_index(), on="ts")["x"]
    want = pd.DataFrame({"return_autocorr_10": z(pd.Series(auto), eps=1e-12), "bb_pctb_1m": z(frame, eps=1e-12)}).set_index(b.ts).loc[got.index]
    assert np.allclose(got[want.columns].to_numpy(), want.to_numpy(), atol=1e-5)
    assert len(got) > 1000 and not got.isna().any().any()
