import datetime as dt

import numpy as np
import pytest

from tapeworks.functions import regimes as M
from tapeworks.operators import regime as R
from tapeworks.sources.models import from_json, load_models, save_models, to_json

CFG = M.Config().small()


def path(n=1500, seed=42):
    """Bars of a drift, a calm and a wild third."""
    r = np.random.default_rng(seed)
    sigma, drift = np.repeat([0.001, 0.0003, 0.003], n // 3), np.repeat([0.0005, 0.0, 0.0], n // 3)
    c = 5000 * np.exp(np.cumsum(drift + sigma * r.normal(size=n)))
    o = np.r_[5000.0, c[:-1]]
    spread = c * sigma * np.abs(r.normal(size=(2, n)))
    return {"open": o, "high": np.maximum(o, c) + spread[0], "low": np.minimum(o, c) - spread[1], "close": c, "volume": r.integers(50, 200, n).astype(float)}


def test_features_look_back_only():
    a = path()
    z, at = M.features(a, CFG)
    z2, at2 = M.features({k: v[:1000] for k, v in a.items()}, CFG)
    assert z.shape[1] == 7 and np.isfinite(z).all() and np.abs(z).max() <= 3
    assert np.array_equal(at[: len(at2)], at2) and np.allclose(z[: len(z2)], z2, atol=1e-6)


def test_buckets_by_hand():
    h, l, c, v = np.array([2.0, 2, 2, 2]), np.array([1.0, 1, 1, 1]), np.array([2.0, 1, 1.5, 2]), np.array([150.0, 50, 100, 50])  # noqa: E741
    # Buckets: 100 bought; 50 bought and 50 sold; 50 and 50; the fourth isn't full.
    assert np.allclose(M.informed_trading(h, l, c, v, 100.0, 2), [1.0, 0.5, 0.0, 0.0])
    assert np.allclose(M.informed_trading(h, l, c, v, 100.0, 50), [1.0, 0.5, 1 / 3, 1 / 3])


@pytest.mark.parametrize("emission", ["gaussian", "studentt"])
def test_states_are_told_apart(emission):
    r = np.random.default_rng(1)
    state = np.repeat([0, 1, 2, 0, 1, 2], 200)
    means = np.array([[1.5, 0, 1, 1, 1.5, 0, 0], [0, -1.5, -1, 0, -1, -1, 0], [0, 2, 0, 0, 0, 2, 0]])
    z = means[state] + 0.4 * r.normal(size=(len(state), 7))
    m = M.fit(z, M.Config(emission=emission))
    p = m.probabilities(z)
    assert (p.argmax(1) == state).mean() > 0.97 and np.allclose(p.sum(1), 1)
    assert np.allclose(m.probabilities(z[:500]), p[:500])
    assert (m.probabilities(z, smooth=True).argmax(1) == state).mean() > 0.98
    again = from_json(to_json(m))
    assert np.allclose(again.probabilities(z), p) and again.cfg == m.cfg


def test_decisions():
    cfg = M.Config(halt_flips=1, least_bars=2)
    d = M.Decision(cfg)
    step = lambda p, ok=True: d.step(np.array(p), ok)
    assert step([0.1, 0.8, 0.1])[:2] == (M.RANGING, 0.8)
    assert step([0.9, 0.05, 0.05], False)[0] == M.RANGING  # not confirmed
    assert step([0.5, 0.2, 0.3])[0] == M.RANGING  # ambiguous
    assert step([0.9, 0.05, 0.05])[::2] == (M.TRENDING, True, 1)
    assert step([0.9, 0.05, 0.05])[3] == 1.0  # two bars in it
    assert step([0.6, 0.4, 0.0])[0] == M.TRENDING and step([0.6, 0.4, 0.0])[3] == 0.5
    assert step([0.0, 0.1, 0.9])[5] and step([0.0, 0.1, 0.9])[3] == 0.0  # a second flip halts


def bars(spark, symbols=("a", "b"), n=900):
    rows = []
    for k, s in enumerate(symbols):
        a = path(n, k)
        rows += [(s, dt.datetime(2024, 1, 2) + dt.timedelta(minutes=5 * i), *(float(a[c][i]) for c in ("open", "high", "low", "close")), int(a["volume"][i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")


def test_no_row_depends_on_a_later_one(spark):
    df = bars(spark).cache()
    whole = {(r.symbol, r.ts): r for r in R.detect(df, CFG, 150).collect()}
    end = dt.datetime(2024, 1, 2) + dt.timedelta(minutes=5 * 700)
    part = R.detect(df.where(R.F.col("ts") < end), CFG, 150).collect()
    assert len(part) == 1400 and any(r.confidence > 0 for r in part)
    for r in part:
        w = whole[r.symbol, r.ts]
        assert (r.regime, r.size, r.halt) == (w.regime, w.size, w.halt) and r.confidence == pytest.approx(w.confidence, abs=1e-6)
    warm = [r for r in part if r.confidence == 0]
    assert warm and all((r.regime, r.size, r.halt) == (M.RANGING, "flat", True) for r in warm)


def test_store_gates_and_components(spark, tmp_path):
    df = bars(spark)
    save_models(R.train(df, CFG), str(tmp_path / "m"), 1)
    save_models(R.train(df.where("symbol = 'a'"), CFG), str(tmp_path / "m"), 2)
    assert load_models(spark, str(tmp_path / "m")).count() == 1 and load_models(spark, str(tmp_path / "m"), 1).count() == 2
    stats = R.walk_forward(df, 3, CFG)
    assert stats.count() == 6 and all(r.trending + r.ranging + r.high_vol == pytest.approx(1) for r in stats.collect())
    row = spark.createDataFrame([("x", 300, 0.97, 0.1, 5.0, 0.5), ("x", 100, 0.97, 0.1, 5.0, 0.5)], "symbol string, n_bars long, avg_confidence double, halt_fraction double, avg_stint double, ranging double")
    (g,) = R.gates(row, ["symbol"]).collect()
    assert g.failed == ["oos_bars < 500", "confidence > 0.95"] and not g.passed
    out = R.projected(R.regime_inputs(df, CFG), list(M.NAMES), 0.95).collect()
    x = np.array([r.components for r in out])
    assert 2 <= x.shape[1] <= 7 and np.allclose(np.cov(x.T) - np.diag(x.var(0, ddof=1)), 0, atol=1e-8)
