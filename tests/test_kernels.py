import math

import numpy as np
import pytest

from tapeworks.functions import kernels as K
from tapeworks.operators.bars import threshold_groups
from tapeworks.operators.profile import expand
from tapeworks.operators.stats import chi2_survival
from tapeworks.operators.validation import cpcv_folds, expected_max_sharpe, probabilistic_sharpe, wfa_windows


def test_ema_and_wilder():
    x = np.array([1.0, 2, 3, 4, 5])
    assert np.allclose(K.ema(x, 3), [1, 1.5, 2.25, 3.125, 4.0625])
    assert np.allclose(K.ema(x, 3, "sma")[2:], [2, 3, 4])
    assert np.allclose(K.wilder(x, 2, "sma")[1:], [1.5, 2.25, 3.125, 4.0625])
    assert np.allclose(K.wilder(x, 3)[:3], [1, 1.5, 2])
    assert len(K.ema(x[:0], 3)) == 0 and np.isnan(K.wilder(x[:1], 3, "sma")).all()


def test_rsi_limits():
    assert K.rsi(np.arange(30.0))[-1] == 100
    assert K.rsi(np.arange(30.0)[::-1])[-1] == 0
    assert (K.rsi(np.arange(5.0)) == 50).all()


def test_adx_of_a_trend():
    up = np.arange(80.0)
    a, p, m = K.adx(up + 1, up, up + 0.5)
    assert a[-1] > 90 and p[-1] > m[-1] and (a[:28] == 0).all()


def test_threshold_groups_match_a_loop():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 50, 500).astype(float)
    want, bar, acc = [], 0, 0.0
    for v in w:
        want.append(bar)
        acc += v
        if acc >= 200:
            bar, acc = bar + 1, 0.0
    assert threshold_groups(w, 200)[0].tolist() == want
    a, n, c = threshold_groups(w[:123], 200)
    b, *_ = threshold_groups(w[123:], 200, n, c)
    assert [*a, *b] == want


def test_value_area():
    levels, volume = np.arange(9), np.array([1.0, 2, 3, 9, 20, 9, 3, 2, 1])
    assert expand(levels, volume) == (4, 3, 5)
    assert expand(levels, np.ones(9), tie="up")[1:] == (0, 6)
    assert expand(np.array([7]), np.array([5.0])) == (7, 7, 7)


def test_change_points_and_states():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, 200), rng.normal(8, 1, 200)]
    assert K.bocpd(x)[195:230].any() and K.cusum(x, 0.5, 5)[200:215].any()
    p = np.array([[0.9, 0.1]] * 10 + [[0.1, 0.9]] * 10)
    assert K.hysteresis(p).tolist() == [0] * 10 + [1] * 10


def test_hidden_markov_filter_uses_no_later_bar():
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(-2, 0.5, (200, 1)), rng.normal(2, 0.5, (200, 1))]
    mu, var, start, move = K.fit_hmm(x, np.array([[-1.0], [1.0]]))
    ll = K.gaussian_log_like(x, mu, var)
    full, half = K.forward(ll, start, move), K.forward(ll[:150], start, move)
    assert np.allclose(full[:150], half)
    assert (K.viterbi(ll, start, move) == np.repeat([0, 1], 200)).mean() > 0.98


def test_exponents():
    rng = np.random.default_rng(42)
    noise = rng.normal(size=4000)
    assert 0.4 < K.dfa(noise) < 0.6 and K.dfa(np.cumsum(noise)) > 1.2
    assert K.hurst_rs(noise[:4]) == 0.5


def test_folds():
    rows = cpcv_folds(80)
    assert len({f for f, _, _ in rows}) == 28
    for fold in range(28):
        test = {d for f, d, r in rows if f == fold and r == "test"}
        train = {d for f, d, r in rows if f == fold and r == "train"}
        assert len(test) == 20 and not test & train
        assert not any(d + 1 in test or d - 1 in test for d in train)


@pytest.mark.parametrize(("n", "want"), [(500, 20), (84, 1), (83, 0)])
def test_walk_forward_windows(n, want):
    w = wfa_windows(n)
    assert len(w) == want and all(a[4] == b[3] for a, b in zip(w, w[1:], strict=False))


def test_sharpe_statistics():
    assert probabilistic_sharpe(0.0, 100, 0, 0) == 0.5
    assert probabilistic_sharpe(0.2, 250, 0, 0) > 0.99
    assert expected_max_sharpe(1, 1.0) == 0 and expected_max_sharpe(100, 1.0) > expected_max_sharpe(10, 1.0) > 0


@pytest.mark.parametrize(("x", "k", "p"), [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.0, 3, 1.0), (2.0, 2, math.exp(-1))])
def test_chi2(x, k, p):
    assert math.isclose(chi2_survival(x, k), p, rel_tol=1e-9)
