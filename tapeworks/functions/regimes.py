"""Features, model and decisions of the regime detector, as functions of plain arrays.

Nothing here looks ahead: features are rolling, the model is fitted on a span that
comes before what it labels, probabilities are filtered forward.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace
from itertools import permutations

import numpy as np

from . import kernels as K

TRENDING, RANGING, HIGH_VOL = 0, 1, 2
NAMES = ("log_return", "gk_vol", "hurst", "autocorr", "adx", "vol_of_vol", "vpin")


@dataclass(frozen=True)
class Config:
    """Windows, thresholds and the family of emissions; the values published for five-minute bars."""

    tier: str = "t2"
    vol_window: int = 20
    hurst_window: int = 250
    hurst_stride: int = 5
    autocorr_window: int = 100
    autocorr_lags: int = 10
    adx_period: int = 14
    bucket: float = 100.0
    buckets: int = 50
    zscore: int = 500
    states: int = 3
    rounds: int = 30
    emission: str = "gaussian"  # or studentt
    dof: float = 5.0
    variance: float = 0.95
    enter: float = 0.65
    leave: float = 0.45
    ambiguous: float = 0.55
    least_bars: int = 5
    halt_flips: int = 2
    halt_window: int = 20
    agree: int = 2
    agree_within: int = 5
    volatility_z: float = 2.0
    volatility_window: int = 50

    def small(self) -> Config:
        """Shorter windows, for few bars."""
        return replace(self, hurst_window=64, autocorr_window=50, zscore=100)


def rolling(x: np.ndarray, n: int, f: str, least: int = 2) -> np.ndarray:
    """Mean or sample deviation of the last n values that aren't NaN, of ``least`` at least."""
    ok = np.isfinite(x)
    v = np.where(ok, x, 0.0)
    total = lambda a: np.concatenate([np.cumsum(a)[: n], np.cumsum(a)[n:] - np.cumsum(a)[:-n]])
    count, shift = total(ok.astype(float)), v[ok].mean() if ok.any() else 0.0
    v = np.where(ok, x - shift, 0.0)
    mean = total(v) / np.maximum(count, 1)
    if f == "std":
        mean = np.sqrt(np.maximum(total(v * v) - count * mean**2, 0.0) / np.maximum(count - 1, 1))
    else:
        mean = mean + shift
    return np.where(count >= least, mean, np.nan)


def garman_klass(o: np.ndarray, h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:  # noqa: E741
    """Volatility from ranges and bodies."""
    log = lambda x: np.log(np.maximum(x, 1e-10))
    return np.sqrt(np.maximum(rolling(0.5 * (log(h) - log(l)) ** 2 - (2 * np.log(2) - 1) * (log(c) - log(o)) ** 2, n, "mean"), 0.0))


def fluctuation_exponent(x: np.ndarray) -> float:
    """Exponent of detrended fluctuations over ten scales from 4 to a quarter of the length; 0.5 if it can't be told."""
    if len(x) < 16:
        return 0.5
    y = np.cumsum(x - x.mean())
    at, logs = [], []
    for n in np.unique(np.logspace(np.log10(4), np.log10(max(len(x) // 4, 5)), 10).astype(int)):
        parts = y[: len(y) // n * n].reshape(-1, n)
        t = np.arange(n) - (n - 1) / 2
        rest = parts - parts.mean(1, keepdims=True) - np.outer(parts @ t / (t @ t), t)
        size = np.sqrt((rest**2).mean())
        if size > 1e-15:
            at.append(np.log(n))
            logs.append(np.log(size))
    if len(at) < 2 or np.ptp(at) < 1e-9:
        return 0.5
    return float(np.clip(np.polyfit(at, logs, 1)[0], 0.0, 1.5))


def rolling_exponent(r: np.ndarray, n: int, stride: int) -> np.ndarray:
    """The exponent of the n returns before each ``stride``-th bar, carried forward."""
    out = np.full(len(r), np.nan)
    last = np.nan
    for i in range(n, len(r)):
        if (i - n) % stride == 0:
            last = fluctuation_exponent(r[i - n : i])
        out[i] = last
    return out


def autocorrelations(r: np.ndarray, n: int, lags: int) -> np.ndarray:
    """Sum of the first autocorrelations of the n returns before each bar."""
    out = np.full(len(r), np.nan)
    if len(r) <= n:
        return out
    w = np.lib.stride_tricks.sliding_window_view(r[:-1], n)
    for lo in range(0, len(w), 4096):
        x = w[lo : lo + 4096] - w[lo : lo + 4096].mean(1, keepdims=True)
        var = (x * x).mean(1)
        total = sum((x[:, k:] * x[:, :-k]).sum(1) / (n - k) for k in range(1, min(lags + 1, n)))
        out[n + lo : n + lo + len(x)] = np.where(var < 1e-20, 0.0, total / np.maximum(var, 1e-20))
    return out


def informed_trading(h: np.ndarray, l: np.ndarray, c: np.ndarray, v: np.ndarray, bucket: float, buckets: int) -> np.ndarray:  # noqa: E741
    """Mean imbalance of the last full volume buckets; a bar's volume is bought by the share of its range below the close."""
    share = np.where(h - l > 1e-10, (c - l) / np.where(h - l > 1e-10, h - l, 1.0), 0.5)
    v = np.maximum(v, 0.0)
    volume, bought = np.r_[0.0, np.cumsum(v)], np.r_[0.0, np.cumsum(v * share)]
    full = np.floor((volume[1:] + 1e-9) / bucket).astype(np.int64)
    edges = np.arange(0, (full[-1] if len(full) else 0) + 1) * bucket
    # Bought volume grows in proportion within a bar, so its value at an edge is a straight line's.
    imbalance = np.abs(2 * np.diff(np.interp(edges, volume, bought)) - bucket) / bucket
    total = np.r_[0.0, np.cumsum(imbalance)]
    first = np.maximum(full - buckets, 0)
    return np.where(full > 0, (total[full] - total[first]) / np.maximum(full - first, 1), np.nan)


def raw_features(a: dict[str, np.ndarray], cfg: Config) -> np.ndarray:
    """A column for each of ``NAMES`` (the first four for tier t1)."""
    o, h, l, c = (a[k] for k in ("open", "high", "low", "close"))  # noqa: E741
    r = np.r_[0.0, np.diff(np.log(np.maximum(c, 1e-10)))] if len(c) else np.empty(0)
    gk = garman_klass(o, h, l, c, cfg.vol_window)
    out = [r, gk, rolling_exponent(r, cfg.hurst_window, cfg.hurst_stride), autocorrelations(r, cfg.autocorr_window, cfg.autocorr_lags)]
    if cfg.tier == "t2":
        x, _, _ = K.adx(h, l, c, cfg.adx_period)
        x[: 2 * cfg.adx_period] = np.nan
        out += [x / 100.0, rolling(gk, cfg.vol_window, "std"), informed_trading(h, l, c, a["volume"], cfg.bucket, cfg.buckets)]
    return np.column_stack(out)


def scaled(raw: np.ndarray, n: int) -> np.ndarray:
    """Rolling z-scores within -3 and 3."""
    out = np.empty_like(raw)
    for k in range(raw.shape[1]):
        sd = rolling(raw[:, k], n, "std")
        out[:, k] = (raw[:, k] - rolling(raw[:, k], n, "mean")) / np.where((sd < 1e-10) | ~np.isfinite(sd), 1.0, sd)
    return np.clip(out, -3.0, 3.0)


def features(a: dict[str, np.ndarray], cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    """Scaled features of the bars that have all of them, and their numbers."""
    z = scaled(raw_features(a, cfg), cfg.zscore)
    z[: cfg.zscore] = np.nan
    at = np.flatnonzero(np.isfinite(z).all(1))
    return z[at], at


@dataclass
class Model:
    """A rotation that decorrelates, and a hidden Markov model whose states have names."""

    mean: np.ndarray
    axes: np.ndarray
    mu: np.ndarray
    cov: np.ndarray
    start: np.ndarray
    move: np.ndarray
    names: list[int]  # regime of each state
    cfg: Config = field(default_factory=Config)

    def probabilities(self, z: np.ndarray, smooth: bool = False) -> np.ndarray:
        """Regimes' probabilities of each row, filtered forward; ``smooth`` looks at later rows too."""
        ll = log_like((z - self.mean) @ self.axes.T, self.mu, self.cov, self.cfg)
        p = smoothed(ll, self.start, self.move) if smooth else K.forward(ll, self.start, self.move)
        out = np.zeros((len(z), 3))
        for s, name in enumerate(self.names):
            out[:, name] += p[:, s]
        return out


def principal_axes(z: np.ndarray, variance: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the fewest principal axes that explain so much of the variance."""
    mean = z.mean(0)
    _, s, axes = np.linalg.svd(z - mean, full_matrices=False)
    share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
    return mean, axes[: min(int(np.searchsorted(share, variance)) + 1, len(s))]


def centres(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Means of k clusters, from starts that lie far from each other (the same for the same rows)."""
    out = [x[np.abs(x - x.mean(0)).sum(1).argmin()]]
    for _ in range(k - 1):
        out.append(x[np.min([((x - c) ** 2).sum(1) for c in out], axis=0).argmax()])
    out = np.array(out)
    for _ in range(rounds):
        own = ((x[:, None, :] - out) ** 2).sum(-1).argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else out[j] for j in range(k)])
        if np.allclose(new, out):
            break
        out = new
    return out


def _distances(x: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared Mahalanobis distances (rows, states) and log determinants."""
    d, det = np.empty((len(x), len(mu))), np.empty(len(mu))
    for s in range(len(mu)):
        low = np.linalg.cholesky(cov[s])
        y = np.linalg.solve(low, (x - mu[s]).T)
        d[:, s], det[s] = (y * y).sum(0), 2 * np.log(np.diag(low)).sum()
    return d, det


def log_like(x: np.ndarray, mu: np.ndarray, cov: np.ndarray, cfg: Config) -> np.ndarray:
    """Log density of each row in each state."""
    from math import lgamma

    d, det = _distances(x, mu, cov)
    k = x.shape[1]
    if cfg.emission == "gaussian":
        return -0.5 * (d + det + k * np.log(2 * np.pi))
    f = cfg.dof
    return lgamma((f + k) / 2) - lgamma(f / 2) - 0.5 * (k * np.log(f * np.pi) + det) - (f + k) / 2 * np.log1p(d / f)


def _backward(ll: np.ndarray, move: np.ndarray) -> np.ndarray:
    b = np.exp(ll - ll.max(1, keepdims=True))
    g = np.ones_like(b)
    for i in range(len(b) - 2, -1, -1):
        g[i] = move @ (b[i + 1] * g[i + 1])
        g[i] /= max(g[i].sum(), 1e-300)
    return g


def smoothed(ll: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """State probabilities given all rows."""
    p = K.forward(ll, start, move) * _backward(ll, move)
    return p / np.maximum(p.sum(1, keepdims=True), 1e-300)


def fit(z: np.ndarray, cfg: Config) -> Model:
    """Rotation, cluster means, then expectation maximisation with full (Gaussian) or diagonal (Student) scatter; states get names."""
    mean, axes = principal_axes(z, cfg.variance)
    x = (z - mean) @ axes.T
    k, d = cfg.states, x.shape[1]
    mu, ridge = centres(x, k), 1e-3 * np.eye(d)
    cov = np.tile(np.atleast_2d(np.cov(x.T)) + ridge, (k, 1, 1))
    if cfg.emission != "gaussian":
        cov = cov * np.eye(d)
    start, move = np.full(k, 1 / k), np.full((k, k), 0.05 / max(1, k - 1)) + np.eye(k) * (0.95 - 0.05 / max(1, k - 1))
    before = -np.inf
    for _ in range(cfg.rounds):
        ll = log_like(x, mu, cov, cfg)
        a, g = K.forward(ll, start, move), _backward(ll, move)
        b = np.exp(ll - ll.max(1, keepdims=True))
        post = a * g
        post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
        pairs = a[:-1, :, None] * move * (b[1:] * g[1:])[:, None, :]
        pairs /= np.maximum(pairs.sum((1, 2), keepdims=True), 1e-300)
        move = pairs.sum(0) + 1e-6
        move /= move.sum(1, keepdims=True)
        start = (post[0] + 1e-6) / (post[0] + 1e-6).sum()
        # A Student density is a Gaussian whose rows weigh less the farther off they are.
        weight = post * ((cfg.dof + d) / (cfg.dof + _distances(x, mu, cov)[0])) if cfg.emission != "gaussian" else post
        mu = weight.T @ x / (weight.sum(0)[:, None] + 1e-9)
        for s in range(k):
            y = x - mu[s]
            c = (weight[:, s, None] * y).T @ y / (post[:, s].sum() + 1e-9) + ridge
            cov[s] = c if cfg.emission == "gaussian" else c * np.eye(d)
        now = float(ll.max())
        if abs(now - before) < 1e-9:
            break
        before = now
    return Model(mean, axes, mu, cov, start, move, named(mu @ axes + mean, cov[:, 0, 0], cfg.states), cfg)


def named(means: np.ndarray, spread: np.ndarray, k: int) -> list[int]:
    """The assignment of states to trending, ranging and high volatility of least cost, by means in the features' own space."""
    m = np.pad(means, ((0, 0), (0, max(0, 6 - means.shape[1]))))
    ret, vol, hurst, auto, adx, vov = (m[:, i] for i in range(6))
    cost = np.column_stack([-(np.abs(ret) + 0.5 * hurst + 0.3 * auto - 0.2 * vol + 0.4 * adx), vol + np.abs(ret) + 0.3 * hurst + 0.3 * adx, -(vol + spread + 0.3 * vov)])
    best = min(permutations(range(3), min(k, 3)), key=lambda p: sum(cost[s, p[s]] for s in range(len(p))))
    return list(best)


def change_points(ret: np.ndarray, vol: np.ndarray, cfg: Config) -> np.ndarray:
    """Where two of three detectors fired within the last bars: run lengths, cumulative sums, a jump of volatility."""
    before = np.r_[np.nan, vol[:-1]]
    base, sd = (rolling(before, cfg.volatility_window - 1, f, 9) for f in ("mean", "std"))
    jump = np.abs(np.where(sd > 1e-10, (vol - base) / np.where(sd > 1e-10, sd, 1.0), 0.0)) > cfg.volatility_z
    fired = [K.bocpd(ret), K.cusum(ret, 0.5, 4.0), jump]
    recent = lambda x: np.convolve(x, np.ones(cfg.agree_within), "full")[: len(x)] > 0
    return sum(recent(f).astype(int) for f in fired) >= cfg.agree


class Decision:
    """Regime in force: thresholds to enter and leave, ambiguity, confirmation, size, and a halt after many flips."""

    def __init__(self, cfg: Config) -> None:
        self.cfg, self.regime, self.age, self.halt = cfg, RANGING, 0, False
        self.flips: deque[int] = deque(maxlen=cfg.halt_window)

    def step(self, p: np.ndarray, confirmed: bool) -> tuple[int, float, bool, float, int, bool]:
        """(regime, confidence, changed, size, bars in it, halted)"""
        cfg, top = self.cfg, float(p.max())
        wanted = self.regime
        if top >= cfg.ambiguous and p[self.regime] < cfg.leave:
            wanted = next((r for r in range(3) if r != self.regime and p[r] > cfg.enter), self.regime)
        changed = wanted != self.regime and (confirmed or cfg.agree <= 0)
        self.flips.append(int(changed))
        self.age = 1 if changed else self.age + 1
        self.regime = wanted if changed else self.regime
        n = sum(self.flips)
        self.halt = n > cfg.halt_flips or self.halt and n > 1
        size = 1.0 if top > cfg.enter else 0.5 if top >= cfg.leave else 0.0
        if self.halt or self.age < cfg.least_bars:
            size = 0.0
        return self.regime, top, changed, size, self.age, self.halt


OUT = ("p_trending", "p_ranging", "p_highvol", "regime", "confidence", "changed", "size", "bars_in", "halt")


def decided(p: np.ndarray, z: np.ndarray, cfg: Config) -> np.ndarray:
    """A row of ``OUT`` for each row of probabilities; z are the scaled features."""
    change, d = change_points(z[:, 0], z[:, 1], cfg), Decision(cfg)
    return np.array([[*p[i], *map(float, d.step(p[i], bool(change[i])))] for i in range(len(p))]).reshape(len(p), len(OUT))


def detected(a: dict[str, np.ndarray], cfg: Config, fit_rows: int) -> np.ndarray:
    """Rows of ``OUT`` of all bars: fitted on the first ``fit_rows`` bars with features, filtered after them.

    Until then: ranging, no confidence, no size, halted.
    """
    out = np.tile(np.array([0.0, 0.0, 0.0, RANGING, 0.0, 0.0, 0.0, 0.0, 1.0]), (len(a["close"]), 1))
    z, at = features(a, cfg)
    if len(at) > fit_rows >= 10 * cfg.states:
        model = fit(z[:fit_rows], cfg)
        out[at[fit_rows:]] = decided(model.probabilities(z), z, cfg)[fit_rows:]
    return out
