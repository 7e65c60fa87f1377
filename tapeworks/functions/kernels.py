"""Recursions over one ordered series, as functions of plain arrays.

Batch operators and streaming state share these.  Missing leading values are NaN.
"""

from __future__ import annotations

import numpy as np


def ema(x: np.ndarray, span: int, seed: str = "first") -> np.ndarray:
    """Exponential mean; seeded with the first value, or with the mean of the first ``span`` values."""
    x = np.asarray(x, float)
    out = np.full(len(x), np.nan)
    start = 0 if seed == "first" else span - 1
    if len(x) <= start:
        return out
    a = 2.0 / (span + 1)
    level = x[0] if seed == "first" else x[:span].mean()
    out[start] = level
    for i in range(start + 1, len(x)):
        level = a * x[i] + (1 - a) * level
        out[i] = level
    return out


def wilder(x: np.ndarray, n: int, seed: str = "grow") -> np.ndarray:
    """Wilder's mean. seed: ``grow`` (running mean until n values), ``first`` or ``sma`` (the mean of the first n)."""
    x = np.asarray(x, float)
    out = np.full(len(x), np.nan)
    if not len(x):
        return out
    if seed == "sma":
        if len(x) < n:
            return out
        level, start = x[:n].mean(), n
        out[n - 1] = level
    else:
        level, start = x[0], 1
        out[0] = level
    for i in range(start, len(x)):
        level = (level * i + x[i]) / (i + 1) if seed == "grow" and i < n else (level * (n - 1) + x[i]) / n
        out[i] = level
    return out


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.r_[np.nan, close[:-1]]
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder's index, seeded with simple means; 100 where there was no loss, 50 before."""
    out = np.full(len(close), 50.0)
    if len(close) <= n:
        return out
    d = np.diff(close)
    up, down = wilder(np.maximum(d, 0), n, "sma"), wilder(np.maximum(-d, 0), n, "sma")
    for i in range(n - 1, len(d)):
        out[i + 1] = 100.0 if down[i] < 1e-10 else 100 - 100 / (1 + up[i] / down[i])
    return out


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(adx, +di, -di); each mean seeded with its first value, zero until 2n + 1 bars."""
    size = len(close)
    zero = np.zeros(size)
    if size < 2 * n + 1:
        return zero, zero.copy(), zero.copy()
    up, down = np.diff(high), -np.diff(low)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = wilder(true_range(high, low, close)[1:], n, "first")
    safe = np.where(tr > 1e-10, tr, np.inf)
    p, m = 100 * wilder(plus, n, "first") / safe, 100 * wilder(minus, n, "first") / safe
    total = p + m
    dx = np.where(total > 1e-10, 100 * np.abs(p - m) / np.where(total > 1e-10, total, 1), 0.0)
    a = wilder(dx, n, "first")
    out = [np.r_[0.0, x] for x in (a, p, m)]
    for x in out:
        x[: 2 * n] = 0.0
    return out[0], out[1], out[2]


def cusum(x: np.ndarray, drift: float, limit: float, memory: float = 0.02) -> np.ndarray:
    """Two-sided cumulative sums about a slow mean; true where either passes the limit, which restarts both."""
    out = np.zeros(len(x), bool)
    mean = up = down = 0.0
    for i, v in enumerate(x):
        mean += min(1.0 / (i + 1), memory) * (v - mean)
        up, down = max(0.0, up + v - mean - drift), max(0.0, down - v + mean - drift)
        if up > limit or down > limit:
            out[i], up, down = True, 0.0, 0.0
    return out


def bocpd(x: np.ndarray, hazard: float = 60.0, longest: int = 300, drop: float = 0.3, beta0: float = 0.01) -> np.ndarray:
    """Online change points of a normal-inverse-gamma model: where the likeliest run length falls by more than ``drop``.

    A run that begins with an observation has seen it.
    """
    from math import lgamma

    out = np.zeros(len(x), bool)
    mu, kappa, alpha, beta = (np.array([v]) for v in (0.0, 1.0, 1.0, beta0))
    p = np.array([1.0])
    gammas = np.array([lgamma(a + 0.5) - lgamma(a) for a in 1.0 + np.arange(longest + 2) / 2])  # alpha is 1, 1.5, ...
    best = 0
    for i, v in enumerate(x):
        scale = beta * (kappa + 1) / (alpha * kappa)
        free = 2 * alpha
        like = np.exp(gammas[(2 * (alpha - 1)).astype(int)] - 0.5 * np.log(free * np.pi * scale) - (free + 1) / 2 * np.log1p((v - mu) ** 2 / (free * scale)))
        p = np.r_[(p * like / hazard).sum(), p * like * (1 - 1 / hazard)][: longest + 1]
        p = p / max(p.sum(), 1e-300)
        mu, kappa, alpha, beta = (np.r_[first, y][: longest + 1] for first, y in ((0.0, mu), (1.0, kappa), (1.0, alpha), (beta0, beta)))
        beta = beta + kappa * (v - mu) ** 2 / (2 * (kappa + 1))
        mu = (kappa * mu + v) / (kappa + 1)
        kappa, alpha = kappa + 1, np.minimum(alpha + 0.5, 1.0 + longest / 2)
        run = int(p.argmax())
        out[i] = best > 5 and run < best * (1 - drop)
        best = run
    return out


def hurst_rs(x: np.ndarray) -> float:
    """Rescaled-range exponent over windows of doubling size; 0.5 for short series."""
    sizes, ratios, n = [], [], 8
    while n <= len(x) // 2:
        parts = x[: len(x) // n * n].reshape(-1, n)
        y = np.cumsum(parts - parts.mean(1, keepdims=True), axis=1)
        s = parts.std(1)
        ok = s > 1e-12
        if ok.any():
            sizes.append(np.log(n))
            ratios.append(np.log(((y.max(1) - y.min(1))[ok] / s[ok]).mean()))
        n *= 2
    return float(np.polyfit(sizes, ratios, 1)[0]) if len(sizes) > 1 else 0.5


def dfa(x: np.ndarray) -> float:
    """Exponent of detrended fluctuations; 0.5 for short series."""
    y = np.cumsum(x - x.mean()) if len(x) else x
    sizes, logs, n = [], [], 8
    while n <= len(y) // 4:
        parts = y[: len(y) // n * n].reshape(-1, n)
        t = np.arange(n) - (n - 1) / 2
        fit = parts.mean(1, keepdims=True) + (parts @ t / (t @ t))[:, None] * t
        f = np.sqrt(((parts - fit) ** 2).mean())
        if f > 0:
            sizes.append(np.log(n))
            logs.append(np.log(f))
        n *= 2
    return float(np.polyfit(sizes, logs, 1)[0]) if len(sizes) > 1 else 0.5


def hysteresis(p: np.ndarray, enter: float = 0.65, leave: float = 0.45, least: int = 5) -> np.ndarray:
    """State that changes when another state's probability reaches ``enter`` while its own is below ``leave``, after ``least`` bars; -1 before any is entered."""
    out = np.empty(len(p), np.int64)
    state, age = -1, 0
    for i, row in enumerate(p):
        top = int(row.argmax())
        age += 1
        if state < 0 and row[top] >= enter or state >= 0 and top != state and row[top] >= enter and row[state] < leave and age >= least:
            state, age = top, 0
        out[i] = state
    return out


def forward(log_like: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Filtered state probabilities of a hidden Markov model; no later bar is used."""
    out = np.empty_like(log_like)
    p = start
    for i, row in enumerate(log_like):
        p = (p if i == 0 else p @ move) * np.exp(row - row.max())
        p = p / max(p.sum(), 1e-300)
        out[i] = p
    return out


def viterbi(log_like: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Likeliest path of states."""
    n, k = log_like.shape
    if not n:
        return np.empty(0, np.int64)
    lm = np.log(np.maximum(move, 1e-300))
    best = np.log(np.maximum(start, 1e-300)) + log_like[0]
    back = np.zeros((n, k), np.int64)
    for i in range(1, n):
        scores = best[:, None] + lm
        back[i] = scores.argmax(0)
        best = scores.max(0) + log_like[i]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def gaussian_log_like(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Log density of each row under diagonal Gaussians."""
    d = (x[:, None, :] - means) ** 2 / variances
    return -0.5 * (d + np.log(2 * np.pi * variances)).sum(-1)


def fit_hmm(x: np.ndarray, means: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expectation maximisation from given means: (means, variances, start, transition)."""
    k = len(means)
    var = np.tile(x.var(0) + 1e-6, (k, 1))
    start, move = np.full(k, 1 / k), np.full((k, k), 0.05 / max(1, k - 1)) + np.eye(k) * (0.95 - 0.05 / max(1, k - 1))
    for _ in range(rounds):
        ll = gaussian_log_like(x, means, var)
        b = np.exp(ll - ll.max(1, keepdims=True))
        a = forward(ll, start, move)
        g = np.ones_like(a)
        for i in range(len(x) - 2, -1, -1):
            g[i] = move @ (b[i + 1] * g[i + 1])
            g[i] /= max(g[i].sum(), 1e-300)
        post = a * g
        post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
        pairs = a[:-1, :, None] * move * (b[1:] * g[1:])[:, None, :]
        pairs /= np.maximum(pairs.sum((1, 2), keepdims=True), 1e-300)
        move = pairs.sum(0) + 1e-6
        move /= move.sum(1, keepdims=True)
        start = post[0] + 1e-6
        start /= start.sum()
        w = post.sum(0)[:, None] + 1e-9
        means = post.T @ x / w
        var = np.maximum(post.T @ (x**2) / w - means**2, 1e-6)
    return means, var, start, move
