"""Augmented Dickey-Fuller test with a constant: least squares, lag by AIC, p-value by MacKinnon's (1994) response surface."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

#: Response surface of the test with a constant (published values).
_SMALL, _LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
_STAR, _MIN, _MAX = -1.61, -18.83, 2.74


def p_value(stat: float) -> float:
    if stat > _MAX:
        return 1.0
    if stat < _MIN:
        return 0.0
    coef = _SMALL if stat <= _STAR else _LARGE
    return NormalDist().cdf(sum(c * stat**k for k, c in enumerate(coef)))


def _regress(y: np.ndarray, lags: int, first: int) -> tuple[float, float]:
    """(t statistic of the level, AIC) over the same rows for every number of lags."""
    d = np.diff(y)
    n = len(d) - first
    cols = [y[first:-1], np.ones(n)] + [d[first - k : len(d) - k] for k in range(1, lags + 1)]
    x, t = np.column_stack(cols), d[first:]
    beta, *_ = np.linalg.lstsq(x, t, rcond=None)
    rss = float(((t - x @ beta) ** 2).sum())
    cov = np.linalg.pinv(x.T @ x) * rss / max(n - x.shape[1], 1)
    return float(beta[0] / np.sqrt(max(cov[0, 0], 1e-300))), n * np.log(max(rss, 1e-300) / n) + 2 * x.shape[1]


def adf(y: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p, lags) of a series of at least eight values."""
    y = np.asarray(y, float)
    if len(y) < 8:
        raise ValueError("a series of at least eight values is needed")
    if np.ptp(y) == 0:
        return 0.0, 1.0, 0
    most = max(min(int(np.ceil(12 * (len(y) / 100) ** 0.25)), len(y) // 2 - 3), 0)
    lags = min(range(most + 1), key=lambda k: _regress(y, k, most)[1])
    stat, _ = _regress(y, lags, lags)
    return stat, p_value(stat), lags
