"""Seasonal ARIMA in numpy: exact likelihood by a Kalman filter on the differenced series, Nelder-Mead on parameters that
keep the polynomials stable (Monahan 1984), psi-weight intervals, and a stepwise search by AIC (Hyndman & Khandakar 2008)."""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np

from .adf import adf


def _stable(u: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary polynomial from any real numbers."""
    out = np.zeros(0)
    for r in np.tanh(u):
        out = np.append(out - r * out[::-1], r)
    return out


def _poly(coef: np.ndarray, seasonal: np.ndarray, m: int, sign: int) -> np.ndarray:
    """(1 + sign*coef(B)) (1 + sign*seasonal(B^m)), lowest power first."""
    a = np.concatenate([[1.0], sign * coef])
    b = np.zeros(len(seasonal) * m + 1)
    b[0] = 1.0
    b[m::m] = sign * seasonal if len(seasonal) else []
    return np.convolve(a, b)


def difference(y: np.ndarray, d: int, D: int, m: int) -> np.ndarray:
    for _ in range(D):
        y = y[m:] - y[:-m]
    for _ in range(d):
        y = np.diff(y)
    return y


def nelder_mead(f, x0: np.ndarray, steps: int, scale: float = 0.25) -> tuple[np.ndarray, float]:
    n = len(x0)
    if n == 0:
        return x0, f(x0)
    pts = [x0, *(x0 + scale * np.eye(n)[i] for i in range(n))]
    val = [f(p) for p in pts]
    for _ in range(steps):
        o = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in o], [val[i] for i in o]
        if val[-1] - val[0] < 1e-7:
            break
        mid = np.mean(pts[:-1], axis=0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < val[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = mid + 0.5 * ((r if fr < val[-1] else pts[-1]) - mid)
            fc = f(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0], *(pts[0] + 0.5 * (p - pts[0]) for p in pts[1:])]
                val = [val[0], *(f(p) for p in pts[1:])]
    best = int(np.argmin(val))
    return pts[best], val[best]


def _filter(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(-2 log likelihood, sigma^2, state after the last value) of a zero-mean ARMA; ar, ma without their leading 1."""
    r = max(len(ar), len(ma) + 1)
    phi, g = np.zeros(r), np.zeros(r)
    phi[: len(ar)] = ar
    g[0], g[1 : len(ma) + 1] = 1.0, ma
    trans = np.zeros((r, r))
    trans[:, 0] = phi
    trans[:-1, 1:] = np.eye(r - 1)
    q = np.outer(g, g)
    p, a = q.copy(), trans.copy()
    for _ in range(40):  # the stationary covariance by doubling
        step = a @ p @ a.T
        p = p + step
        a = a @ a
        if np.abs(step).max() < 1e-10 * np.abs(p).max():
            break
        if not np.isfinite(p).all():
            return np.inf, np.nan, np.zeros(r)
    state, total, logs, f_old, gain = np.zeros(r), 0.0, 0.0, 0.0, None
    for y in w:
        if gain is None or p is not None:
            f = p[0, 0]
            k = p[:, 0] / f
            if abs(f - f_old) < 1e-10:
                gain, p = k, None
            f_old = f
        v = y - state[0]
        total += v * v / f
        logs += np.log(f)
        state = trans @ (state + (k if p is not None else gain) * v)
        if p is not None:
            p = trans @ (p - np.outer(k, p[0])) @ trans.T + q
    n = len(w)
    s2 = max(total / n, 1e-300)
    return n * (np.log(2 * np.pi * s2) + 1) + logs, s2, state


@dataclass
class Sarima:
    order: tuple[int, int, int]
    seasonal: tuple[int, int, int] = (0, 0, 0)
    m: int = 12
    drift: bool = True
    aic: float = np.inf
    sigma2: float = np.nan
    params: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _coef(self, x: np.ndarray):
        (p, _, q), (P, _, Q) = self.order, self.seasonal
        a, b, c, e = np.split(x[: p + q + P + Q], np.cumsum([p, q, P]))
        return -_poly(_stable(a), _stable(c), self.m, -1)[1:], _poly(_stable(b), _stable(e), self.m, 1)[1:], x[p + q + P + Q] if self.drift else 0.0

    def fit(self, y: np.ndarray, steps: int = 600) -> Sarima:
        """Also for a series shorter than the season, as long as differencing leaves eight values."""
        self.y = np.asarray(y, float)
        w = difference(self.y, self.order[1], self.seasonal[1], self.m)
        if len(w) < 8:
            raise ValueError("too short a series for this order")
        unit = float(w.std()) or 1.0
        self.unit = unit
        n = self.order[0] + self.order[2] + self.seasonal[0] + self.seasonal[2]
        x0 = np.concatenate([np.full(n, 0.1), [w.mean() / unit] if self.drift else []])

        def loss(x):
            ar, ma, c = self._coef(x)
            return _filter(w / unit - c, ar, ma)[0]

        self.params, value = nelder_mead(loss, x0, steps)
        ar, ma, c = self._coef(self.params)
        _, s2, self.state = _filter(w / unit - c, ar, ma)
        self.sigma2 = s2 * unit * unit
        self.aic = value + 2 * len(w) * np.log(unit) + 2 * (len(x0) + 1)
        self.w = w
        return self

    def forecast(self, h: int, level: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean, low, high) of the next h values."""
        ar, ma, c = self._coef(self.params)
        r = len(self.state)
        phi = np.zeros(r)
        phi[: len(ar)] = ar
        s, ahead = self.state.copy(), []
        for _ in range(h):
            ahead.append((s[0] + c) * self.unit)
            s = phi * s[0] + np.append(s[1:], 0.0)
        diff = np.array([1.0])
        for _ in range(self.order[1]):
            diff = np.convolve(diff, [1.0, -1.0])
        for _ in range(self.seasonal[1]):
            diff = np.convolve(diff, np.concatenate([[1.0], np.zeros(self.m - 1), [-1.0]]))
        path = self.y.tolist()
        for x in ahead:
            path.append(x - sum(diff[k] * path[-k] for k in range(1, len(diff))))
        mean = np.array(path[len(self.y) :])
        full = np.convolve(np.concatenate([[1.0], -ar]), diff)
        psi = np.zeros(h)
        for j in range(h):
            psi[j] = (1.0 if j == 0 else ma[j - 1] if j <= len(ma) else 0.0) - sum(full[k] * psi[j - k] for k in range(1, min(j, len(full) - 1) + 1))
        half = NormalDist().inv_cdf(0.5 + level / 2) * np.sqrt(self.sigma2 * np.cumsum(psi**2))
        return mean, mean - half, mean + half


def _lagged(x: np.ndarray, lags: int, first: int) -> np.ndarray:
    """Columns x[t - 1] .. x[t - lags] for t from first on."""
    return np.column_stack([x[first - k : len(x) - k] for k in range(1, lags + 1)])


def _ocsb_statistic(y: np.ndarray, m: int, lags: int, first: int) -> tuple[float, float]:
    """(t statistic of the seasonal level, AIC) of the regression by Osborn, Chui, Smith and Birchenhall (1988) with `lags` lags.

    The twice differenced series is explained by its own lags and by two levels, the seasonal differences one month ago and the
    monthly ones a season ago, both filtered by the autoregression of the twice differenced series."""
    yearly, monthly = y[m:] - y[:-m], np.diff(y)
    both = np.diff(yearly)
    t = both[first:]
    own = _lagged(both, lags, first)
    fit, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(t)), own]), t, rcond=None)

    def filtered(x: np.ndarray) -> np.ndarray:
        return x[lags:] - np.column_stack([np.ones(len(x) - lags), _lagged(x, lags, lags)]) @ fit

    at = np.arange(first, len(both))  # month m + 1 + at of y
    levels = np.column_stack([filtered(yearly)[at - lags], filtered(monthly)[at - lags]])
    x = np.column_stack([own, levels])
    beta, *_ = np.linalg.lstsq(x, t, rcond=None)
    rss = float(((t - x @ beta) ** 2).sum())
    cov = np.linalg.pinv(x.T @ x) * rss / max(len(t) - x.shape[1], 1)
    return float(beta[-1] / np.sqrt(max(cov[-1, -1], 1e-300))), len(t) * np.log(max(rss, 1e-300) / len(t)) + 2 * x.shape[1]


#: The surface of the test's critical values over the logarithm of the season's length (published values).
_CRITICAL = (-0.2937411, -0.2850853, 0.7656451, -0.05983644, 1.652202)


def needs_seasonal_difference(y: np.ndarray, m: int, most: int = 3) -> bool:
    """Whether the series has a seasonal unit root: the statistic lies above the critical value, the number of lags chosen by AIC.

    Series too short for the regression, and constant ones, have none."""
    y = np.asarray(y, float)
    if len(y) < 2 * m + 2 * most + 6 or np.ptp(y) == 0:
        return False
    lags = min(range(1, most + 1), key=lambda k: _ocsb_statistic(y, m, k, most)[1])
    a, b, c, d, e = _CRITICAL
    at = np.log(m) - c
    return _ocsb_statistic(y, m, lags, lags)[0] > a * np.exp(b * at + d * at * at) - e


def auto_sarima(y: np.ndarray, m: int = 12, steps: int = 150) -> Sarima:
    """The stepwise search's best model, fitted in full: p and q to 5, P and Q to 2, with and without a constant, until no neighbour has a lower AIC.

    The seasonal difference is taken by a test of its unit root, differences by the augmented Dickey-Fuller test. A
    constant is not looked for after two differences or more, where it would be a curve."""
    y = np.asarray(y, float)
    D = int(needs_seasonal_difference(y, m))
    w, d = difference(y, 0, D, m), 0
    while d < 2 and len(w) >= 12 and adf(w)[1] >= 0.05:
        w, d = np.diff(w), d + 1
    may_drift = d + D <= 1
    seen: dict = {}
    asked: set = set()

    def tried(p, q, P, Q, drift):
        key = (p, q, P, Q, drift)
        if min(key[:4]) < 0 or p > 5 or q > 5 or P > 2 or Q > 2 or (drift and not may_drift) or key in asked:
            return
        asked.add(key)
        try:
            seen[key] = Sarima((p, d, q), (P, D, Q), m, drift).fit(y, steps)
        except (ValueError, np.linalg.LinAlgError):
            pass

    for start in ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1)):
        tried(*start, may_drift)
    tried(0, 0, 0, 0, False)
    if not seen:
        return Sarima((0, d, 0), (0, 0, 0), m, may_drift).fit(y)
    steps_to = ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1))
    while True:
        best = min(seen, key=lambda k: seen[k].aic)
        p, q, P, Q, drift = best
        for step in steps_to:
            for sign in (-1, 1):
                tried(*(a + sign * b for a, b in zip(best[:4], step, strict=True)), drift)
        tried(p, q, P, Q, not drift)
        if min(seen, key=lambda k: seen[k].aic) == best:
            return Sarima((p, d, q), (P, D, Q), m, drift).fit(y)
