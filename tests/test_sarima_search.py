"""The stepwise search runs to the reference's bounds, however many models that takes."""

import numpy as np

from viaduct.forecast import sarima


def test_search_reaches_the_bounds(monkeypatch):
    tried = []

    def fit(self, y, steps=600):
        (p, _, q), (P, _, Q) = self.order, self.seasonal
        tried.append((p, q, P, Q))
        self.aic = -p - 1.1 * q - 5.0 * P - 5.5 * Q
        return self

    monkeypatch.setattr(sarima.Sarima, "fit", fit)
    best = sarima.auto_sarima(np.random.default_rng(0).normal(size=120))
    assert (best.order[0], best.order[2], best.seasonal[0], best.seasonal[2]) == (5, 5, 2, 2)
    assert max(map(max, tried)) == 5
