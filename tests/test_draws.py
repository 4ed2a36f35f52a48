"""Poisson draws by shifts and whole thresholds against the definition with remainders."""

import numpy as np

from panelwright.operators import evaluate as V


def test_draws_are_those_of_the_definition():
    k = np.random.default_rng(1).integers(0, V.FIELD, 2000)
    k[:4] = [0, V.FIELD - 1, 1, V.FIELD - 2]
    r = np.arange(1, 5001, dtype=np.int64)
    x = (k[:, None] * (r * 48271 % V.FIELD) + r * 16807 + 446) % V.FIELD
    x = (x * x + r) % V.FIELD
    x = (x * x + k[:, None]) % V.FIELD
    assert np.array_equal(np.searchsorted(V.POISSON, (x + 0.5) / V.FIELD), V.poisson_draws(k, 5000, 446))
    for cut, step in zip(V.POISSON, V.STEPS, strict=True):
        assert (step - 0.5) / V.FIELD <= cut < (step + 0.5) / V.FIELD


def test_remainders_are_taken_without_division():
    x = np.array([0, 1, V.FIELD - 1, V.FIELD, V.FIELD + 1, 2**62, 2**63 - 1], np.int64)
    want = x % V.FIELD
    V.reduced(x, np.empty_like(x))
    V.reduced(x, np.empty_like(x))
    assert x.max() <= V.FIELD + 2 and (x % V.FIELD == want).all()
