"""Tier classifiers and mixtures against numpy, fold by fold."""

import numpy as np
import pytest

from panelwright.operators import folds, mixtures

SCHEMES, ALPHAS = [(0.0,), (-0.5, 0.6)], (0.1, 10.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for segment in "AB":
        for period in range(2000, 2008):
            for i in range(45):
                a, b = rng.normal(), 5 + 3 * rng.normal()
                role = float(a + rng.normal() / 2)
                out.append((segment, period, i, float(a), None if i == 7 else float(b), None if i == 8 else role, float((1 + (role > 0)) * a + b / 5 + rng.normal() / 3)))
    return spark.createDataFrame(out, "segment string, period long, entity long, a double, b double, role double, actual double")


def descent(z, tiers, k, rounds=60):
    """Newton on the whole softmax, or on the logistic of two tiers, with numeric Hessians left to numpy."""
    n, counts = len(z), np.bincount(tiers, minlength=k)
    w = (n / k / counts)[tiers]
    free = 1 if k == 2 else k
    beta, penal = np.zeros(free * z.shape[1]), np.tile([0.0] + [1.0] * (z.shape[1] - 1), free)
    for _ in range(rounds):
        s = z @ beta.reshape(free, -1).T
        s = np.c_[np.zeros(n), s] if k == 2 else s
        p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
        g, h = np.zeros_like(beta), np.zeros((len(beta), len(beta)))
        for i in range(n):
            e = (np.eye(k)[tiers[i]] - p[i])[-free:]
            g += w[i] * np.kron(e, z[i])
            q = p[i][-free:]
            h += w[i] * np.kron(np.diag(q) - np.outer(q, q), np.outer(z[i], z[i]))
        beta = beta + np.linalg.pinv(h + np.diag(penal), rcond=1e-12) @ (g - penal * beta)
    return beta.reshape(free, -1)


def slow_mixture(past, now, cuts, alpha):
    x, v = past[["a", "b"]].to_numpy(), now[["a", "b"]].to_numpy()
    scale = lambda x, by: (x - by.mean(0)) / by.std(0)
    one = lambda z: np.c_[np.ones(len(z)), z]
    tiers = np.digitize(past.role, cuts)
    s = one(scale(v, x)) @ descent(one(scale(x, x)), tiers, len(cuts) + 1).T
    s = np.c_[np.zeros(len(s)), s] if len(cuts) == 1 else s
    p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    out = np.zeros(len(v))
    for t in range(len(cuts) + 1):
        own, y = x[tiers == t], past.actual.to_numpy()[tiers == t]
        z = scale(own, own)
        w = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean()))
        out += p[:, t] * (y.mean() + scale(v, own) @ w)
    return p, out


def test_mixtures_equal_numpy_and_see_the_past_only(spark, rows):
    got = mixtures.mixed(rows, "segment", "period", ["a", "b"], "actual", "role", SCHEMES, ALPHAS).toPandas()
    data = rows.toPandas()
    data["b"] = data.b.fillna(0.0)
    assert len(got) == len(data)
    assert all(t[0] is None and t[1] is None for t in got[got.period == 2000].tiers)
    for period in (2003, 2007):
        past = data[(data.segment == "B") & (data.period < period) & data.role.notna()]
        now = got[(got.segment == "B") & (got.period == period)].sort_values("entity")
        for i, cuts in enumerate(SCHEMES):
            for j, alpha in enumerate(ALPHAS):
                p, want = slow_mixture(past, data[(data.segment == "B") & (data.period == period)].sort_values("entity"), cuts, alpha)
                assert np.allclose(np.stack([t[i] for t in now.tiers]), p, atol=1e-6)
                assert np.allclose([m[i * 2 + j] for m in now.mixed], want, atol=1e-6)


def test_a_fold_takes_what_did_best_inside(spark, rows):
    scored = mixtures.mixed(rows, "segment", "period", ["a", "b"], "actual", "role", SCHEMES, ALPHAS)
    inner = folds.inner_periods(folds.expanding_folds(rows, "period", "segment", 50), "segment")
    settings = {i * 2 + j: (c, a) for i, c in enumerate(SCHEMES) for j, a in enumerate(ALPHAS)}
    best = {(r["segment"], r["fold"]): r for r in mixtures.chosen(scored, "segment", "period", "actual", settings, inner).collect()}
    frame = scored.toPandas()
    error = {(s, p, i): np.mean([abs(y - m[i]) if m[i] is not None else np.nan for y, m in zip(g.actual, g.mixed, strict=True)]) for (s, p), g in frame.groupby(["segment", "period"]) for i in settings}
    assert best
    for (s, f), r in best.items():
        inside = [x["inner_fold"] for x in inner.filter(f"segment = '{s}' and fold = {f}").collect()]
        mean = {i: np.mean([error[s, p, i] for p in inside]) for i in settings}
        mean = {i: round(v, 9) for i, v in mean.items() if v == v}
        assert r["setting"] == min(mean, key=lambda i: (mean[i], i)) and r["mae"] == pytest.approx(error[s, f, r["setting"]])


def test_too_few_rows_of_a_tier(spark, rows):
    got = mixtures.mixed(rows.filter("period < 2002"), "segment", "period", ["a"], "actual", "role", [(9.0,)], (1.0,)).collect()
    assert all(r["tiers"] == [None] and r["mixed"] == [None] for r in got)
    assert mixtures.mixed(rows.limit(0), "segment", "period", ["a"], "actual", "role", [(0.0,)], (1.0,)).collect() == []
