"""Power calibration reads the tables once and finds the medians that sorting finds."""

import numpy as np

from panelwright.operators import calibrate
from panelwright.plans import base, models


def test_fits_equal_sorting_every_exponent(spark):
    rng = np.random.default_rng(5)
    data = [("x" if i % 3 else "y", int(rng.integers(1, 5)), float(rng.integers(1, 60)) / 2, float(rng.choice([0.0, -0.0, 1.5, rng.gamma(2.0, 30.0)]))) for i in range(1500)]
    df = spark.createDataFrame(data, "g string, t int, r double, y double").repartition(5)
    folds = spark.createDataFrame([(g, f) for g in "xy" for f in (2, 3, 5)], "g string, fold long")
    got = {(r["g"], r["fold"]): r for r in calibrate.power_calibration(df, "g", "t", "r", "y", folds).collect()}
    assert len(got) == 6
    betas = np.array([0.05 + i * ((1.50 - 0.05) / 145) for i in range(146)])
    for (g, fold), r in got.items():
        x = np.array([(a, b) for h, t, a, b in data if h == g and t < fold])
        w = x[:, :1] ** -betas
        v = x[:, 1:] / w
        maes, alphas = [], []
        for i in range(len(betas)):
            order = np.argsort(v[:, i], kind="stable")
            run = np.cumsum(w[order, i])
            alphas.append(v[order, i][np.searchsorted(run, run[-1] / 2)])
            maes.append(np.abs(x[:, 1] - alphas[-1] * w[:, i]).mean())
        best = int(np.argmin(maes))
        assert r["n"] == len(x) and abs(r["mae"] - maes[best]) < 1e-9
        assert abs(r["beta"] - betas[best]) < 1e-12 and abs(r["alpha"] - alphas[best]) < 1e-9


def test_calibration_reads_lines_once(spark, monkeypatch):
    scan, read = base.scan, []
    monkeypatch.setattr(base, "scan", lambda spark, d, name, *more: (read.append(name), scan(spark, d, name, *more))[1])
    assert models.m12_power_calibration(spark, "/root/testdata/sf0.001").count() > 0
    assert read.count("lineitem") == 1


def test_equal_ranks_share_their_powers():
    import pandas as pd

    batch = pd.DataFrame({"g": "a", "t": [1, 1, 1, 2], "r": [2.0, 4.0, 2.0, 2.0], "y": [1.0, -0.0, 3.0, 4.0]})
    got = [(g, int(t), y.ravel().tolist(), w.ravel().tolist()) for g, t, y, w in calibrate.powers(batch, "g", "t", "r", "y", np.array([1.0]))]
    assert got == [("a", 1, [1.0, 0.0, 3.0], [0.5, 0.25, 0.5]), ("a", 2, [4.0], [0.5])]
