"""What SQL can't say of the models: brute force in numpy and pandas on the smallest tables."""

import numpy as np
import pytest
from panelwright.operators import contracts, logistic
from panelwright.plans import models, registry
from panelwright.sources import tables

DIR = "/root/testdata/sf0.01"


def newton(x, y, rounds=40):
    n, pos = len(y), y.sum()
    w = np.where(y > 0, n / 2 / pos, n / 2 / (n - pos))
    a = np.column_stack([np.ones(n), x])
    beta, ridge = np.zeros(a.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a @ beta))
        beta = beta + np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + ridge, a.T @ (w * (y - p)) - ridge @ beta)
    return beta


def test_crossfit_equals_newton_and_sees_the_past_only(spark):
    rng = np.random.default_rng(0)
    rows = [("s", t, float(a), float(b) if i % 7 else None, int(rng.random() < 1 / (1 + np.exp(-a)))) for t in range(4) for i, (a, b) in enumerate(rng.normal(size=(60, 2)) * [1, 3])]
    df = spark.createDataFrame(rows, "seg string, t int, a double, b double, y int")
    got = logistic.crossfit(df, ["seg"], "t", ["a", "b"], "y", rounds=20).toPandas()
    assert got[got.t < 2].probability.isna().all() and got[got.t >= 2].probability.notna().all()
    data = df.toPandas()
    for fold in (2, 3):
        past, now = data[data.t < fold], got[got.t == fold]
        med = past.b.median()
        x = np.column_stack([past.a, past.b.fillna(med)])
        z = np.column_stack([now.a, now.b.fillna(med)])
        beta = newton((x - x.mean(0)) / x.std(0), past.y.to_numpy())
        want = 1 / (1 + np.exp(-(beta[0] + (z - x.mean(0)) / x.std(0) @ beta[1:])))
        assert np.allclose(now.probability, want, atol=1e-6)
    assert logistic.crossfit(df.withColumn("y", df.y * 0), ["seg"], "t", ["a"], "y").toPandas().probability.isna().all()


def test_nested_choice_is_the_best_on_inner_folds(spark):
    scores = models.scores(spark, DIR).toPandas()
    chosen = registry.QUERIES["m8_nested_specs"](spark, DIR).toPandas()
    assert len(chosen) == 30
    for r in chosen.itertuples():
        inner = sorted(scores[(scores.segment == r.segment) & (scores.fold < r.fold)].fold.unique())[-5:]
        past = scores[(scores.segment == r.segment) & (scores.spec == r.spec) & scores.fold.isin(inner)].groupby(["method", "alpha", "l1"]).mae.mean()
        assert len(inner) >= 3 and abs(past.min() - r.inner_mae) < 1e-9
        own = scores[(scores.segment == r.segment) & (scores.spec == r.spec) & (scores.fold == r.fold) & (scores.method == r.method) & (scores.alpha == r.alpha) & (scores.l1 == r.l1)]
        assert abs(own.mae.iloc[0] - r.mae) < 1e-9
    best = registry.QUERIES["m9_adaptive_choice"](spark, DIR).toPandas()
    for r in best.itertuples():
        assert abs(chosen[(chosen.segment == r.segment) & (chosen.fold == r.fold)].inner_mae.min() - r.inner_mae) < 1e-9


def test_row_bootstrap_is_near_the_normal_interval(spark):
    from panelwright.operators.evaluate import row_bootstrap

    values = np.random.default_rng(1).normal(3, 2, 400)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "g string, k long, v double")
    r = row_bootstrap(df, ["g"], "k", "v", 1000).first()
    half = 1.96 * values.std() / 20
    assert abs(r["low"] - values.mean() + half) < 0.06 and abs(r["high"] - values.mean() - half) < 0.06


def proximal(x, y, alpha, l1, rounds=20_000):
    """Elastic net by accelerated proximal gradient on the rows' own products, not by coordinates."""
    n = len(y)
    g, c = x.T @ x / n, x.T @ y / n
    step = 1 / (np.linalg.eigvalsh(g)[-1] + alpha * (1 - l1))
    w = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(rounds):
        v = z - step * (g @ z - c + alpha * (1 - l1) * z)
        new = np.sign(v) * np.maximum(np.abs(v) - step * alpha * l1, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, t, moved = new + (t - 1) / t_new * (new - w), t_new, np.abs(new - w).max()
        w = new
        if moved < 1e-13:
            break
    return w


def test_grids_and_ablation_equal_fits_on_rows(spark):
    """Errors of least squares, every ridge and every net, from the rows of two segments' folds."""
    from panelwright.plans.base import predictions

    data = predictions(spark, DIR).toPandas()
    grid = registry.QUERIES["m6_linear_grids"](spark, DIR).toPandas()
    ablation = registry.QUERIES["m10_ablation"](spark, DIR).toPandas()
    seen = 0
    for segment, fold in (("AUTOMOBILE", 1998), ("BUILDING", 2001)):
        own = data[data.segment == segment]
        past, now = own[own.period < fold], own[own.period == fold]
        for spec, at in models.SPECS.items():
            names = [models.FEATURES[i] for i in at]
            x, v = past[names].to_numpy(float), now[names].to_numpy(float)
            z, u, y = (x - x.mean(0)) / x.std(0), (v - x.mean(0)) / x.std(0), past.actual.to_numpy()
            mae = lambda w: np.abs(y.mean() + u @ w - now.actual.to_numpy()).mean()  # noqa: B023, E731
            fit = {
                "ols": lambda r: np.linalg.lstsq(z, y - y.mean(), rcond=None)[0],  # noqa: B023
                "ridge": lambda r: np.linalg.solve(z.T @ z + r.alpha * np.eye(len(at)), z.T @ (y - y.mean())),  # noqa: B023
                "net": lambda r: proximal(z, y - y.mean(), r.alpha, r.l1),  # noqa: B023
            }
            rows = grid if spec == "full" else ablation[ablation.spec == spec].assign(method="ridge", l1=0.0)
            for r in rows[(rows.segment == segment) & (rows.fold == fold)].itertuples():
                assert mae(fit[r.method](r)) == pytest.approx(r.mae, rel=1e-6)
                assert r.n == len(now)
                seen += 1
    assert seen == 2 * (1 + 6 + 25 + 6 + 6)
    full = grid[grid.method == "ridge"].merge(ablation[ablation.spec == "full"], on=["segment", "fold", "alpha"])
    assert len(full) and np.allclose(full.mae_x, full.mae_y)


def test_publish_leaves_the_old_table_where_the_new_one_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.publish(spark.range(3), path, ["id"])
    with pytest.raises(contracts.ContractError):
        tables.publish(spark.range(3).union(spark.range(1)), path, ["id"])
    assert spark.read.parquet(path).count() == 3
    assert tables.publish(spark.range(5), path, ["id"]).count() == 5


def test_contracts_refuse(spark):
    a = spark.createDataFrame([(1, "Ann O'Hara"), (2, "Bob Jr.")], "k int, name string")
    b = spark.createDataFrame([("ann ohara", 5)], "who string, v int")
    assert {(r["k"], r["v"]) for r in contracts.name_join(a, b, "name", "who").collect()} == {(1, 5), (2, None)}
    with pytest.raises(contracts.ContractError):
        contracts.name_join(a, b.union(b), "name", "who")
    with pytest.raises(contracts.ContractError):
        contracts.one_to_one(a, a.filter("k = 1"), ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.assert_inputs(["target"], ["target"])
    gaps = contracts.TableContract({"k": "K", "t": "team"}, segments=("x",), segment_col="name").gaps(a.limit(0)).collect()
    assert {tuple(r) for r in gaps} == {("column", "team"), ("rows", "none"), ("segment", "x")}
