"""The table of complexity: every family's whole grid, and training errors of rows."""

import inspect

import numpy as np
import pytest
from panelwright.operators import cells, trees
from panelwright.operators.folds import expanding_folds
from panelwright.plans import models, registry
from test_trees import slow_boosting, slow_predict, slow_pruned, slow_tree

DIR = "/root/testdata/sf0.001"


def test_no_family_is_cut(spark, monkeypatch):
    """All settings, trees and rounds are compared, as in the queries of one family."""
    asked, signature = {}, inspect.signature(trees.nested)

    def nested(*args, **options):
        call = signature.bind(*args, **options)
        call.apply_defaults()
        of = call.arguments
        asked[of["kind"]] = (list(of["grid"] or trees.GRIDS[of["kind"]]), of["n_trees"], of["final_trees"])
        return spark.range(1).selectExpr(*(f"1.0D as {c}" for c in models.CHOSEN)), None

    monkeypatch.setattr(trees, "nested", nested)
    out = registry.QUERIES["e25_complexity"](spark, DIR)
    assert sorted(r["family"] for r in out.collect()) == ["boosting", "forest", "tree"]
    assert asked == {kind: (grid, 150, 500) for kind, grid in trees.GRIDS.items()}
    assert [len(asked[kind][0]) for kind in ("tree", "forest", "boosting")] == [64, 36, 48]
    assert max(s["rounds"] for s in asked["boosting"][0]) == 300


def test_families_agree_with_their_own_queries(spark, monkeypatch):
    """With grids of few settings, taken from the end: one table says of each family what its query says."""
    grids = {kind: grid[-2:] for kind, grid in trees.GRIDS.items()}
    monkeypatch.setattr(trees, "GRIDS", grids)
    own = {"tree": registry.QUERIES["m24_tree"](spark, DIR).filter("form = 'direct'"), "forest": registry.QUERIES["m25_forest"](spark, DIR), "boosting": registry.QUERIES["m26_boosting"](spark, DIR)}
    row = lambda r: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in models.CHOSEN)
    want = {(kind, *row(r)) for kind, df in own.items() for r in df.collect()}
    got = registry.QUERIES["e25_complexity"](spark, DIR).collect()
    assert len(got) == len(want) > 0 and {r["label"] for r in got} <= {trees.label(s) for grid in grids.values() for s in grid}
    assert {(r["family"], *row(r)) for r in got} == want
    assert all(r["ratio"] == pytest.approx(r["mae"] / r["train_mae"]) for r in got)


@pytest.mark.parametrize("base", [None, "base"])
@pytest.mark.parametrize("kind,setting", [("tree", {"depth": 3, "leaf": 5, "features": 1.0, "alpha": 0.01}), ("boosting", {"step": 0.12, "leaves": 4, "rounds": 3, "leaf": 10, "loss": "squared"})])
def test_training_errors_are_of_rows(spark, kind, setting, base):
    """A model of one setting by fold, and its error on each row before the fold; targets spread in every cell."""
    rng = np.random.default_rng(12)
    rows = [("A", period, a, b, float(2 * a + 3 * rng.normal()), 2 * a) for period in range(2000, 2006) for a, b in np.round(rng.normal(size=(120, 2))).tolist()]
    df, names, cap = spark.createDataFrame(rows, "segment string, period long, a double, b double, actual double, base double"), ["a", "b"], 0.75
    got = {r["fold"]: r for r in trees.nested(df, "segment", "period", names, "actual", kind, [setting], base, cap)[0].collect()}
    frame, cuts = df.toPandas(), cells.edges(df, ["segment"], "period", names, "actual", expanding_folds(df, "period", "segment", 50)).first()["edges"]
    x = np.stack([[sum(e < v for e in c) for v in frame[f]] for f, c in zip(names, cuts, strict=True)], axis=1)
    goal, bins = (frame.actual - (frame.base if base else 0)).to_numpy(), cells.bins_of(2)
    assert sorted(got) == [2004, 2005]
    for fold, r in got.items():
        train = (frame.period < fold).to_numpy()
        if kind == "tree":
            tree, _ = slow_pruned(slow_tree(x[train], goal[train], bins, setting["depth"], setting["leaf"]), setting["alpha"], train.sum())
            said = np.array([slow_predict(tree, v) for v in x[train]])
        else:
            said = slow_boosting(x[train], goal[train], bins, setting["step"], setting["leaves"], setting["leaf"], setting["loss"], setting["rounds"])
        full = frame.base.to_numpy()[train] + np.clip(said, -cap, cap) if base else said
        assert r["train_mae"] == pytest.approx(np.abs(frame.actual.to_numpy()[train] - full).mean(), abs=1e-9)
