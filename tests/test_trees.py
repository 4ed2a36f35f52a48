"""Trees, forests and boosting against growers that try every cut on every row."""

import numpy as np
import pandas as pd
import pytest

from panelwright.operators import cells, growing, trees
from panelwright.operators.folds import expanding_folds


def rows_of(seed, n=400, k=3, bins=8):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, bins, (n, k))
    return x, x[:, 0] * 1.5 - (x[:, 1] > 3) * 4 + rng.normal(size=n)


def sse(y):
    return float(((y - y.mean()) ** 2).sum()) if len(y) else 0.0


def slow_cut(x, y, bins, leaf):
    """The cut that saves the most, the first feature and cut on ties."""
    best = (1e-9, None, None)
    for f in range(x.shape[1]):
        for c in range(bins - 1):
            side = x[:, f] > c
            if min(side.sum(), (~side).sum()) >= max(1, leaf):
                saved = sse(y) - sse(y[side]) - sse(y[~side])
                if saved > best[0] + 1e-9:
                    best = (saved, f, c)
    return best


def slow_tree(x, y, bins, depth, leaf):
    """Nested tuples (n, mean, feature, cut, low, high); None for no split."""
    saved, f, c = slow_cut(x, y, bins, leaf) if depth else (0, None, None)
    if f is None:
        return (len(y), y.mean(), sse(y), None, None, None, None)
    side = x[:, f] > c
    return (len(y), y.mean(), sse(y), f, c, slow_tree(x[~side], y[~side], bins, depth - 1, leaf), slow_tree(x[side], y[side], bins, depth - 1, leaf))


def slow_pruned(t, alpha, n):
    """The smallest subtree with the least error and alpha a leaf: best of a leaf and of both pruned children."""
    if t[3] is None:
        return t, t[2] / n + alpha
    (low, a), (high, b) = slow_pruned(t[5], alpha, n), slow_pruned(t[6], alpha, n)
    alone = t[2] / n + alpha
    return ((*t[:3], None, None, None, None), alone) if alone <= a + b + 1e-12 else ((*t[:5], low, high), a + b)


def slow_predict(t, row):
    while t[3] is not None:
        t = t[6] if row[t[3]] > t[4] else t[5]
    return t[1]


def predict(tree, ends, x):
    return tree.value[tree.reached(x, ends)]


@pytest.mark.parametrize("seed,depth,leaf", [(1, 2, 5), (2, 3, 20), (3, 5, 10), (4, 5, 40)])
def test_tree_equals_all_cuts(seed, depth, leaf):
    x, y = rows_of(seed)
    tree = growing.level_wise(x, np.ones(len(y)), y, 8, 5, leaf, 3, 0)
    slow = slow_tree(x, y, 8, depth, leaf)
    assert np.allclose(predict(tree, tree.leaves_at(depth), x), [slow_predict(slow, r) for r in x])
    for alpha in (0.005, 0.05, 0.3, 100.0):
        small, _ = slow_pruned(slow, alpha, len(y))
        ends = tree.pruned(tree.leaves_at(depth), alpha)
        assert np.allclose(predict(tree, ends, x), [slow_predict(small, r) for r in x])
    assert tree.n_leaves(tree.pruned(tree.leaves_at(depth), 1e9)) == 1


def test_cells_give_the_tree_of_rows():
    """Points are sums of rows in a cell: the same tree as a row a point."""
    x, y = rows_of(5, 3000)
    frame = pd.DataFrame(x).assign(y=y).groupby([0, 1, 2]).y.agg(["size", "sum"]).reset_index()
    a = growing.level_wise(x, np.ones(len(y)), y, 8, 5, 10, 3, 0)
    b = growing.level_wise(frame[[0, 1, 2]].to_numpy(), frame["size"].to_numpy(float), frame["sum"].to_numpy(), 8, 5, 10, 3, 0)
    assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)


def test_feature_subsets_are_by_node_and_repeat():
    x, y = rows_of(6, 2000)
    grow = lambda seed: growing.level_wise(x, np.ones(len(y)), y, 8, 6, 5, 1, seed)
    a, b = grow(7), grow(7)
    assert (a.feature == b.feature).all() and (a.cut == b.cut).all()
    assert len({tuple(grow(s).feature[:3]) for s in range(20)}) > 3  # other seeds look at other features
    only = growing.level_wise(np.c_[x[:, :1] * 0, x[:, 1:2] * 0, x[:, 2:] * 0 + (x[:, :1] > 3)], np.ones(len(y)), y, 8, 1, 5, 1, 0)
    assert only.feature[0] == 2  # where the drawn feature can't be cut, the others are looked at


def slow_boosting(x, y, bins, rate, most, leaf, loss, rounds, penalty=1.0):
    """Row by row, every leaf and cut tried at every step."""
    middle = lambda v: np.sort(v)[int(np.ceil(len(v) / 2)) - 1]
    out = np.full(len(y), y.mean() if loss == "squared" else middle(y))
    score = lambda g: g.sum() ** 2 / (len(g) + penalty)
    for _ in range(rounds):
        g = out - y if loss == "squared" else np.sign(out - y)
        leaves = [np.arange(len(y))]
        while len(leaves) < most:
            best = (1e-9, None)
            for i, at in enumerate(leaves):
                for f in range(x.shape[1]):
                    for c in range(bins - 1):
                        side = x[at, f] > c
                        if min(side.sum(), (~side).sum()) >= leaf:
                            saved = score(g[at[side]]) + score(g[at[~side]]) - score(g[at])
                            if saved > best[0] + 1e-9:
                                best = (saved, i, side)
            if best[1] is None:
                break
            _, i, side = best
            leaves[i], more = leaves[i][~side], leaves[i][side]
            leaves.append(more)
        step = [(-g[at].sum() / (len(at) + penalty)) if loss == "squared" else middle((y - out)[at]) for at in leaves]
        for at, v in zip(leaves, step, strict=True):
            out[at] += rate * v
    return out


@pytest.mark.parametrize("loss", ["squared", "absolute"])
def test_boosting_equals_all_cuts(loss):
    x, y = rows_of(8, 150)
    got = growing.boosted(x, np.ones(len(y)), y, x, 8, 0.12, 7, 10, loss, [2, 4])
    for rounds, (mine, theirs) in zip((2, 4), got, strict=True):
        assert np.allclose(mine, slow_boosting(x, y, 8, 0.12, 7, 10, loss, rounds)) and np.allclose(mine, theirs)


@pytest.mark.parametrize("loss", ["squared", "absolute"])
def test_training_error_falls(loss):
    x, y = rows_of(9, 600)
    error = (lambda p: ((p - y) ** 2).mean()) if loss == "squared" else lambda p: np.abs(p - y).mean()
    steps = growing.boosted(x, np.ones(len(y)), y, x[:0], 8, 0.07, 15, 10, loss, list(range(1, 61)))
    errors = [error(mine) for mine, _ in steps]
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:], strict=False)) and errors[-1] < 0.8 * errors[0]


def test_grids_and_structures():
    assert [len(trees.GRIDS[k]) for k in ("tree", "forest", "boosting")] == [64, 36, 48]
    assert [len(trees.structures(k, trees.GRIDS[k])) for k in ("tree", "forest", "boosting")] == [8, 12, 24]


def test_forest_is_a_mean_of_bagged_trees():
    x, y = rows_of(10, 300)
    n = np.ones(len(y))
    settings = [{"depth": d, "leaf": 5, "features": 0.5, "rate": 0.75} for d in (2, None)]
    run = lambda: trees.fitted("forest", settings, x, n, y, x, 8, 3, 7)
    got, again = run(), run()
    assert all((a[1] == b[1]).all() for a, b in zip(got, again, strict=True))
    bags = [trees.drawn(3, t, 0.75, n) for t in range(7)]
    each = []
    for t, w in enumerate(bags):
        rows = np.repeat(np.arange(len(y)), w.astype(int))
        tree = growing.level_wise(x[rows], np.ones(len(rows)), y[rows], 8, None, 5, 1, 3 + t)
        each.append(predict(tree, tree.leaves_at(None), x))
    assert np.allclose(np.mean(each, axis=0), got[1][1])
    assert abs(np.mean(bags) - 0.75) < 0.1


PERIODS = range(2000, 2008)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = []
    for segment, size in (("A", 40), ("B", 30)):
        for period in PERIODS:
            for i in range(size):
                a, b = rng.normal(), rng.normal()
                rows.append((segment, period, i, float(a), None if i % 9 == 0 else float(b), float(2 * a + (b > 0) + rng.normal() / 2), float(2 * a)))
    return spark.createDataFrame(rows, "segment string, period long, entity long, a double, b double, actual double, base double")


def slow_nested(panel, grid, base=None, cap=0.75):
    """Every setting of every fold on its rows, with the same edges."""
    frame, goal = panel.toPandas(), "actual"
    frame["goal"] = frame[goal] - (frame.base if base else 0)
    cuts = {r["segment"]: r["edges"] for r in cells.edges(panel, ["segment"], "period", ["a", "b"], "actual", expanding_folds(panel, "period", "segment", 50)).collect()}
    out = {}
    for segment, rows in frame.groupby("segment"):
        x = np.stack([[sum(e < (v if v == v else c[len(c) // 2]) for e in c) for v in rows[f]] for f, c in zip(("a", "b"), cuts[segment], strict=True)], axis=1)
        bins, first = cells.bins_of(2), [p for p in PERIODS if (rows.period < p).sum() >= 50]
        error = {}
        for fold in first:
            train, valid = (rows.period < fold).to_numpy(), (rows.period == fold).to_numpy()
            for i, s in enumerate(grid):
                t, _ = slow_pruned(slow_tree(x[train], rows.goal.to_numpy()[train], bins, s["depth"], s["leaf"]), s["alpha"], train.sum())
                p = np.array([slow_predict(t, r) for r in x[valid]])
                p = rows.base.to_numpy()[valid] + np.clip(p, -cap, cap) if base else p
                error[fold, i] = np.abs(rows.actual.to_numpy()[valid] - p).mean()
        for fold in first:
            inner = [p for p in first if p < fold][-5:]
            if len(inner) >= 3:
                mean = {i: round(np.mean([error[p, i] for p in inner]), 9) for i in range(len(grid))}
                best = min(mean, key=lambda i: (mean[i], trees.SIMPLE["tree"](grid[i]), i))
                out[segment, fold] = (best, mean[best], error[fold, best])
    return out


@pytest.mark.parametrize("base", [None, "base"])
def test_nested_choice_equals_brute_force(panel, base):
    grid = [{"depth": d, "leaf": m, "features": 1.0, "alpha": a} for d in (1, 2) for m in (5, 20) for a in (0.0, 0.02)]
    table, rows = trees.nested(panel, "segment", "period", ["a", "b"], "actual", "tree", grid, base)
    got = {(r["segment"], r["fold"]): (r["setting"], round(r["inner_mae"], 9), r["mae"]) for r in table.collect()}
    want = slow_nested(panel, grid, base)
    assert got.keys() == want.keys() and len(want) == 6
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-7)
    said = rows.toPandas()
    assert len(said) == 3 * 70 and (np.abs(said.predicted - said.base) <= 0.75 + 1e-9).all() == bool(base)


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_other_families_run_nested_and_repeat(panel, kind):
    grid = trees.FOREST_GRID[:4] if kind == "forest" else [s | {"rounds": r} for s in trees.BOOSTING_GRID[:2] for r in (5, 10)]
    run = lambda: trees.nested(panel, "segment", "period", ["a", "b"], "actual", kind, grid, n_trees=6, final_trees=9)[0].orderBy("segment", "fold").drop("n").collect()
    first = run()
    assert first == run() and len(first) == 6
    assert all(r["mae"] < 1.6 and r["train_mae"] < r["mae"] + 0.5 for r in first)


def test_shuffles_are_permutations(panel):
    rows = panel.selectExpr("segment", "period as fold", "entity", "cast(entity % 7 + 10 * (entity % 5) as long) x")
    out = trees.permuted(rows, ["segment", "fold"], ["entity"], ["a", "b"], 5, 10).toPandas()
    before = rows.toPandas()
    assert len(out) == 10 * len(before)
    moved = 0
    for (segment, fold, feature, _), g in out.groupby(["segment", "fold", "feature", "repeat"]):
        own = before[(before.segment == segment) & (before.fold == fold)].set_index("entity").x
        unit, other = (1, 10) if feature == "a" else (10, 1)
        assert sorted(g.x // unit % 10) == sorted(own // unit % 10)
        assert (g.set_index("entity").x // other % 10 == own // other % 10).all()
        moved += (g.set_index("entity").x != own).sum()
    assert moved > 0.6 * len(out)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_places_are_a_bijection(n):
    f = trees.shuffled_place.func
    places = pd.Series(range(n))
    one = f(places, pd.Series([n] * n), pd.Series([5] * n))
    assert sorted(one) == list(range(n))
    assert n < 17 or (one != f(places, pd.Series([n] * n), pd.Series([6] * n))).any()


def test_importance_of_what_matters(panel):
    table, _ = trees.nested(panel, "segment", "period", ["a", "b"], "actual", "tree", trees.TREE_GRID[:4])
    out = trees.importance(panel, "segment", "period", ["entity"], ["a", "b"], "actual", "tree", table.select("segment", "fold", "setting"), grid=trees.TREE_GRID[:4], n_trees=1).toPandas()
    assert len(out) == 6 * 2 * 5
    assert out[out.feature == "a"].rise.min() > 0.3 and abs(out[out.feature == "b"].rise).max() < 0.3


def test_final_models(panel):
    table, _ = trees.nested(panel, "segment", "period", ["a", "b"], "actual", "tree", trees.TREE_GRID[:4])
    nodes = trees.final_models(panel, "segment", "period", ["a", "b"], "actual", table).toPandas()
    for segment, own in nodes.groupby("segment"):
        frame = panel.filter(f"segment = '{segment}'").toPandas()
        root = own[own.node == 0].iloc[0]
        assert root.n == len(frame) and root.value == pytest.approx(frame.actual.mean())
        below = own[own.node == root.below].iloc[0]
        assert root.feature == "a" and below.n == (frame.a <= root.threshold).sum()


@pytest.mark.parametrize("kind", ["tree", "forest"])
def test_trees_grow_from_sums_by_cell(monkeypatch, kind):
    """However many periods and targets a cell has, a tree sees it once, and says the same as from all points."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 3, (4000, 2))
    n = rng.integers(1, 9, 4000).astype(float)
    s = n * (x[:, 0] + rng.normal(size=4000))
    seen, grow = [], growing.level_wise
    monkeypatch.setattr(trees.G, "level_wise", lambda x, *rest: seen.append(len(x)) or grow(x, *rest))
    setting = {"depth": 4, "leaf": 5, "features": 1.0, "alpha": 0.0, "rate": 0.75}
    mine, others, depth, leaves = trees.fitted(kind, [setting], x, n, s, x, 3, 3, 5)[0]
    assert max(seen) <= 9 and len(mine) == 4000 and np.allclose(mine, others)
    bags = [n] if kind == "tree" else [trees.drawn(3, t, 0.75, n) for t in range(5)]
    want = 0.0
    for t, w in enumerate(bags):
        tree = grow(x[w > 0], w[w > 0], (s / n * w)[w > 0], 3, 4, 5, 2, 3 + t)
        want = want + tree.value[tree.reached(x, tree.leaves_at(4))] / len(bags)
    assert np.allclose(mine, want)
