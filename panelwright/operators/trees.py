"""Decision trees, forests and boosting by group and outer fold, over whole grids, and permutation importance.

Rows are summed to cells of bounded size (see cells.py); one small task a group and
structure then fits every fold. Settings that only cut a tree back (depth, pruning) or stop
earlier share one structure. What a fit says of the cells in a fold's own period is
joined with the rows there, once for all settings, so errors are those of all rows.
Settings are chosen on inner folds alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.exprs import clip
from ..sources.scratch import held
from . import cells as C
from . import growing as G
from .folds import chosen_inside, expanding_folds, inner_periods, modal_recent
from .places import running, same_keys

# The grids, in order, and what does not vary.
TREE_GRID = [{"depth": d, "leaf": m, "features": f, "alpha": a} for d, m, f, a in product((2, 3, 4, 5), (5, 10, 20, 40), (1.0, 0.75), (0.0, 0.005))]
FOREST_GRID = [{"depth": d, "leaf": m, "features": f, "rate": r} for d, m, f, r in product((4, 6, None), (5, 10, 20), (0.5, 1.0), (0.75, 1.0))]
BOOSTING_GRID = [{"step": s, "leaves": k, "rounds": r, "leaf": m, "loss": e} for s, k, r, m, e in product((0.03, 0.07, 0.12), (7, 15), (150, 300), (10, 25), ("squared", "absolute"))]
GRIDS: Mapping[str, Sequence[Mapping[str, object]]] = {"tree": TREE_GRID, "forest": FOREST_GRID, "boosting": BOOSTING_GRID}
#: Trees of a forest while settings are compared, and of the one that is kept; the seed of all draws.
TUNING_TREES, FINAL_TREES, SEED = 150, 500, 446
#: Parameters of a setting that only choose among results of one fit.
CUT_BACK = {"tree": ("depth", "alpha"), "forest": ("depth",), "boosting": ("rounds",)}
#: What decides between equal errors: shallower trees, larger leaves; smaller boosted ones.
SIMPLE = {"tree": lambda s: (s["depth"], -s["leaf"]), "forest": lambda s: (-s["leaf"],), "boosting": lambda s: (s["leaves"], s["rounds"])}


def label(setting: Mapping[str, object]) -> str:
    return " ".join(f"{k}={v}" for k, v in setting.items())


def structures(kind: str, grid: Sequence[Mapping[str, object]]) -> list[list[int]]:
    """Places in the grid of the settings that share a fit."""
    groups: dict[tuple, list[int]] = {}
    for i, s in enumerate(grid):
        groups.setdefault(tuple(v for k, v in s.items() if k not in CUT_BACK[kind]), []).append(i)
    return list(groups.values())


def drawn(seed: int, tree: int, rate: float, n: np.ndarray) -> np.ndarray:
    """How often each point is in a tree's bag: Poisson draws of a counter-based generator, the same in every run."""
    return np.random.Generator(np.random.Philox(key=[seed, tree])).poisson(rate * n).astype(float)


def fitted(kind: str, settings: Sequence[Mapping[str, object]], x: np.ndarray, n: np.ndarray, s: np.ndarray, others: np.ndarray, bins: int, seed: int, n_trees: int) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
    """For each of some settings of one structure: predictions for the points and the others, depth and leaves (of all trees; 0 for boosting).

    Trees for squared error need no more than sums by x, so points of one x, whatever their period and target, are added up
    before a tree grows: its cost has the bound of the number of x, and only the draws of bags are made point by point.
    """
    first = settings[0]
    mean = s / n
    if kind != "boosting":
        _, heads, which = np.unique(x @ bins ** np.arange(x.shape[1]), return_index=True, return_inverse=True)
        at = x[heads]
        added = lambda v: np.bincount(which, v, len(at))
    picks = max(1, int(first.get("features", 1.0) * x.shape[1]))
    if kind == "tree":
        tree = G.level_wise(at, added(n), added(s), bins, max(c["depth"] for c in settings), first["leaf"], picks, seed, float(np.sum(mean * s)))
        out = []
        for c in settings:
            ends = tree.pruned(tree.leaves_at(c["depth"]), c["alpha"]) if c["alpha"] else tree.leaves_at(c["depth"])
            mine = tree.reached(at, ends)
            out.append((tree.value[mine][which], tree.value[tree.reached(others, ends)], int(tree.level[mine].max()), tree.n_leaves(ends)))
        return out
    if kind == "forest":
        total = [[np.zeros(len(at)), np.zeros(len(others)), 0, 0] for _ in settings]
        for t in range(n_trees):
            w = drawn(seed, t, first["rate"], n)
            if not w.any():
                w = n
            bag, sums_of_bag = added(w), added(mean * w)
            here = np.flatnonzero(bag)
            tree = G.level_wise(at[here], bag[here], sums_of_bag[here], bins, None if any(c["depth"] is None for c in settings) else max(c["depth"] for c in settings), first["leaf"], picks, seed + t, float(np.sum(mean * mean * w)))
            for c, sums in zip(settings, total, strict=True):
                ends = tree.leaves_at(c["depth"])
                mine = tree.reached(at, ends)
                sums[0] += tree.value[mine] / n_trees
                sums[1] += tree.value[tree.reached(others, ends)] / n_trees
                sums[2], sums[3] = max(sums[2], int(tree.level[mine].max())), sums[3] + tree.n_leaves(ends)
        return [(t[0][which], *t[1:]) for t in total]
    stops = sorted({c["rounds"] for c in settings})
    done = dict(zip(stops, G.boosted(x, n, s, others, bins, first["step"], first["leaves"], first["leaf"], first["loss"], stops), strict=True))
    return [(*done[c["rounds"]], 0, 0) for c in settings]


def unpacked(x: np.ndarray, k: int, bins: int) -> np.ndarray:
    """Bins by feature of cell numbers."""
    return np.stack([x // bins**i % bins for i in range(k)], axis=1)


FIT = "fold bigint, structure int, x bigint, predicted array<double>, depth array<int>, leaves array<int>"


def fits(sums: DataFrame, asked: DataFrame, by: str, period: str, k: int, kind: str, grid: Sequence[Mapping[str, object]], n_trees: int, chosen: DataFrame | None = None) -> DataFrame:
    """by and FIT: for every fold and structure a row a cell x that is asked about (asked has by, fold, x), with each setting's prediction, and one with x null that describes the fits.

    With `chosen` (by, fold, setting) only those settings are fitted: the structure is then the setting's place in the grid.
    A group's cells, whose number has a bound, are fitted by one task. Partitions are numbered, as AQE would join
    many small groups in a task for their bytes, while their work is in the trees.
    """
    shared = structures(kind, grid) if chosen is None else [[i] for i in range(len(grid))]
    bins, shape = C.bins_of(k), f"`{by}` {sums.schema[by].dataType.simpleString()}"
    if chosen is None:
        every = F.explode(F.sequence(F.lit(0), F.lit(len(shared) - 1))).alias("structure")
        left, right = sums.select("*", every), asked.select(by, "fold", "x", every)
    else:
        right = asked.join(chosen.select(by, "fold", F.col("setting").alias("structure")), [by, "fold"])
        left = sums.join(chosen.select(by, F.col("setting").alias("structure")).distinct(), by)

    def fit(key: tuple[pa.Scalar, ...], t: pa.Table, questions: pa.Table) -> pa.Table:
        structure = key[1].as_py()
        settings = [grid[i] for i in shared[structure]]
        t = t.sort_by([(period, "ascending"), ("x", "ascending"), ("y_bin", "ascending")])
        when, codes, n, s = (t[c].to_numpy() for c in (period, "x", "n", "s"))
        x, n, rows = unpacked(codes, k, bins), n.astype(float), []
        seed = SEED + zlib.crc32(str(key[0].as_py()).encode())
        folds, cells = questions["fold"].to_numpy(), questions["x"].to_numpy()
        for fold in np.unique(folds).tolist() if len(t) else ():
            train, there = when < fold, np.unique(cells[folds == fold])
            done = fitted(kind, settings, x[train], n[train], s[train], unpacked(there, k, bins), bins, seed, n_trees)
            rows.append((fold, structure, None, None, [d[2] for d in done], [d[3] for d in done]))
            rows += [(fold, structure, c, p, None, None) for c, p in zip(there.tolist(), np.stack([d[1] for d in done], axis=1).tolist(), strict=True)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        columns = [pa.array([key[0]] * len(rows), key[0].type), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))]
        return pa.table(columns, [by, *(c.split()[0] for c in FIT.split(", "))])

    parts = 2 * len(shared) * asked.select(by).distinct().count()
    left, right = (t.repartition(parts, by, "structure") for t in (left, right))
    return left.groupBy(by, "structure").cogroup(right.groupBy(by, "structure")).applyInArrow(fit, f"{shape}, {FIT}")


def settings_table(df: DataFrame, kind: str, grid: Sequence[Mapping[str, object]]) -> DataFrame:
    """setting (its place in the grid), label and simple, its place in order of simplicity."""
    order = sorted(range(len(grid)), key=lambda i: (SIMPLE[kind](grid[i]), i))
    return df.sparkSession.createDataFrame([(i, label(s), order.index(i)) for i, s in enumerate(grid)], "setting int, label string, simple int")


def by_setting(fits_: DataFrame, keys: Sequence[str], kind: str, grid: Sequence[Mapping[str, object]], column: str) -> DataFrame:
    """keys and an array of the column's values, one a setting in the grid's order, from rows of one structure each."""
    order = [i for group in structures(kind, grid) for i in group]
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("structure", F.col(column).alias("v")))), lambda e: e.v))
    joined = fits_.groupBy(*keys).agg(flat.alias("__flat"))
    return joined.select(*keys, F.array(*(F.get("__flat", F.lit(order.index(i))) for i in range(len(grid)))).alias(column))


def training_errors(placed: DataFrame, said: DataFrame, by: str, target: str, predicted: Column) -> DataFrame:
    """by, fold and train_mae: the error of said (by, fold, x, predicted) on the rows before each fold, by the expression that is given.

    A row meets its cell's predictions of all folds at once; what it says of later folds is summed before any exchange,
    in decimals, so that the sum is the same in any order of rows.
    """
    later = said.groupBy(by, "x").agg(F.collect_list(F.struct(F.col("fold").alias("__later"), "predicted")).alias("__said"))
    each = placed.join(later, [by, "x"]).select("*", F.inline(F.filter("__said", lambda e: e["__later"] > F.col("fold"))))
    error = F.abs(F.col(target) - predicted).cast("decimal(38,18)")
    return each.groupBy(by, F.col("__later").alias("fold")).agg(F.try_divide(F.sum(error).cast("double"), F.count(error)).alias("train_mae"))


def prepared(rows: DataFrame, by: str, period: str, features: Sequence[str], target: str, base: str | None = None, least: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """folds; rows with fold (their period) and x; and their cells. The target is what the base leaves."""
    rows = held(rows.withColumn("__goal", F.col(target).cast("double") - (F.col(base) if base else F.lit(0.0))), "targets")
    folds = held(expanding_folds(rows, period, by, least), "folds")
    placed = held(C.binned(rows, [by], features, C.edges(rows, [by], period, features, "__goal", folds)).withColumn("fold", F.col(period)), "binned")
    return folds, placed.drop("__goal", "target_edges"), held(C.cells(placed, [by], period, "__goal"), "cells")


def nested(rows: DataFrame, by: str, period: str, features: Sequence[str], target: str, kind: str, grid: Sequence[Mapping[str, object]] | None = None, base: str | None = None, cap: float = 0.75, least: int = 50, n_trees: int = TUNING_TREES, final_trees: int = FINAL_TREES, ready: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The setting of every outer fold, chosen by its inner folds' mean errors, and its predictions for the fold's rows.

    First: by, fold, setting, label, inner_mae, mae, n, train_mae (of all rows before the fold), depth,
    leaves and n_distinct predictions. Second: the rows with fold, x and predicted. With `base`, a
    prediction that knows nothing later, the models fit what it leaves and correct it by
    `cap` at most either way. Forests are compared with n_trees, the chosen ones have final_trees.
    `ready` is what `prepared` gives for the same rows, base and least, where several kinds share it.
    """
    grid, keys, k = grid or GRIDS[kind], [by, "fold"], len(features)
    folds, placed, sums = ready or prepared(rows, by, period, features, target, base, least)
    valid = placed.join(folds.select(*keys), keys)
    asked = held(valid.select(*keys, "x").distinct(), "asked")
    said = held(fits(sums, asked, by, period, k, kind, grid, n_trees), "fits")
    full = lambda p: F.col(base) + clip(p, -cap, cap) if base else p
    p = by_setting(said.filter("x is not null"), [*keys, "x"], kind, grid, "predicted")
    error = lambda i: F.avg(F.abs(F.col(target) - full(F.get("predicted", F.lit(i)))))
    scored = valid.join(p, [*keys, "x"]).groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(error(i) for i in range(len(grid)))).alias("maes"))
    scores = held(scored.select(*keys, "n", F.posexplode("maes").alias("setting", "mae")).join(F.broadcast(settings_table(rows, kind, grid)), "setting"), "scores")  # a row a setting
    best = held(chosen_inside(scores, inner_periods(folds, by), [by], ["setting", "label", "simple"], [F.col("simple")]).select(*keys, "setting", "label", "inner_mae"), "chosen")
    before = sums.join(best.select(*keys), by).filter(F.col(period) < F.col("fold")).select(*keys, "x").distinct()
    said = held(fits(sums, asked.union(before).distinct(), by, period, k, kind, grid, final_trees, best), "final-fits")
    of = lambda c: F.get(c, F.lit(0)).alias(c)
    p = said.filter("x is not null").select(*keys, F.col("structure").alias("setting"), "x", of("predicted"))
    facts = training_errors(placed, p, by, target, full(F.col("predicted"))).join(said.filter("x is null").select(*keys, F.col("structure").alias("setting"), *map(of, ("depth", "leaves"))), keys)
    predicted = held(valid.join(p, [*keys, "x"]).withColumn("predicted", full(F.col("predicted"))), "predicted")
    done = predicted.groupBy(*keys, "setting").agg(F.count("*").alias("n"), F.avg(F.abs(F.col(target) - F.col("predicted"))).alias("mae"), F.count_distinct("predicted").alias("n_distinct"))
    return best.join(done, [*keys, "setting"]).join(facts, [*keys, "setting"]), predicted


@F.pandas_udf(LongType())
def shuffled_place(place: pd.Series, size: pd.Series, seed: pd.Series) -> pd.Series:
    """Where a seeded bijection of 0 to size - 1 takes a place: a Feistel network on the next power of two, walked on until it is inside."""
    v, n, key = place.to_numpy(np.uint64), size.to_numpy(np.uint64), seed.to_numpy(np.int64).view(np.uint64)
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.uint64))
    low, one = bits // np.uint64(2), np.uint64(1)
    high = bits - low
    out, open_ = v.copy(), np.arange(len(v))
    with np.errstate(over="ignore"):
        while len(open_):
            a, b, wide, narrow = out[open_] >> low[open_], out[open_] & ((one << low[open_]) - one), high[open_], low[open_]
            for turn in range(4):  # halves change places, so that each is mixed into the other twice
                f = G.scrambled(G.scrambled(b + key[open_]) + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15))
                a, b = b, a ^ (f & ((one << wide) - one))
                wide, narrow = narrow, wide
            out[open_] = a << low[open_] | b
            open_ = open_[out[open_] >= n[open_]]
    return pd.Series(out.astype(np.int64))


def permuted(rows: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], repeats: int, bins: int, seed: int = SEED) -> DataFrame:
    """rows once for every feature and repeat, their x with that feature's bin of another row of their group: each repeat is a permutation of the group.

    Places come from ranges of the order, not from a sort by group; the order has to tell a group's rows apart.
    """
    placed = running(rows.withColumn("__one", F.lit(1)), list(keys), list(order), "__one", "__upto").withColumn("__place", F.col("__upto") - 1).drop("__one", "__upto")
    placed = held(same_keys(placed, placed.groupBy(*keys).agg(F.count("*").alias("__size")), keys), "places")
    tries = [(i, f, r) for i, f in enumerate(features) for r in range(repeats)]
    spread = placed.withColumn("__t", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), F.lit(bins**i).alias("unit")) for i, f, r in tries))))
    at = shuffled_place("__place", "__size", F.xxhash64(F.lit(seed), *keys, "__t.feature", "__t.repeat"))
    spread = spread.select(*rows.columns, F.col("__t.feature").alias("feature"), F.col("__t.repeat").alias("repeat"), F.col("__t.unit").cast("long").alias("__unit"), at.alias("__place"))
    donors = placed.select(*keys, "__place", F.col("x").alias("__other"))
    both = same_keys(spread, donors, [*keys, "__place"])
    bin_at = lambda x: F.expr(f"{x} div __unit") % bins
    return both.withColumn("x", F.col("x") + (bin_at("__other") - bin_at("x")) * F.col("__unit")).drop("__unit", "__place", "__other")


def importance(rows: DataFrame, by: str, period: str, order: Sequence[str], features: Sequence[str], target: str, kind: str, chosen: DataFrame, repeats: int = 5, grid: Sequence[Mapping[str, object]] | None = None, n_trees: int = FINAL_TREES, least: int = 50) -> DataFrame:
    """by, fold, feature, repeat, n, mae and rise: what shuffling a feature among a fold's rows adds to the error of the fold's chosen setting (by, fold, setting)."""
    grid, keys = grid or GRIDS[kind], [by, "fold"]
    _, placed, sums = prepared(rows, by, period, features, target, None, least)
    valid = placed.join(chosen.select(*keys), keys)
    tries = held(permuted(valid, keys, order, features, repeats, C.bins_of(len(features))), "tries")
    asked = tries.select(*keys, "x").union(valid.select(*keys, "x")).distinct()
    said = fits(sums, asked, by, period, len(features), kind, grid, n_trees, chosen).filter("x is not null")
    said = held(said.select(*keys, "x", F.get("predicted", F.lit(0)).alias("predicted")), "said")
    error = F.avg(F.abs(F.col(target) - F.col("predicted")))
    base = valid.join(said, [*keys, "x"]).groupBy(*keys).agg(error.alias("__base"))
    done = tries.join(said, [*keys, "x"]).groupBy(*keys, "feature", "repeat").agg(F.count("*").alias("n"), error.alias("mae"))
    return done.join(base, keys).withColumn("rise", F.col("mae") - F.col("__base")).drop("__base")


def final_models(rows: DataFrame, by: str, period: str, features: Sequence[str], target: str, chosen: DataFrame, least: int = 50) -> DataFrame:
    """The nodes of a decision tree a group, fitted on all periods with the setting that the last folds chose most often.

    chosen has by, fold and setting. Returns by, label, node, feature and threshold of its split (null in a
    leaf; values up to the threshold go to node `below`, others to `below` + 1), n and value.
    """
    setting = modal_recent(chosen.select(by, "fold", "setting"), [by], "fold", ["setting"]).select(by, F.col("setting").alias("structure"))
    cuts = held(C.edges(rows, [by], period, features, target, expanding_folds(rows, period, by, least)), "edges")
    sums = C.cells(C.binned(rows, [by], features, cuts), [by], period, target).groupBy(by, "x").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k, bins, shape = len(features), C.bins_of(len(features)), f"`{by}` {rows.schema[by].dataType.simpleString()}"

    def fit(key: tuple[pa.Scalar, ...], t: pa.Table, about: pa.Table) -> pa.Table:
        rows = []
        if len(t) and len(about):
            t, c, edges = t.sort_by("x"), TREE_GRID[about["structure"][0].as_py()], about["edges"][0].as_py()
            tree = G.level_wise(unpacked(t["x"].to_numpy(), k, bins), t["n"].to_numpy().astype(float), t["s"].to_numpy(), bins, c["depth"], c["leaf"], max(1, int(c["features"] * k)), SEED + zlib.crc32(str(key[0].as_py()).encode()))
            ends, seen = tree.pruned(tree.leaves_at(c["depth"]), c["alpha"]), [0]
            for i in seen:
                f, a = int(tree.feature[i]), int(tree.left[i])
                split = (features[f], edges[f][int(tree.cut[i])], a) if not ends[i] else (None, None, None)
                seen += [] if ends[i] else [a, a + 1]
                rows.append((label(c), i, *split, int(tree.n[i]), float(tree.value[i])))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array([key[0]] * len(rows), key[0].type), *(pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds))], [by, "label", "node", "feature", "threshold", "below", "n", "value"])

    about = setting.join(cuts.select(by, "edges"), by)  # a row a group
    return sums.groupBy(by).cogroup(about.groupBy(by)).applyInArrow(fit, f"{shape}, label string, node bigint, feature string, threshold double, below bigint, n bigint, value double")
