"""Calibration and bounded corrections, all settings of a grid at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, gate, hinge
from ..sources.scratch import held


#: Bits of an alpha that a pass finds.
STEP_BITS = 6
#: Rows whose powers a task holds at once, so that they stay in a core's cache.
BLOCK = 512
#: Rows of a file at most, about: what a task sorts doesn't grow with the table.
FILE_ROWS = 250_000


def powers(batch: pd.DataFrame, by: str, period: str, rank: str, target: str, betas: np.ndarray) -> Iterator[tuple]:
    """Group, period, target (a column) and rank ** -beta (a column a beta) of a batch's rows, in blocks of one group and period; equal ranks share their powers."""
    for (group, when), at in batch.groupby([by, period]).indices.items():
        r, y = batch[rank].to_numpy(float)[at], batch[target].to_numpy(float)[at] + 0.0  # both zeros are one
        ranks, which = np.unique(r, return_inverse=True)
        each = ranks[:, None] ** -betas
        for i in range(0, len(at), BLOCK):
            yield group, when, y[i : i + BLOCK, None], each[which[i : i + BLOCK]]


def folds_of(state: Mapping[tuple, np.ndarray]) -> dict:
    """(fold, value) by group."""
    out: dict = {}
    for (g, fold), x in state.items():
        out.setdefault(g, []).append((fold, x))
    return out


def grid_sums(rows: DataFrame, by: str, period: str, rank: str, target: str, state: Mapping[tuple, np.ndarray], shift: int, betas: np.ndarray) -> DataFrame:
    """by, fold, place (of beta) and w: the weights of the rows before the fold whose ratio lies in each part of (fold, beta)'s bracket.

    state has the brackets' lower ends, as bits, by (group, fold). Every task adds up its own rows; rows outside of a bracket are only compared.
    """
    parts, lows = 1 << STEP_BITS, folds_of({k: low >> shift for k, low in state.items()})
    start = np.arange(len(betas)) * parts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for group, when, y, w in powers(batch, by, period, rank, target, betas):
                bits = (y / w).view(np.int64) >> shift
                for fold, low in lows.get(group, ()):
                    if when < fold:
                        at = bits - low
                        inside = np.flatnonzero(at.view(np.uint64) < parts)  # those below are large there
                        sums = np.bincount(at.ravel()[inside] + start[inside % len(betas)], w.ravel()[inside], len(betas) * parts)
                        found[group, fold] = found.get((group, fold), 0.0) + sums
        yield pd.DataFrame([(g, f, i, w.tolist()) for (g, f), sums in found.items() for i, w in enumerate(sums.reshape(len(betas), -1))], columns=[by, "fold", "place", "w"])

    each = rows.select(by, period, rank, target).mapInPandas(run, f"`{by}` {rows.schema[by].dataType.simpleString()}, fold long, place int, w array<double>")
    return each.groupBy(by, "fold", "place").agg(F.array(*(F.sum(F.get("w", F.lit(i))) for i in range(parts))).alias("w"))


def power_calibration(rows: DataFrame, by: str, period: str, rank: str, target: str, folds: DataFrame, least: int = 20) -> DataFrame:
    """alpha, beta, mae and n of alpha * rank ** -beta with the least absolute error over the rows before each fold (by, fold).

    For each beta alpha is the weighted median of target * rank ** beta with weights rank ** -beta;
    the first beta of the smallest error wins. Folds with fewer than `least` usable rows (rank > 0,
    target >= 0) have none.

    The medians of all folds and exponents are found together, STEP_BITS bits of the ratio a
    pass: tasks add up the weights in each part of every bracket, and the part that holds the
    median is the next bracket. No row is repeated; a row a fold and exponent comes to the driver.
    Rows are written once, in as many files as keep every core busy, and sorted in these, so that
    a batch has few groups and ranks; ranges that end within equal ranks split a hot one.
    """
    betas = np.array([0.05 + i * ((1.50 - 0.05) / 145) for i in range(146)])
    usable = rows.filter((F.col(rank) > 0) & (F.col(target) >= 0)).select(by, period, F.col(rank).cast("double").alias(rank), F.col(target).cast("double").alias(target))
    files = max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FILE_ROWS))
    ok = held(usable.repartitionByRange(files, by, period, rank, target).sortWithinPartitions(by, period, rank), "usable")
    sizes = ok.groupBy(by, period).agg(F.count("*").alias("n"))
    counted = folds.select(by, "fold").join(sizes, by).filter(F.col(period) < F.col("fold")).groupBy(by, "fold").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()  # a row a fold
    n = {(r[by], r["fold"]): r["n"] for r in counted}
    low = {k: np.zeros(len(betas), np.int64) for k in n}
    below, total = {k: np.zeros(len(betas)) for k in n}, {}
    shift = 63
    while shift > 0 and n:
        shift = max(0, shift - STEP_BITS)
        for r in grid_sums(ok, by, period, rank, target, low, shift, betas).collect():
            k, i, w = (r[by], r["fold"]), r["place"], np.array(r["w"])
            run = below[k][i] + np.cumsum(w)
            half = total.setdefault((*k, i), run[-1]) / 2  # the first bracket has all rows
            part = min(int(np.searchsorted(run, half)), int(np.flatnonzero(w).max(initial=0)))
            below[k][i] += w[:part].sum()
            low[k][i] += part << shift
    alphas = {k: v.view(float) for k, v in low.items()}
    of_group = folds_of(alphas)

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for group, when, y, w in powers(batch, by, period, rank, target, betas):
                for fold, alpha in of_group.get(group, ()):
                    if when < fold:
                        left = alpha * w
                        left -= y
                        found[group, fold] = found.get((group, fold), 0.0) + np.abs(left, out=left).sum(axis=0)
        yield pd.DataFrame([(*k, v.tolist()) for k, v in found.items()], columns=[by, "fold", "e"])

    kind = rows.schema[by].dataType.simpleString()
    summed = ok.mapInPandas(errors, f"`{by}` {kind}, fold long, e array<double>").groupBy(by, "fold").agg(F.array(*(F.sum(F.get("e", F.lit(i))) for i in range(len(betas)))).alias("e"))
    best = []
    for r in summed.collect():  # a row a fold
        k = (r[by], r["fold"])
        mae = np.array(r["e"]) / n[k]
        i = int(mae.argmin())
        best.append((*k, float(alphas[k][i]), float(betas[i]), float(mae[i]), n[k]))
    return rows.sparkSession.createDataFrame(best, f"`{by}` {kind}, fold long, alpha double, beta double, mae double, n long")


def apply_power(rank: Column | str) -> Column:
    """The calibrated value of a rank, on a row that has alpha and beta."""
    return F.col("alpha") * F.pow(rank, -F.col("beta"))


#: Largest correction of any adjuster, either way.
BOUND = 0.75
# Bounded corrections by name: parameters to a correction from a row's columns, its fold's means and deviations among them.
ADJUSTERS: Mapping[str, Callable[[Mapping[str, float]], Column]] = {
    "count": lambda p: p["p_coef"] * F.try_divide(F.col("count") - F.col("count_mean"), F.nullif(F.col("count_std"), F.lit(0.0))),
    "burden": lambda p: -p["p_penalty"] * hinge("burden", 6.0),
    "share": lambda p: p["p_coef"] * F.try_divide(F.col("share") - F.col("share_mean"), F.nullif(F.col("share_std"), F.lit(0.0))),
    "steps": lambda p: -(p["p_penalty"] * hinge("burden", 2.0) + p["p_penalty_2"] * hinge("burden", 4.0) + p["p_penalty_3"] * hinge("burden", 6.0)),
    "gated": lambda p: hinge("burden", 4.0) * (p["p_up"] * gate("base", 4.0, 4.0) - p["p_low"] * gate(4.0 - F.col("base"), 0.0, 4.0)),
}


def bounded(name: str, setting: Mapping[str, float], bound: float = BOUND) -> Column:
    """A correction under one setting of its parameters."""
    return F.coalesce(clip(ADJUSTERS[name](setting), -bound, bound), F.lit(0.0))


# The adjusters' parameter grids.
SIGNED = (-0.40, -0.25, -0.15, -0.10, -0.05, 0.0, 0.05, 0.10, 0.15, 0.25, 0.40)
PENALTY = (0.0, 0.025, 0.05, 0.10, 0.15, 0.25)
STEPS = (0.0, 0.025, 0.05, 0.10)
SHRINKAGE = (0.0, 0.25, 0.50, 0.75, 1.0)
GRIDS: Mapping[str, Sequence[Mapping[str, float]]] = {
    "count": [{"p_coef": x} for x in SIGNED],
    "burden": [{"p_penalty": x} for x in PENALTY],
    "share": [{"p_coef": x} for x in SIGNED],
    "steps": [{"p_penalty": a, "p_penalty_2": b, "p_penalty_3": c} for a in STEPS for b in STEPS for c in STEPS],
    "gated": [{"p_low": a, "p_up": b} for a in PENALTY for b in PENALTY],
}


#: What each adjuster reads of a row.
READS = ("count", "count_mean", "count_std", "burden", "share", "share_mean", "share_std", "base")


def corrections(name: str, p: Mapping[str, float], x: Mapping[str, np.ndarray], bound: float = BOUND) -> np.ndarray:
    """bounded() of many rows at once; x has READS as doubles, NaN where they are null."""
    above = lambda v, at: np.maximum(v - at, 0.0)
    ramp = lambda v, start, width: np.clip((v - start) / width, 0.0, 1.0)
    if name in ("count", "share"):
        std = x[f"{name}_std"]
        out = p["p_coef"] * ((x[name] - x[f"{name}_mean"]) / np.where(std == 0, np.nan, std))
    elif name == "burden":
        out = -p["p_penalty"] * above(x["burden"], 6.0)
    elif name == "steps":
        out = -(p["p_penalty"] * above(x["burden"], 2.0) + p["p_penalty_2"] * above(x["burden"], 4.0) + p["p_penalty_3"] * above(x["burden"], 6.0))
    else:
        out = above(x["burden"], 4.0) * (p["p_up"] * ramp(x["base"], 4.0, 4.0) - p["p_low"] * ramp(4.0 - x["base"], 0.0, 4.0))
    out = np.clip(out, -bound, bound)
    return np.where(np.isnan(out), 0.0, out)


def read(batch: pd.DataFrame, at=slice(None)) -> dict[str, np.ndarray]:
    return {c: batch[c].to_numpy(float)[at] for c in READS if c in batch}


def grid_errors(rows: DataFrame, keys: Sequence[str], base: str, target: str, grids: Mapping[str, Sequence[Mapping[str, float]]] = GRIDS) -> DataFrame:
    """keys, name, setting (its place in the grid), mae, base_mae and n of base + correction for every setting of every adjuster.

    Rows are read once: a task adds up every setting's errors by key, in numpy, and only these sums are exchanged.
    """
    places = [(name, i, s) for name, grid in grids.items() for i, s in enumerate(grid)]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    cols = [*keys, "__n", "__known", "__sums"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            x, left = read(batch), batch["__left"].to_numpy(float)
            known = ~np.isnan(left)
            errors = [np.abs(left), *(np.abs(left - corrections(name, s, x)) for name, _, s in places)]
            groups = batch.groupby(list(keys), dropna=False, sort=False)
            code, names = groups.ngroup().to_numpy(), list(groups.indices)
            heads = batch[list(keys)].iloc[np.unique(code, return_index=True)[1]].itertuples(index=False, name=None)
            each = np.stack([np.bincount(code[known], e[known], len(names)) for e in errors], axis=1)
            for name, n, k, e in zip(heads, np.bincount(code), np.bincount(code[known], minlength=len(names)), each, strict=True):
                sums = held.setdefault(name, [0, 0, 0.0])
                sums[0], sums[1], sums[2] = sums[0] + int(n), sums[1] + int(k), sums[2] + e
        yield pd.DataFrame([(*k, n, m, s.tolist()) for k, (n, m, s) in held.items()], columns=cols)

    double = [F.col(c).cast("double").alias(c) for c in READS if c != base and c in rows.columns]
    read_rows = rows.select(*keys, *double, F.col(base).cast("double").alias("base"), (F.col(target) - F.col(base)).cast("double").alias("__left"))
    parts = read_rows.mapInPandas(run, f"{kinds}, __n long, __known long, __sums array<double>")
    each = parts.select(*keys, "__n", "__known", F.posexplode("__sums").alias("__place", "__e"))
    sums = each.groupBy(*keys, "__place").agg(F.sum("__n").alias("n"), F.try_divide(F.sum("__e"), F.sum("__known")).alias("mae"))
    bases = sums.filter("__place = 0").select(*keys, F.col("mae").alias("base_mae"))
    named = rows.sparkSession.createDataFrame([(j, name, i) for j, (name, i, _) in enumerate(places, 1)], "__place int, name string, setting int")  # a row a setting
    done = sums.join(F.broadcast(named), "__place").join(bases, list(keys))
    return done.select(*keys, "n", "base_mae", "name", "setting", "mae")


def mean_correction(rows: DataFrame, chosen: str, name: str, grids: Mapping[str, Sequence[Mapping[str, float]]] = GRIDS, bound: float = BOUND) -> DataFrame:
    """rows with the bounded mean of the corrections that each row's array of (name, setting) chooses; 0 where it is null or empty. Only chosen corrections are made."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total, n = np.zeros(len(batch)), np.zeros(len(batch))
            marks = batch["__chosen"].fillna("")
            for mark in marks.unique():
                at = np.flatnonzero((marks == mark).to_numpy())
                x = read(batch, at)
                for one in filter(None, mark.split(",")):
                    which, setting = one.rsplit(":", 1)
                    total[at] += corrections(which, grids[which][int(setting)], x, bound)
                    n[at] += 1
            batch[name] = np.clip(np.divide(total, n, out=np.zeros(len(batch)), where=n > 0), -bound, bound)
            yield batch.drop(columns="__chosen")

    mark = F.array_join(F.transform(chosen, lambda e: F.concat_ws(":", e["name"], e["setting"].cast("string"))), ",")
    spread = rows.withColumn("__chosen", mark).drop(chosen)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema if f.name != "__chosen")
    return spread.mapInPandas(run, f"{kinds}, `{name}` double")


def blended(rows: DataFrame, keys: Sequence[str], period: str, a: str, b: str, target: str, weights: Sequence[float]) -> DataFrame:
    """For each period the weight of a (against b) with the least error over all earlier periods; the smallest on ties (to 6 places)."""
    tried = rows.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    error = F.abs(F.col(target) - F.col("weight") * F.col(a) - (1 - F.col("weight")) * F.col(b))
    per = tried.groupBy(*keys, period, "weight").agg(F.sum(error).alias("e"), F.count("*").alias("n"))
    before = Window.partitionBy(*keys, "weight").orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    past = per.withColumn("past", F.try_divide(F.sum("e").over(before), F.sum("n").over(before))).filter("past is not null")
    return past.groupBy(*keys, period).agg(F.min(F.struct(F.round("past", 6).alias("past"), "weight")).alias("x")).select(*keys, period, F.col("x.weight").alias("weight"), F.col("x.past").alias("past_mae"))


def locked(discovery: DataFrame, sealed: DataFrame, keys: Sequence[str], parameters: Sequence[str], gain: float = 0.005) -> DataFrame:
    """The best setting on discovery periods scored on sealed ones, with pass or fail. Both have mae and base_mae by setting."""
    best = discovery.groupBy(*keys).agg(F.min_by(F.struct(*parameters), F.struct("mae", *parameters)).alias("p")).select(*keys, "p.*")
    both = best.join(sealed, [*keys, *parameters])
    return both.withColumn("improvement", F.col("base_mae") - F.col("mae")).withColumn("passed", F.col("improvement") >= gain)
