"""Mixtures of ridges over tiers of a role, weighted by cross-fitted probabilities of the tiers.

A scheme is one or two ascending cuts of the role: two tiers or three. Every
scheme of every fold gets its classifier from the same passes: a Newton step needs a
gradient and a block Hessian, which tasks sum over their rows for all folds and schemes at once,
so no row is repeated; only these sums, a row a fold and scheme, come to the driver.
The tiers' ridges need sums by tier, and tiers are unions of the intervals between all cuts, so
rows are summed once by interval and period.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import linear

# Cuts of the role and penalties of the ridges.
TWO_TIERS = ((1.5,), (2.5,), (3.5,), (4.5,))
THREE_TIERS = ((1.5, 3.5), (2.0, 4.0), (2.5, 4.5))
ALPHAS = (0.1, 1.0, 10.0, 100.0)
#: Rows that a tier needs in a fold's training data.
LEAST_IN_TIER = 20


def tier(role: float, cuts: Sequence[float]) -> int:
    return bisect_right(cuts, role)


def running_sums(rows: DataFrame, by: str, period: str, features: Sequence[str], target: str, role: str, schemes: Sequence[Sequence[float]]) -> DataFrame:
    """by, scheme, tier, fold, n, s and p of the rows before every period, as linear.fold_sums has them; tier -1 is all of them (of scheme 0)."""
    points = sorted({c for cuts in schemes for c in cuts})
    places = [(a, i, tier(([*points, np.inf])[a] - 1e-12 if a < len(points) else np.inf, cuts)) for i, cuts in enumerate(schemes) for a in range(len(points) + 1)]
    places += [(a, 0, -1) for a in range(len(points) + 1)]
    spark = rows.sparkSession
    names = spark.createDataFrame(places, "__interval int, scheme int, tier int")  # a row an interval and scheme
    interval = sum((F.when(F.col(role) >= c, 1).otherwise(0) for c in points), F.lit(0)).cast("int")
    m = 2 * len(features) + 1
    known = rows.filter(F.col(role).isNotNull() & F.col(target).isNotNull()).withColumn("__interval", interval)
    sums = linear.period_sums(known, [by, "__interval"], period, features, target)
    total = lambda c, k: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(k)))
    tiers = sums.join(F.broadcast(names), "__interval").groupBy(by, "scheme", "tier", period).agg(F.sum("n").alias("n"), total("s", m).alias("s"), total("p", m * (m + 1) // 2).alias("p"))
    # A tier may have no row in a period that needs its fold: every period of the group is a fold of every tier.
    every = rows.select(by, period).distinct().join(tiers.select(by, "scheme", "tier").distinct(), by)
    full = every.join(tiers, [by, "scheme", "tier", period], "left")
    before = Window.partitionBy(by, "scheme", "tier").orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    past = lambda c, k: F.array(*(F.coalesce(F.sum(F.get(c, F.lit(i))).over(before), F.lit(0.0)) for i in range(k)))
    out = full.select(by, "scheme", "tier", F.col(period).alias("fold"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), past("s", m).alias("s"), past("p", m * (m + 1) // 2).alias("p"))
    return out.filter("n > 0").withColumn("med", F.array(*(F.lit(0.0) for _ in features)))


def probabilities(z: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Of every tier, from standardized features with a leading 1. One row of beta is the upper of two tiers; three are three tiers."""
    score = z @ beta.T
    if score.shape[1] == 1:
        score = np.hstack([np.zeros_like(score), score])
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(z: np.ndarray, of_tier: np.ndarray, weights: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gradient, then Hessian of the weighted log-likelihood (less its sign), flat, of the free tiers."""
    p, free, k = probabilities(z, beta), len(beta), z.shape[1]
    first = p.shape[1] - free
    w = weights[of_tier]
    g = np.concatenate([((w * ((of_tier == first + a) - p[:, first + a]))[:, None] * z).sum(axis=0) for a in range(free)])
    h = np.zeros((free * k, free * k))
    for a in range(free):
        for b in range(free):
            c = w * p[:, first + a] * ((a == b) - p[:, first + b])
            h[a * k : (a + 1) * k, b * k : (b + 1) * k] = z.T @ (z * c[:, None])
    return np.concatenate([g, h.ravel()])


def prepared(frame: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    return frame[list(features)].to_numpy(float, na_value=np.nan)


def classifiers(rows: DataFrame, sums: list, by: str, period: str, features: Sequence[str], role: str, schemes: Sequence[Sequence[float]], penalty: float = 1.0, rounds: int = 25, least: int = LEAST_IN_TIER) -> dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """mean, std and coefficients by (group, fold, scheme), of those whose every tier has enough rows.

    Tiers weigh alike; the penalty is on the squares of the standardized coefficients / 2.
    """
    k = len(features) + 1
    stats, sizes = {}, {}
    for r in sums:
        if r["tier"] == -1:
            _, _, mean, std, _ = linear.design(r)
            stats[r[by], r["fold"]] = (r["n"], mean, std)
        else:
            sizes.setdefault((r[by], r["fold"], r["scheme"]), {})[r["tier"]] = r["n"]
    beta, weights = {}, {}
    for key, by_tier in sizes.items():
        tiers = len(schemes[key[2]]) + 1
        counts = np.array([by_tier.get(i, 0) for i in range(tiers)])
        if counts.min() >= least:
            beta[key], weights[key] = np.zeros((1 if tiers == 2 else tiers, k)), counts.sum() / tiers / counts
    longest = max((b.size + b.size**2 for b in beta.values()), default=0)
    for _ in range(rounds):
        if not beta:
            break
        now = dict(beta)

        def sum_up(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            found: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for group, part in batch.groupby(by):
                    x, when, roles = prepared(part, features), part[period].to_numpy(), part[role].to_numpy()
                    for key in (key for key in now if key[0] == group):
                        past = when < key[1]
                        if past.any():
                            _, mean, std = stats[key[:2]]
                            tiers = np.searchsorted(np.asarray(schemes[key[2]]), roles[past], side="right")
                            found[key] = found.get(key, 0.0) + derivatives(standardized(x[past], mean, std), tiers, weights[key], now[key])
            yield pd.DataFrame([(*key, v.tolist()) for key, v in found.items()], columns=[by, "fold", "scheme", "d"])

        shape = f"`{by}` {rows.schema[by].dataType.simpleString()}, fold long, scheme int, d array<double>"
        parts = rows.select(by, period, role, *features).filter(F.col(role).isNotNull()).mapInPandas(sum_up, shape)
        steps = parts.groupBy(by, "fold", "scheme").agg(F.array(*(F.sum(F.get("d", F.lit(i))) for i in range(longest))).alias("d")).collect()
        most = 0.0
        for r in steps:
            key = (r[by], r["fold"], r["scheme"])
            b = beta[key]
            d = np.array(r["d"][: b.size + b.size**2], float)
            ridge = penalty * np.tile([0.0] + [1.0] * (k - 1), len(b))
            step = np.linalg.lstsq(d[b.size :].reshape(b.size, b.size) + np.diag(ridge), d[: b.size] - ridge * b.ravel(), rcond=1e-12)[0].reshape(b.shape)
            beta[key] = b + step
            most = max(most, np.abs(step).max())
        if most < 1e-10:
            break
    return {key: (*stats[key[:2]][1:], b) for key, b in beta.items()}


def standardized(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = np.divide(x - mean, std, out=np.zeros_like(x), where=std > 0)
    return np.hstack([np.ones((len(x), 1)), z])


def mixed(rows: DataFrame, by: str, period: str, features: Sequence[str], target: str, role: str, schemes: Sequence[Sequence[float]], alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """rows with `tiers`, an array of each scheme's tier probabilities, and `mixed`, an array of predictions: scheme by scheme, each with every penalty.

    Both know only what lies before the row's period; a scheme with too few rows in a tier there
    is null. A null feature counts as 0; rows without role or target train nothing.
    """
    from ..sources.scratch import held

    rows = held(rows.withColumns({x: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in features}).withColumn(role, F.col(role).cast("double")), "roles")
    sums = held(running_sums(rows, by, period, features, target, role, schemes), "tier-sums")
    models = classifiers(rows, sums.collect(), by, period, features, role, schemes)  # rows by fold, scheme and tier
    keys = [by, "scheme", "tier", "fold"]
    ridges = linear.fits(sums.filter("tier >= 0"), keys, {"all": list(range(len(features)))}, alphas).filter("method = 'ridge'")
    coefs = {(r[by], r["fold"], r["scheme"], r["tier"], r["alpha"]): (r["intercept"], np.array(r["coef"])) for r in ridges.collect()}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, tiers, out = prepared(batch, features), [[None] * len(schemes) for _ in range(len(batch))], [[None] * (len(schemes) * len(alphas)) for _ in range(len(batch))]
            at = batch.groupby([by, period]).indices
            for (group, fold), places in at.items():
                for i in range(len(schemes)):
                    if (group, fold, i) in models:
                        mean, std, beta = models[group, fold, i]
                        p = probabilities(standardized(x[places], mean, std), beta)
                        for j, alpha in enumerate(alphas):
                            line = [coefs[group, fold, i, t, alpha] for t in range(p.shape[1])]
                            value = sum(p[:, t] * (c + x[places] @ w) for t, (c, w) in enumerate(line))
                            for place, v in zip(places, value.tolist(), strict=True):
                                out[place][i * len(alphas) + j] = v
                        for place, v in zip(places, p.tolist(), strict=True):
                            tiers[place][i] = v
            yield batch.assign(tiers=tiers, mixed=out)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return held(rows.mapInPandas(score, f"{shape}, tiers array<array<double>>, mixed array<double>"), "mixed")


def chosen(scored: DataFrame, by: str, period: str, target: str, settings: Mapping[int, tuple], inner: DataFrame) -> DataFrame:
    """by, fold, setting, inner_mae, mae and n: for every fold the setting (places in `mixed`) with the least mean error on all its inner folds, the first on ties.

    A setting that an inner fold couldn't fit is not chosen.
    """
    keys = [by, "fold"]
    error = lambda i: F.avg(F.abs(F.col(target) - F.get("mixed", F.lit(i))))
    wide = scored.withColumn("fold", F.col(period)).groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.struct(F.lit(i).alias("setting"), error(i).alias("mae")) for i in settings)).alias("e"))
    scores = wide.select(*keys, "n", F.inline("e")).filter("mae is not null")
    n_inner = inner.groupBy(*keys).agg(F.count("*").alias("__inner"))
    past = inner.join(scores.select(by, F.col("fold").alias("inner_fold"), "setting", "mae"), [by, "inner_fold"]).groupBy(*keys, "setting").agg(F.avg("mae").alias("inner_mae"), F.count("*").alias("__k"))
    whole = past.join(n_inner, keys).filter("__k = __inner")
    best = whole.groupBy(*keys).agg(F.min(F.struct(F.round("inner_mae", 9).alias("e"), "setting", "inner_mae")).alias("b")).select(*keys, "b.setting", "b.inner_mae")
    return best.join(scores, [*keys, "setting"])
