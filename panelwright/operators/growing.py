"""Growing trees on weighted points of binned features: level by level, leaf by leaf, and pruning.

A point is a cell of rows: bins x, weight n and sum s of its target. Everything is a
sum over points by (node, bin), so n points cost n additions a level and feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A split has to gain this part of the root's sum of squares.
LEAST_GAIN = 1e-12


def scrambled(x: np.ndarray) -> np.ndarray:
    """64 mixed bits of each 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


@dataclass
class Tree:
    """Nodes in order of level: feature and cut of a split (bins up to the cut go left), children left and left + 1; -1 in a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    level: np.ndarray
    n: np.ndarray
    s: np.ndarray

    @property
    def value(self) -> np.ndarray:
        return self.s / np.maximum(self.n, 1e-300)

    def leaves_at(self, depth: int | None = None) -> np.ndarray:
        """Which nodes end a path if the tree is cut off at a depth."""
        return (self.left < 0) | (self.level >= (depth if depth is not None else 1 << 30))

    def reached(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The node where each point's path ends."""
        at = np.zeros(len(x), np.int64)
        while len(go := np.flatnonzero(~ends[at])):
            node = at[go]
            at[go] = self.left[node] + (x[go, self.feature[node]] > self.cut[node])
        return at

    def pruned(self, ends: np.ndarray, alpha: float) -> np.ndarray:
        """ends after weakest-link pruning: while the split whose subtree saves the least error a leaf saves no more than alpha (a part of all rows), it goes."""
        error = -self.s**2 / np.maximum(self.n, 1e-300) / max(self.n[0], 1e-300)  # less what no split changes
        ends = ends.copy()
        while not ends[0]:
            inside, leaves, below = np.zeros(len(ends), bool), np.ones(len(ends)), error.copy()
            inside[0] = True
            for i in range(len(ends)):  # parents come before children
                if inside[i] and not ends[i]:
                    inside[self.left[i]] = inside[self.left[i] + 1] = True
            for i in range(len(ends) - 1, -1, -1):
                if inside[i] and not ends[i]:
                    a = self.left[i]
                    leaves[i], below[i] = leaves[a] + leaves[a + 1], below[a] + below[a + 1]
            split = np.flatnonzero(inside & ~ends)
            gain = (error[split] - below[split]) / (leaves[split] - 1)
            weakest = np.argmin(gain)
            if gain[weakest] > alpha:
                break
            ends[split[weakest]] = True
        return ends

    def n_leaves(self, ends: np.ndarray) -> int:
        at, out = np.zeros(1, np.int64), 0
        while len(at):
            out += int(ends[at].sum())
            below = self.left[at[~ends[at]]]
            at = np.concatenate([below, below + 1])
        return out


def gains(n: np.ndarray, s: np.ndarray, least_leaf: float, penalty: float = 0.0) -> np.ndarray:
    """What every cut after a bin saves in squared error; n and s have the bins last. -inf where a side is too small."""
    cn, cs = n.cumsum(axis=-1), s.cumsum(axis=-1)
    all_n, all_s, penalty = cn[..., -1:], cs[..., -1:], penalty or 1e-300
    rn, rs = all_n - cn, all_s - cs
    saved = cs * cs / (cn + penalty) + rs * rs / (rn + penalty) - all_s * all_s / (all_n + penalty)
    saved[(cn < least_leaf) | (rn < least_leaf) | (cn <= 0) | (rn <= 0)] = -np.inf
    return saved


def level_wise(x: np.ndarray, n: np.ndarray, s: np.ndarray, bins: int, depth: int | None, least_leaf: float, picks: int, seed: int, squares: float | None = None) -> Tree:
    """The greedy tree for squared error, a level at a time.

    Each node looks at `picks` of the features, by a hash of the seed and its path, and at
    the others only if none of those can be cut. Ties go to the first feature, then the first cut.
    The least gain is a part of `squares`, by default of the points' s**2 / n.
    """
    k = x.shape[1]
    flat = x + np.arange(k) * bins
    feature, cut, left, level = [np.array([-1])], [np.array([-1])], [np.array([-1])], [np.array([0])]
    weight, total = [np.array([n.sum()])], [np.array([s.sum()])]
    with np.errstate(over="ignore"):
        path = scrambled(np.array([seed], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    order, at, first, size = np.arange(len(n)), np.zeros(len(n), np.int64), 0, 1
    least = LEAST_GAIN * max(float(np.sum(s**2 / np.maximum(n, 1e-300))) if squares is None else squares, 1e-300)
    d = 0
    while size and (depth is None or d < depth):
        place = (at[:, None] * (k * bins) + flat[order]).ravel()  # all features of a level at once
        most = gains(*(np.bincount(place, np.repeat(v[order], k), size * k * bins).reshape(size, k, bins) for v in (n, s)), least_leaf)
        best_cut = most.argmax(axis=2)
        best = np.take_along_axis(most, best_cut[:, :, None], 2)[:, :, 0]
        if picks < k:
            with np.errstate(over="ignore"):
                draw = scrambled(path[:, None] + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
            allowed = draw.argsort(axis=1).argsort(axis=1) < picks
            allowed |= ~(np.where(allowed, best, -np.inf) > least).any(axis=1)[:, None]
            best = np.where(allowed, best, -np.inf)
        f = best.argmax(axis=1)
        rows = np.arange(size)
        cuts = best[rows, f] > least
        numbers = np.cumsum(cuts) - 1
        child = first + size
        feature[-1], cut[-1] = np.where(cuts, f, -1), np.where(cuts, best_cut[rows, f], -1)
        left[-1] = np.where(cuts, child + 2 * numbers, -1)
        go = cuts[at]
        order, at = order[go], at[go]
        side = x[order, f[at]] > best_cut[at, f[at]]
        with np.errstate(over="ignore"):
            path = scrambled(np.repeat(path[cuts], 2) * np.uint64(2) + np.tile(np.array([0, 1], np.uint64), int(cuts.sum())))
        at = 2 * numbers[at] + side
        first, size, d = child, 2 * int(cuts.sum()), d + 1
        if size:
            feature.append(np.full(size, -1))
            cut.append(np.full(size, -1))
            left.append(np.full(size, -1))
            level.append(np.full(size, d))
            weight.append(np.bincount(at, n[order], size))
            total.append(np.bincount(at, s[order], size))
    return Tree(*map(np.concatenate, (feature, cut, left, level, weight, total)))


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """The first value at which the running weight reaches half."""
    order = np.argsort(values, kind="stable")
    run = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(run, run[-1] / 2)])


def leaf_wise(flat: np.ndarray, x: np.ndarray, n: np.ndarray, g: np.ndarray, bins: int, most_leaves: int, least_leaf: float, penalty: float, others: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The leaves of a tree that always cuts the leaf that gains the most: for each the points in it, and which of the others fall there.

    flat is x with its features side by side. The smaller side of a cut is summed, the
    other is what is left of the parent.
    """
    k = x.shape[1]

    def sums(at):
        places = flat[at].ravel()
        return np.bincount(places, np.repeat(n[at], k), k * bins), np.bincount(places, np.repeat(g[at], k), k * bins)

    def best(hists):
        """Gain, feature and cut of the best split of each of some leaves."""
        saved = gains(np.stack([h[0] for h in hists]).reshape(-1, k, bins), np.stack([h[1] for h in hists]).reshape(-1, k, bins), least_leaf, penalty).reshape(len(hists), -1)
        return [(float(row[i]), i // bins, i % bins) for row, i in zip(saved, saved.argmax(axis=1).tolist(), strict=True)]

    everything = np.arange(len(n))
    root = sums(everything)
    leaves = [(best([root])[0], everything, np.arange(len(others)), root)]
    while len(leaves) < most_leaves:
        i = max(range(len(leaves)), key=lambda j: (leaves[j][0][0], -j))
        (gain, f, c), at, rest, hist = leaves[i]
        if not gain > LEAST_GAIN:
            break
        right, far = x[at, f] > c, others[rest, f] > c
        a, b = at[~right], at[right]
        small = sums(a if len(a) <= len(b) else b)
        large = (hist[0] - small[0], hist[1] - small[1])
        low, high = (small, large) if len(a) <= len(b) else (large, small)
        # Leaves of a full tree need no further split.
        found = best([low, high]) if len(leaves) + 1 < most_leaves else [(0.0, 0, 0)] * 2
        leaves[i] = (found[0], a, rest[~far], low)
        leaves.append((found[1], b, rest[far], high))
    return [(x[1], x[2]) for x in leaves]


def boosted(x: np.ndarray, n: np.ndarray, s: np.ndarray, others: np.ndarray, bins: int, rate: float, most_leaves: int, least_leaf: float, loss: str, stops: list[int], penalty: float = 1.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Predictions for the points and for the others after each number of rounds in stops (ascending). loss: squared or absolute."""
    y = s / n
    flat = x + np.arange(x.shape[1]) * bins
    start = float(s.sum() / n.sum()) if loss == "squared" else weighted_median(y, n)
    mine, theirs, out = np.full(len(y), start), np.full(len(others), start), []
    for turn in range(max(stops)):
        g = n * (mine - y) if loss == "squared" else n * np.sign(mine - y)
        for at, rest in leaf_wise(flat, x, n, g, bins, most_leaves, least_leaf, penalty, others):
            step = -g[at].sum() / (n[at].sum() + penalty) if loss == "squared" else weighted_median((y - mine)[at], n[at])
            mine[at] += rate * step
            theirs[rest] += rate * step
        if turn + 1 in stops:
            out.append((mine.copy(), theirs.copy()))
    return out
