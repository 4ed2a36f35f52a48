"""Centroid clustering with heap-ordered bounds: exact rounds that look again only at vectors whose gap has expired.

A vector's gap is the distance to its second nearest centroid less that to its own. When
centroids move, the gap shrinks by at most its own cluster's drift and the largest drift
of the others, so each cluster keeps one offset, the sum of these over all rounds, and
a heap of its vectors by `expires` = gap + the offset at the time they were scanned. A round
pops what has expired up to the new offset; all others can't have changed cluster.

A heap is a few runs here: the table that a scan wrote, sorted by cluster and
expires. Offsets only grow, so popping is a range of expires that Parquet's statistics
prune, a popped vector goes into the run of its round, and nothing is rewritten. Sums of
components are exact integers, and a round changes them by the vectors that moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Components, clusters and rounds; vectors are scaled by SCALE and rounded down.
WIDTH, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Scaled components are below this, so that a squared distance fits in a long.
MOST = 2**27
#: Bounds are distances in doubles; a gap counts as expired this much early, far above their error.
SLACK = 1e-4


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, width: int = WIDTH) -> DataFrame:
    """id and x, the scaled integer components, of every vector that has `width` finite ones."""
    v = F.col(vector_col)
    fine = (F.size(v) == width) & F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * SCALE < MOST), F.lit(False)))
    return table.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("x"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id; of one id, in order of their components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(name, "x").select("x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a centroid a column."""
    return np.stack([np.einsum("ij,ij->i", x - c, x - c) for c in centroids], axis=1)


def rescanned(vectors: DataFrame, centroids: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """id, x, was, cluster and expires of vectors (id, x, was) after a whole scan of the centroids. Ties go to the smaller number."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = squared(matrix(batch["x"], width), centroids)
            own = np.argmin(d, axis=1)
            near = np.sqrt(np.partition(d, min(1, k - 1), axis=1)[:, :2].astype(float))
            gap = near[:, -1] - near[:, 0] if k > 1 else np.full(len(d), np.inf)
            out = [batch["id"], batch["x"], batch["was"], pa.array(own.astype(np.int32)), pa.array(gap + offsets[own])]
            yield pa.RecordBatch.from_arrays(out, ["id", "x", "was", "cluster", "expires"])

    kind = vectors.schema["id"].dataType.simpleString()
    done = vectors.select("id", "x", "was").mapInArrow(run, f"id {kind}, x array<int>, was int, cluster int, expires double")
    return done.sortWithinPartitions("cluster", "expires")


@dataclass
class Heaps:
    """The runs of all clusters' heaps, and the offsets of every round so far."""

    runs: list[DataFrame] = field(default_factory=list)
    offsets: list[np.ndarray] = field(default_factory=list)

    def above(self, offsets: np.ndarray) -> Column:
        """Whether a vector has not expired at these offsets."""
        return ~self.upto(offsets)

    def upto(self, offsets: np.ndarray) -> Column:
        return reduce(or_, ((F.col("cluster") == i) & (F.col("expires") <= float(o) + SLACK) for i, o in enumerate(offsets)))

    def live(self, run: int) -> DataFrame:
        """What is left of a run after all rounds that came after it."""
        rows = self.runs[run]
        return rows if run + 1 >= len(self.offsets) else rows.filter(self.above(self.offsets[-1]))

    def popped(self, offsets: np.ndarray) -> DataFrame:
        """Vectors that expire now: of every run, those between the last offsets and these."""
        parts = [self.live(i).filter(self.upto(offsets)) for i in range(len(self.runs))]
        return reduce(DataFrame.unionByName, parts).select("id", "x", F.col("cluster").alias("was"))


def moved_sums(run: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and component sums by cluster that a run adds; what a vector leaves is taken off."""
    moves = run.filter("was is null or was != cluster").select("x", F.explode(F.array(F.struct("cluster", F.lit(1).alias("sign")), F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign")))).alias("m")).filter("m.cluster is not null")
    sums = moves.groupBy("m.cluster").agg(F.sum(F.col("m.sign").cast("long")).alias("n"), F.array(*(F.sum(F.get("x", F.lit(i)).cast("long") * F.col("m.sign")) for i in range(width))).alias("s"))
    n, s = np.zeros(k, object), np.zeros((k, width), object)
    for r in sums.collect():  # k rows at most
        n[r["cluster"]], s[r["cluster"]] = r["n"], np.array(r["s"], object)
    return n, s


def clusters(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """One row a vector (id, cluster, distance, the squared one to its final centroid), and the final centroids.

    Vectors of another length, null, or with a null or non-finite component are left out;
    so is one with a component of 2^21 or more, whose squared distance is beyond a long.
    Repeated rows and ids are vectors of their own, a null id is named by the empty text;
    fewer vectors than k give as many centroids; an empty table gives an empty result.
    Sums are longs: 2^36 vectors at most. Other columns are ignored.
    """
    vectors = written(integer_vectors(table, id_col, vector_col, width), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, width), np.int64)
    k, heaps, offsets = len(centroids), Heaps(), np.zeros(len(centroids))
    n, s = np.zeros(k, object), np.zeros((k, width), object)
    due = vectors.withColumn("was", F.lit(None).cast("int"))
    for turn in range(rounds + 1):
        heaps.runs.append(written(rescanned(due, centroids, offsets), f"heap-run-{turn}"))
        heaps.offsets.append(offsets)
        if turn == rounds:
            break
        more_n, more_s = moved_sums(heaps.runs[-1], k, width)
        n, s = n + more_n, s + more_s
        after = np.array([[int(v) // int(n[i]) for v in s[i]] if n[i] else centroids[i] for i in range(k)], np.int64).reshape(k, width)
        drift = np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(float))
        others = np.array([np.delete(drift, i).max(initial=0.0) for i in range(k)])
        centroids, offsets = after, offsets + drift + others
        due = heaps.popped(offsets)
    held = reduce(DataFrame.unionByName, (heaps.live(i) for i in range(len(heaps.runs)))).select("id", "x", "cluster")
    return with_distance(held, centroids), centroids


def with_distance(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and the squared distance to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = matrix(batch["x"], centroids.shape[1]) - centroids[batch["cluster"].to_numpy()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["cluster"], pa.array(np.einsum("ij,ij->i", off, off))], ["id", "cluster", "distance"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
