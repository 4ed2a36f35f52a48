"""Ranked search, clustering and line dedup on rows that a table may well hold: nulls, ties, repeats, long and empty texts, clashing names."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import clustering, line_dedup, ranked_search

LONG = "alpha beta " * 30_000 + "\n" + "a line of the very long text\n" * 500
TEXTS = [
    (1, "Alpha beta\n  A line that Many documents HAVE \nend"), (2, "a line that many documents have\na line that many documents have\t"), (3, "gamma\n\rA LINE THAT MANY DOCUMENTS HAVE"),
    (3, "gamma\n\rA LINE THAT MANY DOCUMENTS HAVE"), (None, "a line that many documents have"), (4, None), (5, ""), (6, "!!! ...\n"), (7, LONG), (8, LONG), (9, LONG), (10, "ÄÖ alpha x B2 éa"),
    (11, "only nineteen chars\n" * 3), (12, "only nineteen chars"), (13, "only nineteen chars"), (14, "only twenty chars ok"), (15, "only twenty chars ok"), (16, "only twenty chars OK"),
    (None, "none of them has an id"), (None, "none of them has an id"), (None, "None of them has an id\n"),
]
EXTRA = ["row", "id", "text_", "h1", "shard", "m", "part", "places", "was", "cluster", "item", "x", "n"]


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, *["?"] * len(EXTRA)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA))


def slow_lines(rows):
    """By the definition: counts and keepers in dictionaries."""
    strip = " \t\n\x0b\x0c\r"
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: lower(line.strip(strip))
    holders = {}
    for d, lines in split:
        for k in {key(x) for x in lines}:
            holders.setdefault(k, []).append(d)
    out = []
    for d, lines in split:
        goes = lambda x: len(k := key(x)) >= 20 and len(holders[k]) >= 3 and d != max((h for h in holders[k] if h is not None), default=None)  # noqa: B023, E731
        kept = [x for x in lines if not goes(x)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("heavy", [line_dedup.HEAVY, 1])
def test_lines_equal_brute_force(spark, heavy):
    """With heavy = 1 every key is asked of the shards, with the default all of this small table by broadcast."""
    got = line_dedup.without_repeated_lines(documents(spark), heavy=heavy).select("id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow_lines(TEXTS), key=str)


def test_lines_of_no_documents(spark):
    assert line_dedup.without_repeated_lines(documents(spark, [])).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest()[:16] for i in range(n)), np.uint64).reshape(-1, 2)
    index = line_dedup.PerfectHash.of(keys[:, 0], keys[:, 1])
    assert sorted(index.places(keys[:, 0], keys[:, 1]).tolist()) == list(range(n))
    again = line_dedup.PerfectHash(index.sizes, index.words, index.rest1, index.rest2)
    assert (again.places(keys[:, 0], keys[:, 1]) == index.places(keys[:, 0], keys[:, 1])).all()


def test_perfect_hash_of_keys_that_share_a_half():
    """Half of the hash being equal only moves keys to another level or the list of the rest."""
    h1, h2 = np.full(3000, 7, np.uint64), np.arange(3000, dtype=np.uint64)
    index = line_dedup.PerfectHash.of(h1, h2)
    assert sorted(index.places(h1, h2).tolist()) == list(range(3000))
    listed = line_dedup.PerfectHash([], np.zeros(0, np.uint64), h1, h2)
    assert listed.places(h1, h2).tolist() == list(range(3000))


def slow_search(rows, items):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    docs = [(d, c) for d, t in rows if (c := Counter(terms(t)))]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in docs:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores, key=lambda x: x[:3])[:10], 1)]
    return out


ITEMS = [(1, "alpha beta, gamma"), (1, "documents have have"), (None, "Many lines"), (2, None), (3, "absent"), (4, ""), (5, "ÄÖ éa b2"), (6, LONG), (7, "only chars")]


@pytest.mark.parametrize("limits", [{}, {"PART_DOCS": 1, "SEGMENT_DOCS": 2, "BLOCK_CHARS": 100_000, "GROUP_CELLS": 1}])
def test_search_equals_brute_force(spark, monkeypatch, limits):
    """Once as it is, once with every bound so low that strata, segments, blocks and groups are cut."""
    for k, v in limits.items():
        monkeypatch.setattr(ranked_search, k, v)
    items = spark.createDataFrame([(*r, "?", "?") for r in ITEMS], "item_id long, text string, block string, id string")
    got = ranked_search.search(ranked_search.build(documents(spark)), items).collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow_search(TEXTS, ITEMS), key=str)


def test_search_of_nothing(spark):
    none = documents(spark, [])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(ranked_search.build(none), items).collect() == []
    assert ranked_search.search(ranked_search.build(documents(spark)), items.limit(0)).collect() == []


def slow_clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for c in range(len(centroids)):
                own = [v for (_, v), (_, at) in zip(kept, near, strict=True) if at == c]
                if own:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, at, d) for (i, _), (d, at) in zip(kept, near, strict=True)], centroids


@pytest.mark.parametrize("k", [1, 2, 16])
def test_clusters_equal_brute_force(spark, k):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=64) / 8 + (i % 5) / 4)]) for i in range(300)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (901, None), (902, []), (903, rows[0][1][:63]), (904, [*rows[0][1][:63], None]), (905, [*rows[0][1][:63], float("nan")]), (906, [*rows[0][1][:63], -math.inf])]
    table = spark.createDataFrame([(*r, "?", "?", "?") for r in rows], "vec_id long, embedding array<float>, x string, was string, id string")
    got, centroids = clustering.clusters(table, k=k)
    want, ends = slow_clusters(rows, k, clustering.ROUNDS)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert centroids.tolist() == ends


def test_few_and_no_vectors(spark):
    shape = "vec_id long, embedding array<float>"
    few = [(i, [i / 64] * 64) for i in range(3)]
    got, centroids = clustering.clusters(spark.createDataFrame(few, shape))
    assert sorted(r["cluster"] for r in got.collect()) == [0, 1, 2] and len(centroids) == 3
    assert clustering.clusters(spark.createDataFrame([], shape))[0].collect() == []


def test_a_round_scans_only_what_expired(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=64) / 64 + (i % 4)]) for i in range(400)]
    scanned, real = [], clustering.rescanned

    def counting(vectors, *args):
        scanned.append(vectors.count())
        return real(vectors, *args)

    monkeypatch.setattr(clustering, "rescanned", counting)
    got, _ = clustering.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, rounds=5)
    assert sorted(map(tuple, got.collect())) == sorted(slow_clusters(rows, 4, 5)[0])
    assert scanned[0] == 400 and sum(scanned[3:]) < 400
