import random

import numpy as np
import pytest

from panelwright.llm import near_dedup as N


def brute(rows, k, similar=80):
    """component by position of (id, text) rows, and the set sizes."""
    import re

    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similar * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    best = {}
    for i, (id_, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), id_), id_)
    return [(id_, len(sets[i]), best[root(i)] if sets[i] else id_) for i, (id_, _) in enumerate(rows)]


def family(rng, n, words, edits, vocabulary):
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("small", "crowd"), [(24, 64), (24, 3), (2, 64)])
def test_components_equal_brute_force(spark, small, crowd):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = family(rng, 60, 120, 12, vocabulary) + family(rng, 25, 80, 3, vocabulary) + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(40)]
    texts += ["", None, "  \n", "One", "one", "ONE two", "a b c", "a b c", "Ä b c", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, node string").repartition(3)
    path = f"/tmp/checkpoints/test-near-{random.random()}"
    docs.write.parquet(path)
    got = N.near_groups(spark.read.parquet(path), settings=N.Settings(words=4, small=small, crowd=crowd, block=16)).collect()
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, 4))
    firsts = [r["id"] for r in got if r["first"]]
    assert sorted(firsts) == sorted(i for i, _, c in brute(rows, 4) if i == c)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 3, 50, 2000):
        items = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        got = N.sketches([items, items[:0], items[:1]], 160)
        assert (got[1] == N.NEVER).all()
        assert (got[[0, 2]] != np.uint64(2**64 - 1)).all()
    a = rng.integers(0, 2**63, 1000, dtype=np.int64).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.int64).astype(np.uint64)])
    same = np.equal(*N.sketches([np.unique(a), np.unique(b)], 2000)).mean()
    assert abs(same - 800 / 1200) < 0.05


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_groups(docs).count() == 0
    assert N.drop_near_copies(docs).count() == 0
