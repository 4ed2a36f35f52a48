import random

import numpy as np
from panelwright.llm import license_scan as L


def full_alignment(a, b):
    """Score of the best local alignment over all diagonals."""
    best, before = 0, [0] * (len(a) + 1)
    for y in b:
        row = [0]
        for i, x in enumerate(a):
            row.append(max(0, before[i] + (2 if x == y else -1), before[i + 1] - 1, row[i] - 1))
        best, before = max(best, *row), row
    return best


def test_matches_and_spans(spark):
    apache = L.TEMPLATES["Apache-2.0"][0]
    mit = L.TEMPLATES["MIT"][1]
    edited = mit.replace("free of charge", "without charge").replace("Software without restriction", "Software")
    texts = ["é😀 " + apache + " tail", None, "", "the license of the work is under the version", f"{apache}\n{apache}", "x " * 5000 + edited + " y" * 5000, "Licensed under CC BY-NC 4.0."]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, matches string")
    got = {r["id"]: r["matches"] for r in L.find_licenses(df).collect()}
    assert [[m["license"] for m in got[i]] for i in range(7)] == [["Apache-2.0"], [], [], [], ["Apache-2.0"] * 2, ["MIT"], ["CC-BY-NC-4.0"]]
    assert (got[0][0]["start"], got[0][0]["end"], got[0][0]["coverage"]) == (3, 3 + len(apache) - 1, 1.0)
    m = got[5][0]
    assert texts[5][m["start"] : m["end"]] == edited[:-1] and 0.9 < m["coverage"] < 1
    assert L.find_licenses(df.limit(0)).count() == 0


def test_band_equals_full_alignment():
    rng = random.Random(0)
    for _ in range(60):
        b = [rng.randint(1, 30) for _ in range(rng.randint(5, 40))]
        a = list(b)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(a))
            a[i : i + 1] = rng.choice([[], [99], [a[i], 98]])
        pad = [0] * rng.randint(0, 6)
        a = pad + a + [0] * 5
        matched, first, end = L.align(np.array(a), np.array(b), len(pad), 8)
        gaps = full_alignment(a, b)
        assert matched * 2 >= gaps >= 2 * matched - (end - first) - len(b)


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    index = L.Index(L.TEMPLATES, L.Settings())
    for t, ids in enumerate(index.ids):
        span = index.settings.run + index.settings.window - 1
        for _ in range(5):
            if len(ids) < span:
                continue
            i = rng.integers(0, len(ids) - span + 1)
            assert t in index.hits(np.concatenate([[0, 0], ids[i : i + span], [0]]))[1]


def test_inserted_clause_makes_several_spans_of_one_match():
    index = L.Index(L.TEMPLATES, L.Settings())
    clause = " ".join(f"holder{i}" for i in range(30))
    for name, part in (("MIT", 1), ("BSD-3-Clause", 0), ("GPL-3.0", 2)):
        words = L.TEMPLATES[name][part].split()
        i = len(words) // 2
        got = L.found_in(" ".join([*words[:i], clause, *words[i:]]), index)
        assert [(m[0], m[4], len(m[5])) for m in got] == [(name, 1.0, 2)]


def test_full_texts_and_neighbours():
    index = L.Index(L.TEMPLATES, L.Settings())
    for name, texts in L.TEMPLATES.items():
        for text in texts:
            got = L.found_in(text, index)
            assert [(m[0], m[1], m[2], m[4]) for m in got] == [(name, 0, len(text.rstrip("/.")), 1.0)], text
    mit = f"{L.MIT_GRANT} {L.MIT_REST}"
    assert L.found_in(mit, index)[0][2] == len(mit) - 1
    assert [m[0] for m in L.found_in("# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0)\n", index)] == ["MIT", "GPL-2.0-only"]
    assert L.found_in("Released under the Zebra License.", index) == []
    assert [m[0] for m in L.found_in("Released under the ISC License.", index)] == ["ISC"]
