"""The pipeline's stages on odd rows and on the smallest tables, against brute force."""

import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwright.llm import mixing
from panelwright.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def check(before, after, name):
    """What each stage must have done to the rows before it."""
    ids = lambda rows: Counter(r["doc_id"] for r in rows)
    if name == "language":
        gone = ids(before) - ids(after)
        texts = {r["doc_id"]: r["text"] or "" for r in before}
        assert all(not any(c.isalpha() for c in texts[i]) or len(texts[i]) < 40 for i in gone)
        assert all(any(c.isalpha() for c in r["text"]) for r in after)
    elif name == "exact":
        best = {}
        for r in before:
            k = bare(r["text"])
            best[k] = min(best.get(k, (1, 1, 1)), (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        assert sorted((bare(r["text"]), len(r["text"] or "")) for r in after) == sorted((k, -v[0]) for k, v in best.items())
    elif name == "near":
        sets = [shingles(r["text"]) for r in after]
        post = {}
        for i, s in enumerate(sets):
            for x in s:
                for j in post.setdefault(x, []):
                    both = len(s & sets[j])
                    assert 100 * both < 80 * (len(s) + len(sets[j]) - both)
                post[x].append(i)
        assert not ids(after) - ids(before)
    else:
        assert max(ids(after).values(), default=0) <= 3 * max(ids(before).values(), default=1)


@pytest.mark.parametrize("kind", ["odd", "given", "none"])
def test_stages(spark, kind):
    if kind == "given":
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    else:
        rng = random.Random(0)
        words = [f"{a}{b}" for a in "der die und the and les que".split() for b in "abcdefgh"]
        rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 1) for i in range(120)]
        rows += [(200, rows[0][1], "en", "a", 1), (201, rows[1][1] + " extra", "en", "a", 1), (202, None, None, None, None), (203, "", "en", "a", 0), (None, "the quick one", "en", "b", 3), (204, "12 34", "en", "b", 3), (205, rows[2][1].upper(), "en", None, 1), (5, rows[5][1], rows[5][2], rows[5][3], 1)]
        docs = written(spark.createDataFrame(rows if kind == "odd" else [], SCHEMA), "test-docs")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, None), f"test-{name}")
        assert after.columns == columns
        if kind != "none":
            check(docs.collect(), after.collect(), name)
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, None).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())


def test_mix_repeats_what_the_operator_takes(spark):
    docs = written(spark.createDataFrame([(i, "w " * (i % 7), None, "abc"[i % 3], 1) for i in range(60)], SCHEMA), "test-docs")
    took = {r["id"]: (r["taken"], r["size"]) for r in mixing.mix(docs).collect()}
    got = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert got == Counter({i: (2 * t + n) // (2 * n) for i, (t, n) in took.items() if n and (2 * t + n) // (2 * n)})
    assert docs.select(F.sum(mixing.words_in(F.col("text")))).first()[0] == sum(n for _, n in took.values())
