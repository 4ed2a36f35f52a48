"""Edge cases and brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwright.llm import bpe, exact_dedup, fingerprint, language_id, mixing, secret_scan, toxicity, warc_segments

ODD = [
    (1, "Hello  world", "a"), (2, "Helloworld", "a"), (3, None, None), (4, "", "b"), (5, " \t\r\n", "b"), (6, "Hello world", None), (6, "Hello world", None),
    (None, "Hello world!", "c"), (8, "é😀  x" * 50, "c"), (9, "word " * 20_000, "c"), (10, "x" * 60_000, "d"),
]
SCHEMA = "doc_id long, text string, source string, row string, id string, digest string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    path = f"/tmp/checkpoints/test-odd-{random.random()}"
    spark.createDataFrame([(i, t, s, "r", "i", "d", "en") for i, t, s in ODD], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_groups(docs, fan_in=2).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t, _ in ODD:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2] or None, len(v)) for k, v in groups.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[r["digest"]]
    assert sum(r["kept"] for r in got) == len(want)
    assert exact_dedup.drop_copies(docs).count() == len(want)
    assert exact_dedup.exact_groups(none).count() == 0


def spans(text):
    out = []
    kinds = (("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24))
    for no, (_, pattern, least) in enumerate(kinds):
        out += [(m.start(), no, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return sorted(out)


def test_secret_scan(spark):
    rng = random.Random(1)
    bits = ["password", "API_KEY", "apikey", "secret", "ToKeN", "=", ":", " ", "'", '"', "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "😀", "\n", "xy", "AKIAAAAA", "deadbeefdeadbeef", "Zz9_" * 6]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(300)] + [None, "", "secret=token :longvalue", "token: 'abc'", "password=Zz9_Zz9_Zz9_Zz9_Zz9_ x"]
    df = spark.createDataFrame([(i, t, f"s{i % 5}", "c", "c") for i, t in enumerate(texts)], "doc_id long, text string, source string, row string, spans string")
    got = {r["id"]: r["spans"] for r in secret_scan.find_secrets(df).collect()}
    for i, t in enumerate(texts):
        assert [(x["start"], x["kind_no"], x["end"]) for x in got[i] if x["kind_no"] < 3] == spans(t or ""), t
    owners = {x["value_hash"]: x["n_owners"] for s in got.values() for x in s}
    assert max(owners.values()) == 5 and all(x["n_owners"] == 1 for s in got.values() for x in s if x["kind_no"] == 3)
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


def test_fingerprint(docs, none, spark):
    got = fingerprint.edited_pairs(docs).collect()
    order = sorted(((i is None, -(i or 0)), t or "") for i, t, _ in ODD)
    texts = [t for _, t in order]
    want = []
    for k, t in enumerate(texts):
        n = len(t)
        want.append((n, hashlib.sha256((t[: n - n // 3] + texts[(k + 1) % len(texts)][: n // 3]).encode()).hexdigest(), fingerprint.fingerprint(t)))
    assert sorted((r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in got) == sorted(want)
    assert fingerprint.edited_pairs(none).count() == 0
    one = fingerprint.edited_pairs(docs.filter("doc_id = 1")).collect()
    assert one[0]["next_fingerprint"] == one[0]["fingerprint"]
    rng = random.Random(0)
    long = " ".join(rng.choices([f"{a}{b}" for a in "alpha beta gamma delta epsilon zeta eta".split() for b in range(300)], k=3000))
    pairs = [(long, long), (long, long[:4000] + "XX" + long[4000:]), (long, "".join(rng.choices("qwrtz ", k=9000)))]
    df = spark.createDataFrame([(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) for a, b in pairs], "a string, b string")
    same, near, far = [r[0] for r in df.select(fingerprint.likeness(df.a, df.b)).collect()]
    assert same == 1 and near > 0.8 and far < 0.4
    assert len(fingerprint.fingerprint("a" * 3_000_000)) < 600


def test_language(spark):
    rng = random.Random(2)
    vocabulary = {"en": "the and with that from which".split(), "de": "der und mit dass von welche".split(), "fr": "le et avec que de quelle".split()}
    rows = [(i, " ".join(rng.choices(vocabulary[lang], k=30)), lang) for i in range(300) for lang in [rng.choice(list(vocabulary))]]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 !! 34", "fr"), (1003, "漢字", None), (None, "the and with", None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.learn(df)
    assert model.languages == ["de", "en", "fr"]
    got = {r["id"]: r for r in language_id.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["score"] == 0 and got[1003]["lang_pred"] in vocabulary
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.predict(df.limit(0), language_id.learn(df.limit(0))).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(df, language_id.learn(df.limit(0))).collect()} == {"und"}


def test_bloom_false_positives_are_corrected():
    rng = np.random.default_rng(0)
    slots = np.zeros((1, 1 << 12), dtype=np.uint64)
    for slot in language_id.slots_of(rng.integers(1, 2**62, 1500), 12):
        slots[0, slot] |= np.uint64(1)
    model = language_id.Model(["x"], slots, 0)
    keys = rng.integers(1, 2**62, 20000)
    mask = np.uint64(1)
    for slot in language_id.slots_of(keys, 12):
        mask = mask & slots[0, slot]
    assert abs(mask.mean() - model.false_rates[0]) < 0.02


def test_warc_round_trip(spark):
    rng = random.Random(4)
    html = ["", None, "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é😀" * 9000, "é😀" * 9000, "WARC/1.1\r\n\r\nContent-Length: 5\r\n" * 40] + ["".join(rng.choices("ab\r\n0é", k=rng.randint(0, 70_000))) for _ in range(12)]
    ids = [5, 4, 9, 8, 3, 2, 11, 10, 12, *range(20, 32)]
    rows = [(i, f"http://x/{i}\r\n", h, "z") for i, h in zip(ids, html, strict=True)] + [(None, None, "y" * 100, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    df.write.mode("overwrite").parquet("/tmp/checkpoints/test-pages")
    df = spark.read.parquet("/tmp/checkpoints/test-pages")
    path = warc_segments.write_archives(df, segment_bytes=5000, records_per_file=7)
    got = {r["page_id"]: r for r in warc_segments.read_archives(spark, path, payloads=True).collect()}
    assert len(got) == len(rows)
    for i, _, h, _ in rows:
        data = (h or "").encode()
        same = sorted(j for j, _, g, _ in rows if g == h and j is not None)
        first = len(data) < 100 or i == same[0]
        r = got[i]
        assert (bytes(r["payload"]), r["payload_bytes"], r["payload_digest"]) == (data, len(data), hashlib.sha256(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", same[0]))
    assert warc_segments.read_archives(spark, warc_segments.write_archives(df.limit(0))).count() == 0


def test_warc_broken_segments(spark):
    block = warc_segments.HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + warc_segments.chunked(b"z" * 100)
    parts = [block[:50], block[50:120], block[120:]]
    def archive(numbers, total):
        out = warc_segments.record("response", "urn:a", parts[0], WARC_Segment_Number=1)
        for n in numbers:
            out += b"\r\n\r\n" + warc_segments.record("continuation", f"urn:a:{n}", parts[n - 1], WARC_Segment_Number=n, WARC_Segment_Origin_ID="<urn:a>", WARC_Segment_Total_Length=total if n == 3 else None)
        return out + b"\r\n\r\n"
    for name, numbers, total, complete in (("ok", (3, 2), len(block), True), ("gap", (3,), len(block), False), ("total", (2, 3), len(block) + 1, False), ("twice", (2, 2, 3), len(block), False)):
        folder = f"/tmp/checkpoints/test-warc-{random.random()}"
        spark.createDataFrame([(archive(numbers, total)[:-4].decode("latin-1"),)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(folder)
        got = warc_segments.read_archives(spark, folder).collect()
        assert [r["complete"] for r in got] == [complete], name


def test_bpe_equals_the_library(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = sorted(((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.token_digests(docs, path).collect()))
    want = []
    for _, t, _ in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    back = {(r["id"], r["text"]) for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert back == {(i, t or "") for i, t, _ in ODD}
    assert bpe.token_digests(none, path).count() == 0


def test_segment_tree_on_random_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, library, rng = bpe.Tokenizer(open(path, "rb").read()), Tokenizer.from_file(path), random.Random(5)
    texts = ["".join(rng.choice(" \n\t'sdlltheing aZ9é漢字̀😀\x85\x1c\xa0²½_<|>!ß 　") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    texts += ["<|endoftext|>a<|endoftext|>", "ab" * 20_000, "thing" * 30, " " * 500]
    assert list(ours.encode_batch(texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_toxicity(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        text = rng.choices(words, k=rng.randint(5, 80))
        toxic = int(rng.random() < 0.2)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["idiotic", "vile"]))
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), toxic))
    docs = spark.createDataFrame([(i, t, lang, "a", 0.5) for i, t, lang, _ in rows] + [(9999, None, None, "a", 0.5), (9998, "", "en", "a", 0.5)], "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, _, y in rows] + [(1, rows[1][3], 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.learn(docs, labels)
    got = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= s <= 1 for s in got.values()) and got[9999] < 0.3 and got[9998] < 0.3
    hits = sum((got[i] >= 0.3) == bool(y) for i, _, _, y in rows)
    assert hits > 0.97 * len(rows)
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), labels)).count() == 0


def test_mixing(docs, none, spark):
    got = mixing.mix(docs).collect()
    sizes = {(i, t): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in ODD}
    assert sorted(r["size"] for r in got) == sorted(sizes[i, t] for i, t, _ in ODD)
    by = {}
    for r in got:
        by.setdefault(r["source_no"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for rs in by.values():
        assert sum(r["taken"] for r in rs) == int(rs[0]["target"] or 0) and rs[0]["target"] <= 3 * rs[0]["source_size"]
    assert sorted(map(str, mixing.mix(docs.repartition(2)).drop("row").collect())) == sorted(map(str, mixing.mix(docs).drop("row").collect()))
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_toxicity_learns_from_every_labelled_row(spark):
    """More rows than a bound of 3,000 would draw: what each bucket stands in is counted over all of them, and shards agree with a single one."""
    from panelwright.llm.common import held_out

    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), F.concat(F.lit("only"), F.col("id")), F.when(F.col("id") % 5 == 0, "vileword here")).alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    seen = {}
    counted = toxicity.counted
    toxicity.counted = lambda train, s: seen.setdefault("got", (train.count(), counted(train, s)))[1]
    try:
        model = toxicity.learn(docs, labels, settings=toxicity.Settings(shard_rows=1000, epochs=1))
    finally:
        toxicity.counted = counted
    rows, (stands, toxic) = seen["got"]
    of = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) != 3
    train = docs.join(labels, "doc_id").filter(~held_out(F.col("doc_id")) & of)
    both, _ = toxicity.buckets_of(["vileword"], 16)
    assert rows == train.count() > 3000
    assert stands[0, both[0, 0]] >= toxic[0, both[0, 0]] >= train.filter("toxic = 1").count() > 600
    got = {r["id"]: r["score"] >= toxicity.CUT for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == (i % 5 == 0) for i in range(n)) > 0.98 * n
