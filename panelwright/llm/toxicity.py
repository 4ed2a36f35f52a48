"""Toxicity by a convolutional text classifier, trained in numpy on all labelled rows.

Words and their stems (first letters) are hashed into two embedding tables whose rows add
up, and filters of several widths run over the words. Each filter is pooled twice: its
maximum over the whole text, and the mean over segments of the maximum in each segment,
which tells a text full of such windows from a long one with a stray match. Both go
rectified into one logistic unit. The gradient of a maximum reaches one window only, so
training touches few rows. Embeddings start from how much more often a bucket stands in
toxic texts.
Texts meet their labels in one exchange by shard, where labelled ones are encoded. Every epoch each shard trains from the
same parameters, a task streaming its rows, and the shards' changes are averaged by Spark:
a bucket's over the shards that touched it. The driver only holds the parameters.
Scores are shifted so that the best cut of rows left out of training lies at 0.3; each
language gets a threshold of its own from the same rows (the score never sees the language).
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, text_of, written

TOKEN = re.compile(r"\w+")
CACHE_WORDS, SLICE_WORDS = 300_000, 400_000
CUT = 0.3
#: Words of a pooling segment, letters of a stem.
SEGMENT, STEM = 64, 5


@dataclass(frozen=True)
class Settings:
    """All labelled rows are learned from, unless a caller asks for training_rows of them (in expectation); least_rows: a language's for a threshold of its own.

    Shards have shard_rows rows while there are at most max_shards, and most_rows at most.
    """

    training_rows: int | None = None
    shard_rows: int = 3000
    max_shards: int = 64
    most_rows: int = 40_000
    batch: int = 8
    bucket_bits: int = 16
    dims: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    rate: float = 0.05
    seed: int = 7
    least_rows: int = 40


@dataclass
class Model:
    settings: Settings
    #: By width and place in the window: what a bucket adds to each filter, for either hash.
    tables: list[list[tuple[np.ndarray, np.ndarray]]]
    bias: list[np.ndarray]
    out: np.ndarray
    slope: float = 1.0
    middle: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def buckets_of(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and its stem of all texts, (words, 2), and each text's number of words."""
    cache = sys.modules[__name__].__dict__.setdefault("_buckets", {})
    if len(cache) > CACHE_WORDS:
        cache.clear()
    flat, counts, mask = [], [], (1 << bits) - 1
    for t in texts:
        words = TOKEN.findall(t.lower())
        for w in set(words).difference(cache):
            h = zlib.crc32(w.encode())
            cache[w] = (h & mask) << 32 | (zlib.crc32(w[:STEM].encode(), 0x5BD1E995) & mask)
        flat.extend(map(cache.__getitem__, words))
        counts.append(len(words))
    both = np.array(flat, dtype=np.int64)
    return np.stack([both >> 32, both & 0xFFFFFFFF], axis=1), np.array(counts, dtype=np.int64)


def segments(counts: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (in windows) of every segment of the texts that have a window, and the text of each."""
    windows = np.maximum(counts - width + 1, 0)
    n = -(-windows // SEGMENT)
    text = np.repeat(np.arange(len(counts)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = starts[text] + place * SEGMENT
    return first, np.minimum(first + SEGMENT, starts[text] + windows[text]), text


def pooled(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Maximum of each run first:last of rows."""
    edges = np.stack([first, last], axis=1).ravel()
    return np.maximum.reduceat(values, edges[:-1] if edges[-1] >= len(values) else edges, axis=0)[::2]


def features(model: Model, both: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each text's maximum of every filter and the mean of its segments' maxima, rectified; 0 where a text has no window."""
    s = model.settings
    k_all = len(s.widths) * s.filters
    out = np.zeros((len(counts), 2 * k_all), dtype=np.float32)
    starts = np.cumsum(counts) - counts
    for k, (width, places) in enumerate(zip(s.widths, model.tables, strict=True)):
        n = len(both) - width + 1
        first, last, text = segments(counts, starts, width)
        if n <= 0 or not len(text):
            continue
        conv = sum(a[both[i : i + n, 0]] + b[both[i : i + n, 1]] for i, (a, b) in enumerate(places))
        best = np.maximum(pooled(conv, first, last) + model.bias[k], 0)
        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        who, per = text[heads], np.diff(np.append(heads, len(text)))
        at = slice(k * s.filters, (k + 1) * s.filters)
        out[who, at] = np.maximum.reduceat(best, heads, axis=0)
        out[who, k_all + at.start : k_all + at.stop] = np.add.reduceat(best, heads, axis=0) / per[:, None]
    return out


def logits(model: Model, texts: list[str]) -> np.ndarray:
    out = []
    at = 0
    while at < len(texts):  # a slice holds whole texts, some SLICE_WORDS words
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= 6 * SLICE_WORDS):
            size += len(texts[end])
            end += 1
        both, counts = buckets_of(texts[at:end], model.settings.bucket_bits)
        out.append(features(model, both, counts) @ model.out[:-1] + model.out[-1])
        at = end
    return np.concatenate(out) if out else np.empty(0)


def best_cut(z: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The middle of the gap below which F1 is best, from rows and hits by distinct value."""
    order = np.argsort(-z)
    z, hit, upto = z[order], np.cumsum(hits[order]), np.cumsum(n[order])
    i = int(np.argmax(2 * hit / (upto + max(1, hits.sum()))))
    return float((z[i] + (z[i + 1] if i + 1 < len(z) else z[i] - 1)) / 2)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Buckets of a piece of the embeddings that is averaged by itself.
PIECE = 4096
PIECES = "piece int, shard int, n binary, v binary"


@dataclass
class State:
    """Parameters in training: emb of both hashes, and the dense ones with their momenta."""

    emb: np.ndarray
    dense: list[np.ndarray]
    speed: list[np.ndarray]


def code_type(s: Settings) -> type:
    return np.uint16 if s.bucket_bits <= 16 else np.uint32


def decoded(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """As buckets_of, from encoded texts."""
    both = np.frombuffer(b"".join(words), code_type(s)).reshape(-1, 2).astype(np.int64)
    return both, np.array([len(w) for w in words], dtype=np.int64) // (2 * np.dtype(code_type(s)).itemsize)


def step(state: State, both: np.ndarray, counts: np.ndarray, y: np.ndarray, s: Settings, lr: float) -> None:
    """One step of gradient descent on a few texts. The gradient of a maximum goes to its first window."""
    w_all, f_all = len(s.widths), s.filters
    filt, bias, out = state.dense[:w_all], state.dense[w_all:-1], state.dense[-1]
    k_all, starts = w_all * f_all, np.cumsum(counts) - counts
    used = [np.unique(both[:, h], return_inverse=True) for h in (0, 1)]
    rows = [state.emb[h][u] for h, (u, _) in enumerate(used)]
    value, found = np.zeros((len(counts), 2 * k_all)), []
    for k, w in enumerate(s.widths):
        n = len(both) - w + 1
        first, last, text = segments(counts, starts, w)
        if n <= 0 or not len(text):
            found.append(None)
            continue
        conv = sum((rows[h] @ filt[k][j])[used[h][1][j : j + n]] for j in range(w) for h in (0, 1))
        top = pooled(conv, first, last)
        size = last - first
        inside = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())  # a segment's windows, one after another
        hit = np.where(conv[inside] == np.repeat(top, size, axis=0), inside[:, None], len(both))
        at = np.minimum.reduceat(hit, np.cumsum(size) - size, axis=0)
        best = np.maximum(top + bias[k], 0)
        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        who, per = text[heads], np.diff(np.append(heads, len(text)))
        here = slice(k * f_all, (k + 1) * f_all)
        value[who, here] = most = np.maximum.reduceat(best, heads, axis=0)
        value[who, k_all + here.start : k_all + here.stop] = np.add.reduceat(best, heads, axis=0) / per[:, None]
        place = np.where(best == np.repeat(most, per, axis=0), np.arange(len(best))[:, None], len(best))
        found.append((at, best, text, np.repeat(per, per), who, np.minimum.reduceat(place, heads, axis=0)))
    error = sigmoid(value @ out[:-1] + out[-1]) - y
    grads = [np.zeros_like(p) for p in state.dense]
    change = []
    for k, (w, one) in enumerate(zip(s.widths, found, strict=True)):
        if one is None:
            continue
        at, best, text, per, who, leader = one
        of_max, of_mean = (out[p + k * f_all : p + (k + 1) * f_all] for p in (0, k_all))
        g = error[text, None] * of_mean / per[:, None]
        g[leader, np.arange(f_all)] += error[who, None] * of_max
        g *= best > 0
        grads[w_all + k] = g.sum(0)
        r, c = np.nonzero(g)
        for j in range(w):
            b, gg = both[at[r, c] + j], g[r, c][:, None]
            e = (state.emb[0][b[:, 0]] + state.emb[1][b[:, 1]]) * gg
            for f in range(f_all):
                grads[k][j][:, f] += e[c == f].sum(0)
            change.append((b, -lr * gg * filt[k][j].T[c]))
    for b, d in change:
        for h in (0, 1):
            np.add.at(state.emb[h], b[:, h], d)
    grads[-1][:-1], grads[-1][-1] = error @ value, error.sum()
    for p, v, g in zip(state.dense, state.speed, grads, strict=True):
        v *= 0.9
        v -= 0.1 * lr * g
        p += v


def start(seen: np.ndarray, toxic: np.ndarray, rate: float, n: int, s: Settings) -> State:
    """Embeddings and filters before training, from the rows of each bucket and the toxic ones among them, (2, buckets).

    The counts are scaled down to one shard's before. Deviations of all rows would grow with the root of their
    number until any common word stands out, and the first steps would then push every filter below 0 for good.
    """
    rng, size = np.random.default_rng(s.seed), 1 << s.bucket_bits
    seen, toxic = (x * min(1.0, s.shard_rows / max(n, 1)) for x in (seen, toxic))
    signal = (toxic - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 4)
    emb = rng.normal(0, 0.05, (2, size, s.dims))
    emb[:, :, 0] = np.clip(signal, -8, 8) / 8
    filt = [rng.normal(0, 0.2, (w, s.dims, s.filters)) for w in s.widths]
    for f in filt:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 1 / len(f)
    dense = [*filt, *(np.full(s.filters, -0.3) for _ in s.widths), np.append(np.full(2 * len(s.widths) * s.filters, 0.3), np.log(rate / (1 - rate)))]
    return State(emb, dense, [np.zeros_like(p) for p in dense])


def pieces(shard: int, n: np.ndarray, v: np.ndarray) -> Iterator[tuple]:
    """Rows of PIECES: buckets' weights and values, PIECE buckets each."""
    for i in range(0, len(n), PIECE):
        if n[i : i + PIECE].any():
            yield i // PIECE, shard, n[i : i + PIECE].astype(np.float32).tobytes(), v[i : i + PIECE].astype(np.float32).tobytes()


def totals(parts: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By piece the sums of n and v over all shards, added up by Spark in the shards' order."""
    def add(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["shard", "n", "v"], kind="stable")
        n, v = (sum(np.frombuffer(x, np.float32).astype(float) for x in t[c]) for c in ("n", "v"))
        return pd.DataFrame([(t["piece"].iloc[0], n.tobytes(), v.tobytes())], columns=["piece", "n", "v"])

    got = parts.groupBy("piece").applyInPandas(add, "piece int, n binary, v binary").collect()  # the size of the parameters
    return {r["piece"]: (np.frombuffer(r["n"]), np.frombuffer(r["v"])) for r in got}


def counted(train: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """seen and toxic, (2, buckets): in how many training rows a bucket stands, and in how many toxic ones."""
    size = 1 << s.bucket_bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, toxic = np.zeros(2 * size), np.zeros(2 * size)
        for batch in batches:
            for words, label in zip(batch["words"], batch["label"], strict=True):
                both, _ = decoded([words], s)
                for h in (0, 1):
                    u = np.unique(both[:, h]) + h * size
                    seen[u] += 1
                    toxic[u] += label
        yield pd.DataFrame(list(pieces(0, seen, toxic)), columns=["piece", "shard", "n", "v"])

    seen, toxic = np.zeros(2 * size), np.zeros(2 * size)
    for i, (n, v) in totals(train.mapInPandas(run, PIECES)).items():
        seen[i * PIECE : i * PIECE + len(n)], toxic[i * PIECE : i * PIECE + len(v)] = n, v
    return seen.reshape(2, size), toxic.reshape(2, size)


def epoch(train: DataFrame, state: State, s: Settings, lr: float) -> State:
    """Every shard trains from state on its rows, in their order; the changes' means make the next state."""
    held, size = train.sparkSession.sparkContext.broadcast(state), 1 << s.bucket_bits

    def done(shard: int, now: State) -> pd.DataFrame:
        change = (now.emb - held.value.emb).reshape(2 * size, -1)
        touched = change.any(axis=1)
        rows = list(pieces(shard, touched, change))
        flat = np.concatenate([p.ravel() for p in [*now.dense, *now.speed]])
        return pd.DataFrame([*rows, (-1, shard, np.ones(1, np.float32).tobytes(), flat.astype(np.float32).tobytes())], columns=["piece", "shard", "n", "v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, None
        for batch in batches:
            for shard, part in batch.groupby("shard", sort=False):
                if shard != at:
                    if now is not None:
                        yield done(at, now)
                    old = held.value
                    at, now = shard, State(old.emb.copy(), [p.copy() for p in old.dense], [p.copy() for p in old.speed])
                for i in range(0, len(part), s.batch):
                    few = part.iloc[i : i + s.batch]
                    step(now, *decoded(few["words"].tolist(), s), few["label"].to_numpy(float), s, lr)
        if now is not None:
            yield done(at, now)

    got = totals(train.mapInPandas(run, PIECES))
    n, flat = got.pop(-1)
    flat, shapes, at = flat / n[0], [p.shape for p in [*state.dense, *state.speed]], 0
    fresh = []
    for shape in shapes:
        fresh.append(flat[at : at + int(np.prod(shape))].reshape(shape))
        at += int(np.prod(shape))
    emb = state.emb.reshape(2 * size, -1).copy()
    for i, (n, v) in got.items():
        emb[i * PIECE : i * PIECE + len(n)] += v.reshape(len(n), -1) / np.maximum(n, 1)[:, None]
    held.unpersist()
    return State(emb.reshape(state.emb.shape), fresh[: len(state.dense)], fresh[len(state.dense) :])


def calibrate(model: Model, rest: DataFrame, s: Settings, bins: int = 1 << 16) -> Model:
    """middle, slope and languages' thresholds from all rows left out of training, counted by language and fine steps of the score."""
    held = rest.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                few = batch.iloc[i : i + 1024]
                z = features(held.value, *decoded(few["words"].tolist(), s)) @ held.value.out[:-1] + held.value.out[-1]
                yield pd.DataFrame({"lang": few["lang"].to_numpy(), "label": few["label"].to_numpy(), "z": z.astype(float)})

    z = written(rest.mapInPandas(run, "lang string, label double, z double"), "toxic-calibration")
    all_ = z.agg(F.count("*").alias("n"), F.sum("label").alias("hits"), F.min("z").alias("low"), F.max("z").alias("high"), F.stddev_pop("z").alias("spread")).first()
    if not all_["n"] or not 0 < all_["hits"] < all_["n"]:
        return model
    width = (all_["high"] - all_["low"]) / bins or 1.0
    got = z.groupBy("lang", F.floor((F.col("z") - all_["low"]) / width).alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("hits")).toPandas()  # bounded by languages and bins
    at = lambda t: (all_["low"] + (t["bin"].to_numpy(float) + 0.5) * width, t["n"].to_numpy(float), t["hits"].to_numpy(float))
    model.middle = best_cut(*at(got.groupby("bin", as_index=False)[["n", "hits"]].sum()))
    model.slope = 2 / (all_["spread"] or 1.0)
    for lang, own in got[got["lang"].fillna("") != ""].groupby("lang"):
        if own["n"].sum() >= s.least_rows and own["hits"].sum() > 0:
            values, n, hits = at(own)
            model.thresholds[lang] = best_cut(scaled(model, values), n, hits)
    return model


def scaled(model: Model, z: np.ndarray) -> np.ndarray:
    return sigmoid(model.slope * (z - model.middle) + np.log(CUT / (1 - CUT)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    """A model of label_col from all labelled rows that aren't held out: three quarters of their ids train, the rest calibrate.

    Of several labels of an id the largest counts. Labels and texts that aren't held out are dealt to shards
    together, a task a shard, so that no text is exchanged twice; labelled rows are encoded there and written.
    """
    s = settings
    named = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    if s.training_rows is not None:
        share = min(1.0, s.training_rows / max(named.count(), 1))
        named = named.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    draw = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    texts = docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [buckets_of([t], s.bucket_bits)[0].astype(code_type(s)).tobytes() for t in batch["text"]]
            yield batch.drop(columns="text").assign(words=words)

    n = named.count()
    shards = max(1, min(s.max_shards, n // s.shard_rows), -(-n // s.most_rows))
    both = texts.unionByName(named, allowMissingColumns=True).select("*", draw(4, 1).alias("part"), draw(shards, 2).alias("shard"), F.xxhash64("id", F.lit(3)).alias("place"))
    of_id = Window.partitionBy("shard", "place", "id")
    rows = both.repartitionById(shards, F.col("shard")).withColumn("label", F.max("label").over(of_id)).filter("label is not null and text is not null")
    coded = rows.select("label", "lang", "text", "part", "shard", "place").mapInPandas(encode, "label double, lang string, part int, shard int, place long, words binary")
    coded = written(coded.sortWithinPartitions("shard", "place", "words", "label"), "toxic-rows")
    train, rest = coded.filter("part <> 3").select("shard", "label", "words"), coded.filter("part = 3").select("lang", "label", "words")
    sizes = coded.agg(F.count("*").alias("n"), F.sum("label").alias("hits"), F.count_if(F.col("part") != 3).alias("train"), F.sum(F.when(F.col("part") != 3, F.col("label"))).alias("train_hits")).first()
    if not sizes["train"] or not 0 < sizes["hits"] < sizes["n"]:
        return Model(s, [[(np.zeros((1 << s.bucket_bits, s.filters), np.float32),) * 2] * w for w in s.widths], [np.zeros(s.filters, np.float32)] * len(s.widths), np.zeros(2 * len(s.widths) * s.filters + 1, np.float32), middle=2.0)
    state = start(*counted(train, s), min(max(sizes["train_hits"] / sizes["train"], 1e-3), 1 - 1e-3), sizes["train"], s)
    for i in range(s.epochs):
        state = epoch(train, state, s, s.rate / (1 + i))
    filt, bias = state.dense[: len(s.widths)], state.dense[len(s.widths) : -1]
    tables = [[tuple((e @ f[k]).astype(np.float32) for e in state.emb) for k in range(len(f))] for f in filt]
    return calibrate(Model(s, tables, [b.astype(np.float32) for b in bias], state.dense[-1].astype(np.float32)), rest, s)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every whole text; a null text is empty, and an empty one gets the score of no evidence.

    Rows are independent of each other, repeated ones included; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": scaled(held.value, logits(held.value, batch["text"].tolist()))})

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInPandas(run, f"id {kind}, score double")
