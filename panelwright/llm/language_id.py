"""Language ID by language-bitmask n-gram filters.

A filter is a Bloom filter whose slots hold one bit a language: looking an n-gram up means
reading a few slots and and-ing them, which gives all languages that have it at once. A
document's n-grams are counted by language (a popcount of each bit plane), the counts are
corrected for the filter's false positives, which the fill of each bit plane gives, and the
largest share decides. The n-grams of a language are learned from labelled rows: those that
are about as frequent there as anywhere else. The filter has a fixed size, so what is sent
to the executors does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_scan, held_out, row_number, text_of, without_rows, written

#: Languages of one mask word; a slot has as many words as the languages need.
WORD_BITS = 64
#: Ways over which the choice of a language's n-grams is spread.
SPREAD = 64
SLICE_CHARS = 1_000_000
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass(frozen=True)
class Settings:
    """Bounds of learning: labelled rows of a language (expected; all of a language that has fewer), n-grams of a language, slots of the filter (a power of two).

    An n-gram belongs to a language if it was seen `least_count` times there and its
    rate is at least `share` of its highest rate in any language; of more than `grams`
    the most frequent stay. The filter takes 8 bytes a slot for every 64 languages.
    """

    training_rows: int = 5_000
    grams: int = 30_000
    slot_bits: int = 20
    least_count: int = 3
    share: float = 0.4


@dataclass(frozen=True)
class Model:
    """slots is (words, slots): language i is bit i % 64 of word i // 64."""

    languages: list[str]
    slots: np.ndarray
    fallback: int

    @property
    def false_rates(self) -> np.ndarray:
        fill = [bit_of(self.slots, i).mean() for i in range(len(self.languages))]
        return np.array(fill) ** len(MULTIPLIERS)


def bit_of(words: np.ndarray, i: int) -> np.ndarray:
    return (words[i // WORD_BITS] >> np.uint64(i % WORD_BITS)) & np.uint64(1)


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lower-case trigrams of all texts, and the number of the text of each.

    Runs of other characters count as one space; a trigram never spans two texts.
    """
    low = [t.lower() + " " for t in texts]
    chars = np.frombuffer("".join(low).encode("utf-32-le"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = letter_table()[chars]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    chars, doc, letter = chars[keep], doc[keep], letter[keep]
    chars = np.where(letter, chars, 32).astype(np.int64)
    if len(chars) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys = chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]
    inside = doc[:-2] == doc[2:]
    return keys[inside], doc[:-2][inside]


def slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about SLICE_CHARS in all, with the place of the first."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
            chars += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def slots_of(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    mixed = keys.astype(np.uint64)
    mixed ^= mixed >> np.uint64(29)
    for m in MULTIPLIERS:
        yield (mixed * np.uint64(m)) >> np.uint64(64 - bits)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model:
    """The filter of the languages in lang_col, from labelled rows that aren't held out.

    Of a language with more than settings.training_rows labelled rows those whose hashed
    id is small enough are taken, that many in expectation, whole texts of them. The
    driver gets one row a language and settings.grams n-grams of each.
    """
    named = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = named.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    by_lang = written(labelled.groupBy("lang").count(), "languages")
    counts = by_lang.orderBy("lang").collect()
    languages = [r["lang"] for r in counts]
    slots = np.zeros((-(-len(languages) // WORD_BITS), 1 << settings.slot_bits), dtype=np.uint64)
    if not languages:
        return Model([], slots, 0)
    share = by_lang.select("lang", F.least(F.lit(1.0), settings.training_rows / F.col("count")).alias("share"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = labelled.join(F.broadcast(share), "lang").filter(drawn)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for _, part in slices(texts.tolist()):
                    keys, n = np.unique(trigrams(part)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": keys, "n": n})

    grams = sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = written(grams, "grams")
    rated = grams.join(F.broadcast(grams.groupBy("lang").agg(F.sum("n").alias("all"))), "lang").withColumn("rate", F.col("n") / F.col("all"))
    best = F.max("rate").over(Window.partitionBy("gram"))
    top = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "gram")) <= settings.grams
    chosen = (
        rated.withColumn("best", best).filter((F.col("n") >= settings.least_count) & (F.col("rate") >= settings.share * F.col("best")))
        .select("lang", "gram", "n", F.pmod(F.xxhash64("gram"), F.lit(SPREAD)).alias("part"))
        .withColumn("near", top("part")).filter("near").withColumn("in", top()).filter("in").select("lang", "gram")
    )
    bounded = chosen.toPandas()  # at most languages * settings.grams rows
    for i, lang in enumerate(languages):
        keys = bounded.loc[bounded["lang"] == lang, "gram"].to_numpy(dtype=np.int64)
        for slot in slots_of(keys, settings.slot_bits):
            slots[i // WORD_BITS, slot] |= np.uint64(1 << i % WORD_BITS)
    return Model(languages, slots, max(range(len(counts)), key=lambda i: (counts[i]["count"], -i)))


def popcounts(model: Model, texts: list[str]) -> np.ndarray:
    """Corrected hits by text and language, and in the last column the number of trigrams."""
    out = np.zeros((len(texts), len(model.languages) + 1))
    bits = model.slots.shape[1].bit_length() - 1
    false = model.false_rates
    for at, part in slices(texts):
        keys, doc = trigrams(part)
        mask = None
        for slot in slots_of(keys, bits):
            mask = model.slots[:, slot] if mask is None else mask & model.slots[:, slot]
        n = np.bincount(doc, minlength=len(part))
        out[at : at + len(part), -1] = n
        for i in range(len(model.languages)):
            hits = np.bincount(doc, weights=bit_of(mask, i).astype(float), minlength=len(part))
            out[at : at + len(part), i] = np.clip((hits - n * false[i]) / max(1e-9, 1 - false[i]), 0, n)
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and coverage of every document, by its whole text alone.

    `und` (score 0) for a null text, one without a letter, and if nothing was learned.
    score is the language's share of all corrected hits, coverage its hits among all
    n-grams; a text that hits nothing gets the most frequent learned language, score 0.
    Repeated rows are rows of their own; a very long text is counted whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            counts = popcounts(m, batch["text"].tolist()) if m.languages else np.zeros((len(batch), 1))
            hits, n = counts[:, :-1], counts[:, -1]
            best = hits.argmax(1) if m.languages else np.zeros(len(batch), int)
            most, every = (hits.max(1), hits.sum(1)) if m.languages else (n, n)
            best = np.where(most > 0, best, m.fallback)
            lettered = batch["lettered"].to_numpy(dtype=bool) & bool(m.languages)
            yield pd.DataFrame({
                "id": batch["id"],
                "lang_pred": names[np.where(lettered, best, -1)],
                "score": np.where(lettered & (every > 0), most / np.maximum(every, 1e-9), 0.0),
                "coverage": np.where(lettered & (n > 0), most / np.maximum(n, 1), 0.0),
            })

    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), text.rlike(r"\p{L}").alias("lettered")).mapInPandas(run, f"id {kind}, lang_pred string, score double, coverage double")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows of no known language: undetermined, or hitting no learned n-gram."""
    docs = as_scan(docs)
    rows = docs.select(row_number(docs).alias("number"), F.col(text_col).alias("words"))
    gone = predict(rows, learn(docs, id_col, text_col, lang_col), "number", "words").filter((F.col("lang_pred") == "und") | (F.col("score") == 0))
    return without_rows(docs, gone.select("id"))
