"""Context-triggered piecewise hashing of documents and their likeness.

A rolling hash over seven bytes marks the ends of chunks: at block size b = 3 * 2**k where
it is -1 modulo b. Every chunk becomes one of 64 letters, so an edit changes the letters
near it only. b starts from the length (some LETTERS / 2 to LETTERS chunks); it rises while
a text has more than MOST chunks and falls while it has fewer than LEAST, so that every
chunk of a text is in its fingerprint. A fingerprint is "b:letters at b:letters at 2b", and
two fingerprints are compared by edit distance at the block sizes that both have (Spark's
levenshtein; nothing is compared in Python).

To pair each document with the next one in descending order, rows are dealt by (id, row)
into ranges, even up to the error of a sample, and the first row of each range goes to the range before as well, so that
whole texts cross the network once and no task sees more than its range.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_scan, row_number, shuffle_width, text_of

WINDOW, LEAST_BLOCK, LETTERS, LEAST, MOST = 7, 3, 64, 16, 256
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
#: Rows sampled for each range; they only set where ranges begin.
SAMPLED = 100
#: Bytes that the rolling hash handles at a time.
BLOCK = 1 << 20


def rolling(data: np.ndarray) -> np.ndarray:
    """uint32 hash of the seven bytes up to each position: sum, weighted sum and shifted xor."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint8), data]).astype(np.uint32)
    n = len(data)
    total, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for age in range(WINDOW):
        c = padded[WINDOW - 1 - age : WINDOW - 1 - age + n]
        total += c * np.uint32(1 + WINDOW - age)
        shifted ^= c << np.uint32(5 * age)
    return total + shifted


def letters(mixed: np.ndarray, ends: np.ndarray) -> str:
    """One letter a chunk; the last chunk runs to the end of the text."""
    starts = np.concatenate([[0], ends + 1])
    starts = starts[starts < len(mixed)]
    sums = np.add.reduceat(mixed, starts) * np.uint64(0x9E3779B97F4A7C15)
    return ALPHABET[(sums >> np.uint64(58)).astype(np.intp)].tobytes().decode()


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text; equal texts have equal ones. The empty text's is "3::".

    Memory is some 30 bytes for each byte of the text.
    """
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(data):
        return f"{LEAST_BLOCK}::"
    hashes = np.concatenate([rolling(data[max(0, i - WINDOW + 1) : i + BLOCK])[min(i, WINDOW - 1) :] for i in range(0, len(data), BLOCK)])
    level = hashes.astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(level % np.uint64(LEAST_BLOCK) == 0)
    level = (level[at] // np.uint64(LEAST_BLOCK)).astype(np.int64)
    halvings = np.frexp((level & -level).astype(np.float64))[1] - 1  # how often 2 divides a level
    ends = np.cumsum(np.bincount(halvings, minlength=33)[::-1])[::-1]  # by i: chunk ends at block size 3 * 2**i
    k = max(0, -(-len(data) // (LETTERS * LEAST_BLOCK)) - 1).bit_length()
    while ends[k] > MOST:
        k += 1
    while k and ends[k] < LEAST and ends[k - 1] <= MOST:
        k -= 1
    mixed = (hashes ^ (hashes >> np.uint32(15))).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return f"{LEAST_BLOCK << k}:{letters(mixed, at[level % (1 << k) == 0])}:{letters(mixed, at[level % (2 << k) == 0])}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, 0 where the block sizes differ by more than a factor of two."""
    def part(x: Column, i: int) -> Column:
        return F.split_part(x, F.lit(":"), F.lit(i))

    def same(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)

    size_a, size_b = part(a, 1).cast("long"), part(b, 1).cast("long")
    return (
        F.when(a == b, F.lit(1.0))
        .when(size_a == size_b, F.greatest(same(part(a, 2), part(b, 2)), same(part(a, 3), part(b, 3))))
        .when(size_a == 2 * size_b, same(part(a, 2), part(b, 3)))
        .when(size_b == 2 * size_a, same(part(a, 3), part(b, 2)))
        .otherwise(F.lit(0.0))
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every document; null counts as the empty text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "fingerprint": [fingerprint(t) for t in batch["text"]]})

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInPandas(run, f"id {kind}, fingerprint string")


def in_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """range, extra, id, row, text: dealt and sorted by descending id, each range ending with the next one's first row."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    docs = as_scan(docs)
    rows = docs.select(F.col(id_col).alias("id"), row_number(docs).alias("row"), text_of(text_col).alias("text"))
    keys = rows.select("id", "row")
    every = max(1, keys.count() // (SAMPLED * width))
    drawn = keys.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).orderBy(F.desc_nulls_last("id"), "row").collect()  # some SAMPLED a range
    cuts = [(r["id"], r["row"]) for r in drawn[SAMPLED::SAMPLED]]
    kind = docs.schema[id_col].dataType.simpleString()
    edges = F.from_json(F.lit(json.dumps([{"id": None if i is None else str(i), "row": r} for i, r in cuts])), "array<struct<id:string,row:bigint>>")
    edges = F.transform(edges, lambda x: F.struct(x.id.cast(kind).alias("id"), x.row.alias("row")))
    # a row lies behind a cut if its id comes later, null last of all, or is the same and its row is not smaller
    behind = lambda x: F.coalesce(F.col("id") < x.id, F.col("id").isNull() & x.id.isNotNull(), F.lit(False)) | (F.col("id").eqNullSafe(x.id) & (F.col("row") >= x.row))
    place = F.size(F.filter(edges, behind))
    rows, keys = rows.withColumn("range", place), keys.withColumn("range", place)
    first = lambda x: F.min(F.when(x, F.col("row")))
    largest = keys.groupBy("range").agg(F.max("id").alias("top"))
    heads = {
        r["range"]: r["first"]  # as many rows as ranges
        for r in keys.join(F.broadcast(largest), "range").groupBy("range").agg(F.coalesce(first(F.col("id") == F.col("top")), first(F.col("top").isNull())).alias("first")).collect()
    }
    order = sorted(heads)
    sent = [(heads[r], order[i - 1]) for i, r in enumerate(order)] or [(-1, 0)]  # the first one's head follows the last
    to = spark.createDataFrame(sent, "row long, to int")
    dealt = rows.join(F.broadcast(to), "row", "left").withColumn(
        "go", F.explode(F.when(F.col("to").isNull(), F.array("range")).otherwise(F.array("range", F.lit(-1))))
    )
    extra = F.col("go") < 0
    return (
        dealt.select(F.when(extra, F.col("to")).otherwise(F.col("range")).alias("range"), extra.alias("extra"), "id", "row", "text")
        .repartitionById(len(cuts) + 1, "range")
        .sortWithinPartitions("range", "extra", F.col("id").desc_nulls_last(), "row")
    )


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint.

    The edited text has its last third (whole code points) replaced by as many from the
    start of the next document, in descending order of id (of any type that sorts); the
    last is followed by the first, a document alone by itself. Null ids come last,
    repeated ids stand in row order. Null counts as empty; other columns are ignored. An
    empty table gives an empty result; a task holds two texts and their batch.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for range_, extra, id_, text in zip(batch["range"], batch["extra"], batch["id"], batch["text"], strict=True):
                own = fingerprint(text)
                if held and held[0] == range_:
                    _, was_id, was, was_print = held
                    n = len(was)
                    edited = was[: n - n // 3] + text[: n // 3]
                    out.append((was_id, n, hashlib.sha256(edited.encode()).hexdigest(), was_print, fingerprint(edited), own))
                held = None if extra else (range_, id_, text, own)
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])

    # ids pass through Python as text: pandas would make floats of numbers with nulls
    kind = docs.schema[id_col].dataType.simpleString()
    return in_ranges(docs, id_col, text_col).select("range", "extra", F.col("id").cast("string").alias("id"), "text").mapInPandas(
        run, "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    ).withColumn("id", F.col("id").cast(kind))
