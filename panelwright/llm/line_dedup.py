"""Line dedup by a sharded minimal perfect hash over the distinct line hashes.

A line's key is hashed to 128 bits. Keys are counted once, map side first, and dealt to
shards by the top of their hash. Each shard builds a minimal perfect hash of its keys: levels of
bits in which a key is placed where no other key of the level falls, so that the rank of
its bit is its place. The places index two arrays, 32 bits of fingerprint and a count of
documents, and the ids that keep a repeated line stand in order of place. About nine bytes a key.

Documents don't join lines: their hashes stream past the arrays of their shard and ask
for count and keeper. Keys that hold more than a HEAVY-th of all these questions, of
which there are at most HEAVY, are answered by broadcast before, so shards stay even
whatever a single line's share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_scan, row_number, shuffle_width, text_of, written

#: Keys of fewer code points never count as repeated; keys in so many documents do.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys a shard, on average, and shards a task at least, so that a small table is spread, too.
SHARD_KEYS, SHARDS_A_TASK = 1 << 15, 4
#: At most so many keys are answered by broadcast: those with more than this part of all questions.
HEAVY = 4096
#: Bits a key in each level of the perfect hash, and levels before the rest is listed.
ROOM, LEVELS = 1.6, 40
SPACES = b" \t\n\x0b\x0c\r"
ODD = 0x9E3779B97F4A7C15


def mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """64 well mixed bits of a key's two halves, other ones at every level."""
    x = h1 ^ (h2 + np.uint64(ODD * (level + 1) % 2**64))
    for shift, by in ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB))):
        x = (x ^ (x >> shift)) * by
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Places 0 to n - 1 of n distinct keys."""

    def __init__(self, sizes: list[int], words: np.ndarray, rest1: np.ndarray, rest2: np.ndarray):
        """sizes: bits of each level; words: the bits of all levels; rest: the keys that no level places, sorted."""
        self.sizes, self.words, self.rest1, self.rest2 = sizes, words, rest1, rest2
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(h1) and len(sizes) < LEVELS:
            bits = -(-max(64, int(len(h1) * ROOM)) // 64) * 64
            at = (mixed(h1, h2, len(sizes)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(bits)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        order = np.lexsort((h2, h1))
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64), h1[order], h2[order])

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each key; for a key that was not among those hashed, some place or -1."""
        out, open_, start = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, bits in enumerate(self.sizes):
            if not len(open_):
                return out
            at = (mixed(h1[open_], h2[open_], level) % np.uint64(bits)).astype(np.int64) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[here]] = (self.before[at >> 6] + below)[here]
            open_, start = open_[~here], start + bits
        listed = {k: i for i, k in enumerate(zip(self.rest1.tolist(), self.rest2.tolist(), strict=True))}
        for i in open_.tolist() if listed else ():
            out[i] = self.before[-1] + listed[k] if (k := (int(h1[i]), int(h2[i]))) in listed else -1
        return out


def key_of(line: bytes) -> bytes:
    return line.strip(SPACES).lower()  # bytes.lower() changes A to Z alone


def long_enough(key: bytes, least: int) -> bool:
    """Code points are the bytes that continue none."""
    return len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)


def line_keys(rows: DataFrame, least_chars: int) -> DataFrame:
    """row, id, h1, h2 and the places of its lines, for every distinct key of every row's text."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, digests, places = [], [], []
            for i, text in enumerate(batch["text"]):
                found: dict[bytes, list[int]] = {}
                for place, line in enumerate(text.as_py().split(b"\n")):
                    key = key_of(line)
                    if long_enough(key, least_chars):
                        found.setdefault(key, []).append(place)
                for key, where in found.items():
                    at.append(i)
                    digests.append(hashlib.blake2b(key, digest_size=16).digest())
                    places.append(where)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            picked = batch.select(["row", "id"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(places, pa.list_(pa.int32()))], ["row", "id", "h1", "h2", "places"])

    return rows.mapInArrow(run, f"row long, id {kind}, h1 long, h2 long, places array<int>")


def unsigned(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).astype(np.int64, copy=False).view(np.uint64)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def index_shards(counts: DataFrame, least_docs: int) -> DataFrame:
    """One row a shard: the perfect hash of its keys, their fingerprints and counts, and the keepers of repeated keys in order of place.

    A shard holds SHARD_KEYS keys on average, as hashes are even: a bounded group.
    """
    kind = counts.schema["keeper"].dataType.simpleString()

    def build(t: pa.Table) -> pa.Table:
        h1, h2, n = unsigned(t["h1"]), unsigned(t["h2"]), t["n"].to_numpy()
        index = PerfectHash.of(h1, h2)
        place = index.places(h1, h2)
        by_place = np.empty(len(place), np.int64)
        by_place[place] = np.arange(len(place))
        n = np.minimum(n[by_place], 2**32 - 1).astype(np.uint32)
        keepers = t["keeper"].combine_chunks().take(pa.array(by_place[n >= least_docs]))
        one = lambda x: pa.array([x])
        parts = [t["shard"].slice(0, 1).combine_chunks(), pa.array([index.sizes], pa.list_(pa.int64())), *map(one, map(packed, (index.words, index.rest1, index.rest2, h2[by_place].astype(np.uint32), n)))]
        return pa.table([*parts, pa.ListArray.from_arrays(pa.array([0, len(keepers)], pa.int32()), keepers)], ["shard", "sizes", "words", "rest1", "rest2", "prints", "counts", "keepers"])

    return counts.groupBy("shard").applyInArrow(build, f"shard long, sizes array<bigint>, words binary, rest1 binary, rest2 binary, prints binary, counts binary, keepers array<{kind}>")


def probed(lines: DataFrame, shards: DataFrame, least_docs: int) -> DataFrame:
    """row and places of the lines that go. Shard by shard, the arrays come first and the questions stream past them."""
    arrays = ["sizes", "words", "rest1", "rest2", "prints", "counts", "keepers"]
    asked = ["row", "id", "h1", "h2", "places"]
    as_null = lambda df, names: [F.lit(None).cast(df.schema[x].dataType).alias(x) for x in names]
    both = lines.select("shard", F.lit(1).alias("tag"), *asked, *as_null(shards, arrays)).unionByName(shards.select("shard", F.lit(0).alias("tag"), *as_null(lines, asked), *arrays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = prints = counts = keepers = rank = None
        for batch in batches:
            tag = batch["tag"].to_numpy()
            heads = np.flatnonzero(tag == 0).tolist()
            for at, end in zip([-1, *heads], [*heads, len(tag)], strict=True):
                if at >= 0:
                    head = {x: batch[x][at] for x in arrays}
                    word = lambda x, kind: np.frombuffer(head[x].as_py(), kind)  # noqa: B023, E731
                    index = PerfectHash(head["sizes"].as_py(), word("words", np.uint64), word("rest1", np.uint64), word("rest2", np.uint64))
                    prints, counts, keepers = word("prints", np.uint32), word("counts", np.uint32), head["keepers"].values
                    rank = np.cumsum(counts >= least_docs) - 1
                if at + 1 >= end:
                    continue
                some = batch.slice(at + 1, end - at - 1)
                h1, h2 = unsigned(some["h1"]), unsigned(some["h2"])
                place = index.places(h1, h2)
                if (place < 0).any() or (prints[place] != h2.astype(np.uint32)).any():
                    raise ValueError("a line that was not counted: the documents changed between two scans")
                often = np.flatnonzero(counts[place] >= least_docs)
                stays = keepers.take(pa.array(rank[place[often]])).to_pylist()
                goes = [i for i, own, keeper in zip(often.tolist(), some["id"].take(pa.array(often)).to_pylist(), stays, strict=True) if own != keeper]
                yield some.select(["row", "places"]).take(pa.array(goes, pa.int64()))

    dealt = both.repartition("shard").sortWithinPartitions("shard", "tag")
    return dealt.mapInArrow(run, "row long, places array<int>")


def repeated_lines(rows: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, heavy: int = HEAVY) -> DataFrame:
    """row and the places (from 0) of the lines that go, for rows (row, id, text as bytes) that lose any."""
    lines = written(line_keys(rows, least_chars), "lines")
    total = lines.count()
    n_shards = max(-(-total // SHARD_KEYS), SHARDS_A_TASK * shuffle_width(rows.sparkSession))
    shard = F.pmod(F.xxhash64("h1"), F.lit(n_shards)).alias("shard")
    counts = written(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).select(shard, "h1", "h2", "n", "keeper"), "line-counts")
    common = counts.filter(F.col("n") * heavy > total).select("h1", "h2", "keeper", (F.col("n") >= least_docs).alias("often"))  # fewer than `heavy` rows
    met = lines.join(F.broadcast(common), ["h1", "h2"], "left")
    answered = met.filter(F.col("often") & ~F.col("id").eqNullSafe(F.col("keeper"))).select("row", "places")
    questions = met.filter("often is null").select(shard, "row", "id", "h1", "h2", "places")
    gone = answered.unionByName(probed(questions, index_shards(counts, least_docs), least_docs))
    return gone.groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, heavy: int = HEAVY) -> DataFrame:
    r"""One row a document: row, id, n_lines, n_dropped and kept, the text that is left.

    Lines are what stands between \n; a null or empty text has one empty line. A key, the
    line stripped of [\x20\x09-\x0D] with A-Z lowered, of at least `least_chars` code
    points in at least `least_docs` documents stays in the largest id that holds it, with
    all its lines there. Every row is a document: repeated rows count each for itself, and
    all rows of the largest id keep the line. A null id is below any other; where all that
    hold a key have none, all keep it. An empty table gives an empty result, a very long
    text is one row like any other, and other columns of docs are ignored.
    """
    docs = as_scan(docs)
    rows = docs.select(row_number(docs).alias("row"), F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    met = rows.join(repeated_lines(rows, least_chars, least_docs, heavy), "row", "left")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, places in zip(batch["text"], batch["places"], strict=True):
                text, places = text.as_py(), places.as_py()
                n_lines.append(text.count(b"\n") + 1)
                n_dropped.append(len(places or ()))
                if places:
                    gone = set(places)
                    text = b"\n".join(line for i, line in enumerate(text.split(b"\n")) if i not in gone)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], ["row", "id", "n_lines", "n_dropped", "kept"])

    done = met.select("row", "id", "text", "places").mapInArrow(run, f"row long, id {kind}, n_lines long, n_dropped long, kept binary")
    return done.withColumn("kept", F.col("kept").cast("string"))
