"""Byte-level BPE by a segment tree over adjacent pair ranks.

A leaf holds rank * leaves + position of the pair that starts there (or a large number if
the pair never merges), so the root is the leftmost pair of the lowest rank. A merge
updates three leaves and their ancestors: logarithmic in the word's length. The words of
a batch that are not in the cache are merged side by side in numpy, grouped by the size
of their trees; a word too long for that gets a tree of its own, so a pre-token of a
million characters takes n log n steps.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Words that a worker keeps, and code points of text that it handles at a time.
CACHE_WORDS, SLICE_CHARS = 250_000, 1_000_000
NEVER = np.int64(2**62)
#: Trees of up to so many leaves are merged side by side, so many words at a time.
SIDE_BY_SIDE, ROWS = 64, 2048
# Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def char_class(kind: str) -> str:
    """The ranges of the Basic Multilingual Plane whose general category starts with kind."""
    hit = [unicodedata.category(chr(c))[0] == kind for c in range(0x10000)] + [False]
    edges = [c for c in range(0x10001) if hit[c] != (c > 0 and hit[c - 1])]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


def fast_pattern() -> re.Pattern:
    """PATTERN for texts without code points above U+FFFF, on the quicker engine."""
    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    letter, number = char_class("L"), char_class("N")
    return re.compile(
        PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    )


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

#: Ids that are handed to Spark at a time (a single document may have more).
FRAME_IDS = 500_000


class Tokenizer:
    """From the bytes of a vocabulary file of the tokenizers library."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        to_byte = {c: b for b, c in enumerate(chars)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.base = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.width = max(vocab.values()) + 1
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], dtype=np.int64)
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], NEVER), np.append(order, -1)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max(self.width, *(i + 1 for i in self.special.values())) if self.special else self.width
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.fast, self.full = fast_pattern(), regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: word -> its ids
        self.cache: dict[str, tuple[int, ...]] = {}

    def words(self, text: str) -> list[str]:
        if self.split and any(s in text for s in self.special):
            return list(chain.from_iterable([x] if x in self.special else self.words(x) for x in self.split.split(text) if x))
        wide = len(text.encode("utf-16-le")) != 2 * len(text)
        return (self.full if wide else self.fast).findall(text)

    def learn(self, words: set[str]) -> None:
        """Put words into the cache."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            if w in self.special:
                self.cache[w] = (self.special[w],)
                continue
            b = w.encode()
            by_size.setdefault(1 << max(1, (len(b) - 1).bit_length()), []).append((w, b))
        for leaves, group in by_size.items():
            if leaves > SIDE_BY_SIDE:
                for w, b in group:
                    self.cache[w] = self.merge_one(b)
                continue
            for at in range(0, len(group), ROWS):
                part = group[at : at + ROWS]
                for (w, _), ids in zip(part, self.merge_many([b for _, b in part], leaves), strict=True):
                    self.cache[w] = ids

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, leaves: int) -> np.ndarray:
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, NEVER - 1)
        i = np.searchsorted(self.keys, key)
        return np.where(self.keys[i] == key, self.ranks[i] * leaves + at, NEVER)

    def merge_many(self, words: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        """Ids of words of up to `leaves` bytes: one tree a row, all rows a merge at a time."""
        n, length = len(words), np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        column = np.arange(leaves)
        inside = column < length[:, None]
        sym = np.full((n, leaves + 1), -1, dtype=np.int64)  # one more column: what lies beyond the end
        sym[:, :leaves][inside] = self.base[flat]
        after = np.tile(np.arange(1, leaves + 2), (n, 1))
        after[:, leaves] = leaves
        before = np.tile(np.arange(-1, leaves), (n, 1))  # -1 is the column beyond, too
        tree = np.full((n, 2 * leaves), NEVER)
        tree[:, leaves:] = self.leaf(sym[:, :-1], sym[:, 1:], column, leaves)
        width = leaves
        while width > 1:
            half = width // 2
            tree[:, half:width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width = half
        row = np.flatnonzero(tree[:, 1] < NEVER)
        while row.size:
            rank, p = np.divmod(tree[row, 1], leaves)
            q = after[row, p]
            r = after[row, q]
            sym[row, p], sym[row, q] = self.made[rank], -1
            after[row, p], before[row, r] = r, p
            o = before[row, p]
            tree[row, leaves + p] = self.leaf(sym[row, p], sym[row, r], p, leaves)
            tree[row, leaves + q] = NEVER
            left = self.leaf(sym[row, o], sym[row, p], o, leaves)
            tree[row, leaves + np.maximum(o, 0)] = np.where(o >= 0, left, tree[row, leaves])
            for node in (leaves + p, leaves + q, leaves + np.maximum(o, 0)):
                while node[0] > 1:  # all nodes are on one level
                    node = node >> 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            row = row[tree[row, 1] < NEVER]
        kept = sym[:, :-1] >= 0
        ids, ends = sym[:, :-1][kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def merge_one(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word of any length, with a tree of its own."""
        sym = self.base[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, leaves, width, rank_of, never = len(sym), 1 << (len(sym) - 1).bit_length(), self.width, self.rank_of, int(NEVER)
        made = self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(p: int) -> int:
            if p < 0 or after[p] >= n:
                return never
            rank = rank_of.get(sym[p] * width + sym[after[p]], -1)
            return rank * leaves + p if rank >= 0 else never

        tree = [never] * leaves + [leaf(p) for p in range(n)] + [never] * (leaves - n)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] < never:
            rank, p = divmod(tree[1], leaves)
            q = after[p]
            r = after[q]
            sym[p], sym[q], after[p] = int(made[rank]), -1, r
            if r < n:
                before[r] = p
            for at, value in ((p, leaf(p)), (q, never), (before[p], leaf(before[p]))):
                if at < 0:
                    continue
                node = leaves + at
                tree[node] = value
                while node > 1:
                    node >>= 1
                    value = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == value:
                        break
                    tree[node] = value
        return tuple(s for s in sym if s >= 0)

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Each text's ids."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
                chars += len(texts[end])
                end += 1
            words, new = [self.words(t) for t in texts[at:end]], set()
            for w in words:
                new.update(set(w).difference(self.cache))
            if len(self.cache) + len(new) > CACHE_WORDS:  # what is frequent is in this slice, too
                used = set().union(*words) - new
                self.cache = {w: self.cache[w] for w in used}
            self.learn(new)
            for w in words:
                yield list(chain.from_iterable(map(self.cache.__getitem__, w)))
            at = end

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def vocabulary(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """The bytes of a vocabulary file (some MB), read by the driver from its disk or from any store that Spark reads."""
    if "://" in path:
        return spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def tokenizer(held: Broadcast[bytes]) -> Tokenizer:
    """The worker's tokenizer of this vocabulary, made once a process."""
    made = sys.modules[__name__].__dict__.setdefault("_made", {})
    key = hashlib.sha256(held.value).digest()
    if key not in made:
        made[key] = Tokenizer(held.value)
    return made[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of every document; null and empty texts have no ids. Repeated rows are rows of their own."""
    kind, held = docs.schema[id_col].dataType.simpleString(), vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(held)
        for batch in batches:
            start, out, size = 0, [], 0
            for i, ids in enumerate(t.encode_batch(batch["text"].tolist()), 1):
                out.append(np.array(ids, np.int32))
                size += len(ids)
                if size >= FRAME_IDS or i == len(batch):
                    yield pd.DataFrame({"id": batch["id"].iloc[start:i], "ids": pd.Series(out, index=batch.index[start:i], dtype=object)})
                    start, out, size = i, [], 0

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; null ids are none."""
    kind, held = encoded.schema[id_col].dataType.simpleString(), vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(held)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": [t.decode(x if x is not None else ()) for x in batch["ids"]]})

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, f"id {kind}, text string")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every document, without moving its ids.

    Each text is encoded and its ids are decoded again. Null counts as empty; repeated
    rows are rows of their own; other columns are ignored.
    """
    kind, held = docs.schema[id_col].dataType.simpleString(), vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(held)
        for batch in batches:
            out = []
            for ids in t.encode_batch(batch["text"].tolist()):
                out.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids).encode()).hexdigest()))
            frame = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=batch.index)
            yield frame.assign(id=batch["id"])[["id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInPandas(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
