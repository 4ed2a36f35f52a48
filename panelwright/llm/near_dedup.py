"""Near-dedup of documents on sets of word shingles.

Sketches are made by fast similarity sketching: in round i every shingle is hashed into a
random bin with value i + fraction, and bins keep their minimum; after `size` rounds of
random placement, round size + j fills bin j if it is still empty. Every coordinate is thus
filled, a set of n shingles costs about size * log(size) / n rounds, and the share of equal
coordinates of two sketches is concentrated about their Jaccard similarity at least as
well as with independent hashes.

1. Documents of equal word sequences are one class; its smallest id goes on.
2. Sketches are banded. Each bucket links its smallest member (by hash) to the others:
   a star, so a bucket of any size costs its size.
3. Star links are confirmed on the full sets of shingles, which are made once a document,
   and connected.
4. Buckets that still hold two or more components are open. In rounds, each draws another
   member, whose links with the other components are confirmed, for as long as a quarter
   of them hold. In a family of near copies most members are linked after a few rounds.
5. What is still open is compared in full, so that no link is lost. In small buckets
   pairs of different components are confirmed, as long as a document has few such
   partners. Large buckets, and the crowded documents of small ones, form arenas, each
   document once. One drops out if too few of its shingles are in any other component of
   the arena to be similar to anything there. The rest is compared in blocks of bounded
   size, but for blocks of the arena's largest component with each other; only confirmed
   links leave a task.

Costs: a small bucket of k members k * k / 2 pairs at most (k = 24: 276), an arena of m
documents of which r are not in its largest component r * (2m - r) / 256 copies of sets.

What is left to chance is only whether a pair falls into any common bucket: at the
threshold of 0.8, with 32 bands of 5, it does not once in 340,000 pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, as_scan, row_number, text_of, without_rows, written

WORDS = re.compile(WORD)
#: Buckets that may be broadcast at once, and the least size of such a bucket.
MOST_HOT, LEAST_HOT = 10_000, 128
#: Partners of one document that one task confirms, shingles of a block of documents, rounds of pivots.
PART, BLOCK_ITEMS, MOST_ROUNDS = 128, 1 << 20, 8


@dataclass(frozen=True)
class Settings:
    """similar is in percent; buckets of up to `small` members are paired directly but for documents of more than `crowd` partners; the rest in blocks of `block`."""

    words: int = 5
    similar: int = 80
    bands: int = 32
    rows: int = 5
    small: int = 24
    crowd: int = 64
    block: int = 256

    @property
    def size(self) -> int:
        return self.bands * self.rows


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer of x under a seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    """Words, with A to Z (the letters that bytes.lower knows) in lower case."""
    return WORDS.findall(text.encode().lower().decode())


def shingles(words: list[str], k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of k words; of the whole sequence if shorter; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    n = len(one) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = mix(out + one[i : i + n], i)
    return np.unique(out)


class WordHashes(dict):
    """64-bit hashes of the words seen by this worker, as many as MOST_WORDS."""

    MOST_WORDS = 250_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.MOST_WORDS:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return got


_hashes = WordHashes()
NEVER = np.uint64(2**64 - 1)


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches of several sets of hashes: uint64 of round and fraction by set and coordinate.

    The rounds run over all sets at once; a set leaves when all its coordinates are full.
    """
    out = np.full((len(sets), size), NEVER)
    flat = out.reshape(-1)
    which = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    for i in range(2 * size):
        if not len(items):
            break
        h = mix(items, i + 1)
        value = np.uint64(i << 48) | (h >> np.uint64(16))
        if i < size:
            bins = ((h & np.uint64(0xFFFF)) * np.uint64(size)) >> np.uint64(16)
            np.minimum.at(flat, which * size + bins.astype(np.int64), value)
        else:  # from here on round size + j places every item in bin j
            empty = out[which, i - size] == NEVER
            np.minimum.at(flat, which[empty] * size + (i - size), value[empty])
        open_ = (out == NEVER).any(1)[which]
        items, which = items[open_], which[open_]
    return out


def band_keys(coordinates: np.ndarray, s: Settings) -> np.ndarray:
    """Key of every band, by set."""
    table = coordinates.reshape(-1, s.bands, s.rows)
    key = np.tile(np.arange(s.bands, dtype=np.uint64), (len(table), 1))
    for j in range(s.rows):
        key = mix(key + table[:, :, j], j + 1)
    return key.view(np.int64)


def slices(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Places of runs of texts of about so many code points in all."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def sketched(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """row, id, n_shingles, sequence (digest of the word sequence; null without words) and bands of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, sizes, digests, bands = batch["text"].tolist(), [], [], []
            for first, last in slices(texts):
                words = [words_of(t) for t in texts[first:last]]
                sets = [shingles(w, s.words) for w in words]
                sizes += [len(x) for x in sets]
                digests += [hashlib.sha256(" ".join(w).encode()).digest()[:16] if w else None for w in words]
                bands += [keys if len(x) else None for x, keys in zip(sets, band_keys(sketches(sets, s.size), s), strict=True)]
            yield pd.DataFrame({"row": batch["row"], "id": batch["id"], "n_shingles": sizes, "sequence": digests, "bands": bands})

    rows = docs.select(row_number(docs).alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(run, f"row long, id {kind}, n_shingles long, sequence binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """row and items, the sorted hashes of its shingles, of the wanted rows of docs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "items": [np.sort(shingles(words_of(t), s.words).view(np.int64)) for t in batch["text"]]})

    texts = docs.select(row_number(docs).alias("row"), text_of(text_col).alias("text"))
    return texts.join(wanted, "row", "left_semi").mapInPandas(run, "row long, items array<long>")


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets that are not empty."""
    if len(a) < len(b):
        a, b = b, a
    i = np.searchsorted(a, b)
    i[i == len(a)] = 0
    return int((a[i] == b).sum())


def confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, part) whose sets are similar enough.

    The set of b travels once a pair, that of a once for each part of its partners. Rows
    reach a task in order of a and part, the set of a first, so a task holds one set.
    """
    of = lambda name: sets.select(F.col("row").alias(name), "items")
    heads = pairs.select("a", "part").distinct().join(of("a"), "a").select("a", "part", F.col("a").alias("b"), F.lit(True).alias("own"), "items")
    others = pairs.select("a", "b", "part").join(of("b"), "b").select("a", "part", "b", F.lit(False).alias("own"), "items")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for i, (own, items) in enumerate(zip(batch["own"], batch["items"], strict=True)):
                if own:
                    held = items
                    continue
                both = in_common(held, items)
                keep[i] = 100 * both >= s.similar * (len(held) + len(items) - both)
            yield batch.loc[keep, ["a", "b"]]

    dealt = heads.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.desc("own"))
    return dealt.mapInPandas(run, "a long, b long")


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node -> component, the smallest node that links (a, b) reach, by neighbours' minimum and pointer jumping."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(nodes.select("node", F.col("node").alias("component")).join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        stepped = written(lower.join(roots, "component").select("node", "was", F.least("component", "root").alias("component")), "labels")
        labels = stepped.select("node", "component")
        if stepped.filter("was != component").isEmpty():
            break
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def merged(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """grouped (node, component) after more links (a, b): only the components that these touch are connected anew."""
    of = lambda name: grouped.select(F.col("node").alias(name), F.col("component").alias(f"component_{name}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("component_a").alias("a"), F.col("component_b").alias("b")).filter("a != b").distinct()
    between = written(between, "between")
    touched = between.select(F.col("a").alias("node")).union(between.select("b")).distinct()
    now = connected(touched, between).select(F.col("node").alias("component"), F.col("component").alias("now"))
    return grouped.join(now, "component", "left").select("node", F.coalesce("now", "component").alias("component"))


def fits(a: Column, b: Column, similar: int) -> Column:
    """Sets of these sizes can be similar enough at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * similar


def by_bucket(rows: DataFrame, facts: DataFrame, hot: int, how: str = "inner") -> DataFrame:
    """rows (bucket, size, ...) with the one row of facts (bucket, size, ...) that their bucket has.

    Buckets above `hot` members meet their facts by broadcast: hot_size() sees to it that
    there are MOST_HOT of them at most. So no task gets a whole hot bucket.
    """
    large = F.col("size") > hot
    small = rows.filter(~large).join(facts.filter(~large).drop("size"), "bucket", how)
    return small.unionByName(rows.filter(large).join(F.broadcast(facts.filter(large).drop("size")), "bucket", how))


def hot_size(rows: DataFrame) -> int:
    """A size that at most MOST_HOT groups of these rows exceed."""
    return max(LEAST_HOT, rows.count() // MOST_HOT)


def with_facts(rows: DataFrame, facts: DataFrame, key: str, hot: int) -> DataFrame:
    """rows with the row of facts (key, size, ...) of their key, if there is one: by broadcast where size is above hot, as in by_bucket."""
    large = F.broadcast(facts.filter(F.col("size") > hot))
    small = rows.join(large.select(key), key, "left_anti").join(facts.filter(F.col("size") <= hot), key)
    return small.unionByName(rows.join(large, key))


def parts_of(facts: DataFrame, head: str, members: str) -> DataFrame:
    """facts with parts: over how many tasks the partners of the row's head are spread."""
    each = facts.groupBy(head).agg(F.ceil(F.sum(members) / PART).cast("int").alias("parts"))
    return facts.join(each, head)


def part_of(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.col("parts")).cast("int").alias("part")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row a document: row, id, n_shingles and component_id, the smallest id that links reach.

    Documents without words have an empty set and link with nothing, not even each
    other. Repeated rows and equal word sequences are linked. A null id stands after all
    others and never names a component that has another id. Empty tables give empty
    results; a very long text is one set like any other; other columns are ignored.
    row is row_number() of docs; first is true for the row that names its component.
    """
    s = settings
    docs = as_scan(docs)
    rows = written(sketched(docs, id_col, text_col, s), "sketches")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    classes = written(rows.filter("sequence is not null").groupBy("sequence").agg(F.min(first).alias("first"), F.min("row").alias("node")), "classes")
    members = rows.select("row", "n_shingles", "bands").join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    entries = written(members.select(F.explode("bands").alias("bucket"), F.col("row").alias("node"), F.col("n_shingles").alias("n")), "entries")
    together, hot = headed(entries)
    star = (
        together.filter((F.col("node") != F.col("head")) & fits(F.col("n"), F.col("head_n"), s.similar))
        .select(F.col("head").alias("a"), F.col("node").alias("b"), part_of("node")).distinct()
    )
    sets = written(shingle_sets(docs, together.select(F.col("node").alias("row")).distinct(), text_col, s), "sets")
    nodes = classes.select("node")
    grouped = written(connected(nodes, written(confirmed(star, sets, s), "links")), "components")
    held = written(open_buckets(together.select("bucket", "size", "node", "n"), grouped, hot), "open")
    for seed in range(1, 1 + MOST_ROUNDS):
        tried = written(pivots(held, hot, seed, s), "tried")
        links = written(confirmed(tried, sets, s), "links")
        if links.isEmpty():
            break
        grouped = written(merged(grouped, links), "components")
        held = written(open_buckets(held.drop("component"), grouped, hot), "open")
        if links.count() * 4 < tried.count():
            break
    arenas = written(arena_nodes(held, sets, s), "arenas")
    rest = written(confirmed(open_pairs(held, arenas, s), sets, s).union(arena_links(arenas, s)), "rest")
    if not rest.isEmpty():
        grouped = merged(grouped, rest)
    named = written(classes.join(grouped, "node"), "named")
    best = written(named.groupBy("component").agg(F.min("first").alias("best"), F.count("*").alias("size")), "best")
    by_sequence = with_facts(named, best, "component", hot_size(named)).select("sequence", F.col("best.id").alias("component_id"), F.col("best.row").alias("best_row"))
    return rows.select("row", "id", "n_shingles", "sequence").join(by_sequence, "sequence", "left").select(
        "row", "id", "n_shingles",
        F.when(F.col("sequence").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.coalesce("best_row", "row") == F.col("row")).alias("first"),
    )


def headed(entries: DataFrame) -> tuple[DataFrame, int]:
    """bucket, size, node, n, head, head_n and parts of the entries of buckets with two members or more, and the size above which a bucket is hot."""
    hot = hot_size(entries)
    rank = F.struct(F.xxhash64("node").alias("h"), "node", "n")
    buckets = entries.groupBy("bucket").agg(F.min(rank).alias("first"), F.count("*").alias("size")).filter("size > 1")
    buckets = written(parts_of(buckets.select("bucket", "size", F.col("first.node").alias("head"), F.col("first.n").alias("head_n")), "head", "size"), "buckets")
    return written(with_facts(entries, buckets, "bucket", hot), "together"), hot


def open_buckets(members: DataFrame, grouped: DataFrame, hot: int) -> DataFrame:
    """members (bucket, size, node, n) with component, of the buckets of three or more that hold several components."""
    held = members.filter("size > 2").join(grouped, "node")
    mixed = held.groupBy("bucket", "size").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("bucket", "size")
    return by_bucket(held, mixed, hot, "left_semi")


def pivots(held: DataFrame, hot: int, seed: int, s: Settings) -> DataFrame:
    """Pairs (a, b, part) of a node drawn from each open bucket and those of the bucket's other components."""
    rank = F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), "node", "n", "component")
    drawn = held.groupBy("bucket", "size").agg(F.min(rank).alias("p")).select("bucket", "size", F.col("p.node").alias("a"), F.col("p.n").alias("a_n"), F.col("p.component").alias("a_component"))
    both = by_bucket(held, parts_of(drawn, "a", "size"), hot)
    apart = (F.col("component") != F.col("a_component")) & fits(F.col("n"), F.col("a_n"), s.similar)
    return both.filter(apart).select("a", F.col("node").alias("b"), part_of("node")).distinct()


def open_pairs(held: DataFrame, arenas: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b, part) of different components in one small bucket that aren't of one arena."""
    small = held.filter(F.col("size") <= s.small).join(arenas.select("node", "arena"), "node", "left")
    x, y = small.alias("x"), small.alias("y")
    return x.join(
        y,
        (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
        & fits(F.col("x.n"), F.col("y.n"), s.similar) & (F.coalesce("x.arena", F.lit(-1)) != F.coalesce("y.arena", F.lit(-2))),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.lit(0).alias("part")).distinct()


def arena_nodes(held: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """node, component, arena, items and shared (how many of these any other component of the arena has) of all in large open buckets or crowded in small ones."""
    crowded = held.filter(F.col("size") <= s.small).groupBy("node").agg(F.sum(F.col("size") - 1).alias("partners")).filter(F.col("partners") > s.crowd)
    within = held.filter(F.col("size") <= s.small).join(crowded.select("node"), "node", "left_semi")
    members = written(held.filter(F.col("size") > s.small).unionByName(within).select("bucket", "node", "component"), "members")
    # components, not nodes, make the edges: a bucket gives as many as it has other components
    parties = members.select("bucket", "component").distinct()
    edges = parties.join(parties.groupBy("bucket").agg(F.min("component").alias("a")), "bucket").select("a", F.col("component").alias("b")).filter("a != b").distinct()
    arena = connected(parties.select(F.col("component").alias("node")).distinct(), edges).select(F.col("node").alias("component"), F.col("component").alias("arena"))
    nodes = members.select("node", "component").distinct().join(arena, "component")
    known = written(nodes.join(sets.withColumnRenamed("row", "node"), "node").select("node", "component", "arena", "items"), "items")
    items = known.select("node", "component", "arena", F.explode("items").alias("item"))
    crossing = items.groupBy("arena", "item").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("arena", "item")
    shared = items.join(crossing, ["arena", "item"], "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
    return known.join(shared, "node", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def arena_links(arenas: DataFrame, s: Settings) -> DataFrame:
    """Confirmed links (a, b) between different components of one arena, compared block by block.

    Nodes of an arena's largest component need no look at each other: their blocks only
    meet those of the rest, so an arena of m nodes of which r are not in it costs r * (2m - r) / block copies of sets.
    """
    able = written(arenas.filter(F.col("shared") * 100 >= F.size("items") * s.similar), "able")
    sizes = able.groupBy("arena", "component").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("held"))
    largest = F.max_by("component", F.struct("n", "component"))
    blocks = lambda n, held: F.ceil(F.greatest(n / s.block, held / BLOCK_ITEMS)).cast("int")
    top = lambda x: F.max(F.struct("n", "component", "held")).getField(x)
    plan = sizes.groupBy("arena").agg(
        largest.alias("largest"), blocks(F.sum("n") - top("n"), F.sum("held") - top("held")).alias("rest"), blocks(top("n"), top("held")).alias("most"),
        F.sum("n").alias("size"),
    ).filter("rest > 0")
    in_largest = F.col("component") == F.col("largest")
    place = F.xxhash64("node")
    mine = F.when(in_largest, F.col("rest") + F.pmod(place, F.col("most"))).otherwise(F.pmod(place, F.col("rest"))).cast("int")
    others = F.when(in_largest, F.col("rest")).otherwise(F.col("rest") + F.col("most"))
    dealt = with_facts(able, plan, "arena", hot_size(able)).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    # dealt anew by block, as an arena may be hot
    dealt = dealt.select("arena", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left"), "node", "component", "items", (F.col("mine") == F.col("other")).alias("own"))

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        first, second = rows[rows["left"]], rows[rows["own"] | ~rows["left"]]
        both = overlaps(first["items"].tolist(), second["items"].tolist())
        na, nb = (np.array([len(x) for x in side["items"]]) for side in (first, second))
        similar = 100 * both >= s.similar * (na[:, None] + nb[None, :] - both)
        apart = first["component"].to_numpy()[:, None] != second["component"].to_numpy()[None, :]
        i, j = np.nonzero(similar & apart)
        a, b = first["node"].to_numpy()[i], second["node"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.repartition("arena", "i", "j").groupBy("arena", "i", "j").applyInPandas(links, "a long, b long").distinct()


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b, by products of 0/1 matrices of bounded width."""
    out = np.zeros((len(a), len(b)))
    if not len(a) or not len(b):
        return out
    flat = [np.concatenate(x) for x in (a, b)]
    row = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b)]
    common = np.intersect1d(*flat)
    for at in range(0, len(common), width):
        part, sides = common[at : at + width], []
        for values, place, n in zip(flat, row, (len(a), len(b)), strict=True):
            i = np.searchsorted(part, values)
            hit = (i < len(part)) & (part[np.minimum(i, len(part) - 1)] == values)
            side = np.zeros((n, len(part)), dtype=np.float32)
            side[place[hit], i[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """docs with one document of each group, that of the smallest id; documents without words all stay."""
    docs = as_scan(docs)
    return without_rows(docs, near_groups(docs, id_col, text_col, settings).filter("not first").select("row"))
