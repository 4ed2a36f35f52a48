r"""Ranked lexical search on a length-stratified index.

A term that occurs tf times in a document scores w * impact(tf, m), and the length of the
document enters by the normaliser m alone, a small integer. So documents are grouped
by equal m into strata, a term's postings in a stratum are grouped by tf, and an impact
is computed once for every tf of a stratum instead of once a posting. The largest tf that
a term has in a stratum bounds what any of its documents can score: a task visits the
strata in order of an item's bound and stops at the first bound that can't reach its ten best.

Strata are exchanged by (m, part). One that holds more than PART_DOCS and a MOST_STRATA-th of
all documents, of which there are fewer than MOST_STRATA, is cut into parts of that size; a part is
written in segments of bounded size as its documents stream by in order of id.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_scan, row_number, shared_folder, text_of, written

#: What is returned for an item, and the scale of weights and impacts.
BEST, WEIGHT_SCALE, IMPACT_SCALE = 10, 1000, 1_000_000_000
#: Strata above PART_DOCS and above a MOST_STRATA-th of all documents are cut into parts of that size.
MOST_STRATA, PART_DOCS = 4096, 256
#: A segment's documents and postings, at most (a single document may have more postings).
SEGMENT_DOCS, SEGMENT_POSTINGS = 4096, 400_000
#: Items are asked in blocks of about so many characters, so that neither driver nor tasks hold more.
BLOCK_CHARS = 1_000_000
#: Strata times terms of a block that a task orders at a time.
GROUP_CELLS = 2_000_000
#: Everything that is no part of a term becomes a space, A-Z is lowered.
PLAIN = bytes(32 if b < 0x80 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Digits, letters of ASCII and all beyond ASCII make up terms; UTF-8 has no ASCII byte in a longer character."""
    return text.translate(PLAIN).split()


def impact(tf: int, m: int) -> int:
    return IMPACT_SCALE * tf // (1000 * tf + 8 * m)


def normaliser(n: int, n_docs: int, n_terms: int) -> int:
    return 25 + 75 * n * n_docs // n_terms


def weight(df: int, n_docs: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Index:
    """segments is a table: a row a segment of a stratum. n_docs has at least one term each."""

    segments: DataFrame
    n_docs: int
    n_terms: int


def lengths(docs: DataFrame, text_col: str) -> DataFrame:
    """How many documents have n terms, for every n above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            found.update(len(terms_of(x.as_py())) for x in batch["text"])
        found.pop(0, None)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n", "docs"])

    return docs.select(text_of(text_col).cast("binary").alias("text")).mapInArrow(run, "n long, docs long").groupBy("n").agg(F.sum("docs").alias("docs"))


def forward(docs: DataFrame, id_col: str, text_col: str, n_docs: int, n_terms: int) -> DataFrame:
    """id, m, words (distinct terms, joined by spaces) and tfs (32 bits each) of every document that has a term."""
    rows = docs.select(row_number(docs).alias("row"), F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, m, words, tfs = [], [], [], []
            for i, text in enumerate(batch["text"]):
                counts = Counter(terms_of(text.as_py()))
                if counts:
                    at.append(i)
                    m.append(normaliser(counts.total(), n_docs, n_terms))
                    words.append(b" ".join(counts))
                    tfs.append(np.fromiter(counts.values(), np.uint32, len(counts)).tobytes())
            picked = batch.select(["row", "id"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(m, pa.int64()), pa.array(words, pa.binary()), pa.array(tfs, pa.binary())], ["row", "id", "m", "words", "tfs"])

    return rows.mapInArrow(run, f"row long, id {kind}, m long, words binary, tfs binary")


def segment(m: int, ids: list[pa.Array], words: list[bytes], tfs: list[bytes]) -> pa.RecordBatch:
    """The postings of some documents of one stratum, in the order of their ids: by term, then tf, then document.

    terms are sorted; ends, tfs and docs are packed arrays: where each term's runs end, and
    each run's tf and end, and the documents' places.
    """
    numbers: dict[bytes, int] = {}
    term = np.fromiter((numbers.setdefault(x, len(numbers)) for w in words for x in w.split(b" ")), np.int64)
    tf = np.concatenate([np.frombuffer(x, np.uint32) for x in tfs]).astype(np.int64)
    doc = np.repeat(np.arange(len(words)), [len(x) // 4 for x in tfs])
    names = sorted(numbers)
    place = np.empty(len(names), np.int64)
    place[[numbers[x] for x in names]] = np.arange(len(names))
    order = np.lexsort((doc, tf, place[term]))
    term, tf, doc = place[term][order], tf[order], doc[order]
    last = np.append((term[1:] != term[:-1]) | (tf[1:] != tf[:-1]), True)  # of a run
    run_end = np.flatnonzero(last) + 1
    run_term, run_tf = term[last], tf[last]
    term_end = np.searchsorted(run_term, np.arange(len(names)), side="right")
    one = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()])
    all_ids = pa.concat_arrays(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array([m]), pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids), pa.array([names], pa.list_(pa.binary())),
         one(term_end, np.int32), one(run_tf, np.uint32), one(run_end, np.int32), one(doc, np.int32)],
        ["m", "ids", "terms", "term_end", "run_tf", "run_end", "docs"],
    )


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of every document: all terms of whole texts.

    A null or empty text, or one without a term, is no document of the index. Repeated
    rows and ids are documents of their own; other columns are ignored.
    """
    docs = as_scan(docs)
    by_n = written(lengths(docs, text_col), "lengths")
    total = by_n.agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("n")).alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    m = F.lit(25) + F.floor(F.lit(75) * F.col("n").cast("decimal(38,0)") * n_docs / max(1, n_terms)).cast("long")  # only to find large strata
    most = max(PART_DOCS, n_docs / MOST_STRATA)
    large = by_n.groupBy(m.alias("m")).agg(F.sum("docs").alias("docs")).filter(F.col("docs") > most)
    parts = large.select("m", F.ceil(F.col("docs") / most).cast("int").alias("parts"))  # fewer than MOST_STRATA rows
    lists = forward(docs, id_col, text_col, n_docs, n_terms).join(F.broadcast(parts), "m", "left")
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).alias("part")
    dealt = lists.select("m", part, "id", "words", "tfs").repartition("m", "part").sortWithinPartitions("m", "part", F.col("id").asc_nulls_last())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, words, tfs, size = None, [], [], [], 0
        for batch in batches:
            for i, (m, part) in enumerate(zip(batch["m"].to_pylist(), batch["part"].to_pylist(), strict=True)):
                more = batch["tfs"][i].as_py()
                if words and ((m, part) != key or len(words) >= SEGMENT_DOCS or size + len(more) // 4 > SEGMENT_POSTINGS):
                    yield segment(key[0], ids, words, tfs)
                    ids, words, tfs, size = [], [], [], 0
                key, size = (m, part), size + len(more) // 4
                ids.append(batch["id"].slice(i, 1))
                words.append(batch["words"][i].as_py())
                tfs.append(more)
        if words:
            yield segment(key[0], ids, words, tfs)

    shape = f"m long, ids array<{kind}>, terms array<binary>, term_end binary, run_tf binary, run_end binary, docs binary"
    return Index(written(dealt.mapInArrow(run, shape), "strata"), n_docs, n_terms)


class Block:
    """Some items: their terms, numbered, and how often each item has each."""

    def __init__(self, texts: Sequence[bytes]):
        counts = [Counter(terms_of(x)) for x in texts]
        self.terms = sorted({t for c in counts for t in c})
        number = {t: i for i, t in enumerate(self.terms)}
        self.items = [(np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]


def asked(terms: pa.Array, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places in terms, and the numbers among wanted, of the terms that are wanted."""
    at = pc.index_in(terms, value_set=wanted).to_numpy(zero_copy_only=False)
    found = np.flatnonzero(~np.isnan(at)) if at.dtype.kind == "f" else np.arange(len(at))
    return found, at[found].astype(np.int64)


def frequencies(index: Index, block: Block) -> np.ndarray:
    """In how many documents each term of the block is."""
    names = block.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, df = pa.array(names, pa.binary()), np.zeros(len(names), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                here, number = asked(batch["terms"][i].values, wanted)
                ends = np.append(0, np.frombuffer(batch["run_end"][i].as_py(), np.int32))[np.append(0, np.frombuffer(batch["term_end"][i].as_py(), np.int32))]
                df[number] += np.diff(ends)[here]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    found = index.segments.select("terms", "term_end", "run_end").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(names), np.int64)
    for r in found.collect():  # a row a term of the block
        out[r["term"]] = r["df"]
    return out


class Stratum:
    """A segment, cut down to the terms of a block: where their postings are, and the impact of each."""

    def __init__(self, row: dict, wanted: pa.Array, weights: np.ndarray):
        word = lambda x, kind: np.frombuffer(row[x].as_py(), kind)
        self.ids, m, run_end = row["ids"].values, row["m"].as_py(), np.append(0, word("run_end", np.int32))
        self.docs, term_end = word("docs", np.int32), np.append(0, word("term_end", np.int32))
        tfs, of_run = np.unique(word("run_tf", np.uint32), return_inverse=True)
        by_run = np.array([impact(t, m) for t in tfs.tolist()], np.int64)[of_run]  # once a tf of the stratum
        self.impacts = np.repeat(by_run, np.diff(run_end))
        here, number = asked(row["terms"].values, wanted)
        self.first, self.last, self.most = np.zeros(len(wanted), np.int32), np.zeros(len(wanted), np.int32), np.zeros(len(wanted), np.int64)
        self.first[number], self.last[number] = run_end[term_end[here]], run_end[term_end[here + 1]]
        self.most[number] = weights[number] * by_run[term_end[here + 1] - 1]  # runs are by tf

    def scores(self, terms: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Of every document: the sum of factor * impact over the terms."""
        out, docs, impacts = np.zeros(len(self.ids), np.int64), self.docs, self.impacts
        for a, b, f in zip(self.first[terms].tolist(), self.last[terms].tolist(), factors.tolist(), strict=True):
            if a < b:
                out[docs[a:b]] += f * impacts[a:b]  # a document is once among a term's postings
        return out


def best_of(index: Index, block: Block, best: int) -> DataFrame:
    """item (its place in the block), id and score: the best of every task for every item."""
    kind = index.segments.schema["ids"].dataType.elementType.simpleString()
    weights = np.array([weight(int(df), index.n_docs) if df else 0 for df in frequencies(index, block)], np.int64)
    names, items, together = block.terms, block.items, max(1, GROUP_CELLS // max(1, len(block.terms)))
    index_kind = to_arrow_type(index.segments.schema["ids"].dataType.elementType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, kept = pa.array(names, pa.binary()), [[] for _ in items]
        order = lambda x: (-x[0], x[1] is None, x[1])
        for batch, start in ((b, i) for b in batches for i in range(0, len(b), together)):
            some = batch.slice(start, together)
            strata = [Stratum({x: some[x][i] for x in some.schema.names}, wanted, weights) for i in range(len(some))]
            most = np.stack([s.most for s in strata])
            for item, (terms, repeats) in enumerate(items):
                bounds = most[:, terms] @ repeats
                for at in np.argsort(-bounds, kind="stable").tolist():
                    mine = kept[item]
                    least = mine[-1][0] if len(mine) >= best else 1
                    if bounds[at] < least:
                        break  # no later stratum reaches the best, nor ties with the last of them
                    score = strata[at].scores(terms, weights[terms] * repeats)
                    good = np.flatnonzero(score >= least)
                    good = good[np.argsort(-score[good], kind="stable")][:best]  # documents stand by id
                    mine = sorted([*mine, *((int(score[i]), strata[at].ids[i].as_py()) for i in good.tolist())], key=order)
                    kept[item] = mine[:best]
        rows = [(i, d, s) for i, mine in enumerate(kept) for s, d in mine]
        ids = pa.array([r[1] for r in rows], index_kind)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), ids, pa.array([r[2] for r in rows], pa.int64())], ["item", "id", "score"])

    return index.segments.mapInArrow(run, f"item long, id {kind}, score long")


def search(index: Index, items: DataFrame, item_col: str = "item_id", text_col: str = "text", best: int = BEST) -> DataFrame:
    """item_id, rank, id and score: the documents with the highest scores above 0 of every item, equal scores by id (null last).

    Every row of items is an item of its own; one without a term, or whose terms are in no
    document, has no rows. Items are asked in blocks, each one pass over the index.
    """
    spark = items.sparkSession
    texts = items.select(F.col(item_col).alias("item_id"), text_of(text_col).alias("text"))
    chars = texts.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-chars // BLOCK_CHARS))
    numbered = written(texts.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))), "items")
    folder = f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}"
    kind, of = items.schema[item_col].dataType.simpleString(), index.segments.schema["ids"].dataType.elementType.simpleString()
    shape = f"item_id {kind}, rank int, id {of}, score long"
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    for b in range(n_blocks):
        rows = numbered.filter(F.col("block") == b).select("item_id", "text").collect()  # a block's items
        if not rows:
            continue
        found = best_of(index, Block([r["text"].encode() for r in rows]), best).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {kind}")
        found.join(names, "item").select("item_id", "rank", "id", "score").write.mode("append").parquet(folder)
    spark.createDataFrame([], shape).write.mode("append").parquet(folder)
    return spark.read.schema(shape).parquet(folder)
