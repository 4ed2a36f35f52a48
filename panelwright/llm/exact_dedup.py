"""Exact dedup by a tree merge of sorted digest runs.

Every batch of a scan's task is a leaf run: sorted by digest and folded to one entry a
digest, the entry naming the row that stays and how many it stands for. A run travels as
blocks, a row each, that hold a slice of it in order; a slice is the next digit of the digest.
In round r the blocks of `fan_in` neighbouring nodes and one slice meet and are merged many
ways, lowest entry first, without sorting anything again; equal entries fold into the
smallest identifier. A round has about as many (node, slice) groups as there were
leaves, each of the size of a leaf, so no task ever holds the whole table. A text that a third
of all rows share crosses a round once a run. After the last round one node is left, and its
slices hold each digest once.

At every level entries only fold if a second digest of the text, of another kind, agrees, too.
At the end each copy's whole text is compared with that of the row that stays. Rows that
differ, which takes a collision of both digests, go through the tree again among
themselves, so that equal digests never make texts equal.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_scan, row_number, text_of, without_rows, written

#: Runs that one node merges in a round; 2 is the plain binomial tree.
FAN_IN = 16
#: Ways over which the copies of one text are spread when they are compared with it.
PARTS = 64
#: Hex digits of the digest that the tree merges by: all of them.
DIGITS = 64


def bare_text(text_col: str) -> Column:
    return F.regexp_replace(text_of(text_col), f"{SPACE}+", "")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int = DIGITS) -> DataFrame:
    """row, id, n_chars, leaf, digest, key (its first digits) and check (of a second digest) of every row, without its text. docs must be from as_scan."""
    rows = docs.select(
        row_number(docs).alias("row"),
        F.col(id_col).alias("id"),
        F.char_length(text_of(text_col)).cast("long").alias("n_chars"),
        F.spark_partition_id().cast("long").alias("leaf"),
        bare_text(text_col).alias("bare"),
    )
    rows = rows.withColumn("digest", F.sha2("bare", 256)).withColumn("check", F.substring(F.md5(F.col("bare").cast("binary")), 1, digits // 2))
    return rows.drop("bare").withColumn("key", F.substring("digest", 1, digits))


def folded(entries: Iterable[tuple]) -> Iterator[tuple]:
    """Ascending entries (key, check, -n_chars, no id, id, row, size): the first of each key and check, with all their sizes."""
    now, size = None, 0
    for e in entries:
        if now is not None and e[0] == now[0] and e[1] == now[1]:
            size += e[6]
        else:
            if now is not None:
                yield (*now[:6], size)
            now, size = e, e[6]
    if now is not None:
        yield (*now[:6], size)


def blocks(node: int, entries: Iterable[tuple], depth: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Ascending entries as blocks, one a slice of `depth` digits."""
    for name, part in groupby(entries, key=lambda e: e[0][:depth]):
        keys, checks, ranks, _, ids, rows, sizes = map(list, zip(*part, strict=True))
        lists = [pa.array([x], pa.list_(t)) for x, t in ((keys, pa.string()), (checks, pa.string()), (ranks, pa.int64()), (ids, kind), (rows, pa.int64()), (sizes, pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([name], pa.string()), *lists], ["node", "slice", *BLOCK])


#: What a block holds of its entries, a list each.
BLOCK = ["keys", "checks", "ranks", "ids", "rows", "sizes"]


def block_schema(kind: str) -> str:
    return f"node long, slice string, keys array<string>, checks array<string>, ranks array<long>, ids array<{kind}>, rows array<long>, sizes array<long>"


def leaf_runs(rows: DataFrame) -> DataFrame:
    """The leaves' runs as blocks of one digit: sorted and folded a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, key, check, chars, ids, row = (batch[c].to_pylist() for c in ("leaf", "key", "check", "n_chars", "id", "row"))
            entries = sorted(zip(key, check, (-n for n in chars), (i is None for i in ids), ids, row, repeat(1)))  # noqa: B905
            if entries:
                yield from blocks(leaf[0], folded(entries), 1, batch.schema.field("id").type)

    return rows.select("leaf", "key", "check", "n_chars", "id", "row").mapInArrow(run, block_schema(rows.schema["id"].dataType.simpleString()))


def merged_to(depth: int) -> Callable[[pa.Table], pa.Table]:
    """Merges the blocks of one node and slice into blocks of `depth` digits."""

    def merge(t: pa.Table) -> pa.Table:
        runs = [list(zip(k, c, n, (i is None for i in ids), ids, r, s)) for k, c, n, ids, r, s in zip(*(t[x].to_pylist() for x in BLOCK), strict=True)]  # noqa: B905
        return pa.Table.from_batches(blocks(t["node"][0].as_py(), folded(heapq.merge(*runs)), depth, t.schema.field("ids").type.value_type))

    return merge


def tree_merge(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row a key and check: group_size and best, the struct of the row that stays."""
    leaves = (rows.agg(F.max("leaf")).first()[0] or 0) + 1
    rounds, span = 1, fan_in
    while span < leaves:
        rounds, span = rounds + 1, span * fan_in
    kind = rows.schema["id"].dataType.simpleString()
    runs = leaf_runs(rows)
    for depth in range(1, rounds + 1):
        runs = runs.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("node", "slice").applyInArrow(merged_to(depth + 1), block_schema(kind))
    entry = runs.select(F.explode(F.arrays_zip(*BLOCK)).alias("e"))
    best = F.struct(F.col("e.ranks").alias("rank"), F.col("e.ids").isNull().alias("no_id"), F.col("e.ids").alias("id"), F.col("e.rows").alias("row"))
    return entry.select(F.col("e.keys").alias("key"), F.col("e.checks").alias("check"), F.col("e.sizes").alias("group_size"), best.alias("best"))


def differing(docs: DataFrame, rows: DataFrame, groups: DataFrame, text_col: str) -> DataFrame:
    """The rows whose text is not that of the row that stays in their group. Only groups of several rows are looked at.

    The text that stays goes to each of PARTS places once at most, every copy's to one.
    """
    several = groups.filter("group_size > 1").select("key", "check", F.col("best.row").alias("keeper"))
    copies = rows.join(several, ["key", "check"]).filter("row != keeper").select("row", "keeper", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int").alias("part"))
    copies = written(copies, "copies")
    wanted = copies.withColumn("own", F.lit(False)).unionByName(copies.select(F.col("keeper").alias("row"), "keeper", "part").distinct().withColumn("own", F.lit(True)))
    texts = docs.select(row_number(docs).alias("row"), bare_text(text_col).alias("bare"))
    both = texts.join(wanted, "row")
    mine = both.filter("not own").select("row", "keeper", "part", "bare")
    theirs = both.filter("own").select("keeper", "part", F.col("bare").alias("kept"))
    return mine.join(theirs, ["keeper", "part"]).filter("bare != kept").select("row")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN, digits: int = DIGITS) -> DataFrame:
    """One row a document: row, id, n_chars, digest, keep_id, group_size and kept.

    Texts are equal when identical after white space is deleted; null is the empty
    text, and empty texts are one group. The longest original stays, then the smallest
    id (null last). Of repeated rows with one id exactly one stays. `row` is
    row_number() of docs. An empty table gives an empty result; a very long text is one
    value like any other; other columns of docs are ignored.
    """
    docs = as_scan(docs)
    left = written(digest_rows(docs, id_col, text_col, digits), "digests")
    done = None
    while True:
        groups = written(tree_merge(left, fan_in), "groups")
        bad = written(differing(docs, left, groups, text_col), "differing")
        clash = not bad.isEmpty()
        good = left.join(bad, "row", "left_anti") if clash else left
        out = good.join(tree_merge(good, fan_in) if clash else groups, ["key", "check"])
        done = out if done is None else done.unionByName(out)
        if not clash:
            break
        left = written(left.join(bad, "row", "left_semi"), "digests")
    return done.select(
        "row", "id", "n_chars", "digest",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without its exact copies, all columns kept."""
    docs = as_scan(docs)
    return without_rows(docs, exact_groups(docs, id_col, text_col).filter(~F.col("kept")).select("row"))
