"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions only.

A text is cut at its matches: the pieces between them and the matches themselves give
every span's offset in code points without a UDF. Each candidate value is hashed and
counted by distinct repository and owner over the whole corpus. A value that many
repositories of several owners share is a copied example; a value of one owner is
live-looking. Beside the three base kinds the scan takes long mixed tokens ("opaque"),
which are far too common as examples, so only those seen under one owner are reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

# The patterns of the base kinds. Letters of `assign` match in either case.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
HEX = "[0-9a-f]{24,}"
ACCESS = "AKIA[A-Z0-9]{16,}"
OPAQUE = "[A-Za-z0-9+/_-]{20,}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = f"({'|'.join(map(either_case, KEYWORDS))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "opaque")


@dataclass(frozen=True)
class Ownership:
    """A value is a copied example from this many repositories under this many owners."""

    example_repositories: int = 3
    example_owners: int = 2


#: Matches whose places are added up in one go.
RUN = 256


def placed(pairs: Column) -> Column:
    """array<struct<start, found>> from the text before each match and the match itself.

    Arrays are values, so appending copies them: runs of RUN matches are placed each for
    itself and put together as references, m * RUN / 2 copies for m matches.
    """
    empty = F.expr("cast(array() as array<struct<start:int,found:string>>)")
    runs = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(RUN)), lambda i: F.slice(pairs, i, F.lit(RUN)))

    def one(at: Column, run: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(at.alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc.at + x.skip + F.char_length(x.found)).alias("at"),
                F.concat(acc.out, F.array(F.struct((acc.at + x.skip).alias("start"), x.found.alias("found")))).alias("out"),
            ),
        )

    joined = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,found:string>>>)").alias("out")),
        lambda acc, run: F.get(F.transform(F.array(one(acc.at, run)), lambda x: F.struct(x.at.alias("at"), F.concat(acc.out, F.array(x.out)).alias("out"))), F.lit(0)),
        lambda acc: acc.out,
    )
    return F.when(F.size(pairs) > 0, F.flatten(joined)).otherwise(empty)


def matches_of(text: Column, pattern: str) -> Column:
    """array<struct<start, found>> of all matches, leftmost and non-overlapping."""
    empty = F.expr("cast(array() as array<struct<start:int,found:string>>)")
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda piece, found: F.struct(F.char_length(piece).alias("skip"), found.alias("found")),
    )
    found = F.get(F.transform(F.array(F.filter(pairs, lambda x: x.found.isNotNull())), placed), F.lit(0))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def spans_of(matches: Column, kind: str, value) -> Column:
    return F.transform(
        matches,
        lambda x: F.struct(
            x.start.alias("start"),
            F.lit(KINDS.index(kind)).alias("kind_no"),
            (x.start + F.char_length(x.found)).alias("end"),
            F.sha2(value(x.found), 256).alias("value_hash"),
        ),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """row, id, owner, repo and spans (sorted by start, then kind) of every document; no texts."""
    text = F.col("__text")
    value = lambda found: F.regexp_extract(found, ASSIGN, 2)
    none = F.expr("cast(array() as array<struct<start:int,found:string>>)")
    found = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), text_of(text_col).alias("__text")
    ).select(
        "row", "id", "owner", "repo",
        F.filter(matches_of(text, ASSIGN), lambda x: F.char_length(value(x.found)) >= 6).alias("assign"),
        F.when(text.contains("AKIA"), matches_of(text, ACCESS)).otherwise(none).alias("access"),
        matches_of(text, HEX).alias("hex"),
        F.filter(
            matches_of(text, OPAQUE),
            lambda x: x.found.rlike("[0-9]") & x.found.rlike("[a-z]") & x.found.rlike("[A-Z]"),
        ).alias("opaque"),
    )
    whole = lambda x: x
    return found.select(
        "row", "id", "owner", "repo",
        F.array_sort(F.concat(spans_of(F.col("assign"), "assign", value), spans_of(F.col("access"), "access", whole), spans_of(F.col("hex"), "hex", whole), spans_of(F.col("opaque"), "opaque", whole))).alias("spans"),
    )


def ownership(scanned: DataFrame, rule: Ownership = Ownership()) -> DataFrame:
    """value_hash, n_repositories, n_owners, n_uses and example, over the whole corpus.

    Uses are summed by (value, repository, owner), then by (value, owner), then by
    value: a value that a third of all rows hold is combined before every exchange.
    """
    uses = scanned.select(F.explode("spans").alias("s"), "owner", "repo").select("s.value_hash", "owner", "repo")
    by_repo = uses.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_hash").agg(
        F.sum("repos").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("n").alias("n_uses")
    ).withColumn(
        "example", (F.col("n_repositories") >= rule.example_repositories) & (F.col("n_owners") >= rule.example_owners)
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", rule: Ownership = Ownership()) -> DataFrame:
    """One row a document: row, id and spans, each with its corpus counts.

    spans is an array of (start, kind_no, end, value_hash, n_owners, n_repositories,
    example), by start, then kind. Null and empty texts, and texts without a match,
    have an empty array, very long ones as many spans as they have. A null owner or
    repository counts as one of its own, a null id is an id like any other. Repeated
    rows are scanned each for itself, and are one repository by default, as repo_col is
    the document: a table that names repositories should pass that column. An empty table
    gives an empty result; other columns are ignored.
    """
    scanned = written(scan(docs, id_col, text_col, owner_col, repo_col), "secrets")
    each = scanned.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    judged = each.join(ownership(scanned, rule), "value_hash").filter(
        (F.col("kind_no") < KINDS.index("opaque")) | (F.col("n_owners") == 1)
    )
    by_doc = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "value_hash", "n_owners", "n_repositories", "example"))).alias("judged")
    )
    empty = F.expr("cast(array() as array<struct<start:int,kind_no:int,end:int,value_hash:string,n_owners:bigint,n_repositories:bigint,example:boolean>>)")
    return scanned.select("row", "id").join(by_doc, "row", "left").select("row", "id", F.coalesce("judged", empty).alias("spans"))
