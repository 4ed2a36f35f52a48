"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, exact_dedup, fingerprint, language_id, license_scan, line_dedup, mixing, near_dedup, ranked_search, secret_scan, toxicity, warc_segments
from .common import held_out, table, written

#: Vocabulary of the tokenizer; any byte-level BPE file of the tokenizers library will do.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, white space aside, verified on the texts. A null text is empty, a null id stands last; of repeated rows one is kept."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, with a verdict a span: example (at least three repositories of two owners have it), live (one owner has it) or shared.

    documents names no repositories, so each document is one; its source is the owner. A
    null or empty text has no spans; repeated rows are scanned each for itself.
    """
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, secret_scan.KINDS))
    base = F.filter("spans", lambda x: x.kind_no < 3)
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind_no), x.start, x.end)), ",")
    count = lambda i: F.size(F.filter("spans", lambda x: x.kind_no == i)).cast("long")
    verdict = lambda x: F.when(x.example, "example").when(x.n_owners == 1, "live").otherwise("shared")
    return found.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x.example)).cast("long").alias("n_example"),
        F.size(F.filter("spans", lambda x: x.n_owners == 1)).cast("long").alias("n_single_owner"),
        F.array_join(F.transform("spans", verdict), ",").alias("verdicts"),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text. Null counts as empty, whose fingerprint is "3::"; null ids come last, repeated ids in row order."""
    pairs = fingerprint.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        fingerprint.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprint.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text: und for a null text or one without a letter. A null id is never learned from and isn't held out."""
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs)).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "coverage"
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every text, with spans and matched coverage. A null or empty text has none (and no best coverage); repeated rows and null ids are rows of their own."""
    found = license_scan.find_licenses(table(spark, sf_dir, "documents"))
    spans = lambda m: F.array_join(F.transform(m.spans, lambda x: F.concat_ws(":", x.start, x.end)), "+")
    line = lambda m: F.concat_ws(":", m.license, spans(m), F.format_number(m.coverage, 4))
    return found.select(
        F.col("id").alias("doc_id"), F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.license))), ",").alias("licenses"),
        F.array_join(F.transform("matches", line), ",").alias("spans"), F.array_max(F.transform("matches", lambda m: m.coverage)).alias("best_coverage"),
    )


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, written and read back. A null payload is empty; of repeated rows one is the response."""
    pages = table(spark, sf_dir, "pages")
    path = warc_segments.write_archives(pages)
    return warc_segments.read_archives(spark, path, id_type=pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies on sets of four-word shingles. A document without words is alone; a null id names a component only if no other id is in it."""
    groups = near_dedup.near_groups(table(spark, sf_dir, "documents"), settings=near_dedup.Settings(words=4))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and what they decode to, as digests. A null or empty text has no tokens; repeated rows are rows of their own."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), VOCABULARY).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text. Null counts as empty and gets the score of no evidence; flagged uses the threshold of the row's language, predicted 0.3."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("doc_id", "lang").alias("key"), "text")
    cuts = F.create_map(*(F.lit(x) for pair in model.thresholds.items() for x in pair)) if model.thresholds else F.lit(None).cast("map<string,double>")
    return toxicity.score(rows, model, "key").select(
        F.col("id.doc_id").alias("doc_id"), held_out(F.col("id.doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"),
        (F.col("score") >= F.coalesce(F.try_element_at(cuts, F.coalesce("id.lang", F.lit(""))), F.lit(toxicity.CUT))).alias("flagged"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. A null or empty text has size 0 and gives nothing; a null source is one source, ordered last."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item. A text without a term is no document and asks for nothing; every benchmark row is an item of its own."""
    index = ranked_search.build(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark")).select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 finite components, three rounds from 16 centroids. Repeated rows are vectors of their own; an empty table gives no rows."""
    rows, centroids = clustering.clusters(table(spark, sf_dir, "embeddings"))
    rows = written(rows, "clustered")
    by_cluster = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row a centroid
    of_cluster = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster")) if values else F.lit(None)
    k = range(len(centroids))
    return rows.select(
        F.col("id").alias("vec_id"), "cluster", "distance",
        of_cluster([by_cluster.get(i, 0) for i in k]).cast("long").alias("cluster_inertia"), F.lit(sum(by_cluster.values())).cast("long").alias("inertia"),
        of_cluster([clustering.centroid_digest(centroids[i]) for i in k]).cast("string").alias("centroid_sha256"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them have, but for the largest doc_id. A null or empty text is one empty line; repeated rows count each for itself."""
    return line_dedup.without_repeated_lines(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_secret_scan, op3_fingerprint, op4_language_id, op5_license_scan, op6_warc_segments, op7_near_dedup, op8_bpe, op9_toxicity, op10_mixing, op11_ranked_search, op12_clustering, op13_line_dedup)
}
