"""Columns of documents may be called what the operators call theirs: they come through unchanged."""

import pytest
from pyspark.sql import functions as F

from panelwright.llm import bpe, exact_dedup, language_id, mixing, near_dedup, toxicity
from panelwright.llm.queries import VOCABULARY

DIR = "/root/testdata/sf0.001"
NAMES = ["__row", "__row_", "__copy", "__copies", "__id", "__share", "__text", "row", "id", "key", "check", "digest", "label", "share", "number", "words", "size", "taken", "n", "node", "slice"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names") / "documents")
    rows = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = rows.unionByName(rows.filter("doc_id < 20"))
    rows.withColumns({x: F.concat(F.lit(f"{x}:"), F.col("doc_id")) for x in NAMES}).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


STAGES = {"language": language_id.accepted, "exact": exact_dedup.drop_copies, "near": near_dedup.drop_near_copies, "mix": mixing.mixed_documents}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_every_column(docs, name):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    got, want = STAGES[name](docs), STAGES[name](plain)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[x] == f"{x}:{r['doc_id']}" for r in rows for x in NAMES)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in want.collect())


def test_models_learn_beside_such_names(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet").withColumns({"__id": F.lit("?"), "text": F.lit("?"), "lang": F.lit("?"), "label": F.lit("?")})
    small = toxicity.Settings(training_rows=40)
    toxicity.learn(docs, labels, settings=small)
    assert toxicity.score(docs, toxicity.learn(docs, labels, settings=small), "doc_id").count() == docs.count()
    assert bpe.encode(docs, VOCABULARY).count() == docs.count()


@pytest.mark.parametrize("fan_in", [2, 3])
def test_merge_of_many_runs_is_one_sort(spark, fan_in):
    """Runs of many small tasks, merged two or three at a time, keep what a plain grouping keeps."""
    rows = [(i if i % 7 else None, " ".join(["x"] * (i % 5)) + " " * (i % 3) + str(i % 11)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    got = {(r["row"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs, fan_in=fan_in).collect()}
    assert len(got) == 400
    groups = {}
    for i, t in rows:
        groups.setdefault(t.replace(" ", ""), []).append((-len(t), i is None, i))
    assert sorted(((k, n) for _, k, n, kept in got if kept), key=str) == sorted(((min(g)[2], len(g)) for g in groups.values()), key=str)
