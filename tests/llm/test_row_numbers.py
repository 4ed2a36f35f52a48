from panelwright.llm import exact_dedup, mixing, warc_segments
from panelwright.llm.common import as_scan, row_number
from pyspark.sql import functions as F


def packed(spark, size):
    """How large a task's share of files may be; Spark's default follows the cores that are there."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def rows(spark, path):
    docs = spark.read.parquet(path)
    return {r["row"]: r["doc_id"] for r in docs.select(row_number(docs).alias("row"), "doc_id").collect()}


def test_rows_keep_their_numbers_however_files_are_packed(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source")).repartition(7).write.parquet(path)
    try:
        packed(spark, "128m")
        want = rows(spark, path)
        packed(spark, "8k")
        assert rows(spark, path) == want and len(want) == 5000
        docs = spark.read.parquet(path)
        packed(spark, "128m")
        got = exact_dedup.exact_groups(docs)
        plan = warc_segments.plan_revisits(spark.createDataFrame([(i, "u", "x" * 200) for i in range(9)], "page_id long, url string, html string"))
        packed(spark, "8k")
        first = docs.withColumn("row", row_number(docs)).join(got.filter("kept").select("row"), "row").collect()
        assert [r["doc_id"] for r in first] == [0] and plan.count() == 8
        assert mixing.mixed_documents(docs).count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_without_files_are_written_first(spark):
    docs = as_scan(spark.range(50).withColumn("x", F.rand()))
    numbers = docs.select(row_number(docs).alias("row"))
    assert numbers.distinct().count() == 50 and as_scan(docs) is docs
