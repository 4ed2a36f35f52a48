from panelwright.plans import registry
from panelwright.sources import tables as S
from pyspark.sql import functions as F


def test_file_manifest_is_of_files_written_from_documents(spark):
    small, large = (registry.QUERIES["s11_file_manifest"](spark, f"/root/testdata/{x}").collect() for x in ("sf0.001", "sf0.01"))
    assert all(r["file"].startswith("part-") and len(r["file"]) < 20 and len(r["sha256"]) == 64 for r in small + large)
    assert sum(r["bytes"] for r in large) > 3 * sum(r["bytes"] for r in small)


def test_folder_manifest_sees_rewritten_and_deleted_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(90).select("id", (F.col("id") % 3).alias("k")).write.partitionBy("k").parquet(path)
    before = {r["file"]: r["sha256"] for r in S.folder_manifest(spark, path, "k").collect()}
    spark.range(5).select("id", F.lit(1).alias("k")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("k").parquet(path)
    S.drop_partitions(spark, path, ["k=2"])
    after = {r["file"]: r["sha256"] for r in S.folder_manifest(spark, path, "k").collect()}
    assert set(before) == {"0", "1", "2"} and set(after) == {"0", "1"}
    assert before["0"] == after["0"] and before["1"] != after["1"]


def test_segment_manifest_reads_the_segments(spark):
    df = spark.createDataFrame([("A", 1, None, 2), ("A", 2, None, None), ("B", None, 3, 4)], "seg string, x int, y int, z int")
    got = {(r["segment"], r["spec"], r["ord"], r["feature"]) for r in S.segment_manifest(df, "seg", ["x", "y", "z"]).collect()}
    assert got == {("A", "any", 0, "x"), ("A", "any", 1, "z"), ("A", "complete", 0, "x"), ("B", "any", 0, "y"), ("B", "any", 1, "z"), ("B", "complete", 0, "y"), ("B", "complete", 1, "z")}
    assert "s15_feature_manifest" not in registry.QUERIES
