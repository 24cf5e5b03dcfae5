from pyspark.sql import functions as F

from quillgraph.streaming.resume import incremental


def test_each_record_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def go():
        incremental(spark, source, "id long, t string", target, str(tmp_path / "cp"), ["id"], lambda d: d.withColumn("n", F.length("t"))).awaitTermination()
        return sorted((r.id, r.n) for r in spark.read.parquet(target).collect())

    spark.createDataFrame([(1, "a"), (2, "bb"), (2, "bb")], "id long, t string").write.parquet(source)
    assert go() == [(1, 1), (2, 2)]
    spark.createDataFrame([(2, "bbbb"), (3, "ccc")], "id long, t string").write.mode("append").parquet(source)
    assert go() == [(1, 1), (2, 2), (3, 3)]
    assert go() == [(1, 1), (2, 2), (3, 3)]
