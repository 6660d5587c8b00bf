"""Tables stored by a value: a value with most rows is not one task's."""

from pyspark.sql import functions as F

from graphloom.sources.tables import Tables


def test_a_frequent_value_is_in_several_files(spark, tmp_path):
    rows = spark.range(0, 400_000, 1, 16).select(F.sha2(F.col("id").cast("string"), 256).alias("s"), F.when(F.col("id") % 50 == 0, "rare").otherwise("often").alias("p"))
    name, old = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(name, "2MB")
    try:
        folder = Tables(spark, str(tmp_path)).stored("values", lambda: rows, "p")
    finally:
        spark.conf.set(name, old)
    back = spark.read.parquet(folder)
    assert back.count() == 400_000
    often = [f for f in back.inputFiles() if "/p=often/" in f]
    assert len(often) > 1 and {r.n for r in back.groupBy("p").agg(F.count("*").alias("n")).collect()} == {8000, 392_000}
