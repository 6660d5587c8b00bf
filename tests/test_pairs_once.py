"""Pairs of overlapping variants are met once each, not once a point that they share."""

import __spark_entry__


def test_overlapping_variants_meet_without_an_aggregate_of_pairs(spark, tmp_path):
    sizes = [(k, 1 + k * 5 % 13) for k in range(60)]
    spark.createDataFrame([(k, "n", "b", "t", size, 1.0) for k, size in sizes], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = __spark_entry__.queries()["interval_variants_overlap"](spark, str(tmp_path))
    end = {k: size + 1 + k % 7 for k, size in sizes}
    want = sorted((a, b, max(x, y)) for a, x in sizes for b, y in sizes if a < b and x < end[b] and y < end[a])
    assert sorted((r.a, r.b, r.witness) for r in got.collect()) == want
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
