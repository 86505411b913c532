"""The landing's language lists: the lines of a task do not grow with the input."""

from pyspark.sql import functions as F

from langatlas.sources import bridge


def test_parts_follow_the_number_of_lines(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr(
        "id div 4 AS l_orderkey", "id % 7 AS l_partkey", "CAST(id % 4 AS INT) AS l_linenumber",
        "CAST(2 AS DECIMAL(15,2)) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(7).selectExpr("id AS p_partkey", "concat('b', id) AS p_brand", "'t' AS p_type") \
        .write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(bridge, "TASK_ROWS", 100, raising=False)
    langs = bridge.Bridge(spark, str(tmp_path)).langs
    sizes = [r["count"] for r in langs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 400
