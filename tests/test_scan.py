import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from langatlas.operators.scan import prefix_scan
from tests.conftest import rows_of


def test_prefix_scan_matches_window_with_hot_group(spark):
    rnd = random.Random(7)
    rows = [("hot", i, rnd.randint(0, 50)) for i in range(3000)]          # a third of all rows
    rows += [(f"g{rnd.randint(0, 300)}", 10_000 + i, rnd.randint(0, 50)) for i in range(6000)]
    rows += [(None, 20_000 + i, 1) for i in range(5)]                      # null group
    df = spark.createDataFrame(rows, "g string, k bigint, v bigint")
    order = [F.col("v").desc(), F.col("k").asc()]
    ours = prefix_scan(df, ["g"], order, value_col="v", total_col="tot", num_partitions=7)
    w = Window.partitionBy("g").orderBy(*order)
    ref = df.select("g", "k", "v",
                    (F.row_number().over(w) - 1).alias("pos"),
                    F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                               F.lit(0)).alias("before"),
                    F.sum("v").over(Window.partitionBy("g")).alias("tot"))
    cols = ("g", "k", "pos", "before", "tot")
    assert rows_of(ours, *cols) == rows_of(ref, *cols)


def test_prefix_scan_global(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k"))
    out = prefix_scan(df, [], ["k"], num_partitions=9)
    assert all(r["pos"] == r["k"] for r in out.collect())


def test_prefix_scan_edges(spark):
    empty = spark.createDataFrame([], "g string, k bigint, v bigint")
    assert prefix_scan(empty, ["g"], ["k"], value_col="v").count() == 0
    one = spark.createDataFrame([("a", 1, 5)], "g string, k bigint, v bigint")
    r = prefix_scan(one, ["g"], ["k"], value_col="v", total_col="t").first()
    assert (r["pos"], r["before"], r["t"]) == (0, 0, 5)
    nulls = spark.createDataFrame([(None, i, i) for i in range(5)], "g string, k bigint, v bigint")
    got = sorted((r["k"], r["pos"], r["before"]) for r in
                 prefix_scan(nulls, ["g"], ["k"], value_col="v", num_partitions=3).collect())
    assert got == [(i, i, sum(range(i))) for i in range(5)]
