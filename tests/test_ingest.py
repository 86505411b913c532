from pyspark.sql import functions as F

from langatlas.session import scratch_path
from langatlas.streaming.ingest import ingested, run_ingest


def test_two_runs_then_rerun_adds_nothing(spark):
    schema = "id bigint, v string"
    landing, target, ckpt = (scratch_path(spark, n) for n in ("land", "tgt", "ckpt"))
    spark.range(0, 100).select("id", F.col("id").cast("string").alias("v")) \
        .repartition(3).write.parquet(f"{landing}/d=1")
    st = spark.createDataFrame([], schema).schema
    run_ingest(spark, st, f"{landing}/*", target, ckpt, key="id", files_per_batch=1)
    assert ingested(spark, target).count() == 100
    # second delivery: new ids plus re-delivered ones
    spark.range(90, 150).select("id", F.col("id").cast("string").alias("v")) \
        .write.parquet(f"{landing}/d=2")
    run_ingest(spark, st, f"{landing}/*", target, ckpt, key="id", files_per_batch=1)
    run_ingest(spark, st, f"{landing}/*", target, ckpt, key="id", files_per_batch=1)
    out = ingested(spark, target)
    assert out.count() == 150 and out.select("id").distinct().count() == 150


def test_incremental_equals_one_batch(spark):
    schema = spark.createDataFrame([], "id bigint, v string").schema
    landing = scratch_path(spark, "land2")
    for d, (lo, hi) in enumerate([(0, 40), (30, 80), (75, 120)]):
        spark.range(lo, hi).select("id", F.col("id").cast("string").alias("v")) \
            .write.parquet(f"{landing}/d={d}")
    inc, inc_ck = scratch_path(spark, "inc"), scratch_path(spark, "inc-ck")
    run_ingest(spark, schema, f"{landing}/d=0", inc, inc_ck, key="id")
    run_ingest(spark, schema, f"{landing}/*", inc, inc_ck, key="id")
    one, one_ck = scratch_path(spark, "one"), scratch_path(spark, "one-ck")
    run_ingest(spark, schema, f"{landing}/*", one, one_ck, key="id", files_per_batch=100)
    a = sorted(r["id"] for r in ingested(spark, inc).collect())
    b = sorted(r["id"] for r in ingested(spark, one).collect())
    assert a == b == list(range(120))


GEO_COLS = "location string, city string, country string, lat double, lng double"


def known(spark, *rows):
    from langatlas.sinks.writers import geo_table
    table = geo_table(spark, scratch_path(spark, "geo"))
    table.update(lambda _: spark.createDataFrame(list(rows), GEO_COLS))
    return table


def test_geo_fill_replay_and_misses(spark):
    from langatlas.sources.bridge import reply_body
    from langatlas.streaming.geo_fill import run_geo_fill
    replies, ck = (scratch_path(spark, n) for n in ("grep", "gck"))
    table = known(spark, ("Oslo", "x", "NO", 1.0, 2.0))
    src = spark.createDataFrame([("Lima", "OK", "LIM", "Peru", -12.0, -77.0),
                                 ("Rome", "ZERO_RESULTS", None, None, None, None),
                                 ("Oslo", "OK", "new", "NO", 9.0, 9.0)],
                                "location string, status string, city string, country string, "
                                "lat double, lng double")
    body = src.select("location", reply_body(F.col("status"), F.col("city"), F.col("country"),
                                             F.col("lat"), F.col("lng")).alias("body"))
    body.write.parquet(f"{replies}/d=1")
    run_geo_fill(spark, f"{replies}/*", table, ck)
    body.write.parquet(f"{replies}/d=2")                    # re-delivered
    run_geo_fill(spark, f"{replies}/*", table, ck)
    got = {r["location"]: (r["city"], r["lat"]) for r in table.read().collect()}
    # Oslo was known: its reply is skipped; Rome's miss is recorded with nulls
    assert got == {"Oslo": ("x", 1.0), "Lima": ("LIM", -12.0), "Rome": (None, None)}


def test_geo_fill_takes_the_ok_reply_in_either_order(spark):
    from langatlas.sources.bridge import reply_body
    from langatlas.streaming.geo_fill import run_geo_fill
    ok = spark.range(1).select(F.lit("Oslo").alias("location"), reply_body(
        F.lit("OK"), F.lit("c"), F.lit("NO"), F.lit(59.9), F.lit(10.7)).alias("body"))
    bad = spark.createDataFrame([("Oslo", "{broken"), ("Oslo", None)], "location string, body string")
    for replies in (ok.union(bad), bad.union(ok)):
        folder, ck = (scratch_path(spark, n) for n in ("replies", "ck"))
        table = known(spark, ("Lima", None, None, 1.0, 1.0))
        replies.coalesce(1).write.parquet(f"{folder}/delivery=1")
        run_geo_fill(spark, f"{folder}/*", table, ck)
        got = {r["location"]: r["lat"] for r in table.read().collect()}
        assert got == {"Oslo": 59.9, "Lima": 1.0}
