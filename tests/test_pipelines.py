from pyspark.sql import functions as F

from langatlas.plans import pipelines as P
from langatlas.session import scratch_path
from langatlas.sinks.writers import append_batch, geo_table
from langatlas.sources.bridge import reply_body
from tests.conftest import make_repos, owner, rows_of, srt

GEO = "location string, city string, country string, lat double, lng double"


def _repos(spark):
    return make_repos(spark, [
        (1, owner("Oslo"), [("A", 150), ("B", 60)]),
        (2, owner("Lima"), [("B", 300), ("A", 10), ("C", 5)]),
        (3, owner("Paris"), [("C", 500)]),
    ])


def test_density_correlation_graph(spark):
    repos = _repos(spark)
    geo = spark.createDataFrame([("Oslo", None, None, 59.9, 10.7), ("Lima", None, None, -12.0, -77.0)],
                                GEO)
    dens = P.language_density(repos, geo)
    assert rows_of(dens, "lang", "location", "density") == srt([
        ("A", "Oslo", 150), ("B", "Oslo", 60), ("A", "Lima", 10), ("B", "Lima", 300),
        ("C", "Lima", 5)])
    corr = P.language_correlation(repos, top_langs=2, top_partners=2)
    assert {r["lang"] for r in corr.collect()} == {"A", "B"}
    nodes, edges = P.language_graph(repos, min_loc=0)
    assert {r["lang"] for r in nodes.collect()} == {"A", "B"}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("A", "B"), ("B", "A"), ("B", "C")}


def test_pending_and_apply(spark):
    repos = _repos(spark)
    geo = spark.createDataFrame([("Oslo", "x", "NO", 59.9, 10.7)], GEO)
    pending = P.pending_locations(repos, geo)
    assert rows_of(pending) == srt([("Lima",), ("Paris",)])
    src = spark.createDataFrame([("Lima", "OK", "LIM", "Peru", -12.0, -77.0),
                                 ("Paris", "ZERO_RESULTS", None, None, None, None)],
                                "location string, status string, city string, country string, "
                                "lat double, lng double")
    replies = src.select("location", reply_body(F.col("status"), F.col("city"), F.col("country"),
                                                F.col("lat"), F.col("lng")).alias("body"))
    table = geo_table(spark, scratch_path(spark, "geo"))
    table.update(lambda _: geo)
    new = P.apply_geocodes(table, pending, replies)
    assert rows_of(new, "location", "country") == srt([("Oslo", "NO"), ("Lima", "Peru"),
                                                      ("Paris", None)])


def test_append_batches(spark):
    path = scratch_path(spark, "append")
    append_batch(spark.range(3), path)
    append_batch(spark.range(3, 5), path)
    assert spark.read.parquet(path).count() == 5


def test_page_after_cursor(spark):
    from langatlas.sources.repos import repos_since, resume_cursor
    src = spark.range(0, 10).select(F.col("id"), (F.col("id") * 10).alias("_id"))
    assert [r["id"] for r in repos_since(src, 0, page_size=3).collect()] == [0, 1, 2]
    assert [r["id"] for r in repos_since(src, 4, page_size=3).collect()] == [5, 6, 7]
    empty = src.where(F.col("id") < 0)
    cursor = resume_cursor(empty).scalar()            # 0: start from the beginning
    assert [r["id"] for r in repos_since(src, cursor, page_size=2).collect()] == [0, 1]
    cursor = resume_cursor(src.where(F.col("id") < 6)).scalar()
    assert [r["id"] for r in repos_since(src, cursor, page_size=2).collect()] == [6, 7]
