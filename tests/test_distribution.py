from pyspark.sql import Window
from pyspark.sql import functions as F

from langatlas.operators import distribution as D
from tests.conftest import make_repos, owner, rows_of, srt


def _repos(spark):
    return make_repos(spark, [
        (1, owner("Bangkok"), [("Scala", 150), ("Java", 50)]),       # 200: kept
        (2, owner("Bangkok"), [("Scala", 100), ("Java", 99)]),       # 199: dropped (C1)
        (3, owner("Oslo", repos=1), [("Go", 500)]),                  # repos 1: dropped (C2)
        (4, owner("Oslo", repos=2, followers=9), [("Go", 500)]),     # followers 9: dropped
        (5, owner("Oslo", repos=2, followers=10), [("Go", 500)]),    # kept
        (6, owner(None), [("Go", 300), ("Rust", 10)]),               # null location group
        (7, None, [("Go", 1000)]),                                   # missing owner
        (8, owner("Oslo"), []),                                      # no languages
    ])


def test_lang_region_loc_filters(spark):
    out = D.lang_region_loc(_repos(spark))
    assert rows_of(out, "lang", "location", "loc") == srt([
        ("Scala", "Bangkok", 150), ("Java", "Bangkok", 50), ("Go", "Oslo", 500),
        ("Go", None, 300), ("Rust", None, 10)])


def test_region_counts_unfiltered(spark):
    out = D.region_counts(_repos(spark))
    got = {r["location"]: r["n"] for r in out.collect()}
    assert got == {"Bangkok": 2, "Oslo": 4, None: 2}


def test_clean_and_rank(spark):
    lr = spark.createDataFrame([
        ("Go", "Oslo", 5), ("Go", "Bergen", 5), ("Go", "Earth", 99), ("Go", None, 100),
        ("Go", "x" * 49, 100), ("Go", "Worldwide", 7), ("Go", "Tromso", 9),
        ("message", "Oslo", 1)], "lang string, location string, loc bigint")
    ranked = D.lang_top_regions(lr)
    assert rows_of(ranked, "lang", "rank", "location") == srt([
        ("Go", 1, "Tromso"), ("Go", 2, "Bergen"), ("Go", 3, "Oslo")])


def test_locate_and_nest(spark):
    lr = spark.createDataFrame([("Go", "Oslo", 5), ("Go", "Nowhere", 3), ("C", "Lima", 2)],
                               "lang string, location string, loc bigint")
    geo = spark.createDataFrame([("Oslo", None, None, 59.9, 10.7), ("Lima", None, None, None, None)],
                                "location string, city string, country string, lat double, lng double")
    dens = D.locate(lr, geo)
    assert rows_of(dens, "lang", "lat", "lng", "density") == [("Go", 59.9, 10.7, 5)]
    nested = {r["lang"]["_id"]: r for r in D.nest_coords(lr, geo).collect()}
    assert nested["C"]["coords"] == []
    assert nested["Go"]["coords"] == [[59.9, 10.7, 5.0]]
    assert '"Nowhere":3' in nested["Go"]["lang"]["value"]


def test_total_label(spark):
    dens = spark.createDataFrame([("A", 10000), ("B", 10001), ("B", 2500)],
                                 "lang string, density bigint")
    got = {r["lang"]: r["label"] for r in D.lang_total_label(dens).collect()}
    assert got == {"A": "10000 LoC", "B": "12K LoC"}


def test_listed_languages_skip_missing_location(spark):
    lr = spark.createDataFrame([("A", None, 10), ("B", "Oslo", 0), ("C", "Oslo", 3)],
                               "lang string, location string, loc bigint")
    assert rows_of(D.listed_languages(lr)) == [("C",)]


def test_rank_matches_window_with_hot_group(spark):
    rows = [("hot", f"loc{i:04d}", i % 37) for i in range(900)]
    rows += [(f"l{j}", f"loc{i:04d}", i) for j in range(20) for i in range(j + 1)]
    lr = spark.createDataFrame(rows, "lang string, location string, loc bigint")
    ours = D.lang_top_regions(lr)
    w = Window.partitionBy("lang").orderBy(F.col("loc").desc(), "location")
    ref = D.clean_regions(lr).withColumn("rank", F.row_number().over(w).cast("bigint"))
    assert rows_of(ours, "lang", "location", "rank") == rows_of(ref, "lang", "location", "rank")


def test_listed_languages_from_export_matches_long_form(spark):
    lr = spark.createDataFrame([("A", None, 10), ("B", "Oslo", 0), ("C", "Oslo", 3),
                                ("C", None, 4), ("D", "Lima", 1)],
                               "lang string, location string, loc bigint")
    geo = spark.createDataFrame([("Oslo", None, None, 1.0, 2.0)],
                                "location string, city string, country string, lat double, lng double")
    export = D.nest_coords(lr, geo)
    assert rows_of(D.listed_languages_export(export)) == rows_of(D.listed_languages(lr))
