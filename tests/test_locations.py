from pyspark.sql import functions as F

from langatlas.functions.locations import (is_density_location, is_geocodable,
                                           normalize_location)


def _eval(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "location string")
    return [r[0] for r in df.select(expr(F.col("location"))).collect()]


def test_geocodable_bounds_and_exclusions(spark):
    values = ["ab", "abc", "abcdefghij", "abcdefghijk", "Bangkok", "me@home", "Somewhere",
              "nowhere", "Worldwide", "worldwide", "Earth", "", None, "Paris"]
    got = _eval(spark, values, lambda c: F.coalesce(is_geocodable(c), F.lit(False)))
    assert dict(zip(values, got)) == {
        "ab": False, "abc": True, "abcdefghij": True, "abcdefghijk": False, "Bangkok": True,
        "me@home": False, "Somewhere": False, "nowhere": False, "Worldwide": False,
        "worldwide": False, "Earth": False, "": False, None: False, "Paris": True}


def test_density_location_lengths_and_case(spark):
    values = ["x" * 48, "x" * 49, "EARTH", "The Internet", "the interweb", "0", "1", None,
              "Berlin"]
    got = _eval(spark, values, lambda c: F.coalesce(is_density_location(c), F.lit(False)))
    assert got == [True, False, False, False, False, False, False, False, True]


def test_null_markers_become_null(spark):
    got = _eval(spark, ["null", "undefined", "Null", "Oslo", None], normalize_location)
    assert got == [None, None, "Null", "Oslo", None]
