import json

from langatlas.operators import geo as G
from langatlas.session import scratch_path
from langatlas.sources.bridge import reply_body
from langatlas.sources.geocode import parse_geocode, split_replies
from tests.conftest import rows_of, srt
from pyspark.sql import functions as F


def _comp(name, *types):
    return {"long_name": name, "types": list(types)}


def _body(status, results):
    return json.dumps({"status": status, "results": results})


def test_parse_replies(spark):
    ok = _body("OK", [
        {"address_components": [_comp("Bangkok", "administrative_area_level_1", "political"),
                                _comp("Thailand", "country", "political")],
         "geometry": {"location": {"lat": 13.7, "lng": 100.5}}},
        {"address_components": [_comp("Other", "country", "political")],
         "geometry": {"location": {"lat": 0.0, "lng": 0.0}}}])
    no_country = _body("OK", [{"address_components": [_comp("X", "locality", "political")],
                               "geometry": {"location": {"lat": 1.0, "lng": 2.0}}}])
    replies = spark.createDataFrame([
        ("Bangkok", ok), ("Atlantis", _body("ZERO_RESULTS", [])), ("Xville", no_country),
        ("Broken", "{not json"), ("Cut", ok[:60]), ("List", "[1]"), ("Bare", "{}"),
        ("Empty", ""), ("Offline", None)], "location string, body string")
    got = rows_of(parse_geocode(replies), "location", "status", "city", "country", "lat", "lng",
                  "fault")
    faulty = [("Atlantis", "ZERO_RESULTS", None, None, None, None, "refused"),
              *((name, None, None, None, None, None, "malformed")
                for name in ("Broken", "Cut", "List", "Bare", "Empty")),
              ("Offline", None, None, None, None, None, "transport")]
    assert got == srt([("Bangkok", "OK", "Bangkok", "Thailand", 13.7, 100.5, None),
                       ("Xville", "OK", None, None, 1.0, 2.0, None), *faulty])
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    counts = split_replies(replies, good, bad)
    assert counts == {"replies": 9, "transport": 1, "malformed": 5, "refused": 1}
    assert rows_of(spark.read.parquet(good), "location") == srt([("Bangkok",), ("Xville",)])
    assert rows_of(spark.read.parquet(bad), "location", "fault") == srt(
        (f[0], f[-1]) for f in faulty)


def test_reply_body_roundtrip(spark):
    df = spark.createDataFrame([("Oslo", "OK", "East", "Norway", 59.9, 10.7)],
                               "location string, status string, city string, country string, "
                               "lat double, lng double")
    body = df.select("location", reply_body(F.col("status"), F.col("city"), F.col("country"),
                                            F.col("lat"), F.col("lng")).alias("body"))
    r = parse_geocode(body).first()
    assert (r["city"], r["country"], r["lat"], r["lng"]) == ("East", "Norway", 59.9, 10.7)


def test_latest_pending_upsert(spark):
    log = spark.createDataFrame([
        ("Oslo", "a", "NO", 1.0, 1.0, 1), ("Oslo", "b", "NO", 2.0, 2.0, 3),
        ("Oslo", "c", "NO", 3.0, 3.0, 2), ("Lima", None, None, None, None, 5)],
        "location string, city string, country string, lat double, lng double, seq bigint")
    latest = G.latest_geo(log)
    assert rows_of(latest, "location", "city", "seq") == srt([("Oslo", "b", 3), ("Lima", None, 5)])
    regions = spark.createDataFrame([("Oslo", 3), ("Lima", 1), ("Paris", 2), ("me@home", 1),
                                     ("Berlin", 1), (None, 4)], "location string, n bigint")
    pending = G.pending_locations(regions, latest)   # Lima known although its lookup failed
    assert rows_of(pending) == srt([("Berlin",), ("Paris",)])
    parsed = spark.createDataFrame([("Paris", "OK", "IDF", "France", 48.8, 2.3),
                                    ("Berlin", "ZERO_RESULTS", None, None, None, None)],
                                   "location string, status string, city string, "
                                   "country string, lat double, lng double")
    updates = G.resolve_lookups(pending, parsed)
    new_geo = G.upsert_geo(latest, updates)
    assert rows_of(new_geo, "location", "country", "lat") == srt([
        ("Oslo", "NO", 2.0), ("Lima", None, None), ("Paris", "France", 48.8),
        ("Berlin", None, None)])
    ex = G.location_exists(G.candidate_locations(regions), latest)
    assert dict((r["location"], r["known"]) for r in ex.collect())["Oslo"] is True


def test_single_key_exists(spark):
    geo = spark.createDataFrame([("Oslo",), ("Lima",)], "location string")
    assert G.location_known(geo, "Oslo") and not G.location_known(geo, "Rome")


def test_upsert_duplicates_deterministic(spark):
    cols = "location string, city string, country string, lat double, lng double, seq bigint"
    geo = spark.createDataFrame([("Oslo", "a", "NO", 1.0, 1.0, 0)], cols)
    upd = spark.createDataFrame([("Oslo", "late", "NO", 3.0, 3.0, 9), ("Oslo", "early", "NO", 2.0, 2.0, 4)],
                                cols)
    out = G.upsert_geo(geo, upd, seq_col="seq")
    assert rows_of(out, "location", "city") == [("Oslo", "late")]
    assert G.upsert_geo(geo, upd).count() == 1
