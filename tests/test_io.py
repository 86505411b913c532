import json
import os

import pytest

from pyspark.sql import functions as F

from langatlas.session import scratch_path
from langatlas.schemas import DIST
from langatlas.sinks.writers import overwrite_stage, write_dist_json
from langatlas.sources.dist_json import location_entries, read_dist_json
from langatlas.operators.spatial import dist_languages, explode_coords
from tests.conftest import rows_of, srt


def test_read_export_top_level_array(spark):
    path = scratch_path(spark, "export")
    os.makedirs(path, exist_ok=True)
    doc = [{"lang": {"_id": "Go", "value": {"Oslo": 12, "null": 3}},
            "coords": [[59.9, 10.7, 12], [59.9, 10.7, 4]]},
           {"lang": {"_id": "Zig", "value": ["Lima", 5]}, "coords": []}]
    with open(os.path.join(path, "dist.json"), "w") as fh:
        json.dump(doc, fh)
    dist = read_dist_json(spark, path, view="dists_test")
    assert dist.count() == 2
    assert rows_of(spark.sql("SELECT lang._id AS lang, size(coords) AS n FROM dists_test")) == srt(
        [("Go", 2), ("Zig", 0)])
    assert rows_of(location_entries(dist)) == srt([("Go", "Oslo", 12), ("Go", "null", 3),
                                                   ("Zig", "Lima", 5)])
    assert explode_coords(dist).agg(F.sum("density")).first()[0] == 16


def test_stage_overwrite(spark):
    path = scratch_path(spark, "stage")
    df = spark.range(5).withColumnRenamed("id", "x")
    overwrite_stage(df, path)
    assert overwrite_stage(df, path).count() == 5          # replaced, not appended


def test_export_of_missing_and_null_locations(spark):
    from langatlas.operators.distribution import nest_coords
    lr = spark.createDataFrame([("Go", None, 3), ("Go", "null", 4), ("Go", "Oslo", 5)],
                               "lang string, location string, loc bigint")
    geo = spark.createDataFrame([("Oslo", 59.9, 10.7)], "location string, lat double, lng double")
    row = nest_coords(lr, geo).first()
    assert json.loads(row["lang"]["value"]) == {"Oslo": 5, "null": 7}
    assert row["coords"] == [[59.9, 10.7, 5.0]]


def test_values_of_any_kind(spark):
    values = {"a": '{"x": 1, "undefined": null, "y": "many", "z": 2}', "b": '["Lima", 5]',
              "c": "[null, 7]", "d": "[]", "e": '["Lima"]', "f": "12", "g": "{cut", "h": None,
              "i": "{}", "j": '["a \\"b\\"", 3]'}
    dist = spark.createDataFrame([((k, v), []) for k, v in values.items()], DIST)
    assert rows_of(location_entries(dist)) == srt([
        ("a", "x", 1), ("a", "z", 2), ("b", "Lima", 5), ("c", "null", 7), ("j", 'a "b"', 3)])


def test_a_large_language_comes_in_parts(spark):
    from langatlas.operators.distribution import nest_coords
    rows = [("Go", f"p{n} \"q\"", n + 1) for n in range(100)] + [("Zig", "p1 \"q\"", 5), ("Zig", None, 2),
                                                                ("Ada", "nowhere", 1)]
    lr = spark.createDataFrame(rows, "lang string, location string, loc bigint")
    geo = spark.createDataFrame([(f"p{n} \"q\"", float(n), 1.0) for n in range(100)],
                                "location string, lat double, lng double")
    path = scratch_path(spark, "parts")
    write_dist_json(nest_coords(lr, geo, part_rows=10, pairs_for_single=True), path)
    dist = read_dist_json(spark, path, view=None)
    docs = dist.collect()
    sizes = [len(d["coords"]) for d in docs if d["lang"]["_id"] == "Go"]
    assert 5 < len(sizes) <= 10 and max(sizes) < 30 and sum(sizes) == 100
    assert any(d["lang"]["value"].startswith("[") for d in docs)
    assert rows_of(location_entries(dist)) == srt((a, b or "null", c) for a, b, c in rows)
    assert explode_coords(dist).where("lang = 'Go'").count() == 100
    assert rows_of(dist_languages(dist)) == srt([("Go",), ("Zig",), ("Ada",)])


def test_pretty_printed_array(spark):
    path = scratch_path(spark, "pretty")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "dist.json"), "w") as fh:
        json.dump([{"lang": {"_id": "Go", "value": {"Oslo": 12}}, "coords": [[1, 2, 3]]}], fh, indent=2)
    dist = read_dist_json(spark, path, view=None, multi_line=True)
    assert [r["lang"]["_id"] for r in dist.collect()] == ["Go"]
    with pytest.raises(Exception, match="(?i)malformed"):
        read_dist_json(spark, path, view=None).collect()


def test_load_repos_drops_error_texts_and_null_places(spark):
    from langatlas.sources.repos import load_repos
    from tests.conftest import make_repos, owner
    repos = make_repos(spark, [(1, owner("null"), [("message", 5), ("Go", 7)]),
                               (2, owner("Oslo"), [("Zig", 1)]), (3, None, [])])
    got = {r["id"]: (r["owner"] and r["owner"]["location"], [x["lang"] for x in r["langs"]])
           for r in load_repos(repos).collect()}
    assert got == {1: (None, ["Go"]), 2: ("Oslo", ["Zig"]), 3: (None, [])}
