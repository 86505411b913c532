"""The versioned location table: pinned readers, two writers, dead writers, merging."""

import pytest

from langatlas.operators.geo import upsert_geo
from langatlas.session import scratch_path
from langatlas.sinks import versions
from langatlas.sinks.writers import geo_table

COLS = "location string, city string, country string, lat double, lng double"


@pytest.fixture
def table(spark):
    return geo_table(spark, scratch_path(spark, "geo"))


def rows(spark, **cities):
    return spark.createDataFrame([(k, v, None, None, None) for k, v in cities.items()], COLS)


def cities(df):
    return {r["location"]: r["city"] for r in df.collect()}


def test_readers_hold_their_version(spark, table):
    assert table.version() == 0 and table.read().collect() == []
    one = table.update(lambda _: rows(spark, Oslo="a", Lima="b"))
    before = table.read()
    two = table.update(lambda _: rows(spark, Lima="c", Rome=None))
    assert (one, two) == (1, 2)
    assert cities(before) == cities(table.read(one)) == {"Oslo": "a", "Lima": "b"}
    assert cities(table.read()) == {"Oslo": "a", "Lima": "c", "Rome": None}


def test_two_writers_get_one_version_each(spark, table):
    table.update(lambda _: rows(spark, Oslo="a"))
    calls = []

    def slow(known):
        calls.append(cities(known(rows(spark, Lima="x"))))
        if len(calls) == 1:       # another writer commits while this one is at work
            geo_table(spark, table.path).update(lambda _: rows(spark, Lima="first"))
        new = rows(spark, Lima="second", Rome="r")
        return new.join(known(new).select("location"), "location", "left_anti")

    assert table.update(slow) == 3 and len(calls) == 2 and calls[1]["Lima"] == "first"
    assert cities(table.read()) == {"Oslo": "a", "Lima": "first", "Rome": "r"}


def test_a_writer_that_dies_before_its_commit_changes_nothing(spark, table, monkeypatch):
    table.update(lambda _: rows(spark, Oslo="a"))
    with monkeypatch.context() as m:
        def lost(*_):
            raise RuntimeError("lost")
        m.setattr(table.files, "create", lost)
        with pytest.raises(RuntimeError):
            table.update(lambda _: rows(spark, Oslo="half"))
    assert cities(table.read()) == {"Oslo": "a"} and table.version() == 1
    table.update(lambda _: rows(spark, Lima="b"))            # the same rows as without the death
    assert cities(table.read()) == {"Oslo": "a", "Lima": "b"}
    assert table.vacuum(oldest=1) == 1 and cities(table.read(1)) == {"Oslo": "a"}


def test_a_batch_counts_once(spark, table):
    assert table.update(lambda _: rows(spark, Oslo="a"), ("stream", 0)) == 1
    assert table.update(lambda _: rows(spark, Oslo="again"), ("stream", 0)) == 1
    assert table.update(lambda _: rows(spark, Oslo="b"), ("other", 0)) == 2
    assert table.update(lambda _: rows(spark, Oslo="c"), ("stream", 1)) == 3
    assert cities(table.read()) == {"Oslo": "c"}


def test_many_versions_are_merged_and_old_ones_removed(spark, table, monkeypatch):
    monkeypatch.setattr(versions, "MERGE_AT", 3)
    for n in range(6):
        table.update(lambda _, n=n: rows(spark, Oslo=str(n), **{f"L{n}": "x"}))
    assert len(table.commit(6)["folders"]) <= 3
    want = {"Oslo": "5", **{f"L{n}": "x" for n in range(6)}}
    assert cities(table.read()) == want
    assert table.vacuum() > 0 and cities(table.read()) == want and table.version() == 6
    table.update(lambda known: upsert_geo(known(rows(spark, Oslo="z")), rows(spark, Oslo="z")))
    assert cities(table.read())["Oslo"] == "z"


def test_only_the_buckets_of_the_keys_are_read(spark, table):
    table.update(lambda _: rows(spark, **{f"L{n}": "x" for n in range(40)}))
    seen = table.read(keys=rows(spark, L7=None))
    assert 0 < seen.count() < 40 and seen.where("location = 'L7'").count() == 1
    plan = seen._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and versions.BUCKET in plan.split("PartitionFilters")[1][:80]


def test_empty_update(spark, table):
    assert table.update(lambda _: rows(spark, Oslo="a").where("false")) == 1
    assert table.read().collect() == []
