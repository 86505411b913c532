import os
import time

from langatlas.session import scratch_path
from langatlas.sinks.catalogue import Catalogue, fingerprint
from langatlas.sinks.files import Files


def written(spark, n, path, mode="overwrite"):
    spark.range(n).write.mode(mode).parquet(path)


def counting(spark, path):
    built = []
    return built, lambda: built.append(1) or spark.read.parquet(path).selectExpr("id * 2 AS x")


def test_unchanged_input_is_read_changed_input_rebuilt(spark):
    path, stages = scratch_path(spark, "input"), Catalogue(spark, scratch_path(spark, "cat"))
    written(spark, 5, path)
    built, build = counting(spark, path)
    assert stages.stage("double", [path], build).count() == 5
    assert stages.stage("double", [path], build).count() == 5 and len(built) == 1
    written(spark, 3, path, "append")
    assert stages.stage("double", [path], build).count() == 8 and len(built) == 2
    assert stages.stage("double", [path], build, use_cached=False).count() == 8 and len(built) == 3
    assert stages.stage("double", [path], build, factor=3).count() == 8 and len(built) == 4


def test_versions_that_nobody_needs_are_removed(spark):
    path, stages = scratch_path(spark, "input"), Catalogue(spark, scratch_path(spark, "cat"))
    for n in range(1, 5):
        written(spark, n, path)
        built, build = counting(spark, path)
        before = stages.stage("double", [path], build)
        assert before.count() == n
    assert len(stages.versions("double", [path])) == 2       # today's and the one before
    assert before.count() == 4


def test_a_half_written_version_is_not_found(spark):
    path, root = scratch_path(spark, "input"), scratch_path(spark, "cat")
    written(spark, 4, path)
    stages = Catalogue(spark, root)

    def broken(folder):
        spark.range(2).write.parquet(folder)
        raise RuntimeError("lost")

    try:
        stages.folder("double", [path], broken)
    except RuntimeError:
        pass
    built, build = counting(spark, path)
    assert stages.stage("double", [path], build).count() == 4 and built == [1]


def test_the_second_of_two_builders_keeps_the_first_version(spark):
    path, stages = scratch_path(spark, "input"), Catalogue(spark, scratch_path(spark, "cat"))
    written(spark, 4, path)

    def late(folder):
        other = Catalogue(spark, stages.root)
        other.folder("double", [path], lambda to: spark.range(1).write.parquet(to))
        spark.range(9).write.parquet(folder)

    place = stages.folder("double", [path], late)
    assert spark.read.parquet(place).count() == 1
    assert not [n for n in Files(spark).names(os.path.dirname(place)) if n.startswith("_")]


def test_fingerprint_sees_length_time_and_names(spark):
    path = scratch_path(spark, "files")
    written(spark, 4, path)
    seen = fingerprint(spark, [path])
    assert fingerprint(spark, [path]) == seen
    (part,) = [n for n in Files(spark).names(path) if n.startswith("part-")][:1]
    file = f"{path}/{part}"
    one = fingerprint(spark, [file])
    time.sleep(0.01)
    os.utime(file.removeprefix("file:"), None)
    assert fingerprint(spark, [path]) != seen and fingerprint(spark, [file]) != one


def test_create_is_exclusive(spark):
    files, path = Files(spark), scratch_path(spark, "one")
    assert files.create(path, "a") and not files.create(path, "b")
    assert spark.read.text(path).collect()[0][0] == "a"
    assert files.names(scratch_path(spark, "nothing")) == []
