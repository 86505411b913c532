import math

from pyspark.sql import functions as F

from langatlas.operators import spatial as S
from langatlas.schemas import DIST, DIST_TEXT
from tests.conftest import rows_of, srt


def _dist(spark):
    big = 4_000_000_000.0  # squares overflow a Long (E8)
    data = [
        (("A", "{}"), [[1.0, 1.0, 10.0], [1.0, 1.0, 5.0], [2.0, 2.0, 3.0], [3.0, 3.0, 0.0]]),
        (("B", "{}"), [[2.0, 2.0, 7.0]]),
        (("C", "{}"), []),                               # no coordinates (C9)
        (("D", "{}"), [[3.0, 3.0, 0.0]]),                 # all-zero language
        (("E", "{}"), [[4.0, 4.0, big], [1.0, 1.0, big]]),
    ]
    return spark.createDataFrame(data, DIST)


def test_universe_and_index(spark):
    coords = S.explode_coords(_dist(spark))
    uni = S.global_universe(coords)
    assert rows_of(uni, "lat", "lng", "total") == srt([
        (1.0, 1.0, 15 + 4_000_000_000), (2.0, 2.0, 10), (4.0, 4.0, 4_000_000_000)])
    idx = S.bin_index(uni)
    assert rows_of(idx, "lat", "lng", "bin") == srt([(1.0, 1.0, 0), (2.0, 2.0, 1), (4.0, 4.0, 2)])


def test_bin_index_many_spots_dense(spark):
    spots = spark.range(0, 2000).select((F.col("id") % 97).cast("double").alias("lat"),
                                        (F.col("id") * 7 % 1000).cast("double").alias("lng"),
                                        F.lit(1).cast("bigint").alias("total")).distinct()
    idx = S.bin_index(spots).orderBy("bin").collect()
    assert [r["bin"] for r in idx] == list(range(len(idx)))
    keys = [(r["lat"], r["lng"]) for r in idx]
    assert keys == sorted(keys)


def test_lenient_cast_text(spark):
    dist = spark.createDataFrame([(("A", None), [["1.5", "2", "12"], ["x", "2", "3"],
                                                 ["1", "1", "7.5"], ["1", "1", "abc"]])],
                                 DIST_TEXT)
    out = S.explode_coords(dist, keep_rejects=True)
    # "7.5" and "abc" are not integers: density 0, as the reference's toInt
    assert rows_of(out, "lat", "lng", "density", "rejected") == srt([
        (1.5, 2.0, 12, False), (None, 2.0, 3, True), (1.0, 1.0, 0, False),
        (1.0, 1.0, 0, False)])
    assert S.explode_coords(dist).count() == 3


def test_energy_intent_and_literal(spark):
    coords = S.explode_coords(_dist(spark))
    idx = S.bin_index(S.global_universe(coords))
    bins = S.bin_vectors(coords, idx)
    assert rows_of(bins, "lang", "bin", "value") == srt([
        ("A", 0, 15), ("A", 1, 3), ("B", 1, 7), ("E", 0, 4_000_000_000), ("E", 2, 4_000_000_000)])
    kept = {(r["lang"], r["bin"]): r["value"] for r in S.energy_bins(bins).collect()}
    # A: norm sqrt(234)=15.3; 15 alone is 0.98 of the norm >= 0.66 -> one bin
    assert kept[("A", 0)] == round(100 * 15 / math.sqrt(234)) and ("A", 1) not in kept
    assert kept[("B", 1)] == 100
    # E: two equal bins; the first (lower bin) holds 0.707 of the norm -> one bin
    assert kept[("E", 0)] == 71 and ("E", 2) not in kept
    lit = {r["lang"]: (r["bin"], r["value"]) for r in S.energy_bins_literal(bins).collect()}
    assert lit == {"A": (0, S.LONG_MAX), "B": (1, S.LONG_MAX), "E": (0, S.LONG_MAX)}


def test_energy_threshold_property(spark):
    rows = [(f"L{j}", i, (i * 7919 + j * 31) % 50 + 1) for j in range(12) for i in range(60)]
    bins = spark.createDataFrame(rows, "lang string, bin bigint, value bigint")
    kept = S.energy_bins(bins).collect()
    by_lang = {}
    for r in kept:
        by_lang.setdefault(r["lang"], []).append(r["b"])
    for j in range(12):
        vals = sorted((v for (lang, _, v) in rows if lang == f"L{j}"), reverse=True)
        norm = math.sqrt(sum(v * v for v in vals))
        got = sorted(by_lang[f"L{j}"], reverse=True)
        assert math.sqrt(sum(v * v for v in got)) >= 0.66 * norm
        assert math.sqrt(sum(v * v for v in got[:-1])) < 0.66 * norm
        assert got == vals[:len(got)]


def test_energy_is_exact_in_any_partitioning(spark):
    import random
    r = random.Random(7)
    rows = [(f"L{i % 3}", i, r.randrange(10 ** 8, 10 ** 10)) for i in range(600)]
    bins = spark.createDataFrame(rows, "lang string, bin bigint, value bigint")
    want = []
    for lang in ("L0", "L1", "L2"):
        mine = sorted(((v, b) for g, b, v in rows if g == lang), key=lambda x: (-x[0], x[1]))
        total, before = sum(v * v for v, _ in mine), 0
        for v, b in mine:
            if before * 10_000 < 4356 * total:
                want.append((lang, b, v))
            before += v * v
    for n in (1, 3, 7):
        got = S.energy_bins(bins.repartition(n)).select("lang", "bin", "b").collect()
        assert sorted(tuple(x) for x in got) == sorted(want)
