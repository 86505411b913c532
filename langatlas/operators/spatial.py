"""Spatial binning of the density export: universe of spots, bin index, bin
vectors and their energy threshold (the clustering input)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langatlas.functions.scalars import lenient_int
from langatlas.operators.scan import prefix_scan

# Fixed default from the reference: keep the largest bins holding 66 % of a
# language's energy.
ENERGY_SHARE = 0.66
# Fixed value: the literal reference turns every kept bin into Long.MaxValue.
LONG_MAX = 9223372036854775807


def dist_languages(dist: DataFrame) -> DataFrame:
    """``SELECT lang._id`` over the export (parts of a language are one)."""
    return dist.select(F.col("lang._id").alias("lang")).distinct()


def dist_by_language(dist: DataFrame) -> DataFrame:
    """``SELECT lang._id AS lang, coords``."""
    return dist.select(F.col("lang._id").alias("lang"), "coords")


def explode_coords(dist: DataFrame, keep_rejects: bool = False) -> DataFrame:
    """C9 + C11: languages with coordinates -> ``lang, lat, lng, density``.

    Triples may be numbers or text.  Position text that is not a number makes
    the row a reject (dropped, or flagged with ``keep_rejects``); a density
    that is not an integer counts as 0.
    """
    rows = (dist_by_language(dist).where(F.size("coords") > 0)
            .select("lang", F.explode("coords").alias("c")))
    return cast_triples(rows, keep_rejects)


def cast_triples(rows: DataFrame, keep_rejects: bool = False) -> DataFrame:
    """C11 on rows ``lang, c`` (one triple each); see ``explode_coords``."""
    lat = F.try_element_at("c", F.lit(1)).try_cast("double")
    lng = F.try_element_at("c", F.lit(2)).try_cast("double")
    density = lenient_int(F.try_element_at("c", F.lit(3)))
    out = rows.select("lang", lat.alias("lat"), lng.alias("lng"), density.alias("density"))
    ok = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    if keep_rejects:
        return out.withColumn("rejected", ~ok)
    return out.where(ok)


def global_universe(coords: DataFrame) -> DataFrame:
    """E6 + C10: total positive density per exact spot."""
    return (coords.where(F.col("density") > 0).groupBy("lat", "lng")
            .agg(F.sum("density").cast("bigint").alias("total")))


def bin_index(universe: DataFrame) -> DataFrame:
    """dense 0-based bin per spot in (lat, lng) order.

    A global order over all spots; computed with ``prefix_scan`` (range
    partitions + per-partition offsets) instead of one un-partitioned window.
    """
    spots = universe.select("lat", "lng")
    return (prefix_scan(spots, [], ["lat", "lng"], pos_col="bin")
            .select("lat", "lng", F.col("bin").cast("bigint").alias("bin")))


def bin_vectors(coords: DataFrame, index: DataFrame) -> DataFrame:
    """D7j + E7: per language and bin the summed positive density (sparse:
    zero bins have no row).  Coordinates are summed per spot before the join
    with the index, which holds one row per spot and is joined on (lat, lng)."""
    per_spot = (coords.where(F.col("density") > 0).groupBy("lang", "lat", "lng")
                .agg(F.sum("density").cast("bigint").alias("value")))
    return per_spot.join(index, ["lat", "lng"]).select("lang", "bin", "value")


def half_up(x: F.Column) -> F.Column:
    """``round`` to an integer, half up (values here are >= 0)."""
    return F.floor(x + 0.5).cast("bigint")


def energy_bins(bins: DataFrame, share: float = ENERGY_SHARE) -> DataFrame:
    """E8 + F5 (documented intent): per language keep the largest bins until
    their energy reaches ``share`` of the vector's energy; a kept bin becomes
    ``round(100 * b / ||v||)``.

    Bins are ordered ``b desc, bin asc``; a bin is kept when the energy of the
    bins before it is still below the threshold.  Squares and their sums are
    exact decimals (a Long square overflows past ~3.04e9; double sums depend on
    the partitioning), and ``sqrt(before) < share * sqrt(energy)`` is compared
    as ``before * 10^4 < (100 * share)^2 * energy``; beyond 38 digits the query
    fails instead of rounding.  The running sum and the norm come from one
    ``prefix_scan``: no language is ever one task.
    """
    value = F.col("value").cast("decimal(19,0)")
    sq = bins.withColumn("b2", (value * value).cast("decimal(38,0)"))
    percent = Decimal(str(share)) * 100
    if percent != int(percent):
        raise ValueError("share is a whole number of percent")
    scanned = prefix_scan(sq, ["lang"], [F.col("value").desc(), F.col("bin").asc()],
                          value_col="b2", before_col="before", total_col="energy")
    norm = F.sqrt(F.col("energy").cast("double"))
    below = (F.col("before") * F.lit(10_000).cast("decimal(5,0)")
             < F.col("energy") * F.lit(int(percent) ** 2).cast("decimal(5,0)"))
    return (scanned.where(below)
            .select("lang", "bin", F.col("value").alias("b"),
                    norm.alias("norm"),
                    half_up(F.lit(100.0) * F.col("value") / norm).alias("value")))


def energy_bins_literal(bins: DataFrame) -> DataFrame:
    """F5 literal reference behaviour: the first step divides by an empty
    partial energy, so only the top bin survives, with value Long.MaxValue.
    One aggregate (``max_by``) -- combined map-side, no window."""
    top = (bins.groupBy("lang")
           .agg(F.max_by("bin", F.struct(F.col("value"), (-F.col("bin")).alias("nb")))
                .alias("bin")))
    return top.select("lang", "bin", F.lit(LONG_MAX).cast("bigint").alias("value"))
