"""Location upkeep: which owner locations still need geocoding, and the
location -> position table (last record wins, misses remembered)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langatlas.functions.locations import GEOCODE_MAX_LEN, GEOCODE_MIN_LEN, is_geocodable

GEO_COLUMNS = ("location", "city", "country", "lat", "lng")


def candidate_locations(regions: DataFrame) -> DataFrame:
    """C8 + E13: distinct non-missing locations of the region counts."""
    return regions.where(F.col("location").isNotNull()).select("location").distinct()


def geocodable_locations(regions: DataFrame, min_len: int = GEOCODE_MIN_LEN,
                         max_len: int = GEOCODE_MAX_LEN) -> DataFrame:
    """C7 + C8: distinct locations worth a geocoder request."""
    return candidate_locations(regions).where(is_geocodable("location", min_len, max_len))


def list_locations(geo: DataFrame) -> DataFrame:
    """The known locations."""
    return geo.select("location")


def pending_locations(regions: DataFrame, geo: DataFrame, min_len: int = GEOCODE_MIN_LEN,
                      max_len: int = GEOCODE_MAX_LEN) -> DataFrame:
    """D1j / G1 / S2: geocodable locations not yet in ``geo`` (a known location
    is skipped even when its lookup failed)."""
    return geocodable_locations(regions, min_len, max_len).join(
        list_locations(geo), "location", "left_anti")


def location_exists(candidates: DataFrame, geo: DataFrame) -> DataFrame:
    """C20 for many keys at once: ``location, known``."""
    known = list_locations(geo).distinct().select(
        F.col("location").alias("_k"), F.lit(True).alias("_hit"))
    return (candidates.join(known, candidates.location == known._k, "left")
            .select("location", F.coalesce("_hit", F.lit(False)).alias("known")))


def location_known(geo: DataFrame, location: str) -> bool:
    """C20 for one key: is ``location`` recorded?  Stops at the first match."""
    return geo.where(F.col("location") == location).limit(1).count() > 0


def latest_geo(geo_log: DataFrame, seq_col: str = "seq") -> DataFrame:
    """D3j: one row per location -- the record with the greatest ``seq_col``
    (later writes overwrite earlier ones).  ``max_by`` is combined map-side,
    so a location written a third of all times is still spread over tasks."""
    rec = F.struct(*[F.col(c) for c in GEO_COLUMNS[1:]], F.col(seq_col).alias(seq_col))
    return (geo_log.groupBy("location")
            .agg(F.max_by(rec, F.col(seq_col)).alias("r"))
            .select("location", *[F.col(f"r.{c}").alias(c) for c in (*GEO_COLUMNS[1:], seq_col)]))


def resolve_lookups(pending: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every requested location gets a record; a failed or non-OK lookup
    is recorded with nulls so it is not requested again."""
    ok = parsed.where(F.col("status") == "OK").select(
        F.col("location").alias("_p"), "city", "country", "lat", "lng")
    return (pending.select("location").join(ok, F.col("location") == F.col("_p"), "left")
            .select(*GEO_COLUMNS))


def one_record(updates: DataFrame, seq_col: str | None = None) -> DataFrame:
    """One row per location, deterministically: the latest by ``seq_col`` when given
    (sequential upserts, last wins), otherwise the greatest record (a replayed
    delivery carries identical records, so any fixed rule gives the same table)."""
    if seq_col is not None:
        return latest_geo(updates, seq_col).select(*GEO_COLUMNS)
    rec = F.struct(*[F.col(c) for c in GEO_COLUMNS[1:]])
    return (updates.groupBy("location").agg(F.max(rec).alias("r"))
            .select("location", *[F.col(f"r.{c}").alias(c) for c in GEO_COLUMNS[1:]]))


def upsert_geo(geo: DataFrame, updates: DataFrame, seq_col: str | None = None) -> DataFrame:
    """Insert-or-replace whole records by location, as a plain table: old rows
    whose location is updated are removed with an anti join.  A stored table takes
    ``one_record`` as a new version (``sinks.versions``)."""
    new = one_record(updates, seq_col)
    keep = geo.select(*GEO_COLUMNS).join(new.select("location"), "location", "left_anti")
    return keep.unionByName(new)
