"""Where languages are written: per-location sums, cleaning, ranking, density.

All inputs are D1 repositories (``id, name, owner, langs``) or the long
``lang, location, loc`` table produced from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langatlas.functions.locations import MAX_DENSITY_LOCATION_LEN, is_density_location
from langatlas.functions.scalars import loc_label
from langatlas.operators.scan import rank_within

# Fixed defaults from the reference.
MIN_REPO_LOC = 200          # C1: skip repositories smaller than this
MIN_OWNER_REPOS = 1         # C2: owner must have more than this many repos
MIN_OWNER_FOLLOWERS = 10    # C2: ... and at least this many followers


def repo_total_loc(langs: str = "langs") -> F.Column:
    """Sum of LoC over a repository's language list (in-row, no shuffle)."""
    return F.aggregate(langs, F.lit(0).cast("bigint"), lambda acc, x: acc + x["loc"])


def repo_total(repos: DataFrame) -> F.Column:
    """The repository total: the ``loc_total`` column when the table carries it
    (computed once when the table is landed, so a filter on it is pushed into
    the Parquet scan and stays in generated code), else computed in-row."""
    return F.col("loc_total") if "loc_total" in repos.columns else repo_total_loc()


def lang_region_loc(repos: DataFrame, min_repo_loc: int = MIN_REPO_LOC,
                    min_owner_repos: int = MIN_OWNER_REPOS,
                    min_followers: int = MIN_OWNER_FOLLOWERS) -> DataFrame:
    """E1 (+C1, C2): LoC per (language, owner location) over active owners'
    non-trivial repositories.  A missing location is its own group.

    Filters run on the nested row before the explode; the aggregate is
    partially combined before its shuffle, so a hot language or location
    costs one partial row per task.
    """
    kept = repos.where((repo_total(repos) >= min_repo_loc)
                       & (F.col("owner.repos") > min_owner_repos)
                       & (F.col("owner.followers") >= min_followers))
    rows = kept.select(F.col("owner.location").alias("location"),
                       F.explode("langs").alias("l"))
    return (rows.groupBy(F.col("l.lang").alias("lang"), "location")
            .agg(F.sum("l.loc").cast("bigint").alias("loc")))


def region_counts(repos: DataFrame) -> DataFrame:
    """Number of repositories per owner location (no filter)."""
    return (repos.groupBy(F.col("owner.location").alias("location"))
            .agg(F.count(F.lit(1)).alias("n")))


def clean_regions(lang_region: DataFrame, max_len: int = MAX_DENSITY_LOCATION_LEN) -> DataFrame:
    """C5 + C6: drop non-place and over-long locations and non-numeric amounts."""
    return lang_region.where(
        (F.col("lang") != "message")
        & is_density_location("location", max_len)
        & F.col("loc").isNotNull()
        & ~F.isnan(F.col("loc").cast("double")))


def lang_top_regions(lang_region: DataFrame,
                     max_len: int = MAX_DENSITY_LOCATION_LEN) -> DataFrame:
    """each language's clean locations ranked by LoC (desc, then name)."""
    clean = clean_regions(lang_region, max_len)
    return rank_within(clean, ["lang"], [F.col("loc").desc(), F.col("location").asc()])


def locate(lang_region: DataFrame, geo: DataFrame) -> DataFrame:
    """D2j + C19: attach the geocoded position; rows without one are dropped.

    ``geo`` is one row per location (see ``geo.latest_geo``).  No broadcast
    hint: the join is planned from measured sizes (AQE turns it into a
    broadcast when the location table is small, a shuffle join otherwise).
    """
    g = geo.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        F.col("location").alias("_gloc"), "lat", "lng")
    return (lang_region.join(g, lang_region.location == g._gloc)
            .select("lang", "location", "lat", "lng", F.col("loc").alias("density")))


def coords_long(lang_region: DataFrame, geo: DataFrame) -> DataFrame:
    """E9 in long form (D2j, empty positions kept): every location of every
    language with its position, or nulls where it has none."""
    g = geo.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        F.col("location").alias("_gloc"), "lat", "lng")
    return (lang_region.join(g, lang_region.location == g._gloc, "left")
            .select("lang", "location", "lat", "lng", "loc"))


#: Locations of one export document at most, on average (see ``nest_coords``).
PART_ROWS = 4096


def nest_coords(lang_region: DataFrame, geo: DataFrame, part_rows: int = PART_ROWS,
                pairs_for_single: bool = False) -> DataFrame:
    """E9 / D3 (with D2j + C19): documents ``lang{_id, value}, coords, part`` -- a
    language's locations as JSON and the sorted ``[lat, lng, loc]`` of the
    positioned ones.  Languages with no positioned location keep empty lists.  A
    missing location and the text ``null`` are one key.

    A language of more than ``part_rows`` locations is cut into as many documents
    as keep them at that size (a location's part is by its hash), so no document
    and no task grows with a language; readers put the parts together again
    (``sources.dist_json``).  ``pairs_for_single``: a document of one location has
    ``[location, loc]``, the other form that exports come in.
    """
    merged = (lang_region.groupBy("lang", F.coalesce("location", F.lit("null")).alias("location"))
              .agg(F.sum("loc").alias("loc")))
    sizes = merged.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / part_rows).cast("int")
    j = coords_long(merged, geo).join(sizes, "lang").withColumn(
        "part", F.pmod(F.xxhash64("location"), parts).cast("int"))
    triple = F.when(F.col("lat").isNotNull(),
                    F.array("lat", "lng", F.col("loc").cast("double")))
    entries = F.sort_array(F.collect_list(F.struct(F.col("location").alias("k"),
                                                   F.col("loc").alias("v"))))
    per_part = j.groupBy("lang", "part").agg(entries.alias("e"),
                                             F.sort_array(F.collect_list(triple)).alias("coords"))
    value = F.to_json(F.map_from_entries("e"))
    if pairs_for_single:
        name = F.to_json(F.array(F.col("e")[0]["k"]))            # ["name"]
        pair = F.concat(F.left(name, F.length(name) - 1), F.lit(","),
                        F.col("e")[0]["v"].cast("string"), F.lit("]"))
        value = F.when(F.size("e") == 1, pair).otherwise(value)
    return per_part.select(F.struct(F.col("lang").alias("_id"), value.alias("value")).alias("lang"),
                           "coords", "part")


def listed_languages(lang_region: DataFrame) -> DataFrame:
    """Languages with positive LoC over known (non-missing) locations."""
    return (lang_region.where(F.col("location").isNotNull())
            .groupBy("lang").agg(F.sum("loc").alias("_t"))
            .where(F.col("_t") > 0).select("lang"))


def listed_languages_export(dist: DataFrame) -> DataFrame:
    """C16 on a density export: languages whose ``lang.value`` entries, other
    than the missing-location key ``"null"``, sum to more than zero."""
    from langatlas.sources.dist_json import location_entries
    return (location_entries(dist).where(F.col("location") != "null").groupBy("lang")
            .agg(F.sum("loc").alias("_t")).where(F.col("_t") > 0).select("lang"))


def heatmap_points(density: DataFrame, lang: str | F.Column) -> DataFrame:
    """C14 + C15: one language's coordinates as weighted points."""
    cond = F.col("lang") == (F.lit(lang) if isinstance(lang, str) else lang)
    return density.where(cond).select("lat", "lng", F.col("density").alias("weight"))


def lang_total_label(density: DataFrame) -> DataFrame:
    """Total weight per language and its display label."""
    label = loc_label(F.col("total"))
    return (density.groupBy("lang").agg(F.sum("density").cast("bigint").alias("total"))
            .withColumn("label", label))
