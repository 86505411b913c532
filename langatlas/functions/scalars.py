"""Scalar helpers used across the pipelines, exercised together by
``scalar_functions``: text tests, numeric helpers, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langatlas.functions.locations import is_place_name


def loc_label(total: Column) -> Column:
    """E12 label: ``12K LoC`` above 10,000, else ``9876 LoC``."""
    return F.when(total > 10000, F.concat(F.floor(total / 1000).cast("bigint").cast("string"),
                                          F.lit("K LoC"))) \
            .otherwise(F.concat(total.cast("string"), F.lit(" LoC")))


def stable_round6(c: Column | str) -> Column:
    """Half-up rounding to 6 decimals for query output, by the same arithmetic
    in either engine.  For values in [0, 1e12)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1000000.0 + 0.5) / 1000000.0


def lenient_int(c: Column) -> Column:
    """C11: text -> integer, anything unreadable -> 0."""
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def location_scalars(owners: DataFrame) -> DataFrame:
    """lower / length / contains / isin / trim / isnan / sqrt / pow / floor /
    safe ratio / format over the owner table."""
    loc = F.col("location")
    return owners.select(
        "owner_id",
        F.lower(loc).alias("loc_lower"),
        F.length(loc).cast("bigint").alias("loc_len"),
        loc.contains("@").alias("has_at"),
        F.trim(F.concat(F.lit("  "), loc, F.lit(" "))).alias("trimmed"),
        is_place_name(loc).alias("is_place"),
        F.isnan("c_acctbal").alias("bal_nan"),
        F.floor("c_acctbal").cast("bigint").alias("bal_floor"),
        stable_round6(F.sqrt(F.abs(F.col("followers")).cast("double"))).alias("followers_sqrt"),
        F.pow(F.col("followers"), 2).alias("followers_sq"),
        stable_round6(F.try_divide(F.col("repos").cast("double"), F.col("followers")))
        .alias("repo_ratio"),
        F.format_string("%s: %d repos", F.col("login"), F.col("repos")).alias("label"),
        loc_label(F.col("followers") * 1000).alias("size_label"))


def language_arrays(repos: DataFrame) -> DataFrame:
    """Array concat / slice and map keys / entries over the language lists of
    the repositories that have any."""
    names = F.transform("langs", lambda x: x["lang"])
    by_name = F.map_from_entries(F.transform("langs", lambda x: F.struct(x["lang"], x["loc"])))
    joined = F.concat(F.slice(names, 1, 2), F.array(F.lit("...")))
    return repos.where(F.size("langs") > 0).select(
        F.col("id").alias("repo_id"),
        F.array_join(joined, "|").alias("first_two"),
        F.array_join(F.sort_array(F.map_keys(by_name)), "|").alias("names"),
        F.aggregate(F.map_entries(by_name), F.lit(0).cast("bigint"),
                    lambda acc, e: acc + e["value"]).alias("total"))
