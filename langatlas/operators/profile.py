"""Size figures of one density export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_profile(lang_region: DataFrame, coords: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: languages, languages with coordinates, coordinate triples,
    spots (= bin vector length) and total positive density.  The figures of
    the other tables are scalar subqueries -- no cross join."""
    located = coords.agg(F.struct(F.countDistinct("lang").alias("langs"),
                                  F.count(F.lit(1)).alias("n")).alias("s")).scalar()
    spots = universe.agg(F.struct(F.count(F.lit(1)).alias("n"),
                                  F.sum("total").cast("bigint").alias("total")).alias("s")).scalar()
    return (lang_region.agg(F.countDistinct("lang").alias("n_langs"))
            .withColumn("c", located).withColumn("u", spots)
            .select("n_langs", F.col("c.langs").alias("n_langs_with_coords"),
                    F.col("c.n").alias("n_coords"), F.col("u.n").alias("n_spots"),
                    F.col("u.total").alias("total_density")))


def entries_per_base(cooc: DataFrame) -> DataFrame:
    """E15, per language: entries of its co-occurrence record -- every partner
    plus the language itself (the reference stores the base under its own
    key)."""
    return (cooc.groupBy(F.col("base").alias("lang"))
            .agg((F.count(F.lit(1)) + 1).alias("n_entries")))
