"""A1: read the density export (JSON) with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langatlas.schemas import DIST, DIST_TEXT


def read_dist_json(spark: SparkSession, path: str, view: str | None = "dists",
                   text_coords: bool = False, multi_line: bool = False) -> DataFrame:
    """JSON lines, each an object or an array of objects, or with ``multi_line``
    one JSON value per file (malformed input fails the read) ->
    ``lang{_id, value}, coords``; registered as ``view`` for SQL access.
    ``lang.value`` stays text because it is an object for most languages and
    a two-element list for some (see ``location_entries``).  A large language comes
    in several documents (see ``distribution.nest_coords``)."""
    df = spark.read.schema(DIST_TEXT if text_coords else DIST).json(
        path, multiLine=multi_line, mode="FAILFAST")
    if view:
        df.createOrReplaceTempView(view)
    return df


def location_entries(dist: DataFrame) -> DataFrame:
    """``lang, location, loc``: the entries of ``lang.value``, all parts of a language
    together.

    The text is read as a variant: an object holds an entry a key, a list of two a
    single entry.  An entry without a whole number, another kind of value and text
    that is no JSON give no row.
    """
    value = dist.select(F.col("lang._id").alias("lang"),
                        F.try_parse_json(F.col("lang.value")).alias("v"))
    kind = F.schema_of_variant("v")
    as_map = F.try_variant_get("v", "$", "map<string,variant>")
    as_pair = F.map_from_arrays(
        F.array(F.coalesce(F.try_variant_get("v", "$[0]", "string"), F.lit("null"))),
        F.array(F.try_variant_get("v", "$[1]", "variant")))
    entries = F.when(kind.startswith("OBJECT"), as_map).when(kind.startswith("ARRAY"), as_pair)
    return (value.select("lang", F.explode(entries).alias("location", "_loc"))
            .select("lang", "location", F.try_variant_get("_loc", "$", "bigint").alias("loc"))
            .where("loc IS NOT NULL"))
