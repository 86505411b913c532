"""Geocoder replies: parse a table of raw JSON bodies natively (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langatlas.schemas import GEOCODE_BODY
from langatlas.session import scratch_path

# Address component type paths the reference reads.
COUNTRY_TYPES = "country-political"
CITY_TYPES = "administrative_area_level_1-political"


def _component(first: F.Column, types: str) -> F.Column:
    hit = F.filter(first["address_components"],
                   lambda c: F.array_join(c["types"], "-") == F.lit(types))
    return F.try_element_at(hit, F.lit(1))["long_name"]


CORRUPT = "_corrupt"
#: What may be wrong with a reply; null: nothing.
TRANSPORT, MALFORMED, REFUSED = "transport", "malformed", "refused"


def parse_geocode(responses: DataFrame, body_col: str = "body") -> DataFrame:
    """A8 + A9: ``location, body`` -> ``location, status, city, country, lat, lng,
    fault``.

    ``fault`` tells what a reply lacks: ``transport`` (no body came), ``malformed``
    (a body that is no whole reply), ``refused`` (a status other than OK); then
    all fields are null (a refused reply keeps its status).  Otherwise the first
    result's country / first-level area names and its geometry location; a
    component that is not there is null.
    """
    schema = T.StructType([*GEOCODE_BODY.fields, T.StructField(CORRUPT, T.StringType())])
    body = F.from_json(F.col(body_col), schema,
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = responses.select("location", F.col(body_col).isNull().alias("none"),
                              body.alias("b"))
    whole = F.col(f"b.{CORRUPT}").isNull() & F.col("b.status").isNotNull()
    ok = whole & (F.col("b.status") == "OK")
    first = F.try_element_at(F.col("b.results"), F.lit(1))
    return parsed.select(
        "location",
        F.when(whole, F.col("b.status")).alias("status"),
        F.when(ok, _component(first, CITY_TYPES)).alias("city"),
        F.when(ok, _component(first, COUNTRY_TYPES)).alias("country"),
        F.when(ok, first["geometry"]["location"]["lat"]).alias("lat"),
        F.when(ok, first["geometry"]["location"]["lng"]).alias("lng"),
        F.when(F.col("none"), TRANSPORT).when(~whole, MALFORMED).when(~ok, REFUSED)
        .alias("fault"))


def fault_counts() -> list[Column]:
    """Aggregates for ``DataFrame.observe``: replies and faults of a pass over parsed
    replies, counted while it writes."""
    return [F.count(F.lit(1)).alias("replies"),
            *(F.count(F.when(F.col("fault") == f, 1)).alias(f)
              for f in (TRANSPORT, MALFORMED, REFUSED))]


def split_replies(responses: DataFrame, good: str, quarantine: str) -> dict[str, int]:
    """Parse replies and write them: the records to ``good``, and each faulty reply
    with its body to ``quarantine``.  Returns the counts of the one parsing pass."""
    seen = Observation()
    parsed = parse_geocode(responses.select("location", "body"))
    staged = scratch_path(responses.sparkSession, "parsed")
    parsed.observe(seen, *fault_counts()).write.partitionBy("fault").parquet(staged)
    found = responses.sparkSession.read.schema(parsed.schema).parquet(staged)
    found.where("fault IS NULL").drop("fault").write.parquet(good)
    faulty = found.where("fault IS NOT NULL").select("location", "fault")
    (responses.join(faulty, "location").select("location", "fault", "body")
     .write.parquet(quarantine))
    return seen.get
