"""Incremental geo fill as a Structured Streaming job.

Geocoder replies (``location, body``) land as files.  Each micro-batch keeps
only locations not yet known (a failed lookup is known too), parses the replies
natively, lets an OK reply win over a failed one, records misses with nulls and
puts the records into a new version of the location table.  Only the table's
buckets that the batch's locations fall into are read.  The stream's name and
batch number are in the commit: a replayed batch changes nothing, and another
writer of the table is no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langatlas.operators.geo import GEO_COLUMNS
from langatlas.sinks.versions import VersionedTable
from langatlas.sources.geocode import parse_geocode

REPLY_SCHEMA = "location string, body string"


def reply_records(replies: DataFrame) -> DataFrame:
    """One record per location.  Every reply gives one: a faulty one parses to nulls.
    Of several for a place an OK one counts, then the greatest fields."""
    fields = F.struct(*(c for c in GEO_COLUMNS if c != "location"))
    best = F.max(F.struct(F.col("fault").isNull().alias("ok"), fields.alias("r")))
    return (parse_geocode(replies).groupBy("location").agg(best.alias("b"))
            .select("location", "b.r.*").select(*GEO_COLUMNS))


def run_geo_fill(spark: SparkSession, replies_dir: str, table: VersionedTable,
                 checkpoint: str, files_per_batch: int = 1, name: str = "geo-fill") -> None:
    """Process every landed reply file (``availableNow``) and stop."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        def fresh(known):
            return reply_records(batch.join(known(batch).select("location"), "location",
                                            "left_anti"))
        table.update(fresh, (name, batch_id))

    query = (spark.readStream.schema(REPLY_SCHEMA)
             .option("maxFilesPerTrigger", files_per_batch)
             .parquet(replies_dir)
             .writeStream.foreachBatch(upsert)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()
