"""langatlas: where programming languages are written, which ones travel together,
and how their geographic footprints cluster -- expressed as Spark DataFrame jobs.

Sub-packages
------------
sources    readers: given tables, the repository bridge, dist JSON, geocode responses
functions  Column-expression helpers (predicates, scalars, per-row array logic)
operators  DataFrame -> DataFrame operators (distribution, correlation, graph, spatial, ...)
sinks      writers: overwrite / append / upsert / JSON export
streaming  incremental ingest with Structured Streaming
plans      composite pipelines and the query registry used by ``__spark_entry__``
"""

__version__ = "0.1.0"
