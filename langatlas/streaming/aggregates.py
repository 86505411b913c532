"""E1, E3 and E4 kept up with what is ingested.

The stored aggregates are tables of sums (``sinks.versions``): a batch of
repositories is aggregated by itself -- the same operators as a full run -- and
its partial rows become one more folder of the next version.  Reading adds the
folders up, and every few versions a writer merges them.  The work of a batch
goes with the batch, not with what is stored, and a batch that was put in
before (a replay after a crash) is left out by its number.

What is stored adds up exactly: counts and sums, never means.  A repository must
come in one batch (ingest drops repeated ids).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langatlas.operators.correlation import lang_cooccurrence, lang_pair_totals
from langatlas.operators.distribution import lang_region_loc
from langatlas.operators.graph import graph_emissions
from langatlas.sinks.versions import VersionedTable

#: A weight is stored in units of 1/WEIGHT_UNIT, so that its sum is exact.
WEIGHT_UNIT = 1 << 40


def _table(spark: SparkSession, path: str, keys: str, sums: str) -> VersionedTable:
    keys, sums = keys.split(), sums.split()
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in keys),
                           *(T.StructField(c, T.LongType()) for c in sums)])
    return VersionedTable(spark, path, schema, *keys, sums=tuple(sums))


def _edge_sums(repos: DataFrame) -> DataFrame:
    return graph_emissions(repos).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.sum("src_loc").alias("loc"),
        F.sum(F.round(F.col("w") * WEIGHT_UNIT).cast("bigint")).alias("units"))


@dataclass
class Aggregates:
    """The stored aggregates below one folder."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.regions = _table(self.spark, f"{self.path}/regions", "lang location", "loc")
        self.pairs = _table(self.spark, f"{self.path}/pairs", "base other", "n")
        self.totals = _table(self.spark, f"{self.path}/totals", "lang", "pair_count repo_count")
        self.edges = _table(self.spark, f"{self.path}/edges", "src dst", "n loc units")

    def add(self, repos: DataFrame, batch: int, writer: str = "ingest",
            tables: tuple[str, ...] = ("regions", "pairs", "totals", "edges")) -> None:
        """Add one batch of repositories (D1) to the tables; a batch number that a
        table has already changes nothing there."""
        partial = {"regions": lang_region_loc, "pairs": lang_cooccurrence,
                   "totals": lang_pair_totals, "edges": _edge_sums}
        for name in tables:
            table = getattr(self, name)
            rows = partial[name](repos).select(*(F.col(f.name).cast(f.dataType).alias(f.name)
                                                 for f in table.schema))
            table.update(lambda _, rows=rows: rows, (writer, batch))

    def lang_region_loc(self) -> DataFrame:
        """E1."""
        return self.regions.read()

    def lang_cooccurrence(self) -> DataFrame:
        """E3, D4j."""
        return self.pairs.read()

    def lang_pair_totals(self) -> DataFrame:
        """E3's totals."""
        return self.totals.read()

    def graph_edges(self) -> DataFrame:
        """The mean weight from the sum."""
        weight = F.col("units").cast("double") / WEIGHT_UNIT / F.col("n")
        return self.edges.read().select("src", "dst", "n", "loc", weight.alias("weight"))
