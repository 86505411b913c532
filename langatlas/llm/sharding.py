"""Sharding by longest-processing-time scheduling.

Documents with equal texts are a group that stays together.  Groups go, largest
first, to the least-loaded shard, which a heap of (load, shard) gives.

The schedule is split so that no task sees all groups.  Level l = 1, 2, ... has
the groups of at least ``1 / GROUPS_PER_SHARD ** l`` of a shard's even share that
no earlier level had.  There are at most ``n_shards * GROUPS_PER_SHARD ** l`` of
them, and a hash deals them into buckets of about ``n_shards *
GROUPS_PER_SHARD``, so level l has at most ``GROUPS_PER_SHARD ** (l - 1)``
buckets, and no group of it is larger than a bucket's even share for a shard.
Each bucket is scheduled by one task, starting from its share (by bytes) of the
loads that the earlier levels made: every bucket fills the same hollows and ends
nearly level.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langatlas.llm.common import stage
from langatlas.operators.scan import prefix_scan

SHARDS = 40
OVERHEAD_BYTES = 16
GROUPS_PER_SHARD = 1000


def lpt(sizes: list[int], loads: list[float], turn: int = 0) -> list[int]:
    """The shard of each group; ``sizes`` come largest first, ``loads`` are the
    shards' loads so far.  Equal loads are taken from shard ``turn`` on."""
    n = len(loads)
    heap = [(load, (shard - turn) % n, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    placed = []
    for size in sizes:
        load, order, shard = heap[0]
        heapq.heapreplace(heap, (load + size, order, shard))
        placed.append(shard)
    return placed


def _bucket_schedule(size: int, loads: list[int]):
    """The schedule of one bucket of a level of ``size`` bytes."""
    loads = tuple(loads)

    def schedule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "gid"], ascending=[False, True])
        share = rows["bytes"].sum() / size
        shards = lpt(rows["bytes"].tolist(), [load * share for load in loads],
                     key[0] % len(loads))
        return rows.assign(shard=shards)[["gid", "bytes", "shard"]].astype({"shard": "int32"})

    return schedule


def schedule_groups(groups: DataFrame, n_shards: int = SHARDS,
                    groups_per_shard: int = GROUPS_PER_SHARD) -> DataFrame:
    """``gid, bytes`` (one row per group, bytes > 0) -> ``gid, shard``."""
    schema = f"gid {groups.schema['gid'].dataType.simpleString()}, bytes bigint, shard int"
    total, least = groups.agg(F.sum("bytes"), F.min("bytes")).first()
    loads, placed, above, level = [0] * n_shards, None, None, 1
    while True:
        floor = (total or 0) / (n_shards * groups_per_shard ** level)
        some = groups.where(F.col("bytes") >= floor)
        if above is not None:
            some = some.where(F.col("bytes") < above)
        count, size = some.agg(F.count("*"), F.sum("bytes")).first()
        buckets = max(1, -(-count // (n_shards * groups_per_shard)))

        done = stage(some.groupBy(F.pmod(F.xxhash64("gid"), F.lit(buckets)).alias("bucket"))
                     .applyInPandas(_bucket_schedule(size, loads), schema), "shard-level")
        for row in done.groupBy("shard").agg(F.sum("bytes").alias("b")).collect():  # n_shards rows
            loads[row["shard"]] += row["b"]
        placed = done if placed is None else placed.union(done)
        if least is None or floor <= least:
            return placed.select("gid", "shard")
        above, level = floor, level + 1


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n_shards: int = SHARDS) -> DataFrame:
    """Per input row ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 bytes of the text plus 16 (null: 16).  The law is
    ``bytes``: sizes as equal as whole groups allow; ``grown_shard`` is null.
    ``slot`` counts a shard's rows from 0 by ascending id.  A null text is in the
    group of the empty text.  Null and repeated ids are rows like any other; an
    empty table gives an empty table.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stage(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD_BYTES)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("gid")), "shard-rows")
    groups = stage(rows.groupBy("gid").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = stage(schedule_groups(groups, n_shards), "shard-placed")
    named = rows.join(placed, "gid").drop("gid")
    return prefix_scan(named, ["shard"], ["doc_id", "size", "text_crc32"], pos_col="slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
