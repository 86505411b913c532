"""Token-id files with Elias-Fano document boundaries.

Layout (Parquet, one file per shard; a shard is a range of ascending ids): a row
is one block of whole documents,

    shard, block      place of the block
    first             ids of the shard before the block
    n_ids             ids of the block
    width             bytes of an id: 2 if every id of the block fits, else 4
    ids               the concatenated ids, little-endian
    bounds            Elias-Fano: where each document of the block ends
    base, n_null      smallest document id; documents with a null id (they come first)
    doc_ids           Elias-Fano: the other document ids, less ``base``

Offsets inside a block are small numbers in about two bits a document plus the
low bits of the mean length; no 64-bit table exists.  Starts over the whole
corpus are a shard's total of earlier shards, plus ``first``, plus the offset.
Writing sorts the documents by id once; a block closes at ``block_ids`` ids, so
a task holds one block (or one longer document) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langatlas.llm.common import text_slices
from langatlas.llm.eliasfano import EliasFano, encode
from langatlas.llm.wordids import file_encoder

END_ID = 0
BLOCK_IDS = 1 << 20

BLOCKS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
    T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    T.StructField("bounds", T.BinaryType()), T.StructField("base", T.LongType()),
    T.StructField("n_null", T.IntegerType()), T.StructField("doc_ids", T.BinaryType())])


def _block(shard: int, block: int, first: int, doc_ids: list[int | None],
           pieces: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(pieces)
    width = 2 if int(ids.max()) < 1 << 16 else 4
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    row = {"shard": shard, "block": block, "first": first, "n_ids": len(ids), "width": width,
           "ids": ids.astype(f"<u{width}").tobytes(),
           "bounds": encode(np.cumsum([len(p) for p in pieces])),
           "base": base, "n_null": len(doc_ids) - len(known),
           "doc_ids": encode(known.view(np.uint64) - np.int64(base).view(np.uint64))
           if len(known) else b""}
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(),
             pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], t) for f, t in zip(BLOCKS, types)],
                                      names=BLOCKS.names)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = END_ID,
                      block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text (null: empty), ``end_id`` after each, and write
    the ids in ascending id order.  Null ids come first; rows with equal ids are
    ordered by their text.  Other columns are not read; an empty table writes no
    block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = file_encoder(tokenizer_path)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, pieces, held = [], [], 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, bounds = encoder.encode(part.column("text").to_pylist(), end=end_id)
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(),
                                        bounds[:-1].tolist(), bounds[1:].tolist()):
                    doc_ids.append(doc_id)
                    pieces.append(ids[a:b])
                    held += b - a
                    if held >= block_ids:
                        yield _block(shard, block, first, doc_ids, pieces)
                        block, first = block + 1, first + held
                        doc_ids, pieces, held = [], [], 0
        if doc_ids:
            yield _block(shard, block, first, doc_ids, pieces)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    (rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie)
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
     .mapInArrow(run, BLOCKS).write.parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: a row per document, ``ids`` as
    little-endian unsigned 32-bit numbers, ``start`` the ids of all documents
    before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4").tobytes()
                ends = EliasFano(row["bounds"]).all().astype(np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                known = (EliasFano(row["doc_ids"]).all() + np.int64(row["base"]).view(np.uint64)
                         ).view(np.int64).tolist() if row["doc_ids"] else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(ends), pa.int32()),
                     pa.array([None] * row["n_null"] + known, pa.int64()),
                     pa.array(row["first"] + starts, pa.int64()), pa.array(ends - starts, pa.int64()),
                     pa.array([ids[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())],
                              pa.binary())],
                    names=["shard", "doc_id", "at", "n_tokens", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(path)
    # One row per shard: a shard is one file.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
              .select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0))
                      .alias("before")))
    found = blocks.mapInArrow(
        run, "shard int, doc_id bigint, at bigint, n_tokens bigint, ids binary")
    # A row per file of the folder: broadcast, so that the ids stay where they are.
    return (found.join(F.broadcast(shards), F.col("shard") == F.col("of"))
            .select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids"))


def read_document(block: dict, i: int) -> np.ndarray:
    """Ids of the i-th document of one block row, by two selects."""
    ends = EliasFano(block["bounds"])
    first = ends.select(i - 1) if i else 0
    return np.frombuffer(block["ids"], f"<u{block['width']}")[first:ends.select(i)]
