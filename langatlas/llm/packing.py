"""Bounded-space online best-fit packing of tokenised documents.

Every task packs the documents it reads, in one pass and without a shuffle.  A
piece goes to the open sequence with the least room that still holds it.  The
open sequences are stacks by free space plus one bitset of the free spaces that
have any; the tightest fit is the lowest set bit at or above the piece's
length.  At most ``max_open`` sequences are open: beyond that the fullest (the
lowest set bit of all) closes first.

Pieces arrive through a window of ``window_tokens`` tokens, longest first: long
pieces open sequences, short ones fill them.  Memory is bounded by the window
and the open sequences, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langatlas.llm.common import text_slices
from langatlas.llm.wordids import file_encoder

SEQUENCE_TOKENS = 2048
END_ID = 0
MAX_OPEN = 8192
WINDOW_TOKENS = 4 << 20
#: Token ids of one output batch.
BATCH_TOKENS = 1 << 20
#: Sequences of one task: sequence ids are task << 40 | number.
TASK_SHIFT = 40


class BestFit:
    """Open sequences by free space."""

    def __init__(self, capacity: int, max_open: int) -> None:
        self.capacity, self.max_open = capacity, max_open
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free = 0            # bit f: some open sequence has f tokens of room
        self.open = self.made = 0

    def _take(self, room: int) -> int:
        stack = self.stacks[room]
        found = stack.pop()
        if not stack:
            self.free ^= 1 << room
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """Sequence number and offset of a piece of ``size`` tokens."""
        fits = self.free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            sequence = self._take(room)
        else:
            room, sequence = self.capacity, self.made
            self.made += 1
        left = room - size
        if left:
            if self.open == self.max_open:
                self._take((self.free & -self.free).bit_length() - 1)
            self.stacks[left].append(sequence)
            self.free |= 1 << left
            self.open += 1
        return sequence, self.capacity - room


def cut_sizes(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens: whole if it fits,
    else full pieces after a first one that may be shorter."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text_col: str = "text", capacity: int = SEQUENCE_TOKENS,
                   end_id: int = END_ID, max_open: int = MAX_OPEN,
                   window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    ``ids`` are the piece's token ids, little-endian unsigned 32-bit; ``start`` is
    how many ids of its document come before it; ``offset`` its place in its
    sequence (gapless from 0).  A null or empty text is one piece of the end id
    alone.  Null and repeated ids are documents like any other; an empty table
    gives an empty table.  Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType
    names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])

    def packed(window: list, bins: BestFit, first: int) -> Iterator[pa.RecordBatch]:
        window.sort(key=lambda p: -p[3])        # stable: equal lengths as they came
        rows, tokens = [], 0
        for doc_id, piece, start, length, ids in window:
            sequence, offset = bins.place(length)
            rows.append((doc_id, piece, start, length, ids, first + sequence, offset))
            tokens += length
            if tokens >= BATCH_TOKENS:
                yield batch_of(rows)
                rows, tokens = [], 0
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list) -> pa.RecordBatch:
        doc_id, piece, start, length, ids, sequence, offset = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_id, id_arrow), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
             pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=names)

    id_arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_arrow
        encoder = file_encoder(tokenizer_path)
        bins = BestFit(capacity, max_open)
        first = TaskContext.get().partitionId() << TASK_SHIFT
        window, held = [], 0
        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            for part in text_slices(batch, "text"):
                ids, bounds = encoder.encode(part.column("text").to_pylist(), end=end_id)
                data = ids.astype("<u4").tobytes()
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(),
                                        bounds[:-1].tolist(), bounds[1:].tolist()):
                    start = 0
                    for piece, size in enumerate(cut_sizes(b - a, capacity)):
                        at = 4 * (a + start)
                        window.append((doc_id, piece, start, size, data[at:at + 4 * size]))
                        start += size
                held += int(bounds[-1])
                if held >= window_tokens:
                    yield from packed(window, bins, first)
                    window, held = [], 0
        if window:
            yield from packed(window, bins, first)

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, schema))
