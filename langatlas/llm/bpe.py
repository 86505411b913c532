"""Byte-level BPE encoding and decoding by ranks.

Encoding runs the tokenizers library's BPE model over Arrow batches: bytes are
mapped to the characters of the byte table, the merge rules are made from the
ranks.  Decoding reverses the byte table per id and joins the bytes of a
document before any character is formed, so a character split over tokens comes
back whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langatlas.llm.common import text_slices
from langatlas.llm.wordids import rank_encoder, read_ranks


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: ids without a token have none."""
    ranks = read_ranks(path)
    found = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        found[rank] = token
    return found


def char_offsets(ids: np.ndarray, tokens: list[bytes], text: str) -> np.ndarray:
    """Where in the text (in characters) each token starts; a token that starts
    inside a character has that character's place."""
    sizes = np.fromiter((len(tokens[i]) for i in ids.tolist()), np.int64, len(ids))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(text.encode(), np.uint8)
    return (np.cumsum((data & 0xC0) != 0x80) - 1)[starts]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` and, if asked for, ``offsets`` (array of the
    tokens' places in characters); ``ids`` are little-endian unsigned 32-bit.  A
    null or empty text has no ids.  Null and repeated ids are rows like any
    other; other columns are not read."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType),
              T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if offsets:
        fields.append(T.StructField("offsets", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(ranks_path, pattern)
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids, bounds = encoder.encode(texts)
                data = ids.astype("<u4").tobytes()
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                out = [part.column("doc_id"), pa.array(np.diff(bounds)),
                       pa.array([data[4 * a:4 * b] for a, b in spans], pa.binary())]
                if offsets:
                    tokens = token_bytes(ranks_path)
                    out.append(pa.array([char_offsets(ids[a:b], tokens, t or "").tolist()
                                         for (a, b), t in zip(spans, texts)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, T.StructType(fields)))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``decoded`` (the bytes of ``ids``) to rows with ``ids``; null ids
    decode to null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = token_bytes(ranks_path).__getitem__
        for batch in batches:
            for part in text_slices(batch, "ids"):
                decoded = [None if ids is None else
                           b"".join(map(look, np.frombuffer(ids, "<u4").tolist()))
                           for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())],
                                                 names=[*part.schema.names, "decoded"])

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(run, schema)


def decoded_text(column: str = "decoded"):
    """The decoded bytes as text; bytes that form no character become U+FFFD."""
    return F.decode(F.col(column), "UTF-8")
