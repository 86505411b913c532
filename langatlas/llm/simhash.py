"""SimHash near-dedup over a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ
in at most four bits differ in at most four bytes, so they share at least four
positional bytes (``position, byte``): the guaranteed minimum of matches.

* Postings.  A posting list of one positional byte holds 1/256 of all
  fingerprints, and tallying from those lists is quadratic.  The index keys are
  therefore *three* positional bytes at once: ``TRIPLES`` is the Turan system
  of 20 triples of the 8 positions such that any four positions contain one of
  them.  A pair with four shared bytes meets in at least one of the 20 lists.
* Count filter.  For a pair that meets, the shared positional bytes are tallied
  over all eight positions; fewer than the minimum drops the pair.
* Verify.  The bit distance of what is left.
* Long lists.  A list over ``MAX_LIST`` fingerprints (a large group of close
  copies) is not paired up.  Its members go to the points within half the bit
  distance of them; two members share such a point exactly when they are within
  the bit distance, so linking all members of a point to the smallest of them
  gives the same components, with rows linear in the list.

Equal texts share one fingerprint, so copies are one node however many there
are; links are between distinct fingerprints only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langatlas.llm.common import stage, text_slices
from langatlas.llm.components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
POSITIONS = 8
#: Longest posting list that is paired up; beyond it the exact linear way.
MAX_LIST = 4096
#: Shingles whose bits are counted at a time (64 bytes each).
COUNT_BLOCK = 1 << 16


def turan_triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions of which any 4 positions contain one:
    three cyclic groups, a triple inside one group or two of a group with one of
    the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [t for g in groups for t in combinations(g, 3)]
    for g, after in zip(groups, groups[1:] + groups[:1]):
        found += [tuple(sorted((*two, one))) for two in combinations(g, 2) for one in after]
    return sorted(found)


TRIPLES = turan_triples()


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: A-Z lower-cased, words between ASCII white space,
    word shingles with repeats (fewer words: the whole sequence), XXH64 with
    seed 42 each; a bit is 1 if set in over half of the hashes.  No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    first, last = starts[:len(words) - k + 1], ends[k - 1:]
    for at in range(0, len(first), COUNT_BLOCK):
        spans = zip(first[at:at + COUNT_BLOCK].tolist(), last[at:at + COUNT_BLOCK].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long), one row per input row."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                fps = [fingerprint(t, shingle_words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))],
                    names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("fp", T.LongType())])
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, schema))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _postings(fps: DataFrame) -> DataFrame:
    """``key, fp``: the 20 lists a fingerprint is in."""
    fp = F.col("fp")
    keys = [F.lit(n << 24) + F.shiftleft(_byte(fp, i), 16) + F.shiftleft(_byte(fp, j), 8)
            + _byte(fp, k) for n, (i, j, k) in enumerate(TRIPLES)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _near(x: Column, y: Column, max_bits: int) -> Column:
    """Count filter, then the bit distance."""
    differ = x.bitwiseXOR(y)
    shared = sum((F.when(_byte(differ, i) == 0, 1).otherwise(0) for i in range(POSITIONS)),
                 F.lit(0))
    return (shared >= POSITIONS - max_bits) & (F.bit_count(differ) <= max_bits)


def _ball(fp: Column, free: Column, radius: int) -> Column:
    """All points within ``radius`` bits of ``fp``, changing bits of the five
    positions outside the list's triple only (``free``: 40 single-bit masks)."""
    points = F.array(fp)
    if radius >= 1:
        points = F.concat(points, F.transform(free, lambda m: fp.bitwiseXOR(m)))
    if radius >= 2:
        points = F.concat(points, F.flatten(F.transform(
            free, lambda m, i: F.transform(F.slice(free, i + 2, F.size(free)),
                                           lambda n: fp.bitwiseXOR(m).bitwiseXOR(n)))))
    return points


def _long_list_links(postings: DataFrame, max_bits: int) -> DataFrame:
    """Links of the lists that are too long to pair up; see the module text."""
    free = F.lit(None).cast("array<bigint>")
    for n, triple in enumerate(TRIPLES):
        masks = [1 << b for p in range(POSITIONS) if p not in triple
                 for b in range(8 * p, 8 * p + 8)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        free = F.when(F.shiftrightunsigned("key", 24) == n,
                      F.array(*map(F.lit, signed)).cast("array<bigint>")).otherwise(free)
    half = max_bits // 2
    low = postings.withColumn("free", free)
    # Even max_bits: both ends within half; odd: one end may be one bit further.
    points = low.select("key", "fp", F.explode(_ball(F.col("fp"), F.col("free"), half)).alias("p"))
    least = points.groupBy("key", "p").agg(F.min("fp").alias("m"), F.count("*").alias("n"))
    return (points.join(least.where("n > 1"), ["key", "p"])
            .select(F.col("fp").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS,
                      max_list: int = MAX_LIST) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that give
    the components of all pairs within ``max_bits`` bits (at most 4, even)."""
    if max_bits not in (2, 4):
        raise ValueError("max_bits must be 2 or 4: the index guarantees four shared bytes")
    postings = stage(_postings(fps), "simhash-postings")
    lists = (postings.groupBy("key").agg(F.count("*").alias("n"))
             .where("n > 1").withColumn("long", F.col("n") > max_list).drop("n"))
    met = postings.join(lists, "key")
    short = met.where(~F.col("long"))
    pairs = (short.alias("x").join(short.alias("y"), "key")
             .where((F.col("x.fp") < F.col("y.fp")) & _near(F.col("x.fp"), F.col("y.fp"), max_bits))
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    return pairs.union(_long_list_links(met.where("long").drop("long"), max_bits)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    max_list: int = MAX_LIST) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` for every input row.

    ``component_id`` is the smallest id reachable over links (itself included).
    Null, empty and white-space texts all have fingerprint zero and link to each
    other; equal fingerprints always link.  A row with a null id keeps its row
    and does not name a component unless every id of it is null.  Repeated rows
    give repeated rows; an empty table gives an empty one.  Other columns of the
    input, whatever their names, are not read.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle_words), "simhash-fp")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = stage(connected_components(fingerprint_links(nodes.select("fp"), max_bits, max_list)),
                  "simhash-roots")
    grouped = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stage(grouped.join(least, "root").select(F.col("fp").alias("node"), "component_id"),
                  "simhash-components")
    return (fps.join(named, F.col("fp") == F.col("node"))
            .select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **params) -> DataFrame:
    """The rows of one document of each component: the one that names it.  Rows
    with a null id are kept: they name no document that could stand for them."""
    named = near_duplicates(docs, id_col, text_col, **params)
    gone = stage(named.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")),
                 "simhash-gone").distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
