"""Ranked lexical search by scanning the documents with an Aho-Corasick automaton.

The terms of all items go into one automaton, each guarded by a blank on both
sides, and a document's text, with every run of non-term bytes made one blank,
is scanned by it: every match is one occurrence of a whole term.  No index of
the documents is made.  Two scans are needed, as a score takes counts over all
documents: the first sums document frequencies and lengths, the second scores
and keeps each item's best documents of a task.

An automaton is broadcast, so its size is bounded: items are taken in blocks of
at most ``max_items`` items and ``max_term_bytes`` bytes of terms, and every
block scans the documents by itself.  Blocks are cut by Spark (a running sum
over the items' sizes), and only one block at a time is on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langatlas.llm.common import stage, text_slices

TOP = 10
#: Bounds of one block, whose automaton every task holds.
MAX_ITEMS = 4096
MAX_TERM_BYTES = 4 << 20
#: Documents x items that are scored at a time (8 bytes each).
SCORE_CELLS = 1 << 18
#: Every task's best documents meet in so many groups an item before its last ranking.
MERGE_GROUPS = 256

# Fixed values of the score.
SCALE = 1_000_000_000
TERM_BYTES = [b for b in range(256)
              if b > 0x7F or chr(b).isascii() and chr(b).isalnum()]
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in TERM_BYTES else 0x20
              for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of letters, digits and everything beyond
    ASCII, A-Z lower-cased.  All bytes of a character beyond ASCII are above
    0x7F, so the bytes can be taken one by one."""
    return text.translate(TABLE).split() if text else []


def guarded(terms: list[bytes]) -> str:
    """Terms as one scannable string, a character per byte."""
    return (b" " + b" ".join(terms) + b" ").decode("latin-1")


def build_automaton(terms: list[bytes]) -> ahocorasick.Automaton | None:
    """Automaton over the guarded terms; a match's output is the term's number."""
    if not terms:
        return None
    automaton = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        automaton.add_word(guarded([term]), number)
    automaton.make_automaton()
    return automaton


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class ItemBlock:
    """Items, their terms and, for a term, the items that have it."""

    def __init__(self, items: list[tuple[int, list[bytes]]]) -> None:
        self.items = [item for item, _ in items]
        number: dict[bytes, int] = {}
        repeats: dict[tuple[int, int], int] = {}
        for place, (_, terms) in enumerate(items):
            for term in terms:
                key = (number.setdefault(term, len(number)), place)
                repeats[key] = repeats.get(key, 0) + 1
        self.terms = list(number)
        pairs = sorted(repeats)
        self.item_of = np.array([place for _, place in pairs], np.int64)
        self.times = np.array([repeats[p] for p in pairs], np.int64)
        self.starts = np.searchsorted(np.array([t for t, _ in pairs], np.int64),
                                      np.arange(len(self.terms) + 1))


class Matches:
    """Term occurrences of a slice of documents: (document, term, tf) triples and
    the documents' lengths."""

    def __init__(self, automaton, texts: list[bytes | None]) -> None:
        lengths, docs, found, counts = [], [], [], []
        for place, text in enumerate(texts):
            words = terms_of(text)
            lengths.append(len(words))
            if words and automaton is not None:
                hits = np.fromiter((number for _, number in automaton.iter(guarded(words))),
                                   np.int64)
                if len(hits):
                    distinct, tf = np.unique(hits, return_counts=True)
                    docs.append(np.full(len(distinct), place, np.int64))
                    found.append(distinct)
                    counts.append(tf)
        self.lengths = np.array(lengths, np.int64)
        none = np.empty(0, np.int64)
        self.docs = np.concatenate([none, *docs])
        self.terms = np.concatenate([none, *found])
        self.tf = np.concatenate([none, *counts])


def score_matrix(matches: Matches, block: ItemBlock, weights: np.ndarray,
                 n_docs: int, n_terms: int) -> np.ndarray:
    """Scores, documents x items, in 64-bit integers."""
    m = 25 + (75 * matches.lengths * n_docs) // max(1, n_terms)
    part = weights[matches.terms] * (
        (SCALE * matches.tf) // (1000 * matches.tf + 8 * m[matches.docs]))
    fan = np.diff(block.starts)[matches.terms]
    # All (match, item) pairs, the items of a match side by side.
    first = np.repeat(block.starts[matches.terms], fan)
    at = first + np.arange(len(first)) - np.repeat(np.cumsum(fan) - fan, fan)
    width = len(block.items)
    scores = np.zeros(len(matches.lengths) * width, np.int64)
    np.add.at(scores, np.repeat(matches.docs, fan) * width + block.item_of[at],
              np.repeat(part, fan) * block.times[at])
    return scores.reshape(-1, width)


class Best:
    """The best documents of every item: highest score, then smallest id (a null
    id last)."""

    def __init__(self, n_items: int, top: int) -> None:
        self.top, self.kept = top, [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)   # a score below this cannot enter

    def add(self, ids: list, scores: np.ndarray) -> None:
        least = self.least
        if len(scores) > self.top:    # what this slice itself has seen is a bound, too
            least = np.maximum(least, np.partition(scores, -self.top, axis=0)[-self.top])
        docs, items = np.nonzero(scores >= least)
        for doc, item in zip(docs.tolist(), items.tolist()):
            self.kept[item].append((-int(scores[doc, item]), ids[doc] is None, ids[doc]))
        for item in np.unique(items).tolist():
            kept = self.kept[item]
            if len(kept) > self.top:
                kept.sort(key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
                del kept[self.top:]
            if len(kept) == self.top:
                self.least[item] = -max(x[0] for x in kept)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None]]]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            yield (part.column("doc_id").to_pylist(),
                   part.column("text").cast(pa.binary()).to_pylist())


def count_terms(docs: DataFrame, block, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and how many documents have each
    term of the block (a broadcast).  The sums a task sends are one row a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = block.value.terms
        automaton = build_automaton(terms)
        sums = np.zeros(len(terms) + 2, np.int64)
        for _, texts in _parts(batches):
            matches = Matches(automaton, texts)
            sums[0] += np.count_nonzero(matches.lengths)
            sums[1] += matches.lengths.sum()
            sums[2:] += np.bincount(matches.terms, minlength=len(terms))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])],
                                         names=["number", "n"])

    found = np.zeros(n_terms + 2, np.int64)
    # Bounded: as many rows as the block has terms, and two.
    for row in (docs.mapInArrow(run, "number bigint, n bigint").groupBy("number")
                .agg(F.sum("n").alias("n")).toLocalIterator()):
        found[row["number"]] = row["n"]
    return int(found[0]), int(found[1]), found[2:]


def best_of_tasks(docs: DataFrame, block, weights, n_docs: int, n_terms: int, top: int,
                  schema: T.StructType) -> DataFrame:
    """Every task's ``top`` documents for each item of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        automaton = build_automaton(items.terms)
        best = Best(len(items.items), top)
        rows = max(1, SCORE_CELLS // max(1, len(items.items)))
        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for ids, texts in _parts([batch]):
                for at in range(0, len(ids), rows):
                    matches = Matches(automaton, texts[at:at + rows])
                    best.add(ids[at:at + rows],
                             score_matrix(matches, items, weights.value, n_docs, n_terms))
        for item, kept in zip(items.items, best.kept):
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(kept), pa.int64()),
                     pa.array([x[2] for x in kept], doc_type),
                     pa.array([-x[0] for x in kept], pa.int64())],
                    names=["item_no", "doc_id", "score"])

    return docs.mapInArrow(run, schema)


def item_blocks(items: DataFrame, item_col: str, text_col: str, max_items: int,
                max_term_bytes: int) -> DataFrame:
    """Items with a number and a block, by running sums over their sizes.

    The order is by a range sort; the sums of the ranges before a range come
    from one row a range, so no task sees more than its range and that table.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint")
    ordered = stage(items.select(F.col(item_col).alias("item_id"),
                                 F.col(text_col).cast("string").alias("text"),
                                 size.alias("size"))
                    .repartitionByRange("item_id").sortWithinPartitions("item_id", "text")
                    .select("*", F.spark_partition_id().alias("range"),
                            F.monotonically_increasing_id().alias("place")), "items")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ordered.groupBy("range").agg(F.sum("size").alias("bytes"),
                                            F.count(F.lit(1)).alias("n"))
               .select("range",
                       F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before")))
    inside = Window.partitionBy("range").orderBy("place")
    return (ordered.join(offsets, "range")
            .withColumn("item_no", F.col("n_before") + F.row_number().over(inside) - 1)
            .withColumn("bytes_to", F.col("bytes_before") + F.sum("size").over(inside))
            .select("item_no", "item_id", "text",
                    (F.floor(F.col("item_no") / max_items)
                     + F.floor(F.col("bytes_to") / max_term_bytes)).alias("block")))


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                   max_items: int = MAX_ITEMS,
                   max_term_bytes: int = MAX_TERM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents with a
    score above 0, highest first, equal scores by ascending id (a null id last).

    Every row is a document and every item row an item of its own, repeated and
    null ids included; a null text has no terms.  Items without terms, or whose
    terms no document has, give no row; empty tables give none.  An item of more
    than ``max_term_bytes`` is a block of its own.  Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    numbered = stage(item_blocks(items, item_col, item_text, max_items, max_term_bytes), "blocks")
    schema = T.StructType([T.StructField("item_no", T.LongType()),
                           T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("score", T.LongType())])
    found = spark.createDataFrame([], schema)
    # One pass over the documents a block; the number of blocks follows the items.
    for (number,) in numbered.select("block").distinct().orderBy("block").toLocalIterator():
        rows = numbered.where(F.col("block") == number).select("item_no", "text").collect()
        items_here = ItemBlock([(r["item_no"], terms_of((r["text"] or "").encode()))
                                for r in rows])
        if not items_here.terms:
            continue
        block = spark.sparkContext.broadcast(items_here)
        n_docs, n_terms, df = count_terms(texts, block, len(items_here.terms))
        weights = spark.sparkContext.broadcast(
            np.array([weight(n_docs, int(n)) for n in df], np.int64))
        found = found.unionByName(stage(
            best_of_tasks(texts, block, weights, n_docs, n_terms, top, schema), "best"))
        block.unpersist()
        weights.unpersist()
    highest = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    group = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_GROUPS))
    few = (found.withColumn("group", group)
           .withColumn("place", F.row_number().over(
               Window.partitionBy("item_no", "group").orderBy(*highest)))
           .where(F.col("place") <= top))
    ranked = (few.withColumn("rank", F.row_number().over(
        Window.partitionBy("item_no").orderBy(*highest))).where(F.col("rank") <= top))
    return (ranked.join(numbered.select("item_no", "item_id"), "item_no")
            .select("item_id", "rank", "doc_id", "score"))
