"""Exact BM25 top-k search over document shards with block-max pruning.

Index.  A task turns the documents it reads into segments of at most
``SEGMENT_DOCS`` documents, each an inverted index of its own: terms, posting
lists (document, frequency) and document lengths.  Nothing is shuffled; a
segment is one row of a Parquet table.

Statistics.  Document frequencies, the number of documents and their mean length
are those of the whole table, so a score is the same in every segment.

Search.  Queries go over all segments in blocks of bounded size, each block
broadcast once.  A task goes through its segments one after the other and carries
the best k of each query along, so it returns k rows a query however many segments
it has.  In a segment every (frequent term, block of ``BLOCK_DOCS`` documents) has its
largest impact.  Rare terms are summed posting by posting.  The bound of a block of
documents is its largest such sum and the weighted sum of the frequent terms' block
maxima; blocks whose bound is below the k-th score so far are skipped.  In the others
the frequent terms of many queries are summed as one product of matrices, in single
precision.  Documents that may reach the k-th score, the rounding allowed for, are
scored again in doubles.  The tasks' best k are merged by score and then the smaller
id; all steps are exact.

A query is a whole text: its terms weigh their frequency in it.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from langatlas.llm.common import stage, text_slices
from langatlas.session import scratch_path

K1, B = 1.2, 0.75
TOP_K = 10
SEGMENT_DOCS = 8192
SEGMENT_POSTINGS = 4_000_000
BLOCK_DOCS = 64
#: Terms of the queries of one block (16 bytes each).
QUERY_BLOCK_TERMS = 1_000_000
#: Queries that are looked up in a segment at a time, and those of a batch of results.
QUERY_BATCH, FOUND_QUERIES = 256, 4096
#: Terms of one document in so many and more are columns of a matrix, the most frequent
#: ones at most.
DENSE_SHARE, DENSE_TERMS = 24, 1024
#: Documents whose frequent terms are summed at a time.
DENSE_COLUMNS = 1024
MAX_WORDS = 500_000
#: Postings whose documents' lengths are looked up at a time.
PART = 1 << 18

#: Rows that Spark gives a Python task at a time.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MARKS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
SEGMENT = ("n_docs int, n_words bigint, doc_ids binary, lengths binary, terms binary, "
           "starts binary, docs binary, tfs binary")
SEGMENT_NAMES = [c.split()[0] for c in SEGMENT.split(", ")]


def words_of(text: str | None) -> list[str]:
    # Bytes are translated by one table, characters beyond ASCII one at a time.
    return ((text or "").lower().encode("utf-8", "surrogatepass").translate(MARKS)
            .decode("utf-8", "surrogatepass").split())


class TermHashes(dict):
    """64-bit term hashes of the words a worker has seen."""

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word, 0)
        return found

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """The text's terms in order, how often each occurs, and its words."""
        if len(self) > MAX_WORDS:
            self.clear()
        words = words_of(text)
        terms, tfs = np.unique(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)),
                               return_counts=True)
        return terms, tfs.astype(np.uint32), len(words)


def _segment(doc_ids: list[int], lengths: list[int], terms: list, tfs: list) -> pa.RecordBatch:
    sizes = [len(t) for t in terms]
    docs = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    every = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")             # by term, then by document
    every = every[order]
    starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))[:len(every)])
    known = every[starts]
    row = [len(doc_ids), sum(lengths), np.array(doc_ids, "<i8"), np.array(lengths, "<u4"),
           known.astype("<u8"), np.append(starts, len(every)).astype("<u4"),
           docs[order].astype("<u2"), np.concatenate(tfs)[order].astype("<u4") if tfs else
           np.zeros(0, "<u4")]
    types = [pa.int32(), pa.int64()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array([v if isinstance(v, int) else v.tobytes()], t) for v, t in zip(row, types)],
        names=SEGMENT_NAMES)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """The segments of all rows with an id, staged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = TermHashes(), 0
        ids, lengths, terms, tfs = [], [], [], []
        for batch in batches:
            for part in text_slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(),
                                        part.column("text").to_pylist()):
                    found, counts, n = hashes.counted(text)
                    ids.append(doc_id)
                    lengths.append(n)
                    terms.append(found)
                    tfs.append(counts)
                    held += len(found)
                    if len(ids) >= segment_docs or held >= SEGMENT_POSTINGS:
                        yield _segment(ids, lengths, terms, tfs)
                        ids, lengths, terms, tfs, held = [], [], [], [], 0
        if ids:
            yield _segment(ids, lengths, terms, tfs)

    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stage(rows.mapInArrow(run, SEGMENT), "search-index")


def _query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf`` of rows with ``query_id, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHashes()
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [hashes.counted(t) for t in part.column("text").to_pylist()]
                owner = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column("query_id").take(pa.array(owner, pa.int64())),
                     pa.array(np.concatenate([f[0] for f in found]).view(np.int64)),
                     pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))],
                    names=["query_id", "term", "qtf"])

    return queries.mapInArrow(run, "query_id bigint, term bigint, qtf bigint")


def _document_frequencies(index: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts")):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(terms.as_buffer(), "<i8")),
                     pa.array(np.diff(np.frombuffer(starts.as_buffer(), "<u4").astype(np.int64)))],
                    names=["t", "df"])

    return (index.select("terms", "starts").mapInArrow(run, "t bigint, df bigint")
            .groupBy("t").agg(F.sum("df").alias("df")))


class Segment:
    """A segment row, ready to be searched."""

    def __init__(self, row: dict, mean_length: float) -> None:
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.terms = np.frombuffer(row["terms"], "<u8")
        n = len(self.doc_ids)
        docs = np.frombuffer(row["docs"], "<u2")
        held = np.diff(np.frombuffer(row["starts"], "<u4").astype(np.int64))   # documents of each term
        norm = K1 * (1 - B + B * np.frombuffer(row["lengths"], "<u4") / mean_length)
        below = np.frombuffer(row["tfs"], "<u4").astype(np.float64)
        impacts = below * (K1 + 1)
        for at in range(0, len(docs), PART):
            below[at:at + PART] += norm[docs[at:at + PART]]
        impacts /= below
        del below
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), held)
        # The postings of each document, its terms in order.
        order = np.argsort(docs, kind="stable")
        self.doc_first = np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=n))))
        self.doc_terms, self.doc_impacts = term[order], impacts[order]
        del order
        # Frequent terms as a matrix of their impacts, the others as lists of postings.
        self.blocks = -(-n // BLOCK_DOCS)
        frequent = np.flatnonzero(held >= max(1, n // DENSE_SHARE))
        frequent = frequent[np.argsort(-held[frequent], kind="stable")][:DENSE_TERMS]
        self.place = np.full(len(self.terms), -1, np.int32)
        self.place[frequent] = np.arange(len(frequent))
        at, impacts = self.place[term], impacts.astype(np.float32)
        del term
        rare = at < 0
        self.docs, self.impacts = docs[rare], impacts[rare]
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK_DOCS), np.float32)
        self.dense[at[~rare], docs[~rare]] = impacts[~rare]
        self.dense_max = self.dense.reshape(len(frequent), self.blocks, BLOCK_DOCS).max(2)
        held[frequent] = 0
        self.starts = np.concatenate(([0], np.cumsum(held)))
        # Sums in single precision are off by this share at most: all parts are positive.
        self.slack = (len(frequent) + 8) * 2.0 ** -23
        self.weight_of = np.zeros(len(self.terms))

    def search(self, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray,
               best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
        """Bring up to date ``best``, the ``k`` best (ids, scores) of each query so far.

        The terms of query i are those from ``bounds[i]`` to ``bounds[i + 1]``.  A block's
        bound is its largest sum of the rare terms and the frequent terms' largest impacts;
        blocks whose bound is below the k-th score so far of each query are skipped.
        Single-precision sums of the others, with room for their error, tell which documents
        may be among the best, and those are scored in doubles.
        """
        if not len(self.terms):
            return
        owner = np.repeat(np.arange(len(best)), np.diff(bounds))
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == terms
        owner, at, weights = owner[known], at[known], weights[known]
        bounds = np.searchsorted(owner, np.arange(len(best) + 1))
        place = self.place[at]
        asked = np.zeros((len(best), len(self.dense)), np.float32)
        asked[owner[place >= 0], place[place >= 0]] = weights[place >= 0]
        sums = np.zeros((len(best), self.blocks * BLOCK_DOCS), np.float32)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            few = place[a:b] < 0
            first, last = self.starts[at[a:b][few]], self.starts[at[a:b][few] + 1]
            posting = _ranges(first, last)
            sums[i] = np.bincount(self.docs[posting], np.repeat(weights[a:b][few], last - first)
                                  * self.impacts[posting], sums.shape[1])
        floors = np.array([scores[k - 1] if len(scores) == k else 0.0 for _, scores in best])
        floors *= 1 - 2 * self.slack
        bound = sums.reshape(len(best), self.blocks, BLOCK_DOCS).max(2) + asked @ self.dense_max
        open_ = (bound > 0) & (bound >= floors[:, None])
        some = np.flatnonzero(open_.any(0))
        columns = (some[:, None] * BLOCK_DOCS + np.arange(BLOCK_DOCS)).ravel()
        sums = sums[:, columns]
        for a in range(0, len(columns), DENSE_COLUMNS):
            b = a + DENSE_COLUMNS
            sums[:, a:b] += asked @ self.dense[:, columns[a:b]]
        for i in np.flatnonzero(open_.any(1)).tolist():
            may = np.flatnonzero(sums[i] >= floors[i] if floors[i] > 0 else sums[i] > 0)
            if len(may) > k:
                near = sums[i, may]
                least = float(np.partition(near, len(near) - k)[len(near) - k])
                may = may[near >= least * (1 - 3 * self.slack)]
            if len(may):
                a, b = bounds[i], bounds[i + 1]
                best[i] = self._merged(best[i], columns[may], at[a:b], weights[a:b], k)

    def _merged(self, best: tuple[np.ndarray, np.ndarray], docs: np.ndarray, at: np.ndarray,
                weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best of ``best`` and of ``docs``, scored in doubles, term by term."""
        first, last = self.doc_first[docs], self.doc_first[docs + 1]
        posting = _ranges(first, last)
        self.weight_of[at] = weights
        scores = np.bincount(np.repeat(np.arange(len(docs)), last - first),
                             self.weight_of[self.doc_terms[posting]] * self.doc_impacts[posting],
                             len(docs))
        self.weight_of[at] = 0
        some = scores > 0
        ids = np.concatenate([best[0], self.doc_ids[docs[some]]])
        scores = np.concatenate([best[1], scores[some]])
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = last - first
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "doc_id",
           text_col: str = "text", block_terms: int = QUERY_BLOCK_TERMS,
           segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """``query_id, rank, doc_id, score``: the best ``k`` documents of each row of
    ``queries`` (same id and text columns), the document itself included.

    Ranks start at 1; equal scores go by the smaller id.  Rows with a null id are
    neither documents nor queries.  A null, empty or wordless text matches
    nothing.  Fewer than ``k`` rows where fewer documents share a term.  Rows that
    repeat an id are documents of their own; a repeated query id is one query of
    all its texts.  Empty tables give an empty table; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    index = build_index(docs, id_col, text_col, segment_docs)
    n, words = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    asked = _query_terms(queries.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("query_id"),
        F.col(text_col).cast("string").alias("text")))
    df = F.col("df")
    weighted = (asked.join(_document_frequencies(index), F.col("term") == F.col("t"))
                .select("query_id", "term", (F.col("qtf") * F.log(1 + (F.lit(n or 0) - df + 0.5)
                                                                   / (df + 0.5))).alias("weight")))
    # A query's row holds its own terms, never those of other queries.
    packed = stage(weighted.groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))
                   .groupBy("query_id")
                   .agg(F.collect_list(F.struct("term", "weight")).alias("terms")),
                   "search-queries")
    total = packed.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    mean_length = (words or 0) / n if words else 1.0
    out = scratch_path(spark, "search-found")
    found_schema = "query_id bigint, doc_id bigint, score double"
    numbered = stage(packed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))
                                       .cast("int")), "search-blocks")
    # A task goes through its segments one after the other and returns k rows a query.
    tasks = index.coalesce(spark.sparkContext.defaultParallelism)
    for block in range(blocks):                       # about block_terms terms at a time
        ids, sizes, terms, weights = [], [], [], []
        for row in numbered.where(F.col("block") == block).select("query_id", "terms").toLocalIterator():
            t = np.array([e["term"] for e in row["terms"]], np.int64).view(np.uint64)
            w = np.array([e["weight"] for e in row["terms"]])
            order = np.argsort(t)
            ids.append(row["query_id"])
            sizes.append(len(t))
            terms.append(t[order])
            weights.append(w[order])
        if not ids:
            continue
        shared = spark.sparkContext.broadcast(
            (ids, np.cumsum([0, *sizes]), np.concatenate(terms), np.concatenate(weights)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, bounds, terms, weights = shared.value
            best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = Segment({c: batch.column(c)[i].as_buffer() for c in SEGMENT_NAMES[2:]},
                                      mean_length)
                    for a in range(0, len(ids), QUERY_BATCH):
                        part, upto = best[a:a + QUERY_BATCH], bounds[a:a + QUERY_BATCH + 1]
                        segment.search(upto - upto[0], terms[upto[0]:upto[-1]],
                                       weights[upto[0]:upto[-1]], part, k)
                        best[a:a + QUERY_BATCH] = part
                    del segment                      # before the next one is made
            sizes = [len(scores) for _, scores in best]
            for a in range(0, len(ids), FOUND_QUERIES):
                part = best[a:a + FOUND_QUERIES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(ids[a:a + FOUND_QUERIES], np.int64),
                                        sizes[a:a + FOUND_QUERIES])),
                     pa.array(np.concatenate([x for x, _ in part])),
                     pa.array(np.concatenate([x for _, x in part]))],
                    names=["query_id", "doc_id", "score"])

        before = spark.conf.get(ARROW_ROWS)
        spark.conf.set(ARROW_ROWS, "1")              # a task holds one segment at a time
        try:
            tasks.mapInArrow(run, found_schema).write.mode("append").parquet(out)
        finally:
            spark.conf.set(ARROW_ROWS, before)
        shared.destroy()
    if not total:
        found = spark.createDataFrame([], found_schema)
    else:
        found = spark.read.schema(found_schema).parquet(out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "score"))
