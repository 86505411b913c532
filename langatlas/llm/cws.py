"""Document fingerprints by improved consistent weighted sampling.

Ioffe, "Improved Consistent Sampling, Weighted Minhash and L1 Sketching" (2010).
The terms of a text are its lower-cased words, weighted by how often they occur.
For each term and sample there are r, c ~ Gamma(2, 1) and beta ~ Uniform(0, 1),
all derived from a hash of the term, so every task draws the same numbers.  With

    t = floor(ln(weight) / r + beta)
    ln a = ln c - r * (t - beta) - r

a sample is the pair (term, t) of the smallest ``a``.  Two texts agree in a
sample with the probability of their generalised Jaccard similarity.  A
fingerprint keeps 16 bits of a hash of each pair.

For weight 1, t is 0, and ``ln a`` depends on the term alone: a worker keeps
these rows for the words it has seen (bounded).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langatlas.llm.common import stage, text_slices

SAMPLES = 64
SEED = 42
#: Words of which a worker keeps the rows of weight 1 (4 bytes a sample each).
MAX_WORDS = 300_000
#: Words that are somewhere more than once, of which it keeps r, ln c and beta.
MAX_HEAVY = 60_000
#: Distinct terms of a text whose rows are looked at together.
BLOCK_TERMS = 8192

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Rows of words in arrays of a fixed size; full arrays start again."""

    def __init__(self, samples: int = SAMPLES, max_words: int = MAX_WORDS) -> None:
        self.samples, self.max_words = samples, max_words
        self.max_heavy = max(BLOCK_TERMS, min(MAX_HEAVY, max_words))
        self.hashes = np.empty(max_words, np.uint64)
        self.ones = np.empty((max_words, samples), np.float32)
        self.heavy = np.empty(max_words, np.int64)    # row -> row of the parameters, or -1
        self.params = np.empty((self.max_heavy, 3, samples), np.float32)
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.used = self.heavy_used = 0

    def draw(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, ln c and beta, each (terms x samples)."""
        k = self.samples
        at = hashes[:, None] + np.arange(1, (5 * k + 1) // 2 + 1, dtype=np.uint64) * GOLDEN
        halves = _mix(at).view(np.uint32) >> np.uint32(8)       # two numbers of 24 bits each
        u = (halves.astype(np.float32) + np.float32(0.5)) * np.float32(2 ** -24)
        r = -np.log(u[:, :k] * u[:, k:2 * k])
        c = -np.log(u[:, 2 * k:3 * k] * u[:, 3 * k:4 * k])
        return r, np.log(c), u[:, 4 * k:5 * k]

    def _add(self, words: list[str]) -> None:
        for i in range(0, len(words), BLOCK_TERMS):
            some = words[i:i + BLOCK_TERMS]
            hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED)
                               for w in some], np.uint64)
            r, c, beta = self.draw(hashes)
            need = self.used + len(some)
            self.hashes[self.used:need] = hashes
            self.heavy[self.used:need] = -1
            self.ones[self.used:need] = c + r * beta - r
            self.rows.update(zip(some, range(self.used, need)))
            self.used = need

    def _heavy(self, rows: np.ndarray) -> np.ndarray:
        """Parameters of at most BLOCK_TERMS rows."""
        new = rows[self.heavy[rows] < 0]
        if self.heavy_used + len(new) > self.max_heavy:
            self.heavy[:self.used], self.heavy_used, new = -1, 0, rows
        if len(new):
            need = self.heavy_used + len(new)
            self.params[self.heavy_used:need] = np.stack(self.draw(self.hashes[new]), axis=1)
            self.heavy[new] = np.arange(self.heavy_used, need)
            self.heavy_used = need
        return self.params[self.heavy[rows]]

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """(texts x samples) 16-bit numbers; a text without words has zeros.  The new
        words of as many texts as the store has room for are drawn together."""
        out = np.zeros((len(texts), self.samples), np.uint16)
        group: list[tuple[int, list[str]]] = []
        fresh: dict[str, None] = {}
        for i, text in enumerate(texts):
            words = text.lower().split()
            new = [w for w in dict.fromkeys(words) if w not in self.rows and w not in fresh]
            if self.used + len(fresh) + len(new) > self.max_words:
                self._group(group, fresh, out)
                self._clear()
                group, fresh, new = [], {}, list(dict.fromkeys(words))
            if len(new) > self.max_words:       # a text that fills the store by itself
                out[i] = self._in_pieces(words, new)
                continue
            fresh.update(dict.fromkeys(new))
            if words:
                group.append((i, words))
        self._group(group, fresh, out)
        return out

    def _group(self, group: list, fresh: dict, out: np.ndarray) -> None:
        self._add(list(fresh))
        look = self.rows.__getitem__
        for i, words in group:
            rows = np.fromiter(map(look, words), np.int64, len(words))
            out[i] = self._packed(self._fold(None, *np.unique(rows, return_counts=True)))

    def _in_pieces(self, words: list[str], distinct: list[str]) -> np.ndarray:
        counts, state = Counter(words), None
        for at in range(0, len(distinct), self.max_words):
            some = distinct[at:at + self.max_words]
            self._clear()
            self._add(some)
            state = self._fold(state, np.arange(len(some)), np.array([counts[w] for w in some]))
        self._clear()
        return self._packed(state)

    def _fold(self, state: tuple | None, rows: np.ndarray, weights: np.ndarray) -> tuple:
        """The smallest values so far with their words' hashes and levels."""
        best, term, level = state or (np.full(self.samples, np.inf, np.float32),
                                      np.zeros(self.samples, np.uint64),
                                      np.zeros(self.samples, np.int64))
        once, columns = rows[weights == 1], np.arange(self.samples)
        for i in range(0, len(once), BLOCK_TERMS):
            some = once[i:i + BLOCK_TERMS]
            a = self.ones[some]
            place = a.argmin(axis=0)
            least = a[place, columns]
            won = least < best
            best[won], term[won], level[won] = least[won], self.hashes[some[place]][won], 0
        more, logs = rows[weights > 1], np.log(weights[weights > 1]).astype(np.float32)
        for i in range(0, len(more), BLOCK_TERMS):
            some = more[i:i + BLOCK_TERMS]
            r, c, beta = self._heavy(some).transpose(1, 0, 2)
            t = np.floor(logs[i:i + BLOCK_TERMS, None] / r + beta)
            a = c - r * (t - beta) - r
            place = a.argmin(axis=0)
            least = a[place, columns]
            won = least < best
            best[won], term[won] = least[won], self.hashes[some[place]][won]
            level[won] = t[place, columns][won].astype(np.int64)
        return best, term, level

    def _packed(self, state: tuple) -> np.ndarray:
        _, term, level = state
        mixed = _mix(term ^ ((level.view(np.uint64) + np.uint64(1)) * GOLDEN))
        return (mixed >> np.uint64(48)).astype(np.uint16)


@cache
def sampler(samples: int) -> Sampler:
    """One per Python worker."""
    return Sampler(samples)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal samples."""
    return float((x == y).mean())


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


ROW = T.StructType([
    T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fp", T.BinaryType()), T.StructField("edited_fp", T.BinaryType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def _compare(texts: list[str], following: list[str], samples: int) -> list[pa.Array]:
    """The columns of ROW for texts and the texts that follow them."""
    n = len(texts)
    edited = [edited_text(t, f) for t, f in zip(texts, following)]
    consecutive = texts[1:] == following[:-1]     # each following text but the last is a text
    found = sampler(samples).fingerprints(
        [*texts, *(following[-1:] if consecutive else following), *edited])
    own, changed = found[:n], found[-n:]
    after = found[1:n + 1] if consecutive else found[n:2 * n]
    return [pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([f.astype(">u2").tobytes() for f in own], pa.binary()),
            pa.array([f.astype(">u2").tobytes() for f in changed], pa.binary()),
            pa.array([likeness(x, y) for x, y in zip(own, changed)], pa.float64()),
            pa.array([likeness(x, y) for x, y in zip(own, after)], pa.float64())]


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  samples: int = SAMPLES) -> DataFrame:
    """Per input row: ``doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited,
    near_next``: its fingerprint, that of its text with the last half replaced by
    the start of the next document in ascending id order (after the last: the
    first), and how alike its fingerprint is to that and to the next document's.

    A null text is empty; texts without words have one fingerprint of their own.
    Null ids come first, equal ids are ordered by text.  One row follows itself;
    an empty table gives an empty table.  Other columns are not read.

    The texts are shuffled once, into ranges of ids.  A task passes through its
    range; only the last row of a range needs a text of another task, and those
    few rows (one a task) are finished in a second step.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", id_type),
                           *ROW, T.StructField("head", T.StringType()),
                           T.StructField("tail", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, id_arrow, held = TaskContext.get().partitionId(), None, None
        head = None

        def out(ids: list, columns: list[pa.Array], tails: list) -> pa.RecordBatch:
            nonlocal head
            n, heads = len(ids), [None] * len(ids)
            heads[0], head = head, None
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(ids, id_arrow), *columns,
                 pa.array(heads, pa.string()), pa.array(tails, pa.string())], names=schema.names)

        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            for some in text_slices(batch, "text"):
                rows = list(zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()))
                if held is None:
                    head = rows[0][1]
                else:
                    rows.insert(0, held)
                held = rows[-1]
                if len(rows) > 1:
                    ids, texts = map(list, zip(*rows))
                    yield out(ids[:-1], _compare(texts[:-1], texts[1:], samples),
                              [None] * (len(rows) - 1))
        if held is not None:
            none = [pa.array([None], t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(),
                                                  pa.float64(), pa.float64())]
            yield out([held[0]], none, [held[1]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _compare(batch.column("tail").to_pylist(),
                               batch.column("following").to_pylist(), samples)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns],
                                             names=["doc_id", *ROW.names])

    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    first, tie = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    found = stage(rows.repartitionByRange(first, tie).sortWithinPartitions(first, tie, "text")
                  .mapInArrow(run, schema), "cws-ranges")
    # One row per task from here on; the tasks are put in order without the texts.
    order = Window.orderBy("part")
    begun = found.where("head IS NOT NULL")
    after = begun.select("part").select("part", F.coalesce(
        F.lead("part").over(order), F.first("part").over(order)).alias("next"))
    tails = (found.where("tail IS NOT NULL").select("part", "doc_id", "tail").join(after, "part")
             .join(begun.select(F.col("part").alias("next"), F.col("head").alias("following")),
                   "next").select("doc_id", "tail", "following"))
    names = ["doc_id", *ROW.names]
    return found.where("tail IS NULL").select(*names).union(
        tails.mapInArrow(finish, T.StructType([schema["doc_id"], *ROW])).select(*names))
