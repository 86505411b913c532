"""Toxicity by a subsequence string-kernel SVM with Nystrom landmarks.

Units.  A sentence is the set of its words (lower case, leetspeak digits read
as letters, other signs dropped) and of its runs of single characters, read as
one word ("i d i o t").  A text is the different units of its sentences; its
evidence is the ``TOP`` largest margins among them, and how many there are (a
long text has more units that look alike by chance).

Kernel.  k(u, v) is the gap-weighted subsequence kernel of length 3 (Lodhi et
al., 2002) with at most two skipped characters, decay ``GAP_DECAY`` each, over
the word with its two ends marked, normalised to 1 for u = v and raised to the
fourth power (a product of kernels is a kernel).
Inserted and left-out characters cost a decay, not the match.

Training.  Labelled sentences: a sentence has the label of its document, and
one that a clean document has too is clean.  For every unit, the toxic and the
clean sentences with it are counted (Spark); a bounded sample of the units goes
to the SVM.  Landmarks are the units most over-represented in toxic sentences
and the most frequent others; with K the kernel of the landmarks, the features
of a unit are K^(-1/2) k(u, landmarks) (Nystrom), and a linear SVM with squared
hinge loss, weighted by the counts, is fitted on them by Newton steps.  The
evidence becomes a score by a sigmoid with Platt's targets, fitted on labelled
documents that the SVM has not seen.

Bounds (documented parameters, the same at every size): ``MAX_LABELLED``
labelled documents, ``MAX_UNITS`` units per kind, ``LANDMARKS`` landmarks,
``MAX_CALIBRATION`` documents for the sigmoid.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import nlargest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langatlas.llm.common import stage, text_slices

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
MAX_LABELLED = 20_000
MAX_CALIBRATION = 5_000
MAX_UNITS = 6_000
LANDMARKS = 256
GAP_DECAY = 0.5
OVER_REPRESENTED = 3.0
RIDGE = 0.1
#: Longest stretch of a word that is one unit; longer words are overlapping stretches.
STRETCH, OVERLAP = 40, 5
MAX_WORDS = 150_000
#: Largest margins of a text that its score is made of.
TOP = 3

SENTENCE_END = re.compile(r"[.!?\n]+")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
LEET = str.maketrans("0134578@$", "oieastba" + "s")
# Places of the second and third character and the characters skipped.
PATTERNS = [(1, 2, 0), (1, 3, 1), (2, 3, 1), (1, 4, 2), (2, 4, 2), (3, 4, 2)]
CODES = 32
END_CODE = 31


def plain(word: str) -> str:
    if word.isalpha():
        return word
    if word[:-1].isalpha() and word[-1] in ".,;:!?":
        return word[:-1]
    return "".join(filter(str.isalnum, word.translate(LEET)))


def raw_units(text: str) -> list[str]:
    """Words and runs of single characters, as written but in lower case."""
    text = text.lower()
    return text.split() + [run.replace(" ", "").replace("\t", "") for run in SPACED.findall(text)]


def stretches(word: str) -> list[str]:
    """The units of one written word: none, itself, or overlapping stretches."""
    word = plain(word)
    if len(word) <= STRETCH:
        return [word] if word else []
    return [word[i:i + STRETCH] for i in range(0, len(word) - OVERLAP, STRETCH - OVERLAP)]


def coded(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all units as codes (a-z are 1-26, other letters and
    digits share 27-30), one unit after the other, and the units' lengths."""
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 4)
    return codes.astype(np.int64), np.fromiter(map(len, units), np.int64, len(units))


def occurrences(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, feature, weight) of every distinct feature of every unit."""
    values, sizes = coded(units)
    codes = np.zeros((len(units), int(sizes.max(initial=0)) + 6), np.int64)
    codes[np.repeat(np.arange(len(units)), sizes),
          np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1] = values
    codes[:, 0] = codes[np.arange(len(units)), sizes + 1] = END_CODE
    sizes = sizes + 2
    found, weights = [], []
    width = codes.shape[1] - 4
    at = np.arange(width)
    owner = np.repeat(np.arange(len(units)), width).reshape(len(units), width)
    for i, j, gaps in PATTERNS:
        inside = at + j < sizes[:, None]
        feature = (codes[:, :width] * CODES + codes[:, i:i + width]) * CODES + codes[:, j:j + width]
        found.append((owner * CODES ** 3 + feature)[inside])
        weights.append(np.full(len(found[-1]), GAP_DECAY ** gaps))
    keys, place = np.unique(np.concatenate(found), return_inverse=True)
    return keys // CODES ** 3, keys % CODES ** 3, np.bincount(place, np.concatenate(weights),
                                                              len(keys))


class Landmarks:
    """Kernel values of units against fixed landmarks."""

    def __init__(self, units: list[str]) -> None:
        owner, feature, weight = occurrences(units)
        norm = np.sqrt(np.bincount(owner, weight ** 2, len(units)))
        # The landmarks with each feature, and their normalised weights.
        order = np.argsort(feature, kind="stable")
        self.start = np.searchsorted(feature[order], np.arange(CODES ** 3 + 1))
        self.landmark = owner[order]
        self.weight = (weight / norm[owner])[order]
        self.size = len(units)

    def kernel(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), self.size), np.float32)
        for at in range(0, len(units), 2048):
            some = units[at:at + 2048]
            owner, feature, weight = occurrences(some)
            norm = np.sqrt(np.bincount(owner, weight ** 2, len(some)))
            first = self.start[feature]
            count = self.start[feature + 1] - first
            ends = np.cumsum(count)
            place = np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
            dots = np.bincount(np.repeat(owner * self.size, count) + self.landmark[place],
                               np.repeat(weight / norm[owner], count) * self.weight[place],
                               len(some) * self.size)
            square = dots.reshape(len(some), self.size) ** 2
            out[at:at + 2048] = square * square
        return out


def fit_svm(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge SVM over units that are ``toxic``
    times positive and ``clean`` times negative, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.concatenate([np.ones(len(x)), -np.ones(len(x))])
    c = np.concatenate([np.sqrt(toxic), np.sqrt(clean)])
    both, w = np.vstack([x, x]), np.zeros(x.shape[1])
    penalty = RIDGE * np.eye(len(w))
    penalty[-1, -1] = 1e-9
    for _ in range(50):
        active = (y * (both @ w) < 1) & (c > 0)
        a = both[active] * c[active, None]
        step = np.linalg.solve(a.T @ both[active] + penalty, a.T @ y[active])
        done = np.allclose(step, w, atol=1e-6)
        w = step
        if done:
            break
    return w[:-1], float(w[-1])


def fit_sigmoid(evidence: np.ndarray, labels: np.ndarray) -> list[float]:
    """Weights (the intercept last) of a lightly ridged logistic fit with Platt's
    smoothed targets."""
    pos, neg = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.hstack([evidence, np.ones((len(evidence), 1))])
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(100):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge,
                               x.T @ (target - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """What a task needs to score a text.  Without landmarks (no toxic sentence
    to learn from) every text has the score of the intercept."""

    landmarks: list[str]
    weights: list[float]
    bias: float
    sigmoid: list[float]                    # of the evidence; the intercept last

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("kernel", "seen", "telling", "margin")}

    @cached_property
    def kernel(self) -> Landmarks:
        return Landmarks(self.landmarks)

    @cached_property
    def seen(self) -> dict[str, float]:
        return {}

    @cached_property
    def telling(self) -> set[str]:
        return set()

    @cached_property
    def margin(self) -> dict[str, float]:
        return {}

    def unit_margins(self, units: list[str]) -> np.ndarray:
        return self.kernel.kernel(units) @ np.asarray(self.weights, np.float32) + self.bias

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """The TOP largest margins of each text's different units (the bias where
        it has fewer) and the logarithm of how many it has."""
        if len(self.seen) > MAX_WORDS:
            self.seen.clear()
            self.telling.clear()
        if len(self.margin) > MAX_WORDS:
            self.margin.clear()
        written = [set(raw_units(t or "")) for t in texts]
        new = list(set().union(*(words.difference(self.seen) for words in written)))
        parts, margin = [stretches(w) for w in new], self.margin
        units = list({u for p in parts for u in p if u not in margin})
        if units:
            margin.update(zip(units, self.unit_margins(units).tolist()))
        for word, p in zip(new, parts):
            found = margin[p[0]] if len(p) == 1 else max((margin[u] for u in p), default=self.bias)
            self.seen[word] = found
            if found > self.bias:
                self.telling.add(word)
        look, out = self.seen.__getitem__, np.full((len(texts), TOP + 1), self.bias)
        for row, words in zip(out, written):
            # Words above the bias come before all others.
            some = words & self.telling
            top = nlargest(TOP, map(look, some if len(some) >= TOP else words))
            row[:len(top)] = top
            row[TOP] = math.log1p(len(words))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(texts), _sigmoid(self.sigmoid[-1]))
        return _sigmoid(self.evidence(texts) @ np.array(self.sigmoid[:-1]) + self.sigmoid[-1])


def fold(id_col: str) -> "F.Column":
    """crc32 of the id as text, modulo FOLDS (null: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS))


def _unit_counts(labelled: DataFrame) -> DataFrame:
    """``unit, toxic, clean``: the different sentences of either label with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                key, label, units = [], [], []
                for text, toxic in zip(part.column("text").to_pylist(),
                                       part.column("toxic").to_pylist()):
                    for sentence in SENTENCE_END.split(text or ""):
                        if found := {u for w in raw_units(sentence) for u in stretches(w)}:
                            key.append(xxhash.xxh64_intdigest(sentence.strip().lower().encode(), 1)
                                       - (1 << 63))
                            label.append(toxic)
                            units.append(sorted(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(label, pa.int32()),
                     pa.array(units, pa.list_(pa.string()))], names=["key", "toxic", "units"])

    sentences = (labelled.select("text", "toxic")
                 .mapInArrow(run, "key bigint, toxic int, units array<string>")
                 .groupBy("key").agg(F.min("toxic").alias("toxic"), F.min("units").alias("units")))
    return (sentences.select(F.explode("units").alias("unit"), "toxic")
            .groupBy("unit").agg(F.sum("toxic").alias("toxic"),
                                 F.sum(1 - F.col("toxic")).alias("clean")))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most ``max_labelled`` labelled documents (in the order of a hash
    of their ids) outside the held-out fold.  Null ids and null labels are not
    used; of several labels of an id the smaller counts."""
    chosen = stage(
        labels.select(F.col(id_col).alias("__of"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("__of").isNotNull() & F.col("toxic").isin(0, 1))
        .where(fold("__of") != HELD_OUT)
        .groupBy("__of").agg(F.min("toxic").alias("toxic"))
        .orderBy(F.xxhash64("__of"), "__of").limit(max_labelled), "toxicity-chosen")
    # At most max_labelled (id, label) rows.
    labelled = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")
                                 .alias("text"))
                     .join(F.broadcast(chosen), F.col("doc_id") == F.col("__of"))
                     .select("text", "toxic", fold("doc_id").alias("fold")), "toxicity-labelled")
    counts = stage(_unit_counts(labelled.where(F.col("fold") != CALIBRATION)), "toxicity-units")
    base = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    share = labelled.agg(F.avg("toxic")).first()[0] or 0.0
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not base["t"] or not base["c"]:
        return Model([], [], 0.0, [prior])
    rate = base["t"] / (base["t"] + base["c"])
    expected = (F.col("toxic") + F.col("clean")) * F.lit(rate)
    scored = counts.withColumn("z", (F.col("toxic") - expected) / F.sqrt(expected + 1))
    # Three samples of at most MAX_UNITS units each.
    over = scored.where(F.col("z") >= OVER_REPRESENTED).orderBy(F.desc("z"), "unit")
    often = scored.where(F.col("z") < OVER_REPRESENTED).orderBy(F.desc("clean"), "unit")
    chance = scored.where(F.col("z") < OVER_REPRESENTED).orderBy(F.xxhash64("unit"), "unit")
    rows = {r["unit"]: r for s in (over, often, chance) for r in s.limit(MAX_UNITS).collect()}
    units = list(rows)
    positive = [u for u in units if rows[u]["z"] >= OVER_REPRESENTED][:LANDMARKS // 2]
    if not positive:
        return Model([], [], 0.0, [prior])
    others = [u for u in units if rows[u]["z"] < OVER_REPRESENTED][:LANDMARKS - len(positive)]
    landmarks = Landmarks(positive + others)
    values, vectors = np.linalg.eigh(landmarks.kernel(positive + others).astype(np.float64))
    kept = values > 1e-6
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    weights, bias = fit_svm(landmarks.kernel(units) @ whiten,
                            np.array([rows[u]["toxic"] for u in units], float),
                            np.array([rows[u]["clean"] for u in units], float))
    model = Model(positive + others, (whiten @ weights).tolist(), bias, [0.0] * (TOP + 1) + [prior])
    sample = (labelled.where(F.col("fold") == CALIBRATION)
              .orderBy(F.xxhash64("text"), "text").limit(MAX_CALIBRATION))
    rows = _evidence(sample, model).collect()      # at most MAX_CALIBRATION rows of TOP + 2 numbers
    if rows:
        model.sigmoid = fit_sigmoid(np.array([r["evidence"] for r in rows]),
                                    np.array([r["toxic"] for r in rows], float))
    return model


def _evidence(labelled: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = model.evidence(part.column("text").to_pylist()).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.list_(pa.float64())), part.column("toxic")],
                    names=["evidence", "toxic"])

    return labelled.select("text", "toxic").mapInArrow(run, "evidence array<double>, toxic int")


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per input row.  Null and empty
    texts have the score of a text without units; null and repeated ids are rows
    like any other.  Other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                scores = model.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"),
                                                  pa.array(scores, pa.float64())],
                                                 names=["doc_id", "held_out", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType())])
    return (docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == HELD_OUT).alias("held_out"),
                        F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, schema)
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                yield part.filter(pa.array(model.scores(part.column(text_col).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
