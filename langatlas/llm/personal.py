"""Personal data: base patterns and a semi-Markov conditional random field.

Four kinds are found by fixed patterns (``base_spans``).  The field adds spans
that the patterns miss: numbers without a plus sign, other separators, written
out or bracketed "at" and "dot".  Its segments are whole spans: a candidate is
a run of digit groups or a local part with a host, of bounded length, and its
features look at the span as one thing (shape, digit count, checksum, octets)
and at its edges.  A segmentation's weight is the sum over its segments
(everything outside has weight 0); dynamic programming over the candidates'
boundaries chooses boundaries and kinds jointly.  Base spans are fixed: no
candidate overlaps one.

The field is trained by conditional likelihood (forward and backward sums over
all segmentations of a window).  No labels are given, so the base spans of a
bounded sample of documents are the labels: each becomes a window with its own
context, once as it is, once rewritten into a form that the patterns do not
take, and once replaced by a look-alike that is no personal data.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langatlas.llm.common import text_slices

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Bounds of the training sample: documents, and windows cut from them.
MAX_SAMPLE_DOCUMENTS = 2000
MAX_WINDOWS = 400
CONTEXT = 30
#: Longest candidate: digit groups, digits, characters of a local part or a host's labels.
MAX_GROUPS, MAX_DIGITS, MAX_LOCAL, MAX_LABELS = 8, 19, 64, 5
#: A span is added if it beats no span by this much.
MARGIN = 1.0

# The base patterns.
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit before would have begun the match: the sign before keeps long runs linear.
IP_RUN = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE_RUN = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

GROUP = re.compile(r"[0-9]+")
NUMBER_RUN = re.compile(r"[0-9]+(?:[ ().,/:\[\]-]{1,3}[0-9]+)*")
MARKER = re.compile(r"@|[\[({] ?at ?[\])}]|\bat\b", re.I)
EMAIL_SIGNS = ("@", "dot", "(at", "[at", "{at", "( at", "[ at", "{ at")
LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
DOT = re.compile(r"\.| ?[\[({] ?dot ?[\])}] ?| dot ", re.I)

Span = tuple[int, int, int]          # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, ``@`` and domain, found from the ``@`` on:
    the local part is the run of its characters before it, back to the end of
    the last match or the ``@`` before."""
    low, at = 0, text.find("@")
    while at >= 0:
        run = text[low:at]
        start = low + len(run.rstrip(LOCAL_CHARS))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), EMAIL
        low = found.end() if found else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind; kinds may overlap."""
    found = list(_emails(text))
    if DIGIT.search(text):
        for m in IP_RUN.finditer(text):
            if all(map(octet, m[0].split("."))):
                found.append((m.start(), m.end(), IP))
        for m in CARD_RUN.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), CARD))
        for m in PHONE_RUN.finditer(text):
            if 9 <= sum(map(len, GROUP.findall(m[0]))) <= 15:
                found.append((m.start(), m.end(), PHONE))
        found.sort(key=lambda s: (s[0], s[2]))
    return found


# ------------------------------------------------------------------ candidates
def _char_class(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return ("digit" if c in "0123456789" else "letter" if c.isalpha()
            else "space" if c.isspace() else c if c in "+(.-/:,#@=\"'_" else "other")


def _edges(text: str, start: int, end: int) -> list[str]:
    """What stands around the span: the signs beside it, whether a number goes on
    behind a sign, the word before."""
    before, after = _char_class(text, start - 1), _char_class(text, end)
    left = before not in ("space", "edge") and _char_class(text, start - 2) == "digit"
    right = after not in ("space", "edge") and _char_class(text, end + 1) == "digit"
    word = re.findall(r"[^\W\d_]+", text[max(0, start - 24):start])
    return [f"before={before}", f"after={after}", f"goes on={left}{right}",
            f"word={word[-1].lower() if word else ''}"]


def _number_features(text: str, start: int, end: int, groups: list[str]) -> list[str]:
    span = text[start:end]
    digits = "".join(groups)
    shape = GROUP.sub(lambda m: str(len(m[0])), span)
    return ["shape=" + shape, "separators=" + "".join(sorted(set(GROUP.sub("", span)))),
            f"digits={len(digits)}", f"groups={len(groups)}",
            "lengths=" + ",".join(str(len(g)) for g in groups),
            f"checksum={luhn(digits)}", f"octets={len(groups) == 4 and all(map(octet, groups))}",
            f"first={text[start]}", *_edges(text, start, end)]


def _number_candidates(text: str) -> Iterator[tuple[int, int, int, list[str]]]:
    for run in NUMBER_RUN.finditer(text):
        spans = [m.span() for m in GROUP.finditer(text, run.start(), run.end())]
        for a, (first, _) in enumerate(spans):
            opened = first - (first > 0 and text[first - 1] in "(+")
            groups, size = [], 0
            for start, end in spans[a:a + MAX_GROUPS]:
                size += end - start
                if size > MAX_DIGITS:
                    break
                groups.append(text[start:end])
                kinds = ([IP] * (len(groups) == 4 and size <= 12) + [CARD] * (size >= 12)
                         + [PHONE] * (7 <= size <= 15))
                if kinds:
                    plain = _number_features(text, first, end, groups)
                    for kind in kinds:
                        if kind == PHONE and opened < first:
                            yield opened, end, kind, _number_features(text, opened, end, groups)
                        else:
                            yield first, end, kind, plain


def _email_candidates(text: str) -> Iterator[tuple[int, int, int, list[str]]]:
    folded = text.lower()
    if not any(sign in folded for sign in EMAIL_SIGNS):
        return
    for mark in MARKER.finditer(text):
        stop = mark.start()
        while stop and text[stop - 1] == " " and mark.start() - stop < 2:
            stop -= 1
        run = text[max(0, stop - MAX_LOCAL):stop]
        start = stop - len(run) + len(run.rstrip(LOCAL_CHARS))
        at = mark.end() + (text[mark.end():mark.end() + 1] == " ")
        label = LABEL.match(text, at)
        if start == stop or not label:
            continue
        dots, end, labels = [], label.end(), 1
        while labels < MAX_LABELS and (dot := DOT.match(text, end)):
            label = LABEL.match(text, dot.end())
            if not label:
                break
            dots.append(dot[0].strip().lower())
            end, labels = label.end(), labels + 1
            sign = mark[0].lower().replace(" ", "")
            more = DOT.match(text, end)
            yield start, end, EMAIL, [
                f"at={sign}", f"dots={sorted(set(dots))}", f"at={sign} dots={sorted(set(dots))}",
                f"spaced={stop < mark.start()}{at > mark.end()}", f"last={min(len(label[0]), 5)}",
                f"last letters={label[0].isalpha()}", f"ends={not more}", f"labels={labels}",
                f"local={min(stop - start, 4)}", *_edges(text, start, end)]


def candidates(text: str, fixed: list[Span]) -> list[tuple[int, int, int, list[str]]]:
    """Candidate segments (start, end, kind, features) that overlap no fixed span;
    a feature is named for its kind."""
    barrier: list[list[int]] = []
    for start, end, _ in sorted(fixed):
        if barrier and start < barrier[-1][1]:
            barrier[-1][1] = max(barrier[-1][1], end)
        else:
            barrier.append([start, end])
    found, k = [], 0
    every = sorted([*_number_candidates(text), *_email_candidates(text)],
                   key=lambda c: (c[0], c[1], c[2]))
    for start, end, kind, features in every:
        while k < len(barrier) and barrier[k][1] <= start:
            k += 1
        if k < len(barrier) and barrier[k][0] < end:
            continue
        name = KINDS[kind]
        found.append((start, end, kind, [name, *(f"{name} {f}" for f in features)]))
    return found


# ----------------------------------------------------------------------- field
def _boundaries(segments: list) -> tuple[dict[int, int], list[list[int]]]:
    """Numbers of the boundaries, and the segments that end at each."""
    points = sorted({p for s in segments for p in s[:2]})
    number = {p: k for k, p in enumerate(points)}
    ending: list[list[int]] = [[] for _ in points]
    for k, s in enumerate(segments):
        ending[number[s[1]]].append(k)
    return number, ending


def best_segments(segments: list, scores: list[float]) -> list[int]:
    """The segments of the best segmentation (Viterbi); of equal ones the one with
    fewer segments from the left."""
    number, ending = _boundaries(segments)
    best, back = [0.0], [None]
    for point in range(1, len(ending)):
        top, via = best[point - 1], None
        for k in ending[point]:
            got = best[number[segments[k][0]]] + scores[k]
            if got > top:
                top, via = got, k
        best.append(top)
        back.append(via)
    chosen, point = [], len(ending) - 1
    while point > 0:
        if back[point] is None:
            point -= 1
        else:
            chosen.append(back[point])
            point = number[segments[back[point]][0]]
    return chosen[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(segments: list, scores: list[float]) -> tuple[float, list[float]]:
    """Log of the sum over all segmentations, and each segment's probability."""
    number, ending = _boundaries(segments)
    forward = [0.0]
    for point in range(1, len(ending)):
        total = forward[point - 1]
        for k in ending[point]:
            total = _log_add(total, forward[number[segments[k][0]]] + scores[k])
        forward.append(total)
    backward = [0.0] * len(ending)
    starting = defaultdict(list)
    for k, s in enumerate(segments):
        starting[number[s[0]]].append(k)
    for point in range(len(ending) - 2, -1, -1):
        total = backward[point + 1]
        for k in starting[point]:
            total = _log_add(total, scores[k] + backward[number[segments[k][1]]])
        backward[point] = total
    whole = forward[-1] if forward else 0.0
    return whole, [math.exp(forward[number[s[0]]] + x + backward[number[s[1]]] - whole)
                   for s, x in zip(segments, scores)]


@dataclass
class Field:
    """Weights of the features seen in training; others weigh nothing."""

    weights: dict[str, float]
    margin: float = MARGIN

    def scores(self, segments: list) -> list[float]:
        look = self.weights.get
        return [sum(look(f, 0.0) for f in s[3]) for s in segments]

    def added(self, text: str, fixed: list[Span]) -> list[Span]:
        segments = candidates(text, fixed)
        if not segments:
            return []
        scores = [x - self.margin for x in self.scores(segments)]
        return [segments[k][:3] for k in best_segments(segments, scores)]


def fit(windows: list[tuple[str, Span | None]], rounds: int = 8, rate: float = 0.5,
        shrink: float = 1e-3) -> Field:
    """Field by stochastic ascent of the conditional likelihood (AdaGrad)."""
    examples = []
    for text, gold in windows:
        segments = candidates(text, [])
        hit = [k for k, s in enumerate(segments) if s[:3] == gold]
        if segments and (hit or gold is None):
            examples.append((segments, set(hit)))
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-6)
    model, order = Field(weights), random.Random(0)
    for _ in range(rounds):
        order.shuffle(examples)
        for segments, hit in examples:
            _, chances = marginals(segments, model.scores(segments))
            step: dict[str, float] = defaultdict(float)
            for k, (segment, chance) in enumerate(zip(segments, chances)):
                missing = (k in hit) - chance
                if abs(missing) > 1e-4:
                    for f in segment[3]:
                        step[f] += missing
            for f, g in step.items():
                g -= shrink * weights[f]
                squares[f] += g * g
                weights[f] += rate * g / math.sqrt(squares[f])
    return Field({f: w for f, w in weights.items() if w})


# -------------------------------------------------------------------- training
def rewritten(kind: int, span: str, r: random.Random) -> str:
    """The same personal data in a form that the base patterns do not take."""
    if kind == EMAIL:
        local, host = span.split("@", 1)
        at = r.choice([" at ", " [at] ", "[at]", "(at)", " (at) ", "@"])
        dot = r.choice([" dot ", "[dot]", "(dot)", " [dot] "] + ["."] * (at != "@"))
        return local + at + host.replace(".", " dot " if at == " at " else dot)
    groups = GROUP.findall(span)
    if kind == IP:
        return r.choice(["[.]", " . ", "(.)", ". "]).join(groups)
    digits = "".join(groups)
    if kind == CARD:
        cuts = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return r.choice([".", "/", " - ", ". ", "  "]).join(cuts)
    country, area, mid, last = digits[:-10] or "1", digits[-10:-7], digits[-7:-4], digits[-4:]
    return r.choice([f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}",
                     f"{country}-{area}-{mid}-{last}", f"00{country} {area} {mid} {last}",
                     f"({area}){mid}-{last}", f"{country} ({area}) {mid}-{last}"])


def look_alike(r: random.Random) -> str:
    """A number or phrase that is no personal data."""
    n = r.randint
    while luhn(serial := "".join(str(n(0, 9)) for _ in range(n(12, 19)))):
        pass
    return r.choice([
        f"{n(1, 28):02}.{n(1, 12):02}.{n(1950, 2050)}",
        f"{n(1950, 2050)}-{n(1, 12):02}-{n(1, 28):02}",
        f"{n(1, 12)}/{n(1, 28)}/{n(1950, 2050)}", f"{n(0, 23)}:{n(0, 59):02}:{n(0, 59):02}",
        f"{n(1950, 2050)}-{n(1, 12):02}-{n(1, 28):02} {n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}",
        f"{n(0, 30)}.{n(0, 30)}.{n(0, 300)}",
        f"{n(1, 999)},{n(0, 999):03},{n(0, 999):03}.{n(0, 99):02}",
        f"{n(1, 999)}.{n(0, 999):03}.{n(0, 999):03},{n(0, 99):02}", serial, serial[:n(7, 11)],
        f"{n(256, 999)}.{n(0, 999)}.{n(0, 999)}.{n(0, 999)}", f"{n(1000, 9999)}-{n(1000, 9999)}",
        f"{n(0, 9)}.{n(10**6, 10**12)}", f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}",
        " ".join(str(n(1, 255)) for _ in range(n(3, 6))), f"{n(10**6, 10**9)}", "sat at home dot",
        f"look at {n(1, 99)} dots", f"${n(1, 999)},{n(0, 999):03},{n(0, 999):03}",
        " ".join(serial[i:i + 4] for i in range(0, len(serial), 4)), f"a@{n(1, 99)}"])


def made(kind: int, r: random.Random) -> str:
    """Personal data by rule, in the base form."""
    n = r.randint
    if kind == EMAIL:
        local = r.choice("abcdefghij") + r.choice(["mia", "li.wu", "j_doe", "ob"])
        host = r.choice([f"mail{n(1, 9)}.example", "mail", "firm", "post.town"])
        return f"{local}{r.choice(['', n(1, 99)])}@{host}.{r.choice(['com', 'org', 'net', 'de'])}"
    if kind == IP:
        return ".".join(str(n(0, 255)) for _ in range(4))
    if kind == CARD:
        body = "".join(str(n(0, 9)) for _ in range(15))
        return next(body + d for d in "0123456789" if luhn(body + d))
    return f"+{n(1, 9)} ({n(200, 999)}) {n(200, 999)}-{n(0, 9999):04}"


def training_windows(found: list[tuple[str, str, str, int]],
                     per_kind: int = 40) -> list[tuple[str, Span | None]]:
    """Windows with their label from (before, span, after, kind) rows; kind -1 is a
    number that is no base span.  Spans made by rule take part, too, so a sample
    without some kind still teaches it; their contexts are those of the sample."""
    r = random.Random(0)
    around = [(b, a) for b, _, a, _ in found] or [("", "")]
    rows = list(found)
    for kind in range(len(KINDS)):
        for _ in range(per_kind):
            before, after = r.choice(around)
            rows.append((before, made(kind, r), after, kind))
    windows: list[tuple[str, Span | None]] = []
    for before, span, after, kind in rows:
        forms = [span] if kind < 0 else [span, rewritten(kind, span, r)]
        for form in forms:
            gold = None if kind < 0 else (len(before), len(before) + len(form), kind)
            windows.append((before + form + after, gold))
        windows.append((before + look_alike(r) + after, None))
    return windows


def _sample_windows(text: str) -> Iterator[tuple[str, str, str, int]]:
    """Contexts of the base spans and of other numbers; they hold no digit and no
    sign that a span has, so a window has one span at most."""
    fixed = base_spans(text)
    others = [(m.start(), m.end(), -1) for m in NUMBER_RUN.finditer(text)
              if m.end() - m.start() > 5
              and not any(s < m.end() and e > m.start() for s, e, _ in fixed)]
    for start, end, kind in fixed + others[:20]:
        if end - start <= 120:
            before = re.split("[0-9@+(]", text[max(0, start - CONTEXT):start])[-1]
            after = re.split("[0-9@+]", text[end:end + CONTEXT])[0]
            yield before, text[start:end], after, kind


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_documents: int = MAX_SAMPLE_DOCUMENTS, max_windows: int = MAX_WINDOWS) -> Field:
    """Fit the field to a bounded sample: the documents with the smallest hashes of
    their ids, and of their windows those with the smallest hashes.  An empty
    table trains on the spans made by rule."""
    hashed = docs.select(F.xxhash64(F.col(id_col)).alias("h"),
                         F.col(text_col).cast("string").alias("text"))
    least = hashed.select("h").orderBy("h").limit(max_documents)
    limit = least.agg(F.max("h")).first()[0]
    if limit is None:
        return fit(training_windows([]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = [w for t in part.column("text").to_pylist()
                        for w in _sample_windows(t or "")]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.string()) for c in columns[:3]),
                     pa.array(columns[3], pa.int32())], names=["before", "span", "after", "kind"])

    windows = (hashed.where(F.col("h") <= limit).select("text")
               .mapInArrow(run, "before string, span string, after string, kind int"))
    rows = (windows.orderBy(F.xxhash64("before", "span", "after"), "before", "span", "after")
            .limit(max_windows).collect())
    return fit(training_windows([tuple(r) for r in rows]))


# ------------------------------------------------------------------- operator
SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("kind_no", T.IntegerType()),
    T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


def find_personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``doc_id, base, added``: spans of the fixed patterns and spans that the field
    adds, each (start, kind_no, end, kind) in code points, end exclusive, by
    start, then kind.

    Base spans of different kinds may overlap; added ones overlap none.  A null
    or empty text has none.  Null and repeated ids are rows like any other, an
    empty table gives an empty one, other columns are not read.  Work and memory
    go with the text: long runs of digits, signs or letters cost no more.
    """
    weights = docs.sparkSession.sparkContext.broadcast(field)   # some thousand features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = weights.value
        kind_of = pa.struct([("start", pa.int64()), ("kind_no", pa.int32()),
                             ("end", pa.int64()), ("kind", pa.string())])
        for batch in batches:
            for part in text_slices(batch, "text"):
                base, added = [], []
                for text in part.column("text").to_pylist():
                    fixed = base_spans(text) if text else []
                    base.append([(s, k, e, KINDS[k]) for s, e, k in fixed])
                    more = model.added(text, fixed) if text else []
                    added.append([(s, k, e, KINDS[k]) for s, e, k in more])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(
                        [[dict(zip(("start", "kind_no", "end", "kind"), x)) for x in row]
                         for row in spans], pa.list_(kind_of)) for spans in (base, added))],
                    names=["doc_id", "base", "added"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("base", SPANS), T.StructField("added", SPANS)])
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, schema))
