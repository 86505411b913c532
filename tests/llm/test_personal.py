"""Personal data: fixed patterns against plain regular expressions, the field
against sums over all segmentations, and held-out forms."""

import hashlib
import itertools
import math
import random
import re
import time

import pytest

from langatlas.llm import personal as P
from langatlas.llm.queries import op13_personal_data
from tests.llm.helpers import SF, documents, edge_rows, frame

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def checksum(digits):
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return sum(odd + even) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == 2 and 12 <= len(digits) <= 19 and checksum(digits)
                    or kind == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


@pytest.fixture(scope="module")
def field():
    return P.fit(P.training_windows([w for _, t in documents() for w in P._sample_windows(t)][:200]))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(1)
    for alphabet in ("a@.1-", "0123456789 .-+()", "+1 (2).", "ab1@. é漢", "1.25", "4- "):
        for _ in range(1500):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 45)))
            assert P.base_spans(text) == plain(text), text
    found = 0
    for kind in range(4):
        for _ in range(200):
            text = "é" + P.made(kind, r) + r.choice([" ", ".", "", "1", "-5", "@x"]) + P.made(kind, r)
            assert P.base_spans(text) == plain(text)
            found += len(P.base_spans(text))
    assert found > 1000
    for _, text in documents():
        assert P.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["1" * 400_000, "a" * 400_000, "+1 " * 20_000, "1." * 20_000,
                                  "a@" * 20_000, "@a." * 20_000, "1 2 " * 10_000,
                                  " at dot" * 10_000, "(at)" * 20_000])
def test_long_runs_take_no_longer(field, text):
    begun = time.process_time()
    field.added(text, P.base_spans(text))
    assert time.process_time() - begun < 30      # squares would take hours


def segmentations(segments):
    for n in range(len(segments) + 1):
        for chosen in itertools.combinations(range(len(segments)), n):
            spans = sorted(segments[k][:2] for k in chosen)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                yield chosen


def test_dynamic_programming_equals_all_segmentations():
    r = random.Random(2)
    for _ in range(150):
        segments = []
        for _ in range(r.randint(1, 7)):
            a = r.randint(0, 8)
            segments.append((a, a + r.randint(1, 4), r.randint(0, 3), []))
        scores = [r.uniform(-2, 2) for _ in segments]
        weights = {c: sum(scores[k] for k in c) for c in segmentations(segments)}
        best = P.best_segments(segments, scores)
        assert math.isclose(sum(scores[k] for k in best), max(weights.values()), abs_tol=1e-9)
        whole, chances = P.marginals(segments, scores)
        total = sum(map(math.exp, weights.values()))
        assert math.isclose(whole, math.log(total), rel_tol=1e-9, abs_tol=1e-9)
        for k, p in enumerate(chances):
            assert math.isclose(p, sum(math.exp(w) for c, w in weights.items() if k in c) / total,
                                rel_tol=1e-9)


def test_field_finds_other_forms_and_leaves_look_alikes(field):
    r = random.Random(77)
    hit, wrong = [0] * 4, 0
    for kind in range(4):
        for _ in range(100):
            form = P.rewritten(kind, P.made(kind, r), r)
            text = "they said " + form + " yesterday"
            fixed = P.base_spans(text)
            hit[kind] += (10, 10 + len(form), kind) in fixed + field.added(text, fixed)
    for _ in range(500):
        text = "it was " + P.look_alike(r) + " then"
        wrong += bool(field.added(text, P.base_spans(text)))
    assert min(hit) >= 80 and wrong <= 10


def test_added_spans_stay_clear_of_base_spans(field):
    r = random.Random(3)
    for _ in range(300):
        text = " ".join(P.made(k, r) if r.random() < .5 else P.rewritten(k, P.made(k, r), r)
                        for k in (r.randrange(4) for _ in range(6)))
        fixed = P.base_spans(text)
        added = field.added(text, fixed)
        for s, e, _ in added:
            assert all(b <= s or a >= e for a, b, _ in fixed)
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:]))


def as_text(spans):
    return ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, e, k in spans)


def test_edge_rows(spark, field):
    rows = edge_rows() + [(50, "mail x@y.example.com, call +1 (743) 555-3824 漢 10.0.0.1"),
                          (51, "call (743) 555-3824 or bob [at] mail [dot] com")]
    got = P.find_personal_data(frame(spark, rows), field).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), as_text(plain(t or ""))) for i, t in rows)
    flat = lambda spans: [(s["start"], s["end"], s["kind_no"]) for s in spans]
    assert sorted((str(r["doc_id"]), as_text(flat(r["base"]))) for r in got) == want
    (more,) = [r["added"] for r in got if r["doc_id"] == 51]
    assert as_text(flat(more)) == "phone:5:19,email:23:46"
    assert P.find_personal_data(frame(spark, []), field).collect() == []


def test_training_sample_is_bounded_and_may_be_empty(spark):
    model = P.train(frame(spark, edge_rows()), max_documents=3, max_windows=2)
    assert model.weights and P.train(frame(spark, [])).weights


def test_query_on_the_given_documents(spark):
    got = {r["doc_id"]: r for r in op13_personal_data(spark, SF).collect()}
    for i, text in documents():
        spans = plain(text)
        row = got.pop(i)
        assert [row[f"n_{k}"] for k in P.KINDS] == [sum(s[2] == n for s in spans) for n in range(4)]
        assert row["base_sha256"] == hashlib.sha256(as_text(spans).encode()).hexdigest()
        assert set(as_text(spans).split(",")) <= set(row["spans"].split(",")) | {""}
    assert not got
