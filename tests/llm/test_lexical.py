"""Ranked lexical search against a plain double loop."""

import math
import random
import re
from collections import Counter

import pytest

from langatlas.llm import lexical
from tests.llm.helpers import documents, edge_rows, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top=10):
    held = [(i, plain_terms(t)) for i, t in docs]
    held = [(i, ts, Counter(ts)) for i, ts in held if ts]
    n_docs, n_terms = len(held), sum(len(ts) for _, ts, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, ts, c in held:
            m = 25 + (75 * len(ts) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in plain_terms(text))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort()
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(found[:top])]
    return out


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "b") for i, t in rows],
                                 "item_id bigint, text string, score int, block string")


def got(df):
    key = lambda r: tuple((v is None, v or 0) for v in r)
    return sorted((tuple(r) for r in df.collect()), key=key)


def same(df, docs, items, **more):
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert got(df) == sorted(brute(docs, items, **more), key=key)


ITEMS = [(1, "One two, THREE"), (2, None), (3, ""), (4, "... !"), (5, "two two one id"),
         (6, "Ünïcode 漢字 zz"), (7, "nothing-of-this-kind qqqq"), (None, "one"), (7, "lost id")]


def test_edge_rows(spark):
    docs = edge_rows()
    same(lexical.rank_documents(frame(spark, docs), items_frame(spark, ITEMS)), docs, ITEMS)


@pytest.mark.parametrize("limits", [{}, {"max_items": 3}, {"max_term_bytes": 300}])
def test_given_documents_in_blocks(spark, limits):
    docs = documents()
    r = random.Random(5)
    items = [(i, " ".join(r.choice(docs)[1].split()[:r.randint(1, 30)])) for i in range(12)]
    same(lexical.rank_documents(frame(spark, docs), items_frame(spark, items), **limits),
         docs, items)


def test_many_copies_tie_by_id(spark):
    docs = [(i, "same words here") for i in range(400)] + [(1000, "words")]
    items = [(0, "same here"), (1, "words")]
    same(lexical.rank_documents(frame(spark, docs), items_frame(spark, items)), docs, items)
    same(lexical.rank_documents(frame(spark, docs), items_frame(spark, items), top=3),
         docs, items, top=3)


def test_empty_tables(spark):
    assert lexical.rank_documents(frame(spark, []), items_frame(spark, ITEMS)).collect() == []
    assert lexical.rank_documents(frame(spark, edge_rows()),
                                  items_frame(spark, [])).collect() == []


def test_terms_are_bytes_of_the_pattern():
    text = "".join(chr(c) for c in range(0x300)) + "İẞK漢🙂 x"
    assert [t.decode() for t in lexical.terms_of(text.encode())] == plain_terms(text)
