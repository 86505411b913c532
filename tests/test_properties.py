"""Invariants on generated repositories, checked against plain
Python brute force.  Includes a skewed draw: one language in most
repositories and one owner holding a third of them."""

from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from langatlas.operators import correlation as C
from langatlas.operators import distribution as D
from langatlas.operators import graph as GR
from langatlas.operators import spatial as S
from tests.conftest import make_repos, owner

LANGS = ["A", "B", "C", "D", "E", "F"]
PLACES = ["Oslo", "Lima", None, "Earth"]

repo_st = st.tuples(
    st.sampled_from(PLACES), st.integers(0, 4), st.integers(0, 30),
    st.lists(st.tuples(st.sampled_from(LANGS), st.integers(0, 400)), max_size=5,
             unique_by=lambda t: t[0]))


def _build(spark, draws):
    rows = [(i, owner(loc, repos, fol), langs) for i, (loc, repos, fol, langs) in enumerate(draws)]
    return rows, make_repos(spark, rows)


def _skewed():
    rows = []
    for i in range(600):
        langs = [("A", 100 + i % 50)] + ([("B", 7)] if i % 2 else [])
        langs += [("C", i % 300)] if i % 5 == 0 else []
        o = owner("Oslo", 50, 50, login="hot") if i % 3 == 0 else owner(PLACES[i % 3], 3, 12)
        rows.append((i, o, langs))
    return rows


def check_invariants(spark, rows, repos):
    # E1 total = total LoC of the kept repositories (C1 + C2)
    kept = [r for r in rows if sum(l for _, l in r[2]) >= 200 and r[1][4] > 1 and r[1][5] >= 10]
    e1 = D.lang_region_loc(repos)
    assert (e1.agg(F.sum("loc")).first()[0] or 0) == sum(l for r in kept for _, l in r[2])
    got = {(r["lang"], r["location"]): r["loc"] for r in e1.collect()}
    want = defaultdict(int)
    for r in kept:
        for lang, loc in r[2]:
            want[(lang, r[1][3])] += loc
    assert got == dict(want)
    # co-occurrence: brute force, symmetric
    co = {(r["base"], r["other"]): r["n"] for r in C.lang_cooccurrence(repos).collect()}
    want_co = Counter((a, b) for r in rows for a, _ in r[2] for b, _ in r[2] if a != b)
    assert co == dict(want_co)
    assert all(co[(b, a)] == n for (a, b), n in co.items())
    # edge weights in [0, 1]
    for r in GR.graph_emissions(repos).collect():
        assert r["w"] is None or 0.0 <= r["w"] <= 1.0
    # top partners: self first whenever present
    for r in C.top_partners(C.lang_cooccurrence(repos),
                             C.lang_pair_totals(repos)).where(F.col("rank") == 1).collect():
        assert r["partner"] == r["lang"] and r["occ"] == 1.0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(repo_st, min_size=1, max_size=25))
def test_invariants_random(spark, draws):
    rows, repos = _build(spark, draws)
    check_invariants(spark, rows, repos)


def test_invariants_skewed(spark):
    rows = _skewed()
    check_invariants(spark, rows, make_repos(spark, rows))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(LANGS), st.integers(0, 5), st.integers(0, 5),
                          st.integers(-3, 60)), min_size=1, max_size=40))
def test_universe_and_energy_properties(spark, pts):
    coords = spark.createDataFrame([(lang, float(a), float(b), d) for lang, a, b, d in pts],
                                   "lang string, lat double, lng double, density bigint")
    uni = S.global_universe(coords)
    assert (uni.agg(F.sum("total")).first()[0] or 0) == sum(d for *_, d in pts if d > 0)
    bins = S.bin_vectors(coords, S.bin_index(uni))
    kept = defaultdict(list)
    for r in S.energy_bins(bins).collect():
        kept[r["lang"]].append((r["b"], -r["bin"]))
    literal = {r["lang"]: r["bin"] for r in S.energy_bins_literal(bins).collect()}
    every = defaultdict(list)
    for r in bins.collect():
        every[r["lang"]].append((r["value"], -r["bin"]))
    # intent and literal agree on the top bin of every language with density
    assert set(kept) == set(literal) == set(every)
    for lang, b in literal.items():
        assert -max(kept[lang])[1] == b == -max(every[lang])[1]
