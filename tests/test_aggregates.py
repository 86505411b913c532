"""Aggregates that are kept up batch by batch equal those of one full run."""

from langatlas.operators.correlation import lang_cooccurrence, lang_pair_totals
from langatlas.operators.distribution import lang_region_loc
from langatlas.operators.graph import graph_edges
from langatlas.session import scratch_path
from langatlas.streaming.aggregates import Aggregates
from tests.conftest import make_repos, owner, rows_of


def repos_of(n):
    names = ["A", "B", "C", "D", "E"]
    return [(i, owner(["Oslo", "Lima", None][i % 3]),
             [(names[(i + j) % 5], 50 + 37 * (i * j % 7)) for j in range(i % 4 + 1)])
            for i in range(n)]


def same(kept, repos):
    assert rows_of(kept.lang_region_loc(), "lang", "location", "loc") == rows_of(
        lang_region_loc(repos), "lang", "location", "loc")
    assert rows_of(kept.lang_cooccurrence(), "base", "other", "n") == rows_of(
        lang_cooccurrence(repos), "base", "other", "n")
    cols = ("lang", "pair_count", "repo_count")
    assert rows_of(kept.lang_pair_totals(), *cols) == rows_of(lang_pair_totals(repos), *cols)
    got = {(r["src"], r["dst"]): r for r in kept.graph_edges().collect()}
    want = {(r["src"], r["dst"]): r for r in graph_edges(repos).collect()}
    assert set(got) == set(want)
    for edge, r in want.items():
        assert (got[edge]["n"], got[edge]["loc"]) == (r["n"], r["loc"])
        assert abs(got[edge]["weight"] - r["weight"]) < 1e-9


def test_batches_equal_one_full_run(spark):
    rows = repos_of(30)
    kept = Aggregates(spark, scratch_path(spark, "agg"))
    for batch, (a, b) in enumerate([(0, 11), (11, 12), (12, 30)]):
        part = make_repos(spark, rows[a:b])
        kept.add(part, batch)
        kept.add(part, batch)                       # delivered again: nothing changes
    same(kept, make_repos(spark, rows))


def test_a_crash_between_the_tables_is_made_up_for(spark, monkeypatch):
    rows = repos_of(12)
    kept = Aggregates(spark, scratch_path(spark, "agg"))
    part = make_repos(spark, rows)
    kept.add(part, 0, tables=("regions", "pairs"))  # died before the other two
    kept.add(part, 0)
    same(kept, part)


def test_two_writers_add_up(spark):
    rows = repos_of(12)
    kept = Aggregates(spark, scratch_path(spark, "agg"))
    kept.add(make_repos(spark, rows[:6]), 0, writer="one")
    kept.add(make_repos(spark, rows[6:]), 0, writer="two")
    same(kept, make_repos(spark, rows))
