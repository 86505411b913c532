from pyspark.sql import functions as F

from langatlas.operators import correlation as C
from tests.conftest import make_repos, owner, rows_of, srt


def _repos(spark):
    o = owner()
    return make_repos(spark, [
        (1, o, [("A", 10), ("B", 5), ("C", 1)]),
        (2, o, [("A", 3), ("B", 3)]),
        (3, o, [("A", 7)]),               # single language: no pairs (C3)
        (4, o, [("B", 2), ("D", 2)]),
    ])


def test_pairs_symmetric_counts(spark):
    co = C.lang_cooccurrence(_repos(spark))
    got = {(r["base"], r["other"]): r["n"] for r in co.collect()}
    assert got[("A", "B")] == got[("B", "A")] == 2
    assert got[("A", "C")] == 1 and ("A", "A") not in got
    assert sum(got.values()) == 3 * 2 + 2 * 1 + 2 * 1


def test_pair_totals_are_ordered_pairs(spark):
    t = C.lang_pair_totals(_repos(spark))
    assert rows_of(t, "lang", "pair_count", "repo_count") == srt([
        ("A", 3, 2), ("B", 4, 3), ("C", 2, 1), ("D", 1, 1)])


def test_top_partners_self_first_and_ties(spark):
    repos = _repos(spark)
    top = C.top_partners(C.lang_cooccurrence(repos), C.lang_pair_totals(repos), k=3)
    a = [(r["rank"], r["partner"], round(r["occ"], 4)) for r in
         top.where(F.col("lang") == "A").orderBy("rank").collect()]
    assert a == [(1, "A", 1.0), (2, "B", round(2 / 3, 4)), (3, "C", round(1 / 3, 4))]
    d = [(r["rank"], r["partner"]) for r in top.where(F.col("lang") == "D").orderBy("rank").collect()]
    # D co-occurs with B in every repository: ratio 1 ties with itself; self wins the tie
    assert d == [(1, "D"), (2, "B")]


def test_top_languages_and_display(spark):
    repos = _repos(spark)
    best = C.top_languages(C.lang_pair_totals(repos), k=2)
    assert [r["lang"] for r in best.collect()] == ["B", "A"]
    rep = C.correlation_report(repos, top_langs=2, top_k=3)
    disp = {(r["lang"], r["partner"]): r["pct"] for r in C.correlation_display(rep).collect()}
    assert disp[("A", "A")] == "100.00 %"
    assert disp[("A", "B")] == "66.66 %"   # truncated, not rounded


def test_lazy_percent_truncates(spark):
    df = spark.createDataFrame([(0.123456,), (1.0,), (0.00019,)], "occ double")
    assert [r[0] for r in df.select(C.lazy_percent("occ")).collect()] == [
        "12.34 %", "100.00 %", "0.01 %"]


def test_correlation_json_export(spark):
    import json
    rep = C.correlation_report(_repos(spark), top_langs=2, top_k=3)
    out = {r["lang"]: (r["pair_count"], json.loads(r["top"])) for r in C.correlation_json(rep).collect()}
    assert set(out) == {"A", "B"}
    pc, top = out["A"]
    assert pc == 3 and [t["lang"] for t in top] == ["A", "B", "C"]
    assert top[0]["occ"] == 1.0 and abs(top[1]["occ"] - 2 / 3) < 1e-12
