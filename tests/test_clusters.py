import math

import numpy as np
import pytest

from langatlas.operators import clusters as CL
from langatlas.plans.registry import registered
from langatlas.schemas import DIST

SF = "/root/testdata/sf0.001"


def points(spark, vectors, parts=3):
    rows = [(i, d, x) for i, v in vectors.items() for d, x in enumerate(v) if x]
    rows += [(i, CL.MARK, 1) for i in vectors]
    return spark.createDataFrame(rows, "id string, dim bigint, x bigint").repartition(parts)


def some_vectors(n=40, d=7, seed=3):
    r = np.random.default_rng(seed)
    base = r.integers(0, 100, (5, d)) * (r.random((5, d)) < 0.5)
    return {f"L{j:02}": [int(x) for x in np.clip(base[j % 5] + r.integers(-6, 7, d), 0, 100)]
            for j in range(n)}


def table(rows, d):
    out = {}
    for r in rows:
        out.setdefault((r["model"], r["cluster"]), np.zeros(d))[r["dim"]] = r["value"]
    return out


def test_vectors_are_sparse_and_read_back(spark):
    rows = [(f"L{j}", b, (j + b) % 4) for j in range(6) for b in range(0, 9, 2) if (j + b) % 4]
    kept = spark.createDataFrame(rows, "lang string, bin bigint, value bigint")
    index = spark.range(0, 9).withColumnRenamed("id", "bin")
    langs = spark.createDataFrame([(f"L{j}",) for j in range(7)], "lang string")
    vec = CL.language_vectors(kept, index, langs)                  # L6: all zero
    assert sorted(tuple(r) for r in CL.vector_entries(vec).collect()) == sorted(rows)
    found = vec.collect()
    assert len(found) == 7
    assert all(type(r["features"]).__name__ == "SparseVector" and r["features"].size == 9
               for r in found)


def test_kmeans_equals_plain_rounds(spark):
    v = some_vectors()
    names = sorted(v)
    x = {i: np.array(v[i], float) for i in names}
    seeds = [min(names, key=lambda i: (-x[i] @ x[i], i))]
    while len(seeds) < 4:
        seeds.append(min(names, key=lambda i: (-min(sum((x[i] - x[s]) ** 2) for s in seeds), i)))
    centres = [x[s] for s in seeds]
    for _ in range(10):
        near = {i: min(range(4), key=lambda j: (round(sum((x[i] - centres[j]) ** 2), 6), j))
                for i in names}
        centres = [np.floor(np.mean([x[i] for i in names if near[i] == j], axis=0) * 1000 + .5) / 1000
                   for j in range(4)]
    got = CL.find_clusters(points(spark, v), k=4, mixture_iter=1)
    groups, want = {}, {}
    for r in got.assigned.collect():
        groups.setdefault(r["kmeans"], set()).add(r["id"])
    for i in names:
        want.setdefault(near[i], set()).add(i)
    assert [groups[c] for c in sorted(groups)] == sorted(want.values(), key=min)   # numbering too
    found = table(got.centres.collect(), 7)
    for c, members in groups.items():
        assert np.allclose(found["kmeans", c], np.mean([x[i] for i in members], axis=0), atol=6e-4)


def test_mixture_is_expectation_maximisation(spark):
    v, k, d = some_vectors(30, 5), 3, 5
    work, pts = CL.Work(spark), points(spark, v)
    start = pts.selectExpr("*", "CAST(ascii(substr(id, 3, 1)) % 3 AS INT) AS cluster")
    parameters, likelihoods = CL.fit_mixture(pts, start, k, work, max_iter=8)
    assert len(likelihoods) >= 2
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(likelihoods, likelihoods[1:]))
    names = sorted(v)
    x = np.array([v[i] for i in names], float)
    first = {r["id"]: r["cluster"] for r in CL._by_point(start, "cluster").collect()}
    share = np.array([[float(first[i] == j) for j in range(k)] for i in names])
    for _ in likelihoods:
        n = share.sum(axis=0)
        mean = share.T @ x / n[:, None]
        var = np.maximum(share.T @ x ** 2 / n[:, None] - mean ** 2, 1.0)
        log = (np.log(n / n.sum()) - 0.5 * (np.log(2 * math.pi * var)
               + (x[:, None, :] - mean) ** 2 / var).sum(axis=2).T.T)
        top = log.max(axis=1, keepdims=True)
        whole = np.exp(log - top)
        share = np.floor(whole / whole.sum(axis=1, keepdims=True) * 10_000 + .5) / 10_000
    n = share.sum(axis=0)
    mean = share.T @ x / n[:, None]
    rows = {r["dim"]: r for r in parameters.collect()}
    got = np.array([[rows[t][f"m{j}"] if t in rows else 0.0 for t in range(d)] for j in range(k)])
    assert np.allclose(got, mean, atol=0.05)        # the means are the weighted sums
    work.clear()


def test_result_does_not_depend_on_the_partitioning(spark):
    v = some_vectors(24, 6, seed=9)
    results = []
    for parts in (1, 7):
        got = CL.find_clusters(points(spark, v, parts), k=4, mixture_iter=4)
        results.append((sorted(map(tuple, got.assigned.collect())),
                        sorted(map(tuple, got.centres.collect()))))
    assert results[0] == results[1]


@pytest.mark.parametrize("vectors,clusters", [
    ({}, 0), ({"a": [0, 0], "b": [0, 0]}, 1), ({"a": [5, 0], "b": [5, 0], "c": [0, 9]}, 2)])
def test_few_different_points(spark, vectors, clusters):
    got = CL.find_clusters(points(spark, vectors, 1), k=6, mixture_iter=2)
    rows = got.assigned.collect()
    assert sorted(r["id"] for r in rows) == sorted(vectors)
    assert {r["kmeans"] for r in rows} == set(range(clusters))
    assert all(0 <= r["gmm"] < max(1, clusters) for r in rows)


def test_a_centre_without_points_stays(spark):
    work = CL.Work(spark)
    pts = points(spark, {"a": [10, 0], "b": [12, 0]})
    before = spark.createDataFrame([(0, 11000, 4000), (1, 0, 7000), (CL.MARK, 0, 0)],
                                   "dim bigint, c0 bigint, c1 bigint")
    near = pts.selectExpr("*", "0 AS cluster")
    sums, seen = work.observed(CL._sums(near, 2), *CL._seen(CL._sums(near, 2), "s", 2))
    got = {r["dim"]: (r["c0"], r["c1"]) for r in CL._centres(sums, seen, 2, before, work).collect()}
    assert got == {0: (11000, 4000), 1: (0, 7000), CL.MARK: (11000 ** 2, 4000 ** 2 + 7000 ** 2)}


def test_dense_points_round_half_up(spark):
    rows = spark.createDataFrame([(1, [0.25, -0.25, None, 0.0]), (2, [])],
                                 "vec bigint, v array<double>")
    got = sorted(tuple(r) for r in CL.dense_points(rows, "vec", "v", 10).collect())
    assert got == [(1, CL.MARK, 1), (1, 0, 3), (1, 1, -2), (2, CL.MARK, 1)]


def test_cluster_languages_from_export(spark):
    from langatlas.plans.pipelines import cluster_languages
    spots = [(float(a), float(b)) for a in range(4) for b in range(3)]
    data = []
    for j in range(14):
        coords = [[lat, lng, float((j * 7 + i * 3) % 11)] for i, (lat, lng) in enumerate(spots)
                  if (i + j) % 3]
        data.append(((f"L{j}", "{}"), coords))
    data.append((("Empty", "{}"), []))
    found = cluster_languages(spark.createDataFrame(data, DIST), k=3)
    rows = found.assigned.collect()
    assert sorted(r["id"] for r in rows) == sorted(f"L{j}" for j in range(14))
    members = CL.cluster_members(found.assigned).collect()
    for model in ("kmeans", "gmm"):
        names = [x for r in members if r["model"] == model for x in r["members"]]
        assert sorted(names) == sorted(r["id"] for r in rows)
        least = [min(r["members"]) for r in sorted(members, key=lambda r: r["cluster"])
                 if r["model"] == model]
        assert least == sorted(least)                 # numbered by the smallest member


def test_queries_share_one_fit_and_have_no_python(spark, monkeypatch):
    qs = registered()
    qs["cluster_assign"](spark, SF).count()
    monkeypatch.setattr(CL, "find_clusters", lambda *a, **k: pytest.fail("fitted again"))
    for name in ("cluster_assign", "cluster_members", "cluster_centers"):
        plan = qs[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "ArrowEval" not in plan
    assert "Python" not in qs["cluster_vectors"](spark, SF)._jdf.queryExecution().toString()


def test_rounds_leave_the_points_where_they_are(spark):
    """Sums over a point's entries read its bucket: no round shuffles points by id."""
    class Seen(CL.Work):
        plans = []

        def observed(self, df, *sums):
            self.plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().observed(df, *sums)

    rows = spark.range(40).selectExpr("id", "array(id % 2 * 9D, id * 1D) AS v")
    work = Seen(spark)
    found = CL.find_clusters(CL.dense_points(rows, "id", "v", 1), k=2, work=work)
    assert found.assigned.count() == 40
    rounds = [p for p in work.plans if "Window" in p]
    assert rounds and not any("hashpartitioning(id#" in p for p in rounds)
    names = list(work.bucketed)
    work.clear()
    assert names and not any(spark.catalog.tableExists(n) for n in names)
