from itertools import combinations

import numpy as np
import pytest
import xxhash

from langatlas.llm import simhash
from langatlas.llm.components import connected_components
from tests.llm.helpers import documents, edge_rows, frame


def plain_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, bits=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    unique = sorted(set(fps))
    found = groups(unique, [(a, b) for a, b in combinations(unique, 2)
                            if (a ^ b).bit_count() <= bits])
    least = {}
    for (i, _), fp in zip(rows, fps):
        known = [x for x in (least.get(found[fp]), i) if x is not None]
        least[found[fp]] = min(known, default=None)
    return sorted(((i, f"{fp:016x}", least[found[fp]]) for (i, _), fp in zip(rows, fps)), key=str)


def run(spark, rows, **kw):
    out = simhash.near_duplicates(frame(spark, rows), **kw)
    return sorted((tuple(r) for r in out.select("doc_id", "fingerprint", "component_id").collect()),
                  key=str)


def test_triples_meet_every_four_positions():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES)
               for four in combinations(range(8), 4))


def test_spark_hash_is_the_contract_hash(spark):
    row = spark.sql("SELECT xxhash64('one two') AS h").first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest("one two", 42)


def test_edge_rows_match_brute_force(spark):
    assert run(spark, edge_rows()) == brute(edge_rows())


def test_given_documents_match_brute_force(spark):
    rows = documents()
    assert run(spark, rows) == brute(rows)


def test_long_lists_give_the_same_components(spark):
    """The linear way for long posting lists against all pairs."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 3, dtype=np.int64).tolist()
    fps = sorted({b ^ int(sum(1 << int(x) for x in r.choice(62, r.integers(0, 9), replace=False)))
                  for b in base for _ in range(60)})
    want = groups(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4])
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for longest in (1, 1 << 20):
        links = simhash.fingerprint_links(table, max_list=longest).collect()
        assert all(bin(x["a"] ^ x["b"]).count("1") <= 4 for x in links)
        assert groups(fps, [(x["a"], x["b"]) for x in links]) == want


def test_components_of_a_path_a_star_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, x) for x in range(400, 450)] + [
        (7, 7), (None, 3), (900, 901), (901, 900), (900, 901)]
    got = {r["node"]: r["root"] for r in connected_components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(61)} | {x: 400 for x in [*range(400, 450), 500]} | {
        900: 900, 901: 900}
    assert got == want


def test_empty_table(spark):
    assert run(spark, []) == []
    assert simhash.keep_one(frame(spark, [])).collect() == []


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = edge_rows()
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    want = sorted((i for i, _, c in brute(rows) if i is None or i == c), key=str)
    assert ids == want


def test_max_bits_is_checked(spark):
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([(1,)], "fp bigint"), max_bits=6)
