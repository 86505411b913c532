from pyspark.sql import functions as F

from langatlas.operators import graph as GR
from tests.conftest import make_repos, owner, rows_of, srt


def _repos(spark):
    o = owner()
    return make_repos(spark, [
        (1, o, [("A", 10), ("B", 30), ("C", 60)]),   # largest not first (Q2)
        (2, o, [("A", 50), ("B", 50)]),              # equal largest: earlier wins
        (3, o, [("B", 40)]),                         # single language: no edges
        (4, o, []),
    ])


def test_primary_modes(spark):
    p = GR.primary_languages(_repos(spark))
    assert rows_of(p, "repo_id", "primary_lang", "first_lang") == srt([
        (1, "C", "A"), (2, "A", "A"), (3, "B", "B")])


def test_edges_weights_and_nodes(spark):
    repos = _repos(spark)
    e = {(r["src"], r["dst"]): r for r in GR.graph_edges(repos).collect()}
    assert set(e) == {("C", "A"), ("C", "B"), ("A", "B")}
    assert abs(e[("C", "A")]["weight"] - 0.1) < 1e-12
    assert abs(e[("A", "B")]["weight"] - 0.5) < 1e-12
    assert e[("C", "B")]["loc"] == 60 and e[("C", "B")]["std_w"] == 0.0
    nodes = {r["lang"]: r for r in GR.graph_nodes(repos, min_loc=0).collect()}
    assert nodes["C"]["loc"] == 120 and nodes["C"]["loc_repo"] == 60   # once per edge (Q12)
    assert "B" not in nodes                                             # single-language repo
    first = {(r["src"], r["dst"]) for r in GR.graph_edges(repos, primary="first").collect()}
    assert first == {("A", "B"), ("A", "C")}


def test_node_ids_flag_neighbours(spark):
    repos = _repos(spark)
    nodes = GR.graph_nodes(repos, min_loc=100)
    ids = GR.graph_node_ids(nodes, GR.graph_edges(repos))
    assert rows_of(ids, "lang", "is_primary") == srt([("A", False), ("B", False), ("C", True)])


def test_edge_spread_population(spark):
    o = owner()
    repos = make_repos(spark, [(1, o, [("A", 3), ("B", 1)]), (2, o, [("A", 1), ("B", 1)])])
    e = GR.graph_edges(repos).where(F.col("src") == "A").first()
    ws = [0.25, 0.5]
    mean = sum(ws) / 2
    assert abs(e["std_w"] - (sum((w - mean) ** 2 for w in ws) / 2) ** 0.5) < 1e-12
