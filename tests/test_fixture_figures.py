"""The bridge reproduces the figures measured in FIXTURES.md §3 (sf0.01)."""

import os

import pytest
from pyspark.sql import functions as F

from langatlas.operators import graph as GR
from langatlas.plans.pipelines import Workload
from langatlas.sources.bridge import Bridge

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def w(spark):
    return Workload(Bridge(spark, SF), graph_min_loc=5000)


def test_langs_owner_geo(w):
    b = w.bridge
    assert tuple(b.langs.agg(F.count(F.lit(1)), F.countDistinct("lang"), F.sum("loc")).first()) \
        == (59140, 150, 1524135)
    assert tuple(b.owners.agg(F.count(F.lit(1)), F.count("location"), F.sum("repos"),
                              F.sum("followers")).first()) == (1500, 1411, 15000, 66685)
    assert tuple(b.geo.agg(F.count(F.lit(1)), F.count("lat")).first()) == (25, 23)


def test_distribution_figures(w):
    e1 = w.lang_region
    assert tuple(e1.agg(F.count(F.lit(1)), F.count("location"), F.sum("loc"),
                        F.countDistinct("lang"), F.countDistinct("location")).first()) \
        == (3019, 2892, 169976, 150, 29)
    assert tuple(w.density.agg(F.count(F.lit(1)), F.countDistinct("lat", "lng"),
                               F.sum("density")).first()) == (2274, 23, 123165)


def test_energy_figures(w):
    assert tuple(w.energy.agg(F.count(F.lit(1)), F.countDistinct("lang"),
                              F.sum("value")).first()) == (376, 150, 16638)


def test_cooccurrence_figures(w):
    assert tuple(w.cooc.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()) \
        == (22296, 230600, 41)


def test_graph_figures(w):
    first = GR.graph_edges(w.repos, primary="first")
    n, loc, wsum = first.agg(F.count(F.lit(1)), F.sum("loc"), F.sum("weight")).first()
    assert (n, loc) == (18105, 1152680) and round(wsum, 4) == 4001.2851
    for mode, lo, hi in (("first", 1650, 16761), ("max", 3034, 23809)):
        nodes = GR.graph_nodes(w.repos, primary=mode, min_loc=0)
        assert tuple(nodes.agg(F.count(F.lit(1)), F.min("loc"), F.max("loc")).first()) \
            == (150, lo, hi)
