"""Plan properties the design relies on (checked on the physical plan)."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = E.queries()[name](spark, SF)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_scan_is_pruned_and_filtered(spark):
    txt = plan(spark, "lang_region_loc")
    schema = re.search(r"ReadSchema: struct<(.*)>", txt).group(1)
    assert "owner:struct<location:string,repos:bigint,followers:bigint>" in schema
    assert "name" not in schema and "id:" not in schema
    assert "GreaterThan(owner.repos,1)" in txt and "GreaterThanOrEqual(owner.followers,10)" in txt


def test_pairs_shuffle_once(spark):
    txt = plan(spark, "lang_cooccurrence")
    tree = txt.split("\n\n")[0]
    assert tree.count("Exchange") == 1
    assert "SortMergeJoin" not in tree and "BroadcastHashJoin" not in tree   # no self join


def test_top_partners_group_limit(spark):
    """Each task keeps its best partners per base before the shuffle."""
    txt = plan(spark, "corr_top_partners")
    tree = txt.split("\n\n")[0]
    assert tree.count("WindowGroupLimit") == 2 and "Partial" in txt


@pytest.mark.parametrize("name", ["lang_region_loc", "lang_density", "lang_cooccurrence",
                                  "graph_edges", "energy_bins", "corr_report", "geocode_parse"])
def test_no_python_in_core_queries(spark, name):
    txt = plan(spark, name)
    assert "BatchEvalPython" not in txt and "ArrowEvalPython" not in txt


def test_no_broadcast_hints_in_code():
    import pathlib
    src = pathlib.Path(E.__file__).parent / "langatlas"
    # (the optional operators have one hint, on a sample of a documented size)
    hits = [p for p in src.rglob("*.py") if "llm" not in p.parts
            and ("F.broadcast(" in p.read_text() or ".hint(" in p.read_text())]
    assert hits == []
