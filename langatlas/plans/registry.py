"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the given tables through the bridge and runs over all of
their rows.  Doubles are rounded to 6 decimals where an oracle compares them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langatlas.functions import scalars as SC
from langatlas.operators import correlation as C
from langatlas.operators import distribution as D
from langatlas.operators import geo as G
from langatlas.operators import graph as GR
from langatlas.operators import profile as P
from langatlas.operators import spatial as S
from langatlas.plans.pipelines import Workload, apply_geocodes, pending_locations
from langatlas.sources import repos as R
from langatlas.sources.bridge import Bridge
from langatlas.session import scratch_path
from langatlas.sinks.writers import geo_table
from langatlas.sources.geocode import parse_geocode, split_replies

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
# C17 for the given tables: their repositories are far smaller than real ones.
GRAPH_MIN_LOC = 5000


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _w(spark: SparkSession, sf_dir: str) -> Workload:
    return Workload(Bridge(spark, sf_dir), graph_min_loc=GRAPH_MIN_LOC)


def r6(c: str, name: str | None = None) -> F.Column:
    return SC.stable_round6(c).alias(name or c)


# ---------------------------------------------------------------- distribution
@query
def lang_region_loc(spark, sf_dir):
    return _w(spark, sf_dir).lang_region


@query
def region_counts(spark, sf_dir):
    return _w(spark, sf_dir).regions


@query
def clean_regions(spark, sf_dir):
    return D.clean_regions(_w(spark, sf_dir).lang_region)


@query
def lang_top_regions(spark, sf_dir):
    return D.lang_top_regions(_w(spark, sf_dir).lang_region)


@query
def lang_density(spark, sf_dir):
    return _w(spark, sf_dir).density


@query
def lang_coords(spark, sf_dir):
    w = _w(spark, sf_dir)
    return D.coords_long(w.lang_region, w.geo)


@query
def listed_languages(spark, sf_dir):
    return D.listed_languages(_w(spark, sf_dir).lang_region)


@query
def heatmap_points(spark, sf_dir):
    """Point lookup of one language: the one with the largest total weight."""
    w = _w(spark, sf_dir)
    target = (D.lang_total_label(w.density).orderBy(F.col("total").desc(), "lang")
              .limit(1).select("lang"))
    return D.heatmap_points(w.density, target.scalar())


@query
def lang_total_label(spark, sf_dir):
    return D.lang_total_label(_w(spark, sf_dir).density)


def _doc_lang_source(spark, sf_dir):
    """E1 shape over the documents table: characters per (language, source)."""
    return (Bridge(spark, sf_dir).table("documents", "lang", "source", "n_chars")
            .groupBy("lang", F.col("source").alias("location"))
            .agg(F.sum("n_chars").cast("bigint").alias("loc")))


@query
def doc_lang_source(spark, sf_dir):
    return _doc_lang_source(spark, sf_dir)


@query
def doc_top_sources(spark, sf_dir):
    """F1 over the documents table: sources per language ranked by characters."""
    return D.lang_top_regions(_doc_lang_source(spark, sf_dir))


# ------------------------------------------------------------------------- geo
@query
def geocodable_locations(spark, sf_dir):
    return G.geocodable_locations(_w(spark, sf_dir).regions)


@query
def new_locations(spark, sf_dir):
    w = _w(spark, sf_dir)
    return G.pending_locations(w.regions, w.known_geo)


@query
def geo_exists(spark, sf_dir):
    w = _w(spark, sf_dir)
    return G.location_exists(G.candidate_locations(w.regions), w.known_geo)


@query
def geo_latest(spark, sf_dir):
    b = Bridge(spark, sf_dir)
    return G.latest_geo(b.geo_log)


@query
def geocode_parse(spark, sf_dir):
    return parse_geocode(_w(spark, sf_dir).geocode_replies)


@query
def geocode_quarantine(spark, sf_dir):
    """A8 + A9: faulty replies with their bodies, and how many replies and faults the
    parsing pass counted."""
    good, bad = (scratch_path(spark, n) for n in ("replies-good", "replies-bad"))
    counts = split_replies(_w(spark, sf_dir).geocode_replies, good, bad)
    return spark.read.schema("location string, fault string, body string").parquet(bad).select(
        "*", *(F.lit(n).cast("bigint").alias(f"n_{name}") for name, n in sorted(counts.items())))


@query
def geo_upsert(spark, sf_dir):
    """B3 + B4 + P7: the resolved locations are a new version of the location table."""
    w = _w(spark, sf_dir)
    known = w.known_geo.select(*G.GEO_COLUMNS)
    table = geo_table(spark, scratch_path(spark, "geo-table"))
    table.update(lambda _: known)
    pending = pending_locations(w.repos, table.read())
    return apply_geocodes(table, pending, w.geocode_replies)


# --------------------------------------------------------------------- spatial
@query
def list_languages(spark, sf_dir):
    return S.dist_languages(_w(spark, sf_dir).dist)


@query
def spatial_universe(spark, sf_dir):
    return _w(spark, sf_dir).universe


@query
def lenient_cast(spark, sf_dir):
    """C11 over text triples with unreadable densities and positions."""
    w = _w(spark, sf_dir)
    d = w.density
    txt = F.array(
        F.when(d.density % 11 == 0, F.lit("n/a")).otherwise(d.lat.cast("string")),
        d.lng.cast("string"),
        F.when(d.density % 7 == 0, F.concat(d.density.cast("string"), F.lit("x")))
         .otherwise(d.density.cast("string")))
    return S.cast_triples(d.select("lang", txt.alias("c")), keep_rejects=True)


@query
def bin_index(spark, sf_dir):
    return _w(spark, sf_dir).bin_index


@query
def bin_vectors(spark, sf_dir):
    return _w(spark, sf_dir).bins


@query
def energy_bins(spark, sf_dir):
    return _w(spark, sf_dir).energy.select("lang", "bin", "b", F.round("norm", 6).alias("norm"),
                                           "value")


@query
def energy_bins_literal(spark, sf_dir):
    return S.energy_bins_literal(_w(spark, sf_dir).bins)


@query
def dataset_profile(spark, sf_dir):
    w = _w(spark, sf_dir)
    return P.dataset_profile(w.lang_region, w.density, w.universe)


@query
def corr_entries(spark, sf_dir):
    return P.entries_per_base(_w(spark, sf_dir).cooc)


# ----------------------------------------------------------------- correlation
@query
def lang_cooccurrence(spark, sf_dir):
    return _w(spark, sf_dir).cooc


@query
def lang_pair_totals(spark, sf_dir):
    return _w(spark, sf_dir).pair_totals


@query
def corr_top_partners(spark, sf_dir):
    return _w(spark, sf_dir).top_partners.select("lang", "rank", "partner", r6("occ"))


@query
def corr_top_languages(spark, sf_dir):
    return C.top_languages(_w(spark, sf_dir).pair_totals)


@query
def corr_report(spark, sf_dir):
    return _w(spark, sf_dir).corr_report.select(
        "lang", "pair_count", "repo_count", "rank", "partner", r6("occ"))


@query
def corr_display(spark, sf_dir):
    return C.correlation_display(_w(spark, sf_dir).corr_report)


# ----------------------------------------------------------------------- graph
@query
def primary_language(spark, sf_dir):
    return GR.primary_languages(_w(spark, sf_dir).repos)


@query
def graph_edges(spark, sf_dir):
    return _w(spark, sf_dir).edges.select("src", "dst", "n", "loc", r6("weight"))


@query
def graph_edges_literal(spark, sf_dir):
    """Q2 literal reading: the primary language is the first key."""
    e = GR.graph_edges(_w(spark, sf_dir).repos, primary="first")
    return e.select("src", "dst", "n", "loc", r6("weight"))


@query
def edge_weight_stats(spark, sf_dir):
    e = _w(spark, sf_dir).edges
    return e.select("src", "dst", "n", r6("sum_w"), r6("weight", "mean_w"), r6("std_w"))


@query
def graph_emissions(spark, sf_dir):
    """E4 as rows: the weight of every (repository, primary, neighbour)."""
    e = GR.graph_emissions(_w(spark, sf_dir).repos)
    return e.select("repo", "src", "src_loc", "dst", r6("w"))


@query
def graph_nodes(spark, sf_dir):
    return _w(spark, sf_dir).nodes


@query
def graph_node_ids(spark, sf_dir):
    w = _w(spark, sf_dir)
    return GR.graph_node_ids(w.nodes, w.edges)


# --------------------------------------------------------------- ingest & misc
@query
def resume_cursor(spark, sf_dir):
    return R.resume_cursor(Bridge(spark, sf_dir).repos_raw)


@query
def repos_since(spark, sf_dir):
    """Next page after the repositories stored before 1996."""
    raw = Bridge(spark, sf_dir).repos_raw
    stored = raw.where(F.col("_id.o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    since = R.resume_cursor(stored).scalar()
    return R.repos_since(raw.drop("_id"), since)


@query
def enrich_repos(spark, sf_dir):
    """Profiles of owners with a negative balance were not fetched (A7 default)."""
    b = Bridge(spark, sf_dir)
    repos = b.repos_with(b.users_raw(fetched=F.col("c_acctbal") >= 0))
    return repos.select(
        "id", F.col("owner.login").alias("login"), F.col("owner.type").alias("type"),
        F.col("owner.location").alias("location"), F.col("owner.repos").alias("repos"),
        F.col("owner.followers").alias("followers"),
        F.size("langs").cast("bigint").alias("n_langs"),
        D.repo_total_loc().alias("total_loc"))


@query
def array_functions(spark, sf_dir):
    """Array concat and slice, map keys and entries over a repository's languages."""
    return SC.language_arrays(Bridge(spark, sf_dir).repos)


@query
def scalar_functions(spark, sf_dir):
    return SC.location_scalars(Bridge(spark, sf_dir).owners)


def registered() -> dict[str, Query]:
    from langatlas.plans import io_queries  # noqa: F401 -- registers R queries
    return dict(REGISTRY)
