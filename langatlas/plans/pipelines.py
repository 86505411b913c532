"""Composite pipelines (the reference's entry points) over D1 repositories."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langatlas.operators import clusters as CL
from langatlas.operators import correlation as C
from langatlas.operators import distribution as D
from langatlas.operators import geo as G
from langatlas.operators import graph as GR
from langatlas.operators import spatial as S
from langatlas.session import cut_lineage
from langatlas.sinks.versions import VersionedTable
from langatlas.sources.bridge import Bridge
from langatlas.sources.geocode import parse_geocode


def language_density(repos: DataFrame, geo: DataFrame) -> DataFrame:
    """P1 (``--dist``): LoC per language per positioned location, long form.
    (Repositories from a D1 file come through ``sources.repos.load_repos``.)"""
    return D.locate(D.lang_region_loc(repos), geo)


def language_correlation(repos: DataFrame, top_langs: int = C.TOP_LANGUAGES,
                         top_partners: int = C.TOP_PARTNERS) -> DataFrame:
    """P2 (``--corr``): top languages with their top partners."""
    return C.correlation_report(repos, top_langs, top_partners)


def language_graph(repos: DataFrame, min_loc: float = GR.MIN_NODE_LOC,
                   primary: str = "max") -> tuple[DataFrame, DataFrame]:
    """P3 (``--graph``): (nodes above ``min_loc``, all edges)."""
    return GR.graph_nodes(repos, primary, min_loc), GR.graph_edges(repos, primary)


def pending_locations(repos: DataFrame, geo: DataFrame) -> DataFrame:
    """P7, first half: locations to send to the geocoder."""
    return G.pending_locations(D.region_counts(repos), geo)


def apply_geocodes(geo: VersionedTable, pending: DataFrame, replies: DataFrame,
                   batch: tuple[str, int] | None = None) -> DataFrame:
    """P7, second half: parse the replies, record misses with nulls and upsert them
    into a new version of the location table, which is returned."""
    records = G.resolve_lookups(pending, parse_geocode(replies))
    return geo.read(geo.update(lambda _: G.one_record(records), batch))


def cluster_languages(dist: DataFrame, k: int = 6, share: float = S.ENERGY_SHARE,
                      work: CL.Work | None = None) -> CL.Clusters:
    """P4 (the reference's Spark job): density export -> spots -> bin vectors
    -> energy threshold -> k-means + Gaussian mixture.

    The exploded coordinates are materialised (several branches read them); the
    result reads tables of ``work`` (see ``clusters.find_clusters``).
    """
    coords = cut_lineage(S.explode_coords(dist))
    index = S.bin_index(S.global_universe(coords))
    kept = S.energy_bins(S.bin_vectors(coords, index), share)
    return CL.find_clusters(CL.language_points(kept, coords.select("lang").distinct()), k,
                            work=work)


@dataclass
class Workload:
    """Shared intermediate plans over one bridge (lazy DataFrames only)."""
    bridge: Bridge
    graph_min_loc: float

    @cached_property
    def repos(self) -> DataFrame:
        return self.bridge.repos

    @cached_property
    def lang_region(self) -> DataFrame:
        return D.lang_region_loc(self.repos)

    @cached_property
    def regions(self) -> DataFrame:
        return D.region_counts(self.repos)

    @cached_property
    def geo(self) -> DataFrame:
        return self.bridge.geo

    @cached_property
    def known_geo(self) -> DataFrame:
        """Locations already geocoded before this run: nations of the first two regions."""
        return self.bridge.geo.where(F.col("n_regionkey") < 2)

    @cached_property
    def density(self) -> DataFrame:
        return language_density(self.repos, self.geo)

    @cached_property
    def dist(self) -> DataFrame:
        """The nested density export (D3), in parts of some eight locations (the given
        tables have thirty in all) and with both forms of ``lang.value``."""
        return D.nest_coords(self.lang_region, self.geo, part_rows=8, pairs_for_single=True)

    @cached_property
    def coords_plan(self) -> DataFrame:
        """Spatial input in long form ``lang, lat, lng, density`` (lazy).

        The spatial operators never need the per-language lists of the nested
        export (a hot language would put all its spots in one row), so they
        start from the long table; ``explode_coords`` is the adapter for
        reading an export file."""
        return self.density.select("lang", "lat", "lng", "density")

    @cached_property
    def coords(self) -> DataFrame:
        """``coords_plan`` materialised, for plans that read it twice (the bin
        index and the per-spot sums both start from it)."""
        return cut_lineage(self.coords_plan)

    @cached_property
    def universe(self) -> DataFrame:
        return S.global_universe(self.coords_plan)

    @cached_property
    def bin_index(self) -> DataFrame:
        return S.bin_index(self.universe)

    @cached_property
    def bins_index(self) -> DataFrame:
        """The bin index over the materialised coordinates (shared by the bin
        vectors and the clustering vector size)."""
        return S.bin_index(S.global_universe(self.coords))

    @cached_property
    def bins(self) -> DataFrame:
        return S.bin_vectors(self.coords, self.bins_index)

    @cached_property
    def energy(self) -> DataFrame:
        return S.energy_bins(self.bins)

    @cached_property
    def cooc(self) -> DataFrame:
        return C.lang_cooccurrence(self.repos)

    @cached_property
    def pair_totals(self) -> DataFrame:
        return C.lang_pair_totals(self.repos)

    @cached_property
    def top_partners(self) -> DataFrame:
        return C.top_partners(self.cooc, self.pair_totals)

    @cached_property
    def corr_report(self) -> DataFrame:
        return language_correlation(self.repos)

    @cached_property
    def edges(self) -> DataFrame:
        return GR.graph_edges(self.repos)

    @cached_property
    def nodes(self) -> DataFrame:
        return GR.graph_nodes(self.repos, min_loc=self.graph_min_loc)

    @cached_property
    def geocode_replies(self) -> DataFrame:
        """Replies for every candidate location, landed as JSON text (a fixture)."""
        return self.bridge.geocode_replies(G.candidate_locations(self.regions))
