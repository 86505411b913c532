"""Registered queries that write and read back (sinks, JSON source, streams)
and the clustering queries.  Their end state is a plain query over the given
tables, which the SQL oracle states.

Each run writes under a fresh path of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from langatlas.operators import clusters as CL
from langatlas.operators import correlation as C
from langatlas.operators import distribution as D
from langatlas.operators import geo as G
from langatlas.operators.geo import GEO_COLUMNS
from langatlas.plans.registry import _w, query, r6
from langatlas.session import scratch_path
from langatlas.sinks.catalogue import Catalogue
from langatlas.sinks.writers import geo_table, overwrite_stage, write_dist_json
from langatlas.sources.bridge import SOURCES, Bridge
from langatlas.plans.pipelines import cluster_languages
from langatlas.sources.dist_json import location_entries, read_dist_json
from langatlas.sources.tables import table_path
from langatlas.streaming.aggregates import Aggregates
from langatlas.streaming.geo_fill import run_geo_fill
from langatlas.streaming.ingest import ingested, run_ingest


@query
def sink_json(spark, sf_dir):
    """B5 + A1: the density export written as JSON lines and read back: every
    entry of ``lang.value``."""
    path = scratch_path(spark, "dist-json")
    write_dist_json(_w(spark, sf_dir).dist, path)
    return location_entries(read_dist_json(spark, path, view=None))


@query
def scan_dist(spark, sf_dir):
    """A1 + C13: the export read with its schema and queried through SQL."""
    path = scratch_path(spark, "dist-scan")
    write_dist_json(_w(spark, sf_dir).dist, path)
    read_dist_json(spark, path, view="dists")
    return spark.sql("""
        WITH triples AS (SELECT lang._id AS lang, explode(coords) AS c FROM dists)
        SELECT lang, c[0] AS lat, c[1] AS lng, CAST(c[2] AS BIGINT) AS density FROM triples
        UNION ALL
        SELECT DISTINCT d.lang._id, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT)
        FROM dists d LEFT ANTI JOIN triples t ON d.lang._id = t.lang""")


@query
def listed_languages_export(spark, sf_dir):
    """C16 over the export, as the page does it."""
    path = scratch_path(spark, "dist-listed")
    write_dist_json(_w(spark, sf_dir).dist, path)
    return D.listed_languages_export(read_dist_json(spark, path, view=None))


@query
def sink_overwrite(spark, sf_dir):
    """B1 + P6: the E1 result replaces a stage twice (idempotent), and a stage of
    the catalogue that is made from it is found again instead of recomputed."""
    w = _w(spark, sf_dir)
    path = scratch_path(spark, "distLangByRegion")
    overwrite_stage(w.lang_region, path)
    replaced = overwrite_stage(w.lang_region, path)
    stages = Catalogue(spark)
    stages.stage("distLangByRegion", [path], lambda: replaced)
    return stages.stage("distLangByRegion", [path], lambda: replaced)


@query
def incremental_ingest(spark, sf_dir):
    """S1 + B2 + P5: events land as files in three deliveries (the third one
    re-sends records already landed); two ``availableNow`` runs ingest them
    with the stream checkpoint as cursor and duplicates dropped by key."""
    events = Bridge(spark, sf_dir).table("events")
    landing = scratch_path(spark, "landing")
    target = scratch_path(spark, "events")
    ckpt = scratch_path(spark, "events-ckpt")
    cut = events.select(F.percentile_approx("event_id", 0.5)).first()[0]   # once, not per delivery
    first = events.where(F.col("event_id") <= cut)
    second = events.where(F.col("event_id") > cut)
    first.write.parquet(f"{landing}/delivery=1")
    run_ingest(spark, events.schema, f"{landing}/*", target, ckpt, key="event_id",
               files_per_batch=4)
    second.write.parquet(f"{landing}/delivery=2")
    # re-delivery of records already landed
    first.where(F.col("event_id") > cut - 100).write.parquet(f"{landing}/delivery=3")
    run_ingest(spark, events.schema, f"{landing}/*", target, ckpt, key="event_id",
               files_per_batch=4)
    return ingested(spark, target)


def _kept_up(spark, sf_dir, *tables):
    """Stored aggregates after three batches of repositories, the second of
    which is delivered again."""
    repos = _w(spark, sf_dir).repos
    kept = Aggregates(spark, scratch_path(spark, "aggregates"))
    parts = [repos.where(F.pmod(F.xxhash64("id"), F.lit(3)) == n) for n in range(3)]
    for batch, part in ((0, parts[0]), (1, parts[1]), (1, parts[1]), (2, parts[2])):
        kept.add(part, batch, tables=tables)
    return kept


@query
def lang_region_kept_up(spark, sf_dir):
    """E1 from the stored aggregates (same rows as ``lang_region_loc``)."""
    return _kept_up(spark, sf_dir, "regions").lang_region_loc()


@query
def correlation_kept_up(spark, sf_dir):
    """E3 from the stored aggregates: every pair with the totals of its base."""
    kept = _kept_up(spark, sf_dir, "pairs", "totals")
    totals = kept.lang_pair_totals().withColumnRenamed("lang", "base")
    return kept.lang_cooccurrence().join(totals, "base")


@query
def graph_edges_kept_up(spark, sf_dir):
    """E4 from the stored aggregates (the mean of weights in 1/WEIGHT_UNIT)."""
    return _kept_up(spark, sf_dir, "edges").graph_edges().select("src", "dst", "n", "loc", r6("weight"))


@query
def cluster_vectors(spark, sf_dir):
    """M1, read back from the vectors."""
    w = _w(spark, sf_dir)
    langs = w.coords.select("lang").distinct()
    return CL.vector_entries(CL.language_vectors(w.energy, w.bins_index, langs))


def _stored(spark, name, paths, fit):
    """The model store: a fit's result is a stage of its input, made once and read
    by every query; the fit's own tables go when it is stored."""
    def build(folder):
        work = CL.Work(spark)
        found = fit(work)
        found.assigned.write.parquet(f"{folder}/assigned")
        found.centres.write.parquet(f"{folder}/centres")
        work.clear()

    folder = Catalogue(spark).folder(name, paths, build, k=CL.K, rounds=CL.KMEANS_ITERATIONS,
                                     mixture_rounds=CL.MIXTURE_ITERATIONS)
    return CL.Clusters(spark.read.parquet(f"{folder}/assigned"),
                       spark.read.parquet(f"{folder}/centres"))


def fit_clusters(spark, sf_dir):
    """The export is written, read back and clustered."""
    def fit(work):
        path = scratch_path(spark, "dist-clusters")
        write_dist_json(_w(spark, sf_dir).dist, path)
        return cluster_languages(read_dist_json(spark, path, view=None), work=work)

    paths = [table_path(sf_dir, t) for t in (*SOURCES, "region")]
    return _stored(spark, "language-clusters", paths, fit)


def fit_embeddings(spark, sf_dir):
    def fit(work):
        rows = Bridge(spark, sf_dir).table("embeddings", "vec_id", "embedding")
        return CL.find_clusters(CL.dense_points(rows, "vec_id", "embedding", unit=1000),
                                work=work)

    return _stored(spark, "embedding-clusters", [table_path(sf_dir, "embeddings")], fit)


def _assignments(spark, sf_dir):
    return fit_clusters(spark, sf_dir).assigned.withColumnRenamed("id", "lang")


def _members(spark, sf_dir):
    members = CL.cluster_members(fit_clusters(spark, sf_dir).assigned)
    return members.select("model", "cluster", F.size("members").cast("bigint").alias("n"),
                          F.array_join("members", "|").alias("langs"))


def _center_rows(spark, sf_dir):
    return fit_clusters(spark, sf_dir).centres.select(
        "model", "cluster", F.col("dim").alias("bin"), r6("value"))


@query
def cluster_assign(spark, sf_dir):
    """M2-M4, D8j: both models' cluster of every language."""
    return _assignments(spark, sf_dir)


@query
def cluster_members(spark, sf_dir):
    """The member languages of every cluster of both models."""
    return _members(spark, sf_dir)


@query
def cluster_centers(spark, sf_dir):
    """M5: the centres of both models over the spots (zeros left out)."""
    return _center_rows(spark, sf_dir)


@query
def cluster_assignments(spark, sf_dir):
    """The same rows as ``cluster_assign``."""
    return _assignments(spark, sf_dir)


@query
def cluster_member_lists(spark, sf_dir):
    """The same rows as ``cluster_members``."""
    return _members(spark, sf_dir)


@query
def cluster_center_vectors(spark, sf_dir):
    """The same rows as ``cluster_centers``."""
    return _center_rows(spark, sf_dir)


@query
def geo_fill_stream(spark, sf_dir):
    """Replies for the pending locations arrive in two deliveries and are put
    into the location table by two ``availableNow`` runs; the result is its newest
    version (same rows as ``geo_upsert``)."""
    w = _w(spark, sf_dir)
    known = w.known_geo.select(*GEO_COLUMNS)
    place, replies, ckpt = (scratch_path(spark, n) for n in ("geo-table", "replies", "geo-ckpt"))
    table = geo_table(spark, place)
    table.update(lambda _: known)
    pending = G.pending_locations(w.regions, known)
    todo = w.geocode_replies.join(pending, "location", "left_semi")
    first = todo.where(F.col("location") < "M")
    first.write.parquet(f"{replies}/delivery=1")
    run_geo_fill(spark, f"{replies}/*", table, ckpt)
    todo.where(F.col("location") >= "M").write.parquet(f"{replies}/delivery=2")
    first.write.parquet(f"{replies}/delivery=3")          # a re-delivery: skipped
    run_geo_fill(spark, f"{replies}/*", table, ckpt)
    return table.read()


@query
def corr_json(spark, sf_dir):
    """The correlation export (``top`` as a JSON string per language), parsed."""
    export = C.correlation_json(_w(spark, sf_dir).corr_report)
    top = F.from_json("top", "array<struct<lang:string,occ:double>>")
    return (export.select("lang", "pair_count", "repo_count", F.posexplode(top).alias("i", "e"))
            .select("lang", "pair_count", "repo_count", (F.col("i") + 1).cast("bigint").alias("rank"),
                    F.col("e.lang").alias("partner"), r6("e.occ", "occ")))


@query
def embedding_assignments(spark, sf_dir):
    """M2-M4 on the embeddings table: both models' cluster of every vector."""
    return fit_embeddings(spark, sf_dir).assigned.withColumnRenamed("id", "vec_id")


@query
def embedding_clusters(spark, sf_dir):
    """M2-M5 on the embeddings table: how many vectors each cluster has, and the sum
    of its centre's numbers."""
    found = fit_embeddings(spark, sf_dir)
    sizes = found.assigned.unpivot("id", ["kmeans", "gmm"], "model", "cluster").groupBy(
        "model", "cluster").agg(F.count(F.lit(1)).alias("n"))
    sums = found.centres.groupBy("model", "cluster").agg(
        F.sum(F.col("value").cast("decimal(20,3)")).cast("double").alias("total"))
    return sizes.join(sums, ["model", "cluster"], "left").select(
        "model", "cluster", "n", r6("total"))
