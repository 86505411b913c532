"""Cluster languages by the shape of their geographic footprint.

Points are sparse rows ``id, dim, x`` with whole numbers ``x`` -- never one row a
point -- and one marker row (dim -1, x 1) a point, so a point of zeros is one,
too.  Model parameters are tables, a row per dimension with a column per
cluster; a round is one join with them, one sum per point (its entries lie
together) and one aggregate per dimension.

The points are stored in buckets by id once, as many as their entries ask for, so a
round shuffles its sums by dimension and never the points.

All sums are of whole numbers: k-means centres are kept in thousandths and the
mixture's responsibilities in ten-thousandths.  So a result does not depend on
the partitioning or on the order of the rows, to the last bit, and the same
steps in another engine give the same clusters.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langatlas.session import scratch_path
from langatlas.sinks.files import Files

# Fixed defaults from the reference.
K = 6
KMEANS_ITERATIONS = 10
#: Rounds of the mixture.
MIXTURE_ITERATIONS = 10
#: Least variance of a component along a dimension (of points in 0..100).
MIN_VARIANCE = 1.0
MARK = -1
#: A centre's unit is 1/CENTRE_UNIT, a responsibility's 1/SHARE_UNIT.
CENTRE_UNIT = 1000
SHARE_UNIT = 10_000
#: Entries of points to a bucket, and so to a task of a round.
BUCKET_ENTRIES = 500_000


class Work:
    """Tables of a fit's rounds, in one folder that goes when the result is stored."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.tables = spark, scratch_path(spark, "fit"), 0
        self.bucketed: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        return self.observed(df)[0]

    def observed(self, df: DataFrame, *sums) -> tuple[DataFrame, dict]:
        """A table, and sums over its rows that the same pass observed."""
        self.tables += 1
        path, seen = f"{self.path}/{self.tables}", Observation()
        (df.observe(seen, *sums) if sums else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get if sums else {}

    def by_id(self, points: DataFrame) -> DataFrame:
        """The points in buckets by id, which joins with small tables, windows and
        sums by id read without a shuffle."""
        points, seen = self.observed(points, F.count(F.lit(1)).alias("n"))
        buckets = max(self.spark.sparkContext.defaultParallelism,
                      math.ceil(seen["n"] / BUCKET_ENTRIES))
        self.tables += 1
        name = f"points_{uuid.uuid4().hex}"
        (points.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id")
         .option("path", f"{self.path}/{self.tables}").saveAsTable(name, format="parquet"))
        self.bucketed.append(name)
        return self.spark.table(name)

    def clear(self) -> None:
        for name in self.bucketed:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.bucketed.clear()
        Files(self.spark).remove(self.path)


# ---------------------------------------------------------------- M1: vectors
def language_vectors(kept_bins: DataFrame, index: DataFrame, languages: DataFrame) -> DataFrame:
    """M1: ``lang, features`` -- a sparse vector of length = number of spots.

    Every language in ``languages`` gets a vector (all zero when no bin was
    kept).  A vector is stored as its parts (kind, size, indices, values): the
    entries are written like that and read as the vector type, without Python.
    """
    entries = kept_bins.where(F.col("value") != 0).groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct(F.col("bin").cast("int").alias("bin"),
                                             F.col("value").cast("double").alias("value"))))
        .alias("entries"))
    size = index.select(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    none = F.array().cast("array<struct<bin:int,value:double>>")
    rows = (languages.select("lang").distinct().join(entries, "lang", "left")
            .withColumn("entries", F.coalesce("entries", none))
            .select("lang", F.struct(
                F.lit(0).cast("tinyint").alias("type"), size.alias("size"),
                F.transform("entries", lambda e: e["bin"]).alias("indices"),
                F.transform("entries", lambda e: e["value"]).alias("values")).alias("features")))
    path = scratch_path(rows.sparkSession, "vectors")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("features", VectorUDT())])
    ).parquet(path)


def vectors_as_arrays(vectors: DataFrame) -> DataFrame:
    return vectors.select("lang", vector_to_array("features").alias("features"))


def vector_entries(vectors: DataFrame) -> DataFrame:
    """The vectors read back as rows ``lang, bin, value`` (zeros left out)."""
    return (vectors_as_arrays(vectors).select("lang", F.posexplode("features").alias("bin", "v"))
            .where("v <> 0").select("lang", F.col("bin").cast("bigint").alias("bin"),
                                    F.col("v").cast("bigint").alias("value")))


# ----------------------------------------------------------------- the points
def language_points(kept_bins: DataFrame, languages: DataFrame) -> DataFrame:
    """The same vectors as points."""
    entries = kept_bins.where(F.col("value") != 0).select(
        F.col("lang").alias("id"), F.col("bin").cast("bigint").alias("dim"),
        F.col("value").cast("bigint").alias("x"))
    return entries.unionByName(_marks(languages.select(F.col("lang").alias("id")).distinct()))


def dense_points(rows: DataFrame, id_col: str, values_col: str, unit: int) -> DataFrame:
    """Points of an array column: its numbers in ``1/unit``, rounded half up; a null
    number is 0.  Rows of one id add up."""
    ids = rows.select(F.col(id_col).alias("id"), F.col(values_col).alias("v"))
    entries = ids.select("id", F.posexplode("v").alias("dim", "v")).select(
        "id", F.col("dim").cast("bigint").alias("dim"),
        F.floor(F.col("v").cast("double") * unit + 0.5).cast("bigint").alias("x"))
    return entries.where("x <> 0").unionByName(_marks(ids.select("id").distinct()))


def _marks(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.lit(MARK).cast("bigint").alias("dim"),
                      F.lit(1).cast("bigint").alias("x"))


# ------------------------------------------------------------------ M2: k-means
# The expressions of a round are SQL text: one call a column, not one an operator.
def _each(template: str, k: int) -> list[str]:
    return [template.format(j=j) for j in range(k)]


def _seen(table: DataFrame, letter: str, k: int) -> list[Column]:
    """What is observed while a table of sums is written: the marker's row, and a
    fingerprint of all rows, by which a round that changes nothing is known."""
    return [*map(F.expr, _each(f"max(CASE WHEN dim = {MARK} THEN {letter}{{j}} END) AS "
                               f"{letter}{{j}}", k)),
            F.expr(f"bit_xor(xxhash64({', '.join(table.columns)})) AS print")]


def _mark_row(spark: SparkSession, values: dict, kind: str) -> DataFrame:
    """The marker's row as a local relation: its numbers are data of the plan, not
    part of the generated code, which the rounds so share."""
    said = {"inf": "Infinity", "-inf": "-Infinity"}
    cells = [f"CAST('{said.get(repr(v), repr(v))}' AS {kind}) AS {c}" for c, v in values.items()]
    return spark.sql(f"SELECT CAST({MARK} AS BIGINT) AS dim, {', '.join(cells)}")


def _sums(near: DataFrame, k: int) -> DataFrame:
    """Sums of the clusters (``id, dim, x, cluster``) by dimension, s0.. ; in the
    marker's row: how many points they have."""
    return near.groupBy("dim").agg(*map(F.expr, _each(
        "sum(CASE WHEN cluster = {j} THEN x ELSE 0 END) AS s{j}", k)))


def _centres(sums: DataFrame, counts: dict, k: int, before: DataFrame | None,
             work: Work) -> DataFrame:
    """``dim, c0..``: means in 1/CENTRE_UNIT, rounded half up; a cluster without
    points keeps the centre it had.  The marker's row has the squared lengths."""
    n = [counts[f"s{j}"] for j in range(k)]
    means = sums.where(f"dim <> {MARK}").selectExpr("dim", *(
        f"CAST(floor((s{j} * {2 * CENTRE_UNIT}L + {n[j]}L) / {2 * n[j]}L) AS BIGINT) AS c{j}"
        if n[j] else f"0L AS c{j}" for j in range(k)))
    if before is not None and not all(n):
        old = before.where(f"dim <> {MARK}").selectExpr("dim", *_each("c{j} AS old{j}", k))
        means = work.keep(means.join(old, "dim", "full_outer").selectExpr("dim", *(
            f"coalesce({'c' if n[j] else 'old'}{j}, 0L) AS c{j}" for j in range(k))))
    norms = means.selectExpr(*_each("coalesce(sum(c{j} * c{j}), 0L) AS c{j}", k)).first()
    return means.unionByName(_mark_row(sums.sparkSession, norms.asDict(), "BIGINT"))


def _over_points(entries: DataFrame, template: str, letter: str, k: int) -> DataFrame:
    """Sums over each point's entries, on every entry: entries are dealt by id once,
    and what follows needs no join with the points."""
    return entries.selectExpr("id", "dim", "x", *(
        f"sum({x}) OVER (PARTITION BY id) AS {letter}{j}"
        for j, x in enumerate(_each(template, k))))


def _nearest(points: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """``id, dim, x, cluster``: the nearest centre (ties: the lower number).  A
    point's own length is the same for all centres and left out."""
    far = _over_points(points.join(centres, "dim", "left"),
                       f"CASE WHEN dim = {MARK} THEN c{{j}} "
                       f"ELSE x * coalesce(c{{j}}, 0L) * {-2 * CENTRE_UNIT}L END", "f", k)
    pairs = ", ".join(_each("struct(f{j} AS far, {j} AS cluster)", k))
    return far.selectExpr("id", "dim", "x", f"array_min(array({pairs})).cluster AS cluster")


def _by_point(entries: DataFrame, column: str) -> DataFrame:
    return entries.where(f"dim = {MARK}").selectExpr("id", column)


def _seeds(points: DataFrame, k: int, work: Work) -> list:
    """Ids of the starting points: the longest one, then again and again the one
    that is farthest from those taken (ties: the smaller id); fewer than ``k`` if
    no other point differs."""
    farthest = F.min_by(F.struct("id", "far"), F.struct((-F.col("far")).alias("far"), "id"))
    squares = F.when(F.col("dim") == MARK, 0).otherwise(F.col("x") * F.col("x"))
    lengths = points.groupBy("id").agg(F.sum(squares).alias("own"))
    known, seen = work.observed(lengths.withColumn("far", F.col("own")), farthest.alias("next"))
    taken = []
    while seen["next"] is not None:
        taken.append(seen["next"]["id"])
        if len(taken) == k:
            break
        seed = F.lit(taken[-1])
        own = known.where(F.col("id") == seed).select("own").scalar()
        entries = points.where((F.col("id") == seed) & (F.col("dim") != MARK)).select(
            "dim", F.col("x").alias("y"))
        dots = points.join(entries, "dim").groupBy("id").agg(
            F.sum(F.col("x") * F.col("y")).alias("dot"))
        there = F.col("own") + own - 2 * F.coalesce("dot", F.lit(0))
        far = there if len(taken) == 1 else F.least("far", there)
        known, seen = work.observed(known.join(dots, "id", "left").select(
            "id", "own", far.alias("far")), farthest.alias("next"))
        if seen["next"]["far"] == 0:
            break
    return taken


def fit_kmeans(points: DataFrame, work: Work, k: int = K,
               max_iter: int = KMEANS_ITERATIONS) -> tuple[DataFrame, int] | None:
    """M2: Lloyd's rounds from the ``_seeds``, until nothing moves: the centres
    (``dim, c0..``, see ``_centres``) and how many there are.  No points: none."""
    seeds = _seeds(points, k, work)
    if not seeds:
        return None
    k, id_type = len(seeds), points.schema["id"].dataType
    number = F.array_position(F.array(*(F.lit(i).cast(id_type) for i in seeds)), F.col("id"))
    near = points.withColumn("cluster", (number - 1).cast("int")).where("cluster >= 0")
    centres, last = None, None
    for _ in range(max_iter + 1):            # the first round makes centres of the seeds
        sums = _sums(near, k)
        sums, seen = work.observed(sums, *_seen(sums, "s", k))
        if seen["print"] == last:
            break
        last, centres = seen["print"], _centres(sums, seen, k, centres, work)
        near = _nearest(points, centres, k)
    return centres, k


# ----------------------------------------------------------------- M3: mixture
def _moments(shares: DataFrame, k: int) -> DataFrame:
    """M step: one aggregate over the entries: first and second sums by dimension,
    s0.., q0..; the marker's row has the components' weights and the log
    likelihood at the parameters that the shares came from."""
    return shares.groupBy("dim").agg(*map(F.expr, [
        *_each("CAST(sum(CAST(r{j} * x AS DECIMAL(38,0))) AS DOUBLE) AS s{j}", k),
        *_each("CAST(sum(CAST(r{j} * x * x AS DECIMAL(38,0))) AS DOUBLE) AS q{j}", k),
        f"sum(CASE WHEN dim = {MARK} THEN ll END) AS ll"]))


def _parameters(moments: DataFrame, seen: dict, k: int, min_variance: float) -> DataFrame:
    """``dim, m0.., v0..``: means and variances; the marker's row has, as m0.., each
    component's log density of a point of zeros, its share included."""
    n = [seen[f"s{j}"] for j in range(k)]
    mean = [f"(s{j} / {n[j]!r}D)" if n[j] else "0D" for j in range(k)]
    rows = moments.where(f"dim <> {MARK}").selectExpr(
        "dim", *(f"{mean[j]} AS m{j}" for j in range(k)),
        *(f"greatest(q{j} / {n[j]!r}D - {mean[j]} * {mean[j]}, {min_variance!r}D) AS v{j}"
          if n[j] else f"{min_variance!r}D AS v{j}" for j in range(k)))
    zero = rows.selectExpr(*_each(
        f"coalesce(sum(ln(v{{j}} * {2 * math.pi!r}D) + m{{j}} * m{{j}} / v{{j}}), 0D) AS b{{j}}",
        k)).first()
    bases = {f"m{j}": math.log(n[j] / sum(n)) - 0.5 * zero[f"b{j}"] if n[j] else -math.inf
             for j in range(k)}
    return rows.unionByName(_mark_row(
        moments.sparkSession, bases | {v: 1.0 for v in _each("v{j}", k)}, "DOUBLE"))


def _shares(points: DataFrame, parameters: DataFrame, k: int) -> DataFrame:
    """E step: ``id, dim, x, r0.., ll``: responsibilities in 1/SHARE_UNIT and the
    point's log likelihood.  Only a point's own entries are joined: what its zeros
    weigh is in the marker's row."""
    logs = _over_points(
        points.join(parameters, "dim", "left"),
        f"CASE WHEN dim = {MARK} THEN m{{j}} "
        "ELSE coalesce((x * m{j} * 2D - x * x) / (v{j} * 2D), 0D) END", "l", k)
    top = f"array_max(array({', '.join(_each('l{j}', k))})) AS top"
    weighed = logs.selectExpr("*", top).selectExpr(
        "id", "dim", "x", "top", *_each("exp(l{j} - top) AS e{j}", k))
    total = "(" + " + ".join(_each("e{j}", k)) + ")"
    return weighed.selectExpr("id", "dim", "x", *(
        f"CAST(floor(e{j} / {total} * {SHARE_UNIT}D + 0.5D) AS BIGINT) AS r{j}"
        for j in range(k)), f"top + ln({total}) AS ll")


def fit_mixture(points: DataFrame, start: DataFrame, k: int, work: Work,
                max_iter: int = MIXTURE_ITERATIONS, min_variance: float = MIN_VARIANCE
                ) -> tuple[DataFrame, list[float]]:
    """M3: expectation-maximisation with diagonal covariances over the spots
    themselves, from the clusters ``start`` (``id, dim, x, cluster``), until no share
    changes: the parameters (see ``_parameters``) and the log likelihood that each
    round began with."""
    shares = start.selectExpr("id", "dim", "x", *_each(
        f"CASE WHEN cluster = {{j}} THEN {SHARE_UNIT}L ELSE 0L END AS r{{j}}", k), "0D AS ll")
    parameters, likelihoods, last = None, [], None
    for _ in range(max_iter + 1):            # the first round is that of the clusters
        moments = _moments(shares, k)
        moments, seen = work.observed(moments, *_seen(moments.drop("ll"), "s", k),
                                      F.max("ll").alias("ll"))
        if parameters is not None:
            likelihoods.append(seen["ll"])
        if seen["print"] == last:
            break
        last, parameters = seen["print"], _parameters(moments, seen, k, min_variance)
        shares = _shares(points, parameters, k)
    return parameters, likelihoods


def _likeliest(shares: DataFrame, k: int) -> DataFrame:
    pairs = ", ".join(_each("struct(r{j} AS r, -{j} AS j)", k))
    return _by_point(shares, f"-(array_max(array({pairs})).j) AS cluster")


# ------------------------------------------------------- M4, M5, E14: results
@dataclass
class Clusters:
    """``assigned``: id, kmeans, gmm; ``centres``: model, cluster, dim, value (zeros
    left out).  Clusters are numbered by their smallest members; those without
    members come last."""

    assigned: DataFrame
    centres: DataFrame
    log_likelihoods: list[float] | None = None


def _numbering(assigned: DataFrame, k: int) -> list[int]:
    """New number of each cluster (k rows come to the driver)."""
    least = {r["cluster"]: r["least"] for r in assigned.groupBy("cluster").agg(
        F.min("id").alias("least")).collect()}
    order = sorted(range(k), key=lambda j: (j not in least, least.get(j, 0) if j in least else j))
    return [order.index(j) for j in range(k)]


def _relabelled(assigned: DataFrame, numbers: list[int], name: str) -> DataFrame:
    table = F.array(*(F.lit(n) for n in numbers))
    return assigned.select("id", F.get(table, F.col("cluster")).alias(name))


def _long(wide: DataFrame, letter: str, numbers: list[int], model: str, unit: float) -> DataFrame:
    cells = ", ".join(f"struct({n} AS cluster, {letter}{j} / {unit!r}D AS value)"
                      for j, n in enumerate(numbers))
    return (wide.where(f"dim <> {MARK}").selectExpr("dim", f"explode(array({cells})) AS c")
            .selectExpr(f"'{model}' AS model", "c.cluster", "dim", "c.value").where("value <> 0"))


def find_clusters(points: DataFrame, k: int = K, max_iter: int = KMEANS_ITERATIONS,
                  mixture_iter: int = MIXTURE_ITERATIONS,
                  min_variance: float = MIN_VARIANCE, work: Work | None = None) -> Clusters:
    """M2-M5: fit both models to the points and assign every point (D8j: its id stays
    in the row).  The result reads tables of ``work``: store it before they go.  No
    points give empty tables; fewer than ``k`` different points as many clusters."""
    spark = points.sparkSession
    work = work or Work(spark)
    id_type = points.schema["id"].dataType
    # By id: a point's entries are summed where they are read.
    points = work.by_id(points)
    found = fit_kmeans(points, work, k, max_iter)
    if found is None:
        return Clusters(
            spark.createDataFrame([], T.StructType([
                T.StructField("id", id_type), T.StructField("kmeans", T.IntegerType()),
                T.StructField("gmm", T.IntegerType())])),
            spark.createDataFrame([], "model string, cluster int, dim bigint, value double"), [])
    centres, k = found
    parameters, likelihoods = fit_mixture(points, _nearest(points, centres, k), k, work,
                                          mixture_iter, min_variance)
    near = work.keep(_by_point(_nearest(points, centres, k), "cluster"))
    likely = work.keep(_likeliest(_shares(points, parameters, k), k))
    by_mean, by_share = _numbering(near, k), _numbering(likely, k)
    assigned = _relabelled(near, by_mean, "kmeans").join(
        _relabelled(likely, by_share, "gmm"), "id")
    return Clusters(assigned, _long(centres, "c", by_mean, "kmeans", CENTRE_UNIT).unionByName(
        _long(parameters, "m", by_share, "gmm", 1.0)), likelihoods)


def cluster_members(assigned: DataFrame) -> DataFrame:
    """Per model and cluster the sorted member ids (bounded by the number of
    languages)."""
    long = assigned.unpivot("id", ["kmeans", "gmm"], "model", "cluster")
    return (long.groupBy("model", "cluster")
            .agg(F.sort_array(F.collect_list("id")).alias("members")))
