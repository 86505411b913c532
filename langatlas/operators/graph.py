"""Weighted language graph: primary language -> every other language of a repo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langatlas.operators.distribution import repo_total

# Fixed default from the reference: nodes drawn only above this many LoC.
MIN_NODE_LOC = 5e5


def primary_language(langs: str = "langs", mode: str = "max") -> F.Column:
    """the repository's primary language entry (struct<lang, loc>), in-row.

    ``mode="max"`` (intent): largest LoC, the earlier entry wins ties.
    ``mode="first"`` (literal reference behaviour): the first entry.
    """
    if mode == "first":
        return F.get(F.col(langs), 0)
    if mode != "max":
        raise ValueError(f"unknown primary mode {mode!r}")
    ranked = F.transform(langs, lambda x, i: F.struct(
        x["loc"].alias("loc"), (-i).alias("neg_pos"), x["lang"].alias("lang")))
    best = F.array_max(ranked)
    return F.when(F.size(langs) > 0, F.struct(best["lang"].alias("lang"),
                                              best["loc"].alias("loc")))


def primary_of(repos: DataFrame, mode: str = "max") -> F.Column:
    """The primary entry: the stored ``primary_<mode>`` column when the table
    carries it (computed once when landed, so later plans stay in generated
    code), else computed in-row."""
    stored = f"primary_{mode}"
    return F.col(stored) if stored in repos.columns else primary_language(mode=mode)


def primary_languages(repos: DataFrame) -> DataFrame:
    """Both readings of F4 for every repository that has languages."""
    return (repos.where(F.size("langs") > 0)
            .select(F.col("id").alias("repo_id"),
                    primary_of(repos, "max").alias("p"),
                    primary_of(repos, "first").alias("f"))
            .select("repo_id", F.col("p.lang").alias("primary_lang"),
                    F.col("p.loc").alias("primary_loc"),
                    F.col("f.lang").alias("first_lang"), F.col("f.loc").alias("first_loc")))


def _primary_rows(repos: DataFrame, primary: str) -> DataFrame:
    """Per repository: ``id, tot, p`` (primary entry) and ``others`` -- the
    neighbour entries (every other named language)."""
    base = (repos.where(F.size("langs") > 0)
            .select("id", "langs", repo_total(repos).alias("tot"),
                    primary_of(repos, primary).alias("p"))
            .where(F.col("p.lang").isNotNull()))
    others = F.filter("langs", lambda x: (x["lang"] != F.col("p.lang")) & x["lang"].isNotNull()
                      & (x["lang"] != ""))
    return base.select("id", "tot", "p", others.alias("others"))


def graph_emissions(repos: DataFrame, primary: str = "max") -> DataFrame:
    """D5j: one row per (repository, neighbour): ``repo, src, src_loc, dst, w`` with
    ``w = neighbour LoC / repository LoC``.  Star join inside the row: the
    list is exploded and the primary's own entry dropped."""
    base = (repos.where(F.size("langs") > 0)
            .select("id", "langs", repo_total(repos).alias("tot"),
                    primary_of(repos, primary).alias("p"))
            .where(F.col("p.lang").isNotNull()))
    return (base.select("id", "tot", "p", F.explode("langs").alias("a"))
            .where((F.col("a.lang") != F.col("p.lang")) & (F.col("a.lang") != ""))
            .select(F.col("id").alias("repo"), F.col("p.lang").alias("src"), F.col("p.loc").alias("src_loc"),
                    F.col("a.lang").alias("dst"),
                    F.try_divide(F.col("a.loc").cast("double"), F.col("tot")).alias("w")))


def graph_edges(repos: DataFrame, primary: str = "max") -> DataFrame:
    """E4 + E5 + E11: per edge the repository count, the primary's LoC summed
    per emission, and mean / sum / population spread of the weights.

    The reference keeps every weight in a list and averages it on the page;
    a list per edge grows with the data, so only its moments are kept.
    """
    return (graph_emissions(repos, primary).groupBy("src", "dst")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum("src_loc").cast("bigint").alias("loc"),
                 F.avg("w").alias("weight"),
                 F.sum("w").alias("sum_w"),
                 F.coalesce(F.stddev_pop("w"), F.lit(0.0)).alias("std_w")))


def graph_nodes(repos: DataFrame, primary: str = "max", min_loc: float = MIN_NODE_LOC) -> DataFrame:
    """E4 node value + C17: ``loc`` counts the primary once per neighbour edge
    (reference parity), ``loc_repo`` once per repository; kept above ``min_loc``.
    Repositories without a neighbour contribute nothing (as in the reference).
    The neighbour count is taken in-row, so only one aggregate shuffle."""
    rows = (_primary_rows(repos, primary)
            .select(F.col("p.lang").alias("lang"), F.col("p.loc").alias("src_loc"),
                    F.size("others").alias("k"))
            .where(F.col("k") > 0))
    return (rows.groupBy("lang")
            .agg(F.sum(F.col("src_loc") * F.col("k")).cast("bigint").alias("loc"),
                 F.sum("src_loc").cast("bigint").alias("loc_repo"),
                 F.count(F.lit(1)).alias("n_repos"))
            .where(F.col("loc") > min_loc))


def graph_node_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Drawn primaries plus the neighbours their edges reach."""
    prim = nodes.select("lang", F.lit(True).alias("is_primary"))
    reach = (edges.join(nodes.select(F.col("lang").alias("src")), "src", "left_semi")
             .select(F.col("dst").alias("lang"), F.lit(False).alias("is_primary")))
    return (prim.unionByName(reach).groupBy("lang")
            .agg(F.max("is_primary").alias("is_primary")))
