"""Which languages share repositories (co-occurrence, top partners, report)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed defaults from the reference.
TOP_PARTNERS = 3
TOP_LANGUAGES = 35
MIN_DISPLAY_OCC = 1e-4


def language_pairs(repos: DataFrame) -> DataFrame:
    """D4j: ordered pairs (base, other), base != other, one row per repository
    and pair.  Built inside each row (the repository's list exploded twice,
    then the diagonal dropped), so the self join costs no shuffle and stays in
    generated code; repositories with a single language yield nothing (C3)."""
    multi = repos.where(F.size("langs") > 1).select("id", "langs")
    return (multi.select("id", "langs", F.explode("langs").alias("a"))
            .select("id", F.col("a.lang").alias("base"), F.explode("langs").alias("b"))
            .where(F.col("b.lang") != F.col("base"))
            .select("id", "base", F.col("b.lang").alias("other")))


def lang_cooccurrence(repos: DataFrame) -> DataFrame:
    """Number of repositories containing both ``base`` and ``other``.

    Counted once per unordered pair (half the rows to shuffle), combined
    map-side, and mirrored after the aggregate, so a language present in a
    third of all repositories costs one partial row per task and partner.
    """
    counted = (language_pairs(repos).where(F.col("base") < F.col("other"))
               .groupBy("base", "other").agg(F.count(F.lit(1)).alias("n")))
    both = F.array(F.struct(F.col("base").alias("base"), F.col("other").alias("other")),
                   F.struct(F.col("other").alias("base"), F.col("base").alias("other")))
    return (counted.select(F.explode(both).alias("p"), "n")
            .select("p.base", "p.other", "n"))


def lang_pair_totals(repos: DataFrame) -> DataFrame:
    """E3 base entry: ``pair_count`` = number of ordered pairs the language
    starts (Σ(size-1) over its multi-language repositories -- the reference's
    "numRepos") and the true ``repo_count``."""
    multi = repos.where(F.size("langs") > 1).select(
        (F.size("langs") - 1).alias("others"), F.explode("langs").alias("l"))
    return (multi.groupBy(F.col("l.lang").alias("lang"))
            .agg(F.sum("others").cast("bigint").alias("pair_count"),
                 F.count(F.lit(1)).alias("repo_count")))


def top_partners(cooc: DataFrame, totals: DataFrame, k: int = TOP_PARTNERS,
                 include_self: bool = True) -> DataFrame:
    """E10 + F2 + C22: the ``k`` partners with the highest share
    ``occ = n / pair_count``, where ``pair_count`` (the reference's base
    occurrence) is the number of ordered pairs the base starts.

    The base itself is a candidate with share 1, which no other partner can
    exceed, and it wins ties: it is always rank 1.  The others are ranked inside
    a base by ``n desc, other`` -- the share order -- before the totals are
    joined, so each task keeps only its best ``k`` per base for the shuffle.
    """
    shift = 1 if include_self else 0
    ordered = Window.partitionBy("base").orderBy(F.col("n").desc(), F.col("other").asc())
    ranked = (cooc.where(F.col("n") != 0).withColumn("rn", F.row_number().over(ordered))
              .where(F.col("rn") <= k - shift))
    t = totals.where("pair_count <> 0").select("lang", F.col("pair_count").cast("double").alias("c"))
    others = ranked.join(t, F.col("base") == F.col("lang")).select(
        "lang", (F.col("rn") + shift).cast("bigint").alias("rank"), F.col("other").alias("partner"),
        (F.col("n") / F.col("c")).alias("occ"))
    if not include_self:
        return others
    return t.select("lang", F.lit(1).cast("bigint").alias("rank"), F.col("lang").alias("partner"),
                    F.lit(1.0).alias("occ")).union(others)


def top_languages(totals: DataFrame, k: int = TOP_LANGUAGES) -> DataFrame:
    """the ``k`` languages with most pairs (ties by name).  A top-k report:
    planned as TakeOrderedAndProject (k rows per task, then k overall)."""
    return totals.orderBy(F.col("pair_count").desc(), F.col("lang").asc()).limit(k)


def correlation_report(repos: DataFrame, top_langs: int = TOP_LANGUAGES,
                       top_k: int = TOP_PARTNERS) -> DataFrame:
    """Top languages with their top partners, long form."""
    totals = lang_pair_totals(repos)
    best = top_languages(totals, top_langs)
    return report_of(best, lang_cooccurrence(repos), top_k)


def report_of(best: DataFrame, cooc: DataFrame, top_k: int = TOP_PARTNERS) -> DataFrame:
    """The report of the languages ``best`` (``lang, pair_count, repo_count``):
    pairs of other bases are dropped before they are ranked."""
    own = cooc.join(best.select(F.col("lang").alias("base")), "base", "left_semi")
    return best.join(top_partners(own, best, top_k), "lang").select(
        "lang", "pair_count", "repo_count", "rank", "partner", "occ")


def lazy_percent(occ: F.Column | str) -> F.Column:
    """Q8: share as a percentage truncated (not rounded) to two decimals."""
    occ = F.col(occ) if isinstance(occ, str) else occ
    return F.format_string("%.2f %%", F.floor(occ * 10000) / 100)


def correlation_display(report: DataFrame, min_occ: float = MIN_DISPLAY_OCC) -> DataFrame:
    """C18 + lazyRound: partners shown on the page with their percentage text."""
    return (report.where(F.col("occ") > min_occ)
            .select("lang", "rank", "partner", lazy_percent("occ").alias("pct")))


def correlation_json(report: DataFrame) -> DataFrame:
    """D6a export: one row per language with ``top`` as a JSON string."""
    return (report.groupBy("lang", "pair_count", "repo_count")
            .agg(F.to_json(F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "partner", "occ"))),
                lambda x: F.struct(x["partner"].alias("lang"), x["occ"].alias("occ"))))
                .alias("top")))
