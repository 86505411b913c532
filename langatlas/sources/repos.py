"""Landed harvest records: cursor, paging and enrichment into D1 repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langatlas.functions.locations import normalize_location

# Page size of the code host's repository listing (fixed value).
PAGE_SIZE = 100


def missing_owner() -> F.Column:
    """Profile recorded when the owner's profile could not be fetched."""
    return F.struct(
        F.lit(None).cast("string").alias("login"),
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("name"),
        F.lit("").alias("location"),
        F.lit(0).cast("bigint").alias("repos"),
        F.lit(0).cast("bigint").alias("followers"),
    )


def resume_cursor(landed: DataFrame, id_col: str = "id", seq_col: str = "_id") -> DataFrame:
    """A4 + F7: ``id`` of the most recently stored record, 0 when empty.
    One row; ``max_by`` is combined per task before the single final row."""
    return landed.agg(F.coalesce(F.max_by(id_col, seq_col), F.lit(0)).cast("bigint")
                      .alias("cursor"))


def repos_since(source: DataFrame, since: F.Column | int | None,
                page_size: int = PAGE_SIZE, id_col: str = "id") -> DataFrame:
    """A5: the next page of records after ``since`` (no filter when falsy).
    A page is the feature: ordered by id, ``page_size`` rows (TakeOrdered)."""
    df = source
    if isinstance(since, F.Column):
        # decided per run: a 0 / missing cursor means "from the start"
        df = df.where((F.coalesce(since, F.lit(0)) == 0) | (F.col(id_col) > since))
    elif since:
        df = df.where(F.col(id_col) > F.lit(since))
    return df.orderBy(id_col).limit(page_size)


def user_profiles(users_raw: DataFrame) -> DataFrame:
    """A7 projection: ``public_repos`` -> ``repos``; location markers normalised."""
    return users_raw.select(
        "login", "type", "name", normalize_location("location").alias("location"),
        F.col("public_repos").cast("bigint").alias("repos"),
        F.col("followers").cast("bigint").alias("followers"))


def nest_languages(langs_raw: DataFrame) -> DataFrame:
    """``repo_id, ordinal, lang, loc`` -> ``repo_id, langs`` in key order.
    The list per repository is bounded by that repository's languages."""
    per_repo = langs_raw.groupBy("repo_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "lang", "loc"))).alias("_l"))
    return per_repo.select(
        "repo_id",
        F.transform("_l", lambda x: F.struct(x["lang"].alias("lang"),
                                             x["loc"].alias("loc"))).alias("langs"))


def enrich_repos(repos_raw: DataFrame, users_raw: DataFrame, langs_raw: DataFrame) -> DataFrame:
    """A6 + A7 + D6j: repository ⋈ owner profile ⋈ language list -> D1.

    Two left joins (the reference issues two requests per repository).  No
    broadcast hints: AQE picks broadcast for a measured-small side and splits
    a skewed owner key (one owner with a third of all repositories) in the
    shuffle join otherwise.
    """
    fields = ("login", "type", "name", "location", "repos", "followers")
    users = user_profiles(users_raw).select(*[F.col(c).alias(f"_u_{c}") for c in fields],
                                            F.lit(True).alias("_u_found"))
    langs = nest_languages(langs_raw)
    owner = F.when(F.col("_u_found").isNull(), missing_owner()).otherwise(
        F.struct(*[F.col(f"_u_{c}").alias(c) for c in fields]))
    return (repos_raw
            .join(langs, repos_raw.id == langs.repo_id, "left")
            .join(users, repos_raw.owner_login == users._u_login, "left")
            .select("id", "name", owner.alias("owner"),
                    F.coalesce("langs", F.array().cast("array<struct<lang:string,loc:bigint>>"))
                    .alias("langs")))


def load_repos(repos: DataFrame) -> DataFrame:
    """C5 + Q11 at load, for D1 repositories that did not come through the
    bridge: API error texts (``message``) are dropped from the language list, and
    the owner location texts ``null`` and ``undefined`` are missing locations."""
    named = F.filter("langs", lambda x: x["lang"].isNotNull() & (x["lang"] != "message"))
    place = F.col("owner.location")
    missing = F.lower(F.trim(place)).isin("null", "undefined")
    return repos.withColumn("langs", named).withColumn(
        "owner", F.when(missing, F.col("owner").withField("location", F.lit(None).cast("string")))
        .otherwise(F.col("owner")))
