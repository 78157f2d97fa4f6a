"""Ranking tables: fingerprints, staleness, incremental re-ranking, comparison, selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import lexicons as L
from vacantia.functions.urls import web_link
from vacantia.operators import scoring_v2 as V2
from vacantia.operators.ordering import positions, top

SEPARATOR = chr(31)


def tier_order(tier: Column) -> Column:
    chain = None
    for name, rank in L.TIER_RANK.items():
        chain = F.when(tier == name, rank) if chain is None else chain.when(tier == name, rank)
    return chain.otherwise(0)


def _digest(parts: list[Column]) -> Column:
    """sha-256 of the parts in order; a null, empty, zero or false part counts as empty but keeps its place."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def job_fingerprint() -> Column:
    return _digest([F.col("career_track"), F.col("title"), F.col("description"), F.col("location"), F.col("workplace"), F.col("published_at").cast("string")])


def profile_fingerprint() -> Column:
    lists = ("years_options", "skills", "desired_titles", "preferred_locations", "preferred_work_modes", "keywords", "excluded_keywords")
    flag = lambda name: F.when(F.col(name), "True")
    years = F.when(F.col("years_experience") != 0, F.col("years_experience").cast("string"))
    return _digest([F.col("career_track"), years, *[F.array_join(name, "|") for name in lists], flag("work_authorization"), flag("needs_sponsorship")])


def stale_rankings(rankings: DataFrame, postings: DataFrame, profiles: DataFrame, config_version: int) -> DataFrame:
    """Why a posting x profile row must be ranked again; ``reason`` is null when the stored row still holds.

    Rows belong to (user, posting, engine).  Fingerprints are computed on each side before the joins, so no text is shuffled; the ones
    of now come with the result.
    """
    jobs = postings.select("job_id", "user_id", "career_track", job_fingerprint().alias("job_now"))
    people = profiles.select("user_id", "career_track", profile_fingerprint().alias("profile_now"))
    stored = rankings.filter("engine = 'v2'").select(
        "user_id", "job_id", F.lit(True).alias("known"), "stale", "error", "engine_version", "config_version", "job_fingerprint", "profile_fingerprint")
    rows = jobs.join(people, ["user_id", "career_track"]).join(stored, ["user_id", "job_id"], "left")
    reason = (
        F.when(F.col("known").isNull(), "missing").when(F.col("stale"), "stale").when(F.col("error") != "", "error")
        .when(F.col("engine_version") != V2.ENGINE_VERSION, "engine_version").when(F.col("config_version") != config_version, "config_version")
        .when(~F.col("profile_fingerprint").eqNullSafe(F.col("profile_now")), "profile").when(~F.col("job_fingerprint").eqNullSafe(F.col("job_now")), "job")
    )
    return rows.select("job_id", "user_id", "career_track", "job_now", "profile_now", reason.alias("reason"))


def rerank_incremental(rankings: DataFrame, postings: DataFrame, stale: DataFrame, rank: Callable[[DataFrame], DataFrame], now: Column, config_version: int) -> DataFrame:
    """The next version of the ranking table: only the stale rows of the second engine are ranked, all others stay as they are.

    One row per (user_id, job_id, engine), with versions, fingerprints and time of its evaluation, so that the result can be stored
    and given to :func:`stale_rankings` again, which then finds nothing but what changed since.  A posting that cannot be ranked
    stays as a row with an error.  ``reranked`` tells the new rows.
    """
    due = stale.filter("reason IS NOT NULL").select("user_id", "job_id", "job_now", "profile_now")
    todo = postings.join(due.select("user_id", "job_id"), ["user_id", "job_id"], "left_semi")
    ranked = rank(todo.filter("title IS NOT NULL")).select("user_id", "job_id", "score", "tier", F.lit("").alias("error"))
    broken = todo.filter("title IS NULL").select("user_id", "job_id", F.lit(0).alias("score"), F.lit("excluded").alias("tier"), F.lit("posting has no title").alias("error"))
    marks = ["engine_version", "config_version", "job_fingerprint", "profile_fingerprint", "evaluated_at", "stale"]
    fresh = ranked.unionByName(broken).join(due, ["user_id", "job_id"]).select(
        "user_id", "job_id", F.lit("v2").alias("engine"), "score", "tier", "error", F.lit(V2.ENGINE_VERSION).alias("engine_version"), F.lit(config_version).alias("config_version"),
        F.col("job_now").alias("job_fingerprint"), F.col("profile_now").alias("profile_fingerprint"), now.alias("evaluated_at"), F.lit(False).alias("stale"), F.lit(True).alias("reranked"))
    replaced = due.select("user_id", "job_id", F.lit("v2").alias("engine"))
    kept = rankings.join(replaced, ["user_id", "job_id", "engine"], "left_anti").select("user_id", "job_id", "engine", "score", "tier", "error", *marks, F.lit(False).alias("reranked"))
    return fresh.unionByName(kept)


def attach_ranking(jobs: DataFrame, rankings: DataFrame) -> DataFrame:
    """Jobs with the valid current ranking; its fields override those of the first engine."""
    valid = rankings.filter((F.col("engine") == "v2") & (F.col("engine_version") == V2.ENGINE_VERSION) & ~F.col("stale") & (F.col("error") == ""))
    valid = valid.select("job_id", F.col("score").alias("v2_score"), "tier", "eligibility_state")
    rows = jobs.join(valid, "job_id", "left")
    return rows.withColumns({"active_score": F.coalesce("v2_score", "score"), "active_engine": F.when(F.col("v2_score").isNotNull(), "v2").otherwise("v1")})


def ranking_summary(rankings: DataFrame, postings: DataFrame) -> DataFrame:
    total = postings.filter("is_active").groupBy("user_id").agg(F.count("*").alias("total"))
    valid = ~F.col("stale") & (F.col("error") == "")
    counts = rankings.groupBy("user_id").agg(
        F.count_if(valid).alias("evaluated"), F.count_if(~valid).alias("stale"), F.count_if(F.col("error") != "").alias("failed"),
        F.bround(F.avg(F.nullif(F.col("duration_ms"), F.lit(0.0))), 2).alias("average_ms"), F.max("evaluated_at").alias("last_evaluation"))
    rows = total.join(counts, "user_id", "full_outer").fillna(0, ["total", "evaluated", "stale", "failed", "average_ms"])
    return rows.withColumn("waiting", F.greatest(F.lit(0), F.col("total") - F.col("evaluated")))


def preview_stats(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Promoted, demoted, average change and the five largest absolute changes per group."""
    counts = deltas.groupBy(*keys).agg(
        F.count_if(F.expr("delta > 0")).alias("promoted"), F.count_if(F.expr("delta < 0")).alias("demoted"), F.bround(F.avg("delta"), 2).alias("average_delta"))
    largest = top(deltas.withColumn("change", F.abs("delta")), [F.col("change").desc(), F.col("job_id")], keys, 5)
    lists = largest.groupBy(*keys).agg(F.sort_array(F.collect_list("change"), asc=False).alias("largest"))
    return counts.join(lists, keys)


def readiness(rows: DataFrame) -> DataFrame:
    """Add ``missing``, ``warnings`` and ``ready`` for a posting joined with its profile (``adapter`` and ``resume_path`` known)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    fields = [F.when(blank(F.col(name)), F.lit(name)) for name in ("full_name", "email", "phone")]
    fields += [F.when(blank(F.col("resume_path")), F.lit("resume")), F.when(~web_link(F.col("apply_url")), F.lit("apply_url"))]
    rows = rows.withColumn("missing", F.array_compact(F.array(*fields)))
    warnings = [F.when(blank(F.col("linkedin_url")), "no_linkedin"), F.when(F.col("adapter") == "workday", "workday_account"),
                F.when(~F.col("auto_supported"), "no_automatic_submit"), F.lit("live_questions")]
    return rows.withColumns({"warnings": F.array_compact(F.array(*warnings)), "ready": (F.size("missing") == 0) & F.col("auto_supported")})


def campaign_select(candidates: DataFrame) -> DataFrame:
    """Outcome per campaign candidate: selected or the first skip reason.

    The cap counts ready candidates in score order, as positions in a distributed sort.
    """
    reason = (F.when(F.array_contains("blocked_companies", F.lower("company")), "blocked_company")
              .when(F.col("application_status").isin("submitted", "verification_pending", "applying", "queued"), "already_in_pipeline")
              .when(~F.col("ready"), "profile_incomplete"))
    rows = candidates.withColumns({
        "reason": reason, "limit": F.greatest(F.lit(0), F.least("daily_cap", F.coalesce(F.col("budget_cap") - F.col("spent"), F.col("daily_cap"))))})
    keys = ("campaign_id",)
    order = [F.col("score").desc(), F.col("published_at").desc_nulls_last(), F.col("discovered_at").desc(), F.col("job_id").desc()]
    ready = positions(rows.filter("reason IS NULL").select("campaign_id", "job_id", "score", "published_at", "discovered_at", "limit"), order, keys)
    decided = ready.select("campaign_id", "job_id", F.when(F.col("position") > F.col("limit"), "daily_or_budget_cap").otherwise("selected").alias("outcome"))
    return rows.filter("reason IS NOT NULL").select("campaign_id", "job_id", F.col("reason").alias("outcome")).union(decided)
