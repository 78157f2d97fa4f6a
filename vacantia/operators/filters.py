"""Filters over the catalogue, sources and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import lexicons as L
from vacantia.functions.dates import days_before
from vacantia.functions.locations import in_region
from vacantia.operators.pairs import exclusion_reason, prepare_profiles
from vacantia.functions import features as X

HISTORY_DAYS = 30


def filter_region(postings: DataFrame) -> DataFrame:
    return postings.filter(in_region(F.col("location")))


def with_exclusion(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``exclusion``: why the profile of the posting's user and track excludes the title, or null."""
    wanted = prepare_profiles(profiles).select("user_id", "career_track", "excluded_levels", "excluded_terms")
    rows = postings.join(wanted, ["user_id", "career_track"], "left")
    reason = exclusion_reason(X.detected_levels(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("title", F.lit(""))),
                              F.col("excluded_levels"), F.col("excluded_terms"))
    return rows.withColumn("exclusion", reason).drop("excluded_levels", "excluded_terms")


def jobs_search(postings: DataFrame, track: str, min_score: int = 0, status: str | None = None, text: str | None = None,
                active_only: bool = True) -> DataFrame:
    rows = postings.filter((F.col("career_track") == track) & (F.col("score") >= min_score))
    if active_only:
        rows = rows.filter("is_active")
    if status:
        rows = rows.filter(F.col("status") == status)
    if text:
        pattern = f"%{text}%"
        rows = rows.filter(F.col("title").ilike(pattern) | F.col("company").ilike(pattern) | F.col("description").ilike(pattern))
    return rows


def scoped(rows: DataFrame, user, column: str = "user_id") -> DataFrame:
    """Rows of one tenant."""
    return rows.filter(F.col(column) == user)


def assert_tenant(rows: DataFrame, user, column: str = "user_id") -> DataFrame:
    """Write guard: fails when a row belongs to another tenant."""
    foreign = rows.filter(~F.col(column).eqNullSafe(F.lit(user))).limit(1).count()
    if foreign:
        raise PermissionError(f"rows of another {column} than {user} cannot be written")
    return rows


def source_eligible(sources: DataFrame, track: str, now: Column, ids=None) -> DataFrame:
    rows = sources.filter(F.col("enabled") & (F.col("kind") != "demo") & (F.col("career_track") == track)
                          & (F.col("disabled_until").isNull() | (F.col("disabled_until") <= now)))
    return rows.filter(F.col("source_id").isin(list(ids))) if ids else rows


def submitted_history(status: str = "application_status", submitted_at: str = "submitted_at") -> Column:
    """A real submission: a submission date or a status only submissions reach."""
    return F.coalesce(F.col(submitted_at).isNotNull() | F.col(status).isin(*L.SUBMITTED_STATUSES), F.lit(False))


def history_visible(now: Column) -> Column:
    """May the application of this posting still be shown?"""
    removed = F.coalesce("removed_at", "job_updated_at")
    return F.col("is_active") | (submitted_history() & F.coalesce(removed >= days_before(now, HISTORY_DAYS), F.lit(False)))


def job_applications(postings: DataFrame, applications: DataFrame, how: str = "inner") -> DataFrame:
    """Postings with their application (at most one each); application columns keep distinct names."""
    apps = applications.select(
        "job_id", "application_id", F.col("status").alias("application_status"), "mode", "submitted_at", "started_at", "reminder_at",
        F.col("updated_at").alias("application_updated_at"), "attempt_count", F.col("resume_id").alias("application_resume_id"), "answers")
    jobs = postings.withColumnsRenamed({"updated_at": "job_updated_at"})
    return jobs.join(apps, "job_id", how)
