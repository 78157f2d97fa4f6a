"""Profiles prepared for scoring and joined with the postings of the same user and track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import lexicons as L
from vacantia.functions import features as X, locations as P
from vacantia.functions.text import has_term_column


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def lowered(name: str) -> Column:
    return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda v: F.lower(v))


def prepare_profiles(profiles: DataFrame) -> DataFrame:
    """Lower-cased preference lists (order kept) and what follows from them, once per profile."""
    levels = strings(L.SENIORITY_LEVELS)
    rows = profiles.select(
        "user_id", "career_track", "years_experience",
        lowered("skills").alias("own_skills"),
        F.array_union(lowered("skills"), lowered("resume_skills")).alias("effective_skills"),
        lowered("desired_titles").alias("titles"), lowered("preferred_locations").alias("places"),
        lowered("preferred_work_modes").alias("modes"), lowered("keywords").alias("keywords"),
        lowered("excluded_keywords").alias("excluded"),
        F.array_sort(F.array_distinct(F.filter("years_options", lambda v: v.isin(*L.EXPERIENCE_BUCKETS)))).alias("options"),
    )
    return rows.withColumns({
        "desired_levels": F.array_intersect(levels, "keywords"),
        "excluded_levels": F.array_intersect(levels, "excluded"),
        "excluded_terms": F.filter(F.transform("excluded", lambda v: F.trim(v)), lambda v: (v != "") & ~F.array_contains(levels, v)),
        "place_tokens": F.transform("places", lambda v: P.location_tokens(v)),
        "desired_families": F.array_distinct(F.flatten(F.transform("titles", lambda v: X.role_families(v, F.col("career_track"))))),
        "user_level": X.seniority_of_years(F.col("years_experience")),
    })


def profile_job_pairs(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each posting with the profile of its user and track.

    A profile is unique per (user, track), so the pairs are as many as the postings.  No broadcast is
    forced: Spark broadcasts the profiles while they stay under its size threshold, and beyond it the
    shuffle join is split by adaptive execution when one user owns a large share of the postings.
    """
    return features.join(prepare_profiles(profiles), ["user_id", "career_track"])


def excluded_level(levels: Column, excluded: Column) -> Column:
    """First excluded level (table order) named by the title, or null."""
    return F.get(F.array_intersect(strings(L.SENIORITY_LEVELS), F.array_intersect(levels, excluded)), 0)


def exclusion_reason(levels: Column, low_title: Column, excluded_levels: Column, excluded_terms: Column) -> Column:
    """Why the title is excluded by the profile: a level first, then the first excluded word."""
    level = excluded_level(levels, excluded_levels)
    word = F.get(F.filter(excluded_terms, lambda t: has_term_column(low_title, t)), 0)
    return F.coalesce(F.concat(F.lit("excluded seniority: "), level), F.concat(F.lit("excluded keyword: "), word))
