"""One feature row per posting: everything the scoring rules need from its text, computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vacantia import lexicons as L
from vacantia.functions import features as X, locations as P, text as T


def skill_classes(postings: DataFrame) -> DataFrame:
    """Add required / preferred / supporting skills and ``all_skills``.

    Skills are searched in the joined required and preferred sentences, so no sentence is exploded
    and no shuffle is needed.
    """
    required_text, preferred_text = X.marked_sentences(F.col("title"), F.col("description"))
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("description", F.lit("")))
    rows = postings.withColumns({"_required_text": required_text, "_preferred_text": preferred_text})
    rows = rows.withColumns({
        "all_skills": X.skills_extract(whole),
        "_in_required": X.skills_extract(F.col("_required_text")),
        "_in_preferred": X.skills_extract(F.col("_preferred_text")),
        "_in_title": X.skills_extract(F.coalesce("title", F.lit(""))),
    })
    rows = rows.withColumn("required", F.array_sort(F.array_union("_in_required", "_in_title")))
    rows = rows.withColumn("preferred", F.array_except("_in_preferred", "required"))
    supporting = F.when(F.size("required") == 0, F.col("all_skills")).otherwise(
        F.array_except(F.array_except("all_skills", "required"), "preferred"))
    rows = rows.withColumn("supporting", supporting)
    return rows.drop("_required_text", "_preferred_text", "_in_required", "_in_preferred", "_in_title")


def job_features(postings: DataFrame) -> DataFrame:
    """Posting columns plus text features; expects the posting columns named in :mod:`vacantia.schemas`."""
    title, description = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    rows = skill_classes(postings)
    rows = rows.withColumns({
        "low_title": F.lower(title),
        "low_text": F.lower(F.concat(title, F.lit(" "), description)),
        "full_text": F.lower(F.concat(title, F.lit(" "), description, F.lit(" "), F.coalesce("location", F.lit("")))),
        "quality": T.text_quality(F.col("description")),
        # Scoring needs the length only, so the description itself does not travel to the profiles.
        "description_length": F.length(F.trim(description)),
        "track": X.track_relevance(F.col("title"), F.col("description"), F.col("career_track")),
        "experience": X.experience_extract(F.concat(title, F.lit(" "), description)),
        "seniority": X.seniority_detect(F.col("title")),
        "levels": X.detected_levels(title),
        "families": X.role_families(F.col("title"), F.col("career_track")),
        "location_tokens": P.location_tokens(F.col("location")),
    })
    return rows.withColumns({
        "employment": X.employment_type(F.col("low_text")),
        "text_skills": X.skills_extract(F.col("full_text")),
        "senior_title": T.contains_any(F.col("low_title"), L.SENIOR_TERMS),
        "entry_title": T.contains_any(F.col("low_title"), L.ENTRY_TERMS),
        "dev_title": T.contains_any(F.col("low_title"), L.DEV_TERMS),
        "known_company": T.first_key(F.lower(F.coalesce("company", F.lit(""))), L.KNOWN_COMPANIES),
        "degree": T.contains_any(F.col("low_text"), L.DEGREE_TERMS),
        "mandatory": T.matching_keys(F.col("low_text"), {t: (t,) for t in L.MANDATORY_TERMS}),
    })
