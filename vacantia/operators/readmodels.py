"""Read models: lists, pages, counters and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import lexicons as L
from vacantia.operators.ordering import positions, top
from vacantia.operators.source_state import metadata_field


def sort_modes() -> dict[str, list[Column]]:
    """Orders of the job list; all of them end in the id, so they are total."""
    desc, newest = lambda c: F.col(c).desc_nulls_last(), F.coalesce("published_at", "discovered_at")
    best = [desc("score"), desc("published_at"), desc("discovered_at"), desc("job_id")]
    return {
        "score_desc": best, "auto_apply_first": [desc("auto_supported"), *best],
        "score_asc": [F.col("score").asc(), *best[1:]], "newest": [newest.desc(), desc("job_id")], "oldest": [newest.asc(), F.col("job_id").asc()],
        "discovered_desc": [desc("discovered_at"), desc("job_id")], "company_asc": [F.lower("company").asc(), desc("score"), desc("job_id")],
        "title_asc": [F.lower("title").asc(), desc("score"), desc("job_id")],
    }


def jobs_sorted(jobs: DataFrame, mode: str) -> DataFrame:
    orders = sort_modes()
    if mode not in orders:
        raise ValueError(f"unsupported job order {mode}")
    return positions(jobs, orders[mode])


def jobs_page(jobs: DataFrame, mode: str, page: int, size: int) -> DataFrame:
    """One page with totals; a page beyond the last one shows the last."""
    rows = jobs_sorted(jobs, mode)
    totals = rows.agg(F.count("*").alias("total"))  # one row
    totals = totals.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size).cast("bigint")))
    totals = totals.withColumn("page", F.least(F.lit(page), F.col("pages")))
    first = (F.col("page") - 1) * size
    inside = (F.col("position") > first) & (F.col("position") <= first + size)
    return rows.join(F.broadcast(totals), inside)  # the broadcast side is a single row of totals


def top_recommendations(ranked: DataFrame, size: int = 5) -> DataFrame:
    """Best active postings per user and track; recency only breaks ties."""
    order = [F.col("score").desc(), F.col("published_at").desc_nulls_last(), F.col("discovered_at").desc_nulls_last(), F.col("job_id").desc()]
    return top(ranked.filter("is_active AND status <> 'submitted'"), order, ["user_id", "career_track"], size)


def all_tracks(counts: DataFrame) -> DataFrame:
    """The counts per user with a zero row for every track that has none."""
    tracks = F.explode(F.array(*[F.lit(t) for t in L.TRACKS])).alias("career_track")
    every = counts.select("user_id").distinct().select("user_id", tracks)
    return every.join(counts, ["user_id", "career_track"], "left").fillna(0)


def track_stats(sources: DataFrame, postings: DataFrame) -> DataFrame:
    known = F.when(F.col("career_track").isin(*L.TRACKS), F.col("career_track")).otherwise(L.CS)
    of_sources = sources.groupBy("user_id", known.alias("career_track")).agg(
        F.count_if(F.expr("enabled AND kind <> 'demo'")).alias("enabled_sources"), F.count_if(F.expr("enabled AND last_error <> ''")).alias("source_errors"))
    of_jobs = postings.groupBy("user_id", "career_track").agg(
        F.count_if("is_active").alias("jobs"), F.count_if(F.expr("is_active AND score >= 80")).alias("strong_matches"))
    return all_tracks(of_sources.join(of_jobs, ["user_id", "career_track"], "full_outer"))


def track_stats_ranked(postings: DataFrame, rankings: DataFrame, engine_version: int) -> DataFrame:
    valid = rankings.filter((F.col("engine") == "v2") & ~F.col("stale") & (F.col("error") == "") & (F.col("engine_version") == engine_version)
                            & (F.col("eligibility_state") != "excluded")).select("job_id", "tier")
    rows = postings.filter("is_active").join(valid, "job_id")
    return all_tracks(rows.groupBy("user_id", "career_track").agg(
        F.count("*").alias("jobs"), F.count_if(F.col("tier").isin("top_match", "strong_match")).alias("strong_matches")))


def skill_gaps(job_skills: DataFrame, profiles: DataFrame, samples: int = 3) -> DataFrame:
    """Skills active jobs ask for and the profile lacks: how many jobs, and the lowest job ids as samples.

    Counting is a partial aggregate; the samples come from a row-number limit, so no list grows with the data.
    """
    keys = ["user_id", "career_track", "skill"]
    wanted = job_skills.select("user_id", "career_track", "job_id", F.explode("skills").alias("skill"))
    owned = profiles.select("user_id", "career_track", F.explode("skills").alias("skill")).select(
        "user_id", "career_track", F.trim(F.lower("skill")).alias("skill")).distinct()
    gaps = wanted.join(owned, keys, "left_anti").join(profiles.select("user_id", "career_track"), ["user_id", "career_track"], "left_semi")
    counts = gaps.groupBy(*keys).agg(F.count("*").alias("job_count"))
    first = top(gaps, [F.col("job_id")], keys, samples).groupBy(*keys).agg(F.array_sort(F.collect_list("job_id")).alias("jobs"))
    return counts.join(first, keys)


def resume_coverage(required: Column, owned: Column) -> dict[str, Column]:
    """matched, missing and coverage % (50 when nothing is required)."""
    have = F.transform(owned, lambda s: F.lower(s))
    matched = F.filter(required, lambda s: F.array_contains(have, F.lower(s)))
    missing = F.filter(required, lambda s: ~F.array_contains(have, F.lower(s)))
    coverage = F.when(F.size(required) == 0, 50).otherwise(F.bround(F.try_divide(F.size(matched), F.size(required)) * 100, 0).cast("int"))
    return {"matched": matched, "missing": missing, "coverage": coverage}


def best_resume(jobs: DataFrame, resumes: DataFrame, by: str = "coverage") -> DataFrame:
    """Best resume per job among those of the same user and track.

    Both sides are first reduced to their distinct skill sets, so a user with many resumes and many jobs
    costs (distinct sets x distinct sets), not (resumes x jobs).
    """
    keys = ["user_id", "career_track"]
    sets = resumes.withColumn("owned", F.array_sort(F.transform("skills", lambda s: F.lower(s))))
    sets = sets.groupBy(*keys, "owned").agg(F.max(F.struct("is_default", "created_at", "resume_id")).alias("r"))
    wanted = jobs.withColumn("required", F.array_sort("skills"))
    pairs = wanted.select(*keys, "required").distinct().join(sets, keys)
    if by == "coverage":
        value = resume_coverage(F.col("required"), F.col("owned"))["coverage"]
    else:
        value = F.size(F.array_intersect("required", "owned"))
    best = pairs.groupBy(*keys, "required").agg(F.max(F.struct(value.alias("fit"), "r.is_default", "r.created_at", "r.resume_id")).alias("best"))
    return wanted.join(best, [*keys, "required"], "left").withColumns({"best_resume": F.col("best.resume_id"), "fit": F.col("best.fit")})


def track_state_merge(saved: DataFrame, fields: tuple[str, ...], active: str = "active_track") -> DataFrame:
    """One row per user and track: saved state with the track's defaults filled in and the active track marked."""
    known = F.when(F.col(active).isin(*L.TRACKS), F.col(active)).otherwise(L.CS)
    users = saved.groupBy("user_id").agg(F.max(known).alias("current"))
    grid = users.select("user_id", "current", F.explode(F.array(*[F.lit(t) for t in L.TRACKS])).alias("career_track"))
    rows = grid.join(saved.select("user_id", "career_track", *fields), ["user_id", "career_track"], "left")

    def default(field: str) -> Column:
        chain = None
        for track, values in L.TRACK_DEFAULTS.items():
            value = values[field]
            value = F.array(*[F.lit(v) for v in value]) if isinstance(value, tuple) else F.lit(value)
            chain = F.when(F.col("career_track") == track, value) if chain is None else chain.when(F.col("career_track") == track, value)
        return chain

    return rows.select("user_id", "career_track", (F.col("current") == F.col("career_track")).alias("is_active"),
                       *[F.coalesce(F.col(f), default(f)).alias(f) for f in fields])


def sources_visible(sources: DataFrame) -> DataFrame:
    return sources.filter(metadata_field("duplicate_of", "bigint").isNull())
