"""First engine: additive points from ordered rules, with an explanation and category bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import lexicons as L
from vacantia.functions import features as X
from vacantia.functions.dates import age_days
from vacantia.functions.text import has_term_column
from vacantia.operators.pairs import excluded_level, strings

BASE, CATEGORIES = 15, ("title", "skills", "experience", "location", "freshness")


def weight(rank: Column, floor: float = 0.45) -> Column:
    return F.greatest(F.lit(floor), F.lit(1.0) - rank * F.lit(0.12))


def ranks_of(values: Column, hit: Callable[[Column], Column]) -> Column:
    return F.array_compact(F.transform(values, lambda v, i: F.when((v != "") & hit(v), i)))


def ranked_points(ranks: Column, maximum: int) -> Column:
    """Points for the best-ranked hit, a little more for further hits; 0 without hits."""
    best = F.bround(F.lit(float(maximum)) * weight(F.get(ranks, 0)), 0).cast("int")
    more = F.least(F.lit(maximum), best + F.least(F.lit(4), F.size(ranks) - 1))
    return F.when(F.size(ranks) == 0, 0).when(F.size(ranks) > 1, more).otherwise(best)


def _experience_with_location() -> Column:
    """The requirement in title, description and location."""
    return X.experience_extract(F.col("full_text"))


def freshness(now: Column, published: Column, last_seen: Column) -> Column:
    """struct(code, points, breakdown_points) from the posting date, else from when it was last seen; null when neither helps."""
    age, seen = age_days(now, published), age_days(now, last_seen)
    row = lambda code, points, bar: F.struct(F.lit(code).alias("code"), F.lit(points).alias("points"), F.lit(bar).alias("breakdown_points"))
    return (
        F.when(age <= 3, row("new", 5, 25)).when(age <= 7, row("this_week", 3, 20)).when(age <= 14, row("two_weeks", 1, 15))
        .when(age <= 30, row("this_month", 0, 8)).when(age.isNotNull(), row("old", -6, -8))
        .when(seen <= 2, row("seen_now", 2, 20)).when(seen <= 7, row("seen_this_week", 0, 15))
    )


def score_v1(pairs: DataFrame, now: Column) -> DataFrame:
    """Add ``score``, ``reasons``, ``breakdown`` (one struct) and experience bounds to posting x profile rows."""
    col, levels = F.col, strings(L.SENIORITY_LEVELS)
    rows = pairs.withColumns({
        "_level_hits": F.array_intersect("levels", "desired_levels"),
        "_blocked": excluded_level(col("levels"), col("excluded_levels")).isNotNull(),
        "_title_ranks": ranks_of(col("titles"), lambda v: col("low_title").contains(v)),
        "_overlap": F.array_intersect("effective_skills", "text_skills"),
        "_missing": F.size(F.array_except("required", "effective_skills")),
        "_low_location": F.lower(F.coalesce("location", F.lit(""))),
        "_word_ranks": ranks_of(col("keywords"), lambda v: ~F.array_contains(levels, v) & col("full_text").contains(v)),
        "_mode_ranks": ranks_of(col("modes"), lambda v: v == F.lower(F.coalesce("workplace", F.lit("")))),
        "_excluded_words": F.size(F.filter("excluded", lambda v: (v != "") & ~F.array_contains(levels, v) & has_term_column(col("low_title"), v))),
        "_experience": _experience_with_location(),
        "_fresh": freshness(now, col("published_at"), F.coalesce("updated_at", "discovered_at")),
    })
    rows = rows.withColumns({
        "_place_ranks": ranks_of(col("places"), lambda v: col("_low_location").contains(v) | v.contains(col("_low_location"))),
        "_level_ranks": ranks_of(col("keywords"), lambda v: F.array_contains("_level_hits", v)),
        "_skill_points": F.least(F.lit(18), F.aggregate("_overlap", F.lit(0), lambda total, s: total + F.when(
            F.array_contains("own_skills", s), F.bround(4.0 * weight((F.array_position("own_skills", s) - 1).cast("int"), 0.5), 0).cast("int")).otherwise(3))),
        "experience_min": col("_experience.experience_min"), "experience_max": col("_experience.experience_max"),
    })
    years, need = col("years_experience"), col("experience_min")
    senior_wanted = F.arrays_overlap("desired_levels", strings(("senior", "lead", "staff", "manager")))
    penalty = -F.least(F.lit(28), 12 + 6 * col("_missing"))
    gap = -F.least(F.lit(30), ((need - years) * 8).cast("int"))
    track, relevant = col("career_track"), col("track.relevant")
    places_known = F.size("places") > 0

    def reason(category, *rules):
        """First rule (condition, code, points[, bar points]) of a block that fires, as a reason struct."""
        def as_struct(code, points, bar):
            points = F.lit(points) if isinstance(points, int) else points
            return F.struct(
                F.when(points > 0, "positive").when(points < 0, "negative").otherwise("neutral").alias("type"),
                (F.lit(code) if isinstance(code, str) else code).alias("code"), points.cast("int").alias("points"),
                (points if bar is None else bar).cast("int").alias("breakdown_points"), F.lit(category).alias("category"))
        chain = None
        for condition, code, points, *bar in rules:
            value = as_struct(code, points, bar[0] if bar else None)
            chain = F.when(condition, value) if chain is None else chain.when(condition, value)
        return chain

    has = lambda name: F.size(name) > 0
    reasons = F.array_compact(F.array(
        reason("title", (col("_blocked"), "level_excluded", -100), (has("_level_hits"), "level_desired", ranked_points(col("_level_ranks"), 18)),
               (col("senior_title") & ~senior_wanted, "too_senior", -40)),
        reason("", (~col("_blocked") & ~has("_level_hits") & ~(col("senior_title") & ~senior_wanted) & col("entry_title"), "entry_role", 10)),
        reason("title", ((track == L.CS) & col("dev_title"), "development_role", 5),
               ((track == L.IEM) & relevant, "iem_role", 7), (track == L.IEM, "outside_iem", -25),
               ((track == L.EE) & relevant, "ee_role", 8), (track == L.EE, "outside_ee", -30)),
        reason("title", (col("known_company").isNotNull(), "known_company", 8)),
        reason("title", (has("_title_ranks"), "desired_title", ranked_points(col("_title_ranks"), 22)), (has("titles"), "other_title", -15)),
        reason("skills", (has("_overlap"), "skill_overlap", col("_skill_points")), (has("effective_skills"), "no_skill_overlap", -8)),
        reason("", (col("_missing") > 0, "missing_required", penalty)),
        reason("experience", (need.isNull(), "experience_unclear", 0), (need <= F.greatest(F.lit(1.0), years + 1), "experience_fits", 10),
               (need <= years + 2, "experience_slightly_high", 3), (F.lit(True), "experience_high", gap)),
        reason("location", (places_known & has("_place_ranks"), "preferred_location", ranked_points(col("_place_ranks"), 6)),
               (places_known & (col("workplace") == "remote"), "remote", 4), (places_known, "other_location", -5)),
        reason("title", (has("_word_ranks"), "keywords", ranked_points(col("_word_ranks"), 5))),
        reason("location", (has("_mode_ranks"), "work_mode", ranked_points(col("_mode_ranks"), 6))),
        reason("", (col("_excluded_words") > 0, "excluded_field", -35)),
        reason("freshness", (col("_fresh").isNotNull(), col("_fresh.code"), col("_fresh.points"), col("_fresh.breakdown_points"))),
        reason("", (col("quality") != "complete", "partial_text", 0)),
    ))
    rows = rows.withColumn("reasons", reasons)
    total = F.aggregate("reasons", F.lit(BASE), lambda t, r: t + r["points"])
    cap = F.least(F.when(col("_missing") > 0, 69).otherwise(100), F.when(col("quality") != "complete", 55).otherwise(100))
    bar = lambda category: F.aggregate(
        F.filter("reasons", lambda r: r["category"] == category), F.lit(50),
        lambda level, r: F.greatest(F.lit(0), F.least(F.lit(100), level + 2 * r["breakdown_points"])))
    rows = rows.withColumns({
        "score": F.when(col("_blocked") | (col("_excluded_words") > 0), 0).otherwise(F.least(cap, F.greatest(F.lit(0), total))),
        "breakdown": F.struct(*[bar(c).alias(c) for c in CATEGORIES]),
    })
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def v1_tier(score: Column) -> Column:
    return (F.when(score >= 90, "top_match").when(score >= 80, "strong_match").when(score >= 65, "good_match")
            .otherwise("low_match"))
