"""Queries for the scoring engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions.dates import timestamp
from vacantia.operators import scoring_v1 as V1, scoring_v2 as V2
from vacantia.operators.job_features import job_features, skill_classes
from vacantia.operators.pairs import prepare_profiles, profile_job_pairs
from vacantia.plans import duck as K, duck_scoring as S
from vacantia.plans.fixtures import NOW, spread, view
from vacantia.plans.registry import query
from vacantia.plans.text_queries import joined, skill_class_ctes


def now():
    return timestamp(NOW)


def features(spark, folder):
    return job_features(spread(view(spark, folder, "postings")))


def pairs(spark, folder):
    return profile_job_pairs(features(spark, folder), view(spark, folder, "profiles"))


@query("ranked_points", f"""
WITH {S.profile_ctes()}, r AS (SELECT user_id, career_track, {S.ranks('words', "length(v) % 2 = 0")} AS a, {S.ranks('titles', "contains(v, 'engineer') OR contains(v, 'analyst')")} AS b FROM prof)
SELECT user_id, career_track, {S.points('a', 18)} AS keyword_points, {S.points('b', 22)} AS title_points FROM r""")
def ranked_points(spark, folder):
    rows = prepare_profiles(view(spark, folder, "profiles"))
    words = V1.ranks_of(F.col("keywords"), lambda v: F.length(v) % 2 == 0)
    titles = V1.ranks_of(F.col("titles"), lambda v: v.contains("engineer") | v.contains("analyst"))
    return rows.select("user_id", "career_track", V1.ranked_points(words, 18).alias("keyword_points"), V1.ranked_points(titles, 22).alias("title_points"))


@query("score_v1", f"WITH {S.v1_ctes()} SELECT user_id, career_track, job_id, score, need AS experience_min FROM v1")
def score_v1(spark, folder):
    return V1.score_v1(pairs(spark, folder), now()).select("user_id", "career_track", "job_id", "score", "experience_min")


@query("score_v1_reasons", f"WITH {S.v1_ctes()} SELECT user_id, job_id, array_to_string(list_transform(fired, lambda r: r.c || ':' || r.p || ':' || r.b), '|') AS reasons FROM v1")
def score_v1_reasons(spark, folder):
    rows = V1.score_v1(pairs(spark, folder), now())
    text = F.transform("reasons", lambda r: F.concat_ws(":", r["category"], r["points"].cast("string"), r["breakdown_points"].cast("string")))
    return rows.select("user_id", "job_id", F.array_join(text, "|").alias("reasons"))


@query("score_v1_breakdown", f"WITH {S.v1_ctes()} SELECT user_id, job_id, bar_title AS title, bar_skills AS skills, bar_experience AS experience, bar_location AS location, bar_freshness AS freshness FROM v1")
def score_v1_breakdown(spark, folder):
    return V1.score_v1(pairs(spark, folder), now()).select("user_id", "job_id", "breakdown.*")


@query("freshness", """
WITH a AS (SELECT job_id, greatest(0, floor((epoch(NOW) - floor(epoch(published_at))) / 86400))::int AS age, published_at,
  greatest(0, floor((epoch(NOW) - floor(epoch(updated_at))) / 86400))::int AS seen FROM @@postings)
SELECT job_id, CASE WHEN published_at IS NULL THEN CASE WHEN seen <= 2 THEN 2 WHEN seen <= 7 THEN 0 END WHEN age <= 3 THEN 5 WHEN age <= 7 THEN 3 WHEN age <= 14 THEN 1 WHEN age <= 30 THEN 0 ELSE -6 END AS points FROM a""")
def freshness(spark, folder):
    value = V1.freshness(now(), F.col("published_at"), F.coalesce("updated_at", "discovered_at"))
    return view(spark, folder, "postings").select("job_id", value["points"].alias("points"))


ELIGIBILITY = ("track_status", "experience_status", "seniority_status", "location_status", "recency_status", "work_mode_status", "employment_status")


@query("eligibility", f"""WITH {S.eligibility_ctes()} SELECT user_id, job_id, state, exclusion, gap, {', '.join(ELIGIBILITY)}, {K.joined('buckets')} AS buckets, seniority AS job_level, user_level, age::int AS age,
  CASE WHEN unknowns <= 1 THEN 'high' WHEN unknowns <= 3 THEN 'medium' ELSE 'low' END AS confidence FROM el""")
def eligibility(spark, folder):
    rows = V2.eligibility(pairs(spark, folder), now(), V2.fixed_config())
    return rows.select("user_id", "job_id", F.col("eligibility_state").alias("state"), "exclusion", "gap", *ELIGIBILITY, joined(F.col("buckets")).alias("buckets"),
                       F.col("seniority").alias("job_level"), "user_level", "age", F.col("eligibility_confidence").alias("confidence"))


@query("locations_match", f"WITH {S.eligibility_ctes()} SELECT user_id, job_id, location_status = 'match' AS matches FROM el WHERE len(places) > 0 AND trim(location) <> ''")
def locations_match(spark, folder):
    from vacantia.functions import locations as P

    postings = view(spark, folder, "postings").select("job_id", "user_id", "career_track", "location", P.location_tokens(F.col("location")).alias("tokens"))
    rows = profile_job_pairs(postings, view(spark, folder, "profiles")).filter((F.size("places") > 0) & (F.trim("location") != ""))
    return rows.select("user_id", "job_id", P.locations_match(F.col("tokens"), F.col("place_tokens")).alias("matches"))


@query("role_match", f"WITH {S.v2_ctes()} SELECT user_id, job_id, role_score, {K.joined('families')} AS families FROM v2")
def role_match(spark, folder):
    rows = V2.role_match(pairs(spark, folder), V2.fixed_config())
    return rows.select("user_id", "job_id", "role_score", joined(F.col("families")).alias("families"))


def _skill_pairs(spark, folder):
    return profile_job_pairs(skill_classes(spread(view(spark, folder, "postings"))), view(spark, folder, "profiles"))


SKILL_PAIR_CTES = f"{skill_class_ctes()}, {S.profile_ctes()}, el AS (SELECT po.job_id, po.user_id, c.*EXCLUDE (job_id), effective FROM @@postings po JOIN classes c USING (job_id) JOIN prof p ON p.user_id = po.user_id AND p.career_track = po.career_track)"
MATRIX = """m AS (SELECT *, list_sort(list_filter(required, lambda v: list_contains(effective, v))) AS mr, list_sort(list_filter(required, lambda v: NOT list_contains(effective, v))) AS ms,
  list_sort(list_distinct(list_concat(preferred, supporting))) AS op FROM el), n AS (SELECT *, list_filter(op, lambda v: list_contains(effective, v)) AS mo FROM m)"""


@query("skills_matrix", f"WITH {SKILL_PAIR_CTES}, {MATRIX} SELECT user_id, job_id, {K.joined('mr')} AS matched_required, {K.joined('ms')} AS missing_required, {K.joined('mo')} AS matched_optional FROM n")
def skills_matrix(spark, folder):
    rows = V2.skills_matrix(_skill_pairs(spark, folder))
    return rows.select("user_id", "job_id", *[joined(F.col(c)).alias(c) for c in ("matched_required", "missing_required", "matched_optional")])


@query("skills_score", f"""WITH {SKILL_PAIR_CTES}, {MATRIX} SELECT user_id, job_id, greatest(0, least(35, round_even(24 * CASE WHEN len(required) > 0 THEN len(mr)::double / len(required) WHEN len(op) = 0 THEN 0.65 ELSE 1.0 END::double
  + 11 * CASE WHEN len(op) > 0 THEN len(mo)::double / len(op) ELSE 0.7 END::double, 0)::int)) AS skills_score FROM n""")
def skills_score(spark, folder):
    rows = V2.skills_score(V2.skills_matrix(_skill_pairs(spark, folder)), V2.fixed_config())
    return rows.select("user_id", "job_id", "skills_score")


V2_COLUMNS = ("score", "tier", "confidence", "role_score", "skills_score", "requirements_score", "preferences_score")


@query("score_v2", f"WITH {S.v2_ctes()} SELECT user_id, career_track, job_id, state, {', '.join(V2_COLUMNS)} FROM v2")
def score_v2(spark, folder):
    rows = V2.score_v2(pairs(spark, folder), now())
    return rows.select("user_id", "career_track", "job_id", F.col("eligibility_state").alias("state"), *V2_COLUMNS)


@query("confidence", f"WITH {S.v2_ctes()} SELECT user_id, job_id, confidence FROM v2")
def confidence(spark, folder):
    return features(spark, folder).join(view(spark, folder, "profiles").select("user_id", "career_track"), ["user_id", "career_track"]).select("user_id", "job_id", V2.confidence().alias("confidence"))


@query("v1_tier", "SELECT job_id, CASE WHEN score >= 90 THEN 'top_match' WHEN score >= 80 THEN 'strong_match' WHEN score >= 65 THEN 'good_match' ELSE 'low_match' END AS tier FROM @@postings")
def v1_tier(spark, folder):
    return view(spark, folder, "postings").select("job_id", V1.v1_tier(F.col("score")).alias("tier"))


@query("profile_job_pairs", "SELECT p.user_id, p.career_track, p.job_id FROM @@postings p JOIN @@profiles q ON p.user_id = q.user_id AND p.career_track = q.career_track WHERE p.is_active")
def pairs_query(spark, folder):
    active = view(spark, folder, "postings").filter("is_active").select("user_id", "career_track", "job_id")
    return profile_job_pairs(active, view(spark, folder, "profiles")).select("user_id", "career_track", "job_id")
