"""Queries for read models, counters and ranking tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import lexicons as L
from vacantia.functions import features as X
from vacantia.operators import filters as R, funnel as U, ranking as G, readmodels as M, scoring_v1 as V1, scoring_v2 as V2
from vacantia.operators.job_features import job_features
from vacantia.operators.pairs import profile_job_pairs
from vacantia.plans import duck as K, duck_scoring as S
from vacantia.plans.fixtures import spread, table, view
from vacantia.plans.registry import query
from vacantia.plans.scoring_queries import now, pairs
from vacantia.plans.text_queries import joined

VALID = "engine_version = 2 AND NOT stale AND error = ''"


@query("job_source_application", """SELECT p.job_id, p.title, s.name AS source_name, a.application_id, a.status AS application_status,
  1 + CASE WHEN p.job_id % 13 = 0 THEN 1 ELSE 0 END AS links FROM @@postings p JOIN @@sources s USING (source_id) LEFT JOIN @@applications a ON a.job_id = p.job_id""")
def job_source_application(spark, folder):
    postings = view(spark, folder, "postings")
    alternates = view(spark, folder, "snap_curr").filter(F.col("external_id").startswith("copy-")).groupBy(
        F.regexp_replace("external_id", "^copy-", "").alias("external_id")).agg(F.countDistinct("apply_url").alias("alternates"))
    names = view(spark, folder, "sources").select("source_id", F.col("name").alias("source_name"))
    rows = R.job_applications(postings, view(spark, folder, "applications"), "left").join(names, "source_id").join(alternates, "external_id", "left")
    return rows.select("job_id", "title", "source_name", "application_id", "application_status", (1 + F.coalesce("alternates", F.lit(0))).cast("int").alias("links"))


@query("attach_ranking", f"SELECT p.job_id, coalesce(r.score, p.score) AS active_score, CASE WHEN r.score IS NULL THEN 'v1' ELSE 'v2' END AS active_engine, r.tier FROM @@postings p LEFT JOIN (SELECT * FROM @@rankings WHERE {VALID}) r USING (job_id)")
def attach_ranking(spark, folder):
    return G.attach_ranking(view(spark, folder, "postings"), view(spark, folder, "rankings")).select("job_id", "active_score", "active_engine", "tier")


JOB_SKILLS = f"js AS MATERIALIZED (SELECT job_id, user_id, career_track, is_active, status, score, company, {K.keys("lower(title || ' ' || description)", L.SKILLS)} AS skills FROM @@postings)"


def job_skills(spark, folder):
    rows = spread(view(spark, folder, "postings"))
    return rows.withColumn("skills", X.skills_extract(F.concat_ws(" ", "title", "description")))


RESUME_PAIRS = f"""{JOB_SKILLS}, rs AS (SELECT *, list_transform(skills, lambda v: lower(v)) AS owned FROM @@resumes),
jr AS (SELECT j.job_id, j.user_id, j.career_track, r.resume_id, r.is_default, r.created_at, len(list_filter(j.skills, lambda v: list_contains(r.owned, v)))::int AS overlap,
  CASE WHEN len(j.skills) = 0 THEN 50 ELSE round_even(len(list_filter(j.skills, lambda v: list_contains(r.owned, v))) / len(j.skills) * 100, 0) END::int AS coverage FROM js j JOIN rs r ON r.user_id = j.user_id AND r.career_track = j.career_track),
br AS (SELECT job_id, arg_max(resume_id, (coverage, is_default, created_at, resume_id)) AS best_resume, max(coverage) AS fit, arg_max(resume_id, (overlap, is_default, created_at, resume_id)) AS by_overlap FROM jr GROUP BY 1)"""


@query("best_resume", f"WITH {RESUME_PAIRS} SELECT js.job_id, best_resume, fit, by_overlap FROM js LEFT JOIN br USING (job_id)")
def best_resume(spark, folder):
    jobs, resumes = job_skills(spark, folder).select("job_id", "user_id", "career_track", "skills"), view(spark, folder, "resumes")
    first = M.best_resume(jobs, resumes).select("job_id", "best_resume", "fit")
    second = M.best_resume(jobs, resumes, "overlap").select("job_id", F.col("best_resume").alias("by_overlap"))
    return first.join(second, "job_id")


@query("resume_coverage", f"""WITH {JOB_SKILLS} SELECT a.application_id, {K.joined('list_filter(js.skills, lambda v: list_contains(list_transform(r.skills, lambda s: lower(s)), v))')} AS matched,
  {K.joined('list_filter(js.skills, lambda v: NOT list_contains(list_transform(r.skills, lambda s: lower(s)), v))')} AS missing,
  CASE WHEN len(js.skills) = 0 THEN 50 ELSE round_even(len(list_filter(js.skills, lambda v: list_contains(list_transform(r.skills, lambda s: lower(s)), v))) / len(js.skills) * 100, 0) END::int AS coverage
FROM @@applications a JOIN js USING (job_id) JOIN @@resumes r ON r.resume_id = a.resume_id""")
def resume_coverage(spark, folder):
    resumes = view(spark, folder, "resumes").select("resume_id", F.col("skills").alias("owned"))
    rows = job_skills(spark, folder).select("job_id", "skills").join(view(spark, folder, "applications").select("application_id", "job_id", "resume_id"), "job_id").join(resumes, "resume_id")
    fit = M.resume_coverage(F.col("skills"), F.col("owned"))
    return rows.select("application_id", joined(fit["matched"]).alias("matched"), joined(fit["missing"]).alias("missing"), fit["coverage"].alias("coverage"))


@query("track_stats", f"""WITH s AS (SELECT user_id, career_track, count_if(enabled AND kind <> 'demo') AS enabled_sources, count_if(enabled AND last_error <> '') AS source_errors FROM @@sources GROUP BY ALL),
j AS (SELECT user_id, career_track, count_if(is_active) AS jobs, count_if(is_active AND score >= 80) AS strong_matches FROM @@postings GROUP BY ALL), u AS (SELECT user_id FROM s UNION SELECT user_id FROM j)
SELECT u.user_id, t.career_track, coalesce(enabled_sources, 0)::bigint AS enabled_sources, coalesce(source_errors, 0)::bigint AS source_errors, coalesce(jobs, 0)::bigint AS jobs, coalesce(strong_matches, 0)::bigint AS strong_matches
FROM u CROSS JOIN (VALUES ('{L.CS}'), ('{L.IEM}'), ('{L.EE}')) t(career_track) LEFT JOIN s ON s.user_id = u.user_id AND s.career_track = t.career_track LEFT JOIN j ON j.user_id = u.user_id AND j.career_track = t.career_track""")
def track_stats(spark, folder):
    return M.track_stats(view(spark, folder, "sources"), view(spark, folder, "postings"))


@query("track_stats_ranked", f"""WITH c AS (SELECT p.user_id, p.career_track, count(*) AS jobs, count_if(r.tier IN ('top_match', 'strong_match'))::bigint AS strong_matches FROM @@postings p JOIN @@rankings r USING (job_id)
WHERE p.is_active AND {VALID} AND eligibility_state <> 'excluded' GROUP BY ALL)
SELECT u.user_id, t.career_track, coalesce(jobs, 0) AS jobs, coalesce(strong_matches, 0) AS strong_matches FROM (SELECT DISTINCT user_id FROM c) u CROSS JOIN (VALUES ('{L.CS}'), ('{L.IEM}'), ('{L.EE}')) t(career_track) LEFT JOIN c USING (user_id, career_track)""")
def track_stats_ranked(spark, folder):
    return M.track_stats_ranked(view(spark, folder, "postings"), view(spark, folder, "rankings"), V2.ENGINE_VERSION)


@query("status_counts", """SELECT p.user_id, p.career_track, count(*) AS applications, count_if(a.status = 'queued')::bigint AS queued, count_if(a.status = 'applying')::bigint AS applying, count_if(a.status = 'needs_input')::bigint AS needs_input,
 count_if(a.status = 'verification_pending')::bigint AS verification_pending, count_if(a.status = 'submitted')::bigint AS submitted, count_if(a.status = 'rejected')::bigint AS rejected, count_if(a.status = 'failed')::bigint AS failed
FROM @@applications a JOIN @@postings p USING (job_id) GROUP BY ALL""")
def status_counts(spark, folder):
    rows = R.job_applications(view(spark, folder, "postings"), view(spark, folder, "applications"))
    names = ["queued", "applying", "needs_input", "verification_pending", "submitted", "rejected", "failed"]
    wide = rows.groupBy("user_id", "career_track").pivot("application_status", names).count().fillna(0)
    return wide.withColumn("applications", sum((F.col(n) for n in names), F.lit(0)).cast("bigint"))


@query("dashboard_counters", f"""WITH a AS (SELECT p.user_id, p.career_track, a.* EXCLUDE (user_id) FROM @@applications a JOIN @@postings p USING (job_id)),
b AS (SELECT a.user_id, a.career_track, count(*) AS open_blockers FROM @@blockers b JOIN a USING (application_id) WHERE b.status = 'open' GROUP BY ALL),
r AS (SELECT user_id, career_track, count_if(reminder_at <= NOW AND status <> 'rejected') AS due_reminders FROM a GROUP BY ALL)
SELECT q.user_id, q.career_track, coalesce(open_blockers, 0)::bigint AS open_blockers, coalesce(due_reminders, 0)::bigint AS due_reminders,
  trim(full_name) <> '' AND trim(email) <> '' AND trim(coalesce(phone, '')) <> '' AND trim(q.location) <> '' AS profile_complete, cv_path <> '' AS resume_uploaded
FROM @@profiles q LEFT JOIN b USING (user_id, career_track) LEFT JOIN r USING (user_id, career_track)""")
def dashboard_counters(spark, folder):
    keys = ["user_id", "career_track"]
    apps = R.job_applications(view(spark, folder, "postings"), view(spark, folder, "applications")).select(*keys, "application_id", "application_status", "reminder_at")
    opened = view(spark, folder, "blockers").filter("status = 'open'").groupBy("application_id").agg(F.count("*").alias("n"))
    counts = apps.join(opened, "application_id", "left").groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("open_blockers"),
        F.count_if((F.col("reminder_at") <= now()) & (F.col("application_status") != "rejected")).alias("due_reminders"))
    filled = lambda name: F.trim(F.coalesce(name, F.lit(""))) != ""
    complete = filled("full_name") & filled("email") & filled("phone") & filled("location")
    people = view(spark, folder, "profiles").select(*keys, complete.alias("profile_complete"), filled("cv_path").alias("resume_uploaded"))
    return people.join(counts, keys, "left").fillna(0)


@query("ranking_summary", """WITH t AS (SELECT user_id, count(*) AS total FROM @@postings WHERE is_active GROUP BY 1), c AS (SELECT user_id, count_if(NOT stale AND error = '') AS evaluated, count_if(stale OR error <> '') AS stale, count_if(error <> '') AS failed,
  round_even(avg(nullif(duration_ms, 0)), 2) AS average_ms, max(evaluated_at) AS last_evaluation FROM @@rankings GROUP BY 1)
SELECT user_id, coalesce(total, 0)::bigint AS total, coalesce(evaluated, 0)::bigint AS evaluated, coalesce(stale, 0)::bigint AS stale, coalesce(failed, 0)::bigint AS failed, coalesce(average_ms, 0)::double AS average_ms, last_evaluation::varchar AS last_evaluation,
  greatest(0, coalesce(total, 0) - coalesce(evaluated, 0))::bigint AS waiting FROM t FULL JOIN c USING (user_id)""")
def ranking_summary(spark, folder):
    rows = G.ranking_summary(view(spark, folder, "rankings"), view(spark, folder, "postings"))
    return rows.withColumn("last_evaluation", F.col("last_evaluation").cast("string"))


@query("source_overview", """SELECT s_nationkey, count(*) AS total, count_if(s_acctbal > 0)::bigint AS enabled, count_if(s_acctbal > 0 AND s_suppkey % 7 = 3)::bigint AS erroring, round_even(avg(100 - (s_suppkey % 7) * 13), 0)::int AS average_health FROM supplier GROUP BY 1""")
def source_overview(spark, folder):
    rows = table(spark, folder, "supplier").withColumns({"enabled": F.col("s_acctbal") > 0, "error": F.col("s_suppkey") % 7 == 3, "health": 100 - (F.col("s_suppkey") % 7) * 13})
    return rows.groupBy("s_nationkey").agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(F.expr("enabled AND error")).alias("erroring"),
                                           F.bround(F.avg("health"), 0).cast("int").alias("average_health"))


@query("user_counts", """SELECT c_custkey AS user_id, coalesce(j.n, 0) AS jobs, coalesce(s.n, 0) AS sources, coalesce(a.n, 0) AS applications, coalesce(r.n, 0) AS resumes FROM customer
LEFT JOIN (SELECT user_id, count(*) AS n FROM @@postings GROUP BY 1) j ON j.user_id = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM @@sources GROUP BY 1) s ON s.user_id = c_custkey
LEFT JOIN (SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1) a ON a.user_id = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM @@resumes GROUP BY 1) r ON r.user_id = c_custkey""")
def user_counts(spark, folder):
    tagged = None
    for name, rows in (("jobs", view(spark, folder, "postings").select("user_id")), ("sources", view(spark, folder, "sources").select("user_id")),
                       ("applications", table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"))), ("resumes", view(spark, folder, "resumes").select("user_id"))):
        rows = rows.withColumn("what", F.lit(name))
        tagged = rows if tagged is None else tagged.union(rows)
    # One grouped pass over the union instead of four aggregations and joins.
    count = lambda name: F.count_if(F.col("what") == name).alias(name)
    counts = tagged.groupBy("user_id").agg(*[count(n) for n in ("jobs", "sources", "applications", "resumes")])
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id")).join(counts, "user_id", "left").fillna(0)


@query("skill_gaps", f"""WITH {JOB_SKILLS}, g AS (SELECT js.user_id, js.career_track, job_id, unnest(js.skills) AS skill FROM js WHERE is_active),
h AS (SELECT g.* FROM g JOIN @@profiles q ON q.user_id = g.user_id AND q.career_track = g.career_track WHERE NOT list_contains(list_transform(q.skills, lambda v: lower(trim(v))), g.skill))
SELECT user_id, career_track, skill, count(*) AS job_count, array_to_string(list_slice(list_sort(list(job_id)), 1, 3), '|') AS jobs FROM h GROUP BY ALL""")
def skill_gaps(spark, folder):
    rows = M.skill_gaps(job_skills(spark, folder).filter("is_active"), view(spark, folder, "profiles"))
    return rows.withColumn("jobs", F.array_join(F.col("jobs").cast("array<string>"), "|"))


@query("ranking_preview_stats", """WITH d AS (SELECT p.user_id, p.job_id, r.score - p.score AS delta FROM @@postings p JOIN @@rankings r USING (job_id))
SELECT user_id, count_if(delta > 0)::bigint AS promoted, count_if(delta < 0)::bigint AS demoted, round_even(avg(delta), 2) AS average_delta, array_to_string(list_slice(list_reverse_sort(list(abs(delta))), 1, 5), '|') AS largest FROM d GROUP BY 1""")
def ranking_preview_stats(spark, folder):
    now_scores = view(spark, folder, "rankings").select("job_id", F.col("score").alias("preview"))
    deltas = view(spark, folder, "postings").select("user_id", "job_id", "score").join(now_scores, "job_id").withColumn("delta", F.col("preview") - F.col("score"))
    rows = G.preview_stats(deltas, ["user_id"])
    return rows.withColumn("largest", F.array_join(F.col("largest").cast("array<string>"), "|"))


ORDERS = {
    "score_desc": "score DESC, published_at DESC NULLS LAST, discovered_at DESC, job_id DESC", "auto_apply_first": "auto_supported DESC, score DESC, published_at DESC NULLS LAST, discovered_at DESC, job_id DESC",
    "score_asc": "score, published_at DESC NULLS LAST, discovered_at DESC, job_id DESC", "newest": "coalesce(published_at, discovered_at) DESC, job_id DESC", "oldest": "coalesce(published_at, discovered_at), job_id",
    "discovered_desc": "discovered_at DESC, job_id DESC", "company_asc": "lower(company), score DESC, job_id DESC", "title_asc": "lower(title), score DESC, job_id DESC",
}
JOBS = f"jb AS (SELECT p.*, {K.ats_family('p.apply_url', 's.kind')} IN {K.AUTO_FAMILIES} AS auto_supported FROM @@postings p LEFT JOIN @@sources s ON s.source_id = p.source_id)"


def list_jobs(spark, folder):
    rows = U.with_adapter(view(spark, folder, "postings"), view(spark, folder, "sources"))
    return rows.select("job_id", "score", "published_at", "discovered_at", "company", "title", "auto_supported")


@query("jobs_sorted", f"WITH {JOBS} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, job_id, row_number() OVER (ORDER BY {o}) AS position FROM jb" for m, o in ORDERS.items()))
def jobs_sorted(spark, folder):
    jobs, result = list_jobs(spark, folder), None
    for mode in M.sort_modes():
        rows = M.jobs_sorted(jobs, mode).select(F.lit(mode).alias("mode"), "job_id", "position")
        result = rows if result is None else result.union(rows)
    return result


@query("jobs_page", f"""WITH {JOBS}, n AS (SELECT *, row_number() OVER (ORDER BY {ORDERS['score_desc']}) AS position, count(*) OVER () AS total FROM jb), g AS (SELECT *, greatest(1, ceil(total / 30))::bigint AS pages FROM n), h AS (SELECT *, least(3, pages) AS page FROM g)
SELECT job_id, position, total, pages, page::bigint AS page FROM h WHERE position > (page - 1) * 30 AND position <= page * 30""")
def jobs_page(spark, folder):
    return M.jobs_page(list_jobs(spark, folder), "score_desc", 3, 30).select("job_id", "position", "total", "pages", F.col("page").cast("bigint").alias("page"))


@query("top_recommendations", f"""WITH {S.v1_ctes()}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id, career_track ORDER BY score DESC, published_at DESC NULLS LAST, discovered_at DESC, job_id DESC) AS position FROM v1 WHERE is_active AND status <> 'submitted')
SELECT user_id, career_track, job_id, title, score, position::int AS position FROM t WHERE position <= 5""")
def top_recommendations(spark, folder):
    """The flagship: clean and feature every posting, score it for its user, keep each user's five best."""
    candidates = spread(view(spark, folder, "postings").filter("is_active AND status <> 'submitted'"))
    scored = V1.score_v1(profile_job_pairs(job_features(candidates), view(spark, folder, "profiles")), now())
    return M.top_recommendations(scored).select("user_id", "career_track", "job_id", "title", "score", "position")


@query("tier_order", "SELECT job_id, CASE tier WHEN 'top_match' THEN 5 WHEN 'strong_match' THEN 4 WHEN 'good_match' THEN 3 WHEN 'low_match' THEN 2 WHEN 'stretch' THEN 1 ELSE 0 END AS tier_rank FROM @@rankings")
def tier_order(spark, folder):
    return view(spark, folder, "rankings").select("job_id", G.tier_order(F.col("tier")).alias("tier_rank"))


@query("engine_top20", """WITH r AS (SELECT p.user_id, p.job_id, p.score AS v1, r.score AS v2, r.eligibility_state, CASE r.tier WHEN 'top_match' THEN 5 WHEN 'strong_match' THEN 4 WHEN 'good_match' THEN 3 WHEN 'low_match' THEN 2 WHEN 'stretch' THEN 1 ELSE 0 END AS k FROM @@postings p JOIN @@rankings r USING (job_id))
SELECT * FROM (SELECT 'v1' AS engine, user_id, job_id, v1 AS score, row_number() OVER (PARTITION BY user_id ORDER BY v1 DESC, job_id)::int AS position FROM r) WHERE position <= 20
UNION ALL SELECT * FROM (SELECT 'v2', user_id, job_id, v2, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, v2 DESC, job_id)::int AS position FROM r WHERE eligibility_state <> 'excluded') WHERE position <= 20""")
def engine_top20(spark, folder):
    ranked = view(spark, folder, "rankings").select("job_id", F.col("score").alias("v2"), "eligibility_state", G.tier_order(F.col("tier")).alias("k"))
    rows = view(spark, folder, "postings").select("user_id", "job_id", F.col("score").alias("v1")).join(ranked, "job_id")
    first = M.top(rows, [F.col("v1").desc(), F.col("job_id")], ["user_id"], 20).select(F.lit("v1").alias("engine"), "user_id", "job_id", F.col("v1").alias("score"), "position")
    second = M.top(rows.filter("eligibility_state <> 'excluded'"), [F.col("k").desc(), F.col("v2").desc(), F.col("job_id")], ["user_id"], 20)
    return first.union(second.select(F.lit("v2"), "user_id", "job_id", "v2", "position"))


@query("skills_union", """SELECT user_id, career_track, array_to_string(list_distinct(list_transform(list_concat(skills, resume_skills), lambda v: lower(v))), '|') IS NOT NULL AS known,
  len(list_distinct(list_transform(list_concat(skills, resume_skills), lambda v: lower(v))))::int AS size, array_to_string(list_filter(list_concat(skills, resume_skills), lambda v, i: list_position(list_transform(list_concat(skills, resume_skills), lambda s: lower(s)), lower(v)) = i), '|') AS skills FROM @@profiles""")
def skills_union(spark, folder):
    from vacantia.operators.profiles import ordered_union

    merged = ordered_union(F.col("skills"), F.col("resume_skills"))
    return view(spark, folder, "profiles").select("user_id", "career_track", F.lit(True).alias("known"), F.size(merged).alias("size"), joined(merged).alias("skills"))


STATE_FIELDS = ("desired_titles", "preferred_locations", "preferred_work_modes", "keywords", "excluded_keywords", "auto_apply_threshold")


def _default_sql(field):
    def lit(v):
        return "[" + ", ".join(K.text(x) for x in v) + "]" if isinstance(v, tuple) else str(v)
    return "CASE t.career_track " + " ".join(f"WHEN '{t}' THEN {lit(v[field])}" for t, v in L.TRACK_DEFAULTS.items()) + " END"


SAVED = "sv AS (SELECT * FROM @@profiles WHERE NOT (user_id % 3 = 1 AND career_track = 'industrial_engineering'))"


@query("track_state_merge", f"""WITH {SAVED}, u AS (SELECT user_id, max(CASE WHEN active_track IN {K.names(L.TRACKS)} THEN active_track ELSE '{L.CS}' END) AS cur FROM sv GROUP BY 1),
t AS (SELECT user_id, cur, unnest([{', '.join(K.text(x) for x in L.TRACKS)}]) AS career_track FROM u)
SELECT t.user_id, t.career_track, t.cur = t.career_track AS is_active, {', '.join(f"array_to_string(coalesce(sv.{f}, {_default_sql(f)}), '|') AS {f}" for f in STATE_FIELDS[:-1])}, coalesce(sv.auto_apply_threshold, {_default_sql('auto_apply_threshold')})::int AS auto_apply_threshold
FROM t LEFT JOIN sv ON sv.user_id = t.user_id AND sv.career_track = t.career_track""")
def track_state_merge(spark, folder):
    saved = view(spark, folder, "profiles").filter(~((F.col("user_id") % 3 == 1) & (F.col("career_track") == L.IEM)))
    rows = M.track_state_merge(saved, STATE_FIELDS)
    return rows.withColumns({f: joined(F.col(f)) for f in STATE_FIELDS[:-1]})


# (config id, overrides); some of them break a rule on purpose.
CONFIGS = (
    (0, {}), (1, {"role_weight": 25, "skills_weight": 50}), (2, {"role_weight": 50}), (3, {"top_match_threshold": 70, "strong_match_threshold": 60, "good_match_threshold": 50}),
    (4, {"exclude_experience_gap": 1}), (5, {"maximum_job_age_days": 20, "required_skill_share": 0.5, "preferred_skill_share": 0.5}), (6, {"good_match_threshold": 85}), (7, {"required_skill_share": 0.9}),
    (8, {"strict_location": True, "realistic_experience_gap": 0, "exclude_experience_gap": 6}), (9, {"maximum_job_age_days": 400}),
)
CONFIG_FIELDS = tuple(k for k in V2.DEFAULT_CONFIG if k != "employment_types")


def _config_rows():
    return [(i, *[({**V2.DEFAULT_CONFIG, **o})[f] for f in CONFIG_FIELDS]) for i, o in CONFIGS]


def _sweep_sql():
    def lit(v):
        return str(v).lower() if isinstance(v, bool) else f"{v}::double" if isinstance(v, float) else str(v)
    rows = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in _config_rows())
    w = " + ".join(V2.WEIGHTS)
    bad = f"""CASE WHEN {w} <> 100 OR least({', '.join(V2.WEIGHTS)}) < 0 OR greatest({', '.join(V2.WEIGHTS)}) > 100 THEN 'weights' END,
      CASE WHEN NOT (realistic_experience_gap >= 0 AND realistic_experience_gap <= stretch_experience_gap AND stretch_experience_gap < exclude_experience_gap) THEN 'experience_gaps' END,
      CASE WHEN maximum_job_age_days NOT BETWEEN 1 AND 365 THEN 'age' END,
      CASE WHEN NOT (100 >= top_match_threshold AND top_match_threshold > strong_match_threshold AND strong_match_threshold > good_match_threshold AND good_match_threshold > low_match_threshold AND low_match_threshold >= 0) THEN 'thresholds' END,
      CASE WHEN abs(required_skill_share + preferred_skill_share - 1) > 0.001 THEN 'shares' END"""
    cfg = {k: k for k in ("role_weight", "skills_weight", "requirements_weight", "preferences_weight", "required_skill_share")}
    cfg |= {"top": "top_match_threshold", "strong": "strong_match_threshold", "good": "good_match_threshold"}
    return f"""WITH {S.eligibility_ctes()}, k0 AS (SELECT * FROM (VALUES {rows}) v(config_id, {', '.join(CONFIG_FIELDS)})),
cg AS (SELECT *, array_to_string(list_filter([{bad}], lambda v: v IS NOT NULL), '|') AS violations FROM k0),
sx AS (SELECT el.* EXCLUDE (experience_status, recency_status, state), cg.* EXCLUDE (violations), CASE WHEN need IS NULL THEN 'unknown' WHEN len(options) > 0 THEN experience_status WHEN gap_raw <= realistic_experience_gap THEN 'match' WHEN gap_raw < exclude_experience_gap THEN 'stretch' ELSE 'mismatch' END AS experience_status,
  CASE WHEN age IS NULL THEN 'unknown' WHEN age <= maximum_job_age_days THEN 'fresh' ELSE 'old' END AS recency_status FROM el, cg WHERE violations = ''),
sy AS (SELECT *, CASE WHEN track_status = 'mismatch' OR exclusion IS NOT NULL OR experience_status = 'mismatch' OR seniority_status = 'mismatch' OR recency_status = 'old' OR (strict_location AND location_status = 'preference_mismatch') THEN 'excluded'
   WHEN experience_status = 'stretch' OR seniority_status = 'stretch' THEN 'stretch' ELSE 'realistic' END AS state FROM sx),
{S.v2_parts('sy', cfg)}, n AS (SELECT config_id, tier, count(*) AS postings, sum(score)::bigint AS total_score FROM v2 GROUP BY ALL)
SELECT cg.config_id, violations, tier, coalesce(postings, 0) AS postings, coalesce(total_score, 0) AS total_score FROM cg LEFT JOIN n USING (config_id)"""


@query("ranking_sweep", _sweep_sql())
def ranking_sweep(spark, folder):
    """Every posting under every valid configuration: text features are computed once, configurations are exploded onto them."""
    kinds = {bool: "boolean", int: "int", float: "double"}
    schema = "config_id int, " + ", ".join(f"cfg_{f} {kinds[type(V2.DEFAULT_CONFIG[f])]}" for f in CONFIG_FIELDS)
    configs = spark.createDataFrame(_config_rows(), schema).withColumn("violations", V2.config_violations(V2.column_config()))
    literal = lambda row: F.struct(F.lit(row[0]).alias("config_id"), *[F.lit(v).alias(f"cfg_{f}") for f, v in zip(CONFIG_FIELDS, row[1:])])
    broken = configs.select("config_id", joined(F.col("violations")).alias("violations"))
    valid = V2.config_violations(V2.column_config())
    rows = pairs(spark, folder).withColumn("_c", F.explode(F.array(*[literal(r) for r in _config_rows()]))).select("*", "_c.*").drop("_c").filter(F.size(valid) == 0)
    scored = V2.score_v2(rows, now(), V2.column_config()).groupBy("config_id", "tier").agg(F.count("*").alias("postings"), F.sum("score").alias("total_score"))
    return broken.join(scored, "config_id", "left").select("config_id", "violations", "tier", F.coalesce("postings", F.lit(0)).alias("postings"), F.coalesce("total_score", F.lit(0)).alias("total_score"))


def _digest(parts):
    return "sha256(" + " || chr(31) || ".join(f"coalesce({p}, '')" for p in parts) + ")"


JOB_FP = _digest(["career_track", "title", "description", "location", "workplace", "published_at::varchar"])
PROFILE_FP = _digest(["career_track", "CASE WHEN years_experience <> 0 THEN years_experience::varchar END", *[f"array_to_string({n}, '|')" for n in ("years_options", "skills", "desired_titles", "preferred_locations", "preferred_work_modes", "keywords", "excluded_keywords")],
                      "CASE WHEN work_authorization THEN 'True' END", "CASE WHEN needs_sponsorship THEN 'True' END"])


@query("fingerprints", f"SELECT 'job' AS kind, job_id::varchar AS id, {JOB_FP} AS fingerprint FROM @@postings UNION ALL SELECT 'profile', user_id::varchar || career_track, {PROFILE_FP} FROM @@profiles")
def fingerprints(spark, folder):
    jobs = view(spark, folder, "postings").select(F.lit("job").alias("kind"), F.col("job_id").cast("string").alias("id"), G.job_fingerprint().alias("fingerprint"))
    return jobs.union(view(spark, folder, "profiles").select(F.lit("profile"), F.concat(F.col("user_id").cast("string"), "career_track"), G.profile_fingerprint()))


def stored_rankings(spark, folder):
    """Rankings with the fingerprints of the time they were made (some of them outdated)."""
    jobs = view(spark, folder, "postings").select("job_id", "user_id", "career_track", G.job_fingerprint().alias("job_fingerprint"))
    people = view(spark, folder, "profiles").select("user_id", "career_track", G.profile_fingerprint().alias("profile_fingerprint"))
    rows = view(spark, folder, "rankings").drop("user_id").join(jobs, "job_id").join(people, ["user_id", "career_track"])
    rows = rows.filter("job_id % 37 <> 0")
    return rows.withColumns({"job_fingerprint": F.when(F.col("job_id") % 19 == 0, "old").otherwise(F.col("job_fingerprint")),
                             "profile_fingerprint": F.when(F.col("job_id") % 31 == 0, "old").otherwise(F.col("profile_fingerprint"))})


STALE = """st AS (SELECT r.job_id, p.user_id, p.career_track, r.score, r.tier, r.error, CASE WHEN r.job_id % 37 = 0 THEN 'missing' WHEN r.stale THEN 'stale' WHEN r.error <> '' THEN 'error' WHEN r.engine_version <> 2 THEN 'engine_version'
  WHEN r.config_version <> 3 THEN 'config_version' WHEN r.job_id % 31 = 0 THEN 'profile' WHEN r.job_id % 19 = 0 THEN 'job' END AS reason FROM @@rankings r JOIN @@postings p USING (job_id) JOIN @@profiles q ON q.user_id = p.user_id AND q.career_track = p.career_track)"""


@query("stale_rankings", f"WITH {STALE} SELECT job_id, user_id, career_track, reason FROM st")
def stale_rankings(spark, folder):
    return G.stale_rankings(stored_rankings(spark, folder), view(spark, folder, "postings"), view(spark, folder, "profiles"), 3).select("job_id", "user_id", "career_track", "reason")


@query("rerank_incremental", f"WITH {S.v2_ctes()}, {STALE} SELECT st.user_id, st.job_id, 'v2' AS engine, 2 AS engine_version, 3 AS config_version, CASE WHEN reason IS NULL THEN st.score ELSE v2.score END AS score, CASE WHEN reason IS NULL THEN st.tier ELSE v2.tier END AS tier, '' AS error, reason IS NOT NULL AS reranked FROM st JOIN v2 USING (job_id)")
def rerank_incremental(spark, folder):
    postings, profiles, stored = view(spark, folder, "postings"), view(spark, folder, "profiles"), stored_rankings(spark, folder)
    stale = G.stale_rankings(stored, postings, profiles, 3)
    rank = lambda jobs: V2.score_v2(profile_job_pairs(job_features(jobs), profiles), now())
    rows = G.rerank_incremental(stored, postings, stale, rank, now(), 3)
    return rows.select("user_id", "job_id", "engine", "engine_version", "config_version", "score", "tier", "error", "reranked")


@query("engine_compare", f"""WITH {S.v1_ctes()}, {S.eligibility_ctes().split(S.PAIR_CTE + ',', 1)[1]}, {S.v2_parts('el', S.DEFAULT)},
x AS (SELECT v1.user_id, v1.career_track, v1.job_id, v1.score AS v1_score, v2.score AS v2_score, v2.tier, v2.state AS eligibility, row_number() OVER (PARTITION BY v1.user_id, v1.career_track ORDER BY v1.score DESC, v1.job_id) AS position FROM v1 JOIN v2 USING (job_id) WHERE v1.is_active)
SELECT user_id, career_track, job_id, v1_score, v2_score, v2_score - v1_score AS delta, tier, eligibility FROM x WHERE position <= 20""")
def engine_compare(spark, folder):
    rows = pairs(spark, folder).filter("is_active")
    rows = V1.score_v1(rows, now()).withColumnRenamed("score", "v1_score").drop("reasons", "breakdown", "experience_min", "experience_max")
    both = V2.score_v2(rows, now()).withColumnRenamed("score", "v2_score")
    best = M.top(both.select("user_id", "career_track", "job_id", "v1_score", "v2_score", "tier", F.col("eligibility_state").alias("eligibility")), [F.col("v1_score").desc(), F.col("job_id")], ["user_id", "career_track"], 20)
    return best.withColumn("delta", F.col("v2_score") - F.col("v1_score")).drop("position")


@query("auto_queue_select", f"""WITH {RESUME_PAIRS} SELECT js.job_id, js.user_id, by_overlap AS resume_id FROM js JOIN @@profiles q ON q.user_id = js.user_id AND q.career_track = js.career_track LEFT JOIN br USING (job_id)
WHERE js.is_active AND js.status = 'new' AND q.auto_submit_enabled AND js.score >= q.auto_apply_threshold AND NOT EXISTS (SELECT 1 FROM @@applications a WHERE a.job_id = js.job_id)""")
def auto_queue_select(spark, folder):
    limits = view(spark, folder, "profiles").filter("auto_submit_enabled").select("user_id", "career_track", "auto_apply_threshold")
    fresh = job_skills(spark, folder).filter("is_active AND status = 'new'").join(limits, ["user_id", "career_track"]).filter("score >= auto_apply_threshold")
    fresh = fresh.join(view(spark, folder, "applications").select("job_id"), "job_id", "left_anti").select("job_id", "user_id", "career_track", "skills")
    return M.best_resume(fresh, view(spark, folder, "resumes"), "overlap").select("job_id", "user_id", F.col("best_resume").alias("resume_id"))


READY = f"""rj AS (SELECT p.*, q.full_name, q.email, q.phone, q.linkedin_url, q.cv_path, {K.ats_family('p.apply_url', 's.kind')} AS adapter FROM @@postings p LEFT JOIN @@sources s ON s.source_id = p.source_id
  JOIN @@profiles q ON q.user_id = p.user_id AND q.career_track = p.career_track),
ry AS (SELECT *, list_filter([CASE WHEN trim(coalesce(full_name, '')) = '' THEN 'full_name' END, CASE WHEN trim(coalesce(email, '')) = '' THEN 'email' END, CASE WHEN trim(coalesce(phone, '')) = '' THEN 'phone' END,
  CASE WHEN trim(coalesce(cv_path, '')) = '' THEN 'resume' END, CASE WHEN NOT regexp_matches(apply_url, '^https?://[^/]') THEN 'apply_url' END], lambda v: v IS NOT NULL) AS missing, adapter IN {K.AUTO_FAMILIES} AS auto_supported FROM rj),
rz AS (SELECT *, len(missing) = 0 AND auto_supported AS ready FROM ry)"""


def ready_jobs(spark, folder):
    people = view(spark, folder, "profiles").select("user_id", "career_track", "full_name", "email", "phone", "linkedin_url", F.col("cv_path").alias("resume_path"))
    rows = U.with_adapter(view(spark, folder, "postings"), view(spark, folder, "sources")).join(people, ["user_id", "career_track"])
    return G.readiness(rows)


@query("submission_readiness", f"""WITH {READY} SELECT job_id, {K.joined('missing')} AS missing, ready, array_to_string(list_filter([CASE WHEN linkedin_url = '' THEN 'no_linkedin' END, CASE WHEN adapter = 'workday' THEN 'workday_account' END, CASE WHEN NOT auto_supported THEN 'no_automatic_submit' END, 'live_questions'], lambda v: v IS NOT NULL), '|') AS warnings FROM rz""")
def submission_readiness(spark, folder):
    return ready_jobs(spark, folder).select("job_id", joined(F.col("missing")).alias("missing"), "ready", joined(F.col("warnings")).alias("warnings"))


CAMPAIGN = f"""{READY}, ca AS (SELECT c.campaign_id, c.daily_cap, c.budget_cap, c.spent, rz.*, CASE WHEN list_contains(c.blocked_companies, lower(rz.company)) THEN 'blocked_company' WHEN a.status IN ('submitted', 'verification_pending', 'applying', 'queued') THEN 'already_in_pipeline'
  WHEN NOT rz.ready THEN 'profile_incomplete' END AS reason FROM @@campaigns c JOIN rz ON rz.user_id = c.user_id AND rz.career_track = c.career_track LEFT JOIN @@applications a ON a.job_id = rz.job_id WHERE rz.is_active AND rz.score >= c.min_score AND rz.status IN ('new', 'saved', 'failed')),
cb AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY campaign_id ORDER BY score DESC, published_at DESC NULLS LAST, discovered_at DESC, job_id DESC) AS k FROM ca),
cs AS (SELECT campaign_id, job_id, CASE WHEN reason IS NOT NULL THEN reason WHEN k > greatest(0, least(daily_cap, budget_cap - spent)) THEN 'daily_or_budget_cap' ELSE 'selected' END AS outcome FROM cb)"""


def campaign_outcomes(spark, folder):
    campaigns = view(spark, folder, "campaigns").drop("active")
    applied = view(spark, folder, "applications").select("job_id", F.col("status").alias("application_status"))
    jobs = ready_jobs(spark, folder).filter(F.col("is_active") & F.col("status").isin("new", "saved", "failed"))
    candidates = jobs.join(campaigns, ["user_id", "career_track"]).filter("score >= min_score").join(applied, "job_id", "left")
    return G.campaign_select(candidates)


@query("campaign_select", f"WITH {CAMPAIGN} SELECT campaign_id, job_id, outcome FROM cs")
def campaign_select(spark, folder):
    return campaign_outcomes(spark, folder)


@query("campaign_runs", f"""WITH {CAMPAIGN}, n AS (SELECT campaign_id, count_if(outcome = 'selected')::bigint AS selected, count_if(outcome <> 'selected')::bigint AS skipped FROM cs GROUP BY 1)
SELECT campaign_id, selected, skipped, row_number() OVER (ORDER BY campaign_id DESC) AS newest_first FROM n""")
def campaign_runs(spark, folder):
    from vacantia.operators.ordering import positions

    counts = campaign_outcomes(spark, folder).groupBy("campaign_id").agg(F.count_if(F.expr("outcome = 'selected'")).alias("selected"), F.count_if(F.expr("outcome <> 'selected'")).alias("skipped"))
    return positions(counts, [F.col("campaign_id").desc()], name="newest_first")


@query("campaign_activate", f"""WITH {CAMPAIGN}, q AS (SELECT cs.campaign_id, count(*) AS queued FROM cs JOIN rz USING (job_id) WHERE outcome = 'selected' AND rz.job_id % 10 <> 1 GROUP BY 1)
SELECT c.campaign_id, coalesce(q.queued, 0) AS queued, (c.spent + coalesce(q.queued, 0))::bigint AS spent FROM @@campaigns c LEFT JOIN q USING (campaign_id)""")
def campaign_activate(spark, folder):
    """Selected postings are checked again against the current state (some went inactive since the preview)."""
    from vacantia.operators.funnel import campaign_activate as activate

    current = ready_jobs(spark, folder).withColumn("is_active", F.col("is_active") & (F.col("job_id") % 10 != 1))
    applied = view(spark, folder, "applications").select("job_id", F.col("status").alias("application_status"))
    selected = campaign_outcomes(spark, folder).filter("outcome = 'selected'")
    return activate(selected, current.join(applied, "job_id", "left"), view(spark, folder, "campaigns"))
