"""Queries for filters, reconciliation, duplicates, retention and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import lexicons as L
from vacantia.functions.dates import timestamp
from vacantia.functions import features as X, locations as P
from vacantia.operators import catalogue as C, filters as R, quality as Q
from vacantia.plans import duck as K, duck_scoring as S
from vacantia.plans.fixtures import NOW, spread, table, view
from vacantia.plans.registry import query


def now():
    return timestamp(NOW)


@query("filter_region", f"SELECT job_id, location FROM @@postings WHERE {K.in_region('location')}")
def filter_region(spark, folder):
    return R.filter_region(view(spark, folder, "postings")).select("job_id", "location")


EXCLUSION = (f"coalesce('excluded seniority: ' || list_filter({S.LEVELS}, lambda v: list_contains(levels, v) AND list_contains(excluded_levels, v))[1], "
             f"'excluded keyword: ' || list_filter(excluded_terms, lambda v: {S.term_in_title('low_title', 'v')})[1])")


def judge_ctes(source: str, name: str) -> str:
    return f"""{name}0 AS (SELECT x.*, lower(title) AS low_title, lower(description) AS low_body, {K.keys('lower(title)', L.SENIORITY_LEVELS, K.plain)} AS levels,
   excluded_levels, excluded_terms FROM {source} x LEFT JOIN prof USING (user_id, career_track)),
{name} AS MATERIALIZED (SELECT * EXCLUDE (levels, excluded_levels, excluded_terms), {EXCLUSION} AS exclusion, {K.in_region('location')} AS in_region,
   starts_with({K.track_verdict('low_title', 'low_body', 'career_track')}, 'true') AS on_track FROM {name}0)"""


@query("filter_exclusions", f"WITH {S.profile_ctes()}, {judge_ctes('@@postings', 'j')} SELECT job_id, exclusion FROM j")
def filter_exclusions(spark, folder):
    return R.with_exclusion(view(spark, folder, "postings"), view(spark, folder, "profiles")).select("job_id", "exclusion")


def _track(key, fn, track):
    sql = f"WITH p AS (SELECT job_id, lower(title) AS t, lower(description) AS d FROM @@postings), v AS (SELECT job_id, {K.track_verdict('t', 'd', K.text(track))} AS v FROM p) SELECT job_id, starts_with(v, 'true') AS relevant, split_part(v, ':', 2) AS reason FROM v"

    @query(key, sql)
    def run(spark, folder):
        verdict = fn(F.col("title"), F.col("description")).alias("v")
        return spread(view(spark, folder, "postings")).select("job_id", verdict).select("job_id", "v.*")


for _key, _fn, _name in (("track_cs", X.track_cs, L.CS), ("track_ee", X.track_ee, L.EE), ("track_iem", X.track_iem, L.IEM)):
    _track(_key, _fn, _name)


@query("jobs_search", f"SELECT job_id, title FROM @@postings WHERE career_track = '{L.CS}' AND score >= 40 AND is_active AND status = 'new' AND (title ILIKE '%engineer%' OR company ILIKE '%engineer%' OR description ILIKE '%engineer%')")
def jobs_search(spark, folder):
    return R.jobs_search(view(spark, folder, "postings"), L.CS, 40, "new", "engineer").select("job_id", "title")


@query("tenant_scope", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def tenant_scope(spark, folder):
    return R.scoped(table(spark, folder, "orders"), 7, "o_custkey").select("o_orderkey", "o_totalprice")


@query("source_eligible", f"SELECT source_id, name FROM @@sources WHERE enabled AND kind <> 'demo' AND career_track = '{L.CS}' AND (disabled_until IS NULL OR disabled_until <= NOW)")
def source_eligible(spark, folder):
    return R.source_eligible(view(spark, folder, "sources"), L.CS, now()).select("source_id", "name")


SUBMITTED = f"(a.submitted_at IS NOT NULL OR a.status IN {K.names(L.SUBMITTED_STATUSES)})"


@query("history_visible", f"SELECT p.job_id, a.application_id, p.is_active OR ({SUBMITTED} AND coalesce(p.removed_at, p.updated_at) >= NOW - to_days(30)) AS visible FROM @@postings p JOIN @@applications a USING (job_id)")
def history_visible(spark, folder):
    rows = R.job_applications(view(spark, folder, "postings"), view(spark, folder, "applications"))
    return rows.select("job_id", "application_id", R.history_visible(now()).alias("visible"))


RECONCILE = f"""{S.profile_ctes()}, {judge_ctes('@@snap_prev', 'pv')}, {judge_ctes('@@snap_curr', 'cu')},
cl AS (SELECT source_id, external_id, bool_or(in_region) AS listed, bool_or(in_region AND exclusion IS NULL AND on_track) AS ok FROM cu GROUP BY ALL),
fo AS (SELECT source_id, external_id, is_active, in_region, exclusion, on_track, in_region IS NOT NULL AS stored, coalesce(listed, false) AS listed, coalesce(ok, false) AS ok
   FROM (SELECT source_id, external_id, is_active, in_region, exclusion, on_track FROM pv) a FULL JOIN cl b USING (source_id, external_id)),
re AS (SELECT *, CASE WHEN stored AND NOT ok THEN CASE WHEN NOT in_region THEN 'outside_region' WHEN exclusion IS NOT NULL THEN 'hard_exclusion' WHEN NOT on_track THEN 'track_mismatch' WHEN NOT listed THEN 'no_longer_listed' END END AS reason FROM fo),
rec AS (SELECT source_id, external_id, reason, CASE WHEN ok AND NOT stored THEN 'insert' WHEN ok AND NOT is_active THEN 'reactivate' WHEN ok THEN 'update' WHEN reason IS NOT NULL THEN 'remove' WHEN stored THEN 'keep' ELSE 'skip' END AS action FROM re)"""


def snapshots(spark, folder):
    return spread(view(spark, folder, "snap_prev")), spread(view(spark, folder, "snap_curr")), view(spark, folder, "profiles")


@query("snapshot_reconcile", f"WITH {RECONCILE} SELECT source_id, external_id, action, reason FROM rec")
def snapshot_reconcile(spark, folder):
    return C.snapshot_reconcile(*snapshots(spark, folder))


@query("removal_reason", f"WITH {RECONCILE} SELECT source_id, external_id, reason FROM rec WHERE reason IS NOT NULL")
def removal_reason(spark, folder):
    return C.snapshot_reconcile(*snapshots(spark, folder)).filter("reason IS NOT NULL").select("source_id", "external_id", "reason")


def _clean(col):
    step = f"lower(coalesce({col}, ''))"
    for _ in range(2):
        step = rf"regexp_replace({step}, '(^|[^\p{{L}}\p{{N}}_])(ltd|inc|corp|corporation|israel|ישראל)($|[^\p{{L}}\p{{N}}_])', '\1 \3', 'g')"
    return f"trim(regexp_replace({step}, '[^a-z0-9א-ת+#]+', ' ', 'g'))"


FINGERPRINT = f"{_clean('title')} || '|' || {_clean('company')} || '|' || replace({_clean('location')}, 'tel aviv yafo', 'tel aviv')"
ARRIVALS = f"{S.profile_ctes()}, {judge_ctes('(SELECT * FROM @@snap_curr c WHERE NOT EXISTS (SELECT 1 FROM @@snap_prev p WHERE p.source_id = c.source_id AND p.external_id = c.external_id))', 'cu')}, ar AS (SELECT * FROM cu WHERE in_region AND exclusion IS NULL AND on_track)"


@query("duplicate_merge", f"""WITH {ARRIVALS},
al AS (SELECT user_id, {FINGERPRINT} AS fp, 0 AS rank, discovered_at, source_id, external_id, apply_url FROM @@snap_prev WHERE is_active
  UNION ALL SELECT user_id, {FINGERPRINT}, 1, NULL, source_id, external_id, apply_url FROM ar),
wi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, fp ORDER BY rank, discovered_at, source_id, external_id, apply_url) AS rn FROM al) WHERE rn = 1),
li AS (SELECT w.user_id, w.source_id AS job_source_id, w.external_id AS job_external_id, a.apply_url, a.source_id, a.external_id,
  row_number() OVER (PARTITION BY w.user_id, w.source_id, w.external_id, a.apply_url ORDER BY a.source_id, a.external_id) AS rn
  FROM al a JOIN wi w ON w.user_id = a.user_id AND w.fp = a.fp WHERE a.rank = 1 AND w.source_id <> a.source_id AND w.apply_url <> a.apply_url)
SELECT user_id, job_source_id, job_external_id, apply_url, source_id, external_id FROM li WHERE rn = 1""")
def duplicate_merge(spark, folder):
    prev, curr, profiles = snapshots(spark, folder)
    return C.duplicate_links(prev, C.new_arrivals(prev, curr, profiles))


ACTION = f"""CASE WHEN p.is_active THEN 'keep' WHEN a.application_id IS NOT NULL AND NOT {SUBMITTED} THEN 'delete' WHEN a.application_id IS NOT NULL AND p.removed_at IS NULL THEN 'start_clock'
  WHEN a.application_id IS NOT NULL THEN CASE WHEN p.removed_at < NOW - to_days(30) THEN 'delete' ELSE 'keep' END
  WHEN coalesce(p.removed_at, p.published_at, p.updated_at) < NOW - to_days(2) THEN 'delete' ELSE 'keep' END"""
PURGED = f"pu AS (SELECT p.job_id, a.application_id, {ACTION} AS action FROM @@postings p LEFT JOIN @@applications a USING (job_id))"


def purge(spark, folder):
    rows = R.job_applications(view(spark, folder, "postings"), view(spark, folder, "applications"), "left")
    return rows.withColumn("action", C.retention_action(now()))


@query("retention_purge", f"WITH {PURGED} SELECT job_id, application_id, action FROM pu")
def retention_purge(spark, folder):
    return purge(spark, folder).select("job_id", "application_id", "action")


@query("deactivate_or_delete", f"""SELECT p.job_id, CASE WHEN coalesce({SUBMITTED}, false) THEN 'inactive' ELSE 'deleted' END AS outcome,
  (CASE WHEN coalesce({SUBMITTED}, false) THEN CASE WHEN p.is_active OR p.removed_at IS NULL THEN NOW ELSE p.removed_at END END)::varchar AS removed_at
  FROM @@postings p LEFT JOIN @@applications a USING (job_id)""")
def deactivate_or_delete(spark, folder):
    rows = R.job_applications(view(spark, folder, "postings"), view(spark, folder, "applications"), "left")
    return C.deactivate_or_delete(rows, now()).select("job_id", "outcome", F.col("removed_at").cast("string").alias("removed_at"))


@query("cascade_delete", f"""WITH {PURGED}, de AS (SELECT job_id, application_id FROM pu WHERE action = 'delete')
SELECT 'application' AS child, count(*) AS kept FROM @@applications a WHERE job_id NOT IN (SELECT job_id FROM de)
UNION ALL SELECT 'ranking', count(*) FROM @@rankings WHERE job_id NOT IN (SELECT job_id FROM de)
UNION ALL SELECT 'blocker', count(*) FROM @@blockers WHERE application_id NOT IN (SELECT application_id FROM de WHERE application_id IS NOT NULL)""")
def cascade_delete(spark, folder):
    deleted = purge(spark, folder).filter("action = 'delete'")
    counted = lambda name, rows: rows.agg(F.lit(name).alias("child"), F.count("*").alias("kept"))
    return (counted("application", C.cascade_delete(view(spark, folder, "applications"), deleted, "job_id"))
            .union(counted("ranking", C.cascade_delete(view(spark, folder, "rankings"), deleted, "job_id")))
            .union(counted("blocker", C.cascade_delete(view(spark, folder, "blockers"), deleted, "application_id"))))


@query("purge_foreign", f"""WITH f AS (SELECT p.user_id, p.job_id, p.title, CASE WHEN coalesce({SUBMITTED}, false) THEN 'inactive' ELSE 'deleted' END AS outcome FROM @@postings p LEFT JOIN @@applications a USING (job_id)
  WHERE NOT {K.in_region('p.location')}) SELECT user_id, job_id, title, outcome FROM f""")
def purge_foreign(spark, folder):
    rows = R.job_applications(view(spark, folder, "postings"), view(spark, folder, "applications"), "left")
    return C.deactivate_or_delete(rows.filter(~P.in_region(F.col("location"))), now()).select("user_id", "job_id", "title", "outcome")


@query("bounded_details", f"""WITH {RECONCILE}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY external_id) AS position, count(*) OVER (PARTITION BY source_id) AS total FROM rec WHERE action = 'remove')
SELECT source_id, external_id, reason, position::int AS position, total, total > 100 AS truncated FROM r WHERE position <= 100""")
def bounded_details(spark, folder):
    removed = C.snapshot_reconcile(*snapshots(spark, folder)).filter("action = 'remove'").select("source_id", "external_id", "reason")
    return C.bounded_details(removed, [F.col("external_id")], ["source_id"])


@query("catalogue_delta", """SELECT coalesce(p.source_id, c.source_id) AS source_id, count(*) FILTER (c.external_id IS NULL) AS only_previous, count(*) FILTER (p.external_id IS NULL) AS only_current,
  count(*) FILTER (p.external_id IS NOT NULL AND c.external_id IS NOT NULL) AS in_both
FROM (SELECT DISTINCT source_id, external_id FROM @@snap_prev) p FULL JOIN (SELECT DISTINCT source_id, external_id FROM @@snap_curr) c ON p.source_id = c.source_id AND p.external_id = c.external_id GROUP BY 1""")
def catalogue_delta(spark, folder):
    prev = view(spark, folder, "snap_prev").select(*C.KEY).distinct()
    curr = view(spark, folder, "snap_curr").select(*C.KEY).distinct()
    tagged = (prev.exceptAll(curr).withColumn("side", F.lit("p")).union(curr.exceptAll(prev).withColumn("side", F.lit("c")))
              .union(prev.intersect(curr).withColumn("side", F.lit("b"))))
    side = lambda s, name: F.count_if(F.col("side") == s).alias(name)
    return tagged.groupBy("source_id").agg(side("p", "only_previous"), side("c", "only_current"), side("b", "in_both"))


# Batches with deliberate defects: the source number decides what is broken in it.
BATCH = """SELECT p.source_id, p.job_id,
  CASE p.source_id % 6 WHEN 1 THEN CASE WHEN p.job_id % 3 = 0 THEN 'bb661a53-79b8 459d-a8df-' || lpad(CAST(p.job_id AS STRING), 12, '0') ELSE p.title END WHEN 2 THEN 'Job  Details' WHEN 3 THEN 'Buyer' ELSE p.title END AS title,
  CASE WHEN p.source_id % 6 = 3 THEN 'Haifa' WHEN p.source_id % 6 = 5 THEN 'Israel' ELSE p.location END AS location,
  CASE WHEN p.source_id % 6 = 4 AND p.source_id % 4 = 0 THEN 'same' ELSE p.external_id END AS external_id,
  CASE WHEN p.source_id = 8 THEN 'Apply now' WHEN p.source_id = 14 AND p.job_id % 2 = 0 THEN '' ELSE p.description END AS description,
  CASE WHEN p.source_id = 10 THEN 'https://careers.acme.example/open?utm=' || CAST(p.job_id AS STRING) WHEN p.source_id = 6 THEN '' ELSE p.apply_url END AS apply_url
FROM @@postings p"""


def batches(spark, folder):
    from vacantia.plans.fixtures import render

    return spread(spark.sql(render(BATCH, "spark", folder)))


UUID = Q.UUID_TITLE
PROFILE = f"""b0 AS ({BATCH}), b1 AS (SELECT source_id, {K.squeeze('lower(title)')} AS title, {K.squeeze('lower(location)')} AS location, {K.squeeze('lower(external_id)')} AS external_id,
  trim(apply_url) AS url, {K.url_key('apply_url')} AS url_key, {K.clean_pairs('description')} AS cp FROM b0),
b2 AS (SELECT *, {K.quality(K.clean_text('cp'))} = 'missing' AS no_text FROM b1),
b3 AS (SELECT source_id, count(*) AS n, count_if(external_id = '' OR title = '' OR url = '')::bigint AS missing_core, count_if(regexp_matches(title, {K.text(UUID)}))::bigint AS uuid_titles,
  count_if(title IN {K.names(L.GENERIC_BATCH_TITLES)})::bigint AS generic_titles, count_if(no_text)::bigint AS missing_text, count_if(location IN {K.names(L.GENERIC_REGION_NAMES)})::bigint AS generic_locations,
  count(DISTINCT nullif(external_id, '')) AS id_distinct, count(DISTINCT nullif(url_key, '')) AS link_distinct FROM b2 GROUP BY 1),
ti AS (SELECT source_id, max(c) AS title_count FROM (SELECT source_id, title, count(*) AS c FROM b2 WHERE title <> '' GROUP BY ALL) GROUP BY 1),
lo AS (SELECT source_id, max(c) AS location_count FROM (SELECT source_id, location, count(*) AS c FROM b2 WHERE location <> '' GROUP BY ALL) GROUP BY 1),
bp AS (SELECT b3.*, coalesce(title_count, 0) AS title_count, coalesce(location_count, 0) AS location_count FROM b3 LEFT JOIN ti USING (source_id) LEFT JOIN lo USING (source_id))"""


@query("payload_quality", f"""WITH {PROFILE} SELECT source_id, n, missing_core, uuid_titles, generic_titles, missing_text, title_count, location_count, id_distinct, link_distinct, generic_locations,
CASE WHEN n >= 5 AND missing_core >= greatest(2, ceil(n * 0.20)) THEN 'missing_core' WHEN n >= 5 AND uuid_titles >= greatest(3, ceil(n * 0.25)) THEN 'uuid_titles'
 WHEN n >= 5 AND generic_titles >= greatest(3, ceil(n * 0.35)) THEN 'generic_titles' WHEN n >= 5 AND missing_text >= greatest(3, ceil(n * 0.5)) THEN 'missing_text'
 WHEN n >= 8 AND title_count >= 5 AND (title_count / n >= 0.8 OR (title_count / n >= 0.45 AND location_count / n >= 0.75)) THEN 'dominant_title'
 WHEN n >= 8 AND id_distinct > 0 AND id_distinct <= greatest(2, floor(n * 0.35)) THEN 'few_ids' WHEN n >= 8 AND link_distinct > 0 AND link_distinct <= greatest(2, floor(n * 0.35)) THEN 'few_links'
 WHEN n >= 20 AND generic_locations >= ceil(n * 0.8) THEN 'generic_region' END AS gate FROM bp""")
def payload_quality(spark, folder):
    rows = Q.payload_gate(Q.batch_profile(batches(spark, folder), ["source_id"]))
    return rows.select("source_id", "n", "missing_core", "uuid_titles", "generic_titles", "missing_text", "title_count", "location_count", "id_distinct", "link_distinct", "generic_locations", "gate")


@query("corruption_scan", f"""WITH {PROFILE}, g AS (SELECT source_id, count_if(location = 'israel')::bigint AS israel_only FROM b2 GROUP BY 1),
s AS (SELECT source_id, n, CASE WHEN uuid_titles >= greatest(3, n // 3) THEN 'uuid_titles' WHEN israel_only >= greatest(10, floor(n * 0.8)) THEN 'generic_locations'
  WHEN n >= 8 AND title_count >= greatest(5, floor(n * 0.45)) AND location_count >= greatest(5, floor(n * 0.75)) THEN 'dominant_title' END AS signature FROM bp JOIN g USING (source_id))
SELECT b.job_id, b.source_id, s.signature, CASE WHEN a.application_id IS NULL THEN 'delete' ELSE 'preserve' END AS action FROM b0 b JOIN s USING (source_id) LEFT JOIN @@applications a ON a.job_id = b.job_id WHERE s.signature IS NOT NULL""")
def corruption_scan(spark, folder):
    rows = batches(spark, folder)
    bad = Q.corruption_scan(rows, ["source_id"]).filter("signature IS NOT NULL").select("source_id", "signature")
    applied = view(spark, folder, "applications").select("job_id", "application_id")
    return rows.join(bad, "source_id").join(applied, "job_id", "left").select(
        "job_id", "source_id", "signature", F.when(F.col("application_id").isNull(), "delete").otherwise("preserve").alias("action"))


@query("scan_summary", f"""WITH {RECONCILE}, ag AS (SELECT source_id, count(*) AS collected, count_if(in_region) AS region_found, count_if(in_region AND exclusion IS NULL AND on_track) AS found FROM cu GROUP BY 1),
ch AS (SELECT source_id, count_if(action = 'insert') AS new, count_if(action IN ('update', 'reactivate')) AS updated, count_if(action = 'remove') AS removed FROM rec GROUP BY 1),
so AS (SELECT source_id, last_error <> '' AS failed FROM @@sources),
al AS (SELECT so.*, coalesce(collected, 0) AS collected, coalesce(region_found, 0) AS region_found, coalesce(found, 0) AS found, coalesce(new, 0) AS new, coalesce(updated, 0) AS updated, coalesce(removed, 0) AS removed FROM so LEFT JOIN ag USING (source_id) LEFT JOIN ch USING (source_id)),
su AS (SELECT source_id, sum(collected)::bigint AS collected, sum(region_found)::bigint AS region_found, sum(found)::bigint AS found, sum(collected - region_found)::bigint AS filtered_foreign, sum(region_found - found)::bigint AS filtered_mismatch,
  sum(new)::bigint AS new, sum(updated)::bigint AS updated, sum(removed)::bigint AS removed, count_if(failed)::bigint AS failed_sources, count(*) AS sources FROM al GROUP BY ROLLUP (source_id))
SELECT *, CASE WHEN sources = 0 THEN 'no_sources' WHEN failed_sources = 0 THEN 'ok' WHEN failed_sources < sources THEN 'partial' ELSE 'failed' END AS status FROM su""")
def scan_summary(spark, folder):
    prev, curr, profiles = snapshots(spark, folder)
    sources = view(spark, folder, "sources").select("source_id", (F.col("last_error") != "").alias("failed"))
    return Q.scan_summary(C.snapshot_reconcile(prev, curr, profiles), C.judged(curr, profiles), sources)


@query("track_audit", f"""WITH p AS (SELECT *, lower(title) AS t, lower(description) AS d FROM @@postings), v AS (SELECT user_id, career_track, is_active, {K.track_verdict('t', 'd', 'career_track')} AS v FROM p)
SELECT user_id, career_track, split_part(v, ':', 2) AS reason, count(*) AS postings, count_if(starts_with(v, 'false'))::bigint AS mismatches FROM v WHERE is_active GROUP BY ALL""")
def track_audit(spark, folder):
    rows = spread(view(spark, folder, "postings").filter("is_active")).withColumn("v", X.track_relevance(F.col("title"), F.col("description"), F.col("career_track")))
    return rows.groupBy("user_id", "career_track", F.col("v.reason").alias("reason")).agg(F.count("*").alias("postings"), F.count_if(~F.col("v.relevant")).alias("mismatches"))


@query("track_reconcile", f"""WITH p AS (SELECT *, lower(title) AS t, lower(description) AS d FROM @@postings), v AS (SELECT job_id, user_id, career_track, {K.track_verdict('t', 'd', 'career_track')} AS v FROM p)
SELECT v.job_id, v.career_track, CASE WHEN a.application_id IS NULL THEN 'delete' ELSE 'deactivate' END AS action FROM v LEFT JOIN @@applications a USING (job_id) WHERE starts_with(v, 'false')""")
def track_reconcile(spark, folder):
    rows = spread(view(spark, folder, "postings")).filter(~X.track_relevance(F.col("title"), F.col("description"), F.col("career_track"))["relevant"])
    applied = view(spark, folder, "applications").select("job_id", "application_id")
    return rows.select("job_id", "career_track").join(applied, "job_id", "left").select(
        "job_id", "career_track", F.when(F.col("application_id").isNull(), "delete").otherwise("deactivate").alias("action"))
