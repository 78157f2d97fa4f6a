"""Queries for the application funnel and source state."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions.dates import timestamp
from vacantia.operators import filters as R, funnel as U, source_state as Z
from vacantia.plans import duck as K
from vacantia.plans.fixtures import NOW, view
from vacantia.plans.registry import query

LATE = "2024-01-30 20:00:00"


def now():
    return timestamp(NOW)


def read_model(spark, folder, how="inner"):
    """Postings with application, adapter and source kind."""
    rows = R.job_applications(view(spark, folder, "postings"), view(spark, folder, "applications"), how)
    return U.with_adapter(rows, view(spark, folder, "sources"))


READ = f"""rm AS (SELECT p.*, a.application_id, a.status AS application_status, a.mode, a.submitted_at, a.started_at, a.reminder_at, a.updated_at AS application_updated_at, a.attempt_count,
  a.resume_id, a.answers, s.kind AS source_kind, s.identifier AS source_identifier, {K.ats_family('p.apply_url', 's.kind')} AS adapter
  FROM @@postings p JOIN @@applications a USING (job_id) LEFT JOIN @@sources s ON s.source_id = p.source_id),
rd AS (SELECT *, adapter IN {K.AUTO_FAMILIES} AS auto_supported FROM rm)"""


@query("latest_attempt", "SELECT application_id, attempt_id, attempt_number, status FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY started_at DESC, attempt_id DESC) AS rn FROM @@attempts) WHERE rn = 1")
def latest_attempt(spark, folder):
    return U.latest_attempt(view(spark, folder, "attempts")).select("application_id", "attempt_id", "attempt_number", "status")


@query("active_blocker", "SELECT application_id, blocker_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY created_at DESC, blocker_id DESC) AS rn FROM @@blockers WHERE status = 'open') WHERE rn = 1")
def active_blocker(spark, folder):
    return U.active_blocker(view(spark, folder, "blockers")).select("application_id", "blocker_id", "kind")


@query("auto_queue_order", f"""WITH {READ}, li AS (SELECT * FROM rd WHERE is_active AND mode = 'auto' AND auto_supported AND application_status IN ('queued', 'applying')),
ap AS (SELECT user_id, career_track, application_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, career_track ORDER BY coalesce(started_at, application_updated_at), application_id) AS rn FROM li WHERE application_status = 'applying') WHERE rn = 1),
qu AS (SELECT user_id, career_track, application_id, row_number() OVER (PARTITION BY user_id, career_track ORDER BY application_updated_at DESC, application_id DESC) AS position FROM li WHERE application_status = 'queued')
SELECT user_id, career_track, application_id, NULL::bigint AS position, 'current' AS place, NULL::varchar AS expected_start FROM ap
UNION ALL SELECT q.user_id, q.career_track, q.application_id, position, CASE WHEN position = 1 AND ap.application_id IS NULL THEN 'current' ELSE 'waiting' END, (NOW + to_minutes(greatest(2, 2 * position)))::varchar
FROM qu q LEFT JOIN ap ON ap.user_id = q.user_id AND ap.career_track = q.career_track""")
def auto_queue_order(spark, folder):
    return U.auto_queue(read_model(spark, folder), now()).withColumn("expected_start", F.col("expected_start").cast("string"))


@query("review_queue_next", f"""WITH {READ} SELECT user_id, career_track, arg_min(application_id, (application_updated_at, application_id)) FILTER (mode <> 'auto') AS next_review,
  arg_max(application_id, (application_updated_at, application_id)) FILTER (mode = 'auto' AND auto_supported) AS next_auto FROM rd WHERE is_active AND application_status = 'queued' GROUP BY ALL""")
def review_queue_next(spark, folder):
    return U.review_queue_next(read_model(spark, folder))


@query("stage_explain", f"""WITH {READ}, ob AS (SELECT DISTINCT application_id FROM @@blockers WHERE status = 'open'),
st AS (SELECT rd.*, ob.application_id IS NOT NULL AS blocked FROM rd LEFT JOIN ob ON ob.application_id = rd.application_id)
SELECT application_id, CASE application_status WHEN 'applying' THEN CASE WHEN blocked THEN 'stopped' ELSE 'in_progress' END WHEN 'queued' THEN CASE WHEN mode = 'auto' AND auto_supported THEN 'waiting_in_queue' ELSE 'not_in_auto_queue' END
  WHEN 'needs_input' THEN 'stopped' WHEN 'verification_pending' THEN 'awaiting_verification' ELSE application_status END AS stage,
  CASE application_status WHEN 'applying' THEN CASE WHEN blocked THEN 'user_answer' ELSE 'form_step' END WHEN 'queued' THEN CASE WHEN mode = 'auto' AND auto_supported THEN 'next_worker' ELSE 'manual_handling' END
  WHEN 'needs_input' THEN CASE WHEN blocked THEN 'question' ELSE 'user_answer' END WHEN 'verification_pending' THEN 'site_or_mail' WHEN 'failed' THEN 'retry' ELSE 'none' END AS waiting_for FROM st""")
def stage_explain(spark, folder):
    blocked = U.active_blocker(view(spark, folder, "blockers")).select("application_id", "blocker_id")
    rows = read_model(spark, folder).join(blocked, "application_id", "left")
    return rows.select("application_id", U.stage_explain(F.col("blocker_id").isNotNull()).alias("s")).select("application_id", "s.*")


EVENTS = """SELECT CASE WHEN e.event_id % 3 = 0 THEN 7 ELSE e.user_id END AS application_id, e.event_id, CAST(e.ts AS TIMESTAMP) AS ts,
  CASE e.event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'saved' WHEN 'click' THEN 'ghosted' ELSE 'submitted' END AS to_status,
  CASE e.event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'queued' WHEN 2 THEN 'saved' ELSE 'submitted' END AS from_status,
  CASE e.event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'started' WHEN 'view' THEN 'blocked' WHEN 'click' THEN 'recover' ELSE 'submitted' END AS result,
  e.event_id % 2 = 0 AS verified, e.event_id % 3 = 1 AS uncertain FROM @events e"""


def app_events(spark, folder):
    from vacantia.plans.fixtures import render

    return spark.sql(render(EVENTS, "spark", folder))


def by_time():
    return [F.col("ts"), F.col("event_id")]


@query("timeline", f"""WITH e AS ({EVENTS}), l AS (SELECT *, lag(to_status) OVER w AS expected_from, row_number() OVER (PARTITION BY application_id ORDER BY ts DESC, event_id DESC) AS newest_first FROM e WINDOW w AS (PARTITION BY application_id ORDER BY ts, event_id))
SELECT application_id, event_id, newest_first, expected_from, expected_from IS NULL OR expected_from = from_status AS continuous FROM l""")
def timeline(spark, folder):
    rows = U.timeline(app_events(spark, folder).select("application_id", "event_id", "ts", "to_status", "from_status"), by_time())
    return rows.select("application_id", "event_id", "newest_first", "expected_from", "continuous")


@query("status_change_events", f"""WITH e AS (SELECT * FROM ({EVENTS}) WHERE to_status IN {K.names(U.ALLOWED_STATUSES)}), l AS (SELECT *, lag(to_status) OVER (PARTITION BY application_id ORDER BY ts, event_id) AS before FROM e)
SELECT application_id, event_id, before AS from_status, to_status FROM l WHERE before IS DISTINCT FROM to_status""")
def status_change_events(spark, folder):
    rows = U.status_change_events(app_events(spark, folder).select("application_id", "event_id", "ts", "to_status"), by_time())
    return rows.select("application_id", "event_id", F.col("from_status_known").alias("from_status"), "to_status")


@query("funnel_fold", f"""WITH e AS ({EVENTS}), l AS (SELECT application_id, arg_max(struct_pack(result, verified, uncertain), (ts, event_id)) AS x, count_if(result = 'started') AS attempts, max(ts) FILTER (result = 'submitted' AND verified) AS lv FROM e GROUP BY 1),
s AS (SELECT *, CASE x.result WHEN 'submitted' THEN CASE WHEN x.verified THEN 'submitted' ELSE 'verification_pending' END WHEN 'blocked' THEN CASE WHEN x.uncertain THEN 'verification_pending' ELSE 'needs_input' END
  WHEN 'failed' THEN 'failed' WHEN 'recover' THEN CASE WHEN attempts < 3 THEN 'queued' ELSE 'needs_input' END ELSE 'applying' END AS status FROM l)
SELECT application_id, status, attempts::bigint AS attempts, (CASE WHEN status = 'submitted' THEN lv END)::varchar AS submitted_at FROM s""")
def funnel_fold(spark, folder):
    return U.funnel_fold(app_events(spark, folder)).withColumn("submitted_at", F.col("submitted_at").cast("string"))


@query("manual_submit", f"""WITH {READ} SELECT application_id, 'submitted' AS new_status, CASE mode WHEN 'review' THEN 'manual' ELSE mode END AS new_mode, coalesce(submitted_at, NOW)::varchar AS new_submitted_at, coalesce(ob.n, 0) AS closed_blockers
FROM rd LEFT JOIN (SELECT application_id, count(*) AS n FROM @@blockers WHERE status = 'open' GROUP BY 1) ob USING (application_id)""")
def manual_submit(spark, folder):
    opened = view(spark, folder, "blockers").filter("status = 'open'").groupBy("application_id").agg(F.count("*").alias("n"))
    rows = U.manual_submit(read_model(spark, folder), now()).join(opened, "application_id", "left")
    return rows.select("application_id", "new_status", "new_mode", F.col("new_submitted_at").cast("string").alias("new_submitted_at"), F.coalesce("n", F.lit(0)).alias("closed_blockers"))


@query("receipt_reconcile", f"""WITH {READ}, cm AS (SELECT application_id, blocker_id, page_url FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY created_at DESC, blocker_id DESC) AS rn FROM @@blockers WHERE status = 'open' AND kind = 'confirmation_missing') WHERE rn = 1)
SELECT application_id, blocker_id, 'submitted' AS new_status, CASE WHEN page_url LIKE '%leverAppId=%' THEN split_part(page_url, 'leverAppId=', 2) ELSE '' END AS external_id
FROM rd JOIN cm USING (application_id) WHERE application_status = 'verification_pending' AND adapter = 'lever' AND (page_url LIKE 'https://jobs.lever.co/%/thanks' OR page_url LIKE 'https://www.lever.co/hp-b?leverAppId=%')""")
def receipt_reconcile(spark, folder):
    rows = U.receipt_reconcile(read_model(spark, folder), view(spark, folder, "blockers"), now())
    return rows.select("application_id", "blocker_id", "new_status", "external_id")


REQUEUE_KIND = "CASE application_id % 3 WHEN 0 THEN 'submit_button_missing' WHEN 1 THEN 'application_form_missing' ELSE 'captcha' END"


@query("requeue_once", f"""WITH {READ}, bl AS (SELECT *, {REQUEUE_KIND} AS kind, attempt_count % 2 AS retries,
  CASE WHEN source_kind = 'greenhouse' THEN 'https://job-boards.greenhouse.io/' || regexp_replace(source_identifier, '^(?i)eu:', '') || '/jobs/' || external_id ELSE apply_url END AS native_url FROM rd),
pg AS (SELECT *, CASE WHEN application_id % 5 = 0 THEN native_url || '/' ELSE 'https://careers.acme.example/apply' END AS page_url FROM bl)
SELECT application_id, native_url, mode = 'auto' AND kind <> 'captcha' AND adapter = 'greenhouse' AND native_url <> apply_url AND rtrim(page_url, '/') <> rtrim(native_url, '/') AND retries < 1 AS requeue FROM pg""")
def requeue_once(spark, folder):
    rows = read_model(spark, folder)
    native = U.native_apply_url(F.col("source_kind"), F.col("source_identifier"), F.col("external_id"), F.col("apply_url"))
    way = F.col("application_id") % 3
    rows = rows.withColumns({
        "kind": F.when(way == 0, "submit_button_missing").when(way == 1, "application_form_missing").otherwise("captcha"),
        "page_url": F.when(F.col("application_id") % 5 == 0, F.concat(native, F.lit("/"))).otherwise("https://careers.acme.example/apply")})
    return U.requeue_once(rows, F.col("attempt_count") % 2).select("application_id", "native_url", "requeue")


HEALTH = """WITH RECURSIVE o AS (SELECT source_id, ts, outcome, row_number() OVER (PARTITION BY source_id ORDER BY ts, event_id) AS n FROM @@scan_log),
r AS (SELECT source_id, 0::bigint AS n, 0 AS f, 100 AS h, NULL::timestamp AS d FROM (SELECT DISTINCT source_id FROM o)
 UNION ALL SELECT r.source_id, r.n + 1, CASE WHEN outcome IN ('ok', 'deferred') THEN 0 ELSE f + 1 END,
  CASE outcome WHEN 'ok' THEN 100 WHEN 'deferred' THEN greatest(80, h) WHEN 'quality_failed' THEN least(h, 40) ELSE greatest(5, 100 - (f + 1) * 24) END,
  CASE WHEN outcome IN ('ok', 'deferred') OR f + 1 < 3 THEN NULL ELSE o.ts + to_hours(least(24, 2 * (f + 1))) END FROM r JOIN o ON o.source_id = r.source_id AND o.n = r.n + 1)
SELECT source_id, f::bigint AS consecutive_failures, h::int AS health_score, d::varchar AS disabled_until FROM r JOIN (SELECT source_id, max(n) AS n FROM o GROUP BY 1) m USING (source_id, n)"""


@query("source_health", HEALTH)
def source_health(spark, folder):
    return Z.source_health(view(spark, folder, "scan_log")).withColumn("disabled_until", F.col("disabled_until").cast("string"))


MANAGED = "(s.metadata LIKE '%\"preset\":\"recommended\"%' OR s.metadata LIKE '%duplicate_of%')"


@query("source_duplicates", f"""WITH b AS (SELECT source_id, min(source_id) OVER w AS canonical, count(*) OVER w AS n FROM @@sources WINDOW w AS (PARTITION BY user_id, career_track, kind, identifier)),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY career_track, lower(company_name) ORDER BY entry DESC) AS rn FROM @@catalogue) WHERE rn = 1),
c AS (SELECT s.source_id, s.user_id, s.career_track, lower(s.company_name) AS company, CASE WHEN s.kind = e.kind AND s.identifier = e.identifier THEN 0 WHEN s.name = e.name THEN 1 ELSE 2 END AS pref FROM @@sources s
  JOIN e ON e.career_track = s.career_track AND lower(e.company_name) = lower(s.company_name) WHERE {MANAGED}),
d AS (SELECT source_id, first_value(source_id) OVER (PARTITION BY user_id, career_track, company ORDER BY pref, source_id) AS canonical, count(*) OVER (PARTITION BY user_id, career_track, company) AS n FROM c)
SELECT source_id, canonical, 'board' AS rule FROM b WHERE n > 1 AND source_id <> canonical UNION SELECT source_id, canonical, 'company' FROM d WHERE n > 1 AND source_id <> canonical""")
def source_duplicates(spark, folder):
    return Z.source_duplicates(view(spark, folder, "sources"), view(spark, folder, "catalogue"))


@query("scan_state", f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, career_track ORDER BY run_id DESC) AS rn FROM @@scan_runs) WHERE rn = 1),
s AS (SELECT *, status IN ('queued', 'running') AS active, TIMESTAMP '{LATE}' - requested_at < INTERVAL 2 HOUR AS young FROM l)
SELECT user_id, career_track, run_id, active AND young AS running, CASE WHEN active AND NOT young THEN 'failed' ELSE status END AS state, CASE WHEN active AND NOT young THEN 'stopped before completion' ELSE '' END AS error FROM s""")
def scan_state(spark, folder):
    return Z.scan_state(view(spark, folder, "scan_runs"), timestamp(LATE)).select("user_id", "career_track", "run_id", "running", "state", "error")


@query("scan_due", f"""WITH u AS (SELECT DISTINCT user_id, career_track FROM @@profiles), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, career_track ORDER BY run_id DESC) AS rn FROM @@scan_runs) WHERE rn = 1),
s AS (SELECT user_id, career_track, max(last_scanned_at) AS t FROM @@sources WHERE enabled AND kind <> 'demo' GROUP BY ALL)
SELECT u.user_id, u.career_track, NOT (coalesce(l.finished_at >= TIMESTAMP '2024-01-30 06:00:00' AND l.status IN ('ok', 'partial'), false)) AND NOT (l.run_id IS NULL AND coalesce(s.t >= TIMESTAMP '2024-01-30 06:00:00', false)) AS due
FROM u LEFT JOIN l ON l.user_id = u.user_id AND l.career_track = u.career_track LEFT JOIN s ON s.user_id = u.user_id AND s.career_track = u.career_track""")
def scan_due(spark, folder):
    return Z.scan_due(view(spark, folder, "scan_runs"), view(spark, folder, "sources"), users(spark, folder), timestamp(LATE), "Asia/Jerusalem", 8)


def users(spark, folder):
    return view(spark, folder, "profiles").select("user_id", "career_track").distinct()


@query("catalogue_install", """WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY career_track, kind, identifier ORDER BY entry) AS rn FROM @@catalogue) WHERE rn = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, career_track, kind, identifier ORDER BY source_id) AS rn FROM @@sources) WHERE rn = 1), u AS (SELECT DISTINCT user_id, career_track FROM @@profiles)
SELECT u.user_id, e.career_track, e.kind, e.identifier, k.source_id, e.name, e.company_name, coalesce(k.enabled, true) AS enabled, CASE WHEN k.source_id IS NULL THEN 'insert' WHEN k.name <> e.name OR k.company_name <> e.company_name THEN 'refresh' ELSE 'keep' END AS action
FROM e JOIN u ON u.career_track = e.career_track LEFT JOIN k ON k.user_id = u.user_id AND k.career_track = e.career_track AND k.kind = e.kind AND k.identifier = e.identifier""")
def catalogue_install(spark, folder):
    return Z.catalogue_install(view(spark, folder, "sources"), view(spark, folder, "catalogue"), users(spark, folder))


@query("catalogue_status", """WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, career_track, kind, identifier ORDER BY source_id) AS rn FROM @@sources WHERE metadata NOT LIKE '%duplicate_of%') WHERE rn = 1), u AS (SELECT DISTINCT user_id, career_track FROM @@profiles)
SELECT e.entry, u.user_id, e.career_track, e.kind, e.identifier, k.source_id IS NOT NULL AS installed, coalesce(k.enabled, false) AS enabled FROM @@catalogue e JOIN u ON u.career_track = e.career_track LEFT JOIN k ON k.user_id = u.user_id AND k.career_track = e.career_track AND k.kind = e.kind AND k.identifier = e.identifier""")
def catalogue_status(spark, folder):
    return Z.catalogue_status(view(spark, folder, "sources"), view(spark, folder, "catalogue"), users(spark, folder))


@query("source_migrate", """WITH m AS (SELECT identifier, CASE WHEN entry % 4 < 2 THEN 'greenhouse' ELSE 'lever' END AS new_kind, 'new-' || identifier AS new_identifier FROM (SELECT identifier, min(entry) AS entry FROM @@catalogue WHERE kind = 'official_careers' GROUP BY 1)),
s AS (SELECT s.*, m.new_kind, m.new_identifier, last_error <> '' AS err, kind = 'official_careers' AND m.new_kind IS NOT NULL AS mig FROM @@sources s LEFT JOIN m USING (identifier) WHERE enabled AND kind <> 'demo')
SELECT source_id, CASE WHEN mig THEN new_kind ELSE kind END AS kind, CASE WHEN mig THEN new_identifier ELSE identifier END AS identifier,
 CASE WHEN mig THEN 'migrated' WHEN err AND EXISTS (SELECT 1 FROM m WHERE m.new_kind = s.kind AND m.new_identifier = s.identifier) THEN 'refreshed' WHEN err AND kind = 'official_careers' AND identifier IN ('board-3', 'eu:board-4') THEN 'refreshed' END AS retry,
 CASE WHEN NOT err THEN 100 ELSE health_score END::int AS health_score, CASE WHEN NOT err THEN 0 ELSE consecutive_failures END::int AS consecutive_failures FROM s""")
def source_migrate(spark, folder):
    boards = view(spark, folder, "catalogue").filter("kind = 'official_careers'").groupBy("identifier").agg(F.min("entry").alias("entry"))
    moves = boards.select("identifier", F.when(F.col("entry") % 4 < 2, "greenhouse").otherwise("lever").alias("new_kind"), F.concat(F.lit("new-"), "identifier").alias("new_identifier"))
    return Z.source_migrate(view(spark, folder, "sources"), moves, ["board-3", "eu:board-4"])
