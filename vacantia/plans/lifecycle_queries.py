"""Queries for answers, blockers, queue actions, profiles and other read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import lexicons as L
from vacantia.functions import features as X
from vacantia.operators import answers as A, lifecycle as Y, readmodels as M, source_state as Z
from vacantia.plans import duck as K
from vacantia.plans.fixtures import spread, table, view
from vacantia.operators.ordering import top
from vacantia.plans.funnel_queries import READ, now, read_model
from vacantia.plans.registry import query
from vacantia.plans.text_queries import _category, joined

MEMORY = """me AS (SELECT *, CASE WHEN pattern LIKE 'company:%' THEN split_part(pattern, ':', 2) END AS company_hash, CASE WHEN pattern LIKE 'company:%' THEN 'company' ELSE 'global' END AS scope,
  regexp_replace(pattern, '^company:[^:]*:', '') AS bare, CASE WHEN pattern LIKE 'category:%' THEN substring(pattern, 10) ELSE '' END AS category FROM @@answers)"""
HASH = f"substring(sha256({K.memory_norm('company')}), 1, 24)"
CLAIMED = f"cj AS (SELECT user_id, min(job_id) AS job_id, arg_min({HASH}, job_id) AS jh FROM @@postings WHERE is_active GROUP BY 1)"


def claimed_jobs(spark, folder):
    """One claimed posting per user."""
    return view(spark, folder, "postings").filter("is_active").groupBy("user_id").agg(F.min(F.struct("job_id", "company")).alias("j")).select("user_id", "j.*")


SCOPE = f"""{MEMORY}, {CLAIMED}, sc AS (SELECT me.user_id, cj.job_id, answer_id, bare AS pattern, answer, category, scope, CASE scope WHEN 'company' THEN 0 ELSE 1 END::int AS priority FROM me JOIN cj USING (user_id)
 WHERE auto_use AND (company_hash IS NULL OR (company_hash = jh AND bare <> '')))"""


@query("answer_memory_scope", f"WITH {SCOPE} SELECT user_id, job_id, answer_id, pattern, answer, category, scope, priority FROM sc")
def answer_memory_scope(spark, folder):
    return A.answer_memory_scope(view(spark, folder, "answers"), claimed_jobs(spark, folder))


@query("task_payload_answers", f"WITH {SCOPE} SELECT user_id, job_id, pattern, answer, category, scope FROM sc UNION ALL SELECT m.user_id, cj.job_id, m.question, 'draft ' || m.seq::varchar, 'approved_open_draft', 'job' FROM @@messages m JOIN cj USING (user_id) WHERE m.turn % 3 = 0")
def task_payload_answers(spark, folder):
    jobs = claimed_jobs(spark, folder)
    stored = A.answer_memory_scope(view(spark, folder, "answers"), jobs).select("user_id", "job_id", "pattern", "answer", "category", "scope")
    drafts = view(spark, folder, "messages").filter("turn % 3 = 0").join(jobs, "user_id")
    return stored.unionByName(drafts.select("user_id", "job_id", F.col("question").alias("pattern"), F.concat(F.lit("draft "), F.col("seq").cast("string")).alias("answer"), F.lit("approved_open_draft").alias("category"), F.lit("job").alias("scope")))


ASKED = "CASE WHEN conv_id % 7 = 0 THEN 'Notice period' WHEN conv_id % 5 = 0 THEN 'Please tell us: what is your expected salary per month' ELSE question END"
_FIELDS = {"first_name": "split_part(trim(full_name), ' ', 1)", "last_name": "''", "full_name": "full_name", "email": "email", "phone": "phone", "location": "location", "linkedin_url": "linkedin_url", "years_experience": "years_experience::varchar"}


@query("answer_resolve", f"""WITH {MEMORY}, q0 AS (SELECT user_id, seq AS question_id, {ASKED} AS question, CASE conv_id % 2 WHEN 0 THEN 'Google' ELSE 'Company 2' END AS company FROM @@messages),
q AS (SELECT user_id, question_id, {HASH} AS jh, {K.memory_norm('question')} AS key, {K.question_norm('question')} AS plain FROM q0), qc AS (SELECT *, {_category('plain')} AS cat FROM q),
mn AS (SELECT *, {K.memory_norm('bare')} AS norm FROM me),
c AS (SELECT qc.question_id, CASE mn.scope WHEN 'company' THEN 0 ELSE 1 END AS o, mn.answer_id, mn.answer FROM qc JOIN mn ON mn.user_id = qc.user_id AND CASE WHEN mn.scope = 'company' THEN mn.company_hash = qc.jh AND mn.norm <> '' AND mn.norm = qc.key
  ELSE (mn.category <> '' AND mn.category = qc.cat) OR (mn.norm <> '' AND (mn.norm = qc.key OR (length(mn.norm) >= 12 AND length(qc.key) >= 12 AND (contains(qc.key, mn.norm) OR contains(mn.norm, qc.key))))) END),
b AS (SELECT question_id, arg_min(answer, (o, answer_id)) AS answer, min(o) AS o FROM c GROUP BY 1), p AS (SELECT * FROM @@profiles WHERE career_track = '{L.CS}'),
r AS (SELECT qc.user_id, qc.question_id, b.answer, b.o, coalesce({', '.join(f"CASE WHEN {K.has_any('key', words)} AND trim({_FIELDS[f]}) <> '' THEN {_FIELDS[f]} END" for f, words in A.FIELD_LABELS)}) AS mapped FROM qc LEFT JOIN b USING (question_id) LEFT JOIN p ON p.user_id = qc.user_id)
SELECT user_id, question_id, coalesce(answer, mapped) AS answer, CASE WHEN answer IS NOT NULL THEN CASE o WHEN 0 THEN 'company_memory' ELSE 'memory' END WHEN mapped IS NOT NULL THEN 'profile' ELSE 'none' END AS source FROM r""")
def answer_resolve(spark, folder):
    company = F.when(F.col("conv_id") % 2 == 0, "Google").otherwise("Company 2")
    questions = view(spark, folder, "messages").select("user_id", F.col("seq").alias("question_id"), F.expr(ASKED).alias("question"), company.alias("company"))
    return A.answer_resolve(questions, view(spark, folder, "answers"), view(spark, folder, "profiles"))


@query("email_evidence", f"""WITH {READ}, pe AS (SELECT application_id, user_id, list_distinct(list_filter(string_split(lower(company), ' '), lambda w: length(w) >= 3)) AS ct, list_distinct(list_filter(string_split(lower(title), ' '), lambda w: length(w) >= 4)) AS tt FROM rd WHERE application_status = 'verification_pending'),
ms AS (SELECT user_id, seq, lower(text) AS low FROM @@messages WHERE {K.has_any('lower(text)', A.CONFIRMATION_TERMS)})
SELECT application_id, min(seq) AS message_seq FROM pe JOIN ms USING (user_id) WHERE (len(ct) = 0 OR len(list_filter(ct, lambda t: contains(low, t))) > 0) AND (len(tt) = 0 OR len(list_filter(tt, lambda t: contains(low, t))) > 0) GROUP BY 1""")
def email_evidence(spark, folder):
    pending = read_model(spark, folder).filter("application_status = 'verification_pending'")
    return A.email_evidence(pending, view(spark, folder, "messages"))


@query("resume_suggestions", r"""WITH j AS (SELECT r.resume_id, r.skills, r.email, r.phone, list_transform(q.skills, lambda v: lower(trim(v))) AS owned, coalesce(q.email, '') AS pe, coalesce(q.phone, '') AS pp FROM @@resumes r JOIN @@profiles q ON q.user_id = r.user_id AND q.career_track = r.career_track),
n AS (SELECT *, regexp_replace(phone, '\D', '', 'g') AS a, regexp_replace(pp, '\D', '', 'g') AS b FROM j), m AS (SELECT *, CASE WHEN regexp_full_match(a, '9720?[0-9]{9}') THEN '0' || right(a, 9) ELSE a END AS a1, CASE WHEN regexp_full_match(b, '9720?[0-9]{9}') THEN '0' || right(b, 9) ELSE b END AS b1 FROM n)
SELECT resume_id, 'skill' AS kind, 'skills' AS field, unnest(list_filter(skills, lambda v: NOT list_contains(owned, v))) AS value FROM m
UNION ALL SELECT resume_id, CASE WHEN trim(pe) = '' THEN 'fill' ELSE 'differs' END, 'email', email FROM m WHERE email <> '' AND lower(email) <> lower(pe)
UNION ALL SELECT resume_id, CASE WHEN trim(pp) = '' THEN 'fill' ELSE 'differs' END, 'phone', phone FROM m WHERE phone <> '' AND NOT (a1 <> '' AND a1 = b1)""")
def resume_suggestions(spark, folder):
    return A.resume_suggestions(view(spark, folder, "resumes"), view(spark, folder, "profiles"))


_LOW_RESUME = "lower(extracted_text)"


@query("skill_suggestions", f"""WITH r AS (SELECT resume_id, user_id, career_track, {K.keys(_LOW_RESUME, L.SKILLS)} AS found FROM @@resumes)
SELECT r.resume_id, array_to_string(list_filter(found, lambda v: NOT list_contains(list_transform(q.skills, lambda s: lower(trim(s))), v)), '|') AS suggestions FROM r JOIN @@profiles q ON q.user_id = r.user_id AND q.career_track = r.career_track""")
def skill_suggestions(spark, folder):
    people = view(spark, folder, "profiles").select("user_id", "career_track", F.transform("skills", lambda s: F.trim(F.lower(s))).alias("owned"))
    rows = spread(view(spark, folder, "resumes")).select("resume_id", "user_id", "career_track", X.skills_extract(F.col("extracted_text")).alias("found")).join(people, ["user_id", "career_track"])
    return rows.select("resume_id", joined(F.array_except("found", "owned")).alias("suggestions"))


@query("resume_refresh", f"""WITH r AS (SELECT resume_id, list_concat(skills, list_concat(manual_skills, {K.keys(_LOW_RESUME, L.SKILLS)})) AS al FROM @@resumes)
SELECT resume_id, array_to_string(list_filter(al, lambda v, i: list_position(list_transform(al, lambda s: lower(s)), lower(v)) = i), '|') AS skills FROM r""")
def resume_refresh(spark, folder):
    rows = A.resume_refresh(spread(view(spark, folder, "resumes")), X.skills_extract(F.col("extracted_text")))
    return rows.select("resume_id", joined(F.col("refreshed")).alias("skills"))




@query("applications_list", f"""WITH {READ}, v AS (SELECT * FROM rd WHERE is_active OR ((submitted_at IS NOT NULL OR application_status IN {K.names(L.SUBMITTED_STATUSES)}) AND coalesce(removed_at, updated_at) >= NOW - to_days(30))),
n AS (SELECT user_id, career_track, application_id, row_number() OVER (PARTITION BY user_id, career_track ORDER BY application_updated_at DESC, application_id DESC) AS position FROM v),
q AS (SELECT application_id, row_number() OVER (PARTITION BY user_id, career_track ORDER BY application_updated_at DESC, application_id DESC) AS queue_position FROM v WHERE application_status = 'queued' AND mode = 'auto' AND auto_supported)
SELECT n.*, q.queue_position FROM n LEFT JOIN q USING (application_id)""")
def applications_list(spark, folder):
    return Y.applications_list(read_model(spark, folder), now()).select("user_id", "career_track", "application_id", "position", "queue_position")


@query("blockers_list", """WITH b AS (SELECT b.blocker_id, b.application_id, b.kind, b.created_at, p.user_id, p.career_track, p.title FROM @@blockers b JOIN @@applications a USING (application_id) JOIN @@postings p ON p.job_id = a.job_id WHERE b.status = 'open')
SELECT user_id, career_track, blocker_id, application_id, kind, title, row_number() OVER (PARTITION BY user_id, career_track ORDER BY created_at DESC, blocker_id DESC) AS position FROM b""")
def blockers_list(spark, folder):
    return Y.blockers_list(view(spark, folder, "blockers"), read_model(spark, folder)).drop("created_at")


@query("blocker_relabel", f"""WITH b AS (SELECT b.blocker_id, b.kind, b.field_label, lower(b.field_label) AS label, lower(p.apply_url) AS url, lower(p.company) AS company FROM @@blockers b JOIN @@applications a USING (application_id) JOIN @@postings p ON p.job_id = a.job_id),
c AS (SELECT *, {K.squeeze("regexp_replace(label, '[^a-zא-ת ]+', ' ', 'g')")} IN {K.names(Y.UPLOAD_LABELS)} AS bare, contains(url, 'lever.co/mobileye/') OR (contains(company, 'mobileye') AND contains(url, 'lever.co/')) AS board FROM b),
d AS (SELECT *, ({K.has_any('label', Y.GRADE_SHEET_LABELS)} AND kind IN ('grade_sheet_required', 'file_required', 'submit_not_sent')) OR (kind = 'file_required' AND bare AND board) AS grade FROM c)
SELECT blocker_id, CASE WHEN grade THEN 'grade_sheet_required' ELSE kind END AS kind, CASE WHEN grade AND bare THEN 'Please submit your grade sheet' ELSE field_label END AS question FROM d""")
def blocker_relabel(spark, folder):
    jobs = read_model(spark, folder).select("application_id", "apply_url", "company")
    rows = Y.blocker_relabel(view(spark, folder, "blockers").join(jobs, "application_id"))
    return rows.select("blocker_id", F.col("effective_kind").alias("kind"), F.col("effective_question").alias("question"))


@query("answer_library", f"""WITH s AS (SELECT user_id, substring(pattern, 10) AS category, arg_max(answer, answer_id) AS answer, arg_max(auto_use, answer_id) AS auto_use FROM @@answers WHERE pattern LIKE 'category:%' GROUP BY ALL),
g AS (SELECT user_id, unnest([{', '.join(K.text(k) for k in L.QUESTION_GROUPS)}]) AS category FROM (SELECT DISTINCT user_id FROM @@answers)) SELECT g.user_id, g.category, coalesce(s.answer, '') AS answer, coalesce(s.auto_use, false) AS enabled FROM g LEFT JOIN s USING (user_id, category)""")
def answer_library(spark, folder):
    answers = view(spark, folder, "answers")
    return Y.answer_library(answers, answers.select("user_id").distinct())


@query("sources_visible", "SELECT career_track, source_id, name FROM @@sources WHERE metadata NOT LIKE '%duplicate_of%'")
def sources_visible(spark, folder):
    return M.sources_visible(view(spark, folder, "sources")).select("career_track", "source_id", "name")


@query("audit_recent", "SELECT user_id, event_id, event_type FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 100")
def audit_recent(spark, folder):
    """Each user's newest 100 entries of one type (the size of the report)."""
    return top(table(spark, folder, "events").filter("event_type = 'error'"), [F.col("event_id").desc()], ["user_id"], 100).select("user_id", "event_id", "event_type")


@query("scan_requests", """WITH RECURSIVE o AS (SELECT user_id, career_track, run_id, requested_at, finished_at, row_number() OVER (PARTITION BY user_id, career_track ORDER BY requested_at, run_id) AS n FROM @@scan_runs),
r AS (SELECT user_id, career_track, run_id, n, true AS accepted, least(coalesce(finished_at, requested_at + INTERVAL 2 HOUR), requested_at + INTERVAL 2 HOUR) AS free FROM o WHERE n = 1
 UNION ALL SELECT o.user_id, o.career_track, o.run_id, o.n, o.requested_at >= r.free, CASE WHEN o.requested_at >= r.free THEN least(coalesce(o.finished_at, o.requested_at + INTERVAL 2 HOUR), o.requested_at + INTERVAL 2 HOUR) ELSE r.free END FROM r JOIN o ON o.user_id = r.user_id AND o.career_track = r.career_track AND o.n = r.n + 1)
SELECT user_id, career_track, run_id, accepted FROM r""")
def scan_requests(spark, folder):
    return Z.scan_requests(view(spark, folder, "scan_runs"))


EDITS = "SELECT user_id, career_track, CASE user_id % 3 WHEN 0 THEN ' Python ' WHEN 1 THEN 'Rust' ELSE '' END AS added, CASE user_id % 4 WHEN 0 THEN 'SQL' WHEN 1 THEN 'git ' END AS removed FROM {p} WHERE user_id % 5 <> 0"


@query("profile_list_edit", f"""WITH e AS ({EDITS.format(p='@@profiles')}), j AS (SELECT p.user_id, p.career_track, p.skills, e.added, trim(e.added) AS ad, lower(trim(e.removed)) AS rm FROM @@profiles p LEFT JOIN e ON e.user_id = p.user_id AND e.career_track = p.career_track),
k AS (SELECT *, list_filter(skills, lambda v: rm IS NULL OR lower(v) <> rm) AS kept FROM j), x AS (SELECT *, CASE WHEN length(ad) > 0 AND NOT list_contains(list_transform(kept, lambda v: lower(v)), lower(ad)) THEN list_append(kept, ad) ELSE kept END AS edited FROM k)
SELECT user_id, career_track, array_to_string(edited, '|') AS skills, edited IS DISTINCT FROM skills AS changed FROM x""")
def profile_list_edit(spark, folder):
    people = view(spark, folder, "profiles")
    edits = people.filter("user_id % 5 <> 0").selectExpr("user_id", "career_track", "CASE user_id % 3 WHEN 0 THEN ' Python ' WHEN 1 THEN 'Rust' ELSE '' END AS added", "CASE user_id % 4 WHEN 0 THEN 'SQL' WHEN 1 THEN 'git ' END AS removed")
    return Y.profile_list_edit(people, edits).select("user_id", "career_track", joined(F.col("edited")).alias("skills"), "changed")


@query("approval_consume", """SELECT application_id, application_id % 3 = 0 OR application_id % 6 = 2 AS approved, CASE application_id % 3 WHEN 0 THEN 'city=Haifa' WHEN 1 THEN 'city=Lod' ELSE '' END AS answers FROM @@applications""")
def approval_consume(spark, folder):
    """The map comes from the stored JSON; every sixth broken one is replaced by a legacy approval phrase."""
    stored = F.coalesce(F.from_json("answers", "map<string, string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    legacy = F.create_map(F.lit("נא לאשר את שליחת הטופס"), F.lit(" Approve "))
    answers = F.when(F.col("application_id") % 6 == 2, legacy).otherwise(stored)
    approved, rest = Y.approval_consume(F.col("m"))
    rows = view(spark, folder, "applications").select("application_id", answers.alias("m"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(rest), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    return rows.select("application_id", approved.alias("approved"), shown.alias("answers"))


@query("claim_attempt", f"""WITH {READ}, l AS (SELECT application_id, max(attempt_number) AS last FROM @@attempts GROUP BY 1) SELECT rd.application_id, (coalesce(l.last, 0) + 1)::int AS attempt_number, sha256('app-' || rd.application_id::varchar || '-' || (coalesce(l.last, 0) + 1)::varchar) AS idempotency_key, adapter, 'running' AS status
FROM rd LEFT JOIN l USING (application_id) WHERE is_active AND application_status = 'queued'""")
def claim_attempt(spark, folder):
    claimed = read_model(spark, folder).filter("is_active AND application_status = 'queued'")
    return Y.claim_attempt(claimed, view(spark, folder, "attempts"))


@query("user_activity", """WITH u AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 <> 0 THEN NOW - to_minutes(c_custkey * 7 % 5000) END AS last_login_at, CASE WHEN c_custkey % 4 <> 0 THEN NOW - to_minutes(c_custkey % 100) END AS last_seen_at, NOW - to_days((c_custkey % 900)::int) AS claimed_at FROM customer)
SELECT user_id, row_number() OVER (ORDER BY last_login_at DESC NULLS LAST, last_seen_at DESC NULLS LAST, user_id) AS position, coalesce(last_login_at, claimed_at)::varchar AS shown_login FROM u""")
def user_activity(spark, folder):
    key = F.col("c_custkey")
    back = lambda minutes: now() - F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    users = table(spark, folder, "customer").select(
        key.alias("user_id"), F.when(key % 3 != 0, back(key * 7 % 5000)).alias("last_login_at"), F.when(key % 4 != 0, back(key % 100)).alias("last_seen_at"),
        (now() - F.make_dt_interval((key % 900).cast("int"))).alias("claimed_at"))
    return Y.user_activity(users).select("user_id", "position", F.col("shown_login").cast("string").alias("shown_login"))


GIVEN = "SELECT blocker_id, CASE application_id % 5 WHEN 0 THEN 'approve_submit' WHEN 1 THEN 'skip' ELSE '' END AS action, CASE application_id % 4 WHEN 0 THEN ' YES ' WHEN 1 THEN 'maybe' WHEN 2 THEN '' ELSE 'no' END AS answer, application_id % 2 = 0 AS remember FROM {b}"


@query("resolve_blockers", f"""WITH g AS (SELECT DISTINCT * FROM ({GIVEN.format(b='@@blockers')})), b AS (SELECT b.*, g.action, trim(g.answer) AS answer, lower(trim(g.answer)) AS low, g.remember FROM (SELECT DISTINCT blocker_id, kind, options FROM @@blockers WHERE status = 'open') b JOIN g USING (blocker_id)),
o AS (SELECT *, kind = 'review' AS review, list_filter(string_split(options, '|'), lambda v: v <> '') AS op FROM b),
p AS (SELECT *, list_filter(op, lambda v: lower(v) = low)[1] AS opt FROM o),
r AS (SELECT *, CASE WHEN review AND (action = 'approve_submit' OR low IN {K.names(Y.APPROVALS)}) THEN 'approved' WHEN review AND (action = 'skip' OR low IN ('דלג', 'skip', 'no')) THEN 'skipped' WHEN review THEN 'rejected_choice'
  WHEN answer = '' THEN 'answer_required' WHEN len(op) > 0 AND opt IS NULL THEN 'rejected_option' ELSE 'resolved' END AS outcome FROM p)
SELECT blocker_id, outcome, CASE WHEN NOT review AND len(op) > 0 THEN opt ELSE answer END AS final_answer, CASE WHEN outcome IN ('approved', 'resolved') THEN 'queued' WHEN outcome = 'skipped' THEN 'skipped' END AS application_status, outcome = 'approved' AS one_time_flag,
  outcome = 'resolved' AS remember_company, outcome = 'resolved' AND remember AS remember_global FROM r""")
def resolve_blockers(spark, folder):
    blockers = view(spark, folder, "blockers")
    given = blockers.selectExpr("blocker_id", "CASE application_id % 5 WHEN 0 THEN 'approve_submit' WHEN 1 THEN 'skip' ELSE '' END AS action", "CASE application_id % 4 WHEN 0 THEN ' YES ' WHEN 1 THEN 'maybe' WHEN 2 THEN '' ELSE 'no' END AS answer",
                                "application_id % 2 = 0 AS remember").distinct()
    opened = blockers.select("blocker_id", "kind", "options", "status").distinct()
    rows = Y.resolve_blockers(opened, given)
    return rows.select("blocker_id", "outcome", "final_answer", "application_status", "one_time_flag", "remember_company", "remember_global")


ACTIONS = "CASE job_id % 5 WHEN 0 THEN 'save' WHEN 1 THEN 'skip' WHEN 2 THEN 'retry' WHEN 3 THEN 'remove' ELSE 'delete' END"


@query("apply_actions", f"""WITH j AS (SELECT p.job_id, p.status, a.application_id, a.status AS app, {ACTIONS.replace('job_id', '(p.job_id // 2)')} AS action FROM @@postings p LEFT JOIN @@applications a USING (job_id)), k AS (SELECT *, coalesce(app = 'submitted' AND action IN ('retry', 'remove'), false) AS refused, application_id IS NOT NULL AS ex FROM j)
SELECT job_id, action, refused, CASE WHEN action = 'delete' THEN 'deleted' WHEN app = 'submitted' THEN 'submitted' WHEN action = 'save' THEN 'saved' WHEN action = 'skip' AND ex THEN 'skipped' WHEN action = 'retry' AND ex THEN 'queued' WHEN action = 'remove' AND ex THEN 'removed' END AS next_application,
 CASE WHEN refused THEN status WHEN action = 'delete' THEN 'deleted' WHEN action = 'save' THEN 'saved' WHEN action = 'skip' THEN 'skipped' WHEN action = 'retry' AND ex THEN 'queued' WHEN action = 'remove' AND ex THEN 'new' ELSE status END AS next_job FROM k""")
def apply_actions(spark, folder):
    rows = read_model(spark, folder, "left")
    actions = rows.select("job_id", F.expr(ACTIONS.replace("job_id", "(job_id div 2)")).alias("action"))
    return Y.apply_actions(rows, actions).select("job_id", "action", "refused", "next_application", "next_job")


@query("profile_patch", """WITH p AS (SELECT *, user_id % 3 = 0 AS a, user_id % 4 = 1 AS b, user_id % 5 = 2 AS c FROM @@profiles), n AS (SELECT *, CASE WHEN a THEN ['0', '2'] WHEN b THEN ['3', '5+'] ELSE years_options END AS ny, CASE WHEN b THEN 'new' || user_id::varchar || '@mail.example' ELSE email END AS ne,
  CASE WHEN a THEN 2.0 WHEN b THEN 5.0 ELSE years_experience END AS nyear, CASE WHEN c THEN ['python'] ELSE skills END AS ns FROM p)
SELECT user_id, career_track, nyear AS years, ne AS email, array_to_string(ns, '|') AS skills, (ny IS DISTINCT FROM years_options) OR (nyear IS DISTINCT FROM years_experience) OR (ns IS DISTINCT FROM skills) AS matching_changed, (ne IS DISTINCT FROM email) OR (ns IS DISTINCT FROM skills) AS resume_fields_changed FROM n""")
def profile_patch(spark, folder):
    people, user = view(spark, folder, "profiles"), F.col("user_id")
    text = lambda *values: F.array(*[F.lit(v) for v in values])
    patches = people.select("user_id", "career_track", F.when(user % 3 == 0, text("0", "2")).when(user % 4 == 1, text("3", "5+")).alias("years_options"),
                            F.when(user % 4 == 1, F.concat(F.lit("new"), user.cast("string"), F.lit("@mail.example"))).alias("email"), F.when(user % 5 == 2, text("python")).alias("skills"))
    rows = Y.profile_patch(people, patches, ("years_options", "years_experience", "skills"), ("email", "skills"))
    return rows.select("user_id", "career_track", F.col("new_years_experience").alias("years"), F.col("new_email").alias("email"), joined(F.col("new_skills")).alias("skills"), "matching_changed", "resume_fields_changed")


@query("source_edits", """WITH e AS (SELECT c.entry * 50 + u.user_id AS edit_id, 'add' AS action, u.user_id, NULL::bigint AS source_id, c.kind, c.identifier, c.career_track, NULL::boolean AS enabled FROM @@catalogue c JOIN (SELECT DISTINCT user_id, career_track FROM @@sources WHERE user_id % 10 = 3) u USING (career_track)
 UNION ALL SELECT -source_id, CASE source_id % 3 WHEN 0 THEN 'delete' ELSE 'edit' END, CASE WHEN source_id % 5 = 0 THEN user_id + 1 ELSE user_id END, source_id, NULL, NULL, NULL, CASE source_id % 4 WHEN 0 THEN true WHEN 1 THEN false END FROM @@sources),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind, identifier, career_track ORDER BY edit_id) AS rn FROM e WHERE action = 'add')
SELECT edit_id, user_id, source_id, CASE WHEN rn > 1 OR EXISTS (SELECT 1 FROM @@sources s WHERE s.user_id = a.user_id AND s.kind = a.kind AND s.identifier = a.identifier AND s.career_track = a.career_track) THEN 'refused_duplicate' ELSE 'added' END AS outcome, true AS enabled, 0 AS consecutive_failures FROM a
UNION ALL SELECT e.edit_id, e.user_id, e.source_id, CASE e.action WHEN 'delete' THEN 'deleted' ELSE 'edited' END, coalesce(e.enabled, s.enabled), CASE WHEN e.enabled THEN 0 ELSE s.consecutive_failures END FROM e JOIN @@sources s ON s.source_id = e.source_id AND s.user_id = e.user_id WHERE action <> 'add'""")
def source_edits(spark, folder):
    """Every fifth edit comes from a user who does not own the source."""
    sources = view(spark, folder, "sources")
    users = sources.filter("user_id % 10 = 3").select("user_id", "career_track").distinct()
    adds = view(spark, folder, "catalogue").join(users, "career_track").select(
        (F.col("entry") * 50 + F.col("user_id")).alias("edit_id"), F.lit("add").alias("action"), "user_id", F.lit(None).cast("bigint").alias("source_id"), "kind", "identifier", "career_track", F.lit(None).cast("boolean").alias("enabled"))
    key, none = F.col("source_id"), F.lit(None).cast("string")
    changes = sources.select((-key).alias("edit_id"), F.when(key % 3 == 0, "delete").otherwise("edit").alias("action"), F.when(key % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), "source_id",
                             none.alias("kind"), none.alias("identifier"), none.alias("career_track"), F.when(key % 4 == 0, True).when(key % 4 == 1, False).alias("enabled"))
    return Y.source_edits(sources, adds.unionByName(changes))


@query("submission_outcome", r"""WITH r AS (SELECT *, TRY_CAST(body AS JSON) AS j, url = 'https://jobs.lever.co/acme/apply' AS trusted FROM @@responses), s AS (SELECT *, (j ->> '$.ok') AS ok, coalesce(j ->> '$.applicationId', '') AS app, coalesce(j ->> '$.error', '') AS err FROM r),
t AS (SELECT *, trusted AND ((status BETWEEN 300 AND 399 AND location LIKE '%/thanks') OR (status BETWEEN 200 AND 299 AND coalesce(ok = 'true', false))) AS yes FROM s), u AS (SELECT *, trusted AND NOT yes AND (status >= 400 OR coalesce(ok = 'false', false)) AS no FROM t),
v AS (SELECT attempt_id, bool_or(yes) AS y, bool_or(no) AS n, arg_min(CASE WHEN status BETWEEN 200 AND 299 THEN app ELSE '' END, (seq, url, status, body, location)) FILTER (yes) AS ex, arg_max('HTTP ' || status::varchar || CASE WHEN err <> '' THEN ': ' || err ELSE '' END, (seq, url, status, body, location)) FILTER (no) AS er FROM u GROUP BY 1)
SELECT attempt_id, CASE WHEN y THEN 'accepted' WHEN n THEN 'rejected' ELSE 'unknown' END AS outcome, CASE WHEN y THEN ex ELSE '' END AS external_id, CASE WHEN n AND NOT y THEN er ELSE '' END AS error FROM v""")
def submission_outcome(spark, folder):
    return Y.submission_outcome(spread(view(spark, folder, "responses")))


def _snippet(t):
    rules = " ".join(f"WHEN instr(lower({t}), {K.text(term)}) > 0 THEN substring({K.squeeze(f'substring({t}, greatest(1, instr(lower({t}), {K.text(term)}) - 120), (instr(lower({t}), {K.text(term)}) + {len(term) + 240} - greatest(1, instr(lower({t}), {K.text(term)}) - 120)))')}, 1, 500)" for term in A.SUCCESS_TERMS)
    return f"CASE {rules} ELSE '' END"


@query("page_evidence", f"SELECT seq, {_snippet('text')} AS evidence FROM @@messages")
def page_evidence(spark, folder):
    return view(spark, folder, "messages").select("seq", A.page_evidence(F.col("text")).alias("evidence"))


@query("board_status", f"WITH {READ}, b AS (SELECT user_id, career_track, CASE WHEN application_status = 'queued' AND NOT (mode = 'auto' AND auto_supported) THEN 'saved' ELSE application_status END AS col FROM rd) SELECT user_id, career_track, col AS board_column, count(*) AS applications FROM b GROUP BY ALL")
def board_status(spark, folder):
    return read_model(spark, folder).groupBy("user_id", "career_track", Y.board_status().alias("board_column")).agg(F.count("*").alias("applications"))


_STARTER = "CASE career_track " + " ".join(f"WHEN '{t}' THEN [{', '.join(K.text(s) for s in v)}]" for t, v in L.STARTER_SKILLS.items()) + " END"


@query("starter_skill_cleanup", f"WITH p AS (SELECT user_id, career_track, onboarding_version, cv_path, CASE WHEN user_id % 2 = 0 THEN {_STARTER} ELSE skills END AS skills FROM @@profiles) SELECT user_id, career_track, onboarding_version <= 0 AND trim(cv_path) = '' AND skills = {_STARTER} AS cleared, CASE WHEN onboarding_version <= 0 AND trim(cv_path) = '' AND skills = {_STARTER} THEN '' ELSE array_to_string(skills, '|') END AS skills FROM p")
def starter_skill_cleanup(spark, folder):
    starter = None
    for track, skills in L.STARTER_SKILLS.items():
        value = F.array(*[F.lit(s) for s in skills])
        starter = F.when(F.col("career_track") == track, value) if starter is None else starter.when(F.col("career_track") == track, value)
    people = view(spark, folder, "profiles").withColumn("skills", F.when(F.col("user_id") % 2 == 0, starter).otherwise(F.col("skills")))
    return Y.starter_skill_cleanup(people).select("user_id", "career_track", "cleared", joined(F.col("kept_skills")).alias("skills"))
