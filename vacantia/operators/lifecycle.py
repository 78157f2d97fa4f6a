"""Application and profile actions applied as tables: blockers, queue edits, overlays, claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import lexicons as L
from vacantia.functions.text import contains_any, squeeze
from vacantia.functions.urls import host, path
from vacantia.operators.filters import history_visible
from vacantia.operators.ordering import positions

ONE_TIME = "approved_once"
APPROVALS = ("אשר ושלח", "מאשר", "אישור", "approve", "submit", "yes")
LEGACY_APPROVAL_KEYS = ("אישור הגשה", "לאשר את שליחת")
# Labels that ask for a grade sheet, and labels of a bare upload control.
GRADE_SHEET_LABELS = (
    "grade sheet", "gradesheet", "grade report", "academic transcript", "transcript", "academic record", "mark sheet", "marksheet",
    "גיליון ציונים", "גליון ציונים",
)
UPLOAD_LABELS = (
    "upload", "upload file", "attach", "attach file", "choose file", "select file", "browse", "browse file", "add file",
    "העלה קובץ", "צרף קובץ", "בחר קובץ",
)


def applications_list(rows: DataFrame, now: Column, status: str | None = None) -> DataFrame:
    """Applications per user and track, newest first, visible history only, with positions in the list and in the automatic queue."""
    keys = ("user_id", "career_track")
    seen = rows.filter(history_visible(now))
    if status:
        seen = seen.filter(F.col("application_status") == status)
    slim = seen.select(*keys, "application_id", "application_status", "application_updated_at", "mode", "auto_supported")
    newest = [F.col("application_updated_at").desc(), F.col("application_id").desc()]
    listed = positions(slim, newest, keys)
    queue = positions(slim.filter("application_status = 'queued' AND mode = 'auto' AND auto_supported").select(*keys, "application_id", "application_updated_at"), newest, keys, "queue_position")
    return listed.join(queue.select("application_id", "queue_position"), "application_id", "left")


def blockers_list(blockers: DataFrame, rows: DataFrame, status: str = "open") -> DataFrame:
    chosen = blockers if status == "all" else blockers.filter(F.col("status") == status)
    joined = chosen.join(rows.select("application_id", "user_id", "career_track", "title"), "application_id")
    slim = joined.select("user_id", "career_track", "blocker_id", "application_id", "kind", "title", "created_at")
    return positions(slim, [F.col("created_at").desc(), F.col("blocker_id").desc()], ("user_id", "career_track"))


def blocker_relabel(rows: DataFrame) -> DataFrame:
    """Effective kind and question of file blockers that really ask for a grade sheet."""
    label = F.lower(squeeze(F.col("field_label")))
    bare = squeeze(F.regexp_replace(label, "[^a-zא-ת ]+", " ")).isin(*UPLOAD_LABELS)
    url, company = F.lower(F.coalesce("apply_url", F.lit(""))), F.lower(F.coalesce("company", F.lit("")))
    board = url.contains("lever.co/mobileye/") | (company.contains("mobileye") & url.contains("lever.co/"))
    grade = (contains_any(label, GRADE_SHEET_LABELS) & F.col("kind").isin("grade_sheet_required", "file_required", "submit_not_sent")) | (
        (F.col("kind") == "file_required") & bare & board)
    return rows.withColumns({"effective_kind": F.when(grade, "grade_sheet_required").otherwise(F.col("kind")),
                             "effective_question": F.when(grade & bare, "Please submit your grade sheet").otherwise(F.col("field_label"))})


def answer_library(answers: DataFrame, users: DataFrame) -> DataFrame:
    """Every question category per user with its saved answer ('' and off when there is none)."""
    saved = answers.filter(F.col("pattern").startswith("category:")).withColumn("category", F.regexp_replace("pattern", "^category:", ""))
    saved = saved.groupBy("user_id", "category").agg(F.max(F.struct("answer_id", "answer", "auto_use")).alias("s"))
    grid = users.select("user_id", F.explode(F.array(*[F.lit(k) for k in L.QUESTION_GROUPS])).alias("category"))
    return grid.join(saved, ["user_id", "category"], "left").select(
        "user_id", "category", F.coalesce("s.answer", F.lit("")).alias("answer"), F.coalesce("s.auto_use", F.lit(False)).alias("enabled"))


def profile_list_edit(profiles: DataFrame, edits: DataFrame, column: str = "skills") -> DataFrame:
    """Case-insensitive, repeatable add and remove on an ordered list; ``changed`` marks profiles to rank again.

    ``edits``: (user_id, career_track, added, removed), one row per profile.
    """
    rows = profiles.join(edits, ["user_id", "career_track"], "left")
    low = lambda c: F.transform(c, lambda v: F.lower(v))
    kept = F.filter(column, lambda v: F.col("removed").isNull() | (F.lower(v) != F.lower(F.trim("removed"))))
    wanted = F.trim("added")
    edited = F.when((F.length(wanted) > 0) & ~F.array_contains(low(kept), F.lower(wanted)), F.concat(kept, F.array(wanted))).otherwise(kept)
    return rows.withColumn("edited", edited).withColumn("changed", ~F.col("edited").eqNullSafe(F.col(column)))


def approval_consume(answers: Column) -> tuple[Column, Column]:
    """(approved once, remaining answers) of an answers map: the flag, or one legacy approval phrase, is used up."""
    low = lambda c: F.lower(F.trim(c))
    legacy = F.map_filter(answers, lambda k, v: contains_any(low(k), LEGACY_APPROVAL_KEYS) & low(v).isin(*APPROVALS))
    first = F.get(F.array_sort(F.map_keys(legacy)), 0)
    flag = F.coalesce(answers[ONE_TIME].isNotNull() & (answers[ONE_TIME] != ""), F.lit(False))
    rest = F.map_filter(answers, lambda k, v: (k != ONE_TIME) & (flag | first.isNull() | (k != first)))
    return flag | first.isNotNull(), rest


def claim_attempt(claimed: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempt row of each claimed application: previous number + 1 and a deterministic key."""
    last = attempts.groupBy("application_id").agg(F.max("attempt_number").alias("last"))
    rows = claimed.select("application_id", "adapter").join(last, "application_id", "left").withColumn("attempt_number", F.coalesce("last", F.lit(0)) + 1)
    key = F.concat_ws("-", F.lit("app"), F.col("application_id").cast("string"), F.col("attempt_number").cast("string"))
    return rows.select("application_id", "attempt_number", F.sha2(key, 256).alias("idempotency_key"), "adapter", F.lit("running").alias("status"))


def resolve_blockers(blockers: DataFrame, given: DataFrame) -> DataFrame:
    """Answers applied to open blockers: outcome, next application status, and what is remembered.

    ``given``: (blocker_id, action, answer, remember).
    """
    rows = blockers.filter("status = 'open'").join(given, "blocker_id")
    answer, low = F.trim("answer"), F.lower(F.trim("answer"))
    review = F.col("kind") == "review"
    approved, skipped = (F.col("action") == "approve_submit") | low.isin(*APPROVALS), (F.col("action") == "skip") | low.isin("דלג", "skip", "no")
    options = F.filter(F.split("options", "[|]"), lambda o: F.trim(o) != "")
    option = F.get(F.filter(options, lambda o: F.lower(squeeze(o)) == F.lower(squeeze(answer))), 0)
    choice = F.size(options) > 0
    outcome = (F.when(review & approved, "approved").when(review & skipped, "skipped").when(review, "rejected_choice")
               .when(answer == "", "answer_required").when(choice & option.isNull(), "rejected_option").otherwise("resolved"))
    rows = rows.withColumns({"outcome": outcome, "final_answer": F.when(~review & choice, option).otherwise(answer)})
    done = F.col("outcome") == "resolved"
    return rows.withColumns({
        "application_status": F.when(F.col("outcome").isin("approved", "resolved"), "queued").when(F.col("outcome") == "skipped", "skipped"),
        "one_time_flag": F.col("outcome") == "approved", "remember_company": done, "remember_global": done & F.col("remember")})


def apply_actions(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """save / skip / retry / remove / delete per posting: next application and posting status; submitted rows never change."""
    rows = rows.join(actions, "job_id")
    submitted, act = F.col("application_status") == "submitted", F.col("action")
    exists = F.col("application_id").isNotNull()
    next_application = (
        F.when(act == "delete", "deleted").when(submitted, "submitted").when(act == "save", "saved").when((act == "skip") & exists, "skipped")
        .when((act == "retry") & exists, "queued").when((act == "remove") & exists, "removed"))
    refused = submitted & act.isin("retry", "remove")
    next_job = (F.when(refused, F.col("status")).when(act == "delete", "deleted").when(act == "save", "saved").when(act == "skip", "skipped")
                .when((act == "retry") & exists, "queued").when((act == "remove") & exists, "new").otherwise(F.col("status")))
    return rows.withColumns({"next_application": next_application, "next_job": next_job, "refused": F.coalesce(refused, F.lit(False))})


def profile_patch(profiles: DataFrame, patches: DataFrame, matching: tuple[str, ...], resume: tuple[str, ...]) -> DataFrame:
    """Overlay of the supplied (non-null) fields; years follow the largest chosen option; flags what has to be refreshed."""
    keys = ["user_id", "career_track"]
    fields = [c for c in patches.columns if c not in keys]
    rows = profiles.join(patches.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields]), keys, "left")
    new = {f: F.coalesce(f"_{f}", f) for f in fields}
    if "years_options" in fields:
        largest = F.array_max(F.transform("_years_options", lambda v: F.when(v == "5+", 5.0).otherwise(v.try_cast("double"))))
        new["years_experience"] = F.coalesce(largest, new.get("years_experience", F.col("years_experience")))
    rows = rows.withColumns({f"new_{f}": value for f, value in new.items()})
    differs = lambda names: reduce(lambda a, b: a | b, [~F.col(f"new_{f}").eqNullSafe(F.col(f)) for f in names if f in new], F.lit(False))
    return rows.withColumns({"matching_changed": differs(matching), "resume_fields_changed": differs(resume)})


def source_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """Add (a board the same user has is refused), edit (re-enabling resets the back-off) and delete (own sources only).

    ``edits``: (edit_id, action, user_id, source_id, kind, identifier, career_track, enabled).  Of several adds of one board the
    first edit counts; an edit of a source that its user does not own gives no row.
    """
    board = ["user_id", "kind", "identifier", "career_track"]
    adds = edits.filter("action = 'add'")
    known = sources.select(*board, F.lit(True).alias("known")).distinct()
    first = adds.groupBy(*board).agg(F.min("edit_id").alias("first"))
    refused = F.coalesce("known", F.lit(False)) | (F.col("edit_id") != F.coalesce("first", "edit_id"))
    added = adds.join(known, board, "left").join(first, board, "left").select(
        "edit_id", "user_id", F.lit(None).cast("bigint").alias("source_id"), F.when(refused, "refused_duplicate").otherwise("added").alias("outcome"),
        F.lit(True).alias("enabled"), F.lit(0).alias("consecutive_failures"))
    own = sources.select("user_id", "source_id", "enabled", "consecutive_failures")
    rest = edits.filter("action <> 'add'").select("edit_id", "action", "user_id", "source_id", F.col("enabled").alias("wanted")).join(own, ["user_id", "source_id"])
    enabled = F.coalesce("wanted", "enabled")
    changed = rest.select("edit_id", "user_id", "source_id", F.when(F.col("action") == "delete", "deleted").otherwise("edited").alias("outcome"), enabled.alias("enabled"),
                          F.when(F.col("wanted"), 0).otherwise(F.col("consecutive_failures")).alias("consecutive_failures"))
    return added.unionByName(changed)


def submission_outcome(responses: DataFrame) -> DataFrame:
    """Logged submission responses per attempt: accepted, rejected or unknown; any acceptance beats errors, else the last error."""
    body = F.from_json("body", "ok boolean, applicationId string, application_id string, error string, message string")
    rows = responses.withColumn("b", body)
    trusted = host(F.col("url")).isin("jobs.lever.co", "jobs.eu.lever.co") & F.lower(F.rtrim(path(F.col("url")), F.lit("/"))).endswith("/apply")
    thanks = host(F.col("location")).isin("jobs.lever.co", "jobs.eu.lever.co") & F.lower(F.rtrim(path(F.col("location")), F.lit("/"))).endswith("/thanks")
    accepted = trusted & ((F.col("status").between(300, 399) & thanks) | (F.col("status").between(200, 299) & F.coalesce("b.ok", F.lit(False))))
    rejected = trusted & ~accepted & ((F.col("status") >= 400) | F.coalesce(~F.col("b.ok"), F.lit(False)))
    # The row content breaks ties between responses with the same number.
    order = F.struct("seq", "url", "status", "body", "location")
    external = F.when(F.col("status").between(200, 299), F.trim(F.coalesce("b.applicationId", "b.application_id", F.lit("")))).otherwise("")
    reason = F.coalesce("b.error", "b.message", F.lit(""))
    text = F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.when(reason != "", F.concat(F.lit(": "), reason)).otherwise(""))
    rows = rows.select("attempt_id", F.when(accepted, order).alias("yes"), external.alias("external"), F.when(rejected, order).alias("no"), text.alias("text"))
    best = rows.groupBy("attempt_id").agg(F.min_by("external", "yes").alias("external_id"), F.min("yes").isNotNull().alias("accepted"),
                                          F.max_by("text", "no").alias("error"), F.max("no").isNotNull().alias("rejected"))
    return best.select("attempt_id", F.when(F.col("accepted"), "accepted").when(F.col("rejected"), "rejected").otherwise("unknown").alias("outcome"),
                       F.when(F.col("accepted"), F.col("external_id")).otherwise("").alias("external_id"), F.when(F.col("rejected") & ~F.col("accepted"), F.col("error")).otherwise("").alias("error"))


def board_status() -> Column:
    """Board column: queued but not automatic shows as saved."""
    auto = (F.col("mode") == "auto") & F.col("auto_supported")
    return F.when((F.col("application_status") == "queued") & ~auto, "saved").otherwise(F.col("application_status"))


def starter_skill_cleanup(profiles: DataFrame) -> DataFrame:
    """Clear skills of untouched profiles that are exactly the track's old starter list."""
    untouched = (F.col("onboarding_version") <= 0) & (F.trim(F.coalesce("cv_path", F.lit(""))) == "")
    starter = reduce(lambda a, b: a | b, [
        (F.col("career_track") == track) & F.col("skills").eqNullSafe(F.array(*[F.lit(s) for s in skills])) for track, skills in L.STARTER_SKILLS.items()])
    cleared = untouched & starter
    return profiles.withColumns({"cleared": cleared, "kept_skills": F.when(cleared, F.array().cast("array<string>")).otherwise(F.col("skills"))})


def user_activity(users: DataFrame) -> DataFrame:
    """Accounts by last login, last seen and id; the claim time stands in for a missing login."""
    order = [F.col("last_login_at").desc_nulls_last(), F.col("last_seen_at").desc_nulls_last(), F.col("user_id")]
    return positions(users, order).withColumn("shown_login", F.coalesce("last_login_at", "claimed_at"))
