"""Application funnel: attempts, blockers, queues, status changes, receipts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.urls import ats_family, auto_submit, confirmation, native_apply_url
from vacantia.operators.ordering import positions, previous

IN_PIPELINE = ("submitted", "verification_pending", "applying", "queued")
ALLOWED_STATUSES = (
    "saved", "queued", "applying", "needs_input", "verification_pending", "submitted", "phone_screen", "test", "interview",
    "offer", "accepted", "rejected", "failed",
)


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """Newest attempt per application; an aggregate, so a hot application is combined before the shuffle."""
    rest = [c for c in attempts.columns if c not in ("application_id", "started_at", "attempt_id")]
    best = attempts.groupBy("application_id").agg(F.max(F.struct("started_at", "attempt_id", *rest)).alias("a"))
    return best.select("application_id", "a.*")


def active_blocker(blockers: DataFrame) -> DataFrame:
    rest = [c for c in blockers.columns if c not in ("application_id", "created_at", "blocker_id")]
    opened = blockers.filter("status = 'open'").groupBy("application_id").agg(F.max(F.struct("created_at", "blocker_id", *rest)).alias("b"))
    return opened.select("application_id", "b.*")


def with_adapter(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``adapter`` and ``auto_supported`` from the link and the source's kind."""
    kinds = sources.select("source_id", F.col("kind").alias("source_kind"), F.col("identifier").alias("source_identifier"))
    rows = rows.join(kinds, "source_id", "left").withColumn("adapter", ats_family(F.col("apply_url"), F.col("source_kind")))
    return rows.withColumn("auto_supported", auto_submit(F.col("adapter")))


def auto_queue(rows: DataFrame, now: Column) -> DataFrame:
    """Automatic queue per user and track: the applying row that started first is current, waiting rows are newest first."""
    keys = ("user_id", "career_track")
    live = rows.filter("is_active AND mode = 'auto' AND auto_supported AND application_status IN ('queued', 'applying')")
    applying = live.filter("application_status = 'applying'").groupBy(*keys).agg(
        F.min(F.struct(F.coalesce("started_at", "application_updated_at").alias("t"), "application_id")).alias("c")).select(*keys, F.col("c.application_id").alias("current_id"))
    queued = positions(live.filter("application_status = 'queued'").select(*keys, "application_id", "application_updated_at"),
                       [F.col("application_updated_at").desc(), F.col("application_id").desc()], keys)
    queued = queued.join(applying, list(keys), "left")
    head = F.col("current_id").isNull() & (F.col("position") == 1)
    waiting = queued.select(*keys, "application_id", "position", F.when(head, "current").otherwise("waiting").alias("place"))
    running = applying.select(*keys, F.col("current_id").alias("application_id"), F.lit(None).cast("bigint").alias("position"), F.lit("current").alias("place"))
    minutes = F.greatest(F.lit(2), F.col("position") * 2)
    start = F.when(F.col("position").isNotNull(), now + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int")))
    return running.unionByName(waiting).withColumn("expected_start", start)


def review_queue_next(rows: DataFrame) -> DataFrame:
    """Per user and track: the next review task (oldest first) and the next automatic task (newest first)."""
    queued = rows.filter("is_active AND application_status = 'queued'")
    key = F.struct("application_updated_at", "application_id")
    return queued.groupBy("user_id", "career_track").agg(
        F.min(F.when(F.col("mode") != "auto", key))["application_id"].alias("next_review"),
        F.max(F.when((F.col("mode") == "auto") & F.col("auto_supported"), key))["application_id"].alias("next_auto"))


def stage_explain(blocker: Column) -> Column:
    """struct(stage, waiting_for) of an application; ``blocker`` says whether one is open."""
    status, auto = F.col("application_status"), (F.col("mode") == "auto") & F.col("auto_supported")
    rules = (
        ((status == "applying") & blocker, "stopped", "user_answer"), (status == "applying", "in_progress", "form_step"),
        ((status == "queued") & auto, "waiting_in_queue", "next_worker"), (status == "queued", "not_in_auto_queue", "manual_handling"),
        ((status == "needs_input") & blocker, "stopped", "question"), (status == "needs_input", "stopped", "user_answer"),
        (status == "verification_pending", "awaiting_verification", "site_or_mail"), (status == "failed", "failed", "retry"),
        (status == "submitted", "submitted", "none"),
    )
    value = lambda stage, wait: F.struct(F.lit(stage).alias("stage"), F.lit(wait).alias("waiting_for"))
    chain = reduce(lambda c, r: c.when(r[0], value(r[1], r[2])), rules[1:], F.when(rules[0][0], value(*rules[0][1:])))
    return chain.otherwise(F.struct(status.alias("stage"), F.lit("none").alias("waiting_for")))


def timeline(events: DataFrame, order: list[Column]) -> DataFrame:
    """Events newest first per application, with the status before and whether the chain is unbroken."""
    rows = previous(events, order, ("application_id",), "to_status", "expected_from")
    last = rows.groupBy("application_id").agg(F.max("position").alias("_last"))
    rows = rows.join(last, "application_id").withColumn("newest_first", F.col("_last") - F.col("position") + 1)
    return rows.withColumn("continuous", F.col("expected_from").isNull() | (F.col("expected_from") == F.col("from_status"))).drop("_last")


def status_change_events(events: DataFrame, order: list[Column]) -> DataFrame:
    """One event per real change of status, over the allowed statuses."""
    valid = events.filter(F.col("to_status").isin(*ALLOWED_STATUSES))
    rows = previous(valid, order, ("application_id",), "to_status", "from_status_known")
    return rows.filter(~F.col("from_status_known").eqNullSafe(F.col("to_status")))


def funnel_fold(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Current status of each application from its log of agent results (the last result decides)."""
    last = events.groupBy("application_id").agg(
        F.max(F.struct("ts", "event_id", "result", "verified", "uncertain")).alias("last"),
        F.count_if(F.col("result") == "started").alias("attempts"),
        F.max(F.when((F.col("result") == "submitted") & F.col("verified"), F.col("ts"))).alias("last_verified"))
    result = F.col("last.result")
    status = (
        F.when(result == "submitted", F.when(F.col("last.verified"), "submitted").otherwise("verification_pending"))
        .when(result == "blocked", F.when(F.col("last.uncertain"), "verification_pending").otherwise("needs_input"))
        .when(result == "failed", "failed").when(result == "recover", F.when(F.col("attempts") < max_attempts, "queued").otherwise("needs_input"))
        .otherwise("applying")
    )
    return last.select("application_id", status.alias("status"), "attempts", F.when(status == "submitted", F.col("last_verified")).alias("submitted_at"))


def manual_submit(rows: DataFrame, now: Column) -> DataFrame:
    """Applications marked as submitted by hand: first submission date kept, review becomes manual."""
    return rows.withColumns({
        "new_status": F.lit("submitted"), "new_mode": F.when(F.col("mode") == "review", "manual").otherwise(F.col("mode")),
        "new_submitted_at": F.coalesce("submitted_at", now)})


def receipt_reconcile(rows: DataFrame, blockers: DataFrame, now: Column) -> DataFrame:
    """Pending applications whose open confirmation blocker has a link that proves success."""
    missing = active_blocker(blockers.filter("kind = 'confirmation_missing'")).select("application_id", "blocker_id", "page_url")
    pending = rows.filter("application_status = 'verification_pending' AND adapter = 'lever'").join(missing, "application_id")
    proof = confirmation(F.col("page_url"))
    proven = pending.withColumns({"evidence": proof["evidence"], "external_id": proof["application_id"]}).filter("evidence <> ''")
    return proven.withColumns({"new_status": F.lit("submitted"), "new_submitted_at": F.coalesce("submitted_at", now)})


def requeue_once(rows: DataFrame, retry_count: Column) -> DataFrame:
    """Automatic applications stopped on a branded page go back to the queue once, on the native link."""
    native = native_apply_url(F.col("source_kind"), F.col("source_identifier"), F.col("external_id"), F.col("apply_url"))
    same = lambda a, b: F.rtrim(F.trim(a), F.lit("/")) == F.rtrim(b, F.lit("/"))
    ready = ((F.col("mode") == "auto") & F.col("kind").isin("submit_button_missing", "application_form_missing") & (F.col("adapter") == "greenhouse")
             & (F.col("native_url") != F.trim("apply_url")) & ~same(F.col("page_url"), F.col("native_url")) & (retry_count < 1))
    return rows.withColumn("native_url", native).withColumn("requeue", ready)


def campaign_activate(selected: DataFrame, current: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Queue the selected postings that still qualify; ``spent`` grows by what was queued."""
    valid = (F.col("is_active") & F.col("status").isin("new", "saved", "failed") & F.col("ready")
             & ~F.coalesce(F.col("application_status").isin(*IN_PIPELINE), F.lit(False)))
    queued = selected.select("campaign_id", "job_id").join(current.filter(valid).select("job_id"), "job_id").groupBy("campaign_id").agg(F.count("*").alias("queued"))
    rows = campaigns.select("campaign_id", "spent").join(queued, "campaign_id", "left")
    queued_count = F.coalesce("queued", F.lit(0))
    return rows.select("campaign_id", queued_count.alias("queued"), (F.col("spent") + queued_count).alias("spent"))
