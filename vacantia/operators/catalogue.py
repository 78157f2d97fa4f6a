"""Source snapshots against the stored catalogue: reconcile, duplicates, retention, retirement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.dates import days_before
from vacantia.functions.features import track_relevance
from vacantia.functions.locations import in_region
from vacantia.operators.filters import submitted_history, with_exclusion

KEY = ["source_id", "external_id"]
LEGAL_WORDS = r"(?U)\b(ltd|inc|corp|corporation|israel|ישראל)\b"


def _clean(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), LEGAL_WORDS, " ")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9א-ת+#]+", " "))


def fingerprint(title: Column, company: Column, location: Column) -> Column:
    """Duplicate key that tolerates punctuation and company forms."""
    place = F.replace(_clean(location), F.lit("tel aviv yafo"), F.lit("tel aviv"))
    return F.concat_ws("|", _clean(title), _clean(company), place)


def judged(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add region, exclusion and track verdicts and ``eligible``."""
    rows = with_exclusion(rows, profiles).withColumns({
        "in_region": in_region(F.col("location")),
        "on_track": track_relevance(F.col("title"), F.col("description"), F.col("career_track"))["relevant"],
    })
    return rows.withColumn("eligible", F.col("in_region") & F.col("exclusion").isNull() & F.col("on_track"))


def removal_reason(listed: Column) -> Column:
    """Why a stored posting leaves the catalogue, by priority; null keeps it."""
    return (F.when(~F.col("in_region"), "outside_region").when(F.col("exclusion").isNotNull(), "hard_exclusion")
            .when(~F.col("on_track"), "track_mismatch").when(~listed, "no_longer_listed"))


def snapshot_reconcile(catalogue: DataFrame, snapshot: DataFrame, profiles: DataFrame) -> DataFrame:
    """One action per posting key: insert, update, reactivate, remove (with reason), keep or skip.

    Verdicts are computed on both sides before the join, so only keys and flags are shuffled.  Stored
    postings are compared with everything the source lists in the region, not only with what the
    profile wants.
    """
    stored = judged(catalogue, profiles).select(*KEY, "is_active", "in_region", "exclusion", "on_track", F.lit(True).alias("stored"))
    listed = judged(snapshot, profiles).select(*KEY, F.col("in_region").alias("listed"), F.col("eligible").alias("listed_eligible"))
    # A board can list an id twice; one row per key decides (any valid listing counts).
    listed = listed.groupBy(*KEY).agg(F.max("listed").alias("listed"), F.max("listed_eligible").alias("listed_eligible"))
    rows = stored.join(listed, KEY, "full_outer")
    is_listed, eligible = F.coalesce("listed", F.lit(False)), F.coalesce("listed_eligible", F.lit(False))
    reason = F.when(F.col("stored") & ~eligible, removal_reason(is_listed))
    action = (
        F.when(eligible & F.col("stored").isNull(), "insert").when(eligible & ~F.col("is_active"), "reactivate").when(eligible, "update")
        .when(reason.isNotNull(), "remove").when(F.col("stored"), "keep").otherwise("skip")
    )
    return rows.select(*KEY, action.alias("action"), reason.alias("reason"))


def duplicate_links(catalogue: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Alternate links: arrivals whose fingerprint already stands under another source of the same user.

    The winner of a user's fingerprint is the oldest active catalogue posting, else the first arrival.  The result
    is a table of links (one row per posting and new url), never a list collected per posting.
    """
    mark = fingerprint(F.col("title"), F.col("company"), F.col("location")).alias("fingerprint")
    stored = catalogue.filter("is_active").select("user_id", mark, F.lit(0).alias("rank"), "discovered_at", "source_id", "external_id", "apply_url")
    new = arrivals.select("user_id", mark, F.lit(1).alias("rank"), F.lit(None).cast("timestamp").alias("discovered_at"), "source_id", "external_id", "apply_url")
    winner = stored.union(new).groupBy("user_id", "fingerprint").agg(
        F.min(F.struct("rank", "discovered_at", "source_id", "external_id", "apply_url")).alias("winner"))
    links = new.join(winner, ["user_id", "fingerprint"]).filter(
        (F.col("winner.source_id") != F.col("source_id")) & (F.col("winner.apply_url") != F.col("apply_url")))
    return links.groupBy("user_id", F.col("winner.source_id").alias("job_source_id"), F.col("winner.external_id").alias("job_external_id"), "apply_url").agg(
        F.min(F.struct("source_id", "external_id")).alias("first")).select("user_id", "job_source_id", "job_external_id", "apply_url", "first.*")


def new_arrivals(catalogue: DataFrame, snapshot: DataFrame, profiles: DataFrame) -> DataFrame:
    """Eligible snapshot rows whose key the catalogue does not hold."""
    fresh = snapshot.join(catalogue.select(*KEY), KEY, "left_anti")
    return judged(fresh, profiles).filter("eligible")


def retention_action(now: Column, stale_days: int = 2, history_days: int = 30) -> Column:
    """What the purge does with a posting joined with its application: keep, delete or start_clock."""
    has_application, submitted = F.col("application_id").isNotNull(), submitted_history()
    reference = F.coalesce("removed_at", "published_at", "job_updated_at")
    before = lambda moment, days: F.coalesce(moment < days_before(now, days), F.lit(False))
    return (
        F.when(F.col("is_active"), "keep").when(has_application & ~submitted, "delete")
        .when(has_application & F.col("removed_at").isNull(), "start_clock")
        .when(has_application, F.when(before(F.col("removed_at"), history_days), "delete").otherwise("keep"))
        .otherwise(F.when(before(reference, stale_days), "delete").otherwise("keep"))
    )


def deactivate_or_delete(rows: DataFrame, now: Column) -> DataFrame:
    """Retire postings: submitted history stays inactive with its first removal date, the rest is deleted."""
    first = F.col("is_active") | F.col("removed_at").isNull()
    return rows.withColumns({
        "outcome": F.when(submitted_history(), "inactive").otherwise("deleted"),
        "removed_at": F.when(submitted_history() & first, now).when(submitted_history(), F.col("removed_at")),
    })


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows of a child table that survive the deletion of their parents."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def bounded_details(rows: DataFrame, order: list[Column], groups: list[str], size: int = 100) -> DataFrame:
    """First ``size`` rows per group for an audit entry, with the group's total and a truncated flag.

    The total is a partial aggregate; the top rows are cut by the row-number limit before the shuffle.
    """
    from pyspark.sql import Window

    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    top = ranked.filter(F.col("position") <= size)
    totals = rows.groupBy(*groups).agg(F.count("*").alias("total"))
    return top.join(totals, groups).withColumn("truncated", F.col("total") > size)
