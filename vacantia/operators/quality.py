"""Quality gates of a source batch and of the stored catalogue, and the scan summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import lexicons as L
from vacantia.functions.text import squeeze, text_quality
from vacantia.functions.urls import url_key

UUID_TITLE = r"^[0-9a-f]{8}[\s-]+[0-9a-f]{4}[\s-]+[0-9a-f]{4}[\s-]+[0-9a-f]{4}[\s-]+[0-9a-f]{12}$"


def _norm(name: str) -> Column:
    return squeeze(F.lower(F.col(name)))


def _at_least(count: Column, floor: int, share: float) -> Column:
    return count >= F.greatest(F.lit(floor), F.ceil(F.col("n") * share).cast("bigint"))


def value_mode(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent non-empty value per group (ties: first in order) by two-level counting."""
    counts = rows.filter(F.col(value) != "").groupBy(*keys, value).agg(F.count("*").alias("c"))
    best = F.max_by(F.struct(F.col("c").alias("count"), F.col(value).alias("value")), F.struct("c", value))
    return counts.groupBy(*keys).agg(F.max("c").alias(f"{name}_count"), F.count("*").alias(f"{name}_distinct"), best["value"].alias(f"{name}_value"))


def batch_profile(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts the gates need, one row per source batch.  Every count is a partial aggregate."""
    rows = postings.select(
        *keys, _norm("title").alias("title"), _norm("location").alias("location"), _norm("external_id").alias("external_id"),
        F.trim(F.coalesce("apply_url", F.lit(""))).alias("url"), url_key(F.col("apply_url")).alias("url_key"),
        (text_quality(F.col("description")) == "missing").alias("no_text"))
    count_if = lambda c, name: F.count_if(c).alias(name)
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        count_if((F.col("external_id") == "") | (F.col("title") == "") | (F.col("url") == ""), "missing_core"),
        count_if(F.col("title").rlike(UUID_TITLE), "uuid_titles"), count_if(F.col("title").isin(*L.GENERIC_BATCH_TITLES), "generic_titles"),
        count_if(F.col("no_text"), "missing_text"), count_if(F.col("location").isin(*L.GENERIC_REGION_NAMES), "generic_locations"))
    # Distinct counts go through a grouped pre-aggregation, so a hot source is spread over its values.
    for value, name in (("title", "title"), ("location", "location"), ("external_id", "id"), ("url_key", "link")):
        counts = counts.join(value_mode(rows, keys, value, name), keys, "left")
    numbers = [c for c in counts.columns if c.endswith(("_count", "_distinct"))]
    return counts.fillna(0, numbers)


def payload_gate(profile: DataFrame) -> DataFrame:
    """Add ``gate``: the first gate the batch fails, or null when it passes."""
    n, col = F.col("n"), F.col
    ratio = lambda name: col(name) / n
    dominant = (col("title_count") >= 5) & ((ratio("title_count") >= 0.80) | ((ratio("title_count") >= 0.45) & (ratio("location_count") >= 0.75)))
    few = lambda name: (col(name) > 0) & (col(name) <= F.greatest(F.lit(2), F.floor(n * 0.35).cast("bigint")))
    gate = (
        F.when((n >= 5) & _at_least(col("missing_core"), 2, 0.20), "missing_core").when((n >= 5) & _at_least(col("uuid_titles"), 3, 0.25), "uuid_titles")
        .when((n >= 5) & _at_least(col("generic_titles"), 3, 0.35), "generic_titles").when((n >= 5) & _at_least(col("missing_text"), 3, 0.50), "missing_text")
        .when((n >= 8) & dominant, "dominant_title").when((n >= 8) & few("id_distinct"), "few_ids").when((n >= 8) & few("link_distinct"), "few_links")
        .when((n >= 20) & (col("generic_locations") >= F.ceil(n * 0.80)), "generic_region")
    )
    return profile.withColumn("gate", gate)


def corruption_scan(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Stored sources that carry the signature of a broken page parser."""
    rows = postings.select(*keys, squeeze(F.lower("title")).alias("title"), squeeze(F.lower("location")).alias("location"))
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("title").rlike(UUID_TITLE)).alias("uuid_titles"),
        F.count_if(F.col("location") == "israel").alias("generic_locations"))
    for value in ("title", "location"):
        counts = counts.join(value_mode(rows, keys, value, value), keys, "left").fillna(0, [f"{value}_count"])
    n, whole = F.col("n"), lambda share: F.floor(F.col("n") * share).cast("bigint")
    uuid = F.col("uuid_titles") >= F.greatest(F.lit(3), F.floor(n / 3).cast("bigint"))
    generic = F.col("generic_locations") >= F.greatest(F.lit(10), whole(0.8))
    dominant = ((n >= 8) & (F.col("title_count") >= F.greatest(F.lit(5), whole(0.45)))
                & (F.col("location_count") >= F.greatest(F.lit(5), whole(0.75))))
    return counts.withColumn("signature", F.when(uuid, "uuid_titles").when(generic, "generic_locations").when(dominant, "dominant_title"))


def scan_summary(actions: DataFrame, judged: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source and in total: what was collected, filtered, added, updated and removed."""
    collected = judged.groupBy("source_id").agg(
        F.count("*").alias("collected"), F.count_if("in_region").alias("region_found"), F.count_if("eligible").alias("found"))
    changes = actions.groupBy("source_id").agg(
        F.count_if(F.col("action") == "insert").alias("new"), F.count_if(F.col("action").isin("update", "reactivate")).alias("updated"),
        F.count_if(F.col("action") == "remove").alias("removed"))
    rows = sources.join(collected, "source_id", "left").join(changes, "source_id", "left").fillna(0)
    rows = rows.withColumns({"filtered_foreign": F.col("collected") - F.col("region_found"), "filtered_mismatch": F.col("region_found") - F.col("found")})
    total = lambda name: F.sum(name).alias(name)
    names = ("collected", "region_found", "found", "filtered_foreign", "filtered_mismatch", "new", "updated", "removed")
    summary = rows.rollup("source_id").agg(*[total(n) for n in names], F.count_if("failed").alias("failed_sources"), F.count("*").alias("sources"))
    status = (F.when(F.col("sources") == 0, "no_sources").when(F.col("failed_sources") == 0, "ok")
              .when(F.col("failed_sources") < F.col("sources"), "partial").otherwise("failed"))
    return summary.withColumn("status", status)
