"""Normalisers for landed job-board payloads.

Input: one row per landed API page, ``(source_id, company, token, payload)`` with the page's JSON text, so a
large board is many rows.  Output: the posting contract.  Broken payloads give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.dates import parse_posted_at
from vacantia.functions.locations import workplace_detect
from vacantia.functions.text import html_to_text, squeeze, truthy
from vacantia.schemas import POSTING, conform

UNTITLED = "Untitled role"

GREENHOUSE = ("jobs array<struct<id: string, title: string, location: struct<name: string>, content: string, absolute_url: string, "
              "first_published: string, updated_at: string>>")
LEVER = ("array<struct<id: string, text: string, categories: struct<location: string>, workplaceType: string, description: string, "
         "lists: array<struct<content: string>>, additional: string, applyUrl: string, hostedUrl: string, createdAt: string>>")
ASHBY = ("jobs array<struct<id: string, title: string, location: string, isRemote: boolean, descriptionHtml: string, descriptionPlain: string, "
         "applyUrl: string, jobUrl: string, publishedAt: string>>")
SMART_LIST = ("content array<struct<id: string, uuid: string, name: string, ref: string, location: struct<city: string, region: string, country: string, "
              "countryCode: string, remote: boolean>, applyUrl: string, postingUrl: string, releasedDate: string>>")
SMART_DETAIL = ("id string, name string, location struct<city: string, region: string, country: string, countryCode: string, remote: boolean>, "
                "jobAd struct<sections: map<string, struct<title: string, text: string>>>, applyUrl string, postingUrl string, releasedDate string")
WORKDAY_LIST = "jobPostings array<struct<title: string, externalPath: string, locationsText: string, bulletFields: array<string>>>"
WORKDAY_DETAIL = "jobPostingInfo struct<title: string, location: string, jobDescription: string, externalUrl: string>"


def _first(*columns: Column) -> Column:
    return F.coalesce(*[truthy(c) for c in columns], F.lit(""))


def _items(raw: DataFrame, schema: str, field: str | None) -> DataFrame:
    parsed = F.from_json("payload", schema)
    rows = raw.select("source_id", "company", "token", *[c for c in ("seq",) if c in raw.columns], F.posexplode(parsed[field] if field else parsed).alias("pos", "j"))
    return rows.withColumn("company", _first(F.col("company"), F.col("token")))


def normalize_greenhouse(raw: DataFrame) -> DataFrame:
    place, content = F.coalesce("j.location.name", F.lit("")), F.coalesce("j.content", F.lit(""))
    rows = _items(raw, GREENHOUSE, "jobs").select(
        "source_id", F.col("j.id").alias("external_id"), _first(F.col("j.title"), F.lit(UNTITLED)).alias("title"), "company", place.alias("location"),
        workplace_detect(content, place).alias("workplace"), html_to_text(content).alias("description"),
        _first(F.col("j.absolute_url")).alias("apply_url"), _first(F.col("j.absolute_url")).alias("source_url"),
        parse_posted_at(F.coalesce(truthy(F.col("j.first_published")), F.col("j.updated_at"))).alias("published_at"))
    return conform(rows, POSTING)


def normalize_lever(raw: DataFrame) -> DataFrame:
    place, kind = F.coalesce("j.categories.location", F.lit("")), F.lower(F.coalesce("j.workplaceType", F.lit("")))
    lists = F.array_join(F.transform(F.coalesce("j.lists", F.array().cast("array<struct<content: string>>")), lambda s: html_to_text(s["content"])), " ")
    parts = F.filter(F.array(html_to_text(F.col("j.description")), lists, html_to_text(F.col("j.additional"))), lambda p: p != "")
    rows = _items(raw, LEVER, None).select(
        "source_id", F.col("j.id").alias("external_id"), _first(F.col("j.text"), F.lit(UNTITLED)).alias("title"), "company", place.alias("location"),
        F.when(kind.isin("remote", "hybrid", "onsite"), kind).otherwise("unknown").alias("workplace"), F.array_join(parts, " ").alias("description"),
        _first(F.col("j.applyUrl"), F.col("j.hostedUrl")).alias("apply_url"), _first(F.col("j.hostedUrl"), F.col("j.applyUrl")).alias("source_url"),
        parse_posted_at(F.col("j.createdAt")).alias("published_at"))
    return conform(rows, POSTING)


def normalize_ashby(raw: DataFrame) -> DataFrame:
    place, html = F.coalesce("j.location", F.lit("")), F.coalesce("j.descriptionHtml", F.lit(""))
    rows = _items(raw, ASHBY, "jobs").select(
        "source_id", _first(F.col("j.id"), F.col("j.jobUrl"), F.col("j.applyUrl")).alias("external_id"), _first(F.col("j.title"), F.lit(UNTITLED)).alias("title"),
        "company", place.alias("location"), F.when(F.col("j.isRemote"), "remote").otherwise(workplace_detect(html, place, "hybrid")).alias("workplace"),
        html_to_text(_first(F.col("j.descriptionHtml"), F.col("j.descriptionPlain"))).alias("description"),
        _first(F.col("j.applyUrl"), F.col("j.jobUrl")).alias("apply_url"), _first(F.col("j.jobUrl"), F.col("j.applyUrl")).alias("source_url"),
        parse_posted_at(F.col("j.publishedAt")).alias("published_at"))
    return conform(rows, POSTING)


def _last_per_id(rows: DataFrame) -> DataFrame:
    """A board may repeat an id; the last landed row wins (an aggregate, so repeats combine before the shuffle)."""
    rest = [c for c in rows.columns if c not in ("source_id", "external_id", "_order")]
    best = rows.groupBy("source_id", "external_id").agg(F.max_by(F.struct(*rest), "_order").alias("b"))
    return best.select("source_id", "external_id", "b.*")


def normalize_smartrecruiters(raw: DataFrame, details: DataFrame) -> DataFrame:
    """List rows with their detail payload ``(source_id, id, payload)`` where it was landed."""
    rows = _items(raw, SMART_LIST, "content").withColumn("id", F.trim(_first(F.col("j.id"), F.col("j.uuid")))).filter("id <> ''")
    detail = details.select("source_id", "id", F.from_json("payload", SMART_DETAIL).alias("d"))
    rows = rows.join(detail, ["source_id", "id"], "left")
    place = F.coalesce("d.location", "j.location")
    text = lambda name: F.trim(F.coalesce(place[name], F.lit("")))
    raw_country = _first(text("country"), text("countryCode"))
    code = F.when(F.length(raw_country) == 2, F.lower(raw_country)).otherwise(F.lower(text("countryCode")))
    country = F.when(code == "il", "Israel").otherwise(raw_country)
    named = F.array_join(F.array_distinct(F.filter(F.array(text("city"), text("region"), country), lambda p: p != "")), ", ")
    sections = F.map_values(F.coalesce("d.jobAd.sections", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<title: string, text: string>>"))))
    pieces = F.flatten(F.transform(sections, lambda s: F.array(F.trim(F.coalesce(s["title"], F.lit(""))), html_to_text(s["text"]))))
    either = lambda name: _first(F.col(f"d.{name}"), F.col(f"j.{name}"))
    rows = rows.select(
        "source_id", F.col("id").alias("external_id"), F.struct("seq", "pos").alias("_order"), _first(F.col("d.name"), F.col("j.name"), F.lit(UNTITLED)).alias("title"), "company", named.alias("location"),
        F.when(F.coalesce(place["remote"], F.lit(False)) | F.lower(named).contains("remote"), "remote").otherwise("onsite").alias("workplace"),
        F.array_join(F.filter(pieces, lambda p: p != ""), "\n\n").alias("description"), either("applyUrl").alias("apply_url"),
        _first(F.col("d.postingUrl"), F.col("j.postingUrl"), F.col("d.applyUrl"), F.col("j.applyUrl")).alias("source_url"), parse_posted_at(either("releasedDate")).alias("published_at"))
    return conform(_last_per_id(rows), POSTING)


# Markers and cities of the per-tenant rules.
WORKDAY_GENERIC_MARKERS = ("israel", "jerusalem", "yavne", "migdal", "haifa", "tel aviv", "tel-aviv")
WORKDAY_MATERIALS_MARKERS = ("israel", "isr", "rehovot")
WORKDAY_CITIES = ("Jerusalem", "Yavne", "Migdal Haemek", "Haifa", "Tel Aviv", "Kiryat Gat", "Petah Tikva")


def _workday_keeps(rule: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce("j.locationsText", F.lit("")), F.coalesce("j.externalPath", F.lit("")), F.coalesce("j.title", F.lit(""))))
    any_in = lambda terms: text.rlike("|".join(terms))
    return (F.when(rule == "materials", any_in(WORKDAY_MATERIALS_MARKERS)).when(rule == "generic", any_in(WORKDAY_GENERIC_MARKERS))
            .otherwise(F.coalesce(F.col("j.externalPath").contains("/job/Israel-"), F.lit(False))))


def _workday_place(rule: Column, place: Column, path: Column) -> Column:
    compact = squeeze(place)
    suffixed = F.when(compact == "", "Israel").otherwise(F.concat(compact, F.lit(", Israel")))
    israel = F.lower(compact).contains("israel")
    repaired = squeeze(F.replace(F.replace(place, F.lit(",ISR"), F.lit(", Israel")), F.lit(", ISR"), F.lit(", Israel")))
    rehovot = F.lit("Rehovot, Israel")
    materials = (F.when(F.lower(repaired).contains("rehovot") & ~F.lower(repaired).contains("israel"), rehovot).when(F.lower(repaired).contains("israel"), repaired)
                 .when(F.lower(path).contains("rehovot"), rehovot).when(repaired == "", "Israel").otherwise(F.concat(repaired, F.lit(", Israel"))))
    text = F.lower(F.concat(compact, F.lit(" "), F.translate(path, "-_", "  ")))
    city = F.coalesce(*[F.when(text.contains(c.lower()), F.lit(f"{c}, Israel")) for c in WORKDAY_CITIES])
    generic = F.when(israel, compact).otherwise(F.coalesce(city, suffixed))
    from_path = F.initcap(F.replace(F.regexp_extract(path, "/job/Israel-([^/]+)", 1), F.lit("-"), F.lit(" ")))
    plain = F.when(F.lower(place).contains("israel"), place).when(from_path == "", "Israel").otherwise(F.concat(from_path, F.lit(", Israel")))
    return F.when(rule == "materials", materials).when(rule == "generic", generic).otherwise(plain)


def normalize_workday(raw: DataFrame, details: DataFrame, tenants: DataFrame) -> DataFrame:
    """List rows ⟕ details ``(source_id, path, payload)``; ``tenants`` (source_id, rule, host, site) is a small parameter table."""
    rows = _items(raw, WORKDAY_LIST, "jobPostings").join(tenants, "source_id").filter(_workday_keeps(F.col("rule")))
    rows = rows.withColumn("path", F.coalesce("j.externalPath", F.lit("")))
    detail = details.select("source_id", "path", F.from_json("payload", WORKDAY_DETAIL)["jobPostingInfo"].alias("d"))
    rows = rows.join(detail, ["source_id", "path"], "left")
    place = _workday_place(F.col("rule"), _first(F.col("d.location"), F.col("j.locationsText"), F.lit("Israel")), F.col("path"))
    page = F.concat(F.lit("https://"), "host", F.lit("/en-US/"), "site", "path")
    rows = rows.select(
        "source_id", _first(F.get("j.bulletFields", 0), F.substring_index("path", "_", -1)).alias("external_id"), F.struct("seq", "pos").alias("_order"),
        _first(F.col("d.title"), F.col("j.title"), F.lit(UNTITLED)).alias("title"), "company", place.alias("location"),
        F.when(F.lower(place).contains("remote"), "remote").otherwise("onsite").alias("workplace"), html_to_text(F.col("d.jobDescription")).alias("description"),
        _first(F.col("d.externalUrl"), page).alias("apply_url"), page.alias("source_url"), F.lit(None).cast("timestamp").alias("published_at"))
    return conform(_last_per_id(rows), POSTING)
