"""Titles of landed link rows: recognise, resolve from links and slugs, repair per source."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacantia import lexicons as L
from vacantia.functions.text import squeeze, truthy
from vacantia.functions.urls import path_parts

CTA_EDGES = " .…→-"
# Per-source recovery of a title from the text of its card.
CARD_TITLES = (
    ("texas-instruments", r"(?i)^(.+?)\s+(?:Israel|Ra['’]anana, Israel)\s+POSTING DATE"),
    ("speedata", r"(?i)^(.+?)\s+Israel\s+About the position"),
    ("camtek", r"(?i)^(.+?)\s+(?:R&D|Marketing|Operations|Engineering|Product|Applications?)\s+Migdal"),
)
CAMTEK_CODE = "^[A-Fa-f0-9]{2,3}[.-][A-Fa-f0-9]{3}$"
BLANK_TITLES = (("samsung", "SNS"), ("samsung", "\\"), ("sentinelone", "SNS"), ("sentinelone", "\\"))


def call_to_action(title: Column) -> Column:
    generic = sorted({t.strip(CTA_EDGES) for t in L.GENERIC_LINK_TITLES})
    return F.btrim(F.lower(title), F.lit(CTA_EDGES)).isin(*generic)


def human(title: Column) -> Column:
    """A single text that reads like a job title, not a call to action or an infrastructure id."""
    text = squeeze(title)
    slug = F.regexp_replace(text, r"\s+", "-")
    return ((text != "") & ~call_to_action(text) & ~text.rlike("^(?i)ref[0-9]+[a-z]?$")
            & ~slug.rlike("^(?i)(?:oracle|seat)-[a-f0-9-]+(?:-t[0-9]+)?-[0-9]+$"))


def title_human(title: Column, link_text: Column) -> Column:
    return human(title) | human(link_text)


def slug_title(slug: Column, upper=L.UPPERCASE_SLUG_WORDS) -> Column:
    words = F.filter(F.split(F.replace(slug, F.lit("_"), F.lit("-")), "-"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(*upper), F.upper(w)).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))), " ")


def link_slug(href: Column, offset: int) -> Column:
    parts = F.filter(F.split(F.regexp_extract(href, r"^([^?]*)", 1), "/"), lambda p: p != "")
    slug = F.coalesce(F.try_element_at(parts, F.lit(offset)), F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.regexp_replace(slug, "^(?i)(?:job|position)-", "")


def title_resolve(title: Column, link_text: Column, href: Column, force_slug: bool = False, offset: int = -1,
                  prefer_link_text: bool = False) -> Column:
    """Heading, else link text, else the slug of the link when the visible text is a call to action."""
    heading = squeeze(title)
    if prefer_link_text:
        first_line = F.get(F.filter(F.transform(F.split(F.coalesce(link_text, F.lit("")), "[\\r\\n]+"), lambda x: F.trim(x)),
                                    lambda x: x != ""), 0)
        shown = F.coalesce(truthy(first_line), heading)
    else:
        shown = F.coalesce(truthy(heading), squeeze(link_text))
    from_slug = slug_title(link_slug(href, offset))
    if force_slug:
        return from_slug
    return F.when((shown == "") | call_to_action(shown), from_slug).otherwise(shown)


def slug_title_positional(url: Column) -> Column:
    """Title from the second-last path part when the part before it is ``jobs``."""
    parts = path_parts(url)
    fits = F.coalesce(F.try_element_at(parts, F.lit(-3)) == "jobs", F.lit(False))
    return F.when(fits, slug_title(F.try_element_at(parts, F.lit(-2)), (*L.UPPERCASE_SLUG_WORDS, "c"))).otherwise("")


def title_repair(source: Column, title: Column, text: Column) -> Column:
    """Per-source recovery of a title from the card text."""
    compact = squeeze(text)
    found = {name: F.trim(F.regexp_extract(compact, pattern, 1)) for name, pattern in CARD_TITLES}
    code = title.rlike(CAMTEK_CODE)
    result = F.when((source == "camtek") & (F.lower(title) == "open positions"), "")
    result = result.when((source == "camtek") & code, found["camtek"])
    for name in ("texas-instruments", "speedata"):
        result = result.when((source == name) & (found[name] != ""), found[name])
    for name, blank in BLANK_TITLES:
        result = result.when((source == name) & (F.trim(title) == blank), "")
    return result.otherwise(title)
