"""URL column functions: parts, identity key, application system, native and confirmation links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacantia import lexicons as L
from vacantia.functions.text import contains_any

AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
GREENHOUSE_BOARD = "https://job-boards.greenhouse.io/"
LEVER_HOSTS = ("jobs.lever.co", "jobs.eu.lever.co")
LEVER_EVIDENCE = "Lever confirmation page reached after submitting the application"


def _text(url: Column) -> Column:
    return F.trim(F.coalesce(url, F.lit("")))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_text(url), "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(_text(url), AUTHORITY, 1))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", "")


def path(url: Column) -> Column:
    without_authority = F.regexp_replace(F.regexp_replace(_text(url), AUTHORITY, ""), "^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    return F.regexp_extract(without_authority, "^([^?#]*)", 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def query_pairs(url: Column) -> Column:
    """array<struct(name, value)> of the decoded query string; blank values are left out."""
    query = F.regexp_extract(_text(url), r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p.contains("=")), lambda p: F.struct(
        F.try_url_decode(F.substring_index(p, "=", 1)).alias("name"),
        F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("value")))
    return F.filter(pairs, lambda p: p["value"] != "")


def url_key(url: Column) -> Column:
    """Host and path plus the parameters that identify a posting; tracking parameters do not count."""
    base = F.concat(authority(url), F.lower(F.rtrim(path(url), F.lit("/"))))
    identity = F.array_sort(F.transform(
        F.filter(query_pairs(url), lambda p: F.lower(p["name"]).isin(*L.URL_IDENTITY_PARAMS)),
        lambda p: F.concat(F.lower(p["name"]), F.lit("="), F.lower(p["value"]))))
    return F.when(F.size(identity) > 0, F.concat(base, F.lit("?"), F.array_join(identity, "&"))).otherwise(base)


def resolve_url(base: Column, target: Column) -> Column:
    """``target`` seen from the page ``base``: absolute, scheme-relative, root-relative or relative."""
    target = _text(target)
    origin = F.concat(scheme(base), F.lit("://"), F.regexp_extract(_text(base), AUTHORITY, 1))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(target == "", "").when(target.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme(base), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.rlike("^[?#]"), F.concat(origin, path(base), target))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target))
    )


def ats_family(url: Column, kind: Column) -> Column:
    """Application system from the link and the kind of the source, by priority."""
    kind = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    site = authority(url)
    everything = F.concat_ws(" ", site, F.lower(path(url)), kind)
    return (
        F.when(everything.contains("greenhouse"), "greenhouse").when(everything.contains("comeet"), "comeet")
        .when(site.contains("lever.co") | (kind == "lever"), "lever")
        .when(site.contains("ashbyhq.com") | (kind == "ashby"), "ashby")
        .when(site.contains("myworkdayjobs.com") | everything.contains("workday"), "workday")
        .when(site.contains("smartrecruiters.com") | kind.contains("smartrecruiters"), "smartrecruiters")
        .otherwise("custom")
    )


def auto_submit(family: Column) -> Column:
    return family.isin(*[name for name, automatic in L.ATS_FAMILIES.items() if automatic])


def native_apply_url(kind: Column, identifier: Column, external_id: Column, apply_url: Column) -> Column:
    """Board-hosted application page for boards that expose a branded link; otherwise the original link."""
    identifier = F.trim(F.coalesce(identifier, F.lit("")))
    token = F.regexp_replace(identifier, "^(?i)eu:", "")
    posting = F.trim(F.coalesce(external_id, F.lit("")))
    plus_to_space = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    hosted = F.concat(F.lit(GREENHOUSE_BOARD), plus_to_space(token), F.lit("/jobs/"), plus_to_space(posting))
    usable = (F.lower(F.trim(F.coalesce(kind, F.lit("")))) == "greenhouse") & (token != "") & (posting != "")
    return F.when(usable, hosted).otherwise(_text(apply_url))


def confirmation(url: Column) -> Column:
    """struct(evidence, application_id); both empty when the link proves nothing."""
    tail = F.lower(F.rtrim(path(url), F.lit("/")))
    ids = F.filter(query_pairs(url), lambda p: F.lower(p["name"]) == "leverappid")
    application = F.coalesce(F.get(ids, 0)["value"], F.lit(""))
    result = lambda text, value: F.struct(text.alias("evidence"), value.alias("application_id"))
    return (
        F.when(host(url).isin(*LEVER_HOSTS) & tail.endswith("/thanks"), result(F.lit(LEVER_EVIDENCE), F.lit("")))
        .when(host(url).isin("lever.co", "www.lever.co") & (tail == "/hp-b") & (application != ""),
              result(F.concat(F.lit("Lever accepted the application (application id: "), application, F.lit(")")), application))
        .otherwise(result(F.lit(""), F.lit("")))
    )


def company_site(company: Column, apply_url: Column) -> Column:
    """Careers page of a known company, else the https origin of the link, else ''."""
    name = F.trim(F.lower(F.coalesce(company, F.lit(""))))
    known = [F.when(contains_any(name, aliases), F.lit(site)) for aliases, site in L.CAREER_SITES.values()]
    netloc = F.regexp_extract(F.coalesce(apply_url, F.lit("")), AUTHORITY, 1)
    origin = F.when((scheme(apply_url) == "https") & (netloc != ""), F.concat(F.lit("https://"), netloc))
    return F.coalesce(*known, origin, F.lit(""))


def web_link(url: Column) -> Column:
    """An http(s) link with a host."""
    return F.coalesce(scheme(url).isin("http", "https") & (authority(url) != ""), F.lit(False))
