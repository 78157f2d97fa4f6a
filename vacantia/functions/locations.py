"""Location column functions: normal form, region test, canonical city, tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacantia import lexicons as L
from vacantia.functions.text import let, matching_keys, quoted, sql_text, squeeze

# Full-width ASCII, ideographic space and bidi marks, the compatibility forms that occur in postings.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　‏‎ "
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "    "
REGION_REGEX = "(?iU)(?:" + "|".join(L.REGION_PATTERNS) + ")"
SPELLINGS = (("Beer Sheva", "Be'er Sheva"), ("Raanana", "Ra'anana"), ("Yoqneam", "Yokneam"))


def norm_location(text: Column) -> Column:
    return squeeze(F.translate(F.coalesce(text, F.lit("")), WIDE, NARROW))


def in_region(location: Column) -> Column:
    """True only when the text names the region or one of its places."""
    return norm_location(location).rlike(REGION_REGEX)


def canonical_name(city: str) -> str:
    for spelling, canonical in SPELLINGS:
        city = city.replace(spelling, canonical)
    return city


def canonical_city(text: Column) -> Column:
    """First rule that fires: Hebrew city, English city, a standalone ``IL``, the country; else ''."""
    hebrew = F.expr("array(" + ", ".join(f"named_struct('name', {sql_text(k)}, 'city', {sql_text(v)})" for k, v in L.HEBREW_CITIES.items()) + ")")
    english = F.expr("array(" + ", ".join(
        f"named_struct('name', {sql_text(c.lower())}, 'pattern', {sql_text(f'(?i)(?<![A-Za-z]){quoted(c)}(?![A-Za-z])')}, 'city', {sql_text(canonical_name(c) + ', Israel')})"
        for c in L.ENGLISH_CITIES) + ")")

    def city(pair: Column) -> Column:
        compact, low = pair["compact"], pair["low"]
        in_hebrew = F.get(F.filter(hebrew, lambda e: F.contains(compact, e["name"])), 0)["city"]
        # Literal tests on lower-case text are the cheap guards of the border tests.
        in_english = F.get(F.filter(english, lambda e: F.contains(low, e["name"]) & F.regexp_like(compact, e["pattern"])), 0)["city"]
        country = F.when(
            (low.contains("il") & compact.rlike("(?<![A-Za-z])IL(?![A-Za-z])")) | compact.contains("ישראל")
            | (low.contains("israel") & compact.rlike("(?i)(?<![A-Za-z])Israel(?![A-Za-z])")), F.lit("Israel"))
        return F.coalesce(in_hebrew, in_english, country, F.lit(""))

    return let(let(squeeze(text), lambda c: F.struct(c.alias("compact"), F.lower(c).alias("low"))), city)


def location_tokens(location: Column) -> Column:
    """The text itself plus the canonical places it names."""
    lowered = F.trim(F.lower(F.coalesce(location, F.lit(""))))
    named = matching_keys(lowered, L.LOCATION_ALIASES)
    own = F.when(lowered == "", F.array().cast("array<string>")).when(in_region(location), F.array(lowered, F.lit("israel"))).otherwise(F.array(lowered))
    return F.array_sort(F.array_union(own, named))


def locations_match(job_tokens: Column, preferred_tokens: Column) -> Column:
    """Does any preference (an array of token arrays) accept the job's tokens?

    A preference that names a city needs that city; otherwise the country or any shared token is enough.
    """
    cities = F.array(*[F.lit(c) for c in L.LOCATION_ALIASES if c != "israel"])

    def accepts(tokens: Column) -> Column:
        wanted = F.array_intersect(tokens, cities)
        return F.when(F.size(wanted) > 0, F.arrays_overlap(wanted, job_tokens)).otherwise(
            F.arrays_overlap(tokens, job_tokens))

    return F.exists(preferred_tokens, accepts)


def workplace_detect(text: Column, location: Column, first: str = "remote") -> Column:
    """remote / hybrid by mention, ``first`` wins when both occur; else onsite when a location is known."""
    second = "hybrid" if first == "remote" else "remote"
    lowered = F.lower(F.concat_ws(" ", F.coalesce(location, F.lit("")), F.coalesce(text, F.lit(""))))
    return (
        F.when(lowered.contains(first), first).when(lowered.contains(second), second)
        .when(F.length(location) > 0, "onsite").otherwise("unknown")
    )
