"""Posting features that depend on the posting alone: experience, seniority, skills, families, tracks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from vacantia import lexicons as L
from vacantia.functions.text import (
    any_of, contains_any, count_terms, first_key, let, matching_keys, matching_words, sql_text,
)


def _null_double() -> Column:
    return F.lit(None).cast("double")


def _found(text: Column, pattern: str) -> Column:
    """All matches of a duration pattern; the literal guard keeps it off texts without a unit of years."""
    guard = any_of(text.contains(unit) for unit in ("year", "yr", "שנות", "שנים"))
    return F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _numbers(found: Column, pattern: str, group: int) -> Column:
    return F.transform(found, lambda m: F.regexp_extract(m, pattern, group).cast("double"))


def implicit_experience(lowered: Column) -> Column:
    """Experience demanded without a duration, unless an optional cue stands within -90/+120 characters."""
    # The empty look-ahead for the phrase comes first, so the long look-behind runs only where the phrase starts.
    before = "".join(rf"(?<!{c}.{{0,{90 - len(c)}}})" for c in L.EXPERIENCE_OPTIONAL_CUES)
    after = "".join(rf"(?!.{{0,{120 - len(c)}}}{c})" for c in L.EXPERIENCE_OPTIONAL_CUES)
    # The literal guard keeps the look-around expression off texts that cannot match.
    guard = lowered.contains("experience") | lowered.contains("סיון")
    phrase = "|".join(L.EXPERIENCE_IMPLICIT)
    return guard & lowered.rlike(f"(?sU)(?={phrase}){before}(?:{phrase}){after}")


def experience_extract(text: Column) -> Column:
    """struct(experience_min, experience_max): phrases for none, ranges, single numbers, implicit, unknown."""
    return let(F.lower(F.coalesce(text, F.lit(""))), _experience)


def _experience(lowered: Column) -> Column:
    low, high = (lambda found: _numbers(found, L.EXPERIENCE_RANGE, 1)), (lambda found: _numbers(found, L.EXPERIENCE_RANGE, 2))
    pair = lambda a, b: F.struct(a.cast("double").alias("experience_min"), b.cast("double").alias("experience_max"))
    without_range = lambda singles: (
        F.when(F.size(singles) > 0, pair(F.array_min(_numbers(singles, L.EXPERIENCE_SINGLE, 1)), _null_double()))
        .when(implicit_experience(lowered), pair(F.lit(1.0), _null_double()))
        .otherwise(pair(_null_double(), _null_double())))
    return (
        F.when(contains_any(lowered, L.NO_EXPERIENCE), pair(F.lit(0.0), F.lit(1.0)))
        .otherwise(let(_found(lowered, L.EXPERIENCE_RANGE), lambda ranges: F.when(
            F.size(ranges) > 0, pair(F.array_min(low(ranges)), F.array_max(high(ranges))))
            .otherwise(let(_found(lowered, L.EXPERIENCE_SINGLE), without_range)))))


def experience_buckets(low: Column, high: Column) -> Column:
    """Selectable experience values a requirement covers; open-ended requirements cover upward."""
    start = F.greatest(F.lit(0), F.ceil(low).cast("int"))
    end = F.when(high.isNull(), F.lit(5)).otherwise(F.greatest(start, F.floor(high).cast("int")))
    values = F.array(*[F.lit(v) for v in L.EXPERIENCE_BUCKETS])
    covered = F.filter(values, lambda v, i: F.when(i < 5, (i >= start) & (i <= end)).otherwise(end >= 5))
    return F.when(low.isNull(), F.array().cast("array<string>")).otherwise(covered)


def detected_levels(title: Column) -> Column:
    return matching_keys(F.lower(title), L.SENIORITY_LEVELS)


def seniority_rank(level: Column) -> Column:
    ranks = F.expr("map(" + ", ".join(f"{sql_text(k)}, {v}" for k, v in L.SENIORITY_RANK.items()) + ")")
    return F.when(level.isNotNull(), F.try_element_at(ranks, level))


def seniority_detect(title: Column) -> Column:
    """Highest level named by the title; a profession such as "project manager" is not a level."""
    highest_first = dict(sorted(L.SENIORITY_LEVELS.items(), key=lambda item: -L.SENIORITY_RANK[item[0]]))
    people = {k: v for k, v in highest_first.items() if k != "manager"}

    def level(t: Column) -> Column:
        return F.when(contains_any(t, L.PROFESSION_MANAGERS), first_key(t, people)).otherwise(first_key(t, highest_first))

    return let(F.lower(F.coalesce(title, F.lit(""))), level)


def seniority_of_years(years: Column) -> Column:
    return (F.when(years < 1, "entry level").when(years < 3, "junior").when(years < 5, "mid level")
            .otherwise("senior"))


def employment_type(text: Column) -> Column:
    return first_key(F.lower(text), L.EMPLOYMENT_TYPES)


def skills_extract(text: Column, table=None) -> Column:
    """Sorted skills with a variant in the text."""
    return matching_words(F.lower(text), table or L.SKILLS)


def marked_sentences(title: Column, description: Column) -> tuple[Column, Column]:
    """(required, preferred) sentences of a posting, each joined by newlines; a preferred marker wins."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))
    sentences = F.split(F.lower(text), "[\\n.!?;]+")
    preferred = lambda s: contains_any(s, L.PREFERRED_MARKERS)
    required = lambda s: contains_any(s, L.REQUIRED_MARKERS) & ~preferred(s)
    return F.array_join(F.filter(sentences, required), "\n"), F.array_join(F.filter(sentences, preferred), "\n")


def role_families(title: Column, track: Column) -> Column:
    """Sorted families of the track whose terms occur in the title."""
    tables = F.expr("map(" + ", ".join(
        f"{sql_text(t)}, array(" + ", ".join(
            f"named_struct('key', {sql_text(k)}, 'terms', array({', '.join(sql_text(x) for x in terms)}))" for k, terms in sorted(table.items())) + ")"
        for t, table in L.ROLE_FAMILIES.items()) + ")")
    lowered = F.lower(F.coalesce(title, F.lit("")))
    found = let(lowered, lambda t: F.filter(F.try_element_at(tables, track), lambda row: F.exists(row["terms"], lambda term: F.contains(t, term))))
    return F.coalesce(found.getField("key"), F.array().cast("array<string>"))


def _verdict(*rules: tuple[Column, bool, str], default: str) -> Column:
    """First rule that fires decides struct(relevant, reason)."""
    outcome = lambda ok, why: F.struct(F.lit(ok).alias("relevant"), F.lit(why).alias("reason"))
    chain = reduce(lambda c, r: c.when(r[0], outcome(r[1], r[2])), rules[1:],
                   F.when(rules[0][0], outcome(rules[0][1], rules[0][2])))
    return chain.otherwise(outcome(False, default))


def track_cs(title: Column, description: Column) -> Column:
    return _judge(title, description, _cs_rules)


def _cs_rules(title: Column, text: Column) -> Column:
    software = contains_any(title, L.CS_SOFTWARE_TITLES)
    generic = contains_any(title, L.CS_GENERIC_TITLES)
    return _verdict(
        (~software & contains_any(title, L.CS_HARDWARE_TITLES), False, "hardware_discipline_title"),
        (~software & contains_any(title, L.CS_OTHER_DISCIPLINE_TITLES), False, "non_software_discipline_title"),
        (contains_any(title, L.CS_STRONG_TITLES), True, "cs_title"),
        (generic & ~software & (count_terms(text, L.CS_HARDWARE_CONTEXT) >= 2), False, "hardware_discipline_context"),
        (generic & contains_any(text, L.CS_DEGREE_SIGNALS), True, "cs_degree_signal"),
        (generic & (count_terms(text, L.CS_CONTEXT) >= 2), True, "cs_context"),
        default="outside_cs_scope",
    )


def track_ee(title: Column, description: Column) -> Column:
    return _judge(title, description, _ee_rules)


def _ee_rules(title: Column, text: Column) -> Column:
    context = count_terms(text, L.EE_CONTEXT)
    return _verdict(
        (contains_any(title, L.EE_STRONG_TITLES), True, "ee_title"),
        (contains_any(text, L.EE_DEGREE_SIGNALS) & (context >= 1), True, "ee_degree_signal"),
        (contains_any(title, L.EE_ENGINEER_TITLES) & (context >= 3), True, "ee_context"),
        default="outside_ee_scope",
    )


def track_iem(title: Column, description: Column) -> Column:
    return _judge(title, description, _iem_rules)


def _iem_rules(title: Column, text: Column) -> Column:
    generic, context = contains_any(title, L.IEM_GENERIC_TITLES), count_terms(text, L.IEM_CONTEXT)
    return _verdict(
        (contains_any(title, L.IEM_SOFTWARE_TITLES), False, "software_role_outside_iem_scope"),
        (contains_any(title, L.IEM_LABOUR_TITLES), False, "iem_non_professional_operations_role"),
        (contains_any(title, L.IEM_STRONG_TITLES), True, "iem_title"),
        (contains_any(text, L.IEM_DEGREE_SIGNALS) & (generic | (context >= 2)), True, "iem_degree_signal"),
        (generic & (context >= 3), True, "iem_context"),
        default="outside_iem_scope",
    )


def _judge(title: Column, description: Column, rules) -> Column:
    """Apply rules(lower title, lower title and description) with both texts lowered once."""
    title = F.lower(F.coalesce(title, F.lit("")))
    text = F.concat(title, F.lit(" "), F.lower(F.coalesce(description, F.lit(""))))
    return let(F.struct(title.alias("title"), text.alias("text")), lambda t: rules(t["title"], t["text"]))


def track_relevance(title: Column, description: Column, track: Column) -> Column:
    """struct(relevant, reason) of a posting for the given career track."""
    return (F.when(track == L.CS, track_cs(title, description)).when(track == L.EE, track_ee(title, description))
            .otherwise(track_iem(title, description)))
