"""Helpers that write DuckDB expressions for the check queries."""

from __future__ import annotations

from vacantia import lexicons as L
from vacantia.functions.locations import NARROW, WIDE, canonical_name
from vacantia.functions.text import ENTITIES, bordered, quoted

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(conditions) -> str:
    return "(" + (" OR ".join(conditions) or "false") + ")"


def has_any(col: str, terms) -> str:
    return any_of(f"contains({col}, {text(t)})" for t in terms)


def count(col: str, terms) -> str:
    return "(" + " + ".join(f"contains({col}, {text(t)})::int" for t in terms) + ")"


def has_term(col: str, term: str) -> str:
    term = term.lower()
    found = f"contains({col}, {text(term)})"
    if bordered(term):
        found += f" AND regexp_matches({col}, {text(f'(^|{NOT_WORD}){quoted(term)}({NOT_WORD}|$)')})"
    return f"({found})"


def plain(col: str, term: str) -> str:
    return f"contains({col}, {text(term)})"


def keys(col: str, table, test=has_term) -> str:
    items = ", ".join(f"CASE WHEN {any_of(test(col, t) for t in terms)} THEN {text(k)} END" for k, terms in sorted(table.items()))
    return f"list_filter([{items}], lambda v: v IS NOT NULL)"


def first(col: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {has_any(col, terms)} THEN {text(k)}" for k, terms in table.items()) + " END"


def squeeze(col: str) -> str:
    return rf"trim(regexp_replace(coalesce({col}, ''), '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'))"


def unescape(col: str) -> str:
    for entity, plain_text in ENTITIES:
        col = f"replace({col}, {text(entity)}, {text(plain_text)})"
    return col


def drop_elements(col: str, names) -> str:
    pattern = "|".join(rf"<{n}\b[^>]*>.*?</{n}\s*>" for n in names)
    return f"regexp_replace({col}, {text(pattern)}, ' ', 'gis')"


MARKUP = r"(?s)<!--.*?-->|<[a-zA-Z/!?][^>]*>"


def html_to_text(col: str) -> str:
    body = drop_elements(f"coalesce({col}, '')", ("script", "style", "template"))
    return squeeze(unescape(f"regexp_replace({body}, {text(MARKUP)}, ' ', 'g')"))


def line_key(col: str) -> str:
    return f"trim(lower({col}), ' .:–—-')"


def names(terms) -> str:
    return "(" + ", ".join(text(t) for t in terms) + ")"


def clean_pairs(col: str) -> str:
    raw = f"replace({unescape(f'coalesce({col}, {text('')})')}, '\\/', '/')"
    raw = f"replace(replace(replace({raw}, '\\n', chr(10)), '\\r', chr(10)), '\\t', ' ')"
    body = drop_elements(raw, ("script", "style", "noscript", "svg", "form", "nav", "footer"))
    body = unescape(f"regexp_replace({body}, {text(MARKUP)}, chr(10), 'g')")
    body = rf"regexp_replace({body}, '[\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}\x{{feff}}]', '', 'g')"
    lines = rf"string_split_regex({body}, '[\r\n\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]')"
    pairs = f"list_transform({lines}, lambda x: {{'line': trim({squeeze('x')}, ' |'), 'key': {line_key(f'trim({squeeze('x')}, {text(' |')})')}}})"
    return f"list_filter({pairs}, lambda p: p.line <> '' AND p.key NOT IN {names(L.GENERIC_DESCRIPTIONS)})"


def clean_text(pairs: str) -> str:
    """Text from a column made by :func:`clean_pairs`."""
    ks = f"list_transform({pairs}, lambda p: p.key)"
    kept = f"list_filter({pairs}, lambda p, i: list_position({ks}, p.key) = i)"
    return f"array_to_string(list_transform({kept}, lambda p: p.line), chr(10))"


def quality(clean: str) -> str:
    c = squeeze(clean)
    return rf"""CASE WHEN {c} = '' OR {line_key(c)} IN {names(L.GENERIC_DESCRIPTIONS)} THEN 'missing'
      WHEN length({c}) < 40 OR regexp_full_match({c}, '(?i)[0-9a-f -]{{24,}}') THEN 'partial'
      WHEN length(regexp_replace({c}, '[^\p{{L}}]', '', 'g'))::double / length({c}) < 0.35 THEN 'partial' ELSE 'complete' END"""


def joined(lst: str) -> str:
    return f"array_to_string({lst}, '|')"


def norm_location(col: str) -> str:
    return squeeze(f"translate(coalesce({col}, ''), {text(WIDE)}, {text(NARROW)})")


REGION = "(?i)(?:" + "|".join(L.REGION_PATTERNS) + ")"


def in_region(col: str) -> str:
    return f"regexp_matches({norm_location(col)}, {text(REGION)})"


def canonical_city(col: str) -> str:
    c = squeeze(col)
    rules = [f"WHEN contains({c}, {text(k)}) THEN {text(v)}" for k, v in L.HEBREW_CITIES.items()]
    rules += [f"WHEN regexp_matches({c}, {text(f'(?i)(^|[^A-Za-z]){quoted(k)}([^A-Za-z]|$)')}) THEN {text(canonical_name(k) + ', Israel')}"
              for k in L.ENGLISH_CITIES]
    return (f"CASE {' '.join(rules)} WHEN regexp_matches({c}, '(^|[^A-Za-z])IL([^A-Za-z]|$)') THEN 'Israel' "
            f"WHEN regexp_matches({c}, '(?i)(^|[^A-Za-z])Israel([^A-Za-z]|$)') OR contains({c}, 'ישראל') THEN 'Israel' ELSE '' END")


def location_tokens(col: str) -> str:
    low = f"trim(lower(coalesce({col}, '')))"
    items = [f"CASE WHEN {low} <> '' THEN {low} END"]
    items += [f"CASE WHEN {has_any(low, a)} THEN {text(p)} END" for p, a in L.LOCATION_ALIASES.items()]
    items.append(f"CASE WHEN {low} <> '' AND {in_region(col)} THEN 'israel' END")
    return f"list_sort(list_distinct([{', '.join(items)}]))"


AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def authority(col: str) -> str:
    return f"lower(regexp_extract(trim(coalesce({col}, '')), '{AUTHORITY}', 1))"


def path(col: str) -> str:
    return (f"regexp_extract(regexp_replace(regexp_replace(trim(coalesce({col}, '')), '{AUTHORITY}', ''), "
            f"'^[a-zA-Z][a-zA-Z0-9+.-]*:', ''), '^([^?#]*)', 1)")


def query_pairs(col: str) -> str:
    q = rf"regexp_extract(trim(coalesce({col}, '')), '^[^?#]*\?([^#]*)', 1)"
    return (f"list_filter(list_transform(list_filter(string_split({q}, '&'), lambda p: contains(p, '=')), "
            f"lambda p: {{'n': lower(url_decode(split_part(p, '=', 1))), 'v': url_decode(regexp_replace(p, '^[^=]*=', ''))}}), "
            f"lambda p: p.v <> '')")


def url_key(col: str) -> str:
    ids = (f"list_sort(list_transform(list_filter({query_pairs(col)}, lambda p: p.n IN {names(L.URL_IDENTITY_PARAMS)}), "
           f"lambda p: p.n || '=' || lower(p.v)))")
    base = f"{authority(col)} || lower(rtrim({path(col)}, '/'))"
    return f"CASE WHEN len({ids}) > 0 THEN {base} || '?' || array_to_string({ids}, '&') ELSE {base} END"


def ats_family(url: str, kind: str) -> str:
    k = f"lower(trim(coalesce({kind}, '')))"
    site, everything = authority(url), f"({authority(url)} || ' ' || lower({path(url)}) || ' ' || {k})"
    return (f"CASE WHEN contains({everything}, 'greenhouse') THEN 'greenhouse' WHEN contains({everything}, 'comeet') THEN 'comeet' "
            f"WHEN contains({site}, 'lever.co') OR {k} = 'lever' THEN 'lever' WHEN contains({site}, 'ashbyhq.com') OR {k} = 'ashby' THEN 'ashby' "
            f"WHEN contains({site}, 'myworkdayjobs.com') OR contains({everything}, 'workday') THEN 'workday' "
            f"WHEN contains({site}, 'smartrecruiters.com') OR contains({k}, 'smartrecruiters') THEN 'smartrecruiters' ELSE 'custom' END")


AUTO_FAMILIES = names(k for k, automatic in L.ATS_FAMILIES.items() if automatic)


def question_norm(col: str) -> str:
    return squeeze(f"regexp_replace(lower(coalesce({col}, '')), '[^a-z0-9 ]', ' ', 'g')")


def memory_norm(col: str) -> str:
    return squeeze(f"regexp_replace(lower(coalesce({col}, '')), '[^a-z0-9א-ת+/# ]', ' ', 'g')")


def numbers(col: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({col}, {text(pattern)}, {group})::double[]"


def implicit_experience(low: str) -> str:
    """Windows around each implicit phrase; exact when a pattern occurs once per window."""
    hits = [f"len(list_filter(regexp_extract_all({low}, {text(f'(?s).{{0,90}}(?:{p}).{{0,120}}')}), lambda w: NOT {has_any('w', L.EXPERIENCE_OPTIONAL_CUES)})) > 0"
            for p in L.EXPERIENCE_IMPLICIT]
    return f"((contains({low}, 'experience') OR contains({low}, 'סיון')) AND {any_of(hits)})"


def experience_min(low: str, implicit: bool = True) -> str:
    return (f"CASE WHEN {has_any(low, L.NO_EXPERIENCE)} THEN 0.0::double WHEN len({numbers(low, L.EXPERIENCE_RANGE, 1)}) > 0 "
            f"THEN list_min({numbers(low, L.EXPERIENCE_RANGE, 1)}) WHEN len({numbers(low, L.EXPERIENCE_SINGLE, 1)}) > 0 "
            f"THEN list_min({numbers(low, L.EXPERIENCE_SINGLE, 1)}) WHEN {implicit_experience(low)} THEN 1.0::double END")


def experience_max(low: str) -> str:
    return (f"CASE WHEN {has_any(low, L.NO_EXPERIENCE)} THEN 1.0::double WHEN len({numbers(low, L.EXPERIENCE_RANGE, 1)}) > 0 "
            f"THEN list_max({numbers(low, L.EXPERIENCE_RANGE, 2)}) END")


def buckets(lo: str, hi: str) -> str:
    start = f"greatest(0, ceil({lo})::int)"
    end = f"CASE WHEN {hi} IS NULL THEN 5 ELSE greatest({start}, floor({hi})::int) END"
    items = ", ".join(
        f"CASE WHEN {lo} IS NOT NULL AND " + (f"{v} >= {start} AND {v} <= {end}" if v < 5 else f"{end} >= 5")
        + f" THEN '{label}' END" for v, label in enumerate(L.EXPERIENCE_BUCKETS))
    return f"list_filter([{items}], lambda v: v IS NOT NULL)"


def seniority(title: str) -> str:
    low = f"lower(coalesce({title}, ''))"
    rules = []
    for level, terms in sorted(L.SENIORITY_LEVELS.items(), key=lambda x: -L.SENIORITY_RANK[x[0]]):
        hit = has_any(low, terms)
        if level == "manager":
            hit = f"({hit} AND NOT {has_any(low, L.PROFESSION_MANAGERS)})"
        rules.append(f"WHEN {hit} THEN {text(level)}")
    return f"CASE {' '.join(rules)} END"


def seniority_rank(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN {text(k)} THEN {v}" for k, v in L.SENIORITY_RANK.items()) + " END"


def years_level(years: str) -> str:
    return f"CASE WHEN {years} < 1 THEN 'entry level' WHEN {years} < 3 THEN 'junior' WHEN {years} < 5 THEN 'mid level' ELSE 'senior' END"


def families(title: str, track: str) -> str:
    low = f"lower(coalesce({title}, ''))"
    return f"CASE {track} " + " ".join(f"WHEN {text(t)} THEN {keys(low, table, plain)}" for t, table in L.ROLE_FAMILIES.items()) + " END"


def track_verdict(title: str, body: str, track: str) -> str:
    """Text 'true:reason' or 'false:reason'; title and body are lower-case columns."""
    tx = f"({title} || ' ' || {body})"
    soft, generic = has_any(title, L.CS_SOFTWARE_TITLES), has_any(title, L.CS_GENERIC_TITLES)
    cs = f"""CASE WHEN NOT {soft} AND {has_any(title, L.CS_HARDWARE_TITLES)} THEN 'false:hardware_discipline_title'
      WHEN NOT {soft} AND {has_any(title, L.CS_OTHER_DISCIPLINE_TITLES)} THEN 'false:non_software_discipline_title'
      WHEN {has_any(title, L.CS_STRONG_TITLES)} THEN 'true:cs_title'
      WHEN {generic} AND NOT {soft} AND {count(tx, L.CS_HARDWARE_CONTEXT)} >= 2 THEN 'false:hardware_discipline_context'
      WHEN {generic} AND {has_any(tx, L.CS_DEGREE_SIGNALS)} THEN 'true:cs_degree_signal'
      WHEN {generic} AND {count(tx, L.CS_CONTEXT)} >= 2 THEN 'true:cs_context' ELSE 'false:outside_cs_scope' END"""
    ee = f"""CASE WHEN {has_any(title, L.EE_STRONG_TITLES)} THEN 'true:ee_title'
      WHEN {has_any(tx, L.EE_DEGREE_SIGNALS)} AND {count(tx, L.EE_CONTEXT)} >= 1 THEN 'true:ee_degree_signal'
      WHEN {count(tx, L.EE_CONTEXT)} >= 3 AND {has_any(title, L.EE_ENGINEER_TITLES)} THEN 'true:ee_context' ELSE 'false:outside_ee_scope' END"""
    ig = has_any(title, L.IEM_GENERIC_TITLES)
    iem = f"""CASE WHEN {has_any(title, L.IEM_SOFTWARE_TITLES)} THEN 'false:software_role_outside_iem_scope'
      WHEN {has_any(title, L.IEM_LABOUR_TITLES)} THEN 'false:iem_non_professional_operations_role'
      WHEN {has_any(title, L.IEM_STRONG_TITLES)} THEN 'true:iem_title'
      WHEN {has_any(tx, L.IEM_DEGREE_SIGNALS)} AND ({ig} OR {count(tx, L.IEM_CONTEXT)} >= 2) THEN 'true:iem_degree_signal'
      WHEN {ig} AND {count(tx, L.IEM_CONTEXT)} >= 3 THEN 'true:iem_context' ELSE 'false:outside_iem_scope' END"""
    return f"CASE {track} WHEN '{L.CS}' THEN {cs} WHEN '{L.EE}' THEN {ee} ELSE {iem} END"
