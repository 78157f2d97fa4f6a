"""DuckDB texts of the two scoring engines (CTE chains)."""

from __future__ import annotations

from vacantia import lexicons as L
from vacantia.plans import duck as K
from vacantia.plans.text_queries import SKILL_CLASSES_SQL, skill_class_ctes

LEVELS = "[" + ", ".join(K.text(v) for v in L.SENIORITY_LEVELS) + "]"


def lower_list(name: str) -> str:
    return f"list_transform({name}, lambda v: lower(v))"


def term_in_title(title: str, term: str) -> str:
    edge = r"[\p{L}\p{N}]"
    return (rf"(contains({title}, {term}) AND (NOT regexp_matches({term}, '^{edge}(.*{edge})?$') OR "
            rf"regexp_matches({title}, '(^|{K.NOT_WORD})' || regexp_escape({term}) || '({K.NOT_WORD}|$)')))")


def has(lst: str) -> str:
    return f"len({lst}) > 0"


FULL = "lower(title || ' ' || description || ' ' || location)"


def feature_ctes(postings: str = "@@postings") -> str:
    companies = "CASE " + " ".join(f"WHEN {K.has_any('lower(company)', v)} THEN {K.text(k)}" for k, v in L.KNOWN_COMPANIES.items()) + " END"
    mandatory = "[" + ", ".join(f"CASE WHEN {K.plain('low_text', t)} THEN {K.text(t)} END" for t in L.MANDATORY_TERMS) + "]"
    return f"""po AS MATERIALIZED (SELECT * EXCLUDE (score) FROM {postings}),
{skill_class_ctes(SKILL_CLASSES_SQL.replace('@@postings', 'po'))},
f0 AS (SELECT po.*, lower(title) AS low_title, lower(description) AS low_body, lower(title || ' ' || description) AS low_text, {FULL} AS full_text,
   {K.clean_pairs('description')} AS clean_pairs FROM po),
f1 AS (SELECT * EXCLUDE (clean_pairs), {K.clean_text('clean_pairs')} AS clean FROM f0),
f2 AS (SELECT f1.* EXCLUDE (clean), {K.quality('clean')} AS quality, {K.track_verdict('low_title', 'low_body', 'career_track')} AS verdict,
   {K.experience_min('low_text')} AS need, {K.experience_max('low_text')} AS high, {K.seniority('title')} AS seniority,
   {K.keys('low_title', L.SENIORITY_LEVELS, K.plain)} AS levels, {K.families('title', 'career_track')} AS families,
   {K.location_tokens('location')} AS tokens, {K.first('low_text', L.EMPLOYMENT_TYPES)} AS employment, {K.keys('full_text', L.SKILLS)} AS text_skills,
   {K.has_any('low_title', L.SENIOR_TERMS)} AS senior_title, {K.has_any('low_title', L.ENTRY_TERMS)} AS entry_title,
   {K.has_any('low_title', L.DEV_TERMS)} AS dev_title, {companies} AS known_company, {K.has_any('low_text', L.DEGREE_TERMS)} AS degree,
   list_filter({mandatory}, lambda v: v IS NOT NULL) AS mandatory,
   CASE WHEN published_at IS NULL THEN NULL ELSE greatest(0, floor((epoch(NOW) - floor(epoch(published_at))) / 86400))::int END AS age,
   greatest(0, floor((epoch(NOW) - floor(epoch(updated_at))) / 86400))::int AS seen FROM f1),
feat AS MATERIALIZED (SELECT f2.*, c.all_skills, c.required, c.preferred, c.supporting FROM f2 JOIN classes c USING (job_id))"""


def profile_ctes(profiles: str = "@@profiles") -> str:
    return f"""q0 AS (SELECT user_id, career_track, years_experience AS years, {lower_list('skills')} AS own_skills,
   list_distinct(list_concat({lower_list('skills')}, {lower_list('resume_skills')})) AS effective, {lower_list('desired_titles')} AS titles,
   {lower_list('preferred_locations')} AS places, {lower_list('preferred_work_modes')} AS modes, {lower_list('keywords')} AS words,
   {lower_list('excluded_keywords')} AS excluded, list_filter(years_options, lambda v: v IN {K.names(L.EXPERIENCE_BUCKETS)}) AS options FROM {profiles}),
prof AS MATERIALIZED (SELECT *, list_filter({LEVELS}, lambda v: list_contains(words, v)) AS desired_levels, list_filter({LEVELS}, lambda v: list_contains(excluded, v)) AS excluded_levels,
   list_filter(list_transform(excluded, lambda v: trim(v)), lambda v: v <> '' AND NOT list_contains({LEVELS}, v)) AS excluded_terms,
   flatten(list_transform(titles, lambda v: {K.families('v', 'career_track')})) AS desired_families, {K.years_level('years')} AS user_level FROM q0)"""


PAIR_CTE = "pr AS (SELECT f.*, p.* EXCLUDE (user_id, career_track) FROM feat f JOIN prof p USING (user_id, career_track))"


def pair_ctes() -> str:
    return f"{feature_ctes()},\n{profile_ctes()},\n{PAIR_CTE}"


def weight(rank: str, floor: str = "0.45") -> str:
    return f"greatest({floor}::double, 1.0::double - ({rank}) * 0.12::double)"


def ranks(values: str, hit: str) -> str:
    """0-based positions of the values ``v`` that satisfy ``hit``."""
    return f"list_filter(list_transform({values}, lambda v, i: CASE WHEN v <> '' AND ({hit}) THEN i - 1 END), lambda r: r IS NOT NULL)"


def points(ranks_col: str, maximum: int) -> str:
    best = f"round_even({maximum}::double * {weight(f'{ranks_col}[1]')}, 0)::int"
    return (f"CASE WHEN len({ranks_col}) = 0 THEN 0 WHEN len({ranks_col}) > 1 THEN least({maximum}, {best} + least(4, len({ranks_col}) - 1)) ELSE {best} END::int")


def v1_ctes() -> str:
    plain_level = f"NOT list_contains({LEVELS}, v)"
    skill = (f"list_sum(list_transform(overlap, lambda s: CASE WHEN list_contains(own_skills, s) THEN "
             f"round_even(4.0::double * {weight('list_position(own_skills, s) - 1', '0.5')}, 0)::int ELSE 3 END))")
    rules = [
        # category, points, bar points (null = points)
        ("title", f"CASE WHEN blocked THEN -100 WHEN {has('level_hits')} THEN {points('level_ranks', 18)} WHEN too_senior THEN -40 END", None),
        ("", f"CASE WHEN NOT blocked AND len(level_hits) = 0 AND NOT too_senior AND entry_title THEN 10 END", None),
        ("title", f"CASE career_track WHEN '{L.CS}' THEN CASE WHEN dev_title THEN 5 END WHEN '{L.IEM}' THEN CASE WHEN starts_with(verdict, 'true') THEN 7 ELSE -25 END "
                  "ELSE CASE WHEN starts_with(verdict, 'true') THEN 8 ELSE -30 END END", None),
        ("title", "CASE WHEN known_company IS NOT NULL THEN 8 END", None),
        ("title", f"CASE WHEN {has('title_ranks')} THEN {points('title_ranks', 22)} WHEN {has('titles')} THEN -15 END", None),
        ("skills", f"CASE WHEN {has('overlap')} THEN least(18, {skill})::int WHEN {has('effective')} THEN -8 END", None),
        ("", "CASE WHEN missing > 0 THEN -least(28, 12 + 6 * missing) END", None),
        ("experience", "CASE WHEN need IS NULL THEN 0 WHEN need <= greatest(1.0, years + 1) THEN 10 WHEN need <= years + 2 THEN 3 ELSE -least(30, trunc((need - years) * 8)::int) END", None),
        ("location", f"CASE WHEN len(places) = 0 THEN NULL WHEN {has('place_ranks')} THEN {points('place_ranks', 6)} WHEN workplace = 'remote' THEN 4 ELSE -5 END", None),
        ("title", f"CASE WHEN {has('word_ranks')} THEN {points('word_ranks', 5)} END", None),
        ("location", f"CASE WHEN {has('mode_ranks')} THEN {points('mode_ranks', 6)} END", None),
        ("", "CASE WHEN bad_words > 0 THEN -35 END", None),
        ("freshness", "CASE WHEN age <= 3 THEN 5 WHEN age <= 7 THEN 3 WHEN age <= 14 THEN 1 WHEN age <= 30 THEN 0 WHEN age IS NOT NULL THEN -6 WHEN seen <= 2 THEN 2 WHEN seen <= 7 THEN 0 END",
         "CASE WHEN age <= 3 THEN 25 WHEN age <= 7 THEN 20 WHEN age <= 14 THEN 15 WHEN age <= 30 THEN 8 WHEN age IS NOT NULL THEN -8 WHEN seen <= 2 THEN 20 WHEN seen <= 7 THEN 15 END"),
        ("", "CASE WHEN quality <> 'complete' THEN 0 END", None),
    ]
    listed = ", ".join(f"{{'c': '{c}', 'p': ({p})::int, 'b': ({b or p})::int}}" for c, p, b in rules)
    bars = ", ".join(
        f"list_reduce(list_prepend(50, list_transform(list_filter(fired, lambda r: r.c = '{c}'), lambda r: r.b)), "
        f"lambda a, b: greatest(0, least(100, a + 2 * b))) AS bar_{c}" for c in ("title", "skills", "experience", "location", "freshness"))
    return f"""{pair_ctes()},
s0 AS (SELECT *, list_filter(levels, lambda v: list_contains(desired_levels, v)) AS level_hits, len(list_intersect(levels, excluded_levels)) > 0 AS blocked,
   list_filter(effective, lambda v: list_contains(text_skills, v)) AS overlap, len(list_filter(required, lambda v: NOT list_contains(effective, v)))::int AS missing,
   lower(location) AS low_location, senior_title AND len(list_intersect(desired_levels, ['senior', 'lead', 'staff', 'manager'])) = 0 AS too_senior,
   len(list_filter(excluded, lambda v: v <> '' AND {plain_level} AND {term_in_title('low_title', 'v')})) AS bad_words FROM pr),
s1 AS (SELECT *, {ranks('words', 'list_contains(level_hits, v)')} AS level_ranks, {ranks('titles', 'contains(low_title, v)')} AS title_ranks,
   {ranks('places', 'contains(low_location, v) OR contains(v, low_location)')} AS place_ranks, {ranks('words', f'{plain_level} AND contains(full_text, v)')} AS word_ranks,
   {ranks('modes', 'v = lower(workplace)')} AS mode_ranks FROM s0),
s2 AS (SELECT *, list_filter([{listed}], lambda r: r.p IS NOT NULL) AS fired FROM s1),
v1 AS (SELECT *, CASE WHEN blocked OR bad_words > 0 THEN 0 ELSE least(CASE WHEN missing > 0 THEN 69 ELSE 100 END, CASE WHEN quality <> 'complete' THEN 55 ELSE 100 END,
   greatest(0, 15 + list_sum(list_transform(fired, lambda r: r.p)))) END::int AS score, {bars} FROM s2)"""


def eligibility_ctes(age: str = "45", gap: str = "1", far: str = "4") -> str:
    cities = "[" + ", ".join(K.text(c) for c in L.LOCATION_ALIASES if c != "israel") + "]"
    place_ok = (f"len(list_filter(places, lambda v: CASE WHEN len(list_intersect({K.location_tokens('v')}, {cities})) > 0 "
                f"THEN len(list_intersect(list_intersect({K.location_tokens('v')}, {cities}), tokens)) > 0 ELSE len(list_intersect({K.location_tokens('v')}, tokens)) > 0 END)) > 0")
    return f"""{pair_ctes()},
e0 AS (SELECT *, coalesce('excluded seniority: ' || list_filter({LEVELS}, lambda v: list_contains(levels, v) AND list_contains(excluded_levels, v))[1],
   'excluded keyword: ' || list_filter(excluded_terms, lambda v: {term_in_title('low_title', 'v')})[1]) AS exclusion, {K.buckets('need', 'high')} AS buckets,
   greatest(0.0, need - years) AS gap_raw, {K.seniority_rank('seniority')} - {K.seniority_rank('user_level')} AS step, lower(workplace) AS mode FROM pr),
e1 AS (SELECT *, CASE WHEN need IS NOT NULL THEN gap_raw END AS gap, CASE WHEN starts_with(verdict, 'true') THEN 'match' ELSE 'mismatch' END AS track_status,
   CASE WHEN need IS NULL THEN 'unknown' WHEN len(options) > 0 THEN CASE WHEN len(list_intersect(options, buckets)) > 0 THEN 'match' ELSE 'mismatch' END
     WHEN gap_raw <= {gap} THEN 'match' WHEN gap_raw < {far} THEN 'stretch' ELSE 'mismatch' END AS experience_status,
   CASE WHEN seniority IS NULL THEN 'unknown' WHEN step >= 3 THEN 'mismatch' WHEN step > 0 THEN 'stretch' ELSE 'match' END AS seniority_status,
   CASE WHEN trim(location) = '' THEN 'unknown' WHEN len(places) = 0 THEN 'not_configured' WHEN {place_ok} THEN 'match' ELSE 'preference_mismatch' END AS location_status,
   CASE WHEN age IS NULL THEN 'unknown' WHEN age <= {age} THEN 'fresh' ELSE 'old' END AS recency_status,
   CASE WHEN mode IN ('', 'unknown') THEN 'unknown' WHEN len(modes) = 0 OR list_contains(modes, mode) THEN 'match' ELSE 'preference_mismatch' END AS work_mode_status,
   CASE WHEN employment IS NULL THEN 'unknown' ELSE 'match' END AS employment_status FROM e0),
el AS (SELECT *, CASE WHEN track_status = 'mismatch' OR exclusion IS NOT NULL OR experience_status = 'mismatch' OR seniority_status = 'mismatch' OR recency_status = 'old' THEN 'excluded'
   WHEN experience_status = 'stretch' OR seniority_status = 'stretch' THEN 'stretch' ELSE 'realistic' END AS state,
   (experience_status = 'unknown')::int + (seniority_status = 'unknown')::int + (location_status = 'unknown')::int + (recency_status = 'unknown')::int
   + (work_mode_status = 'unknown')::int + (employment_status = 'unknown')::int AS unknowns FROM e1)"""


def even(expr: str) -> str:
    return f"round_even(({expr})::double, 0)::int"


def v2_parts(source: str, cfg: dict[str, str], keep: str = "*") -> str:
    """CTEs m0..v2 over ``source`` (el or a join of it); cfg maps setting name to SQL."""
    req_points = even(f"{cfg['skills_weight']} * {cfg['required_skill_share']}")
    return f"""m0 AS (SELECT *, list_sort(list_filter(required, lambda v: list_contains(effective, v))) AS matched_required,
   list_sort(list_filter(required, lambda v: NOT list_contains(effective, v))) AS missing_required, list_sort(list_distinct(list_concat(preferred, supporting))) AS optional FROM {source}),
m1 AS (SELECT *, list_filter(optional, lambda v: list_contains(effective, v)) AS matched_optional,
   CASE WHEN len(list_filter(titles, lambda v: v <> '' AND contains(low_title, v))) > 0 THEN 1.0 WHEN len(list_intersect(families, desired_families)) > 0 THEN 0.88
     WHEN len(families) > 0 AND len(titles) = 0 THEN 0.72 WHEN len(families) > 0 THEN 0.42 ELSE 0.12 END::double AS role_ratio FROM m0),
m2 AS (SELECT *, {even(f"{cfg['role_weight']} * role_ratio")} AS role_score,
   greatest(0, least({cfg['skills_weight']}, {even(f"{req_points} * CASE WHEN len(required) > 0 THEN len(matched_required)::double / len(required) WHEN len(optional) = 0 THEN 0.65 ELSE 1.0 END::double + ({cfg['skills_weight']} - {req_points}) * CASE WHEN len(optional) > 0 THEN len(matched_optional)::double / len(optional) ELSE 0.7 END::double")})) AS skills_score,
   {even(f"{cfg['requirements_weight']} * CASE WHEN len(mandatory) > 0 THEN 0.65 WHEN degree THEN 0.88 ELSE 0.70 END::double")} AS requirements_score,
   CASE WHEN len(list_filter(words, lambda v: v <> '' AND contains(low_text, v))) > 0 THEN {cfg['preferences_weight']} ELSE
     CASE WHEN location_status = 'match' THEN {even(f"{cfg['preferences_weight']} * 0.5")} ELSE 0 END + CASE WHEN work_mode_status = 'match' THEN {even(f"{cfg['preferences_weight']} * 0.3")} ELSE 0 END END AS preferences_score FROM m1),
m3 AS (SELECT *, role_score + skills_score + requirements_score + preferences_score AS parts FROM m2),
m4 AS (SELECT *, CASE WHEN len(missing_required) > 0 THEN least(69, parts - least(28, 12 + 6 * len(missing_required))) ELSE parts END AS raw FROM m3),
m5 AS (SELECT *, greatest(0, least(100, CASE WHEN quality <> 'complete' THEN least(55, raw) ELSE raw END))::int AS score,
   1 + CASE WHEN length(trim(description)) >= 120 THEN 2 WHEN length(trim(description)) > 0 THEN 1 ELSE 0 END + (location <> '')::int + (published_at IS NOT NULL)::int
   + (need IS NOT NULL)::int + (len(required) > 0 OR len(supporting) > 0)::int AS signals FROM m4),
v2 AS (SELECT *, CASE WHEN state IN ('excluded', 'stretch') THEN state WHEN score >= {cfg['top']} THEN 'top_match' WHEN score >= {cfg['strong']} THEN 'strong_match'
   WHEN score >= {cfg['good']} THEN 'good_match' ELSE 'low_match' END AS tier,
   CASE WHEN signals >= 6 THEN 'high' WHEN signals >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM m5)"""


DEFAULT = {"role_weight": "40", "skills_weight": "35", "requirements_weight": "15", "preferences_weight": "10",
           "required_skill_share": "0.70::double", "top": "90", "strong": "80", "good": "65"}


def v2_ctes() -> str:
    return f"{eligibility_ctes()},\n{v2_parts('el', DEFAULT)}"
