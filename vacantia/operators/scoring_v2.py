"""Second engine: eligibility first, then role, skills, requirements and preferences against a configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions import features as X, locations as P
from vacantia.functions.dates import age_days
from vacantia.operators.pairs import exclusion_reason

# The default configuration.
DEFAULT_CONFIG = {
    "role_weight": 40, "skills_weight": 35, "requirements_weight": 15, "preferences_weight": 10,
    "maximum_job_age_days": 45, "realistic_experience_gap": 1, "stretch_experience_gap": 3, "exclude_experience_gap": 4,
    "top_match_threshold": 90, "strong_match_threshold": 80, "good_match_threshold": 65, "low_match_threshold": 45,
    "strict_location": False, "strict_work_mode": False, "strict_employment_type": False,
    "required_skill_share": 0.70, "preferred_skill_share": 0.30, "employment_types": [],
}
WEIGHTS = ("role_weight", "skills_weight", "requirements_weight", "preferences_weight")
THRESHOLDS = ("top_match_threshold", "strong_match_threshold", "good_match_threshold", "low_match_threshold")
ENGINE_VERSION = 2

Config = Callable[[str], Column]


def fixed_config(config: dict | None = None) -> Config:
    values = {**DEFAULT_CONFIG, **(config or {})}
    return lambda name: (F.array(*[F.lit(v) for v in values[name]]).cast("array<string>")
                         if isinstance(values[name], (list, tuple)) else F.lit(values[name]))


def column_config(prefix: str = "cfg_", extra: dict | None = None) -> Config:
    """Settings read from columns ``cfg_<name>`` where the row has them, else the defaults."""
    default = fixed_config(extra)
    return lambda name: default(name) if name in ("employment_types",) else F.col(prefix + name)


def config_violations(cfg: Config) -> Column:
    """Codes of the rules a configuration breaks (empty array: valid)."""
    weights, gaps, limits = [cfg(n) for n in WEIGHTS], [cfg(n) for n in ("realistic_experience_gap", "stretch_experience_gap", "exclude_experience_gap")], [cfg(n) for n in THRESHOLDS]
    bad_weight = (weights[0] + weights[1] + weights[2] + weights[3]) != 100
    for w in weights:
        bad_weight = bad_weight | ~w.between(0, 100)
    ordered = (gaps[0] >= 0) & (gaps[0] <= gaps[1]) & (gaps[1] < gaps[2])
    falling = (limits[0] <= 100) & (limits[0] > limits[1]) & (limits[1] > limits[2]) & (limits[2] > limits[3]) & (limits[3] >= 0)
    shares = F.abs(cfg("required_skill_share") + cfg("preferred_skill_share") - 1.0) > 0.001
    return F.array_compact(F.array(
        F.when(bad_weight, "weights"), F.when(~ordered, "experience_gaps"),
        F.when(~cfg("maximum_job_age_days").between(1, 365), "age"), F.when(~falling, "thresholds"), F.when(shares, "shares")))


def eligibility(pairs: DataFrame, now: Column, cfg: Config) -> DataFrame:
    """Add the eligibility columns; an exclusion always wins over a stretch."""
    col = F.col
    need, high, years = col("experience.experience_min"), col("experience.experience_max"), col("years_experience")
    rows = pairs.withColumns({
        "track_status": F.when(col("track.relevant"), "match").otherwise("mismatch"),
        "exclusion": exclusion_reason(col("levels"), col("low_title"), col("excluded_levels"), col("excluded_terms")),
        "required_min": need, "required_max": high, "gap": F.when(need.isNotNull(), F.greatest(F.lit(0.0), need - years)),
        "buckets": X.experience_buckets(need, high),
        "place": F.trim(F.coalesce("location", F.lit(""))),
        "age": age_days(now, col("published_at")),
        "mode": F.lower(F.coalesce("workplace", F.lit(""))),
        "step": X.seniority_rank(col("seniority")) - X.seniority_rank(col("user_level")),
    })
    chosen = F.size("options") > 0
    rows = rows.withColumns({
        "experience_status": F.when(need.isNull(), "unknown")
        .when(chosen, F.when(F.arrays_overlap("options", "buckets"), "match").otherwise("mismatch"))
        .when(col("gap") <= cfg("realistic_experience_gap"), "match").when(col("gap") < cfg("exclude_experience_gap"), "stretch").otherwise("mismatch"),
        "seniority_status": F.when(col("seniority").isNull(), "unknown").when(col("step") >= 3, "mismatch").when(col("step") > 0, "stretch").otherwise("match"),
        "location_status": F.when(col("place") == "", "unknown").when(F.size("places") == 0, "not_configured")
        .when(P.locations_match(col("location_tokens"), col("place_tokens")), "match").otherwise("preference_mismatch"),
        "recency_status": F.when(col("age").isNull(), "unknown").when(col("age") <= cfg("maximum_job_age_days"), "fresh").otherwise("old"),
        "work_mode_status": F.when(col("mode").isin("", "unknown"), "unknown")
        .when((F.size("modes") == 0) | F.array_contains("modes", col("mode")), "match").otherwise("preference_mismatch"),
        "employment_status": F.when(col("employment").isNull(), "unknown")
        .when((F.size(cfg("employment_types")) > 0) & ~F.array_contains(cfg("employment_types"), col("employment")), "mismatch").otherwise("match"),
    })
    missed = lambda status: col(status) == "preference_mismatch"
    rows = rows.withColumns({
        "reasons": F.array_compact(F.array(
            F.concat(F.lit("track_"), "track_status"), F.when(col("exclusion").isNotNull(), "explicit_exclusion"),
            F.when(col("experience_status").isin("match", "mismatch"), F.concat(F.lit("experience_"), "experience_status")),
            F.when(col("seniority_status") == "mismatch", "seniority_mismatch"),
            F.when(missed("location_status") & cfg("strict_location"), "strict_location"),
            F.when(col("recency_status") == "old", "too_old"), F.when(missed("work_mode_status") & cfg("strict_work_mode"), "strict_work_mode"))),
        "warnings": F.array_compact(F.array(
            F.when(col("experience_status") == "stretch", "experience_gap"), F.when(col("seniority_status") == "stretch", "senior_role"),
            F.when(missed("location_status") & ~cfg("strict_location"), "other_location"),
            F.when(missed("work_mode_status") & ~cfg("strict_work_mode"), "other_work_mode"),
            F.when((col("employment_status") == "mismatch") & ~cfg("strict_employment_type"), "other_employment_type"))),
        "unknown_fields": F.array_compact(F.array(
            F.when(col("experience_status") == "unknown", "experience"), F.when(col("seniority_status") == "unknown", "seniority"),
            F.when(col("location_status") == "unknown", "location"), F.when(col("recency_status") == "unknown", "publication_date"),
            F.when(col("work_mode_status") == "unknown", "work_mode"), F.when(col("employment_status") == "unknown", "employment_type"))),
        "eligibility_state": F.when(
            (col("track_status") == "mismatch") | col("exclusion").isNotNull() | (col("experience_status") == "mismatch")
            | (col("seniority_status") == "mismatch") | (col("recency_status") == "old")
            | (missed("location_status") & cfg("strict_location")) | (missed("work_mode_status") & cfg("strict_work_mode"))
            | ((col("employment_status") == "mismatch") & cfg("strict_employment_type")), "excluded")
        .when((col("experience_status") == "stretch") | (col("seniority_status") == "stretch"), "stretch").otherwise("realistic"),
    })
    unknown = F.size("unknown_fields")
    return rows.withColumn("eligibility_confidence", F.when(unknown <= 1, "high").when(unknown <= 3, "medium").otherwise("low"))


def whole(value: Column) -> Column:
    return F.bround(value.cast("double"), 0).cast("int")


def role_match(pairs: DataFrame, cfg: Config) -> DataFrame:
    exact = F.exists("titles", lambda v: (v != "") & F.col("low_title").contains(v))
    known = F.size("families") > 0
    ratio = (F.when(exact, 1.0).when(F.arrays_overlap("families", "desired_families"), 0.88)
             .when(known & (F.size("titles") == 0), 0.72).when(known, 0.42).otherwise(0.12))
    return pairs.withColumns({"role_ratio": ratio, "role_score": whole(cfg("role_weight") * ratio)})


def skills_matrix(pairs: DataFrame) -> DataFrame:
    """Matched and missing required skills, matched optional skills; all sorted."""
    optional = F.array_union("preferred", "supporting")
    return pairs.withColumns({
        "matched_required": F.array_sort(F.array_intersect("required", "effective_skills")),
        "missing_required": F.array_sort(F.array_except("required", "effective_skills")),
        "optional": F.array_sort(optional),
        "matched_optional": F.array_sort(F.array_intersect(optional, F.col("effective_skills"))),
    })


def skills_score(matrix: DataFrame, cfg: Config) -> DataFrame:
    size = lambda name: F.size(name).cast("double")
    required_points = whole(cfg("skills_weight") * cfg("required_skill_share"))
    required_ratio = (F.when(size("required") > 0, F.try_divide(size("matched_required"), size("required")))
                      .when(size("optional") == 0, 0.65).otherwise(1.0))
    optional_ratio = F.when(size("optional") > 0, F.try_divide(size("matched_optional"), size("optional"))).otherwise(0.7)
    points = whole(required_points * required_ratio + (cfg("skills_weight") - required_points) * optional_ratio)
    return matrix.withColumn("skills_score", F.greatest(F.lit(0), F.least(cfg("skills_weight"), points)))


def tier_of(score: Column, state: Column, cfg: Config) -> Column:
    return (F.when(state.isin("excluded", "stretch"), state).when(score >= cfg("top_match_threshold"), "top_match")
            .when(score >= cfg("strong_match_threshold"), "strong_match").when(score >= cfg("good_match_threshold"), "good_match")
            .otherwise("low_match"))


def confidence() -> Column:
    """Confidence in a recommendation from how much of the posting is known."""
    length = F.col("description_length")
    signal = lambda c: F.when(c, 1).otherwise(0)
    signals = (1 + F.when(length >= 120, 2).when(length > 0, 1).otherwise(0) + signal(F.length("location") > 0)
               + signal(F.col("published_at").isNotNull()) + signal(F.col("experience.experience_min").isNotNull())
               + signal((F.size("required") > 0) | (F.size("supporting") > 0)))
    return F.when(signals >= 6, "high").when(signals >= 4, "medium").otherwise("low")


def score_v2(pairs: DataFrame, now: Column, cfg: Config | None = None) -> DataFrame:
    """Add eligibility, the four part scores, ``score``, ``tier`` and ``confidence``."""
    cfg, col = cfg or fixed_config(), F.col
    rows = skills_score(skills_matrix(role_match(eligibility(pairs, now, cfg), cfg)), cfg)
    ratio = F.when(col("degree"), 0.88).otherwise(0.70)
    ratio = F.when(F.size("mandatory") > 0, F.least(ratio, F.lit(0.65))).otherwise(ratio)
    total = cfg("preferences_weight")
    word_hit = F.exists("keywords", lambda v: (v != "") & col("low_text").contains(v))
    wished = (F.when(col("location_status") == "match", whole(total * 0.5)).otherwise(0)
              + F.when(col("work_mode_status") == "match", whole(total * 0.3)).otherwise(0))
    rows = rows.withColumns({
        "requirements_score": whole(cfg("requirements_weight") * ratio),
        "preferences_score": F.least(total, F.when(word_hit, total).otherwise(wished)),
        "confidence": confidence(),
    })
    missing = F.size("missing_required")
    parts = col("role_score") + col("skills_score") + col("requirements_score") + col("preferences_score")
    score = F.when(missing > 0, F.least(parts - F.least(F.lit(28), 12 + 6 * missing), F.lit(69))).otherwise(parts)
    score = F.when(col("quality") != "complete", F.least(score, F.lit(55))).otherwise(score)
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
    return rows.withColumn("tier", tier_of(col("score"), col("eligibility_state"), cfg))
