"""Golden cases of the two scoring engines."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacantia.functions.dates import timestamp
from vacantia.operators import ranking as G, registry as R, scoring_v1 as V1, scoring_v2 as V2
from vacantia.operators.job_features import job_features
from vacantia.operators.pairs import profile_job_pairs

NOW = dt.datetime(2026, 8, 18)
POSTING = ("job_id bigint, user_id bigint, career_track string, title string, description string, location string, workplace string, company string, "
           "published_at timestamp, updated_at timestamp, discovered_at timestamp")
PROFILE = ("user_id bigint, career_track string, years_experience double, years_options array<string>, skills array<string>, resume_skills array<string>, "
           "desired_titles array<string>, preferred_locations array<string>, preferred_work_modes array<string>, keywords array<string>, "
           "excluded_keywords array<string>, work_authorization boolean, needs_sponsorship boolean")


def job(title="Graduate Software Developer", description="Python and C++ tools on Linux. 0-2 years experience.", location="Haifa, Israel", workplace="hybrid",
        company="", age=None, track="computer_science", **_):
    published = None if age is None else NOW - dt.timedelta(days=age)
    return dict(track=track, row=(title, description, location, workplace, company, published, NOW, NOW))


def profile(years=0.0, options=(), skills=(), titles=(), places=("Israel",), modes=("hybrid", "remote", "onsite"), keywords=(), excluded=(), resume=()):
    return (float(years), list(options), list(skills), list(resume), list(titles), list(places), list(modes), list(keywords), list(excluded), True, False)


@pytest.fixture(scope="module")
def scored(spark):
    """Score (profile, job) cases with both engines; one user per case."""

    def run(cases, config=None):
        jobs = [(i, i, j["track"], *j["row"]) for i, (_, j) in enumerate(cases)]
        people = [(i, j["track"], *p) for i, (p, j) in enumerate(cases)]
        pairs = profile_job_pairs(job_features(spark.createDataFrame(jobs, POSTING)), spark.createDataFrame(people, PROFILE))
        now = F.lit(NOW)
        first = {r["job_id"]: r for r in V1.score_v1(pairs, now).select("job_id", "score", "reasons", "breakdown", "experience_min").collect()}
        second = {r["job_id"]: r for r in V2.score_v2(pairs, now, V2.fixed_config(config)).select(
            "job_id", "score", "tier", "confidence", "eligibility_state", "exclusion", "experience_status", "location_status", "recency_status", "work_mode_status",
            "buckets", "warnings", "missing_required").collect()}
        return [(first[i], second[i]) for i in range(len(cases))]

    return run


def points(row, code):
    return next((r["points"] for r in row["reasons"] if r["code"] == code), None)


def test_first_engine(scored):
    base = profile(skills=("python", "c++", "linux"), titles=("software",), places=("Haifa",), keywords=())
    rows = scored([
        (base, job()), (base, job(title="Senior Staff Software Architect", description="8+ years Java")),
        (base, job(company="Google")), (base, job(description="Apply now")),
        (profile(keywords=("senior",)), job(title="Senior Software Engineer")), (profile(excluded=("senior",)), job(title="Senior Software Engineer")),
        (profile(excluded=("it",)), job(title="Network Security Integrations")), (profile(excluded=("it",)), job(title="IT Support Engineer")),
        (profile(titles=("backend", "software")), job(title="Backend Engineer")), (profile(titles=("software", "backend")), job(title="Backend Engineer")),
        (base, job(age=45)), (base, job(workplace="remote")),
    ])
    score = [a["score"] for a, _ in rows]
    assert score[0] >= 80 and score[1] < score[0]
    assert score[2] == min(100, score[0] + 8)
    assert score[3] <= 55
    assert points(rows[4][0], "level_desired") == 18
    assert score[5] == 0 and points(rows[5][0], "level_excluded") == -100
    assert points(rows[6][0], "excluded_field") is None and score[7] == 0
    assert points(rows[8][0], "desired_title") == 22 and points(rows[9][0], "desired_title") == 19
    assert rows[0][0]["breakdown"]["freshness"] == 90 and rows[10][0]["breakdown"]["freshness"] < 50
    assert points(rows[0][0], "work_mode") == 6 and points(rows[11][0], "work_mode") == 5


def test_missing_requirement_caps_both_engines(scored):
    text = "דרישות: ניסיון מוכח של 3 שנים לפחות בפיתוח תוכנה משובצת מחשב עבור מערכות מורכבות ורב תחומיות תוך הבנה מעמיקה בנושאים הטכניים."
    (first, second), = scored([(profile(skills=("python", "git")), job(title="מפתח תוכנה משובצת", description=text))])
    assert first["experience_min"] == 3 and first["score"] <= 69 and second["score"] <= 69
    assert second["missing_required"] == ["embedded"]


def test_eligibility(scored):
    plain = lambda **kw: job(title="Backend Software Engineer", description=kw.pop("description", "Python"), **{"age": 1, "location": "Tel Aviv, Israel", **kw})
    three = dict(years=3, options=("3",))
    cases = [
        (profile(**three, excluded=("senior",)), job(title="Senior Backend Software Engineer", description="Python", age=1), "excluded"),
        (profile(years=4, options=("4",)), plain(description="Python. 4 years experience"), "realistic"),
        (profile(years=4, options=("4",)), plain(description="Python. 3+ years experience"), "realistic"),
        (profile(years=2, options=("0", "1", "2")), plain(description="Python. 3 years experience"), "excluded"),
        (profile(**three), plain(age=60), "excluded"), (profile(**three, places=("Tel Aviv",)), plain(location="תל-אביב"), "realistic"),
        (profile(**three, places=("Tel Aviv",)), plain(location="Haifa"), "realistic"), (profile(**three), plain(location=""), "realistic"),
        (profile(**three), plain(age=None), "realistic"), (profile(years=3), plain(description="4 years experience"), "realistic"),
        (profile(years=0, options=("0",)), plain(description="Experience working with Python services is required"), "excluded"),
    ]
    rows = [b for _, b in scored([(p, j) for p, j, _ in cases])]
    assert [r["eligibility_state"] for r in rows] == [s for *_, s in cases]
    assert rows[5]["location_status"] == "match" and rows[6]["location_status"] == "preference_mismatch" and rows[7]["location_status"] == "unknown"
    assert rows[10]["buckets"] == ["1", "2", "3", "4", "5+"]
    (_, strict), = scored([(profile(**three, places=("Tel Aviv",)), plain(location="Haifa"))], {"strict_location": True})
    assert strict["eligibility_state"] == "excluded" and strict["tier"] == "excluded"


def test_config_rules(spark):
    broken = [({"role_weight": 50}, ["weights"]), ({"exclude_experience_gap": 1}, ["experience_gaps"]), ({"maximum_job_age_days": 400}, ["age"]),
              ({"good_match_threshold": 85}, ["thresholds"]), ({"required_skill_share": 0.9}, ["shares"]), ({}, [])]
    for config, wanted in broken:
        assert spark.range(1).select(V2.config_violations(V2.fixed_config(config)).alias("v")).first()["v"] == wanted


def test_unknown_engine(spark):
    with pytest.raises(ValueError):
        R.rank(spark.range(1), "v9", timestamp("2024-01-01"))


def test_fingerprint_keeps_positions(spark):
    rows = spark.createDataFrame([("t", None, "d", "l", "w", None), ("t", "d", None, "l", "w", None)], "career_track string, title string, description string, location string, workplace string, published_at timestamp")
    assert len({r["f"] for r in rows.select(G.job_fingerprint().alias("f")).collect()}) == 2
