"""The stored ranking table: one row per user, posting and engine, ranked again only where something changed."""

from datetime import datetime

from pyspark.sql import functions as F

from vacantia.operators import ranking as G, scoring_v2 as V2

NOW = lambda: F.lit("2026-05-01 00:00:00").cast("timestamp")
LISTS = ("years_options", "skills", "desired_titles", "preferred_locations", "preferred_work_modes", "keywords", "excluded_keywords")


def tables(spark):
    postings = spark.createDataFrame([(u, j, "t", title, f"text {j}") for u, j, title in [(1, 1, "one"), (2, 1, "one"), (1, 2, "two"), (2, 3, None)]],
                                     "user_id int, job_id int, career_track string, title string, description string")
    postings = postings.withColumns({"location": F.lit("Haifa"), "workplace": F.lit(""), "published_at": F.lit(None).cast("timestamp")})
    profiles = spark.createDataFrame([(1, "t"), (2, "t")], "user_id int, career_track string").withColumns({name: F.array(F.lit("x")) for name in LISTS})
    profiles = profiles.withColumns({"years_experience": F.lit(2.0), "work_authorization": F.lit(True), "needs_sponsorship": F.lit(False)})
    rankings = spark.createDataFrame([], "user_id int, job_id int, engine string, score int, tier string, error string, engine_version int, config_version int, "
                                         "job_fingerprint string, profile_fingerprint string, evaluated_at timestamp, stale boolean")
    return postings, profiles, rankings


def rank(jobs):
    return jobs.select("user_id", "job_id", (F.col("user_id") * 10).alias("score"), F.lit("good_match").alias("tier"))


def test_result_can_be_stored_and_used_again(spark):
    postings, profiles, rankings = tables(spark)
    old = spark.createDataFrame([(1, 1, "v1", 5, "low_match", "", 1, 1, "", "", datetime(2026, 1, 1), False)], rankings.schema)
    step = lambda stored, jobs, version=3: G.rerank_incremental(stored, jobs, G.stale_rankings(stored, jobs, profiles, version), rank, NOW(), version)
    first = step(rankings.union(old), postings)
    rows = {(r["user_id"], r["job_id"], r["engine"]): r for r in first.collect()}
    assert len(rows) == first.count() == 5
    assert rows[1, 1, "v2"]["score"] == 10 and rows[2, 1, "v2"]["score"] == 20, "two users' rankings of one posting stay apart"
    assert not rows[1, 1, "v1"]["reranked"] and rows[1, 1, "v1"]["score"] == 5, "rows of the other engine stay"
    assert rows[2, 3, "v2"]["error"] == "posting has no title" and rows[1, 2, "v2"]["engine_version"] == V2.ENGINE_VERSION
    assert rows[1, 1, "v2"]["evaluated_at"] == datetime(2026, 5, 1) and len(rows[1, 1, "v2"]["job_fingerprint"]) == 64
    stored = spark.createDataFrame([r[:-1] for r in first.select(*rankings.columns, "reranked").collect()], rankings.schema)
    again = step(stored, postings)
    assert {(r["user_id"], r["job_id"]) for r in again.filter("reranked").collect()} == {(2, 3)}, "only the failed row is tried again"
    changed = postings.withColumn("title", F.when(F.expr("user_id = 1 AND job_id = 1"), "new").otherwise(F.col("title")))
    assert {(r["user_id"], r["job_id"]) for r in step(stored, changed).filter("reranked").collect()} == {(1, 1), (2, 3)}
    assert step(stored, postings, 4).filter("reranked").count() == 4
    assert step(stored, postings.limit(0)).filter("reranked").count() == 0
