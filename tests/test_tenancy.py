"""Two users with the same boards, patterns and fingerprints never see or change each other's rows."""

from datetime import datetime

from pyspark.sql import functions as F

from vacantia.operators import lifecycle as Y
from vacantia.sources import exchange as E

BOARD = ("lever", "acme", "electrical_engineering")
SOURCES = "source_id long, user_id int, name string, company_name string, kind string, identifier string, career_track string, enabled boolean, consecutive_failures int"
EDITS = "edit_id long, action string, user_id int, source_id long, kind string, identifier string, career_track string, enabled boolean"


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_source_edits(spark):
    sources = spark.createDataFrame([(1, 1, "a", "A", *BOARD, False, 3), (2, 2, "b", "B", "lever", "other", BOARD[2], True, 0)], SOURCES)
    edits = spark.createDataFrame([
        (10, "add", 1, None, *BOARD, None), (11, "add", 2, None, *BOARD, None), (12, "add", 2, None, *BOARD, None), (13, "add", 2, None, "lever", None, BOARD[2], None),
        (20, "edit", 1, 1, None, None, None, True), (21, "delete", 2, 1, None, None, None, None), (22, "edit", 2, 2, None, None, None, None)], EDITS)
    found = rows(Y.source_edits(sources, edits), "edit_id", "user_id", "outcome", "enabled", "consecutive_failures")
    assert found == [(10, 1, "refused_duplicate", True, 0), (11, 2, "added", True, 0), (12, 2, "refused_duplicate", True, 0), (13, 2, "added", True, 0),
                     (20, 1, "edited", True, 0), (22, 2, "edited", True, 0)]
    assert rows(Y.source_edits(sources, edits.limit(0)), "edit_id") == []
    assert len(rows(Y.source_edits(sources.limit(0), edits), "edit_id")) == 4


def test_restore_sources(spark):
    old = spark.createDataFrame([(1, "a", "A", *BOARD, True), (2, "b", "B", *BOARD, True)], "user_id int, name string, company_name string, kind string, identifier string, career_track string, enabled boolean")
    bundle = spark.createDataFrame([(5, 9, "new", "A", *BOARD, False, 0), (6, 9, "other", "A", *BOARD, False, 0), (7, 9, "x", "", " ", "y", "", True, 0)], SOURCES)
    found = rows(E.restore_sources(old, bundle, F.lit(1)), "user_id", "name", "enabled", "action")
    assert found == [(1, "other", False, "update"), (2, "b", True, "keep")]
    assert rows(E.restore_sources(old, bundle, F.lit(3)), "user_id", "action") == [(1, "keep"), (2, "keep"), (3, "insert")]
    assert rows(E.restore_sources(old, bundle.limit(0), F.lit(1)), "action") == [("keep",), ("keep",)]


def test_restore_answers(spark):
    kind = "user_id int, pattern string, answer string, auto_use boolean"
    old = spark.createDataFrame([(1, "salary", "10", True), (2, "salary", "20", True), (1, "p" * 500, "cut", False)], kind)
    bundle = spark.createDataFrame([(1, "salary", "11", None), (2, "salary", "12", None), (3, "notice", None, True), (4, "", "no", True), (5, None, "no", True), (6, "p" * 600, "long", True)],
                                   "seq int, pattern string, answer string, auto_use boolean")
    found = rows(E.restore_answers(old, bundle, F.lit(1)), "user_id", "pattern", "answer", "auto_use", "action")
    assert found == [(1, "notice", "", True, "insert"), (1, "p" * 500, "long", True, "update"), (1, "salary", "12", False, "update"), (2, "salary", "20", True, "keep")]


def test_restore_applications(spark):
    day = datetime(2026, 1, 2)
    old = spark.createDataFrame([(1, 1, "submitted", "auto", day), (2, 2, "queued", "auto", day)], "user_id int, job_id int, status string, mode string, reminder_at timestamp")
    jobs = spark.createDataFrame([(1, 1), (2, 2), (1, 3)], "user_id int, job_id int")
    bundle = spark.createDataFrame([(1, 1, "rejected", "manual", None), (2, 2, "failed", "auto", None), (3, 3, "", None, day), (4, 4, "saved", "auto", None)],
                                   "seq int, job_id int, status string, mode string, reminder_at timestamp")
    found = rows(E.restore_applications(old, bundle, jobs, F.lit(1)), "user_id", "job_id", "status", "mode", "reminder_at", "action")
    assert found == [(1, 1, "rejected", "manual", day, "update"), (1, 3, "saved", "review", day, "insert"), (2, 2, "queued", "auto", day, "keep")]
