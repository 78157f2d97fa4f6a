"""Small inputs with large results are cut into tasks by number; texts are spread over the cores and guarded by literal tests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vacantia.functions import contacts as C, features as X, text as T
from vacantia.functions.dates import timestamp
from vacantia.operators import registry as R, source_state as Z
from vacantia.operators.profiles import ordered_union
from vacantia.plans import QUERIES
from vacantia.plans.fixtures import NOW
from vacantia.plans.scoring_queries import pairs


@pytest.mark.parametrize("key", ["catalogue_install", "catalogue_status"])
def test_product_of_users_and_entries_is_spread(spark, small, key):
    tasks = [r["count"] for r in QUERIES[key](spark, small).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(tasks) >= 8 and max(tasks) <= sum(tasks) / 4


@pytest.mark.parametrize("key", ["catalogue_install", "catalogue_status"])
def test_product_of_users_and_entries_has_even_tasks(spark, small, key):
    tasks = [r["count"] for r in QUERIES[key](spark, small).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(tasks) >= 16 and max(tasks) <= 2.5 * sum(tasks) / len(tasks)


def test_blocks_of_users_and_entries_keep_every_row_and_board(spark, monkeypatch):
    monkeypatch.setattr(Z, "USERS_OF_BLOCK", 4)
    monkeypatch.setattr(Z, "ENTRIES_OF_BLOCK", 3)
    # User 1 owns every board, 2 the first and last, others none or boards outside the list; a board listed twice, unknown users and tracks.
    users = spark.createDataFrame([(u, t) for u in (*range(1, 14), None) for t in ("cs", "ee")] + [(50, "none"), (51, None)], "user_id long, career_track string")
    entries = spark.createDataFrame(
        [(i, t, "lever", None if i == 5 else f"b{i // 2 if i < 4 else i}") for i in range(11) for t in ("cs", "ee")] + [(90, "alone", "lever", "b1"), (91, None, "lever", "b1")],
        "entry long, career_track string, kind string, identifier string")
    boards = [(1, t, i) for t in ("cs", "ee") for i in range(12)] + [(2, "cs", 0), (2, "cs", 10), (3, "ee", 77), (99, "cs", 1), (None, "cs", 1), (12, "ee", 6), (13, "alone", 1)]
    known = spark.createDataFrame([(u, t, "lever", f"b{i}", n, n % 3 == 0) for n, (u, t, i) in enumerate(boards)] + [(4, "cs", "lever", None, 200, True), (5, "cs", "lever", "b6", None, None)],
                                  "user_id long, career_track string, kind string, identifier string, source_id long, enabled boolean")
    columns = ["entry", "user_id", "career_track", "kind", "identifier", "source_id", "enabled"]
    rows = Z._each_user_and_entry(entries, users, known).select(*columns[:5], "found.source_id", "found.enabled")
    plain = entries.join(users, "career_track").join(known, ["user_id", "career_track", "kind", "identifier"], "left").select(*columns)
    found, wanted = (sorted(map(tuple, f.collect()), key=repr) for f in (rows, plain))
    assert found == wanted and len(found) == 14 * 22 and sum(r[5] is not None for r in found) > 20


def test_heads_of_texts_are_spread_and_places_guarded(spark, small):
    rows = QUERIES["contact_names"](spark, small)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    # One border test over a table of places behind a literal test, not one per place and line.
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("rlike") < 12


def test_places_are_whole_words_in_table_order(values):
    texts = ["x\nHaifax Haifa and tel aviv", "HAIFA, Israel", "Address: Lod\nHaifa", "a\r\nb\rראש חיפה ישראל", "\n" * 45 + "Haifa", None, "Netanyahu"]
    assert values(C.place, texts) == ["Tel Aviv, Israel", "Haifa", "Lod", "חיפה", "", "", ""]
    assert values(C.full_name, ["x@y | Dana Levi | Noa Bar", "\n" * 18 + "Dana Levi"]) == ["Dana Levi", ""]


def test_ordered_union_evaluates_its_lists_once(spark):
    assert str(ordered_union(F.col("a"), F.col("costly"))).count("costly") == 1
    rows = spark.createDataFrame([(["Go", " git ", ""], ["GIT", "go", "sql"]), ([], []), (None, ["x"])], "a array<string>, costly array<string>")
    assert [r["v"] for r in rows.select(ordered_union(F.col("a"), F.col("costly")).alias("v")).collect()] == [["Go", "git", "sql"], [], None]


def test_two_engines_share_one_pass_over_the_features(spark, small):
    rows = QUERIES["register_engine"](spark, small)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1


def test_engines_joined_and_chained_agree(spark, small):
    rows, at = pairs(spark, small), timestamp(NOW)
    chained = R.shadow(rows, at, "v2", "v1")
    R.register_engine("plain", lambda p, now, config: R.ENGINES["v1"](p, now, config))
    try:
        joined = R.shadow(rows, at, "v2", "plain")
    finally:
        R.ENGINES.pop("plain")
    assert sorted(chained.columns) == sorted(joined.columns)
    found = [sorted(tuple(r) for r in f.select(*sorted(chained.columns)).collect()) for f in (chained, joined)]
    assert found[0] == found[1] and len(found[0]) > 0


def test_durations_are_searched_once(values):
    assert str(X.experience_extract(F.col("t"))).count("regexp_extract_all") <= 2
    texts = ["2-4 years, 1 to 3 yrs", "12 or more years; 3 years", "5 yearly", "no units 3-5", "1.5–2 שנים", "new grad 4 years", "3 - 5 yrs.and 7+ years", None]
    assert [None if r is None else tuple(r) for r in values(X.experience_extract, texts)] == [
        (1.0, 4.0), (3.0, None), (5.0, None), (None, None), (1.5, 2.0), (0.0, 1.0), (3.0, 5.0), (None, None)]


def test_generic_lines_and_edges(values):
    assert values(T.text_quality, [" ..Apply Now — ", "|: read more :|", "apply now apply now apply now apply now apply", None]) == ["missing", "missing", "complete", "missing"]
    assert values(T.clean_text, ["| a  \t b |\n\n A C.\nx y |​|"]) == ["a b\nA C.\nx y"]


def test_name_and_place_cut_the_lines_once(values):
    assert str(C.name_and_place(F.col("t"))).count("split(t") == 1
    texts = ["Dana Levi | x@y\nAddress: Lod", "\n" * 20 + "Noa Bar\nHaifa, Israel", "", None]
    assert [tuple(r) for r in values(C.name_and_place, texts)] == list(zip(values(C.full_name, texts), values(C.place, texts)))
