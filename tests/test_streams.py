"""Streams against their batch twins, for files in any number and order."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vacantia.operators import catalogue as C, quality as Q, source_state as Z
from vacantia.plans import QUERIES
from vacantia.plans.fixtures import view
from vacantia.plans.stream_queries import landed_pages, normalized
from vacantia.streaming import jobs as J
from vacantia.streaming.tables import KeyedTable

START = dt.datetime(2024, 1, 1)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def in_files(spark, rows, schema, folder, files, seed):
    """Rows dealt at random to ``files`` files, read one file per batch."""
    draw = random.Random(seed)
    parts = [[] for _ in range(files)]
    for r in rows:
        parts[draw.randrange(files)].append(r)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_keyed_table_is_repeatable_and_keeps_two_versions(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k int, v int", ["k"], 4)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").cast("int").alias("v"))
    assert table.read().collect() == []
    batches = [spark.createDataFrame([(i % 5, n) for i in range(10)], "k int, v int") for n in (1, 10, 100, 1000)]
    for n, batch in enumerate(batches):
        table.rewrite(n, batch, add)
        once = rows_of(table.read())
        table.rewrite(n, batch, add)  # the batch is run again
        assert rows_of(table.read()) == once
    assert once == [(k, 2222) for k in range(5)]
    assert rows_of(table.read(3)) == [(k, 222) for k in range(5)]
    table.rewrite(7, spark.createDataFrame([], "k int, v int"), add)
    assert rows_of(table.read()) == once and len(list((tmp_path / "pointer").glob("number=*"))) == 2
    table.rewrite(8, spark.createDataFrame([(1, 0)], "k int, v int"), lambda old, new: old.where("k <> 1"))
    assert rows_of(table.read()) == [(k, 2222) for k in (0, 2, 3, 4)]


@pytest.mark.parametrize("files", [1, 6])
def test_dedup_has_no_horizon(spark, tmp_path, files):
    rows = [(a, START + dt.timedelta(days=d)) for a in range(8) for d in (0, 1, 40, 400)]
    stream = in_files(spark, rows, "application_id int, ts timestamp", tmp_path, files, 3)
    got = J.run_dedup(stream, ["application_id"], str(tmp_path))
    assert sorted(r["application_id"] for r in got.collect()) == list(range(8))


def runs_of(seed):
    draw = random.Random(seed)
    out = []
    for run in range(60):
        at = START + dt.timedelta(minutes=20 * run)
        user, track = run % 3, "t"
        for step, status in enumerate(draw.choice([["queued"], ["queued", "ok"], ["queued", "running", "failed"], ["queued", "running"]])):
            out.append((user, track, run, status, at + dt.timedelta(minutes=7 * step)))
    return out


@pytest.mark.parametrize("files", [1, 5])
def test_run_states_follow_the_last_event_of_the_newest_run(spark, tmp_path, files):
    rows = runs_of(files)
    rows += [(9, "t", 500, "queued", START), (9, "t", 500, "ok", START + dt.timedelta(minutes=5)), (8, "t", 501, "queued", START)]
    clock = max(r[4] for r in rows)
    want = []
    for user in {r[0] for r in rows}:
        run, at, status = max((r[2], r[4], r[3]) for r in rows if r[0] == user)
        want.append((user, "t", run, "failed" if status in J.ACTIVE and at + dt.timedelta(hours=2) < clock else status))
    stream = in_files(spark, rows, "user_id long, career_track string, run_id long, status string, requested_at timestamp", tmp_path, files, files)
    got = rows_of(J.run_timeout(stream, str(tmp_path)))
    assert got == sorted(want, key=repr) and (9, "t", 500, "ok") in got and (8, "t", 501, "failed") in got
    fired = spark.read.parquet(f"{tmp_path}/out/batch=*").where("user_id = 8").collect()
    assert len(fired) == 1  # once, in the batch that moved the clock past it


@pytest.mark.parametrize("files", [1, 12])
def test_heartbeat_and_progress_keep_all_keys_without_state(spark, tmp_path, files):
    draw = random.Random(1)
    rows = [(draw.randrange(5), i, START + dt.timedelta(hours=draw.randrange(500)), draw.random() < 0.4, f"s{i}") for i in range(200)]
    schema = "run_id long, event_id long, ts timestamp, finished boolean, source string"
    stream = in_files(spark, rows, schema, tmp_path, files, 2)
    seen = J.heartbeat(stream, str(tmp_path / "beat"), "run_id")
    assert rows_of(seen) == sorted(((k, max(r[2] for r in rows if r[0] == k)) for k in range(5)), key=repr)
    got = rows_of(J.progress(stream, str(tmp_path / "run")))
    assert got == [(k, len(mine), sum(r[3] for r in mine), max((r[2], r[1], r[4]) for r in mine)[2]) for k in range(5) for mine in [[r for r in rows if r[0] == k]]]
    assert not (tmp_path / "beat/progress/state").exists() and not (tmp_path / "run/progress/state").exists()


def test_health_with_late_outcomes_equals_batch(spark, tmp_path):
    draw = random.Random(7)
    rows = [(draw.choice([1, 1, 1, 2, 3]), i, START + dt.timedelta(hours=i), draw.choice(["ok", "failed", "failed", "deferred", "quality_failed"])) for i in range(80)]
    schema = "source_id long, event_id long, ts timestamp, outcome string"
    got = J.source_health_stream(in_files(spark, rows, schema, tmp_path, 3, 5), str(tmp_path))
    want = Z.source_health(spark.createDataFrame(rows, schema))
    assert rows_of(got) == rows_of(want)
    # A restart without new files gives the same.
    again = J.source_health_stream(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"{tmp_path}/in"), str(tmp_path))
    assert rows_of(again) == rows_of(want)


def test_health_of_a_batch_is_computed_once(spark, tmp_path, monkeypatch):
    """The state of a batch decides which buckets are rewritten and what is merged into them, from one computation."""
    rows = spark.sparkContext.accumulator(0)

    def seen(source):
        rows.add(1)
        return source

    counted = F.udf(seen, "bigint").asNondeterministic()
    real = J.source_health
    monkeypatch.setattr(J, "source_health", lambda *given: real(*given).withColumn("source_id", counted("source_id")))
    log = [(source, n, START + dt.timedelta(minutes=n), "failed") for n in range(4) for source in (1, 2, 3)]
    stream = in_files(spark, log, "source_id bigint, event_id bigint, ts timestamp, outcome string", tmp_path, 1, 3)
    got = J.source_health_stream(stream, str(tmp_path))
    assert rows_of(got.select("source_id", "consecutive_failures")) == [(s, 4) for s in (1, 2, 3)]
    assert rows.value == 3


def test_stream_source_health_equals_batch(spark, small):
    assert rows_of(QUERIES["stream_source_health"](spark, small)) == rows_of(QUERIES["source_health"](spark, small))


def test_ingest_of_split_boards_equals_batch(spark, small, tmp_path):
    """Boards of three kinds over three files; an older scan that comes late, and an incomplete newer one, change nothing."""
    owners = view(spark, small, "postings").select("source_id", "external_id", "user_id", "career_track")
    pages = landed_pages(spark, small)
    pages.repartition(3, "seq").write.parquet(f"{tmp_path}/in")
    board = pages.where("source_id = 4").limit(1)
    board.withColumns({"scan_id": F.lit(0).cast("long"), "pages": F.lit(1).cast("long")}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    board.withColumns({"scan_id": F.lit(2).cast("long"), "pages": F.lit(9).cast("long")}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    previous, profiles = view(spark, small, "snap_prev"), view(spark, small, "profiles")
    stream = spark.readStream.schema(J.PAGE).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    stored, actions = J.ingest_stream(stream, normalized, owners, previous, profiles, str(tmp_path))

    listed = normalized(pages).join(owners, ["source_id", "external_id"])
    good = Q.payload_gate(Q.batch_profile(listed, ["source_id"])).where("gate IS NULL").select("source_id")
    kept = listed.join(good, "source_id", "left_semi")
    whole = C.snapshot_reconcile(previous.join(good, "source_id", "left_semi"), kept, profiles)
    done = {(r["source_id"], r["external_id"]): r["action"] for r in actions.where("action <> 'quality_failed'").collect() if r["source_id"] != 4}
    want = {(r["source_id"], r["external_id"]): (r["action"], r["reason"]) for r in whole.collect()}
    assert done == {k: v[0] for k, v in want.items() if k[0] != 4}
    after = {(r["source_id"], r["external_id"]): (r["is_active"], r["reason"]) for r in stored.read().collect()}
    before = {(r["source_id"], r["external_id"]): r["is_active"] for r in previous.collect()}
    expected = {k: (v, None) for k, v in before.items()}
    for k, (action, reason) in want.items():
        if action in ("insert", "update", "reactivate"):
            expected[k] = (True, None)
        elif action == "remove":
            expected[k] = (False, reason)
    assert {k: v for k, v in after.items() if k[0] != 4} == {k: v for k, v in expected.items() if k[0] != 4}
    assert {a for a in want.values() if a[0] in ("insert", "update", "remove")}
