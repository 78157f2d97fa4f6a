"""Table operators: brute-force twins, invariants, skew, streams against their batch twins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vacantia.operators import catalogue as C, filters as R, ordering as O, registry as P, source_state as Z
from vacantia.plans import ORACLES, QUERIES
from vacantia.plans.fixtures import view
from vacantia.sources import sites as S
from vacantia.streaming import jobs as J


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_every_query_is_registered_once():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 170


def test_positions_of_a_hot_group(spark):
    """Two thirds of the rows belong to one group; positions must equal the sorted order."""
    rng = random.Random(1)
    data = [(0 if i % 3 else i % 7, rng.randrange(50), i) for i in range(3000)]
    got = O.positions(spark.createDataFrame(data, "g int, x int, id int"), [F.col("x").desc(), F.col("id")], ("g",)).collect()
    want = {}
    for g in {d[0] for d in data}:
        for k, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2])), 1):
            want[d[2]] = k
    assert {r["id"]: r["position"] for r in got} == want


def test_carry_last(spark):
    data = [(i % 2, i, i if i % 5 == 0 else None) for i in range(200)]
    got = {r["t"]: r["v"] for r in O.carry_last(spark.createDataFrame(data, "g int, t int, m int"), [F.col("t")], ("g",), "m", "v").collect()}
    last = {}
    for g, t, m in data:
        if m is not None:
            last[g] = m
        assert got[t] == last.get(g)


def health_by_steps(log):
    state = {}
    for source, _, _, outcome in sorted(log, key=lambda r: (r[1], r[2])):
        failures, health = state.get(source, (0, 100))
        if outcome == "ok":
            failures, health = 0, 100
        elif outcome == "deferred":
            failures, health = 0, max(80, health)
        elif outcome == "quality_failed":
            failures, health = failures + 1, min(health, 40)
        else:
            failures += 1
            health = max(5, 100 - 24 * failures)
        state[source] = (failures, health)
    return state


def test_source_health_against_steps(spark):
    rng = random.Random(7)
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    outcomes = ("ok", "failed", "quality_failed", "deferred")
    log = [(rng.randrange(60), start + dt.timedelta(minutes=rng.randrange(400)), i, rng.choice(outcomes)) for i in range(500)]
    schema = "source_id bigint, ts timestamp, event_id bigint, outcome string"
    got = {r["source_id"]: (r["consecutive_failures"], r["health_score"]) for r in Z.source_health(spark.createDataFrame(log, schema)).collect()}
    assert got == health_by_steps(log)
    # Folding the two halves one after the other gives the same state.
    middle = start + dt.timedelta(minutes=200)
    early, late = [r for r in log if r[1] < middle], [r for r in log if r[1] >= middle]
    first = Z.source_health(spark.createDataFrame(early, schema))
    second = {r["source_id"]: (r["consecutive_failures"], r["health_score"]) for r in Z.source_health(spark.createDataFrame(late, schema), first).collect()}
    assert all(got[k] == v for k, v in second.items())


def test_reconcile_is_stable(spark, small):
    """A snapshot equal to the valid catalogue inserts nothing and reports nothing as no longer listed."""
    stored, profiles = view(spark, small, "snap_prev"), view(spark, small, "profiles")
    actions = C.snapshot_reconcile(stored, stored, profiles)
    assert actions.filter("action = 'insert' OR reason = 'no_longer_listed'").count() == 0
    assert actions.count() == stored.count()


def test_tenant_guard(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "user_id int, x string")
    assert R.scoped(rows, 1).count() == 1
    with pytest.raises(PermissionError):
        R.assert_tenant(rows, 1)


def test_structured_feed(spark):
    pages = [(1, '{"jobs":[{"jobId":"77","title":"Data Engineer","city":"Haifa"}]}'), (2, '[{"id":"X1","tl":"FPGA Engineer","ct":"Lod"}]'),
             (3, '{"results":{"page":[{"jobNumber":5,"jobTitle":"Buyer","location":{"name":"Yavne"}}]}}'), (4, "broken{"), (5, '{"jobId":"78","title":"Read more"}')]
    feeds = spark.createDataFrame(pages, "feed_id int, payload string")
    got = S.structured_feed(feeds, ("jobId", "jobNumber", "id"), ("title", "jobTitle", "tl"), ("location", "city", "ct"), ("description",), "https://x.example/{id}", ".{1,10}")
    assert rows_of(got.select("feed_id", "external_id", "title", "location", "href")) == [
        (1, "77", "Data Engineer", "Haifa", "https://x.example/77"), (2, "X1", "FPGA Engineer", "Lod", "https://x.example/X1"), (3, "5", "Buyer", "Yavne", "https://x.example/5")]


def test_official_rows(spark):
    site = S.Site("https://x.example/open", r"/jobs/(\d+)", "https://x.example/jobs/{id}/")
    rows = [(1, "wix", "/jobs/1", "", "Data Engineer", "", "Work in Haifa, Israel with data"), (2, "wix", "", "go('/jobs/2')", "Read more", "REF12A", "x"),
            (3, "wix", "/jobs/1", "", "", "", ""), (4, "wix", "/about", "", "About", "", "")]
    frame = spark.createDataFrame(rows, "seq int, source string, href string, onclick string, title string, link_text string, text string")
    got = rows_of(S.postings_from_rows(frame, site).select("external_id", "title", "location", "apply_url"))
    assert got[0] == ("1", "Data Engineer", "Haifa, Israel", "https://x.example/jobs/1")
    assert [g[0] for g in got] == ["1", "2"] and got[1][3] == "https://x.example/jobs/2/"


def test_contract_of_plug_ins(spark):
    P.register_normalizer("bad", lambda raw: raw)
    try:
        with pytest.raises(TypeError):
            P.normalize_all(spark.createDataFrame([(1, "", "", "[]", "bad")], "source_id bigint, company string, token string, payload string, kind string"))
    finally:
        P.NORMALIZERS.pop("bad")


def test_lexicon_round_trip(spark):
    from vacantia import lexicons as L

    table = {}
    for row in P.lexicon_frame(spark, L.EMPLOYMENT_TYPES).orderBy("ordinal").collect():
        table[row["key"]] = table.get(row["key"], ()) + (row["term"],)
    assert table == L.EMPLOYMENT_TYPES


def test_batch_number_makes_writes_repeatable(spark, tmp_path):
    write = J.write_batch(str(tmp_path))
    rows = spark.range(5)
    write(rows, 0), write(rows, 0), write(rows, 1)
    assert spark.read.parquet(f"{tmp_path}/out/batch=*").count() == 10


def test_contained_texts_of_the_same_user(spark):
    """Against a plain search, for texts and users that repeat."""
    from vacantia.operators.answers import GRAM, _containing

    long = "what is your expected salary and when can you start"
    texts = [(1, long), (2, long), (1, "your expected salary"), (1, "x" * 40), (3, "short"), (None, long)]
    parts = [(1, "expected salary"), (1, "expected salary and nothing else"), (2, "when can you start"), (2, long), (1, "x" * 13), (3, "short"), (4, "expected salary"), (None, long)]
    got = _containing(spark.createDataFrame(texts, "user_id int, text string"), spark.createDataFrame(parts, "user_id int, part string"))
    want = {(u, t, p) for u, t in texts for v, p in parts if u is not None and u == v and len(p) >= GRAM and p in t}
    rows = [(r["user_id"], r["text"], r["part"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) == 5
