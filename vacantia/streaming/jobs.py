"""Structured Streaming jobs.  Results are written to tables in a shared folder; nothing goes through the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacantia.operators import catalogue as C, quality as Q
from vacantia.operators.source_state import STALE_RUN_HOURS, source_health
from vacantia.session import checkpoint_dir
from vacantia.streaming.tables import KeyedTable


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run(stream: DataFrame, folder: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process everything available now, one ``foreachBatch`` call per micro-batch."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress")
             .trigger(availableNow=True).foreachBatch(each).start())
    query.awaitTermination()


def write_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """Write each batch under its own number; a repeated batch overwrites itself, so it counts once."""
    return lambda batch, number: batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number:08d}")


def event_dedup(events: DataFrame, keys: list[str]) -> DataFrame:
    """One event per (application, attempt, stage), however late a repeated one comes.

    The keys seen are exact state without a horizon. ``run_dedup`` keeps them in RocksDB, on the executors' disks with a change log in
    the progress folder, so they are bounded by disk and survive a lost executor.
    """
    return events.dropDuplicates(keys)


def run_dedup(events: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run ``event_dedup`` over all that is available and return the events kept."""
    spark = events.sparkSession
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rocks)
    try:
        run(event_dedup(events, keys), folder, "append", write_batch(folder))
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(events.schema).parquet(f"{folder}/out/batch=*")


def fold(stream: DataFrame, folder: str, schema: str, keys: list[str], partial: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame], DataFrame],
         after: Callable[[KeyedTable, DataFrame, int], None] | None = None) -> KeyedTable:
    """Aggregates per key, carried from batch to batch in a ``KeyedTable``.

    ``partial`` gives a batch's rows of ``schema``, combined before the shuffle; ``combine`` merges rows of one key in any order. So
    late and hot keys are exact, nothing has to expire, and the last value of a key stays readable.
    """
    table = KeyedTable(stream.sparkSession, f"{folder}/state", schema, keys)

    def each(batch: DataFrame, number: int) -> None:
        rows = partial(batch).persist()
        try:
            table.rewrite(number, rows, lambda old, new: combine(old.unionByName(new)))
            if after:
                after(table, rows, number)
        finally:
            rows.unpersist()

    run(stream, folder, "append", each)
    return table


def heartbeat(events: DataFrame, folder: str, key: str, time: str = "ts") -> DataFrame:
    """Last sign of life per key, over all time."""
    latest_of = lambda rows, column: rows.groupBy(key).agg(F.max(column).alias("last_seen"))
    kind = dict(events.dtypes)[key]
    return fold(events, folder, f"{key} {kind}, last_seen timestamp", [key], lambda b: latest_of(b, time), lambda r: latest_of(r, "last_seen")).read()


def online(seen: DataFrame, now: Column, seconds: int = 120) -> DataFrame:
    return seen.withColumn("online", F.unix_micros(now) - F.unix_micros("last_seen") < seconds * 1_000_000)


def progress(events: DataFrame, folder: str) -> DataFrame:
    """Live completed / total and the last source of each run."""
    last = "struct<ts: timestamp, event_id: bigint, source: string>"
    partial = lambda b: b.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if("finished").alias("completed"), F.max(F.struct("ts", "event_id", "source")).cast(last).alias("last"))
    combine = lambda r: r.groupBy("run_id").agg(F.sum("total").alias("total"), F.sum("completed").alias("completed"), F.max("last").alias("last"))
    rows = fold(events, folder, f"run_id bigint, total bigint, completed bigint, last {last}", ["run_id"], partial, combine).read()
    return rows.select("run_id", "total", "completed", F.col("last.source").alias("last_source"))


def source_health_stream(log: DataFrame, folder: str) -> DataFrame:
    """Health state of every source, carried from batch to batch.

    A batch is folded with the aggregates of the batch job, so a source that dominates a batch is combined before the shuffle. The
    outcomes of every batch are kept beside the state: a source with an outcome older than its state is folded anew from all of them.
    """
    spark = log.sparkSession
    outcomes = "source_id bigint, event_id bigint, ts timestamp, outcome string"
    moment = "struct<ts: timestamp, event_id: bigint>"
    state = KeyedTable(spark, f"{folder}/state", f"source_id bigint, consecutive_failures bigint, health_score int, disabled_until timestamp, last {moment}", ["source_id"])

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.select("source_id", "event_id", "ts", "outcome").persist()
        late = now = batch
        try:
            span = batch.groupBy("source_id").agg(F.min(F.struct("ts", "event_id")).cast(moment).alias("first"), F.max(F.struct("ts", "event_id")).cast(moment).alias("end"))
            old = state.touched(batch, number)
            late = old.join(span, "source_id").where(F.col("first") < F.col("last")).select("source_id").persist()
            batch.write.mode("overwrite").parquet(f"{folder}/log/batch={number:08d}")
            now = source_health(batch.join(late, "source_id", "left_anti"), old)
            if not late.isEmpty():
                earlier = spark.read.schema(f"{outcomes}, batch int").parquet(f"{folder}/log").where(F.col("batch") <= number).drop("batch")
                now = now.unionByName(source_health(earlier.join(late, "source_id", "left_semi")))
            ends = old.select("source_id", "last").unionByName(span.select("source_id", F.col("end").alias("last"))).groupBy("source_id").agg(F.max("last").alias("last"))
            # Used for the touched buckets and twice in the merge, computed once.
            now = now.join(ends, "source_id").withColumn("consecutive_failures", F.col("consecutive_failures").cast("bigint")).persist()
            state.rewrite(number, now, lambda before, new: before.join(new.select("source_id"), "source_id", "left_anti").unionByName(new))
        finally:
            for frame in (now, late, batch):
                frame.unpersist()

    run(log, folder, "append", each)
    return state.read().drop("last")


ACTIVE = ("queued", "running")
RUN = "struct<run_id: bigint, requested_at: timestamp, status: string>"


def silent(run: Column, clock: Column) -> Column:
    """Whether a run is still active though two hours of event time have passed since its last event."""
    return run["status"].isin(*ACTIVE) & (run["requested_at"] + F.make_dt_interval(F.lit(0), F.lit(STALE_RUN_HOURS)) < clock)


def run_timeout(runs: DataFrame, folder: str) -> DataFrame:
    """State of the newest run of every user and track; a run that is silent for two hours of event time has failed.

    The newest run is that of the largest run_id, its state that of its last event, whatever order events come in. The event clock
    (the latest event seen) is a table of one row. Runs whose time has come are found after each batch by a filtered read of the
    state, and written to ``folder/out`` once, in the batch that moves the clock past them.
    """
    spark = runs.sparkSession
    keys = ["user_id", "career_track"]
    clock = KeyedTable(spark, f"{folder}/clock", "name string, at timestamp", ["name"], 1)
    newest = lambda rows, what: rows.groupBy(*keys).agg(F.max(what).cast(RUN).alias("run"))
    at = lambda below: (clock.read(below).first() or [None, None])[1]

    def timers(table: KeyedTable, rows: DataFrame, number: int) -> None:
        seen = rows.select(F.lit("event time").alias("name"), F.col("run.requested_at").alias("at"))
        clock.rewrite(number, seen, lambda old, new: old.unionByName(new).groupBy("name").agg(F.max("at").alias("at")))
        before, now = at(number), at(number + 1)
        fired = table.read(number + 1).where(silent(F.col("run"), F.lit(now)))
        if before is not None:
            known = table.read(number).where(silent(F.col("run"), F.lit(before))).select(*keys, F.col("run.run_id").alias("known"))
            fired = fired.join(known, keys, "left").where("known IS NULL OR known <> run.run_id").drop("known")
        fired.select(*keys, "run.run_id").withColumn("state", F.lit("failed")).write.mode("overwrite").parquet(f"{folder}/out/batch={number:08d}")

    event = F.struct("run_id", "requested_at", "status")
    table = fold(runs, folder, f"user_id bigint, career_track string, run {RUN}", keys, lambda b: newest(b, event), lambda r: newest(r, "run"), timers)
    now = at(None)
    state = F.when(silent(F.col("run"), F.lit(now)), "failed").otherwise(F.col("run.status")) if now is not None else F.col("run.status")
    return table.read().select(*keys, "run.run_id", state.alias("state"))


PAGE = "source_id bigint, kind string, company string, token string, scan_id bigint, seq bigint, pages bigint, payload string"
CATALOGUE = ("source_id bigint, external_id string, user_id bigint, career_track string, title string, company string, location string, workplace string, "
             "description string, apply_url string, published_at timestamp, is_active boolean, reason string")


def apply_actions(stored: DataFrame, listed: DataFrame, actions: DataFrame) -> DataFrame:
    """The catalogue after ``actions``: listed rows stand for inserted, updated and reactivated postings, removed ones stay inactive with
    their reason, the others as they are."""
    columns = [c.split()[0] for c in CATALOGUE.split(", ")]
    written = ("insert", "update", "reactivate")
    one = listed.groupBy(*C.KEY).agg(F.min(F.struct(*[c for c in listed.columns if c not in C.KEY])).alias("r")).select(*C.KEY, "r.*")
    fresh = one.join(actions.where(F.col("action").isin(*written)).select(*C.KEY), C.KEY).withColumns({"is_active": F.lit(True), "reason": F.lit(None).cast("string")})
    fates = actions.select(*C.KEY, "action", F.col("reason").alias("why"))
    rest = stored.join(fates, C.KEY, "left").where(~F.coalesce(F.col("action").isin(*written), F.lit(False)))
    gone = F.coalesce(F.col("action") == "remove", F.lit(False))
    rest = rest.withColumns({"is_active": F.col("is_active") & ~gone, "reason": F.when(gone, F.col("why")).otherwise(F.col("reason"))})
    return fresh.select(*columns).unionByName(rest.select(*columns))


def ingest_stream(payloads: DataFrame, normalize: Callable[[DataFrame], DataFrame], owners: DataFrame, catalogue: DataFrame, profiles: DataFrame, folder: str) -> tuple[KeyedTable, DataFrame]:
    """Landed pages of boards (``PAGE``) as a stream: the catalogue table, and the actions of every batch.

    A page says of how many its board's scan consists. Pages wait in a table until their scan is complete, in whatever order and batches
    they come; then the newest complete scan of each source is normalised, gated and reconciled with the source's stored postings, and
    the catalogue's buckets are rewritten. Pages of scans that are not newer than the last one taken are dropped.
    """
    spark = payloads.sparkSession
    waiting = KeyedTable(spark, f"{folder}/waiting", PAGE, ["source_id"])
    taken = KeyedTable(spark, f"{folder}/taken", "source_id bigint, scan_id bigint", ["source_id"])
    stored = KeyedTable(spark, f"{folder}/catalogue", CATALOGUE, ["source_id"])
    columns = [c.split()[0] for c in CATALOGUE.split(", ")]
    stored.rewrite(-1, catalogue.withColumn("reason", F.lit(None).cast("string")).select(*columns), lambda old, new: new)

    def each(batch: DataFrame, number: int) -> None:
        names = [c.split()[0] for c in PAGE.split(", ")]
        done = taken.read(number).withColumnRenamed("scan_id", "done")
        pages = waiting.touched(batch, number).unionByName(batch.select(*names)).dropDuplicates(["source_id", "scan_id", "seq"])
        pages = pages.join(done, "source_id", "left").where("done IS NULL OR scan_id > done").drop("done").persist()
        complete = postings = gated = pages
        try:
            counts = pages.groupBy("source_id", "scan_id").agg(F.count("*").alias("n"), F.max("pages").alias("pages"))
            complete = counts.where("n >= pages").groupBy("source_id").agg(F.max("scan_id").alias("scan_id")).persist()
            postings = normalize(pages.join(complete, ["source_id", "scan_id"], "left_semi")).join(owners, ["source_id", "external_id"]).persist()
            gated = Q.payload_gate(Q.batch_profile(postings, ["source_id"])).select("source_id", "gate").persist()
            good = gated.where("gate IS NULL").select("source_id")
            listed = postings.join(good, "source_id", "left_semi").withColumns({"is_active": F.lit(True), "reason": F.lit(None).cast("string")}).select(*columns)
            old = stored.touched(complete, number).join(good, "source_id", "left_semi")
            actions = C.snapshot_reconcile(old, listed, profiles).withColumn("_batch", F.lit(number))
            refused = gated.where("gate IS NOT NULL").select("source_id", F.lit("").alias("external_id"), F.lit("quality_failed").alias("action"), F.col("gate").alias("reason"), F.lit(number).alias("_batch"))
            actions.unionByName(refused).write.mode("overwrite").parquet(f"{folder}/out/batch={number:08d}")
            actions = spark.read.schema(actions.schema).parquet(f"{folder}/out/batch={number:08d}").where("action <> 'quality_failed'")
            listed = listed.drop("is_active", "reason")
            stored.rewrite(number, good, lambda before, good: apply_actions(before, listed, actions))
            taken.rewrite(number, complete, lambda before, new: before.join(new.select("source_id"), "source_id", "left_anti").unionByName(new))
            # Last: what still waits. A batch that is lost before this is run again as a whole.
            left = pages.join(complete.withColumnRenamed("scan_id", "done"), "source_id", "left").where("done IS NULL OR scan_id > done").drop("done")
            waiting.rewrite(number, batch.select(*names), lambda before, new: left.select(*names))
        finally:
            for frame in (pages, complete, postings, gated):
                frame.unpersist()

    run(payloads, folder, "append", each)
    return stored, spark.read.schema("source_id bigint, external_id string, action string, reason string").parquet(f"{folder}/out/batch=*")
