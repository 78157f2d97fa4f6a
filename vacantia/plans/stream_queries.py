"""Queries for the streaming jobs and the plug-in points.  Streams read files and run until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import lexicons as L
from vacantia.functions.dates import timestamp
from vacantia.operators import registry as P
from vacantia.operators.dictionary import term_keys
from vacantia.plans import duck as K, duck_scoring as S
from vacantia.plans.fixtures import spread, table, view
from vacantia.plans.funnel_queries import HEALTH
from vacantia.plans.registry import query
from vacantia.plans.scoring_queries import now, pairs
from vacantia.plans.source_queries import board_rows, html, landed, stamp
from vacantia.streaming import jobs as J

SLICES = 4


def event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sliced(rows, folder, column):
    """The rows written once, in time slices of several files each, and the stream that reads about one slice per batch, oldest first."""
    spark = rows.sparkSession
    low, high = rows.agg(F.unix_seconds(F.min(column)), F.unix_seconds(F.max(column))).first()
    part = F.floor((F.unix_seconds(column) - low) * SLICES / (high - low + 1))
    tasks = max(1, spark.sparkContext.defaultParallelism // SLICES)
    rows.withColumn("slice", part).repartition(SLICES * tasks, "slice", F.pmod(F.xxhash64(*rows.columns), F.lit(tasks))).write.mode("append").partitionBy("slice").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", tasks).parquet(f"{folder}/in")


@query("stream_event_dedup", "SELECT DISTINCT user_id AS application_id, event_id % 3 AS attempt, event_type AS stage FROM events")
def stream_event_dedup(spark, folder):
    place = J.workspace(spark, "dedup")
    events = event_stream(spark, folder).select(F.col("user_id").alias("application_id"), (F.col("event_id") % 3).alias("attempt"), F.col("event_type").alias("stage"), "ts")
    return J.run_dedup(events, ["application_id", "attempt", "stage"], place).select("application_id", "attempt", "stage")


@query("stream_source_health", HEALTH)
def stream_source_health(spark, folder):
    place = J.workspace(spark, "health")
    rows = J.source_health_stream(sliced(view(spark, folder, "scan_log"), place, "ts"), place)
    return rows.withColumn("disabled_until", F.col("disabled_until").cast("string"))


@query("stream_run_timeout", """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, career_track ORDER BY run_id DESC) AS rn FROM @@scan_runs) WHERE rn = 1), w AS (SELECT max(requested_at) AS t FROM @@scan_runs)
SELECT user_id, career_track, run_id, CASE WHEN status IN ('queued', 'running') AND requested_at + INTERVAL 2 HOUR < w.t THEN 'failed' ELSE status END AS state FROM l, w""")
def stream_run_timeout(spark, folder):
    place = J.workspace(spark, "timeout")
    runs = sliced(view(spark, folder, "scan_runs"), place, "requested_at")
    return J.run_timeout(runs, place)


BEAT = "2024-01-30 23:58:00"


@query("stream_heartbeat", f"SELECT user_id, max(ts)::timestamp::varchar AS last_seen, epoch_us(TIMESTAMP '{BEAT}') - epoch_us(max(ts)::timestamp) < 120000000 AS online FROM events GROUP BY 1")
def stream_heartbeat(spark, folder):
    place = J.workspace(spark, "heartbeat")
    rows = J.online(J.heartbeat(event_stream(spark, folder), place, "user_id"), timestamp(BEAT))
    return rows.withColumn("last_seen", F.col("last_seen").cast("string"))


@query("stream_progress", "SELECT user_id % 40 AS run_id, count(*) AS total, count_if(event_type IN ('click', 'purchase'))::bigint AS completed, arg_max('source ' || (event_id % 20)::varchar, (ts, event_id)) AS last_source FROM events GROUP BY 1")
def stream_progress(spark, folder):
    place = J.workspace(spark, "progress")
    events = event_stream(spark, folder).select((F.col("user_id") % 40).alias("run_id"), "ts", "event_id", F.col("event_type").isin("click", "purchase").alias("finished"),
                                                F.concat(F.lit("source "), (F.col("event_id") % 20).cast("string")).alias("source"))
    return J.progress(events, place)


#: Kinds of board in the landing table of the stream; a source has one.
KINDS = ("greenhouse", "lever", "ashby")


def landed_pages(spark, folder):
    """Pages of boards of several kinds, each page telling how many its board's scan has."""
    rows, way = board_rows(spark, folder), F.col("source_id") % len(KINDS)
    items = {
        "greenhouse": (F.struct(F.col("external_id").alias("id"), "title", F.struct(F.col("location").alias("name")).alias("location"), html().alias("content"), F.col("apply_url").alias("absolute_url"), stamp().alias("updated_at")), "jobs"),
        "lever": (F.struct(F.col("external_id").alias("id"), F.col("title").alias("text"), F.struct("location").alias("categories"), html().alias("description"), F.col("apply_url").alias("applyUrl")), None),
        "ashby": (F.struct(F.col("external_id").alias("id"), "title", "location", html().alias("descriptionHtml"), F.col("apply_url").alias("applyUrl"), stamp().alias("publishedAt")), "jobs"),
    }
    pages = None
    for number, kind in enumerate(KINDS):
        part = landed(rows.filter(way == number), *items[kind]).withColumn("kind", F.lit(kind))
        pages = part if pages is None else pages.unionByName(part)
    sizes = pages.groupBy("source_id").agg(F.count("*").alias("pages"))
    return pages.join(sizes, "source_id").select("source_id", "kind", "company", "token", F.lit(1).cast("bigint").alias("scan_id"), F.col("seq").cast("bigint").alias("seq"), "pages", "payload")


def normalized(pages):
    return P.normalize_all(pages).drop("kind", "source_url")


@query("stream_ingest")
def stream_ingest(spark, folder):
    """Page files as a stream, every board spread over several files; the catalogue after it (equals the batch jobs, see the tests)."""
    place = J.workspace(spark, "ingest")
    owners = view(spark, folder, "postings").select("source_id", "external_id", "user_id", "career_track")
    pages = landed_pages(spark, folder)
    pages.repartition(3, "seq").write.mode("overwrite").parquet(f"{place}/in")
    stream = spark.readStream.schema(J.PAGE).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    stored, actions = J.ingest_stream(stream, normalized, owners, view(spark, folder, "snap_prev"), view(spark, folder, "profiles"), place)
    done = actions.groupBy("source_id", "external_id").agg(F.max("action").alias("action"))
    return stored.read().select("source_id", "external_id", "title", "is_active", "reason").join(done, ["source_id", "external_id"], "left")


@query("register_normalizer", "SELECT CASE job_id % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'plain' END AS kind, external_id, title, location FROM @@postings")
def register_normalizer(spark, folder):
    """Pages of four kinds in one landing table; the fourth kind is a plug-in that reads plain JSON rows."""
    from vacantia.schemas import POSTING, conform

    def plain(raw):
        rows = raw.select("source_id", F.explode(F.from_json("payload", "array<struct<external_id: string, title: string, location: string>>")).alias("j")).select("source_id", "j.*")
        return conform(rows, POSTING)

    P.register_normalizer("plain", plain)
    try:
        rows, way = board_rows(spark, folder), F.col("job_id") % 4
        items = {
            "greenhouse": (0, F.struct(F.col("external_id").alias("id"), "title", F.struct(F.col("location").alias("name")).alias("location")), "jobs"),
            "lever": (1, F.struct(F.col("external_id").alias("id"), F.col("title").alias("text"), F.struct("location").alias("categories")), None),
            "ashby": (2, F.struct(F.col("external_id").alias("id"), "title", "location"), "jobs"),
            "plain": (3, F.struct("external_id", "title", "location"), None),
        }
        pages = None
        for kind, (residue, item, wrapper) in items.items():
            part = landed(rows.filter(way == residue), item, wrapper).withColumn("kind", F.lit(kind))
            pages = part if pages is None else pages.unionByName(part)
        return P.normalize_all(pages).select("kind", "external_id", "title", "location")
    finally:
        P.NORMALIZERS.pop("plain", None)


@query("register_engine", f"""WITH {S.v1_ctes()}, {S.eligibility_ctes().split(S.PAIR_CTE + ',', 1)[1]}, {S.v2_parts('el', S.DEFAULT)}
SELECT v1.job_id, v1.score, v2.score AS shadow_score, v2.tier AS shadow_tier, v2.score - v1.score AS delta FROM v1 JOIN v2 USING (job_id)""")
def register_engine(spark, folder):
    return P.shadow(pairs(spark, folder), now(), "v1", "v2").select("job_id", "score", "shadow_score", "shadow_tier", "delta")


@query("lexicons_as_tables", f"""WITH p AS (SELECT lower(title || ' ' || description) AS low FROM @@postings), s AS (SELECT unnest({K.keys('low', {**L.SKILLS, 'cooking': ('chef', 'kitchen')})}) AS skill FROM p) SELECT skill, count(*) AS postings FROM s GROUP BY 1""")
def lexicons_as_tables(spark, folder):
    """The skill table is written, extended by a user's rows, read back and used without a code change."""
    place = J.workspace(spark, "lexicon")
    own = spark.createDataFrame([(10_000, "cooking", "chef"), (10_001, "cooking", "kitchen")], "ordinal int, key string, term string")
    P.lexicon_frame(spark, L.SKILLS).unionByName(own).write.mode("overwrite").parquet(place)
    rows = spread(view(spark, folder, "postings")).select("job_id", F.concat_ws(" ", "title", "description").alias("text"))
    return term_keys(rows, "job_id", "text", spark.read.parquet(place)).groupBy(F.col("key").alias("skill")).agg(F.count("*").alias("postings"))
