"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vacantia.plans import QUERIES  # noqa: E402
from vacantia.session import local_session  # noqa: E402

HEADLINE = (
    "clean_text", "skills_extract", "experience_extract", "canonical_city", "filter_region", "track_audit", "payload_quality",
    "snapshot_reconcile", "duplicate_merge", "retention_purge", "score_v1", "score_v2", "eligibility", "top_recommendations",
    "rerank_incremental", "best_resume", "skill_gaps", "jobs_sorted", "latest_attempt", "active_blocker", "source_health",
    "funnel_fold", "timeline", "submission_outcome", "answer_resolve", "email_evidence", "ingest_greenhouse",
    "ingest_smartrecruiters", "stream_source_health", "scan_requests",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    # Start the JVM paths once, so that the first query does not carry the start-up cost.
    spark.read.parquet(f"{folder}/supplier.parquet").groupBy("s_nationkey").count().collect()
    seconds: dict[str, float] = {}
    for key in HEADLINE:
        start = time.time()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.time() - start, 3)
    postings = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "pairs_per_second": {key: round(postings / seconds[key]) for key in ("score_v1", "score_v2", "snapshot_reconcile")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
