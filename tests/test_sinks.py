"""Writers: what is written can be read back, in order and without secrets."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import filters as R
from vacantia.plans.fixtures import view
from vacantia.sources import exchange as E


def test_export_round_trip(spark, small, tmp_path):
    rows = E.export_catalogue(R.job_applications(view(spark, small, "postings"), view(spark, small, "applications"), "left"))
    E.write_export(rows, f"{tmp_path}/csv", "csv")
    E.write_export(rows, f"{tmp_path}/json", "json")
    read = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert read.count() == rows.count() == spark.read.json(f"{tmp_path}/json").count()
    numbers = [int(r["row_number"]) for r in read.select("row_number").collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))


def test_backup_drops_secrets(spark, small, tmp_path):
    profiles = view(spark, small, "profiles").withColumn("application_password", F.lit("secret"))
    E.write_backup({"profiles": profiles}, str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/profiles")
    assert "application_password" not in stored.columns and stored.count() == profiles.count()
