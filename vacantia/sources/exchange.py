"""Import, export, backup, restore and migration of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import lexicons as L
from vacantia.functions.locations import in_region
from vacantia.operators.ordering import positions

SECRETS = ("application_password", "agent_token", "token_hash", "refresh_token", "phone_secret")


def import_manual(submitted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Postings entered by hand: region required, one per link, existing ones returned unchanged."""
    valid = submitted.filter(in_region(F.col("location"))).withColumn("external_id", F.sha2("apply_url", 256))
    one = valid.groupBy("source_id", "external_id").agg(F.min(F.struct("seq", "title", "location", "apply_url")).alias("f")).select("source_id", "external_id", "f.*")
    known = catalogue.select("source_id", F.sha2("apply_url", 256).alias("external_id"), F.lit(True).alias("known")).distinct()
    return one.join(known, ["source_id", "external_id"], "left").withColumn("created", F.col("known").isNull()).drop("known")


def export_catalogue(rows: DataFrame) -> DataFrame:
    """Flat export, newest discovery first, with its row number as the order."""
    flat = rows.select("job_id", "title", "company", "location", "score", "status", "apply_url", "discovered_at",
                       F.coalesce("application_status", F.lit("")).alias("application_status"))
    return positions(flat, [F.col("discovered_at").desc(), F.col("job_id").desc()], name="row_number")


def write_export(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Write an export as CSV or JSON; files follow the row number."""
    writer = rows.repartitionByRange(F.col("row_number")).sortWithinPartitions("row_number").write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)


def backup_bundle(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a backup without secret columns."""
    return {name: rows.drop(*SECRETS) for name, rows in tables.items()}


def write_backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, rows in backup_bundle(tables).items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of both sides by natural key; a value of the new side wins where it is not null."""
    incoming = new.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    rows = old.select(*keys, *values, F.lit(True).alias("_old")).join(incoming.withColumn("_new", F.lit(True)), keys, "full_outer")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNotNull(), "update").otherwise("keep")
    return rows.select(*keys, *[F.coalesce(f"_{v}", v).alias(v) for v in values], action.alias("action"))


def known_track(column: Column) -> Column:
    track = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    return F.when(track.isin(*L.TRACKS), track).otherwise(L.CS)


def restore_sources(old: DataFrame, bundle: DataFrame, owner: Column) -> DataFrame:
    """Sources of a bundle by (owner, kind, identifier, track); unknown tracks become the default; the last entry of a board wins.

    ``owner`` is the user who restores (a column of the bundle or a constant): boards of other users are neither matched nor changed.
    """
    keys = ["user_id", "kind", "identifier", "career_track"]
    new = bundle.withColumns({"user_id": owner, "career_track": known_track(F.col("career_track"))}).filter("trim(kind) <> '' AND trim(identifier) <> ''")
    new = new.groupBy(*keys).agg(F.max(F.struct("source_id", "name", "company_name", "enabled")).alias("n")).select(*keys, "n.name", "n.company_name", "n.enabled")
    return upsert(old.dropDuplicates(keys), new, keys, ["name", "company_name", "enabled"])


def last_entries(bundle: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key: the values of the entry with the largest ``order``."""
    return bundle.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("n")).select(*keys, *[F.col(f"n.{v}").alias(v) for v in values])


def restore_answers(old: DataFrame, bundle: DataFrame, owner: Column) -> DataFrame:
    """Remembered answers of a bundle by (owner, pattern); what an entry leaves out becomes empty or false, the last of equal patterns
    wins, entries without a pattern are left out.

    ``old``: (user_id, pattern, answer, auto_use); ``bundle`` also has ``seq``, the place in the file.
    """
    keys, values = ["user_id", "pattern"], ["answer", "auto_use"]
    new = bundle.withColumns({"user_id": owner, "pattern": F.substring("pattern", 1, 500), "answer": F.coalesce("answer", F.lit("")),
                              "auto_use": F.coalesce("auto_use", F.lit(False))}).filter("pattern <> ''")
    return upsert(old.dropDuplicates(keys), last_entries(new, keys, "seq", values), keys, values)


def restore_applications(old: DataFrame, bundle: DataFrame, postings: DataFrame, owner: Column) -> DataFrame:
    """Applications of a bundle whose posting exists among those of the owner, one per posting; the last entry of a posting wins.

    An entry without status or mode becomes saved and in review; a reminder that an entry leaves out stays.  ``old``: (user_id, job_id,
    status, mode, reminder_at); ``bundle`` also has ``seq``.  The posting takes the status of its application.
    """
    keys, values = ["user_id", "job_id"], ["status", "mode", "reminder_at"]
    filled = lambda name, default: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))
    new = bundle.withColumns({"user_id": owner, "status": filled("status", "saved"), "mode": filled("mode", "review")})
    new = last_entries(new, keys, "seq", values).join(postings.select(*keys), keys, "left_semi")
    return upsert(old, new, keys, values)


def migrate_table(rows: DataFrame, target_columns: list[str], owner: str, paths: DataFrame | None = None, path_column: str | None = None) -> DataFrame:
    """Rows in the target's columns (those both sides have), stamped with the owner, paths rewritten by a map table."""
    shared = [c for c in target_columns if c in rows.columns and c != "user_id"]
    moved = rows.select(*shared).withColumn("user_id", F.lit(owner))
    if paths is not None and path_column in shared:
        new = paths.select(F.col("old_path").alias(path_column), "new_path")
        moved = moved.join(new, path_column, "left").withColumn(path_column, F.coalesce("new_path", path_column)).drop("new_path")
    return moved


def require_empty(target: DataFrame, name: str) -> None:
    if not target.isEmpty():
        raise ValueError(f"target table {name} is not empty")
