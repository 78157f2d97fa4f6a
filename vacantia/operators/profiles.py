"""Profile operators: defaults per track, list edits, overlays, work history, starter skills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.text import let


def mirror_latest_job(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Drop all-blank entries of ``work_experiences`` and copy the first one to flat ``current_*`` columns."""
    trimmed = F.transform("work_experiences", lambda e: F.struct(*[
        F.trim(F.coalesce(e[f], F.lit(""))).alias(f) for f in fields]))
    kept = F.filter(trimmed, lambda e: reduce(lambda a, b: a | b, [e[f] != "" for f in fields]))
    rows = rows.withColumn("work_experiences", kept)
    return rows.withColumns({
        f"current_{f}": F.coalesce(F.get("work_experiences", 0)[f], F.lit("")) for f in fields})


def ordered_union(*lists: Column) -> Column:
    """Case-insensitive union in order; the first spelling is kept."""
    every = F.filter(F.transform(F.concat(*lists), lambda v: F.trim(v)), lambda v: v != "")
    spelt = lambda values: F.struct(values.alias("values"), F.transform(values, lambda v: F.lower(v)).alias("keys"))
    first = lambda pair: F.filter(pair["values"], lambda v, i: F.array_position(pair["keys"], F.lower(v)) == i + 1)
    # The lists may be long expressions over whole texts: evaluated once, not once per entry.
    return let(let(every, spelt), first)
