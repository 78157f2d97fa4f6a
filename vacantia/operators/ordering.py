"""Exact positions in a sorted order, without putting a whole group or table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacantia.session import cut_lineage

ROW_BITS = 33


def _placed(rows: DataFrame, order: list[Column], groups: tuple[str, ...]) -> DataFrame:
    """Rows sorted over all tasks by a range partitioning (a hot group is split like any other range), with
    ``_part`` and ``_id``.  Checkpointed, because the row ids must not change between passes."""
    keys = [F.col(g) for g in groups] + order
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
                         .withColumn("_id", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_id", ROW_BITS))


def positions(rows: DataFrame, order: list[Column], groups: tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """Number the rows from 1 in ``order`` (per group when ``groups`` is given).  ``order`` must be total.

    Only one row count per partition is summed up to turn local into global positions.
    """
    placed = _placed(rows, order, groups)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    # One row per partition: the window below sees as many rows as there are shuffle partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_id") - F.shiftleft(F.shiftright("_id", ROW_BITS), ROW_BITS)
    placed = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + local + 1)
    placed = placed.drop("_id", "_part", "_offset")
    if groups:
        first = placed.groupBy(*groups).agg(F.min(name).alias("_first"))
        placed = placed.join(first, list(groups)).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
    return placed


def carry_last(rows: DataFrame, order: list[Column], groups: tuple[str, ...], mark: str, name: str) -> DataFrame:
    """Most recent non-null ``mark`` at or before each row of its group.

    Within a partition by a window over that partition's range; across partitions by the last mark of each
    (group, partition), of which a group has at most as many as there are partitions.
    """
    placed = _placed(rows, order, groups)
    here = Window.partitionBy("_part", *groups).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.filter(F.col(mark).isNotNull()).groupBy("_part", *groups).agg(F.max_by(mark, "_id").alias("_end"))
    every = placed.select("_part", *groups).distinct().join(ends, ["_part", *groups], "left")
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("_part", *groups, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    placed = placed.withColumn("_here", F.last(mark, ignorenulls=True).over(here)).join(carried, ["_part", *groups])
    return placed.withColumn(name, F.coalesce("_here", "_carry")).drop("_here", "_carry", "_id", "_part")


def previous(rows: DataFrame, order: list[Column], groups: tuple[str, ...], value: str, name: str) -> DataFrame:
    """``value`` of the row before in each group (an equi-join on positions instead of a per-group window)."""
    numbered = positions(rows, order, groups)
    earlier = numbered.select(*groups, (F.col("position") + 1).alias("position"), F.col(value).alias(name))
    return numbered.join(earlier, [*groups, "position"], "left")


def follow(starts: DataFrame, pointers: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Positions (``groups``, position) met from ``starts`` along ``pointers`` (``groups``, at, to), starts included.

    Every position has at most one pointer, pointers lead forward, and none leads to a start.  After round n all positions fewer than
    2^n steps away are known and a pointer spans 2^n steps; pointers that run out of their chain drop out, so the rounds end.
    """
    known, pointers = starts, cut_lineage(pointers)
    while not pointers.isEmpty():
        step = pointers.withColumnRenamed("at", "position")
        known = cut_lineage(known.union(known.join(step, [*groups, "position"]).select(*groups, F.col("to").alias("position"))))
        second = pointers.select(*groups, F.col("at").alias("to"), F.col("to").alias("end"))
        pointers = cut_lineage(pointers.join(second, [*groups, "to"]).select(*groups, "at", F.col("end").alias("to")))
    return known


def top(rows: DataFrame, order: list[Column], groups: list[str], size: int, name: str = "position") -> DataFrame:
    """First ``size`` rows per group; Spark cuts each task to ``size`` rows per group before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= size)
