"""Versioned tables of keyed rows, rewritten bucket by bucket by the micro-batches of a stream.

Rows lie in bucket folders by the hash of their bucket columns. A micro-batch reads the buckets that its rows touch, merges, writes them
under its own number, and at last a pointer: which version of each bucket counts from now on. A batch reads what pointers before its
own number say and overwrites what it wrote itself, so a batch that is run again changes nothing; a batch that is lost before its
pointer leaves no trace. No state is held in memory or on an executor's disk between batches. Versions that neither the last pointer nor
the one before it names are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 16


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders ``number=...`` below ``path`` that were written to the end."""
    system, target = _path(spark, path)
    if not system.exists(target):
        return []
    names = [s.getPath() for s in system.listStatus(target)]
    done = [n for n in names if n.getName().startswith("number=") and _path(spark, f"{n}/_SUCCESS")[0].exists(_path(spark, f"{n}/_SUCCESS")[1])]
    return sorted(int(n.getName().split("=")[1]) for n in done)


class KeyedTable:
    """A table of ``schema``; the rows of one value of the columns ``by`` are in one bucket."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, by: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.schema, self.by, self.buckets = spark, folder, schema, by, buckets

    def _pointer(self, below: int | None) -> tuple[int, dict[int, int]]:
        numbers = [n for n in _numbers(self.spark, f"{self.folder}/pointer") if below is None or n < below]
        if not numbers:
            return -1, {}
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.folder}/pointer/number={numbers[-1]}")
        return numbers[-1], {r["bucket"]: r["version"] for r in rows.collect()}

    def _rows(self, where: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/number={v}/_bucket={b}" for b, v in sorted(where.items())]
        paths = [p for p in paths if _path(self.spark, p)[0].exists(_path(self.spark, p)[1])]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, below: int | None = None) -> DataFrame:
        """All rows, as the last batch (or the last one before number ``below``) left them."""
        return self._rows(self._pointer(below)[1])

    def touched(self, rows: DataFrame, below: int) -> DataFrame:
        """The stored rows of the buckets that ``rows`` touch."""
        touched = self._touched(rows)
        return self._rows({b: v for b, v in self._pointer(below)[1].items() if b in touched})

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}  # at most ``buckets`` numbers

    def rewrite(self, number: int, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Batch ``number``: the touched buckets become ``merge(stored rows of them, changes)``."""
        touched = self._touched(changes)
        if not touched:
            return
        last, where = self._pointer(number)
        old = self._rows({b: v for b, v in where.items() if b in touched})
        new = merge(old, changes).withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket")
        new.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/number={number}")
        now = where | dict.fromkeys(touched, number)
        rows = self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.folder}/pointer/number={number}")
        for kind, used in (("data", {number, last, *now.values(), *where.values()}), ("pointer", {number, last})):
            for old_number in _numbers(self.spark, f"{self.folder}/{kind}"):
                if old_number < number and old_number not in used:
                    system, target = _path(self.spark, f"{self.folder}/{kind}/number={old_number}")
                    system.delete(target, True)
