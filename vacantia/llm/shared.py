"""What several corpus operators need: tables in the shared folder, and the smallest label of each connected component."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.session import checkpoint_dir

#: The word separators of the corpus operators: space, and tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Rows of the smallest neighbours of all nodes up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Narrow rows that one task takes at least.
TASK_ROWS = 25_000


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which every executor reaches."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: later passes, and lost executors, read the table."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``stored`` wrote. Nothing that is still to be computed may read it."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def unused(names: list[str], wish: str) -> str:
    """``wish``, with underscores before it until no column has that name in any case."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` to be broadcast if its rows are few, else left to an ordinary join."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def in_few_tasks(df: DataFrame, rows: int, each: int | None = None) -> DataFrame:
    """``df``, which is made of about ``rows`` rows, in no more tasks than these are worth: one per ``each`` of them, and two per core."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // (each or TASK_ROWS))))


def smallest_labels(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, label) per node, label being the smallest node of its component.

    Large-star and small-star steps in turn: each replaces edges by edges to smaller nodes of the same component until every node
    hangs on its smallest one. Both are a map-side combined minimum and an equi-join; the join on a node with very many edges is one
    that Spark can split, and the minima are broadcast while they are few. Every step is written as a table. The number of steps
    grows with the logarithm of the node count. Edges with a null end, and loops, are ignored. Without edges the result is empty.
    """
    a, b = F.col("a"), F.col("b")
    links = stored(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    while True:
        count = links.count()
        # A node hangs on its smallest one, or is it, unless it has a smaller neighbour and another one.
        both = links.union(links.select("b", "a")).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
        least = both.select("a", F.least("a", "low").alias("m"), ((F.col("low") < a) & (F.col("low") != F.col("high"))).alias("open"))
        least = stored(in_few_tasks(least, count), "least")
        if least.where("open").isEmpty():
            return least.select(a.alias("node"), F.col("m").alias("label"))
        # Large star: every larger neighbour of a node is linked with the node's smallest neighbour (or itself).
        grown = links.select(b.alias("a"), a.alias("b")).join(bounded(least), "a").select(b.alias("a"), F.col("m").alias("b")).where("a != b")
        # Small star: every smaller neighbour of a node, and the node, are linked with the node's smallest neighbour.
        grown = stored(in_few_tasks(grown, count), "large-star")
        least = stored(in_few_tasks(grown.groupBy("a").agg(F.min("b").alias("m")), count), "least")
        near = in_few_tasks(grown.join(bounded(least), "a"), count)
        links = near.select(b.alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).where("a != b").distinct()
        links = stored(in_few_tasks(links, count), "small-star")
