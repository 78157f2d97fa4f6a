"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over blocks.

A dimension is a term. A block of candidates is turned into postings, per term the rows with a non-zero weight and their weights; a
block of queries is a set of sparse rows. Each query scatters its weighted postings, term by term, into one dense array of scores,
of which a partition selection keeps the k best; the blocks' answers are merged per query. Nothing is skipped: every query meets
every candidate block.

Blocks are bounded in rows and in weights, whatever the table's size and width; postings are built from the rows' own weights and never
from a dense matrix. Candidates are dealt to blocks in turn, queries likewise; every pair of a query block and a candidate block is
one group, so a task holds one block of each. The candidates travel once per query block, the queries once per candidate block, and k
rows per query and candidate block come back.

Scores are exact at any size of the weights. Weights are kept as doubles, which hold a scaled component exactly; a pair whose product of
largest weights times dimensions could leave 62 bits is summed over Python integers instead of 64-bit ones, decided per pair.

Edge cases. A vector that is null or holds a null or non-finite component takes no part, nor does one whose component times 256 is no
finite double (from 7e305), nor a row without vec_id. Missing components of shorter vectors count as 0, an empty vector scores 0 with all.
A query's own rows, those with its vec_id, are no candidates; a vec_id that repeats is a candidate, and a query, per row. Ties go to the
smaller vec_id. A score beyond a long is reported as the nearest long, but ranked by its exact value. An empty table, or one without
queries, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.llm.shared import stored

#: Rows, and weights, of a block.
BLOCK_ROWS, BLOCK_WEIGHTS = 8_192, 1 << 22
SCALE = 256
#: Sums that stay below this are taken over 64-bit integers.
SAFE = 2**62
LEAST, MOST = -(2**63), 2**63 - 1
#: Digits of any score: two weights below 2 ** 1024 each, over fewer than 2 ** 31 dimensions.
DIGITS = 640
VECTORS = "vec_id long, row long, weights array<double>"
ANSWERS = "query_row long, query_id long, vec_id long, score long, beyond string"


def _scaled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, row, embedding) with floor(256 * x) per component; rows that take no part are left out."""
    for batch in batches:
        vectors = batch.column(2)
        flat = vectors.flatten().cast(pa.float64())
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(SCALE * np.asarray(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), dtype=np.float64))
        fit = np.isfinite(values)
        lengths = np.array([len(v) if v.is_valid else 0 for v in vectors], np.int64)
        bad = np.zeros(batch.num_rows, np.int64)
        np.add.at(bad, np.repeat(np.arange(batch.num_rows), lengths), ~fit)
        keep = (bad == 0) & np.asarray(vectors.is_valid()) & np.asarray(batch.column(0).is_valid())
        whole = values[np.repeat(keep, lengths)]
        offsets = np.concatenate(([0], np.cumsum(lengths[keep]))).astype(np.int32)
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole))], ["vec_id", "row", "weights"])


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, a number of the row, and the weights, whole numbers, of every vector that takes part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_scaled, VECTORS)


class Postings:
    """A block of candidates, by rising vec_id, so that of equal scores the smaller one stands first: per term its rows and their weights."""

    def __init__(self, table: pa.Table) -> None:
        table = table.take(pa.array(np.argsort(table.column("vec_id").to_numpy(), kind="stable")))
        self.ids = table.column("vec_id").to_numpy()
        rows, terms, weights = _sparse(table)
        self.largest = np.zeros(len(self.ids))
        np.maximum.at(self.largest, rows, np.abs(weights))
        order = np.argsort(terms, kind="stable")
        self.dims = int(terms.max()) + 1 if len(terms) else 0
        cuts = np.searchsorted(terms[order], np.arange(1, self.dims))
        self.rows, self.exact = np.split(rows[order], cuts), np.split(weights[order], cuts)
        # What does not fit 64 bits is never read from here: such rows are summed over Python integers.
        self.weights = [np.where(np.abs(w) < SAFE, w, 0).astype(np.int64) for w in self.exact]

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The score of every candidate with one query: 64-bit integers, or Python integers if a score could leave them."""
        n = len(self.ids)
        shared = terms < self.dims
        terms, weights = terms[shared], weights[shared]
        bound = float(np.abs(weights).max()) * len(weights) if len(weights) else 0.0
        with np.errstate(over="ignore"):
            hard = self.largest * bound >= SAFE
        scores = np.zeros(n, np.int64)
        if not hard.all():
            for term, weight in zip(terms, weights, strict=True):
                # A query weight of 62 bits or more makes every candidate with a weight a hard one.
                weight = int(weight) if abs(weight) < SAFE else 0
                if len(self.rows[term]) == n:  # a full list needs no scatter
                    scores += weight * self.weights[term]
                else:
                    scores[self.rows[term]] += weight * self.weights[term]
        if not hard.any():
            return scores
        scores = scores.astype(object)
        scores[hard] = 0
        for term, weight in zip(terms, weights, strict=True):
            rows, among = self.rows[term], hard[self.rows[term]]
            scores[rows[among]] += np.array([int(weight) * int(w) for w in self.exact[term][among]], dtype=object)
        return scores


def _sparse(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every weight that is not zero, by row and term."""
    lists = table.column("weights").combine_chunks()
    lengths = np.asarray(lists.value_lengths(), np.int64)
    flat = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = flat != 0
    return rows[some], terms[some], flat[some]


def _beyond(score: int) -> str | None:
    """For a score at or beyond the ends of a long: a text that sorts among those of its sign as the score does."""
    if LEAST < score < MOST:
        return None
    return str(score if score > 0 else 10**DIGITS + score).zfill(DIGITS)


def _block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k best candidates of this block for each query of this block."""
    out: list[list] = [[], [], [], [], []]
    if candidates.num_rows and queries.num_rows:
        block = Postings(candidates)
        rows, terms, weights = _sparse(queries)
        cuts = np.searchsorted(rows, np.arange(queries.num_rows + 1))
        for i, (number, query) in enumerate(zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), strict=True)):
            mine = slice(cuts[i], cuts[i + 1])
            scores = block.scores(terms[mine], weights[mine])
            others = np.flatnonzero(block.ids != query)
            if len(others) > k:
                bound = np.partition(scores[others], len(others) - k)[len(others) - k]
                others = others[scores[others] >= bound]  # all that tie with the k-th
            best = others[np.argsort(-scores[others], kind="stable")[:k]]
            found = [int(s) for s in scores[best]]
            for column, values in zip(out, ([number] * len(best), [query] * len(best), block.ids[best].tolist(), [min(max(s, LEAST), MOST) for s in found], map(_beyond, found)), strict=True):
                column.extend(values)
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["query_row", "query_id", "vec_id", "score", "beyond"])


def _blocks(vectors: DataFrame) -> int:
    """Into how many blocks the rows go."""
    rows, weights = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("weights")), F.lit(0))).first()
    return max(1, -(-rows // BLOCK_ROWS), -(-weights // BLOCK_WEIGHTS))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each row of ``queries`` its ``k`` best rows of ``vectors`` (both as ``scaled`` gives them): query_id, rank, vec_id, score."""
    blocks, query_blocks = _blocks(vectors), _blocks(queries)
    # Rows are dealt in turn within their partition of the stored table, so blocks are even and a repeated vec_id does not gather.
    dealt = vectors.select("*", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).alias("block"))
    asked = queries.select("*", F.pmod(F.monotonically_increasing_id(), F.lit(query_blocks)).alias("query_block"))
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = dealt.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    # One grouping of the union: a cogroup's second side loses columns where a later step needs only some of the result.
    both = left.withColumn("asks", F.lit(True)).unionByName(right.withColumn("asks", F.lit(False)))

    def group(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        return _block(table.filter(asks), table.filter(pc.invert(asks)), k)

    part = both.groupBy("block", "query_block").applyInArrow(group, ANSWERS)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for each vector whose id is divisible by 50."""
    vectors = stored(scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def oracle(table: str = "embeddings") -> str:
    """DuckDB text of ``op7_exact_topk`` over ``table``; scores of up to 127 bits."""
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS w FROM {table}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])), 0) AS HUGEINT) AS exact
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY exact DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, CAST(least(greatest(exact, CAST({LEAST} AS HUGEINT)), CAST({MOST} AS HUGEINT)) AS BIGINT) AS score FROM ranked WHERE rank <= 5
"""
