"""Best-fit packing of token sequences, certified by lower bounds.

``pieces`` encodes the documents and cuts those that are longer than a sequence into full pieces, the first of which may be shorter.
A full piece is a sequence by itself. The rest is packed by best-fit decreasing in partitions of a fixed mean size. Dual-feasible
functions give a lower bound on the sequences that a partition needs; a partition that meets its bound is certified, and keeps all
its sequences but the emptiest. A partition with a gap keeps its full and nearly full sequences and gives up the documents of the
others. What is given up is dealt anew to fewer partitions, so that documents of different partitions meet, and packed again, until
one partition holds the rest or a round no longer helps.

Only sizes and row numbers move between tasks; texts and ids stay in the table that ``pieces`` writes. A group holds about
``GROUP_ROWS`` sizes whatever the table's size. ``sequences`` joins the ids to their places.

Edge cases. A null text counts as empty and gets the end id alone. Rows that share a doc_id are documents of their own (``place`` tells
them apart); a null doc_id is handed on. Equal sizes are taken in the order of ``place``, so a run can be repeated. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.shared import stored
from vacantia.llm.units import encoder

#: Mean rows of a packing group.
GROUP_ROWS = 100_000
#: A sequence with at most this share of its length free is kept by a partition that gives documents up.
NEARLY = 1 / 64


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; only the first may be shorter than ``capacity``."""
    first = length if length <= capacity else length % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, length, capacity))]


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Fewest sequences that the sizes can need: the best bound of two families of dual-feasible functions."""
    values, counts = np.unique(sizes, return_counts=True)
    if not len(values):
        return 0
    best = -(-int(sizes.sum()) // capacity)
    for edge in range(1, capacity // 2 + 1):  # small ones count nothing, large ones a whole sequence
        weight = np.where(values > capacity - edge, capacity, np.where(values < edge, 0, values))
        best = max(best, -(-int((weight * counts).sum()) // capacity))
    for k in range(1, 101):  # steps of 1/k, down except at exact multiples
        scaled = (k + 1) * values
        weight = np.where(scaled % capacity == 0, scaled // capacity * k, scaled // capacity * (k + 1))
        best = max(best, -(-int((weight * counts).sum()) // (k * (k + 1))))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence of each size (given in falling order), and what is left free in each sequence."""
    free: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_at = 0  # bit i: a sequence with i tokens free
    where = []
    for size in sizes:
        fits = open_at >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            chosen = by_free[left].pop()
            if not by_free[left]:
                open_at ^= 1 << left
        else:
            chosen, left = len(free), capacity
            free.append(capacity)
        left -= size
        free[chosen] = left
        by_free[left].append(chosen)
        if left:
            open_at |= 1 << left
        where.append(chosen)
    return where, free


PIECES = "doc_id {kind}, place long, piece int, start long, length long, ids_crc32 long, ids binary"


def _pieces(batches: Iterable[pa.RecordBatch], schema: pa.Schema, file: str, units: str, end: bytes, capacity: int) -> Iterator[pa.RecordBatch]:
    bpe = encoder(file, units)
    wide = bpe.size > 1 << 16 or struct.unpack("<I", end)[0] >= 1 << 16
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            rows = []
            for doc, place, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                data = bpe.encode(text or "") + end
                for number, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    ids = data[4 * start : 4 * (start + length)]
                    rows.append((doc, place, number, start, length, zlib.crc32(ids), bytes(ids) if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pieces(docs: DataFrame, file: str, units: str, end_id: int, capacity: int) -> DataFrame:
    """The stored pieces of ``docs`` (doc_id, text). ``place`` numbers the rows; ``ids`` are little-endian unsigned integers of 16 bits if
    the vocabulary and ``end_id`` fit them, else of 32: then ``ids`` has four bytes for each of ``length``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    layout = PIECES.format(kind=docs.schema["doc_id"].dataType.simpleString())
    schema, end = to_arrow_schema(StructType.fromDDL(layout)), struct.pack("<I", end_id)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("place"), "text")
    return stored(rows.mapInArrow(lambda x: _pieces(x, schema, file, units, end, capacity), layout), "pieces")


PLACED = "place long, piece int, length long, sequence_id long, offset long, certified boolean"


def _packer(capacity: int, number: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs the groups of round ``number``; the last round keeps every sequence."""
    return lambda table: _packed(table, capacity, number << 56, last)


def _packed(table: pa.Table, capacity: int, base: int, last: bool) -> pa.Table:
    """One group: its pieces with their places, or with a null sequence where they are given up."""
    table = table.sort_by([("length", "descending"), ("place", "ascending"), ("piece", "ascending")])
    sizes = table.column("length").to_numpy()
    where, free = best_fit_decreasing(sizes.tolist(), capacity)
    where, free = np.array(where, np.int64), np.array(free, np.int64)
    certified = len(free) == lower_bound(sizes, capacity)
    keep = np.ones(len(free), bool)
    if not last:
        keep = free <= capacity * NEARLY
        if certified:
            keep[:] = True
            keep[np.argmax(free)] = free.max() == 0
    order = np.argsort(where, kind="stable")
    ends = np.cumsum(sizes[order])
    offsets = np.empty(len(sizes), np.int64)
    first = np.searchsorted(where[order], where[order], "left")
    offsets[order] = ends - sizes[order] - np.concatenate(([0], ends))[first]
    group = table.column("group")[0].as_py()
    sequence = pa.array(2 * (base + (group << 32) + where), mask=~keep[where])
    return pa.table([table.column("place"), table.column("piece"), table.column("length"), sequence, pa.array(offsets), pa.array(np.full(len(sizes), certified))],
                    ["place", "piece", "length", "sequence_id", "offset", "certified"])


def place(cut_docs: DataFrame, capacity: int) -> DataFrame:
    """Sequence and offset of every piece of ``cut_docs`` (as ``pieces`` stores them): place, piece, sequence_id, offset, certified.

    Full pieces have odd sequence numbers. Packed ones have even numbers made of the round, the group and the sequence in it.
    """
    sized = cut_docs.select("place", "piece", "length")
    full = sized.where(F.col("length") == capacity)
    done = [full.select("place", "piece", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))]
    rest = sized.where(F.col("length") < capacity)
    left, number = rest.count(), 0
    while left:
        groups = -(-left // GROUP_ROWS)
        last = groups == 1
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("place", "piece", F.lit(number)), F.lit(groups)))
        packed = stored(dealt.groupBy("group").applyInArrow(_packer(capacity, number, last), PLACED), "packed")
        done.append(packed.where("sequence_id IS NOT NULL").select("place", "piece", "sequence_id", "offset", "certified"))
        rest = packed.where("sequence_id IS NULL").select("place", "piece", "length")
        now = 0 if last else rest.count()
        if now and (now > 0.9 * left and groups == -(-now // GROUP_ROWS) or number == 50):  # no fewer groups: what is left is packed as it stands
            dealt = rest.withColumn("group", F.pmod(F.xxhash64("place", "piece", F.lit(number + 1)), F.lit(groups)))
            packed = stored(dealt.groupBy("group").applyInArrow(_packer(capacity, number + 1, True), PLACED), "packed")
            done.append(packed.select("place", "piece", "sequence_id", "offset", "certified"))
            now = 0
        left, number = now, number + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def sequences(cut_docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Every piece with its ids and its place: doc_id, piece, start, length, ids, sequence_id, offset."""
    return cut_docs.join(placed, ["place", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "certified")


def pack(docs: DataFrame, file: str, units: str, end_id: int, capacity: int) -> DataFrame:
    """``docs`` packed into sequences of at most ``capacity`` tokens."""
    stored_pieces = pieces(docs, file, units, end_id, capacity)
    return sequences(stored_pieces, place(stored_pieces, capacity))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 1024 tokens."""
    import public_tokenizers as P

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"), "byte_level", end_id=2, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
