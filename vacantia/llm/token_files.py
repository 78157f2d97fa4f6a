"""Token-id files: one id array per shard, with Elias-Fano coded document boundaries.

A shard is a range of documents in ascending doc_id order. ``<shard>.ids`` holds the ids of its documents in a row, as little-endian
unsigned integers of 16 bits if the vocabulary fits them, else of 32. ``<shard>.ef`` holds a header and two Elias-Fano sequences: the token counts before each document (and the
total), and the document ids. A sequence of n values below u takes about n * (2 + log2(u / n)) bits, and half a bit for the places of
every 128th set bit, which the file holds too. ``select`` reads one value from there; writer and reader never hold a table of offsets.

``write`` range-partitions the documents, encodes each range in a task and writes its two files under a name of that task's own; only
the files that the manifest names count, so a task that is lost or run twice leaves no trace in the result. The manifest has one row
per shard, and the tokens before each shard are a running sum over those rows alone. ``read`` opens each shard in a task and yields
its documents; files are reached through the file system of their URI, never through a local path.

Edge cases. A null text counts as empty and gets the end id alone. A null doc_id sorts first and is kept as null. Rows that share a
doc_id keep the order of the input and are documents of their own; a doc_id that very many rows share is split over shards.
Documents of any length are written as they are. An empty table gives an empty manifest and no documents. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.llm.shared import folder, stored
from vacantia.llm.units import encoder

MAGIC, SAMPLE, HEAD = b"TOKSHRD3", 128, struct.Struct("<8sBQQq")
#: Bytes of ids that a reader holds at once.
CHUNK = 4 << 20
#: Values that are coded at once: whole bytes of low bits, whole steps of samples.
SLICE = 8_192


class EliasFano:
    """A sequence of non-negative integers that never falls: low bits, upper bits in unary, and the place of every ``SAMPLE``-th value."""

    HEAD = struct.Struct("<QBQQ")

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, n: int, top: int, slices: Iterable[np.ndarray]) -> EliasFano:
        """``n`` values, the last being ``top``, given in slices of ``SLICE`` (the last may be shorter)."""
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        high, low, samples, done = np.zeros((n + (top >> bits) + 7) // 8 if n else 0, np.uint8), [], [np.zeros(0, np.uint64)], 0
        for values in slices:
            values = values.astype(np.uint64)
            places = (values >> np.uint64(bits)) + np.arange(done, done + len(values), dtype=np.uint64)
            np.bitwise_or.at(high, places >> np.uint64(3), np.left_shift(1, (places & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
            samples.append(places[::SAMPLE])
            cells = (values[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
            low.append(np.packbits(cells.ravel(), bitorder="little").tobytes())
            done += len(values)
        return cls(n, bits, b"".join(low), high.tobytes(), np.concatenate(samples).astype("<u8"))

    def dumps(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.samples.tobytes() + self.low + self.high

    @classmethod
    def loads(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that starts at ``at``, and where it ends."""
        n, bits, a, b = cls.HEAD.unpack_from(data, at)
        samples = np.frombuffer(data, "<u8", -(-n // SAMPLE), at + cls.HEAD.size)
        at += cls.HEAD.size + samples.nbytes
        return cls(n, bits, data[at : at + a], data[at + a : at + a + b], samples), at + a + b

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, bytes of the upper part are counted until the i-th set bit."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place // 8
        byte = self.high[at] >> (place % 8) << (place % 8)
        while left >= (ones := byte.bit_count()):
            left -= ones
            at += 1
            byte = self.high[at]
        for _ in range(left):
            byte &= byte - 1
        upper = at * 8 + (byte & -byte).bit_length() - 1 - i
        start = i * self.low_bits
        word = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8], "little") >> start % 8
        return upper << self.low_bits | word & ((1 << self.low_bits) - 1)


def _rising(steps: array, first: int) -> Iterator[np.ndarray]:
    """``first``, and the running sums of ``steps`` from there, in slices."""
    parts, last = np.frombuffer(steps, f"u{steps.itemsize}"), first
    for at in range(0, len(steps) + 1, SLICE):
        # The value before the slice stands in front, but for the first slice, which begins with it.
        sums = np.uint64(last) + np.concatenate((np.zeros(1, np.uint64), np.cumsum(parts[max(0, at - 1) : at + SLICE - 1], dtype=np.uint64)))
        yield sums[1:] if at else sums
        last = int(sums[-1])


MANIFEST = "shard string, first_doc long, first_place long, n_docs long, n_tokens long"


def _write_shard(root: str, batches: Iterable[pa.RecordBatch], encode: Callable[[str], bytes], end: bytes, width: int) -> Iterator[pa.RecordBatch]:
    """The rows (doc_id, place, text) of one task, in order, as one shard; yields its manifest row, or nothing for no rows."""
    store, base = fs.FileSystem.from_uri(root)
    # Lengths, and the steps from one doc_id to the next: what the two sequences are built from.
    name, first, lengths, steps, total, nameless, least, last, out = uuid.uuid4().hex, None, array("I"), array("Q"), 0, 0, 0, None, None
    for batch in batches:
        if out is None and batch.num_rows:
            out = store.open_output_stream(f"{base}/{name}.ids")
            first = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
        for doc, text in zip(batch.column(0), batch.column(2), strict=True):
            data = encode(text.as_py() or "") + end
            out.write(data if width == 4 else np.frombuffer(data, "<u4").astype("<u2").tobytes())
            lengths.append(len(data) // 4)
            total += lengths[-1]
            if (doc := doc.as_py()) is None:
                nameless += 1
            else:
                if last is None:
                    least = doc
                else:
                    steps.append(doc - last)
                last = doc
    if out is None:
        return
    out.close()
    n_docs = len(lengths)
    with store.open_output_stream(f"{base}/{name}.ef") as index:
        index.write(HEAD.pack(MAGIC, width, n_docs, nameless, least))
        index.write(EliasFano.build(n_docs + 1, total, _rising(lengths, 0)).dumps())
        index.write(EliasFano.build(n_docs - nameless, (last or 0) - least, _rising(steps, 0) if n_docs > nameless else ()).dumps())
    yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([v], pa.int64()) for v in (*first, n_docs, total))], names=["shard", "first_doc", "first_place", "n_docs", "n_tokens"])


class Shard:
    """A shard's boundaries and document ids, and its id file opened for reading."""

    def __init__(self, root: str, name: str) -> None:
        store, base = fs.FileSystem.from_uri(root)
        with store.open_input_stream(f"{base}/{name}.ef") as f:
            data = f.read()
        magic, self.width, self.n_docs, self.nameless, self.least = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError(f"{name} is not a shard")
        self.bounds, at = EliasFano.loads(data, HEAD.size)
        self.ids, _ = EliasFano.loads(data, at)
        self.file = store.open_input_file(f"{base}/{name}.ids")

    def span(self, i: int) -> tuple[int, int]:
        """First token of document i, and the one after its last."""
        return self.bounds.select(i), self.bounds.select(i + 1)

    def tokens(self, i: int) -> np.ndarray:
        """The ids of document i."""
        start, stop = self.span(i)
        return np.frombuffer(self.file.read_at(self.width * (stop - start), self.width * start), f"<u{self.width}").astype("<u4")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nameless else self.ids.select(i - self.nameless) + self.least

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[bytes]]]:
        """Per document: doc_id, first token, and its ids in pieces of 32-bit integers. Files are read in order, ``CHUNK`` bytes at most at once."""
        held, at = b"", 0

        def pieces(start: int, stop: int) -> Iterator[bytes]:
            nonlocal held, at
            while start < stop:
                if not at <= start < at + len(held):
                    held, at = self.file.read_at(CHUNK, start), start
                part = held[start - at : stop - at]
                yield part if self.width == 4 else np.frombuffer(part, "<u2").astype("<u4").tobytes()
                start = min(stop, at + len(held))

        for i in range(self.n_docs):
            start, stop = self.span(i)
            yield self.doc_id(i), start, pieces(self.width * start, self.width * stop)


def write(docs: DataFrame, root: str, file: str, units: str, end_id: int) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into shards under ``root``; returns the manifest with the tokens before each shard."""
    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    end = struct.pack("<I", end_id)

    def shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file, units)
        return _write_shard(root, batches, encode.encode, end, 2 if encode.size <= 1 << 16 and end_id < 1 << 16 else 4)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"), "text")
    ranged = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    manifest = stored(ranged.mapInArrow(shard, MANIFEST), "token-manifest")
    # One row per shard: the running sum is over file names and counts alone.
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "first_place").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _digests(root: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: list[list] = [[], [], [], []]
            for doc, start, pieces in Shard(root, shard).documents():
                crc = n = 0
                for piece in pieces:
                    crc, n = zlib.crc32(piece, crc), n + len(piece) // 4
                for column, value in zip(rows, (doc, base + start, n, crc), strict=True):
                    column.append(value)
                if len(rows[0]) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names)
                    rows = [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names)


def read_digests(manifest: DataFrame, root: str) -> DataFrame:
    """Per document, from the files: doc_id, start (tokens before it), n_tokens, and the crc32 of its ids."""
    return manifest.select("shard", "start").repartition(max(1, manifest.count())).mapInArrow(
        lambda x: _digests(root, x), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files and read back."""
    import public_tokenizers as P

    root = folder(spark, "token-files")
    manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), root, P.path("word_bpe_49k.json"), "words", end_id=1)
    return read_digests(manifest, root)
