"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Each token of the rank file becomes a piece: its bytes are written as the printable characters of the usual byte alphabet, and its
score is its negative rank, so that the model merges in the order of ranks. Normalisation is the identity: no prefix, no white-space
handling. A text is cut into pre-tokens by the pattern, each is written in the byte alphabet and encoded; a pre-token that is itself
a token keeps its own id, whether merges reach it or not. Decoding maps each id to the bytes of its token.

``encoded``, ``decoded`` and ``digested`` work on streams of Arrow batches and can be chained in one task; ``encode`` and ``decode``
are the DataFrame forms. All are narrow: no shuffle, and a task holds a slice of a batch, its ids and a bounded memory of pre-tokens.

Edge cases. A null text counts as empty: no ids, empty bytes. Repeated rows are encoded each for itself; a null doc_id is handed on.
An empty table gives an empty result. Other columns are not read. Ids that are not in the vocabulary make ``decode`` fail.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.units import UNITS, Memory, byte_alphabet, is_plain

#: Rows that are held at once as Python texts.
STEP = 128


def ranks_of(file: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One field of a protocol-buffer message: text and bytes with their length, integers as varints, floats in four bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: an unknown piece with id 0, then the tokens by rank, so that a token's id is its place less one."""
    letters, normal, unknown, bpe = byte_alphabet(), 1, 2, 2
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    pieces = [_field(1, "▁?") + _field(2, 0.0) + _field(3, unknown)]
    pieces += [_field(1, "".join(letters[b] for b in token)) + _field(2, -float(rank)) + _field(3, normal) for token, rank in ordered]
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(45, "▁?")
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, file: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.ranks = ranks_of(file)
        self.by_place = [rank for _, rank in sorted((r, r) for r in self.ranks.values())]
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.decimals = {rank: str(rank) for rank in self.tokens}
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.ranks))
        self.letters = dict(enumerate(byte_alphabet()))
        self.split = regex.compile(pattern).findall
        self.known = Memory(self.fresh)

    def pre_token(self, token: str) -> list[int]:
        raw = token.encode()
        own = self.ranks.get(raw)
        if own is not None:
            return [own]
        return [self.by_place[i - 1] for i in self.pieces.encode(raw.decode("latin-1").translate(self.letters))]

    def fresh(self, text: str) -> bytes:
        return np.array([i for t in self.split(text) for i in self.pre_token(t)], dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if is_plain(text):
            return b"".join(map(self.known.__getitem__, UNITS["byte_level"].findall(text)))
        return self.fresh(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def model(file: str, pattern: str) -> ByteBpe:
    """One model per worker, file and pattern."""
    return ByteBpe(file, pattern)


def encoded(batches: Iterable[pa.RecordBatch], file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, ids): little-endian unsigned 32-bit integers in bytes."""
    bpe = model(file, pattern)
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            part = batch.slice(start, STEP)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.encode(x or "") for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])


def decoded(batches: Iterable[pa.RecordBatch], file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) to (doc_id, ids, bytes): the bytes that the ids stand for."""
    bpe = model(file, pattern)
    for batch in batches:
        texts = [bpe.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "bytes"])


def digested(batches: Iterable[pa.RecordBatch], file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, bytes) to (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    decimals = model(file, pattern).decimals
    for batch in batches:
        ids = [np.frombuffer(x, "<u4").tolist() for x in batch.column("ids").to_pylist()]
        written = [hashlib.sha256(",".join(map(decimals.__getitem__, x)).encode()).hexdigest() for x in ids]
        back = [hashlib.sha256(x).hexdigest() for x in batch.column("bytes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(written), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary) of every row's text."""
    return docs.select("doc_id", "text").mapInArrow(lambda x: encoded(x, file, pattern), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(ids: DataFrame, file: str, pattern: str) -> DataFrame:
    """doc_id, ids and the decoded bytes of every row."""
    return ids.select("doc_id", "ids").mapInArrow(lambda x: decoded(x, file, pattern), f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, ids binary, bytes binary")


def round_trip(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every row, encoded and decoded in one pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digested(decoded(encoded(batches, file, pattern), file, pattern), file, pattern)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded bytes."""
    import public_tokenizers as P

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
