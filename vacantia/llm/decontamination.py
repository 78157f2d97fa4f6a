"""Benchmark decontamination by a distributed positional inverted index.

The training side is indexed once. A task cuts its documents into shards of about ``SHARD_WORDS`` words; a shard stores, for every
term (a word's 64-bit hash), the rising list of its positions in the shard, and where each document starts. Shards are rows of a table
in the shared folder; no token is shuffled, and a document lies in one shard.

The test side becomes phrases: every ``width`` words in a row of an item, each distinct phrase once, beside a table of the items that
hold it. Phrases meet the index in blocks of about ``BLOCK`` phrases, each handed to the workers as arrays. In a shard a phrase whose
rarest term is absent is out at once; else the rarest term's positions, less that term's place in the phrase, are the candidate starts,
and they are intersected with the lists of the other terms, adjusted by their places, from the rarer to the more frequent. What is left
is every exact occurrence. With ``within`` a phrase matches by proximity: around each position of its rarest term, the first stretch
of so many words of the document that holds all its words, in any order.

Words are runs of letters and digits of ASCII and of all other characters beyond ASCII, A-Z taken as a-z. Equal words have equal
hashes; unequal ones differ but for a chance of 2**-64.

Edge cases. A document that is null or has no words is returned with zeros; a text of any length is indexed whole, in a shard of its
own if it is long. A document without doc_id, or rows that share one, are documents of their own. An item that is null, without words
or without item_id takes no part; rows that share an item_id are one item. An item of fewer words than ``width`` is one phrase. Without
items no document is hit; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.shared import folder, stored
from vacantia.llm.words import word_hashes

#: Words of a shard, phrases that are looked up at once, and candidate starts that are held at once.
SHARD_WORDS, BLOCK, SLICE = 1 << 20, 100_000, 1 << 20
#: Rows of the phrase-to-item table up to which it is broadcast.
BROADCAST_ROWS = 200_000

_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
SHARD = "shard string, doc_ids array<long>, lengths array<long>, terms binary, ends binary, places binary"


def _words(text: pa.Scalar) -> np.ndarray:
    return word_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", _BETWEEN)


def _shard(name: str, doc_ids: list, texts: list[np.ndarray]) -> pa.RecordBatch:
    words = np.concatenate(texts)
    order = np.argsort(words, kind="stable")
    in_order = words[order]
    last = np.flatnonzero(np.append(in_order[1:] != in_order[:-1], True)) if len(words) else np.zeros(0, np.int64)
    columns = [
        pa.array([name]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
        *(pa.array([x.tobytes()], pa.binary()) for x in (in_order[last], (last + 1).astype(np.uint32), order.astype(np.uint32))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "doc_ids", "lengths", "terms", "ends", "places"])


def _shards(batches: Iterable[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    from uuid import uuid4

    ids: list = []
    texts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(_words(text))
            size += len(texts[-1])
            if size >= shard_words:
                yield _shard(uuid4().hex, ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield _shard(uuid4().hex, ids, texts)


def index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), stored: one row per shard. The rows of a shard are written once, so its name is fixed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    path = folder(spark, "index")
    # A shard is a row of several MB, so the writer looks at its size after every row.
    write = rows.mapInArrow(lambda x: _shards(x, shard_words), SHARD).write.option("parquet.block.size", 32 << 20)
    write.option("parquet.block.size.row.check.min", 1).option("parquet.page.size.row.check.min", 1).parquet(path)
    return spark.read.schema(SHARD).parquet(path)


def _phrases(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, terms = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = _words(text)
            windows = {words[i : i + width].tobytes() for i in range(max(1, len(words) - width + 1))} if len(words) else ()
            ids += [item] * len(windows)
            terms += windows
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.binary())], ["item_id", "terms"])


def phrases(items: DataFrame, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """Stored tables of the distinct phrases (phrase, terms) of ``items`` (item_id, text), and of (phrase, item_id)."""
    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows = stored(rows.mapInArrow(lambda x: _phrases(x, width), "item_id string, terms binary"), "item-phrases").distinct()
    numbered = stored(rows.select("terms").distinct().select(F.monotonically_increasing_id().alias("phrase"), "terms"), "phrases")
    return numbered, stored(rows.join(numbered, "terms").select("phrase", "item_id"), "phrase-items")


class Block:
    """A block of phrases as arrays: vocabulary, and per phrase its terms as places in the vocabulary."""

    def __init__(self, names: np.ndarray, terms: list[bytes]) -> None:
        self.names = names
        self.lengths = np.array([len(t) // 8 for t in terms], np.int64)
        self.firsts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)
        self.vocabulary, self.flat = np.unique(np.frombuffer(b"".join(terms), np.uint64), return_inverse=True)

    def found(self, shard: Shard, within: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the phrase, start and end of every match in the shard."""
        nothing = (np.zeros(0, np.int64),) * 3
        if not len(shard.terms) or not len(self.names):
            return nothing
        at = np.minimum(np.searchsorted(shard.terms, self.vocabulary), len(shard.terms) - 1)
        count = np.where(shard.terms[at] == self.vocabulary, shard.ends[at] - shard.firsts[at], 0)[self.flat]
        least = np.minimum.reduceat(count, self.firsts)
        alive = np.flatnonzero(least)
        # Places of a phrase's terms, the rarest in this shard first.
        order = np.lexsort((count, np.repeat(np.arange(len(self.names)), self.lengths)))
        out = []
        for part in np.split(alive, np.unique(np.searchsorted(np.cumsum(least[alive] * (within or 1)), np.arange(SLICE, int(least[alive].sum()) * (within or 1), SLICE)))):
            if len(part):
                out.append(self._part(shard, part, order, at, within))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else nothing

    def _part(self, shard: Shard, part: np.ndarray, order: np.ndarray, at: np.ndarray, within: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rarest = order[self.firsts[part]]
        term = at[self.flat[rarest]]
        size = shard.ends[term] - shard.firsts[term]
        phrase = np.repeat(part, size)
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = shard.places[np.repeat(shard.firsts[term], size) + nth]
        doc = shard.doc_of(place)
        if within is None:
            start = place - np.repeat(rarest - self.firsts[part], size)
            stop = start + self.lengths[phrase]
            keep = (start >= shard.starts[doc]) & (stop <= shard.stops[doc])
        else:
            phrase, place, doc = (np.repeat(x, within) for x in (phrase, place, doc))
            start = np.maximum(place - np.tile(np.arange(within)[::-1], len(place) // within), shard.starts[doc])
            stop = np.minimum(start + within, shard.stops[doc])
            keep = np.ones(len(place), bool)
        for turn in range(1, int(self.lengths[part].max())):
            phrase, place, start, stop = (x[keep] for x in ((phrase, place, start, stop)))
            more = self.lengths[phrase] > turn
            entry = order[self.firsts[phrase] + np.minimum(turn, self.lengths[phrase] - 1)]
            low = start + (entry - self.firsts[phrase] if within is None else 0)
            keep = ~more | shard.holds(at[self.flat[entry]], low, low + 1 if within is None else stop)
        phrase, place, start, stop = (x[keep] for x in ((phrase, place, start, stop)))
        if within is not None and len(phrase):  # the first stretch around each place
            first = np.append(True, (phrase[1:] != phrase[:-1]) | (place[1:] != place[:-1]))
            phrase, start, stop = phrase[first], start[first], stop[first]
        return phrase, start, stop


class Shard:
    """A row of the index as arrays."""

    def __init__(self, row: dict) -> None:
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.ends = np.frombuffer(row["ends"], np.uint32).astype(np.int64)
        self.firsts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.places = np.frombuffer(row["places"], np.uint32).astype(np.int64)
        self.size = len(self.places)
        #: Term and position as one rising number, so that all lists are searched at once.
        self.keys = np.repeat(np.arange(len(self.terms)), self.ends - self.firsts) * (self.size + 1) + self.places
        lengths = np.array(row["lengths"], np.int64)
        self.stops = np.cumsum(lengths)
        self.starts = self.stops - lengths

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.stops, places, "right")

    def holds(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term stands at a position from ``low`` to below ``high``."""
        base = terms * (self.size + 1)
        found = np.searchsorted(self.keys, base + low)
        return np.append(self.keys, np.iinfo(np.int64).max)[found] < base + high


def _matches(batches: Iterable[pa.RecordBatch], block, within: int | None) -> Iterator[pa.RecordBatch]:
    names = ["shard", "place", "spans", "phrases"]
    for batch in batches:
        for number in range(batch.num_rows):
            row = batch.slice(number, 1).to_pylist()[0]
            shard = Shard(row)
            phrase, start, stop = block.value.found(shard, within)
            if not len(phrase):
                continue
            order = np.lexsort((stop, start))
            phrase, start, stop = phrase[order], start[order], stop[order]
            doc = shard.doc_of(start)
            # Spans that meet or overlap within a document are one; of a document's phrases each counts once.
            reach = np.maximum.accumulate(stop)
            new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))
            lasts = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
            docs, at = np.unique(doc[new], return_index=True)
            spans = pa.StructArray.from_arrays([pa.array(start[new] - shard.starts[doc[new]]), pa.array(reach[lasts] - shard.starts[doc[new]])], ["start", "stop"])
            pairs = np.unique(np.stack([doc, phrase]), axis=1)
            first = np.searchsorted(pairs[0], docs)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["shard"]] * len(docs)), pa.array(docs),
                pa.ListArray.from_arrays(pa.array(np.append(at, len(spans)).astype(np.int32)), spans),
                pa.ListArray.from_arrays(pa.array(np.append(first, pairs.shape[1]).astype(np.int32)), pa.array(block.value.names[pairs[1]])),
            ], names)


def matches(indexed: DataFrame, numbered: DataFrame, within: int | None = None) -> DataFrame:
    """Documents (shard, place in it) with the spans (start, stop in words, merged per block) and phrases of their matches, stored.

    Without ``within`` phrases match as they stand, else within so many words in any order.
    """
    spark = indexed.sparkSession
    schema = "shard string, place long, spans array<struct<start: long, stop: long>>, phrases array<long>"
    blocks = max(1, -(-numbered.count() // BLOCK))
    out = spark.createDataFrame([], schema)
    for number in range(blocks):
        # A block is a bounded share of the phrases, whatever their number.
        block = numbered.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == number).toArrow()
        handed = spark.sparkContext.broadcast(Block(block.column("phrase").to_numpy(), block.column("terms").to_pylist()))
        part = indexed.mapInArrow(lambda x, handed=handed: _matches(x, handed, within), schema)
        out = out.unionByName(stored(part, "matches"))
        handed.unpersist()
    return out


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit (words in an occurrence of a phrase of ``items``), n_items, items_sha256
    (of the item_ids, sorted as strings and joined by commas) and contaminated."""
    indexed = index(docs)
    numbered, holders = phrases(items, width)
    found = matches(indexed, numbered)
    rows = indexed.select("shard", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("place", "d")).select("shard", F.col("place").cast("long").alias("place"), F.col("d.doc_ids").alias("doc_id"), F.col("d.lengths").alias("n_words"))
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("upto"))
    covered = F.aggregate(spans, start, lambda a, s: F.struct(
        (a["total"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["upto"]))).alias("total"), F.greatest(a["upto"], s["stop"]).alias("upto")))["total"]
    hit = found.groupBy("shard", "place").agg(covered.alias("n_hit"))
    small = holders.count() <= BROADCAST_ROWS
    pairs = found.select("shard", "place", F.explode("phrases").alias("phrase")).join(F.broadcast(holders) if small else holders, "phrase")
    listed = F.sort_array(F.collect_set("item_id"))
    held = pairs.groupBy("shard", "place").agg(F.size(listed).cast("long").alias("n_items"), F.array_join(listed, ",").alias("items"))
    rows = rows.join(hit, ["shard", "place"], "left").join(held, ["shard", "place"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the ten-word phrases of all benchmark items."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle(docs: str = "documents", items: str = "benchmark", width: int = 10) -> str:
    """DuckDB text of ``op11_decontamination``."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM {docs}),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM {items} WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda k: w[k:k + {width - 1}])) AS phrase FROM i WHERE len(w) > 0),
n AS (SELECT DISTINCT len(phrase) AS n FROM p),
s AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n),
m AS (SELECT r, n, k, item FROM s JOIN p ON w[k:k + n - 1] = phrase),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
