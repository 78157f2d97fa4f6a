"""Secret scans over a trigram inverted index.

From each rule's regular expression ``trigram_query`` derives a Boolean query over trigrams that every match implies. The index is
cut by documents: a task reads a slice of rows, collects the distinct (trigram, row) pairs of their lower-cased bytes and writes one
segment, with a posting list per trigram, so the index needs no shuffle. A search reads only the trigrams that the rules name,
intersects and joins their postings per segment, and hands the candidate rows to the rules for verification. Rules whose query is
empty (no mandatory trigram) scan every text; they do so in the pass that builds the index, which has the texts at hand.

Candidates meet their texts through a join on document id and text hash. Its candidate side is broadcast only where its counted rows
stay under ``BROADCAST_ROWS``; beyond that it is a shuffled join. A match is a span of code points.

Edge cases. A null or empty text has no spans. Very long texts are scanned whole; a segment ends after ``SEGMENT_BYTES`` of text, so a
long text is a segment of its own. Rows that share a doc_id or a text each get their own spans; a null doc_id is handed on. Of spans
that start together the rules' order decides. An empty table gives an empty result. Other columns are not read; ``found`` keeps
them, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.shared import stored, unused

SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
BROADCAST_ROWS = 200_000
#: Alternatives that are kept apart while a query is derived.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        # ASCII case folding only.
        return re.compile(self.pattern, re.ASCII | re.IGNORECASE if self.any_case else 0)


#: The base rules, in the order in which equal starts are listed; then what the library adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE

# A query is a set of alternatives, each a set of trigrams that must all occur; the empty set among them says nothing.
Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])


def _either(a: Query, b: Query) -> Query:
    """a or b, without alternatives that another one implies."""
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _both(a: Query, b: Query) -> Query:
    return reduce(_either, (frozenset([x | y]) for x, y in product(a, b)), frozenset())


def _of_strings(strings: Iterable[str]) -> Query:
    """That one of the strings occurs: all trigrams of one of them, in lower case as the index has them."""
    return reduce(_either, (frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in {x.lower() for x in strings}), frozenset())


def _derive(items) -> tuple[set[str] | None, Query]:
    """For a parsed sequence: all strings that it can match (null: too many or unbounded), and a query that every match implies."""
    run: set[str] = {""}
    exact, query = True, ALL
    for op, value in items:
        name, strings, own = str(op), None, ALL
        if name == "LITERAL" and value < 128:
            strings = {chr(value)}
        elif name == "IN" and all(str(o) == "LITERAL" and v < 128 for o, v in value) and len(value) <= 8:
            strings = {chr(v) for _, v in value}
        elif name == "SUBPATTERN":
            strings, own = _derive(value[3])
        elif name == "BRANCH":
            parts = [_derive(x) for x in value[1]]
            strings = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            own = reduce(_either, ((_of_strings(p[0]) if p[0] is not None else p[1]) for p in parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, child = value
            once, own = _derive(child)
            if least == 0:
                strings, own = ({""} | once if int(most) == 1 and once is not None else None), ALL
            elif once is not None and least == int(most) and len(once) ** least <= MOST_STRINGS:
                strings = {"".join(x) for x in product(once, repeat=least)}
            elif once is not None:  # at least one of them follows what came before, then the run ends
                own = _of_strings(a + b for a in run for b in once) if len(run) * len(once) <= MOST_STRINGS else _of_strings(once)
        elif name == "AT":
            strings = {""}
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query = _both(_both(query, _of_strings(run)), own if strings is None else _of_strings(strings))
        run, exact = {""}, False
    return (run, _of_strings(run)) if exact else (None, _both(query, _of_strings(run)))


def trigram_query(rule: Rule) -> Query:
    """Trigrams, in lower case, that every match of the rule implies; ``ALL`` if none is mandatory."""
    from re import _parser

    query = _derive(_parser.parse(rule.pattern))[1]
    return ALL if frozenset() in query else query


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


def spans(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, without those that are too short."""
    return [m.span() for m in pattern.finditer(text) if len(m.group(rule.group)) >= rule.least]


def _found(rules: tuple[Rule, ...], text: str) -> str:
    """kind:start:end of every match of ``rules``, comma-joined in their order."""
    return ",".join(f"{r.kind}:{a}:{b}" for r in rules for a, b in spans(r, r.compiled(), text))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def postings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of the texts, where each one's list starts (and the end of the last), and the lists: rows as gaps."""
    data = _FOLD[np.frombuffer(b"\n".join(texts), np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    if len(data) < 3:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.uint16)
    codes = data[:-2].astype(np.uint64) << np.uint64(16) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:].astype(np.uint64)
    rows = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(ends, prepend=0))[: len(codes)]
    pairs = np.sort(codes << np.uint64(16) | rows)  # trigrams over a text's end name rows that verification refuses
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
    codes, rows = (pairs >> np.uint64(16)).astype(np.int32), (pairs & np.uint64(0xFFFF)).astype(np.int32)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    gaps = np.diff(rows, prepend=0)
    gaps[first] = rows[first]
    return codes[first], np.append(first, len(codes)), gaps.astype(np.uint16)


#: doc rows: segment, row, doc_id, text_hash, spans. list rows: segment, trigram, rows (16-bit gaps).
INDEX = "part string, segment string, row int, doc_id {kind}, text_hash long, spans string, trigram int, rows binary"


def _segments(batches: Iterable[pa.RecordBatch], schema: pa.Schema, scanning: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    patterns = [(r, r.compiled()) for r in scanning]
    made = 0

    def filled(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, None) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def segment(ids: pa.Array, hashes: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        nonlocal made
        name = f"{TaskContext.get().partitionId()}-{made}"
        made += 1
        n = len(texts)
        hits = [",".join(f"{r.kind}:{a}:{b}" for r, p in patterns for a, b in spans(r, p, t)) for t in texts]
        yield filled(n, part=pa.array(["doc"] * n), segment=pa.array([name] * n), row=pa.array(range(n), pa.int32()), doc_id=ids, text_hash=hashes, spans=pa.array(hits))
        codes, starts, gaps = postings([t.encode() for t in texts])
        k = len(codes)
        lists = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((2 * starts).astype(np.int32)), pa.py_buffer(gaps)])
        for at in range(0, k, 10_000):
            m = min(10_000, k - at)
            yield filled(m, part=pa.array(["list"] * m), segment=pa.array([name] * m), trigram=pa.array(codes[at : at + m]), rows=pa.concat_arrays([lists.slice(at, m)]))

    for batch in batches:
        lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(2)])
        start = 0
        while start < batch.num_rows:
            total = np.cumsum(lengths[start : start + SEGMENT_ROWS])
            n = max(1, int(np.searchsorted(total, SEGMENT_BYTES, "right")))
            part = batch.slice(start, n)
            yield from segment(part.column(0), part.column(1), [x or "" for x in part.column(2).to_pylist()])
            start += n


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """The index of ``docs`` (doc_id, text), written to the shared folder: its rows, with the spans of the rules that scan, and its lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from vacantia.llm.shared import folder

    scanning = tuple(r for r in rules if trigram_query(r) == ALL)
    layout = INDEX.format(kind=docs.schema["doc_id"].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(layout))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    path = folder(docs.sparkSession, "trigram-index")
    rows.mapInArrow(lambda x: _segments(x, schema, scanning), layout).write.partitionBy("part").option("compression", "zstd").parquet(path)
    read = docs.sparkSession.read.schema(layout).parquet(path)
    return (
        read.where("part = 'doc'").select("segment", "row", "doc_id", "text_hash", "spans"),
        read.where("part = 'list'").select("segment", "trigram", "rows"),
    )


def _matches(queries: list[Query], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment (trigrams and their lists): the rows that any query admits."""
    for batch in batches:
        out: list[tuple[str, int]] = []
        for segment, trigrams, lists in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held = {t: np.cumsum(np.frombuffer(x, np.uint16), dtype=np.int64) for t, x in zip(trigrams, lists, strict=True)}
            none = np.zeros(0, np.int64)
            rows = none
            for query in queries:
                for need in query:
                    rows = np.union1d(rows, reduce(np.intersect1d, (held.get(_code(t), none) for t in sorted(need))))
            out += [(segment, int(r)) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), pa.array([r for _, r in out], pa.int32())], ["segment", "row"])


def candidates(docs: DataFrame, lists: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and text_hash of the rows that the trigram queries admit, each pair once."""
    queries = [q for q in map(trigram_query, rules) if q != ALL]
    wanted = sorted({_code(t) for q in queries for need in q for t in need})
    # A segment has one list per trigram, so a group is bounded by the rules and the segment size.
    groups = lists.where(F.col("trigram").isin(wanted)).groupBy("segment").agg(F.collect_list("trigram").alias("trigrams"), F.collect_list("rows").alias("lists"))
    rows = groups.mapInArrow(lambda x: _matches(queries, x), "segment string, row int")
    return rows.join(docs, ["segment", "row"]).select("doc_id", "text_hash").distinct()


def _verified(batches: Iterable[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_found(rules, x or "") for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["doc_id", "text_hash", "more"])


def _ordered(spans_list: str, kinds: dict[str, int]) -> list[str]:
    keyed = [(int(s.split(":")[1]), kinds[s.split(":")[0]], s) for s in spans_list.split(",") if s]
    return [s for _, _, s in sorted(keyed)]


def _reported(batches: Iterable[pa.RecordBatch], rules: tuple[Rule, ...], base: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    kinds, own = {r.kind: i for i, r in enumerate(rules)}, [r.kind for r in base]
    for batch in batches:
        rows = [_ordered(f"{a or ''},{b or ''}", kinds) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        first = [[s for s in r if s.split(":")[0] in own] for r in rows]
        counts = [pa.array([sum(s.startswith(f"{k}:") for s in r) for r in first], pa.int64()) for k in own]
        digest = pa.array([hashlib.sha256(",".join(r).encode()).hexdigest() for r in first])
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([",".join(r) for r in rows], pa.string())], [batch.schema.names[0], *(f"n_{k}" for k in own), "base_sha256", "spans"])


def _both_passes(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, text_hash, spans of the scanning rules and ``more`` of the verified ones, per row of ``docs`` (doc_id, text)."""
    rows, lists = build_index(docs, rules)
    wanted = stored(candidates(rows, lists, rules), "secret-candidates")
    small = wanted.count() <= BROADCAST_ROWS
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").alias("d")
    side = (F.broadcast(wanted) if small else wanted).alias("w")
    texts = keyed.join(side, (F.col("d.text_hash") == F.col("w.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    kind = docs.schema["doc_id"].dataType.simpleString()
    verifying = tuple(r for r in rules if trigram_query(r) != ALL)
    more = texts.mapInArrow(lambda x: _verified(x, verifying), f"doc_id {kind}, text_hash long, more string")
    more = more.where("more <> ''").distinct()  # rows with the same text
    a, b = rows.alias("a"), more.alias("b")
    both = a.join(b, (F.col("a.text_hash") == F.col("b.text_hash")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    return both.select("a.doc_id", "a.text_hash", "a.spans", "b.more")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Per row of ``docs``: doc_id, spans per base kind, the digest of the base spans, and all spans (kind:start:end by start)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {kind}, " + "".join(f"n_{r.kind} long, " for r in base) + "base_sha256 string, spans string"
    return _both_passes(docs, rules).select("doc_id", "spans", "more").mapInArrow(lambda x: _reported(x, rules, base), layout)


def _spans_of(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, text_hash and all spans by start of the rows that have any, each pair once."""
    kinds = {r.kind: i for i, r in enumerate(rules)}

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [",".join(_ordered(f"{a or ''},{b or ''}", kinds)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.string())], ["doc_id", "text_hash", "spans"])

    hit = _both_passes(docs, rules).where("spans <> '' OR more <> ''")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return hit.mapInArrow(joined, f"doc_id {kind}, text_hash long, spans string").distinct()


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with each secret replaced by ``[kind]`` (of overlapping ones the first), and ``n_chars``, where there is
    such a column, of the new text. All rows and columns stay; texts without secrets are untouched."""
    key, mark = unused(docs.columns, "key_hash"), unused(docs.columns, "found_spans")
    hits = stored(_spans_of(docs.select("doc_id", "text"), rules), "secret-spans").toDF("hit_id", "hit_hash", mark)
    side = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    joined = docs.withColumn(key, F.xxhash64("text")).join(side, (F.col(key) == side["hit_hash"]) & F.col("doc_id").eqNullSafe(side["hit_id"]), "left")
    text = F.col("text")

    def swap(done, span):
        parts = F.split(span, ":")
        start, stop = parts[1].cast("int"), parts[2].cast("int")
        put = F.concat(done["out"], F.substr(text, done["at"] + 1, start - done["at"]), F.lit("["), parts[0], F.lit("]"))
        return F.struct(F.when(start >= done["at"], put).otherwise(done["out"]).alias("out"), F.greatest(done["at"], stop).alias("at"))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    swapped = F.aggregate(F.split(mark, ","), begin, swap, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1)))
    # A column of its own: beside a new "text", the length would be taken of what the aggregation makes of that new text.
    made = unused(docs.columns, "redacted_text")
    joined = joined.withColumn(made, F.when(F.col(mark).isNotNull(), swapped).otherwise(text))
    columns = {"text": F.col(made)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(mark).isNotNull(), F.length(made).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
