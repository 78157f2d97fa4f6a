"""Grouping of spelling variants by a bit-sliced position index.

The vocabulary is counted first: words and their occurrences. Two words are near if one inserted, deleted or replaced code point makes
one of the other. A near pair has a shorter word, of m code points (either, if they are equally long), and a first place, from 0 to m,
where the two differ; before it, and after it but for the edit, they are the same. The places are cut into ``WINDOWS`` windows; a word
is entered for each window under what stands before and after it, once as the shorter word and once as the longer one. So each near
pair meets in one group, that of the window of its first difference, and nowhere else. A group of more than ``GROUP`` words has its
window halved, and again, until it is small or its window is one place; then it can hold no more words than the alphabet and its square.

In a group the search is word-parallel. Per position and letter a bitset tells which words of a block of the vocabulary have that
letter there. For every word of m code points the recurrence keeps, place by place, the set of words with no error so far, and two sets
with one error: aligned (a letter replaced) and shifted by one position (a letter inserted); they take in those of the first set that
differ first at a place of the window. A deletion is an insertion seen from the other word. Small groups share blocks of ``ROWS`` words.

Edge cases. A null text has no words; a row without doc_id counts with an empty id in the deletion rule of ``counted``; texts and words
may have any length; repeated rows count again. Without words that occur twice the result is empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOWS, GROUP, ROWS = 3, 2_048, 512
#: Rows of one call of the search, about, and rows of a table up to which it is broadcast.
CALL_ROWS, BROADCAST_ROWS = 16_384, 100_000
#: Machine words of a bitset matrix (words that search x machine words of the block).
CELLS = 1 << 16


def counted(docs: DataFrame, least: int = 7, twice: int = 2, every: int = 31) -> DataFrame:
    """Words of at least ``least`` code points that occur ``twice`` times or more in ``docs`` (doc_id, text), and how often: word, n.

    Where ``every`` divides the crc32 of ``<doc_id>:<word>``, that occurrence loses one code point (a planted misspelling).
    """
    # Only runs of the least length can give such words; a run is maximal, so nothing shorter matches within a longer one.
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"([a-zÀ-ÿ]{{{least},}}+)"), F.lit(1))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = F.expr("concat(substr(run, 1, cast(h % length(run) as int)), substr(run, cast(h % length(run) as int) + 2))")
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, s, t) with the hash of what a word has outside the window from place s to before t."""
    before, after = F.expr("substr(word, 1, s)"), F.expr("substr(word, length(word) - (m - t) + 1)")
    return rows.withColumn("key", F.xxhash64("m", "s", "t", before, after))


def _entries(words: DataFrame, least: int) -> DataFrame:
    """(word, n, m, s, t, key): every word for each window, as the shorter word (m is its length) and as the longer one (m + 1 is)."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where(F.col("m") >= least)
    part = F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1)))
    rows = rows.withColumn("p", part).select(
        "word", "n", "m", F.expr(f"cast(m * p div {WINDOWS} as int)").alias("s"), F.expr(f"cast(m * (p + 1) div {WINDOWS} as int)").alias("t"))
    return _keyed(rows)


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _groups(words: DataFrame, least: int, group: int) -> DataFrame:
    """The entries of ``words``, those of large groups under halved windows."""
    level, settled = _entries(words, least), None
    while True:
        hot = stored(level.groupBy("m", "s", "t", "key").count().where((F.col("count") > group) & (F.col("t") - F.col("s") > 1)).drop("count"), "hot-keys")
        if hot.isEmpty():
            return level if settled is None else settled.unionByName(level)
        keys = ["m", "s", "t", "key"]
        small = level.join(_bounded(hot), keys, "left_anti")
        settled = small if settled is None else settled.unionByName(small)
        half = F.expr("cast((s + t) div 2 as int)")
        halves = F.explode(F.array(F.struct(F.col("s"), half.alias("t")), F.struct(half.alias("s"), F.col("t"))))
        large = level.join(_bounded(hot), keys, "left_semi").select("word", "n", "m", halves.alias("w")).select("word", "n", "m", "w.s", "w.t")
        level = stored(_keyed(large), "halved")


def near_pairs(codes: np.ndarray, lengths: np.ndarray, s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of rows that are one edit apart and differ first in the window from ``s`` to before ``t``.

    ``codes`` has a row of letters per word, of m + 1 places, padded with -1; x has length m, y length m or m + 1, which ``lengths``
    tells. A pair of words of length m is found from both sides.
    """
    m = codes.shape[1] - 1
    n = len(codes)
    machine = -(-n // 64)

    def bits(flags: np.ndarray) -> np.ndarray:
        """Flags (..., n) as bitsets of whole machine words."""
        packed = np.packbits(flags, axis=-1, bitorder="little")
        out = np.zeros((*packed.shape[:-1], machine * 8), np.uint8)
        out[..., : packed.shape[-1]] = packed
        return out.view("<u8")

    letters, at = np.unique(codes, return_inverse=True)
    at = at.reshape(codes.shape)
    index = [bits(at[:, j] == np.arange(len(letters))[:, None]) for j in range(m + 1)]
    equal, longer = bits(lengths == m), bits(lengths == m + 1)
    found: list[list[np.ndarray]] = [[], []]
    short = np.flatnonzero(lengths == m)
    step = max(1, CELLS // machine)
    for first in range(0, len(short), step):
        rows = short[first : first + step]
        query = at[rows]
        none = np.repeat((equal | longer)[None], len(rows), axis=0)
        replaced, inserted = np.zeros_like(none), np.zeros_like(none)
        for j in range(m):
            here, shifted = index[j][query[:, j]], index[j + 1][query[:, j]]
            replaced &= here
            if s <= j < t:
                differs = none & ~here
                replaced |= differs
                inserted |= differs
            inserted &= shifted
            none &= here
        if t == m:
            inserted |= none
        near = (replaced & equal) | (inserted & longer)
        row, cell = np.nonzero(near)
        flags = np.unpackbits(near[row, cell].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(flags)
        found[0].append(rows[row[which]])
        found[1].append(cell[which] * 64 + bit)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, a row each, padded with -1."""
    out = np.full((len(words), width), -1, np.int32)
    lengths = np.array([len(w) for w in words], np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _blocks(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows, sorted by key, that hold whole groups: about ``ROWS`` rows, or one group of more."""
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    first = last = 0
    for end in ends.tolist():
        if end - first > ROWS and last > first:
            yield first, last
            first = last
        last = end
    if last > first:
        yield first, last


def _search(table: pa.Table) -> pa.Table:
    """Entries (word, n, m, s, t, key) of one window to (word, near, form_n, form): the near words found here, and the best of them."""
    m, s, t = (table.column(c)[0].as_py() for c in ("m", "s", "t"))
    keys = table.column("key").to_numpy()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    # A word alone in its group has no partner there.
    alone = np.append(True, keys[1:] != keys[:-1]) & np.append(keys[1:] != keys[:-1], True)
    order, keys = order[~alone], keys[~alone]
    words = table.column("word").take(pa.array(order)).to_pylist()
    often = table.column("n").to_numpy()[order]
    lengths = np.array([len(w) for w in words], np.int64)
    left, right = [], []
    for first, last in _blocks(keys) if len(keys) else ():
        x, y = near_pairs(_codes(words[first:last], m + 1), lengths[first:last], s, t)
        left += [x + first, y[lengths[first + y] == m + 1] + first]
        right += [y + first, x[lengths[first + y] == m + 1] + first]
    left, right = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    involved = np.unique(right)
    rank = np.zeros(len(words), np.int64)
    rank[sorted(involved.tolist(), key=words.__getitem__)] = np.arange(len(involved))
    by = np.lexsort((rank[right], -often[right], left))
    left, right = left[by], right[by]
    who, first, near = np.unique(left, return_index=True, return_counts=True)
    best = right[first]
    return pa.table([pa.array([words[i] for i in who], pa.string()), pa.array(near, pa.int64()), pa.array(often[best], pa.int64()), pa.array([words[i] for i in best], pa.string())],
                    ["word", "near", "form_n", "form"])


def near_words(words: DataFrame, least: int = 7, group: int = GROUP) -> DataFrame:
    """For each of ``words`` (word, n; distinct, of at least ``least`` code points) that has near words: word, n_near, and the near word
    of largest n (ties: the smallest in code-point order) as form_n, form."""
    entries = _groups(words, least, group)
    shares = entries.groupBy("m", "s", "t").agg(F.ceil(F.count("*") / CALL_ROWS).alias("shares"))
    dealt = entries.join(_bounded(stored(shares, "shares")), ["m", "s", "t"]).withColumn("share", F.pmod("key", F.col("shares"))).drop("shares")
    part = dealt.groupBy("m", "s", "t", "share").applyInArrow(_search, "word string, near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form")))
    return part.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, twice as far in every round. A form occurs more often than its word,
    so there is no ring."""
    hops = forms.select("word", F.col("form").alias("root"))
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("far"))
        further = stored(hops.join(on, "root", "left"), "hops")
        hops = further.select("word", F.coalesce("far", "root").alias("root"))
        if further.where("far IS NOT NULL").isEmpty():
            return hops


def groups(words: DataFrame, times: int = 10, least: int = 7, group: int = GROUP) -> DataFrame:
    """Per row of ``words`` (word, n): word, n, form (its near word of largest n, if that is at least ``times`` its own), form_n, root and
    n_near."""
    near = near_words(words, least, group)
    known = F.col("form_n") >= times * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(known, F.col("form")).alias("form"), F.when(known, F.col("form_n")).alias("form_n"))
    rows = stored(rows, "near-words")
    roots: Column = F.coalesce("root", "word")
    return rows.join(_roots(rows.where("form IS NOT NULL")), "word", "left").select("word", "form", roots.alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms and roots."""
    return groups(stored(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")), "words"))


def oracle(docs: str = "documents") -> str:
    """DuckDB text of ``op12_spelling``; near words by one deleted place."""
    return f"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END, i)) AS crc),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM {docs}),
x AS (SELECT run, hex(encode(id || ':' || run)) AS h FROM r WHERE length(run) >= 7),
b AS (SELECT run, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM x),
k AS (SELECT run, xor(4294967295::BIGINT, list_reduce(bytes, lambda a, y: xor(crc[(xor(a, y) & 255) + 1], a >> 8), 4294967295::BIGINT)) AS h FROM b, c),
w AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM k) WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM w, range(0, (SELECT max(length(word)) FROM w)) AS g(i) WHERE i < length(word)),
p AS (SELECT a.word, b.word AS other, b.n FROM d AS a JOIN d AS b USING (rest, i) WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
f AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS form, max(n) AS form_n FROM p GROUP BY 1),
o AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN f USING (word)),
t AS (SELECT word, word AS stop, 0 AS hops FROM o UNION ALL SELECT t.word, o.form, hops + 1 FROM t JOIN o ON t.stop = o.word WHERE o.form IS NOT NULL)
SELECT o.word, o.form, e.root, o.n, o.n_near, o.form_n FROM o JOIN (SELECT word, arg_max(stop, hops) AS root FROM t GROUP BY 1) AS e USING (word)
"""
