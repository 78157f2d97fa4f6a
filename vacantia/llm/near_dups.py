"""MinHash near-duplicates through a multi-index Hamming join.

A document is the set of its word shingles. A signature holds ``PLACES`` minima of ``BITS`` bits; the distance of two signatures is
the number of places that differ. The places are split into chunks of ``WIDTH``. By pigeonhole, two signatures that differ in at most
``chunks * (ERRORS + 1) - 1`` places have a chunk with at most ``ERRORS`` differing places. Each chunk is entered once for every choice
of ``ERRORS`` places left out, so such a pair shares an entry: all pairs under that distance meet. Two sets at similarity 0.8 meet but
for a chance of 4e-7 (14 chunks of 6 places, one error); pairs further apart than ``FAR`` places are dropped, which two sets at 0.8
exceed with a chance of 1e-10. What remains is confirmed on the full sets.

Rows with the same set form a class, and the class takes part as one node. Members of an entry are never paired with each other:

1. every member meets the smallest member that it shares an entry with;
2. the members of each entry that still spans several components are measured against one reference, a central member of the entry's
   largest component. Members similar to it are linked through it. A member that is not can only be similar to another one with which it
   shares a certain number of the shingles that set the two apart from the reference; such pairs meet in prefixes of these shingles,
   rarest first, whose lengths follow from the weights of both (``_meetings``). First each meets one member per component, then,
   where the components are still apart, the others.

So every pair that could link two components is compared, or ruled out by a bound that holds for all sets. Links are kept as one edge
per member (to its component's label). Texts are hashed in one narrow pass; entries, pairs and links are tables in the shared folder,
removed once they are superseded; full sets move only for pairs to confirm and for members that are measured.

Edge cases. A row without words or text has an empty set and is its own component. With fewer words than a shingle the whole sequence
is the one shingle. The chunks are made for similarities of 80 % or more: a smaller ``percent`` is refused. A doc_id (an integer) names
a document: rows that repeat it are linked through it; a row without doc_id takes no part, its component is null and it is kept. A
text of any length is hashed whole. An empty table gives an empty result. Other columns are not read; ``one_of_each`` hands them on,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.llm.shared import bounded, discard, in_few_tasks, smallest_labels, stored, unused
from vacantia.llm.words import mix, shingles

CHUNKS, WIDTH, ERRORS, BITS = 14, 6, 1, 16
PLACES = CHUNKS * WIDTH
#: Places in which two sets at 0.8 differ at most (but for a chance of 1e-9).
FAR = 42
#: Rows of the involved documents up to which their ids are broadcast to fetch the texts.
BROADCAST_ROWS = 200_000
#: Pairs that one task compares at least.
TASK_PAIRS = 1_000

_SEEDS = mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WEIGHTS = mix(_SEEDS) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low bits of the smallest value of each of ``PLACES`` hash functions; large sets are taken in slices."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, mix(hashes[None, at : at + 4096] ^ _SEEDS[:, None]).min(axis=1), out=least)
    return mix(least).astype(np.uint16)


def _set_id(hashes: np.ndarray) -> bytes:
    """128 bits of the whole set."""
    a, b = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), mix(hashes + np.uint64(0x14057B7EF767814F))
    return np.array([a.sum(dtype=np.uint64), np.bitwise_xor.reduce(b) if len(b) else 0], np.uint64).tobytes()


def _sketches(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "set_id", "signature"]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            n, ids, signatures = [], [], []
            for text in part.column(1):
                hashes = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", width)
                n.append(len(hashes))
                ids.append(_set_id(hashes))
                signatures.append(signature(hashes).tobytes() if len(hashes) else b"")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(signatures, pa.binary())], names)


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, signature) to (entry, doc): one row per chunk and place left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            docs = part.column(0).to_numpy()
            values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(len(docs), PLACES).astype(np.uint64)
            terms = (mix(values + _SEEDS) * _WEIGHTS).reshape(len(docs), CHUNKS, WIDTH)
            entries = mix((terms.sum(axis=2, dtype=np.uint64)[:, :, None] - terms) + _WEIGHTS.reshape(CHUNKS, WIDTH))
            yield pa.RecordBatch.from_arrays([pa.array(entries.reshape(-1).view(np.int64)), pa.array(np.repeat(docs, PLACES))], ["entry", "doc"])


def _near(batches: Iterable[pa.RecordBatch], far: int) -> Iterator[pa.RecordBatch]:
    """(a, b, signature of a, signature of b) to the pairs (a, b) that differ in at most ``far`` places."""
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, PLACES) for i in (2, 3))
        near = pa.array((left != right).sum(axis=1) <= far)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc, set_id, text) to (doc, hashes), for texts whose set is the one that stands for ``doc``; once per task."""
    done: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            docs, sets = [], []
            for doc, wanted, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                if doc in done:
                    continue
                hashes = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", width)
                if _set_id(hashes) == wanted:
                    done.add(doc)
                    docs.append(doc)
                    sets.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sets, pa.binary())], ["doc", "hashes"])


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, hashes of a, hashes of b) to (a, b, size of a, size of b, size of the intersection)."""
    for batch in batches:
        sizes: list[list[int]] = [[], [], []]
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            for column, value in zip(sizes, (len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in sizes)], ["a", "b", "n_a", "n_b", "both"])


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ..., hashes of a, hashes of b) to one row per hash that only one of the two sets has."""
    for batch in batches:
        rest = batch.num_columns - 2
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(rest + k)[i].as_buffer(), np.uint64) for k in (0, 1))
            tokens = np.setxor1d(x, y, assume_unique=True).view(np.int64)
            repeated = [pa.repeat(batch.column(k)[i], len(tokens)) for k in range(rest)]
            yield pa.RecordBatch.from_arrays([*repeated, pa.array(tokens)], [*batch.schema.names[:rest], "token"])


def _bounded(df: DataFrame) -> DataFrame:
    return bounded(df, BROADCAST_ROWS)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_id and signature of every row, as a stored table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(lambda x: _sketches(x, width), "doc_id long, n_shingles long, set_id binary, signature binary"), "sketches")


def links(docs: DataFrame, standing: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all similar sets of ``standing`` (doc, doc_id, n, set_id, signature): one row per class, ``doc`` being
    its node and ``doc_id`` one of its rows."""
    if percent < 80:
        raise ValueError("the signatures are cut for similarities of 80 % or more")
    scratch: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """``df`` stored until the next ``swept``."""
        scratch.append(stored(df, name))
        return scratch[-1]

    def swept() -> None:
        while scratch:
            discard(scratch.pop())

    # Sets of up to three shingles are similar only if they are equal.
    wide = standing.where("n > 3").select("doc", "signature")
    keyed = wide.mapInArrow(_entries, "entry long, doc long")
    met = stored(keyed.groupBy("entry").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("entry", "least"), "met")
    entries = stored(keyed.join(_bounded(met), "entry"), "entries")

    involved = stored(entries.select("doc").distinct().join(standing, "doc"), "involved")
    wanted = involved.select("doc", "doc_id", "set_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_bounded(wanted), "doc_id").select("doc", "set_id", "text")
    sets = stored(texts.mapInArrow(lambda x: _sets(x, width), "doc long, hashes binary"), "sets")

    def side_of(name: str, *columns: str) -> DataFrame:
        return involved.select(F.col("doc").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def with_sets(pairs: DataFrame, count: int) -> DataFrame:
        """``count`` rows with a and b, and the full sets of both."""
        left = in_few_tasks(pairs.join(sets.toDF("a", "left"), "a"), count, TASK_PAIRS)
        return in_few_tasks(left.join(sets.toDF("b", "right"), "b"), count, TASK_PAIRS)

    def compared(pairs: DataFrame, count: int) -> DataFrame:
        """Sizes and intersections of the pairs (a, b), of which there are ``count`` or fewer."""
        full = with_sets(pairs, count).select("a", "b", "left", "right")
        return kept(full.mapInArrow(_shared, "a long, b long, n_a long, n_b long, both long"), "compared")

    similar = 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The similar ones of the pairs (a, b): those of fitting sizes and near signatures are compared."""
        pairs = kept(pairs.distinct(), "pairs")
        count = pairs.count()
        pairs = in_few_tasks(pairs.join(side_of("a", "n", "signature"), "a"), count)
        pairs = in_few_tasks(pairs.join(side_of("b", "n", "signature"), "b"), count)
        pairs = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        near = pairs.select("a", "b", "signature_a", "signature_b").mapInArrow(lambda x: _near(x, FAR), "a long, b long")
        return compared(near, count).where(similar).select("a", "b")

    def ordered(x: str, y: str) -> list:
        return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]

    first = entries.groupBy("doc").agg(F.min("least").alias("b")).where("b < doc").select(F.col("doc").alias("a"), "b")
    labels = smallest_labels(confirmed(first))
    swept()
    found = labels.where("node <> label").toDF("a", "b")
    # What is left are entries whose members are in several components.
    part = kept(entries.select("entry", "doc").join(labels.toDF("doc", "label"), "doc", "left").select("entry", "doc", F.coalesce("label", "doc").alias("part")), "parts")
    across = part.groupBy("entry").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size")).where("p < q").select("entry", "size")
    apart = kept(part.join(_bounded(kept(in_few_tasks(across, part.count()), "across")), "entry"), "apart")
    if apart.isEmpty():
        return found

    rows = apart.count()
    # The reference of a component is the member that shares its entries with most others: what all copies come from, if it is there.
    central = apart.groupBy("part", "doc").agg(F.sum("size").alias("others")).groupBy("part").agg(F.max(F.struct("others", "doc"))["doc"].alias("a"))
    sizes = apart.groupBy("entry", "part").agg(F.count("*").alias("members"))
    main = sizes.groupBy("entry").agg(F.max(F.struct("members", "part"))["part"].alias("part"))
    main = main.join(_bounded(kept(in_few_tasks(central, rows), "central")), "part").select("entry", "a")
    referred = apart.select("entry", "doc", "size").join(_bounded(kept(in_few_tasks(main, rows), "main")), "entry").where("doc <> a")
    # Of an entry of two only these two are to be compared; in a larger one every member is measured.
    referred = kept(in_few_tasks(referred.groupBy("a", F.col("doc").alias("b")).agg(F.max("size").alias("size")), rows), "referred")
    count = referred.count()
    links_of_two = confirmed(referred.where("size <= 2").select(*ordered("a", "b")))
    measured = compared(referred.where("size > 2").select("a", "b"), count)
    weight = 100 * (F.col("n_a") - F.col("both")) + percent * (F.col("n_b") - F.col("both"))
    measured = kept(measured.select(
        "a", "b", similar.alias("close"), weight.alias("w"), (F.col("n_a") + F.col("n_b") - 2 * F.col("both")).alias("e"), ((100 - percent) * F.col("n_a")).alias("room")), "measured")
    labels = smallest_labels(found.union(links_of_two).union(measured.where("close").select("a", "b")))
    # Members of one component by now need not meet: only references with members of several ones are searched.
    label_of = measured.select(F.col("b").alias("doc")).distinct().join(labels.toDF("doc", "label"), "doc", "left").select(F.col("doc").alias("b"), F.coalesce("label", "doc").alias("part"))
    parted = kept(in_few_tasks(measured.join(_bounded(kept(in_few_tasks(label_of, count), "labels")), "b"), count), "parted")
    several = parted.groupBy("a").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.max(~F.col("close")).alias("far")).where("p < q AND far").select("a")
    parted = parted.join(_bounded(kept(in_few_tasks(several, count), "several")), "a")
    entered = kept(_meetings(parted, lambda pairs: with_sets(pairs, count), percent), "entered")
    keys = ["a", "token", "j", "k"]

    def mixed(rows: DataFrame, name: str) -> DataFrame:
        """The rows at places that hold both roles, and several components: no other gives a link, as components only grow."""
        places = rows.groupBy(*keys).agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min("role").alias("x"), F.max("role").alias("y"))
        count = rows.count()
        places = kept(in_few_tasks(places.where("p < q AND x < y").select(*keys), count), "places")
        return stored(in_few_tasks(rows.join(_bounded(places), keys), count), name)

    rows = mixed(entered, "meetings")
    found = labels.where("node <> label").toDF("a", "b")
    if rows.isEmpty():
        return found
    swept()
    q = 100 + percent
    for every in (False, True):
        if every:
            labels = smallest_labels(found)
            found = labels.where("node <> label").toDF("a", "b")
            swept()
            part = rows.select(F.col("b").alias("doc")).distinct().join(labels.toDF("doc", "label"), "doc", "left").select(F.col("doc").alias("b"), F.coalesce("label", "doc").alias("part"))
            rows = mixed(kept(rows.drop("part").join(_bounded(kept(in_few_tasks(part, count), "parts")), "b"), "parted"), "both")
        x, y = rows.where("role = 0"), rows.where("role = 1")
        if not every:
            x = x.groupBy(*keys, "part").agg(F.min(F.struct("w", "b", "e")).alias("x")).select(*keys, "part", "x.*")
        x = x.select(*keys, F.col("part").alias("x_part"), F.col("b").alias("x"), F.col("w").alias("x_w"), F.col("e").alias("x_e"))
        lighter = (F.col("x_w") < F.col("w")) | ((F.col("x_w") == F.col("w")) & (F.col("x") < F.col("b")))
        enough = q * F.least("x_e", "e") >= F.col("x_w") + F.col("w") - F.col("room")
        pairs = y.join(x, keys).where((F.col("x_part") != F.col("part")) & lighter & enough)
        found = found.union(confirmed(pairs.select(*ordered("x", "b"))))
    return found


def _meetings(measured: DataFrame, with_sets, percent: int) -> DataFrame:
    """Where documents measured against one reference can meet: rows (a, token, j, k, role, b, part, w, e, room).

    Let x and y differ from the reference in R removed and A added shingles, with weight w = 100 R + percent A, and share s of these
    e = R + A edits. Then x and y are similar exactly if (100 + percent) s >= w(x) + w(y) - room, where room = (100 - percent)
    |reference|; and y is not similar to the reference if its excess w(y) - room is positive. Take y to be such, and of no smaller weight
    than x. If both excess and weight are known to be at least G and W, x and y share at least S = ceil((w(x) + G) / (100 + percent)) and
    ceil((W + excess(y)) / (100 + percent)) edits, so a shared one is among the e - S + 1 rarest edits of each. So x (role 0) is
    entered for every class j of excesses under its reference, y (role 1) for every class k of weights; classes are steps of the
    logarithm, and G and W are the smallest values in them.

    Members of one component (``part``) need no link, so an edit that only members of one component have counts as rare: it comes first
    in the order and is not entered.
    """
    q = 100 + percent

    def step(value: Column) -> Column:
        return F.floor(4 * F.log2(1 + value / q)).cast("int")

    excess = F.col("w") - F.col("room")
    all_of = measured.withColumn("k", step(F.col("w"))).withColumn("j", F.when(~F.col("close"), step(excess)))
    by_weight = all_of.groupBy("a", "k").agg(F.min("w").alias("least")).groupBy("a").agg(F.collect_list(F.struct(F.col("k").alias("step"), "least")).alias("weights"))
    by_excess = all_of.where("NOT close").groupBy("a", "j").agg(F.min(excess).alias("least")).groupBy("a").agg(F.collect_list(F.struct(F.col("j").alias("step"), "least")).alias("excesses"))
    # A reference that all its members are similar to has nobody left; with the classes of a reference the longest prefix is known.
    useful = all_of.join(by_excess, "a").join(by_weight, "a")

    def prefix(known: Column, least: Column) -> Column:
        return F.col("e") - F.ceil((known + least) / q) + 1

    as_x = F.array_max(F.transform("excesses", lambda c: prefix(F.col("w"), c["least"])))
    as_y = F.when(~F.col("close"), F.array_max(F.transform("weights", lambda c: prefix(excess, c["least"]))))
    useful = useful.withColumn("longest", F.greatest(as_x, as_y)).where("longest > 0")
    kept = ["a", "b", "part", "close", "w", "e", "room", "j", "k", "longest"]
    schema = "a long, b long, part long, close boolean, w long, e long, room long, j int, k int, longest long, token long"
    tokens = stored(with_sets(useful.select(*kept)).select(*kept, "left", "right").mapInArrow(_edits, schema), "edits")
    count = tokens.count()
    often = tokens.groupBy("a", "token").agg(F.when(F.min("part") < F.max("part"), F.count("*")).otherwise(1).alias("often"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("often", "token"))
    ranked = in_few_tasks(tokens.join(often, ["a", "token"]), count)
    ranked = in_few_tasks(ranked.withColumn("rank", rank), count).where("rank <= longest AND often > 1").drop("often", "longest")
    ranked = ranked.join(_bounded(by_excess), "a").join(_bounded(by_weight), "a")
    xs = F.transform(F.filter("excesses", lambda c: F.col("rank") <= prefix(F.col("w"), c["least"])), lambda c: F.struct(F.lit(0).alias("role"), c["step"].alias("j"), F.col("k").alias("k")))
    ys = F.transform(F.filter("weights", lambda c: ~F.col("close") & (F.col("rank") <= prefix(excess, c["least"])) & (c["least"] <= F.col("w"))),
                     lambda c: F.struct(F.lit(1).alias("role"), F.col("j").alias("j"), c["step"].alias("k")))
    rows = ranked.withColumn("at", F.explode(F.concat(xs, ys)))
    return rows.select("a", "token", "at.j", "at.k", "at.role", "b", "part", "w", "e", "room")


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept."""
    docs = docs.select("doc_id", "text")
    sketched = sketches(docs, width)
    filled = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = stored(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")
    # Rows that share a doc_id link the classes of their texts.
    shared = filled.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high").select("doc_id")
    shared = filled.select("doc_id", "set_id").distinct().join(_bounded(stored(shared, "repeated")), "doc_id").join(classes.select("set_id", F.col("doc").alias("a")), "set_id")
    shared = shared.select("a", "doc_id").join(shared.groupBy("doc_id").agg(F.min("a").alias("b")), "doc_id").select("a", "b")
    labels = smallest_labels(links(docs, classes, width, percent).union(shared))
    named = classes.select("doc", "doc_id").join(labels.toDF("doc", "part"), "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    least = named.groupBy("part").agg(F.min("doc_id").alias("label"))
    named = named.join(least, "part").join(classes.select("doc", "set_id"), "doc").select("set_id", "label")
    out = sketched.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    label = F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), label).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` per component, that with the smallest doc_id, with the columns they came with; rows without doc_id stay.

    Of rows that share a doc_id one stays, that with the smallest text hash.
    """
    judged = stored(components(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width, percent), "components")
    gone = unused(docs.columns, "gone_id")

    def ids(rows: DataFrame) -> DataFrame:
        rows = stored(rows.select(F.col("doc_id").alias(gone)), "ids")
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    dropped = ids(judged.where("NOT kept").select("doc_id").distinct())
    kept = docs.join(dropped, docs[doc_id] == dropped[gone], "left_anti")
    repeated = judged.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    twice = ids(repeated)
    row = F.struct(*[F.col(c) for c in docs.columns])
    firsts = kept.join(twice, kept[doc_id] == twice[gone], "left_semi").groupBy(F.col(doc_id).alias(gone)).agg(F.min_by(row, F.xxhash64(text)).alias("row")).select("row.*")
    return kept.join(twice, kept[doc_id] == twice[gone], "left_anti").union(firsts)


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over two-word shingles."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, percent=80)
