"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned from labelled rows: whole words and word beginnings (stems, of ``STEMS`` letters) whose document counts in toxic
and other rows differ most. It is a trie, and the automaton of edit distance is run over the whole trie at once: a state is the set
of (trie node, edits so far) that a word's letters can reach, and states and steps are kept once they were met, so an unknown word
costs a look-up per letter. Terms of three letters must match exactly, longer ones may differ by ``edits`` letters, where
a swap of two neighbours counts as one; a stem may be followed by anything. Words of three letters or more, however
long, are terms beside the stems that cover them.
A word that resembles a term but is met in labelled rows often enough to show that it says too little is no misspelling of it.

Each hit gets a context score from where it stands and the ``WINDOW`` words around it: quotations of any length, quoting lines and
reporting verbs lower it, second person, exclamation and other hits near by raise it. A document's features are sums, maxima and shares of the hits' weights; a logistic
model over them, fitted on about ``FIT_ROWS`` labelled rows (drawn by a hash), gives the score. Counts for the lexicon cover all labelled
rows; a text that several of them share counts once, toxic if at least half of them are.

Only rows whose crc32(doc_id as text) modulo 3 is not 1 teach. Labels, lang, source and doc_id are no inputs of a score. Labels meet
their texts in a join that broadcasts the labels only where their counted rows stay under ``BROADCAST_ROWS``. Driver-side: the terms of
the lexicon, two counts of each, and the rows to fit. All terms that pass the measures are kept; Spark broadcasts a lexicon beyond a megabyte.

Edge cases. A null or empty text has no hits and the score of that. Texts of any length are read whole. Of several labels of one
doc_id the largest counts; null labels and labels without a row are ignored. Rows that share a doc_id are scored each for itself; a null doc_id is
never held out and never teaches. Without toxic or without other labels every score is the smoothed share of toxic ones (0.5 without
labels). An empty table gives an empty result. Other columns are not read; ``civil`` hands them on, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.shared import stored, unused
from vacantia.llm.units import Memory

STEMS = (4, 5, 6, 7, 8)
LEAST_ROWS, LEAST_ODDS, LEAST_RATIO = 4, 2.0, 25.0
FIT_ROWS, BROADCAST_ROWS = 20_000, 500_000
WINDOW, THRESHOLD, LEAST_FUZZY = 8, 0.7, 0.5
#: Letters of words whose counts a task holds before it hands them on.
HELD_LETTERS = 1 << 24
_WORDS = re.compile(r"\w+")
_MARKS = re.compile('["“”„«»‘’]')
#: What closes a quotation that the mark opens.
_CLOSERS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’"}
_SPELLED = str.maketrans("013457", "oieast")
#: Words of reported speech, and of address, in the four languages of the corpus.
REPORTING = frozenset("said says wrote quote quoted called word term sagte schrieb zitat wort dit écrit cite mot terme dijo escribió cita palabra".split())
ADDRESS = frozenset("you your yours du dein deine dich tu ton toi te vous votre tú usted vosotros".split())


def edits(term: str) -> int:
    """How many letters of a term may differ."""
    return 0 if len(term) < 4 else 1 if len(term) < 10 else 2


@dataclass
class Trie:
    """A term's end is marked with its number; stems end in the same way but accept any continuation."""

    steps: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, int] = field(default_factory=dict)
    stems: dict[int, int] = field(default_factory=dict)

    def add(self, term: str, number: int, stem: bool) -> None:
        node = 0
        for letter in term:
            if letter not in self.steps[node]:
                self.steps[node][letter] = len(self.steps)
                self.steps.append({})
            node = self.steps[node][letter]
        (self.stems if stem else self.ends)[node] = number


class FuzzyLexicon:
    """The edit-distance automaton over a trie of ``terms`` (a trailing ``*`` marks a stem), made deterministic as words ask for it."""

    MOST_STATES = 100_000

    def __init__(self, terms: list[str], exact_only: frozenset[int] = frozenset(), swaps: bool = False) -> None:
        """``exact_only`` numbers the terms that may not differ by a letter; with ``swaps`` two neighbours that changed places are one edit."""
        self.terms, self.trie, self.swaps = terms, Trie(), swaps
        for number, term in enumerate(terms):
            self.trie.add(term.rstrip("*"), number, term.endswith("*"))
        self.allowed = [0 if n in exact_only else edits(t.rstrip("*")) for n, t in enumerate(terms)]
        # A node is worth following with e edits while a term below it allows as many.
        self.reach = [-1] * len(self.trie.steps)
        for node in range(len(self.trie.steps) - 1, -1, -1):
            own = [self.allowed[m[node]] for m in (self.trie.ends, self.trie.stems) if node in m]
            self.reach[node] = max([-1, *own, *(self.reach[c] for c in self.trie.steps[node].values())])
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple[dict[int, int], dict[tuple[int, str], int], tuple[int, int] | None]] = []
        self.moves: list[dict[str, int]] = []
        self.start = self.number(self.closed({0: 0}), {}, None)

    def closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes that missing letters reach, and without those that no term can end from."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            for child in self.trie.steps[node].values():
                if e + 1 <= self.reach[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        return {n: e for n, e in nodes.items() if e <= self.reach[n]}

    def number(self, nodes: dict[int, int], halves: dict[tuple[int, str], int], best: tuple[int, int] | None) -> int:
        """The state of these nodes; ``halves`` are swaps of which one letter was read, as (node after both, other letter), and ``best``
        is the stem met so far, as (edits, -term)."""
        for node, e in nodes.items():
            stem = self.trie.stems.get(node)
            if stem is not None and e <= self.allowed[stem] and (best is None or (e, -len(self.terms[stem])) < (best[0], -len(self.terms[best[1]]))):
                best = (e, stem)
        key = (frozenset(nodes.items()), frozenset(halves.items()), best)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append((nodes, halves, best))
            self.moves.append({})
        return self.numbers[key]

    def step(self, state: int, letter: str) -> int:
        nodes, halves, best = self.states[state]
        after = {node: e for (node, wanted), e in halves.items() if wanted == letter}
        begun: dict[tuple[int, str], int] = {}
        for node, e in nodes.items():
            for read, child in self.trie.steps[node].items():
                cost = e + (read != letter)
                if cost <= self.reach[child] and after.get(child, 99) > cost:
                    after[child] = cost
                both = self.trie.steps[child].get(letter) if self.swaps and read != letter else None
                if both is not None and e + 1 <= self.reach[both] and begun.get((both, read), 99) > e + 1:
                    begun[both, read] = e + 1
            if e + 1 <= self.reach[node] and after.get(node, 99) > e + 1:  # a letter too many
                after[node] = e + 1
        to = self.moves[state][letter] = self.number(self.closed(after), begun, best)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """The term that a word stands for, and the edits: fewest edits first, whole words before stems, then the longer term."""
        if len(self.states) > self.MOST_STATES:
            self.clear()
        state = self.start
        for letter in word:
            to = self.moves[state].get(letter)
            state = self.step(state, letter) if to is None else to
            if not self.states[state][0] and not self.states[state][1]:
                break
        nodes, _, best = self.states[state]
        found = (best[0], 1, -len(self.terms[best[1]]), best[1]) if best else None
        for node, e in nodes.items():
            term = self.trie.ends.get(node)
            if term is not None and e <= self.allowed[term] and (found is None or (e, 0, -len(self.terms[term]), term) < found):
                found = (e, 0, -len(self.terms[term]), term)
        return (found[3], found[0]) if found else None


def quotations(text: str) -> list[tuple[int, int]]:
    """Start and end of the outermost quotations of a text, over any number of lines: marks of the same kind are paired in order.

    A mark between two letters is an apostrophe. A straight mark after white space (or a bracket) and before a word only opens, one after
    a word and before white space only closes. A quotation that is never closed is none, nor is what a later mark of its kind opens anew.
    """
    found: list[tuple[int, int]] = []
    opened: dict[str, int] = {}
    for m in _MARKS.finditer(text):
        mark, at = m.group(), m.start()
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        if mark in '"’' and before.isalnum() and after.isalnum():
            continue
        starts = mark == '"' and (not before or before.isspace() or before in "([{") and after.strip() != ""
        ends = mark == '"' and not starts and before.strip() != "" and (not after or after.isspace())
        begun = [] if starts else [o for o in opened if mark in _CLOSERS[o]]
        if begun:
            start = opened.pop(max(begun, key=opened.__getitem__))
            while found and found[-1][0] > start:
                found.pop()
            found.append((start, at + 1))
            opened = {o: a for o, a in opened.items() if a < start}
        elif mark in _CLOSERS and not ends:
            opened[mark] = at
    return found


class Scanner:
    """Hits of a lexicon in texts."""

    def __init__(self, terms: list[str], exact_only: frozenset[int] = frozenset(), harmless: frozenset[str] = frozenset()) -> None:
        """``harmless`` words are no misspellings of any term."""
        self.harmless = harmless
        self.lexicon = FuzzyLexicon(terms, exact_only, swaps=True)
        self.known = Memory(self.look, longest=40)

    def look(self, word: str) -> tuple[int, int] | bool:
        found = self.lexicon.match(word)
        if word in self.harmless and found and found[1]:
            return False
        if (found is None or found[1]) and not word.isalpha():
            spelled = self.lexicon.match(word.translate(_SPELLED))
            if spelled and (found is None or spelled[1] < found[1]):
                return spelled
        return found or False

    def hits(self, text: str) -> tuple[list[tuple[int, int, int, float]], int]:
        """(word, term, edits, context score) of every hit, and the number of words."""
        words = _WORDS.findall(text.lower())
        looked = list(map(self.known.__getitem__, words))
        if not any(looked):
            return [], len(words)
        found = [(i, *h) for i, h in enumerate(looked) if h]
        places = [m.span() for m in _WORDS.finditer(text)]
        whole = len(places) == len(words)  # lower case can change the number of words in rare scripts
        spans = quotations(text) if whole else []
        starts = [a for a, _ in spans]
        out = []
        for k, (i, term, e) in enumerate(found):
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            a, b = places[i] if whole else (0, 0)
            line = text.rfind("\n", 0, a) + 1
            span = bisect_right(starts, a) - 1
            quoted = whole and (text.startswith(">", line) or span >= 0 and b <= spans[span][1])
            others = k > 0 and i - found[k - 1][0] <= WINDOW or k + 1 < len(found) and found[k + 1][0] - i <= WINDOW
            score = 1.0 - 0.6 * quoted - 0.3 * (not REPORTING.isdisjoint(near))
            score += 0.2 * (not ADDRESS.isdisjoint(near)) + 0.1 * ("!" in text[b : b + 3].split("\n", 1)[0]) + 0.2 * others
            out.append((i, term, e, max(0.1, score)))
        return out, len(words)


N_FEATURES = 9


def features(hits: list[tuple[int, int, int, float]], words: int, exact: np.ndarray, fuzzy: np.ndarray) -> list[float]:
    """What the model reads of a document; ``exact`` and ``fuzzy`` are the terms' weights."""
    weights = [(fuzzy if e else exact)[term] * c for _, term, e, c in hits]
    kinds: dict[tuple[int, bool], float] = {}
    for (_, term, e, _), w in zip(hits, weights, strict=True):
        kinds[term, e > 0] = max(kinds.get((term, e > 0), w), w)
    strong = [w for w in weights if w > 0]
    total = sum(strong)
    return [
        1.0, float(bool(hits)), max([0.0, *weights]), np.log1p(total), sum(sorted(kinds.values())[-3:]) / 3 if kinds else 0.0,
        np.log1p(len(strong)), np.log1p(100 * total / (words + 10)), sum(c < 0.75 for *_, c in hits) / max(1, len(hits)), np.log1p(words) / 10,
    ]


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a logistic model by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(x.shape[1])
        move = np.linalg.solve(bend, slope)
        w += move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (entry, toxic, other): documents per word and stem, summed per batch."""
    names = ["entry", "toxic", "other"]
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        letters = 0

        def given() -> pa.RecordBatch:
            entries = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), *(pa.array([counts[k][x] for x in entries], pa.int64()) for k in (1, 0))], names)

        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = set(_WORDS.findall((text.as_py() or "").lower()))
            counts[toxic].update(w for w in words if len(w) >= 3)
            letters += sum(map(len, words))
            counts[toxic].update({f"{w[:n]}*" for w in words for n in STEMS if len(w) > n})
            if len(counts[0]) + len(counts[1]) > 200_000 or letters > HELD_LETTERS:
                yield given()
                letters = 0
                counts[0].clear()
                counts[1].clear()
        yield given()


def _log_odds(n1, n0, all1, all0):
    return np.log((n1 + 0.5) / (all1 + 1)) - np.log((n0 + 0.5) / (all0 + 1))


def _odds(all1: int, all0: int) -> Column:
    """``_log_odds`` of columns n1 and n0."""
    return F.log((F.col("n1") + 0.5) / (all1 + 1)) - F.log((F.col("n0") + 0.5) / (all0 + 1))


def _exact_only(fuzzy: np.ndarray) -> frozenset[int]:
    """Terms whose misspellings say too little to be looked for."""
    return frozenset(np.flatnonzero(fuzzy < LEAST_FUZZY).tolist())


@dataclass
class Model:
    terms: list[str]
    exact: np.ndarray
    fuzzy: np.ndarray
    harmless: frozenset[str]
    weights: np.ndarray
    share: float

    def scanner(self) -> Scanner:
        return Scanner(self.terms, _exact_only(self.fuzzy), self.harmless)

    def score(self, scanner: Scanner, text: str) -> float:
        if not len(self.weights):
            return self.share
        x = np.array(features(*scanner.hits(text), self.exact, self.fuzzy))
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic (0 or 1) and draw of the labelled rows that teach, as a stored table: one row per distinct text, which is toxic if at
    least half of its rows are."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = stored(marks.where(~held_out(F.col("label_id"))), "labels")
    side = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    rows = docs.join(side, docs["doc_id"] == side["label_id"]).select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    once = rows.groupBy("text").agg(F.sum("toxic").alias("n1"), F.count("*").alias("n"))
    return stored(once.select("text", F.when(2 * F.col("n1") >= F.col("n"), 1).otherwise(0).alias("toxic"), F.xxhash64("text").alias("draw")), "taught")


def lexicon(taught: DataFrame, all1: int, all0: int) -> tuple[list[str], np.ndarray]:
    """All terms whose counts differ by the ``LEAST_`` measures, which are the same at every size, and their log odds: all such words, as
    misspellings are looked for in whole words, and of nested stems those that say more than a shorter one."""
    counts = taught.select("text", "toxic").mapInArrow(_counted, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("n1"), F.sum("other").alias("n0"))
    n1, n0 = F.col("n1"), F.col("n0")
    odds = _odds(all1, all0)
    share = (n1 + n0) / F.lit(all1 + all0)
    ratio = 2 * (n1 * F.log(n1 / (share * all1)) + F.when(n0 > 0, n0 * F.log(n0 / (share * all0))).otherwise(0))
    rows = counts.where((n1 >= LEAST_ROWS) & (odds >= LEAST_ODDS) & (ratio >= LEAST_RATIO)).orderBy(ratio.desc(), "entry").collect()
    chosen: dict[str, tuple[int, int]] = {}
    odds_of = {r["entry"]: float(_log_odds(r["n1"], r["n0"], all1, all0)) for r in rows}
    for r in rows:
        entry = r["entry"]
        bare = entry.rstrip("*")
        covered = entry.endswith("*") and any(f"{bare[:n]}*" in chosen and odds_of[f"{bare[:n]}*"] >= odds_of[entry] - 0.7 for n in STEMS if n <= len(bare))
        if not covered:
            chosen[entry] = (r["n1"], r["n0"])
    terms = list(chosen)
    return terms, np.array([odds_of[t] for t in terms])


def _hit_counts(batches: Iterable[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to documents per word that stands for a term with edits."""
    scanner = Scanner(terms)
    for batch in batches:
        counts: Counter = Counter()
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for word in set(_WORDS.findall((text.as_py() or "").lower())):
                met = scanner.known[word]
                if met and met[1]:
                    counts[met[0], word, toxic] += 1
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))), pa.array([n for _, n in rows], pa.int64())], ["term", "word", "toxic", "n"])


def _feature_rows(batches: Iterable[pa.RecordBatch], terms: list[str], exact: np.ndarray, fuzzy: np.ndarray, harmless: frozenset[str]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(terms, _exact_only(fuzzy), harmless)
    for batch in batches:
        x = [features(*scanner.hits(t.as_py() or ""), exact, fuzzy) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon, weights and model from the labelled rows of ``docs`` (doc_id, text) that teach."""
    taught = labelled(docs, labels)
    totals = {r["toxic"]: r["n"] for r in taught.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    all1, all0 = totals.get(1, 0), totals.get(0, 0)
    share = (all1 + 0.5) / (all1 + all0 + 1)
    none = np.zeros(0)
    if not all1 or not all0:
        return Model([], none, none, frozenset(), none, share)
    terms, exact = lexicon(taught, all1, all0)
    met = taught.select("text", "toxic").mapInArrow(lambda x: _hit_counts(x, terms), "term int, word string, toxic long, n long")
    met = met.groupBy("term", "word").agg(*(F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (1, 0)))
    # A word that is met often speaks for itself, not for what else resembles the term.
    met = stored(met.withColumn("harmless", (F.col("n1") + F.col("n0") >= LEAST_ROWS) & (_odds(all1, all0) < LEAST_FUZZY)), "met")
    near = np.zeros((len(terms), 2))
    for r in met.where("NOT harmless").groupBy("term").agg(F.sum("n0"), F.sum("n1")).collect():
        near[r["term"]] = r[1:]
    # An unseen misspelling counts half of its term; seen ones by what they were seen in.
    seen = _log_odds(near[:, 1], near[:, 0], all1, all0)
    trust = near.sum(axis=1) / (near.sum(axis=1) + 3) if len(terms) else none
    fuzzy = np.clip(trust * seen + (1 - trust) * 0.5 * exact, 0, None) if len(terms) else none
    loose = [n for n in range(len(terms)) if n not in _exact_only(fuzzy)]
    harmless = frozenset(r["word"] for r in met.where(F.col("harmless") & F.col("term").isin(loose)).select("word").collect())
    share_drawn = min(1.0, FIT_ROWS / (all1 + all0))
    drawn = taught.where(F.pmod("draw", F.lit(1_000_000)) < round(share_drawn * 1_000_000)).select("text", "toxic")
    rows = drawn.mapInArrow(lambda x: _feature_rows(x, terms, exact, fuzzy, harmless), "x array<double>, toxic int").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    return Model(terms, exact, fuzzy, harmless, fitted(x, y) if 0 < y.sum() < len(y) else none, share)


def _scored(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scanner = model.scanner()
    for batch in batches:
        scores = [model.score(scanner, t.as_py() or "") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(lambda x: _scored(x, model), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns they came with, in one pass after learning."""
    from pyspark.sql.pandas.types import to_arrow_schema

    model = learn(docs.select("doc_id", "text"), labels)
    place = docs.columns.index("text")
    schema = to_arrow_schema(docs.schema)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = model.scanner()
        for batch in batches:
            keep = [model.score(scanner, t.as_py() or "") < THRESHOLD for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns, schema=schema)

    return docs.mapInArrow(kept, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scores(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
