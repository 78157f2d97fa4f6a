"""Near-duplicates, toxicity, exact search, chat threads and the pipeline, against brute force."""

from __future__ import annotations

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from vacantia.llm import chat_format, exact_topk, near_dups, secret_scan, shared, toxicity, words
from vacantia.llm.shared import smallest_labels


def shingle_set(text, width):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)} if len(found) >= width else ({tuple(found)} if found else set())


def brute_components(rows, width, percent=80):
    """Smallest doc_id reachable, all pairs compared; rows with one doc_id are one document."""
    sets = [(d, shingle_set(t, width)) for d, t in rows if d is not None]
    label = {d: d for d, _ in sets}

    def root(x):
        return x if label[x] == x else root(label[x])

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(a), root(b)))
            label[b] = a
    return {d: root(d) for d, _ in sets}


@pytest.fixture(scope="module")
def copies():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([4, 12, 60, 150]))]
        for _ in range(draw.choice([1, 2, 5, 25])):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 8))):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            rows.append((draw.randint(0, 10**6), " ".join(text)))
    rows += [(rows[3][0], rows[40][1]), rows[5], rows[5]]  # one doc_id with two texts; a repeated row
    return rows


def test_word_hashes_follow_words(monkeypatch, odd_rows):
    texts = [(t or "") for _, t in odd_rows]
    for width in (1, 2, 5):
        assert [len(words.shingles(t.encode(), width)) for t in texts] == [len(shingle_set(t, width)) for t in texts]
    whole = [words.word_hashes(t.encode()).tolist() for t in texts]
    monkeypatch.setattr(words, "CHUNK", 32)
    monkeypatch.setattr(words, "_POWERS", [])
    assert [words.word_hashes(t.encode()).tolist() for t in texts] == whole
    assert words.shingles(b"A b\tC", 2).tolist() == words.shingles(b"a B\n\nc ", 2).tolist()


def test_chunks_meet_within_the_guaranteed_distance():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 16, near_dups.PLACES, dtype=np.uint16)
    for _ in range(50):
        other = base.copy()
        changed = draw.choice(near_dups.PLACES, near_dups.CHUNKS * (near_dups.ERRORS + 1) - 1, replace=False)
        other[changed] ^= np.uint16(1)
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([base.tobytes(), other.tobytes()])], ["doc", "signature"])
        entries = [set(), set()]
        for out in near_dups._entries([batch]):
            for entry, doc in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                entries[doc - 1].add(entry)
        assert entries[0] & entries[1]


@pytest.mark.parametrize(("width", "broadcast"), [(2, 1000), (5, 0)])
def test_components_equal_brute_force(monkeypatch, docs_of, odd_rows, copies, width, broadcast):
    monkeypatch.setattr(near_dups, "BROADCAST_ROWS", broadcast)
    rows = copies + [(d if d is None else d + 2 * 10**6, t) for d, t in odd_rows]
    expected = brute_components(rows, width)
    got = near_dups.components(docs_of(rows), width).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert sorted(r["n_shingles"] for r in got) == sorted(len(shingle_set(t, width)) for _, t in rows)
    docs = docs_of(rows)
    kept = near_dups.one_of_each(docs, width=width)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([str(d) for d in set(expected.values())] + ["None"])


def test_compared_pairs_grow_with_the_copies_not_with_their_square(monkeypatch, docs_of):
    """Near copies of one text, many of them too far from it: far fewer pairs are compared than there are, and no link is lost."""
    draw = random.Random(9)
    base = [f"b{i}" for i in range(75)]
    rows = []
    for n in range(320):
        text = list(base)
        for _ in range(draw.randint(0, 14)):
            text[draw.randrange(len(text))] = f"e{draw.randrange(3000)}"
        rows.append((n, " ".join(text)))
    counts = {}
    for n in (160, 320):
        made = []

        def stored(df, name, made=made):
            out = shared.stored(df, name)
            made.append(out.count() if name == "compared" else 0)
            return out

        monkeypatch.setattr(near_dups, "stored", stored)
        got = {r["doc_id"]: r["component_id"] for r in near_dups.components(docs_of(rows[:n]), 2).collect()}
        assert got == brute_components(rows[:n], 2)
        counts[n] = sum(made)
    assert counts[320] < 8 * 320 and counts[320] < 3 * counts[160]


def test_members_of_one_component_are_not_entered_again(monkeypatch, docs_of):
    """Near copies with changes from few words, linked in chains or near the original: what only they share gives no place to meet."""
    draw = random.Random(4)
    base, rows = [f"b{i}" for i in range(75)], []

    def changed(text, n):
        text = list(text)
        for at in draw.sample(range(len(text)), n):
            text[at] = f"e{draw.randrange(5)}"
        return text

    for n in range(60):
        near = changed(base, draw.randint(0, 5))
        rows += [(4 * n, " ".join(near)), (4 * n + 1, " ".join(changed(near, 3)))]
    rows.append((1000, " ".join(changed(base, 12))))
    entered = []

    def stored(df, name):
        out = shared.stored(df, name)
        entered.append(out.count() if name == "entered" else 0)
        return out

    monkeypatch.setattr(near_dups, "stored", stored)
    got = {r["doc_id"]: r["component_id"] for r in near_dups.components(docs_of(rows), 2).collect()}
    assert got == brute_components(rows, 2)
    assert sum(entered) < 80 * len(rows)


def test_places_to_meet_hold_several_components(monkeypatch, docs_of):
    """Members that are linked by now are left out of the table of places before it is stored, and no link is lost."""
    draw = random.Random(9)
    base, rows, seen = [f"b{i}" for i in range(75)], [], []
    for n in range(160):
        text = list(base)
        for _ in range(draw.randint(0, 14)):
            text[draw.randrange(len(text))] = f"e{draw.randrange(300)}"
        rows.append((n, " ".join(text)))

    def stored(df, name):
        out = shared.stored(df, name)
        if name in ("meetings", "both"):
            seen.extend(out.groupBy("a", "token", "j", "k").agg({"part": "min", "role": "min"}).toDF(*"atjkpr").join(out.groupBy("a", "token", "j", "k").agg({"part": "max", "role": "max"}).toDF(*"atjkqs"), list("atjk")).collect())
        return out

    monkeypatch.setattr(near_dups, "stored", stored)
    got = {r["doc_id"]: r["component_id"] for r in near_dups.components(docs_of(rows), 2).collect()}
    assert got == brute_components(rows, 2)
    assert seen and all(r["p"] != r["q"] and r["r"] != r["s"] for r in seen)


def test_labels_of_stars_take_one_look(monkeypatch, spark):
    """Nodes that hang on their smallest one are found so at once; any number of nodes and tasks gives the same labels."""
    names = []
    whole = shared.stored
    monkeypatch.setattr(shared, "stored", lambda df, name: names.append(name) or whole(df, name))
    stars = spark.createDataFrame([(10 * s, 10 * s + i) for s in range(5) for i in range(1, 9)], "a long, b long")
    assert all(r["label"] == r["node"] // 10 * 10 for r in smallest_labels(stars).collect()) and names == ["links", "least"]
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "TASK_ROWS", 1)
    draw = random.Random(6)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)]
    label = list(range(60))
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    ends = {x for a, b in pairs if a != b for x in (a, b)}
    assert {(r["node"], r["label"]) for r in smallest_labels(spark.createDataFrame(pairs, "a long, b long")).collect()} == {(n, label[n]) for n in ends}


def test_similarities_below_those_of_the_chunks_are_refused(docs_of):
    with pytest.raises(ValueError):
        near_dups.components(docs_of([(1, "a b c d e"), (2, "a b c d f")]), 2, 75)


def test_no_documents_no_components(docs_of):
    assert near_dups.components(docs_of([])).count() == 0 and near_dups.components(docs_of([(1, ""), (2, None)])).count() == 2


def test_smallest_labels(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 107), (107, 103), (5, 5), (None, 3), (200, 300), (200, 300)]
    got = {r["node"]: r["label"] for r in smallest_labels(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 107: 100, 200: 200, 300: 200}
    assert smallest_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_lexicon_equals_edit_distance():
    terms = ["moron", "idiot", "worthless", "disgusting", "cad", "stup*", "moronic", "réeux*"]
    lexicon = toxicity.FuzzyLexicon(terms)
    draw = random.Random(2)
    tried = ["moron", "morron", "mron", "mroon", "cad", "cat", "worthles", "wxrthless", "disgustng", "dsgustng", "dsgstng", "stupid", "stup", "stpid", "réeuxabc", "réuxabc", "xidiot", "iidiot", "idio", "idi", ""]
    tried += ["".join(draw.choice("moridt") for _ in range(draw.randint(3, 7))) for _ in range(300)]
    for word in tried:
        options = []
        for n, term in enumerate(terms):
            bare = term.rstrip("*")
            e = min(distance(word[:k], bare) for k in range(len(word) + 1)) if term.endswith("*") else distance(word, bare)
            if e <= toxicity.edits(bare):
                options.append((e, n))
        found = lexicon.match(word)
        assert (found is None) == (not options), word
        if found:
            assert found[1] == min(options)[0], (word, found, options)


def test_context_tells_quotation_from_abuse():
    scanner = toxicity.Scanner(["moron"])
    abuse, quotation = (scanner.hits(t)[0][0][3] for t in ("you are such a moron!", 'the report said that the word "moron" was used'))
    assert abuse > 1 > quotation
    assert scanner.hits("m0ron")[0][0][1:3] == (0, 0) and scanner.hits("morron")[0][0][2] == 1 and scanner.hits("")[0] == []


def test_quotations_of_any_length_and_nothing_between_them():
    scanner = toxicity.Scanner(["moron"])
    filler = "and many more words of no weight " * 5

    def score(text):
        return scanner.hits(text)[0][0][3]

    for left, right in ('""', "“”", "„“", "«»", "»«", "‘’"):
        assert score(f"{left}{filler}moron {filler}{right}") == score(f"a {left}b\nmoron\nc{right} d") == 0.4
        assert score(f"{left}hi{right} a moron {left}bye{right}") == score(f"a {left}b moron c") == score(f"a moron {left}b{right}") == 1.0
    assert score("“b moron c»") == 1.0 and score('„a "moron" b“') == 0.4 and score("‘it’s a moron’") == 0.4 and score("it’s a moron, isn’t it") == 1.0
    assert score('a 5" moron "bye" x') == 1.0 and score('an "unclosed one and "hi" a moron "bye"') == 1.0


@pytest.fixture(scope="module")
def speech():
    draw = random.Random(7)
    plain, bad = [f"plain{i}word" for i in range(200)], ["moron", "idiot", "scumbag", "pathetic", "worthless"]
    rows, marks = [], []
    for i in range(600):
        text, toxic = [draw.choice(plain) for _ in range(draw.randint(10, 60))], i % 5 == 0
        for _ in range(3 * toxic):
            term = draw.choice(bad)
            text.insert(draw.randrange(len(text)), term if draw.random() < 0.8 else term[:2] + "x" + term[2:])
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    return rows, marks


def test_toxicity_learns_from_allowed_rows_and_finds_the_rest(spark, docs_of, odd_rows, speech):
    rows, marks = speech
    labels = spark.createDataFrame([(d, 1, t) for d, t in marks] + [(None, 1, 1), (3, 1, None), (10**7, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows + [(d if d is None else d + 1000, t) for d, t in odd_rows])
    model = toxicity.learn(docs, labels)
    got = toxicity.scores(docs, model).collect()
    truth, seen = dict(marks), {}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        seen[r["doc_id"]] = r
    import zlib

    assert all(r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, r in seen.items())
    assert sum(seen[d]["predicted"] == t for d, t in truth.items() if seen[d]["held_out"]) >= 0.97 * sum(seen[d]["held_out"] for d in truth)
    # Labels of held-out rows change nothing.
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    again = toxicity.learn(docs, turned)
    assert again.terms == model.terms and np.array_equal(again.weights, model.weights)
    civil = toxicity.civil(docs, labels)
    assert civil.columns == docs.columns and civil.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_finds_misspellings_at_every_letter(spark, docs_of):
    """Misspellings that no labelled row holds: a letter left out, doubled, replaced, or swapped with the next, at each position."""
    draw = random.Random(11)
    plain, bad = [f"plain{i}word" for i in range(200)], ["moron", "idiot", "scum", "stupid", "pathetic", "worthless"]
    rows = []
    for i in range(600):
        text = [draw.choice(plain) for _ in range(30)] + draw.choices(bad, k=3 * (i % 5 == 0))
        text += ["oron", "scumm"] * (i % 3 == 0)  # words of their own, which say nothing
        rows.append((i, " ".join(draw.sample(text, len(text)))))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs_of(rows), labels)
    assert set(bad) <= set(model.terms)
    scanner = model.scanner()
    for term in bad:
        for i in range(len(term)):
            for wrong in {term[:i] + term[i + 1 :], term[:i] + term[i] + term[i:], f"{term[:i]}q{term[i + 1 :]}", term[:i] + term[i : i + 2][::-1] + term[i + 2 :]} - {term, "oron", "scumm"}:
                hits, _ = scanner.hits(f"plain1word {wrong} plain2word")
                assert len(hits) == 1 and model.terms[hits[0][1]].rstrip("*") == term[: len(model.terms[hits[0][1]].rstrip("*"))], (term, wrong)
                assert model.score(scanner, f"plain1word {wrong} {wrong} plain2word") > model.score(scanner, "plain1word plain2word"), (term, wrong)
    assert scanner.hits("oron scumm")[0] == []


def test_toxicity_counts_texts_once_and_keeps_all_terms(spark, docs_of, speech):
    """Copies of one long text teach nothing by their number, and no number of significant words displaces another."""
    rows, marks = list(speech[0]), list(speech[1])
    copied = " ".join(f"{a}{b}copied" for a in "bcdfghjklmnpqrstvwxz" for b in "abcdefghijklmnopqrstuvwxyz")
    many = [a + b + c for a in "bcdfgh" for b in "aeiouyàéèüöä" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows += [(10_000 + i, copied) for i in range(300)] + [(20_000 + i, " ".join([*many, f"own{i}"])) for i in range(60)]
    marks += [(d, 1) for d, _ in rows[len(marks) :]]
    model = toxicity.learn(docs_of(rows), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert len(many) > 1_500 and {*many, "moron", "idiot", "scumbag", "pathetic", "worthless"} <= set(model.terms)
    assert not set(copied.split()) & set(model.terms)


def test_toxicity_learns_words_of_any_length(monkeypatch, spark, docs_of):
    monkeypatch.setattr(toxicity, "HELD_LETTERS", 500)  # counts are handed on after every few texts
    draw = random.Random(12)
    plain = [f"plain{i}word" for i in range(100)]
    long, longer = "verachtenswerterunmenschenhaufenvondiebenundluegnern", "字" * 300
    rows = [(i, " ".join([*draw.sample(plain, 10), *([long, longer] if i % 5 == 0 else [])])) for i in range(300)]
    model = toxicity.learn(docs_of(rows), spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert longer in model.terms
    scanner = model.scanner()
    clean = model.score(scanner, "plain1word plain2word plain3word")
    assert all(model.score(scanner, f"plain1word {w} plain2word") > clean for w in (long, longer, longer[:-1], longer[:20] + "x" + longer[20:]))


def test_toxicity_without_labels(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scores(docs_of([(1, "a"), (2, None)]), toxicity.learn(docs_of([(1, "a")]), labels)).collect()
    assert [(r["score"], r["predicted"]) for r in got] == [(0.5, 0)] * 2
    assert toxicity.scores(docs_of([]), toxicity.learn(docs_of([]), labels)).count() == 0


def test_exact_topk_equals_sql(monkeypatch, spark, same):
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.0, 0.5, -0.25, draw.uniform(-1, 1)]) for _ in range(6)], 1, "x") for i in range(0, 300)]
    rows += [(50, [1.0] * 6, 1, "x"), (50, [1.0] * 6, 1, "x"), (7, [1.0] * 6, 1, "x"), (400, None, 1, "x"), (401, [None, 1.0], 1, "x"), (402, [float("nan")], 1, "x"), (403, [float("inf")], 1, "x"),
             (404, [], 1, "x"), (450, [0.5], 1, "x"), (None, [9.0] * 6, 1, "x"), (-50, [0.1] * 9, 1, "x"), (405, [1e20], 1, "x"),
             (406, [9e6, 1.0, 1.0, 1.0], 1, "x"), (407, [8e6] * 4, 1, "x"), (500, [8e6] * 4, 1, "x"), (550, [3e8, -3e8, 3e8], 1, "x"), (408, [3e8, -3e8, 3e8], 1, "x"), (409, [3e8, -3e8, 3.1e8], 1, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string").repartition(3)
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(exact_topk, "BLOCK_WEIGHTS", 150)
    held = exact_topk.stored(exact_topk.scaled(vectors), "vectors")
    same(exact_topk.top_k(held, held.where("vec_id % 50 = 0"), 5), exact_topk.oracle("vectors"), vectors=vectors)
    few = held.where("vec_id IN (0, 1, 2)")
    assert exact_topk.top_k(few, few.where("vec_id % 50 = 0"), 5).count() == 2
    empty = held.limit(0)
    assert exact_topk.top_k(empty, empty, 5).count() == 0


def test_topk_of_any_finite_weights_is_exact(spark):
    draw = random.Random(5)
    sizes = [1.0, 1e6, 8e6, 1e15, 3e18, 1e40, 1e300]
    rows = [(i, [draw.choice([-1, 1]) * draw.choice(sizes) * draw.choice([0, 1, 0.7]) for _ in range(draw.randint(0, 5))]) for i in range(120)]
    rows += [(150, [1e200, 1e-3]), (151, [1e200, 1e-3]), (152, [1e200, -1e-3]), (153, [2e306]), (154, [1.7e308])]
    kept = {i: [math.floor(256 * x) for x in v] for i, v in rows if all(math.isfinite(256 * x) for x in v)}
    expected = []
    for q in (i for i in kept if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(kept[q], v, strict=False)), i) for i, v in kept.items() if i != q)
        expected += [(q, r, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scores[:7], 1)]
    held = exact_topk.stored(exact_topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)), "vectors")
    assert sorted(map(tuple, exact_topk.top_k(held, held.where("vec_id % 50 = 0"), 7).collect())) == sorted(expected)


CHAT = [
    (1, 0, "user", "Hello there.\n\nHow do I bake\nbread at home?"), (1, 1, "assistant", "Mix flour and water.\nWait an hour."), (1, 2, "user", "A new topic: cats"),
    (1, 3, "assistant", "On Monday, user wrote:\n> How do I  BAKE\n> bread at home?\n\nSee above."), (1, 4, "user", "> > How do I bake bread at home?\n> Mix flour and water.\n> Wait an hour.\nThanks!"), (1, 5, "assistant", "> cats\nno such line"),
    (1, 6, "assistant", ">A new topic: cats\nThey purr."), (1, 7, "user", "> They purr.\n>> A new topic: cats\nYes.\r\n> nothing like this"), (2, 0, "user", "> Hello there.\nother conversation"), (2, 1, None, None), (2, 1, "user", ""), (2, 2, "user", "x > y\n  >only quote"),
    (3, 5, "user", "same"), (3, 6, "user", "same"), (3, 7, "user", "> same"), (3, 4, "user", "> same"), (None, 1, "user", "same"), (None, 2, "user", "> same"), (4, None, "user", "late"), (4, 0, "user", "early"), (3, 5, "user", "same"),
]


def test_chat_threads_equal_sql(spark, same):
    chat = spark.createDataFrame([(*c, "x") for c in CHAT], "conv_id long, turn long, role string, text string, position string").repartition(3)
    got = chat_format.threaded(chat)
    same(got.drop("body"), chat_format.oracle("chat"), chat=chat)
    first = {r["turn"]: r for r in got.where("conv_id = 1").collect()}
    assert {t: r["parent_turn"] for t, r in first.items()} == {0: None, 1: None, 2: None, 3: 0, 4: 1, 5: None, 6: 2, 7: 6}
    assert first[4]["body"] == "Thanks!" and first[3]["body"] == "See above." and first[7]["thread_turn"] == 2
    assert [t for t, _ in sorted(first.items(), key=lambda x: x[1]["position"])] == [0, 3, 1, 4, 2, 6, 7, 5]
    assert chat_format.threaded(chat.limit(0)).count() == 0


def test_pipeline_stages_take_effect(spark, docs_of, tmp_path, speech):
    rows, marks = speech
    sentence = "the old house of the man is near to it and we went with a friend for a walk on the hill " * 2
    texts = [(d, f"{t} {sentence}" if d % 2 else f"{sentence} {t}") for d, t in rows[:200]]
    texts = [(d, t + " " + " ".join(f"{d}tail{i}" for i in range(60))) for d, t in texts]
    texts += [(1001, texts[1][1]), (1002, texts[1][1] + " more"), (1003, "short"), (1004, None), (1005, texts[3][1] + " secret = abcdefgh and " + " ".join(f"own{i}" for i in range(80)))]
    docs_of(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in marks[:200]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert seen[name].columns == docs.columns
            docs = seen[name]
    ids = {n: {r["doc_id"] for r in f.collect()} for n, f in seen.items()}
    assert not ids["quality"] & {1003, 1004} and {0, 1, 1001, 1002, 1005} <= ids["quality"]
    toxic = {d for d, t in marks[:200] if t}
    assert len(ids["toxicity"] & toxic) <= 2 and {d for d, t in marks[:200] if not t} <= ids["toxicity"]
    left = {r["doc_id"]: r["text"] for r in seen["toxicity"].collect()}
    assert ids["near_duplicates"] == set(brute_components(list(left.items()), 5).values()) and not ids["near_duplicates"] & {1001, 1002}
    assert ids["secrets"] == ids["near_duplicates"] == ids["packing"]
    assert all("[assign]" in r["text"] for r in seen["secrets"].where("doc_id = 1005").collect()) and secret_scan.scan(seen["secrets"]).where("spans <> ''").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0] == seen["packing"].agg({"length": "sum"}).first()[0]
