"""Phrase and proximity matches against plain search."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from vacantia.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def windows(items, width):
    out = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            out.setdefault(str(item), set()).update(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))
    return out


def plain(docs, items, width=10):
    out, by_item = [], windows(items, width)
    for doc_id, text in docs:
        w, hit, held = words(text), set(), set()
        for item, phrases in by_item.items():
            for phrase in phrases:
                for i in range(len(w) - len(phrase) + 1):
                    if tuple(w[i : i + len(phrase)]) == phrase:
                        hit.update(range(i, i + len(phrase)))
                        held.add(item)
        out.append((doc_id, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def items_of(spark, rows):
    full = [(i, t, "x", "x", "x") for i, t in rows]
    return spark.createDataFrame(full, "item_id long, text string, terms string, phrase string, doc_id string")


def columns(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def mixed():
    draw = random.Random(4)
    vocabulary = ["the", "of", "A", "naïve", "x1", "日本語", "b", "c"]
    text = lambda n: draw.choice([" ", "\n", " - ", "\u007f"]).join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.choice([1, 2, 4, 6, 9, 14]))) for i in range(12)] + [(3, "one more text of item three"), (None, "the of"), (20, None), (21, " - "), (22, "zebra zebra zebra")]
    docs = [(i, text(draw.randint(0, 60))) for i in range(40)]
    docs += [(50, items[5][1] + " the " + items[5][1].upper()), (51, "zebra zebra zebra zebra"), (51, "zebra zebra"), (52, (items[3][1] + " z ") * 300), (53, "the " * 500)]
    return docs, items


@pytest.mark.parametrize(("width", "shard"), [(4, 40), (10, 1 << 20), (1, 7)])
def test_hits_equal_plain_search(spark, docs_of, odd_rows, mixed, width, shard, monkeypatch):
    docs, items = mixed
    docs = docs + odd_rows
    monkeypatch.setattr(D, "BLOCK", 9)  # several blocks of phrases
    monkeypatch.setattr(D, "SHARD_WORDS", shard)
    assert columns(D.contamination(docs_of(docs), items_of(spark, items), width)) == plain(docs, items, width)


def test_candidates_are_taken_in_slices(spark, docs_of, mixed):
    docs, items = mixed
    ix = D.index(docs_of(docs), 100).collect()
    numbered, _ = D.phrases(items_of(spark, items), 4)
    rows = numbered.collect()
    import numpy as np

    block = D.Block(np.array([r["phrase"] for r in rows]), [bytes(r["terms"]) for r in rows])
    for within in (None, 6):
        for row in ix:
            shard = D.Shard(row.asDict())
            D.SLICE, kept = 5, D.SLICE
            try:
                cut = block.found(shard, within)
            finally:
                D.SLICE = kept
            assert sorted(zip(*(x.tolist() for x in cut), strict=True)) == sorted(zip(*(x.tolist() for x in block.found(shard, within)), strict=True))


@pytest.mark.parametrize("within", [1, 4, 8])
def test_proximity_equals_plain_search(spark, docs_of, mixed, within):
    docs, items = mixed
    docs = [d for d in docs if d[0] not in (52, 53)]
    numbered, holders = D.phrases(items_of(spark, items), 4)
    ix = D.index(docs_of(docs), 60)
    found = D.matches(ix, numbered, within)
    at = {(r["shard"], i): d for r in ix.collect() for i, d in enumerate(r["doc_ids"])}
    held = {}
    for r in holders.collect():
        held.setdefault(r["phrase"], set()).add(r["item_id"])
    got = sorted({(at[r["shard"], r["place"]], item) for r in found.collect() for p in r["phrases"] for item in held[p]})
    want = set()
    for doc_id, text in docs:
        w = words(text)
        stretches = [set(w[i : i + within]) for i in range(len(w))]
        want |= {(doc_id, item) for item, phrases in windows(items, 4).items() if any(set(p) <= s for p in phrases for s in stretches)}
    assert got == sorted(want)


def test_empty_tables(spark, docs_of):
    none = items_of(spark, [])
    assert D.contamination(docs_of([]), items_of(spark, [(1, "a b")])).collect() == []
    assert columns(D.contamination(docs_of([(1, "a b")]), none)) == plain([(1, "a b")], [])


def test_query_equals_its_sql(spark, docs_of, mixed, same):
    docs, items = mixed
    d, i = docs_of(docs), items_of(spark, items)
    same(D.contamination(d, i), D.oracle("d", "i"), d=d, i=i)
