"""Spelling groups against all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vacantia.llm import spelling as S

LOW = str.maketrans(S.UPPER, S.LOWER)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            out[run] += len(run) >= 7
    return {w: n for w, n in out.items() if n >= 2}


def plain(often):
    forms, near = {}, {}
    for w, n in often.items():
        others = sorted((v for v in often if abs(len(v) - len(w)) <= 1 and v != w and one_edit(v, w)), key=lambda v: (-often[v], v))
        near[w] = len(others)
        if others and often[others[0]] >= 10 * n:
            forms[w] = others[0]

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return sorted((w, forms.get(w), root(w), n, near[w], often.get(forms.get(w))) for w, n in often.items())


def columns(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=4, max_size=5), min_size=2, max_size=90, unique=True), st.integers(0, 4))
def test_every_near_pair_is_found_in_one_window(words, cut):
    words = [w for w in words if len(w) in (4, 5)]
    lengths = np.array([len(w) for w in words])
    found = []
    for s, t in ((0, cut), (cut, 4)):
        if s < t:
            found += zip(*(v.tolist() for v in S.near_pairs(S._codes(words, 5), lengths, s, t)), strict=True)
    want = [(x, y) for x, a in enumerate(words) for y, b in enumerate(words) if len(a) == 4 and one_edit(a, b)]
    assert sorted(found) == want


@pytest.fixture(scope="module")
def often():
    draw = random.Random(3)
    out = {}
    for stem in ["standard", "abcdefg", "naïvement", "aaaaaaaa", "a" * 300, "internationalisation"]:
        out[stem] = 5000
        for _ in range(60):
            i, c = draw.randrange(len(stem)), draw.choice("abcdeï")
            word = draw.choice([stem[:i] + stem[i + 1 :], stem[:i] + c + stem[i:], stem[:i] + c + stem[i + 1 :]])
            if len(word) >= 7:
                out.setdefault(word, draw.choice([2, 3, 70, 400]))
                i = draw.randrange(len(word))
                if len(word) > 7:
                    out.setdefault(word[:i] + word[i + 1 :], draw.choice([2, 7]))
    return out


@pytest.mark.parametrize("group", [2_048, 20, 1])
def test_groups_equal_all_pairs(spark, often, group, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 16)
    monkeypatch.setattr(S, "CALL_ROWS", 100)
    words = spark.createDataFrame([(w, n) for w, n in often.items()], "word string, n long").repartition(3)
    assert columns(S.groups(words, group=group)) == plain(often)


def test_a_hot_stem_is_split(spark):
    """Words that differ only at their last four places: one group of each window but the last, until it is halved."""
    draw = random.Random(8)
    often = {"commonstem" + "".join(draw.choice("abcdefghij") for _ in range(4)): draw.choice([2, 30]) for _ in range(700)}
    words = spark.createDataFrame(list(often.items()), "word string, n long")
    groups = S._groups(words, 7, 100).groupBy("m", "s", "t", "key").count()
    assert groups.where("count > 100 AND t - s > 1").isEmpty()
    assert columns(S.groups(words, group=100)) == plain(often)


def test_counts_forms_and_roots_of_texts(spark, docs_of, odd_rows, same):
    draw = random.Random(6)
    vocabulary = ["standard", "Standart", "STANDARDS", "naïvement", "besonders", "besondere", "word", "a×b÷cdefg", "internationales"]
    rows = [(i, " ".join(draw.choices(vocabulary, [90, 3, 2, 40, 60, 2, 9, 5, 60], k=200))) for i in range(40)] + odd_rows
    docs = docs_of(rows)
    words = S.counted(docs)
    assert {r["word"]: r["n"] for r in words.collect()} == counted(rows)
    assert columns(S.groups(words)) == plain(counted(rows))
    same(S.groups(words), S.oracle("d"), d=docs)


def test_empty_tables(spark, docs_of):
    for rows in ([], [(1, None), (2, "")], [(1, "standard")]):
        assert S.groups(S.counted(docs_of(rows))).collect() == []
