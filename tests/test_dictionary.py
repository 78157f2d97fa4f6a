"""Dictionary matching as a join, against a plain search of every term in every text."""

import re

from pyspark.sql import functions as F

from vacantia import lexicons as L
from vacantia.operators import dictionary as D, registry as P


def occurs(term, text):
    """The rule itself: a term between letters or digits stands between borders, any other stands anywhere."""
    term = term.strip().lower()
    if not term:
        return False
    word = lambda c: c.isalnum() or c == "_"
    bordered = term[0].isalnum() and term[-1].isalnum()
    for place in range(len(text) - len(term) + 1):
        if text.startswith(term, place):
            after = place + len(term)
            if not bordered or not (place and word(text[place - 1]) or after < len(text) and word(text[after])):
                return True
    return False


TEXTS = [
    (1, "C++ and abc++ beside c#, .NET; node.js/TypeScript"), (2, "javascript is not java_script, nor Java-Script"), (3, "machine  learning, machine learning"),
    (4, None), (5, ""), (6, "שפות: פייתון, C++"), (7, "ci/cd ci-cd ci cd cd/ci"), (8, "a.b.c a.b a.b.c.d 3.11 13.11"), (9, "learn machine learn machine learning"),
    (10, "++c++ +c+ _x_ x_ _x"), (11, "word " * 3_000 + "last phrase"), (7, "kotlin"), (12, "𝒳 c++𝒳 é é! café"),
]
TERMS = [
    ("c", "c++"), ("c", "C#"), ("net", ".net"), ("js", "node.js"), ("js", "javascript"), ("java", "java"), ("ml", "machine learning"), ("ml2", " Machine Learning "),
    ("ci", "ci/cd"), ("ab", "a.b.c"), ("v", "3.11"), ("plus", "+"), ("under", "_x"), ("under2", "x_"), ("end", "last phrase"), ("cafe", "café"), ("e", "é!"),
    ("none", ""), ("none", None), (None, "word"), ("py", "פייתון"), ("rep", "machine learn machine"), ("kt", "kotlin"), ("c", "c++"),
]


def frames(spark):
    texts = spark.createDataFrame(TEXTS, "id int, text string").withColumns({"key": F.lit("clash"), "term": F.lit("clash"), "way": F.lit(0)})
    terms = spark.createDataFrame(TERMS, "key string, term string").withColumns({"id": F.lit(1), "text": F.lit("clash"), "size": F.lit("clash")})
    return texts, terms


def test_equals_plain_search(spark):
    texts, terms = frames(spark)
    found = [tuple(r) for r in D.term_keys(texts, "id", "text", terms).collect()]
    expected = {(i, key) for i, text in TEXTS for key, term in TERMS if key and term and text and occurs(term, text.lower())}
    assert len(found) == len(set(found)) and set(found) == expected
    assert {(1, "c"), (8, "ab"), (11, "end"), (7, "kt"), (7, "ci")} <= expected and (2, "c") not in expected


def test_texts_without_first_words_are_passed_over(spark, monkeypatch):
    """The same keys with and without the starts of the terms; one start per first word, none beyond the bound."""
    texts, terms = frames(spark)
    expected = {(i, key) for i, text in TEXTS for key, term in TERMS if key and term and text and occurs(term, text.lower())}
    starts = {(way, size): found for way, size, found in D._starts(D.prepared(terms))}
    assert starts[D.WORDS, 2] == ["3", "ci", "last", "machine", "node"] and starts[D.WORDS, 1] is None and starts[D.TO_SYMBOL, 3] == ["++"]
    monkeypatch.setattr(D, "FIRST_WORDS", 2)
    monkeypatch.setattr(D, "MARKS", 1)
    starts = {(way, size): found for way, size, found in D._starts(D.prepared(terms))}
    assert starts[D.WORDS, 2] is None and starts[D.WORDS, 3] == ["a", "machine"]
    assert {tuple(r) for r in D.term_keys(texts, "id", "text", terms).collect()} == expected


def test_empty_tables(spark):
    texts, terms = frames(spark)
    assert D.term_keys(texts, "id", "text", terms.limit(0)).collect() == []
    assert D.term_keys(texts.limit(0), "id", "text", terms).collect() == []
    assert D.term_keys(texts, "id", "text", terms.limit(0)).columns == ["id", "key"]


def test_fifty_thousand_terms(spark):
    """Far beyond what could stand in expressions; a frequent term, rare ones, and phrases that share their first word."""
    terms = spark.range(50_000).selectExpr("concat('k', id) AS key", "CASE id % 4 WHEN 0 THEN concat('term', id) WHEN 1 THEN concat('big data ', id) WHEN 2 THEN concat('x', id, '+') ELSE concat('.dot', id) END AS term")
    terms = terms.union(spark.createDataFrame([("everywhere", "common")], "key string, term string"))
    texts = spark.range(300).selectExpr("id", "concat('common Term', id * 4, ' and BIG data ', id * 4 + 1, '; x', id * 4 + 2, '++ .dot', id * 4 + 3, 'a') AS text")
    found = {tuple(r) for r in D.term_keys(texts, "id", "text", terms).collect()}
    # Stretches that start at a symbol may be followed by anything: ".dot7" is found in ".dot71a".
    dots = {(i, f"k{n}") for i in range(300) for n in range(3, 50_000, 4) if str(i * 4 + 3).startswith(str(n))}
    expected = {(i, k) for i in range(300) for k in ("everywhere", f"k{i * 4}", f"k{i * 4 + 1}", f"k{i * 4 + 2}")} | dots
    assert found == expected


def test_skill_table(spark):
    from vacantia.functions import features as X

    texts = spark.createDataFrame([(1, "Python, C++ and SQL; React.js"), (2, "Docker/Kubernetes with CI/CD"), (3, "nothing here")], "id int, text string")
    joined = {tuple(r) for r in D.term_keys(texts, "id", "text", P.lexicon_frame(spark, L.SKILLS)).collect()}
    native = {(r[0], k) for r in texts.select("id", X.skills_extract(F.col("text"), L.SKILLS)).collect() for k in r[1]}
    assert joined == native and joined
