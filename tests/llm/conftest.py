from __future__ import annotations

import duckdb
import pytest

EXTRA = ", ".join(f"{c} string" for c in ("kept", "spans", "score", "n_words", "component_id", "counts", "place", "entry"))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A frame like ``documents`` from (doc_id, text) pairs, with other columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "src0", len(t or ""), *["x"] * 8) for i, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, repeated, very long and oddly spaced texts, and a null doc_id."""
    word = "the quick brown fox and a lazy dog of the house with it "
    return [
        (1, ""), (2, None), (None, word * 12), (3, word * 3000), (4, "one two"), (4, "one two"), (5, " \t\n\x0b\x0c\r "), (6, "one two"),
        (7, "a\u00a0b  c\u3000d\x1c e\u2028f"), (8, "word"), (9, "don't  'stop\n\n 's  'll \t x … ,,…"), (10, "x" * 70_000), (11, "日本語 🎉 e\u0301 É İ ß"),
    ]


@pytest.fixture
def same(spark):
    """Compare a frame with a DuckDB text over a Spark frame that is registered under ``table``."""

    def rows(columns, data):
        order = sorted(columns)
        return sorted([tuple(None if v is None else str(v) for v in (dict(zip(columns, r, strict=True))[c] for c in order)) for r in data], key=repr)

    def check(got, sql, **tables):
        with duckdb.connect() as db:
            for name, frame in tables.items():
                db.register(name, frame.toArrow())
            found = db.execute(sql)
            columns = [d[0] for d in found.description]
            assert sorted(columns) == sorted(got.columns)
            assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, found.fetchall())

    return check
