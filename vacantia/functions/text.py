"""Text column functions: matching term tables, HTML to text, line clean-up, text quality."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from vacantia import lexicons as L

# Named entities that occur in board payloads, ampersand last.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
    ("&apos;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&bull;", "•"), ("&amp;", "&"),
)
LINE_KEY_EDGES = " .:–—-"
INVISIBLE = "(?![ -~])[\\u200b-\\u200f\\u202a-\\u202e\\u2060\\ufeff]"
# One literal character first, then the choice: the search passes all text between two of them without trying any branch.
MARKUP = r"(?s)<(?:!--.*?-->|[a-zA-Z/!?][^>]*>)"
# A lone ordinary blank needs no replacement.  The look-ahead passes printable ASCII by two range tests before any class look-up.
SPACES = r"(?![!-~]| [!-~])(?:[\s\p{Z}\x{85}]{2,}|[\s\p{Z}\x{85}&&[^ ]])"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def term_array(terms: Iterable[str]) -> Column:
    """The terms as one constant array.

    Term tables enter expressions as constants and are searched with higher-order functions: one small
    expression per table instead of one per term keeps plans short and quick to build.
    """
    return F.expr("array(" + ", ".join(sql_text(t) for t in terms) + ")")


def term_table(table: Mapping[str, Iterable[str]]) -> Column:
    """A term table as a constant ``array<struct<key, terms>>`` in table order."""
    rows = (f"named_struct('key', {sql_text(k)}, 'terms', array({', '.join(sql_text(t) for t in terms)}))" for k, terms in table.items())
    return F.expr("array(" + ", ".join(rows) + ")")


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True when any literal term occurs in ``text`` (plain substring search)."""
    return let(text, lambda t: F.exists(term_array(terms), lambda term: F.contains(t, term)))


def count_terms(text: Column, terms: Iterable[str]) -> Column:
    """Number of distinct terms of the table that occur in ``text``."""
    return let(text, lambda t: F.size(F.filter(term_array(terms), lambda term: F.contains(t, term))))


def bordered(term: str) -> bool:
    return term[:1].isalnum() and term[-1:].isalnum()


def quoted(term: str) -> str:
    """Literal regex for ``term``; spelt with escapes both Java and RE2 read the same way."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in term)


def has_term_column(text: Column, term: Column) -> Column:
    """:func:`has_term` for a term held in a column (user word lists)."""
    edge = r"[\p{L}\p{N}_]"
    literal = F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))
    pattern = F.concat(F.lit(f"(?<!{edge})"), literal, F.lit(f"(?!{edge})"))
    both_ends = term.rlike(r"^[\p{L}\p{N}](.*[\p{L}\p{N}])?$")
    return text.contains(term) & (~both_ends | F.regexp_like(text, pattern))


def matching_keys(text: Column, table: Mapping[str, Iterable[str]]) -> Column:
    """Sorted array of the table's keys that have a term in ``text`` (plain substring search)."""
    rows = term_table(dict(sorted(table.items())))
    return let(text, lambda t: F.filter(rows, lambda row: F.exists(row["terms"], lambda term: F.contains(t, term)))).getField("key")


def first_key(text: Column, table: Mapping[str, Iterable[str]]) -> Column:
    """First key (table order) with a term in ``text``, or null."""
    found = let(text, lambda t: F.filter(term_table(table), lambda row: F.exists(row["terms"], lambda term: F.contains(t, term))))
    return F.get(found, 0)["key"]


def matching_words(text: Column, table: Mapping[str, Iterable[str]]) -> Column:
    """Sorted array of the keys that have a term in the lower-case ``text``, not inside a longer word.

    Borders apply only when both ends of a term are alphanumeric.  The text is split into words once and
    intersected with the words the terms start with; only terms whose first word occurs (or that have no
    borders) are searched in the text itself, and the border test runs only where the term was found.
    """

    def variant(term: str) -> str:
        term = term.lower()
        word = re.findall(r"\w+", term)[0] if bordered(term) else None
        pattern = rf"(?<![\p{{L}}\p{{N}}_]){quoted(term)}(?![\p{{L}}\p{{N}}_])"
        return (f"named_struct('term', {sql_text(term)}, 'word', {sql_text(word) if word else 'cast(null as string)'}, "
                f"'whole', {str(word == term).lower()}, 'pattern', {sql_text(pattern)})")

    rows = F.expr("array(" + ", ".join(
        f"named_struct('key', {sql_text(k)}, 'variants', array({', '.join(variant(t) for t in terms)}))" for k, terms in sorted(table.items())) + ")")
    vocabulary = term_array(sorted({re.findall(r"\w+", t.lower())[0] for terms in table.values() for t in terms if bordered(t)}))

    def keys(pair: Column) -> Column:
        t, words = pair["text"], pair["words"]

        def occurs(v: Column) -> Column:
            return (F.when(v["word"].isNull(), F.contains(t, v["term"])).when(~F.array_contains(words, v["word"]), False).when(v["whole"], True)
                    .otherwise(F.contains(t, v["term"]) & F.regexp_like(t, v["pattern"])))

        return F.filter(rows, lambda row: F.exists(row["variants"], occurs)).getField("key")

    split = lambda t: F.struct(t.alias("text"), F.array_intersect(F.split(t, r"[^\p{L}\p{N}_]+"), vocabulary).alias("words"))
    return let(let(text, split), keys)


def truthy(value: Column) -> Column:
    """The string itself, or null when it is empty."""
    return F.when(F.length(value) > 0, value)


def squeeze(text: Column) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def trimmed(text: Column, edges: str) -> Column:
    """``text`` without ``edges`` at both ends; the trim walks the whole text, so it runs only where an end needs it."""
    needs = any_of(test(F.lit(c)) for c in edges for test in (text.startswith, text.endswith))
    return F.when(needs, F.btrim(text, F.lit(edges))).otherwise(text)


def unescape(text: Column) -> Column:
    plain = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    return F.when(text.contains("&"), plain).otherwise(text)


def drop_elements(html: Column, names: Iterable[str]) -> Column:
    pattern = "|".join(rf"{n}\b[^>]*>.*?</{n}\s*>" for n in names)
    return F.regexp_replace(html, f"(?is)<(?:{pattern})", " ")


def html_to_text(html: Column) -> Column:
    """Markup to a single line of text."""
    body = drop_elements(F.coalesce(html, F.lit("")), ("script", "style", "template"))
    return squeeze(let(F.regexp_replace(body, MARKUP, " "), unescape))


def line_key(line: Column) -> Column:
    return let(F.lower(line), lambda low: trimmed(low, LINE_KEY_EDGES))


def _strip_markup(text: Column) -> Column:
    """Unescaped text without elements that carry no posting text; each step runs only where it can change something."""

    def unslash(raw: Column) -> Column:
        plain = raw
        for escape, value in (("\\/", "/"), ("\\n", "\n"), ("\\r", "\n"), ("\\t", " ")):
            plain = F.replace(plain, F.lit(escape), F.lit(value))
        return F.when(raw.contains("\\"), plain).otherwise(raw)

    def untag(raw: Column) -> Column:
        body = drop_elements(raw, ("script", "style", "noscript", "svg", "form", "nav", "footer"))
        return F.when(raw.contains("<"), F.regexp_replace(body, MARKUP, "\n")).otherwise(raw)

    body = let(let(let(F.coalesce(text, F.lit("")), unescape), unslash), untag)
    return F.regexp_replace(let(body, unescape), INVISIBLE, "")


def clean_text(text: Column) -> Column:
    """Readable lines of a posting in first-seen order: no markup, no call-to-action lines, no repeats."""
    lines = F.transform(F.split(_strip_markup(text), "[\\r\\n\\u000b\\u000c\\u0085\\u2028\\u2029]"),
                        lambda x: let(squeeze(x), lambda line: trimmed(line, " |")))
    noise = F.array(*[F.lit(t) for t in L.GENERIC_DESCRIPTIONS])
    pairs = F.filter(F.transform(lines, lambda x: F.struct(x.alias("line"), line_key(x).alias("key"))),
                     lambda p: (p["line"] != "") & ~F.array_contains(noise, p["key"]))

    def first_of_each(rows: Column) -> Column:
        """First row per key, in order: sorted by key and place, a row stands behind those of its key that came before it."""
        ordered = F.array_sort(F.transform(rows, lambda p, i: F.struct(p["key"].alias("key"), i.alias("place"), p["line"].alias("line"))))
        heads = let(ordered, lambda o: F.filter(o, lambda p, i: (i == 0) | (p["key"] != F.get(o, i - 1)["key"])))
        return F.array_sort(F.transform(heads, lambda p: F.struct(p["place"].alias("place"), p["line"].alias("line")))).getField("line")

    def keep_first(rows: Column) -> Column:
        repeats = let(rows.getField("key"), lambda keys: F.size(F.array_distinct(keys)) < F.size(keys))
        return F.when(repeats, first_of_each(rows)).otherwise(rows.getField("line"))

    return F.array_join(let(pairs, keep_first), "\n")


def quality_of_clean(clean: Column) -> Column:
    """missing / partial / complete for text that :func:`clean_text` already produced."""
    return _grade(squeeze(clean))


def _grade(squeezed: Column) -> Column:
    # The line key of a long text is one of the generic lines only if the text is that line between edge characters.
    generic = f"^(?i)[{LINE_KEY_EDGES}]*+(?:{'|'.join(quoted(t) for t in L.GENERIC_DESCRIPTIONS)})[{LINE_KEY_EDGES}]*+\\z"

    def grade(compact: Column) -> Column:
        letters = F.length(F.regexp_replace(compact, r"[^\p{L}]+", ""))
        return (
            F.when((compact == "") | compact.rlike(generic), "missing")
            .when((F.length(compact) < 40) | compact.rlike("^(?i)[0-9a-f -]{24,}$"), "partial")
            .when(letters / F.length(compact) < 0.35, "partial")
            .otherwise("complete")
        )

    return let(squeezed, grade)


def text_quality(text: Column) -> Column:
    # Clean lines are squeezed and not empty, so only the line ends are left to replace.
    return _grade(F.replace(clean_text(text), F.lit("\n"), F.lit(" ")))


def json_default(text: Column, schema: str, default: Column) -> Column:
    """Typed value of JSON text; the default for null, empty or broken text."""
    return F.coalesce(F.from_json(truthy(text), schema), default)


def question_norm(text: Column) -> Column:
    """Lower-case letters, digits and single blanks."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", " "))


def memory_norm(text: Column) -> Column:
    """Variant for answer memory: keeps Hebrew letters and ``+ / #``."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9א-ת+/# ]", " "))


def question_category(text: Column) -> Column:
    """Category all of whose groups have a term in the question; most groups wins, then table order."""
    ordered = sorted(L.QUESTION_GROUPS.items(), key=lambda item: -len(item[1]))
    rows = F.expr("array(" + ", ".join(
        f"named_struct('key', {sql_text(k)}, 'groups', array({', '.join('array(' + ', '.join(sql_text(t) for t in g) + ')' for g in groups)}))"
        for k, groups in ordered) + ")")
    fits = lambda norm: F.filter(rows, lambda row: F.forall(row["groups"], lambda g: F.exists(g, lambda term: F.contains(norm, term))))
    return F.get(let(question_norm(text), fits), 0)["key"]
