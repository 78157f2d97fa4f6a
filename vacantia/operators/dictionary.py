"""Dictionary matching as a join: which keys of a term table occur in which text, for term tables of any size.

A term whose ends are both letters or digits must not stand inside a longer word, so an occurrence is a whole run of as many words as
the term has, separators included.  Any other term is found anywhere; it starts or ends with a symbol, so an occurrence starts or
ends at one.  Every such run and every such stretch of a text is cut out in a narrow projection and joined with the terms by equality:
no term is turned into an expression.  Of the term table the driver reads the distinct lengths and, as long as they are few, what the
terms of a length start (or end) with: only texts that hold one of these are cut for that length, and all texts where they are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.text import let, term_array

WORD, BORDER = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
SYMBOL = r"[^\p{L}\p{N}\s]"

#: Ways to find a term: whole words, a stretch that starts at a symbol, a stretch that ends at one.
WORDS, FROM_SYMBOL, TO_SYMBOL = "words", "from", "to"

#: First words of the terms of one length, and characters at the symbol of others, up to which texts without them are passed over.
FIRST_WORDS, MARKS, MARK = 10_000, 50, 2


def _pattern(way: str, size: int) -> str:
    """One match per word or symbol, what it cuts out (overlapping) as group 1; ``size`` counts words (two or more) for whole words, else characters."""
    if way == WORDS:
        return rf"(?<!{WORD})(?=({WORD}++(?:{BORDER}++{WORD}++){{{size - 1}}})){WORD}++"
    return rf"(?s)(?=({SYMBOL}.{{{size - 1}}})){SYMBOL}" if way == FROM_SYMBOL else rf"(?s){SYMBOL}(?<=(.{{{size}}}))"


def prepared(lexicon: DataFrame) -> DataFrame:
    """Distinct (key, term, way, size) of a term table; terms are trimmed and lower-cased, null and empty ones match nothing."""
    rows = lexicon.select("key", F.lower(F.regexp_replace("term", r"^\s+|\s+$", "")).alias("term")).filter("key IS NOT NULL AND term <> ''").distinct()
    opens, closes = F.col("term").rlike(r"^[\p{L}\p{N}]"), F.col("term").rlike(r"[\p{L}\p{N}]$")
    way = F.when(opens & closes, WORDS).when(~opens, FROM_SYMBOL).otherwise(TO_SYMBOL)
    size = F.when(opens & closes, F.size(F.regexp_extract_all("term", F.lit(f"{WORD}+"), 0))).otherwise(F.length("term"))
    return rows.withColumns({"way": way, "size": size})


def _starts(terms: DataFrame) -> list[tuple[str, int, list[str] | None]]:
    """Every (way, size) of ``terms`` with the distinct first words of its terms, or the characters at their symbol; null if they are many."""
    first = F.regexp_extract("term", f"^{WORD}+", 0)
    mark = F.when(F.col("way") == FROM_SYMBOL, F.substring("term", 1, MARK)).otherwise(F.substring("term", -MARK, MARK))
    starts = terms.select("way", "size", F.when(F.col("way") == WORDS, first).otherwise(mark).alias("start")).distinct()
    counts = starts.groupBy("way", "size").agg(F.count("*").alias("n"))
    few = counts.filter(F.col("n") <= F.when(F.col("way") == WORDS, FIRST_WORDS).otherwise(MARKS)).filter(f"NOT (way = '{WORDS}' AND size = 1)")
    known: dict[tuple[str, int], list[str]] = {}
    for row in starts.join(few.select("way", "size"), ["way", "size"]).toLocalIterator():
        known.setdefault((row["way"], row["size"]), []).append(row["start"])
    return sorted((row["way"], row["size"], sorted(known[key]) if (key := (row["way"], row["size"])) in known else None) for row in counts.toLocalIterator())


def _stretches(text: Column, words: Column, way: str, size: int, starts: list[str] | None) -> Column:
    """What can be a term of this kind in a text with these distinct words."""
    if way == WORDS and size == 1:
        return words
    cut = F.regexp_extract_all(text, F.lit(_pattern(way, size)), 1)
    if starts is None:
        return cut
    there = F.arrays_overlap(words, term_array(starts)) if way == WORDS else F.exists(term_array(starts), lambda mark: F.contains(text, mark))
    return F.when(there, cut).otherwise(F.array().cast("array<string>"))


def term_keys(texts: DataFrame, id_column: str, text_column: str, lexicon: DataFrame) -> DataFrame:
    """Distinct (id, key) of the texts and the keys of ``lexicon`` (key, term) that have a term in the text, in either case.

    A null or empty text, an empty table of texts and an empty lexicon give no rows; repeated ids count as one text each, their keys
    are united; other columns of both tables are ignored.  A term may belong to several keys.  A frequent term meets many texts but
    each (text, stretch) once, and Spark broadcasts the terms by size or splits the skewed partition.
    """
    terms = prepared(lexicon)
    kinds = _starts(terms)
    if not kinds:
        return texts.select(F.col(id_column).alias("id"), F.lit(None).cast(lexicon.schema["key"].dataType).alias("key")).filter(F.lit(False))
    rows = texts.select(F.col(id_column).alias("id"), F.lower(F.col(text_column)).alias("text")).filter("text <> ''")
    split = F.struct(F.col("text").alias("text"), F.array_distinct(F.split("text", f"{BORDER}+")).alias("words"))
    cut = let(split, lambda p: F.array_distinct(F.flatten(F.array(*[_stretches(p["text"], p["words"], *kind) for kind in kinds]))))
    stretches = rows.select("id", F.explode(cut).alias("term"))
    return stretches.join(terms.select("key", "term"), "term").select("id", "key").distinct()
