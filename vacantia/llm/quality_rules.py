"""Quality rules: a threshold table compiled into one projection of counts and ratios, without user functions.

``metrics`` counts per text; ``compiled`` turns the rows of ``THRESHOLDS`` into one expression over those counts. All of it is a
narrow projection: no shuffle, no Python, and the cost of a text is its length times its logarithm (windows are sorted).

Edge cases. A null or empty text has no words and no lines: all counts are 0 and the base rule fails it. Repeated rows are judged
each for itself, ties cannot occur. An empty table gives an empty result. Other columns are not read; in ``passing`` they are
handed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.shared import SEPARATORS, unused

#: Rule, part, whole, and the least and most per cent that the part may be of the whole (null: no bound). A whole of 0 passes.
THRESHOLDS: tuple[tuple[str, str, str, int | None, int | None], ...] = (
    ("mean_word_length", "word_chars", "n_words", 200, 1200),
    ("symbols_per_word", "n_symbols", "n_words", None, 50),
    ("words_with_letters", "n_letter_words", "n_words", 60, None),
    ("stop_words", "n_stop_words", "n_words", 2, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
)
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "was", "this", "are", "by", "a", "on",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "mit", "von", "für", "sich", "auf",
    "le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "dans", "pour", "pas", "est", "du", "en", "au",
    "el", "los", "las", "y", "del", "por", "con", "para", "una", "no", "se", "al", "es", "su",
)
#: The base rule: at least so many words, at most so many per cent of them in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BLANKS = " \t\n\x0b\x0c\r"


def _repeated(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs twice: sort (hash, place), keep equal neighbours, count the places they cover."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(placed)


def metrics(docs: DataFrame, text: str = "text", out: str = "counts") -> DataFrame:
    """``docs`` with one more column ``out``: a struct of the counts that the rules use."""
    t, w, n, h, s, lines = (unused(docs.columns, x) for x in ("q_text", "q_words", "q_n", "q_windows", "q_sorted", "q_lines"))
    c = F.col
    docs = docs.withColumns({t: F.coalesce(c(text), F.lit(""))})
    body = F.trim(c(t), F.lit(BLANKS))
    docs = docs.withColumns({
        w: F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SEPARATORS)),
        lines: F.filter(F.split(c(t), "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != ""),
    })
    docs = docs.withColumn(n, F.size(w))
    starts = F.when(c(n) >= 3, F.sequence(F.lit(0), c(n) - 3)).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumn(h, F.transform(starts, lambda i: F.xxhash64(F.get(c(w), i), F.get(c(w), i + 1), F.get(c(w), i + 2))))
    docs = docs.withColumn(s, _repeated(c(h)))
    twice = F.filter(c(s), lambda x, i: (F.get(c(s), i - 1)["h"] == x["h"]) | (F.get(c(s), i + 1)["h"] == x["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))
    kept = [*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)]
    letters = F.trim(F.regexp_replace(c(t), r"[^\p{L}\x20\x09-\x0D]+", ""), F.lit(BLANKS))
    values = {
        "n_words": c(n),
        "word_chars": F.length(F.regexp_replace(c(t), SEPARATORS, "")),
        "n_symbols": F.length(c(t)) - F.length(F.regexp_replace(c(t), r"[#*$%&|<>]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.size(covered),
        "n_letter_words": F.when(letters == "", 0).otherwise(F.size(F.split(letters, SEPARATORS))),
        "n_stop_words": F.size(F.filter(c(w), lambda x: x.isin(*kept))),
        "n_bullet_lines": F.size(F.filter(c(lines), lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "‣", "▪", "–"))),
        "n_ellipsis_lines": F.size(F.filter(c(lines), lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    }
    # The row number keeps the optimiser from copying the counts into every condition on them, below which they would be computed anew.
    counted = F.struct(*[v.cast("long").alias(k) for k, v in values.items()], F.monotonically_increasing_id().alias("row"))
    return docs.withColumn(out, counted).drop(t, w, n, h, s, lines)


def base_failed(counts: str) -> Column:
    """The base rule on the struct column ``counts``."""
    c = F.col
    return (c(f"{counts}.n_words") < LEAST_WORDS) | (100 * c(f"{counts}.n_repeat_words") > MOST_REPEATED * c(f"{counts}.n_words"))


def compiled(counts: str, thresholds=THRESHOLDS) -> Column:
    """The names of the rules that fail, in the table's order."""
    failed = []
    for name, part, whole, least, most in thresholds:
        part, whole = F.col(f"{counts}.{part}"), F.col(f"{counts}.{whole}")
        bad = F.lit(False)
        if least is not None:
            bad = bad | (100 * part < least * whole)
        if most is not None:
            bad = bad | (100 * part > most * whole)
        failed.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*failed))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Per row of ``docs``: doc_id, every count, base_failed, failed_rules and kept."""
    judged = metrics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    judged = judged.select("doc_id", "counts", base_failed("counts").alias("base_failed"), compiled("counts", thresholds).alias("failed_rules"))
    return judged.select("doc_id", "counts.*", "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept")).drop("row")


def passing(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that the base rule and the table keep, with the columns they came with."""
    q = unused(docs.columns, "q_counts")
    return metrics(docs, text, q).where(~base_failed(q) & (F.size(compiled(q, thresholds)) == 0)).drop(q)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and counts of every document."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *COUNTS, "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


def _rules_sql() -> str:
    parts = []
    for name, part, whole, least, most in THRESHOLDS:
        tests = [f"100 * {part} < {least} * {whole}"] * (least is not None) + [f"100 * {part} > {most} * {whole}"] * (most is not None)
        parts.append(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


def _quoted(words) -> str:
    return ", ".join(f"'{x}'" for x in words)


def oracle(table: str = "documents") -> str:
    """DuckDB text of ``op4_quality_rules`` over ``table``."""
    kept = _quoted([*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)])
    sep = SEPARATORS
    return rf"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
words AS (SELECT r, list_filter(string_split_regex(t, '{sep}'), lambda x: x <> '') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM rows),
placed AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words),
windows AS (SELECT r, i, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p AS x FROM placed WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM windows WHERE x IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY r),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{sep}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS BIGINT) AS n_letter_words,
    CAST(len(list_filter(w, lambda x: x IN ({kept}))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(lines, lambda x: ltrim(x, ' ')[1:1] IN ('-', '*', '•', '‣', '▪', '–'))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(lines, lambda x: suffix(rtrim(x, ' '), '...') OR suffix(rtrim(x, ' '), '…'))) AS BIGINT) AS n_ellipsis_lines
  FROM rows JOIN words USING (r) LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {_rules_sql()} AS failed FROM counts)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND len(failed) = 0 AS kept, coalesce(array_to_string(failed, ','), '') AS failed_rules FROM judged
"""
