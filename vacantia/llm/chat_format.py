"""Chat formatting by quotation linking: what a message quotes tells which message it answers.

Lines that start with ``>`` are quotes, as deep as they have marks; the line that introduces them ("... wrote:") goes with them. The
quoted lines of one level form passages, cut at blank and other lines; passages and single lines are normalised (A-Z as a-z, white space
as one space) and hashed. A message's own passages and lines are hashed likewise, and each quote is joined with the latest earlier
message of its conversation that holds it. The message that most quoted characters of the lowest level come from is the parent
(of equal ones the latest). Messages that parents connect are a thread. A conversation is ordered by thread, threads by their first
turn, and by turn within a thread, so a reply stands after what it answers and next to its thread. Bodies are free of quotes, and each is
formatted with its role; a conversation's text is its messages' formatted texts in order of position.

Native: lines, levels and passages are array functions within a row. Only quotes, and the passages that equal one, are joined; the
latest earlier holder and the positions come from range-sorted passes that split a long conversation or a frequent passage over tasks
(``operators.ordering``), threads from connected components. Message texts are written once and move once, to meet their position.

Edge cases. A null text counts as empty. A message that quotes nothing, or nothing that was said earlier in its conversation, starts a
thread; its quotes are removed all the same. A row without conv_id or turn neither quotes nor is quoted; rows without conv_id are
ordered among themselves, rows without turn stand first. Rows with the same conv_id and turn are messages of their own in one place of
the thread; their order is that of the md5 of role and text, and equal rows get different positions. A null role is written as ``user``. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.shared import smallest_labels, stored
from vacantia.operators.ordering import carry_last, positions

_MARKS = r"^((?:[ \t]*>)+)[ \t]?"
_INTRODUCES = r"(?i)(wrote|writes|schrieb|écrit|escribió)\s*:\s*$"
_QUOTES = r"(?m)^[ \t]*>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def level(line: Column) -> Column:
    """How many quotation marks a line starts with."""
    marks = F.regexp_extract(line, _MARKS, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def own_body(lines: Column) -> Column:
    """The lines that are no quotes and introduce none."""
    kept = F.filter(lines, lambda x, i: ~((level(x) > 0) | (x.rlike(_INTRODUCES) & (F.coalesce(level(F.get(lines, i + 1)), F.lit(0)) > 0))))
    return F.trim(F.array_join(kept, "\n"), F.lit(" \t\r\n"))


def passages(text: Column) -> Column:
    """Normalised passages and lines of a text, each once."""
    parts = F.concat(F.split(text, r"\n\s*\n"), F.split(text, "\n"))
    normal = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.translate(x, _UPPER, _LOWER), r"\s+", " ")))
    return F.array_distinct(F.filter(normal, lambda x: x != ""))


def _keyed(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per passage of ``rows.passages``: its hash and its length."""
    exploded = rows.select(*columns, F.explode("passages").alias("passage"))
    return exploded.select(*columns, F.md5("passage").alias("hash"), F.length("passage").alias("chars"))


def messages(conversations: DataFrame) -> DataFrame:
    """Every message with a row number, its body, and its quotes as (level, passages); written as a table."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("lines", F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1))
    quoting = F.col("text").rlike(_QUOTES)
    rows = rows.withColumn("levels", F.when(quoting, F.filter(F.array_distinct(F.transform("lines", level)), lambda x: x > 0)).otherwise(F.array().cast("array<int>")))

    def of_level(k: Column) -> Column:
        text = F.array_join(F.transform("lines", lambda x: F.when(level(x) == k, F.regexp_replace(x, _MARKS, "")).otherwise("")), "\n")
        return F.struct(k.alias("level"), passages(text).alias("passages"))

    body = F.when(quoting, own_body(F.col("lines"))).otherwise(F.trim("text", F.lit(" \t\r\n")))
    rows = rows.select("conv_id", "turn", "role", body.alias("body"), F.transform("levels", of_level).alias("quotes"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "messages")


def sources(said: DataFrame) -> DataFrame:
    """row, parent_turn and n_linked of every message that quotes an earlier one of its conversation."""
    placed = said.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = placed.select("row", "conv_id", "turn", F.explode("quotes").alias("q")).select("row", "conv_id", "turn", "q.level", "q.passages")
    quotes = stored(_keyed(quotes, "row", "conv_id", "turn", "level"), "quotes")
    wanted = quotes.select("conv_id", "hash").distinct()
    asked = wanted.select("conv_id").distinct()
    held = _keyed(placed.join(asked, "conv_id", "left_semi").select("conv_id", "turn", passages(F.col("body")).alias("passages")), "conv_id", "turn")
    held = held.join(wanted, ["conv_id", "hash"], "left_semi")
    none = F.lit(None)
    both = held.select("conv_id", "hash", "turn", F.lit(1).alias("kind"), F.col("turn").alias("holder"), none.cast("long").alias("row"), none.cast("int").alias("level"), none.cast("int").alias("chars")).unionByName(
        quotes.select("conv_id", "hash", "turn", F.lit(0).alias("kind"), none.cast("long").alias("holder"), "row", "level", "chars"))
    # At the same turn a quote stands before what is said, so only earlier messages are its source.
    found = carry_last(both, [F.col("turn"), F.col("kind")], ("conv_id", "hash"), "holder", "source").where("kind = 0 AND source IS NOT NULL")
    summed = found.groupBy("row", "level", "source").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    best = summed.groupBy("row").agg(F.max(F.struct(-F.col("level"), "chars", "source"))["source"].alias("parent_turn"), F.sum("n").alias("n_linked"))
    return stored(best, "parents")


def threaded(conversations: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, position, role, body, parent_turn, thread_turn, n_quoted, n_linked, formatted."""
    said = messages(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    parents = sources(said)
    slim = said.select("row", "conv_id", "turn", F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), "body")).alias("tie")).join(parents, "row", "left")
    node = lambda turn: F.struct(F.col("conv_id").alias("c"), F.col(turn).alias("t"))
    edges = slim.where("parent_turn IS NOT NULL").select(node("turn").alias("a"), node("parent_turn").alias("b"))
    labels = smallest_labels(edges).select(F.col("node.c").alias("conv_id"), F.col("node.t").alias("turn"), F.col("label.t").alias("first_turn"))
    slim = slim.join(labels, ["conv_id", "turn"], "left").withColumn("thread_turn", F.coalesce("first_turn", "turn"))
    # Rows without conversation are one group; a null group key would not survive the joins of the numbering.
    grouped = slim.select("row", "conv_id", "turn", "tie", "parent_turn", "n_linked", "thread_turn", F.coalesce("conv_id", F.lit(0)).alias("group"), F.col("conv_id").isNull().alias("loose"))
    numbered = positions(grouped, [F.col(c) for c in ("thread_turn", "turn", "tie", "row")], ("loose", "group"))
    numbered = numbered.select("row", "position", "parent_turn", "thread_turn", F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    start, middle, end = map(F.lit, TEMPLATE)
    return said.join(numbered, "row").select(
        "conv_id", "turn", "position", "role", "body", "parent_turn", "thread_turn",
        F.aggregate("quotes", F.lit(0), lambda n, q: n + F.size(q["passages"])).cast("long").alias("n_quoted"), "n_linked",
        F.concat(start, F.coalesce("role", F.lit("user")), middle, "body", end).alias("formatted"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation in reply order."""
    return threaded(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("body")


def oracle(table: str = "conversations") -> str:
    """DuckDB text of ``op10_chat_format`` over ``table``. Equal rows are numbered in any order, which shows in no column but position."""
    level_sql = "len(regexp_extract({0}, '^((?:[ \\t]*>)+)[ \\t]?', 1)) - len(replace(regexp_extract({0}, '^((?:[ \\t]*>)+)[ \\t]?', 1), '>', ''))"

    def parts(text: str) -> str:
        normal = f"trim(regexp_replace(translate(x, '{_UPPER}', '{_LOWER}'), '\\s+', ' ', 'g'))"
        return f"list_distinct(list_filter(list_transform(list_concat(string_split_regex({text}, '\\n\\s*\\n'), string_split({text}, chr(10))), lambda x: {normal}), lambda x: x <> ''))"

    start, middle, end = (x.replace("\n", "' || chr(10) || '") for x in TEMPLATE)
    return f"""
WITH RECURSIVE told AS (SELECT row_number() OVER () AS r, conv_id, turn, role, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS t, coalesce(text, '') AS raw FROM {table}),
cut AS (SELECT r, string_split(t, chr(10)) AS lines FROM told),
lines AS (SELECT r, i, lines[i] AS line, {level_sql.format("lines[i]")} AS level FROM cut, unnest(range(1, len(lines) + 1)) AS u(i)),
marked AS (SELECT *, lead(level, 1, 0) OVER (PARTITION BY r ORDER BY i) AS next FROM lines),
bodies AS (
  SELECT told.r, trim(CASE WHEN max(level) > 0 THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (next > 0 AND regexp_matches(line, '{_INTRODUCES}'))), '') ELSE any_value(raw) END, chr(32) || chr(9) || chr(13) || chr(10)) AS body
  FROM told JOIN marked USING (r) GROUP BY told.r),
levels AS (SELECT DISTINCT r, level AS k FROM lines WHERE level > 0),
texts AS (SELECT r, k, string_agg(CASE WHEN level = k THEN regexp_replace(line, '^((?:[ \\t]*>)+)[ \\t]?', '') ELSE '' END, chr(10) ORDER BY i) AS t FROM levels JOIN lines USING (r) GROUP BY r, k),
quotes AS (SELECT r, k, unnest({parts("t")}) AS p FROM texts),
held AS (SELECT DISTINCT conv_id, turn, unnest({parts("body")}) AS p FROM bodies JOIN told USING (r)),
found AS (
  SELECT quotes.r, k, p, max(held.turn) AS source FROM quotes JOIN told USING (r) JOIN held USING (p) WHERE held.conv_id = told.conv_id AND held.turn < told.turn GROUP BY quotes.r, k, p),
summed AS (SELECT r, k, source, sum(len(p)) AS chars, count(*) AS n FROM found GROUP BY r, k, source),
parents AS (SELECT r, first(source ORDER BY k, chars DESC, source DESC) AS parent, CAST(sum(n) AS BIGINT) AS n_linked FROM summed GROUP BY r),
edges AS (SELECT DISTINCT conv_id, turn AS a, parent AS b FROM parents JOIN told USING (r)),
ways AS (SELECT conv_id, a, b FROM edges UNION SELECT conv_id, b, a FROM edges),
reach(conv_id, a, b) AS (SELECT conv_id, a, b FROM ways UNION SELECT reach.conv_id, reach.a, ways.b FROM reach JOIN ways ON reach.conv_id = ways.conv_id AND reach.b = ways.a),
threads AS (SELECT conv_id, a AS turn, min(b) AS first_turn FROM reach GROUP BY conv_id, a),
named AS (SELECT told.*, body, parent, coalesce(n_linked, 0) AS n_linked, coalesce(first_turn, told.turn) AS thread FROM told JOIN bodies USING (r) LEFT JOIN parents USING (r) LEFT JOIN threads ON told.conv_id = threads.conv_id AND told.turn = threads.turn),
counted AS (SELECT r, count(*) AS n FROM quotes GROUP BY r)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, turn NULLS FIRST, md5(coalesce(role, '') || chr(10) || body)) AS position, role, parent AS parent_turn, thread AS thread_turn,
  coalesce(n, 0) AS n_quoted, n_linked, '{start}' || coalesce(role, 'user') || '{middle}' || body || '{end}' AS formatted
FROM named LEFT JOIN counted USING (r)
"""
