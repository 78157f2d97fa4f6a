"""URL filters: host and path rules, and block decisions that reach the aliases of a page.

A rule (action, host, path) fits a url on its host or a subdomain of it, if the url's path starts with the rule's path; of the rules
that fit, the longest (host and path together) wins, and of equally long ones an allow. Redirects (``http-equiv="refresh"``) and
canonical links in the pages, and given redirect rows, join two addresses; the connected components of these links are classes of
aliases. A page that no rule fits is blocked if its class holds an address that a rule blocks and none that a rule allows. All else
is allowed. A page with a rule of its own keeps that rule's verdict, whatever its aliases are.

Native: addresses, links, components and verdicts are SQL functions and equi-joins. A short policy (``PLAN_RULES``) is constants of
the plan, so the pages are judged in a narrow projection. A policy of any size is a table: each host gives its suffixes, a suffix
meets the lengths of the paths that rules have on it, and path prefixes of those lengths meet the rules; the best match per host and
path is a map-side combined maximum. Both ways give the same verdicts. Only linked addresses take part in components; the pages meet
their class through a join on the address, which Spark splits where one address is very frequent.

Edge cases. A null url, or one without ``://``, has an empty host and path and fits no rule; its page stands in the links under its
page_id, so absolute links of it count, and it is allowed unless its class is blocked. Null html has no links. A rule with a null field
is left out. Addresses are compared without scheme, fragment, and host case; relative link targets are read
against the page's host (with a leading ``/``) or its folder. Repeated rows are judged each for itself. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.shared import smallest_labels, stored

#: Action, host, path.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Up to so many rules are part of the plan; more are a table.
PLAN_RULES = 100
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What makes two urls one: host, path and query, without scheme and fragment. Null without a host."""
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), F.when(path(url) == "", "/").otherwise(path(url)), query))


def resolved(base: Column, link: Column) -> Column:
    """A link target as a full url, read against the url of its page."""
    site, folder = F.regexp_extract(base, "^([^?#]*?://[^/?#]*)", 1), F.regexp_extract(base, "^([^?#]*?://[^?#]*/)", 1)
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(folder == "", F.concat(site, F.lit("/"), link))
        .otherwise(F.concat(folder, link))
    )


def _winner(h: Column, p: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rule that wins, as a struct (rule, verdict), else null: rules in order of precedence, the first that fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))
    fits = [F.when(((h == r[1]) | h.endswith("." + r[1])) & p.startswith(r[2]), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _met(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, own) of every distinct place that a rule fits; ``own`` is the winner, a struct (rule, verdict)."""
    named = rules.select(F.col("action").alias("verdict"), F.col("host").alias("suffix"), F.col("path").alias("prefix")).dropna().distinct()
    lengths = named.groupBy("suffix").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # no longer than the longest path
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tails = places.select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix")).join(lengths, "suffix")
    heads = tails.select("host", "path", "suffix", F.explode("lengths").alias("size")).where(F.col("size") <= F.length("path"))
    hits = heads.select("host", "path", "suffix", F.left("path", "size").alias("prefix")).join(named, ["suffix", "prefix"])
    # Longest first, then an allow, then the smaller host: equal lengths on one place mean that a longer host has a shorter path.
    best = F.min_by(F.struct(F.concat("suffix", "prefix").alias("rule"), "verdict"), F.struct(-F.length(F.concat("suffix", "prefix")), F.col("verdict") != "allow", "suffix", "prefix"))
    return hits.groupBy("host", "path").agg(best.alias("own"))


def with_rule(places: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``places`` (host, path, ...) and ``own``, the rule that wins as a struct (rule, verdict), or null. ``rules``: (action, host, path)."""
    if not isinstance(rules, DataFrame):
        rules = [r for r in rules if None not in r]
        if len(rules) <= PLAN_RULES:
            return places.withColumn("own", _winner(F.col("host"), F.col("path"), rules))
        rules = places.sparkSession.createDataFrame(rules, "action string, host string, path string")
    return places.join(_met(places, rules), ["host", "path"], "left")


def node(url: Column, page_id: Column) -> Column:
    """What stands for a page in the links: its address, or without one its id behind a ``#``, which no address holds."""
    return F.coalesce(address(url), F.concat(F.lit("#"), page_id.cast("string")))


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between the address of a page and the targets of its canonical links and redirects."""
    # A cheap test first: most pages have neither.
    pages = pages.where(F.col("html").rlike("(?i)canonical|http-equiv"))
    targets = F.flatten(F.array(F.regexp_extract_all("html", F.lit(_CANONICAL), 1), F.regexp_extract_all("html", F.lit(_REFRESH), 1)))
    linked = pages.select("page_id", "url", F.explode(targets).alias("link"))
    return linked.select(node(F.col("url"), F.col("page_id")).alias("a"), address(resolved(F.col("url"), F.col("link"))).alias("b"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict. ``rules``: a list, or a table of any size (action, host, path); ``redirects``: rows (from_url, to_url)."""
    pages = pages.select("page_id", "url", "html")
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(address(F.col("from_url")), address(F.col("to_url"))))
    labels = smallest_labels(edges)
    # One decision per class: blocked if it holds a blocked address and no allowed one.
    named = with_rule(labels.withColumns({"host": F.regexp_extract("node", "^([^/]*)", 1), "path": F.regexp_extract("node", r"^[^/]*([^?]*)", 1)}), rules)
    decided = named.groupBy("label").agg(
        F.max(F.col("own.verdict") == "block").alias("bad"), F.max(F.col("own.verdict") == "allow").alias("good")
    ).where("bad AND NOT coalesce(good, false)")
    blocked = stored(labels.join(decided.select("label"), "label").select(F.col("node").alias("address")), "blocked")
    own = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url"), F.col("page_id")).alias("address"))
    own = with_rule(own, rules).select("page_id", "host", "path", "address", "own.rule", "own.verdict")
    alias = own.join(blocked.withColumn("hit", F.lit(True)), "address", "left")
    return alias.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle(table: str = "pages", rules=RULES) -> str:
    """DuckDB text of ``op9_url_filters`` over ``table``."""
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in rules)
    quote = "''"

    def address_sql(url: str) -> str:
        h, p = host_sql(url), path_sql(url)
        return f"CASE WHEN {h} <> '' THEN {h} || CASE WHEN {p} = '' THEN '/' ELSE {p} END || regexp_extract({url}, '://[^?#]*(\\?[^#]*)', 1) END"

    def host_sql(url: str) -> str:
        return f"translate(coalesce(regexp_extract({url}, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"

    def path_sql(url: str) -> str:
        return f"coalesce(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), '')"

    site, base = "regexp_extract(url, '^([^?#]*?://[^/?#]*)', 1)", "regexp_extract(url, '^([^?#]*?://[^?#]*/)', 1)"
    full = (
        f"CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link "
        f"WHEN starts_with(link, '/') THEN {site} || link WHEN {base} = '' THEN {site} || '/' || link ELSE {base} || link END"
    )
    # RE2 has no look-ahead: the tag is cut out first, then tested.
    tag = f"regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')"
    href = f"regexp_extract(tag, '(?is)\\bhref\\s*=\\s*[\"{quote}]?([^\"{quote}\\s>]+)', 1)"
    goal = f"regexp_extract(tag, '(?is)\\bcontent\\s*=\\s*[\"{quote}]?[^\"{quote}>]*?url\\s*=\\s*[\"{quote}]?([^\"{quote}\\s>]+)', 1)"
    return f"""
WITH RECURSIVE rules(action, h, p) AS (VALUES {values}),
tags AS (SELECT page_id, url, unnest({tag}) AS tag FROM {table}),
links AS (
  SELECT page_id, url, replace(CASE WHEN regexp_matches(tag, '(?is)^<link') THEN {href} ELSE {goal} END, '&amp;', '&') AS link FROM tags
  WHERE regexp_matches(tag, '(?is)^<link\\b.*\\brel\\s*=\\s*["{quote}]?canonical\\b') OR regexp_matches(tag, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["{quote}]?refresh\\b')),
goals AS (SELECT coalesce({address_sql("url")}, '#' || page_id) AS a, {full} AS goal FROM links WHERE link <> ''),
edges AS (SELECT a, {address_sql("goal")} AS b FROM goals),
ways AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
sites AS (SELECT page_id, {host_sql("url")} AS host, {path_sql("url")} AS path, coalesce({address_sql("url")}, '#' || page_id) AS address FROM {table}),
nodes AS (SELECT DISTINCT b AS address, regexp_extract(b, '^([^/]*)', 1) AS host, regexp_extract(b, '^[^/]*([^?]*)', 1) AS path FROM reach),
places AS (SELECT host, path FROM sites UNION SELECT host, path FROM nodes),
won AS (
  SELECT host, path, h || p AS rule, action FROM places JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, action, h, p) = 1),
classes AS (
  SELECT reach.a AS address FROM reach JOIN nodes ON reach.b = nodes.address LEFT JOIN won USING (host, path)
  GROUP BY reach.a HAVING bool_or(action = 'block') AND NOT coalesce(bool_or(action = 'allow'), false))
SELECT page_id, sites.host, sites.path, rule, coalesce(action, CASE WHEN classes.address IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM sites LEFT JOIN won ON sites.host = won.host AND sites.path = won.path LEFT JOIN classes ON sites.address = classes.address
"""
