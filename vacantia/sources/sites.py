"""Employer sites: links and ids in raw pages, link rows, structured and mirrored feeds, fallbacks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.locations import canonical_city
from vacantia.functions.text import clean_text, contains_any, html_to_text, let, squeeze, text_quality, truthy, unescape
from vacantia.functions.titles import human, title_human, title_repair, title_resolve
from vacantia.functions.urls import host, resolve_url
from vacantia.operators.ordering import top
from vacantia.session import cut_lineage

QUOTED = "[\"']([^\"']+)[\"']"
CARD_ID_CHARS = 800  # the id of a card without link is defined over so many characters of its text


@dataclass(frozen=True)
class Site:
    """What identifies a posting on one employer's site."""

    url: str
    id_pattern: str
    href_template: str = ""
    trusted_region: bool = False
    prefer_link_text: bool = False


def _link(row_id: Column, template: str) -> Column:
    return F.format_string(template.replace("%", "%%").replace("{id}", "%s"), row_id)


def extract_links(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """Quoted URLs in raw HTML or scripts whose text matches the id pattern."""
    text = F.replace(unescape(F.col(html)), F.lit("\\/"), F.lit("/"))
    rows = pages.select(key, F.explode(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))).alias("c"))
    link = F.replace(F.trim("c"), F.lit("\\u0026"), F.lit("&"))
    rows = rows.select(key, F.when(link.startswith("//"), F.concat(F.lit("https:"), link)).otherwise(link).alias("href"))
    return rows.filter(F.col("href").rlike(pattern) & F.col("href").rlike("^(?:/|https?://)"))


def extract_ids(rows: DataFrame, key: list[str], text: str, pattern: str, template: str) -> DataFrame:
    """Posting ids in plain text as canonical links, one row per text and id."""
    found = rows.select(*key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))).alias("external_id"))
    return found.withColumn("href", _link(F.col("external_id"), template))


def sitemap_locations(maps: DataFrame, key: str, xml: str, pattern: str) -> DataFrame:
    """``<loc>`` values that are postings or child sitemaps."""
    locations = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    rows = maps.select(key, F.explode(locations).alias("loc")).withColumn("loc", F.trim(unescape(F.col("loc")))).filter("loc <> ''")
    child = F.lower(F.substring_index("loc", "?", 1)).endswith(".xml")
    return rows.withColumn("is_sitemap", child).filter(F.col("is_sitemap") | F.col("loc").rlike(pattern))


def resolve_href(rows: DataFrame, site: Site) -> DataFrame:
    """Add ``link`` (resolved, or made from the id in onclick) and ``external_id`` ('' when the row is no posting)."""
    href = resolve_url(F.lit(site.url), F.col("href"))
    searchable = F.concat_ws(" ", truthy(href), truthy(F.trim("href")), truthy(F.trim("onclick")))
    found = F.regexp_extract(searchable, site.id_pattern, 1)
    made = _link(found, site.href_template) if site.href_template else href
    usable = (href != "") & href.rlike(site.id_pattern)
    return rows.withColumns({"external_id": found, "link": F.when((found != "") & ~usable, made).otherwise(href)})


def dedupe_best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Best row per posting id: a title counts 3, text 2, a longer link breaks ties, then the first row."""
    titled = (F.length("title") > 0) | (F.length("link_text") > 0)
    score = F.when(titled, 3).otherwise(0) + F.when(F.length("text") > 0, 2).otherwise(0) + F.length("link") / 1000
    rows = rows.filter("external_id <> ''").withColumn("id_key", F.lower("external_id"))
    rest = [c for c in rows.columns if c not in (*keys, "id_key")]
    best = rows.groupBy(*keys, "id_key").agg(F.max_by(F.struct(*rest), F.struct(score, -F.col("seq"))).alias("b"))
    return best.select(*keys, "id_key", "b.*")


def hydrate_details(rows: DataFrame, details: DataFrame, size: int | None = None, missing_title_only: bool = False) -> DataFrame:
    """Rows with their detail page (link, canonical, detail_title, detail_text) where one was landed.

    ``size``: only the first so many rows of a source use their page; the rest stay as they are.
    """
    joined = rows.join(details, "link", "left")
    use = F.col("canonical").isNotNull()
    if size is not None:
        first = top(rows.select("source", "link", "seq"), [F.col("seq")], ["source"], size).select("source", "seq", F.lit(True).alias("chosen"))
        joined = joined.join(first, ["source", "seq"], "left")
        use = use & F.col("chosen").isNotNull()
    if missing_title_only:
        use = use & ~title_human(F.col("title"), F.col("link_text"))
    cleaned = clean_text(F.col("detail_text"))
    return joined.withColumns({
        "href": F.when(use, F.coalesce(truthy(F.col("canonical")), F.col("link"))).otherwise(F.col("link")),
        "title": F.when(use, F.coalesce(truthy(F.col("detail_title")), F.col("title"))).otherwise(F.col("title")),
        "text": F.when(use & (text_quality(F.col("detail_text")) == "complete"), cleaned).otherwise(F.col("text")),
    }).drop("canonical", "detail_title", "detail_text", "chosen")


def postings_from_rows(rows: DataFrame, site: Site) -> DataFrame:
    """Link rows of a site as postings: only rows with an id and a human title."""
    best = dedupe_best(resolve_href(rows, site), ["source"])
    text = clean_text(F.col("text"))
    best = best.withColumn("description", text)
    title = title_repair(F.col("source"), title_resolve(F.col("title"), F.col("link_text"), F.col("link"), prefer_link_text=site.prefer_link_text), F.col("description"))
    place = canonical_city(F.col("description"))
    if site.trusted_region:
        place = F.coalesce(truthy(place), F.lit("Israel"))
    best = best.withColumns({"title": title, "location": place})
    return best.filter(human(F.col("title"))).select(
        "source", "external_id", "title", "location", F.lit("onsite").alias("workplace"), "description", F.col("link").alias("apply_url"))


def postings_from_search(rows: DataFrame, id_pattern: str, cities: tuple[str, ...]) -> DataFrame:
    """Search-result variant: id in the link, every listed city, hybrid when the text says so; first row per id."""
    rows = rows.withColumn("external_id", F.regexp_extract(F.regexp_extract("href", "^([^?]*)", 1), id_pattern, 1)).filter("external_id <> '' AND title <> ''")
    first = rows.groupBy("external_id").agg(F.min_by(F.struct("title", "text", "href"), "seq").alias("f")).select("external_id", "f.*")
    named = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(rf"(?i)({'|'.join(cities)}),\s*Israel"), F.lit(1)), lambda c: F.concat(F.initcap(c), F.lit(", Israel"))))
    return first.select("external_id", "title", F.coalesce(truthy(F.array_join(named, "; ")), F.lit("Israel")).alias("location"),
                        F.when(F.lower("text").contains("hybrid"), "hybrid").otherwise("onsite").alias("workplace"), F.col("href").alias("apply_url"))


# Fields of an object that stand for its value, in order.
SCALAR_FIELDS = ("name", "title", "label", "value", "city")
RICH_FIELDS = ("text", "html", "value", "description", "content", "label", "name", "title")


def _plain(path: str) -> Column:
    """Text of a string, number or flag at the path; null for objects, lists and missing fields."""
    kind = F.schema_of_variant(F.try_variant_get("node", path, "variant"))
    return F.when(kind.rlike("^(?:OBJECT|ARRAY|VOID|BOOLEAN)"), None).otherwise(F.try_variant_get("node", path, "string"))


def _scalar(keys: tuple[str, ...]) -> Column:
    """First key with a value: its own text, else that of a naming field of its object."""
    paths = [p for k in keys for p in (f"$.{k}", *[f"$.{k}.{f}" for f in SCALAR_FIELDS])]
    return F.coalesce(*[truthy(squeeze(_plain(p))) for p in paths])


def _rich(key: str) -> Column:
    """Longer text of a key: its own text, else the text fields of its object, one per line."""
    fields = F.array_compact(F.array(*[truthy(_plain(f"$.{key}.{f}")) for f in RICH_FIELDS]))
    return F.coalesce(_plain(f"$.{key}"), F.array_join(fields, "\n"))


def structured_feed(feeds: DataFrame, id_keys: tuple[str, ...], title_keys: tuple[str, ...], location_keys: tuple[str, ...],
                    description_keys: tuple[str, ...], template: str, id_pattern: str = ".{2,80}") -> DataFrame:
    """Postings anywhere in nested JSON: a node with an id and a human title, at any depth (one stored level per depth)."""
    spark = feeds.sparkSession
    level = feeds.select("feed_id", F.try_parse_json("payload").alias("node"))
    nodes = level
    kind = F.schema_of_variant("node")
    while True:
        inner = level.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        level = spark.sql("SELECT f.feed_id, e.value AS node FROM {level} f, LATERAL variant_explode(f.node) e", level=inner)
        level = cut_lineage(level.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY")))
        if level.isEmpty():
            break
        nodes = nodes.union(level)
    # Only objects carry the keys; scalars and lists give null.
    rows = nodes.select(
        "feed_id", _scalar(id_keys).alias("external_id"), _scalar(title_keys).alias("title"), F.coalesce(_scalar(location_keys), F.lit("")).alias("location"),
        F.array_compact(F.array(*[let(clean_text(_rich(k)), truthy) for k in description_keys])).alias("pieces"))
    rows = rows.filter(F.col("external_id").rlike(f"^(?:{id_pattern})$") & human(F.col("title")))
    text = F.array_join(F.concat(F.array("title"), F.filter(F.array("location"), lambda v: v != ""), "pieces"), "\n")
    rows = rows.select("feed_id", "external_id", "title", "location", clean_text(text).alias("text"), _link(F.col("external_id"), template).alias("href"))
    best = rows.groupBy("feed_id", F.lower("external_id").alias("id_key")).agg(F.max_by(F.struct("external_id", "title", "location", "text", "href"), F.struct(F.length("text"), "title", "text")).alias("b"))
    return best.select("feed_id", "b.*")


MIRROR = ("Company struct<Jobs: array<struct<JobContent: struct<Name: string, Addresses: array<struct<City: string, CityEnglish: string>>, Description: string, "
          "Requirements: string>, SendCVButtonModel: struct<ExternalLink: string>>>>")


def mirror_feed(feeds: DataFrame, official_host: str, id_pattern: str) -> DataFrame:
    """A third-party company listing: only rows whose external link is on the official site."""
    rows = feeds.select("feed_id", F.posexplode(F.from_json("payload", MIRROR)["Company"]["Jobs"]).alias("pos", "j"))
    link = squeeze(F.col("j.SendCVButtonModel.ExternalLink"))
    cities = F.filter(F.transform("j.JobContent.Addresses", lambda a: squeeze(F.coalesce(truthy(a["City"]), a["CityEnglish"]))), lambda c: c != "")
    title = squeeze(F.col("j.JobContent.Name"))
    parts = F.filter(F.concat(F.array(title), F.coalesce(cities, F.array().cast("array<string>")), F.array(html_to_text(F.col("j.JobContent.Description")), html_to_text(F.col("j.JobContent.Requirements")))), lambda p: p != "")
    rows = rows.select("feed_id", "pos", link.alias("href"), title.alias("title"), F.array_join(parts, " ").alias("text"), F.regexp_extract(link, id_pattern, 1).alias("external_id"))
    return rows.filter((host(F.col("href")) == official_host) & (F.col("external_id") != "") & human(F.col("title")))


def fallback_chain(tagged: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows of the first stage that returned any, per source, and the outcome.

    ``tagged``: (source, stage, ...).  ``plans``: (source, mirror_first, errored, preserve).  The order of stages is
    feed, static, mirror (early when flagged), rendered, sitemap, mirror.
    """
    rank = (F.when(F.col("stage") == "feed", 0).when(F.col("stage") == "static", 1).when((F.col("stage") == "mirror") & F.col("mirror_first"), 2)
            .when(F.col("stage") == "rendered", 3).when(F.col("stage") == "sitemap", 4).otherwise(5))
    ranked = tagged.join(plans, "source").withColumn("rank", rank)
    winner = ranked.groupBy("source").agg(F.min(F.struct("rank", "stage")).alias("w"), F.count("*").alias("landed"))
    kept = ranked.join(winner, "source").filter("rank = w.rank").groupBy("source").agg(F.count("*").alias("rows"))
    outcome = (F.when(F.col("rows") > 0, "ok").when(F.col("errored") & F.col("preserve"), "deferred").when(F.col("errored"), "failed").otherwise("empty"))
    rows = plans.join(winner.select("source", F.col("w.stage").alias("stage")), "source", "left").join(kept, "source", "left").fillna(0, ["rows"])
    return rows.select("source", "stage", "rows", outcome.alias("outcome"))


# Headings that are navigation, and words a posting's card must contain.
CARD_HEADINGS_IGNORED = ("משרות", "משרות פתוחות", "לא נמצאו משרות פתוחות", "תחומי עיסוק", "חיפוש משרות", "jobs", "open positions", "careers")
CARD_SIGNALS = ("תפקיד", "דרוש", "מחפשים", "משרה", "ניסיון", "מהנדס", "מהנדסת", "engineer", "developer", "manager", "student", "fpga", "vlsi")


def card_rows(cards: DataFrame) -> DataFrame:
    """Landed (heading, text) cards without links as postings with a content-based id; first card per title."""
    rows = cards.select("seq", squeeze(F.col("title")).alias("title"), squeeze(F.col("text")).alias("text"))
    rows = rows.filter((F.col("title") != "") & ~F.lower("title").isin(*CARD_HEADINGS_IGNORED) & F.length("title").between(3, 180)
                       & (F.length("text") >= F.greatest(F.lit(35), F.length("title") + 12)) & contains_any(F.lower("text"), CARD_SIGNALS))
    first = rows.groupBy(F.lower("title").alias("k")).agg(F.min_by(F.struct("seq", "title", "text"), "seq").alias("f")).select("f.*")
    return first.withColumn("external_id", F.substring(F.sha2(F.concat("title", F.lit("\n"), F.substring("text", 1, CARD_ID_CHARS)), 256), 1, 16))
