"""Queries for sources and sinks.  Payloads are written from the given tables and read back by the normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import lexicons as L
from vacantia.operators import filters as R
from vacantia.plans import duck as K
from vacantia.plans.fixtures import spread, table, view
from vacantia.plans.registry import query
from vacantia.plans.text_queries import _workplace
from vacantia.sources import boards as B, exchange as E, sites as S

PAGE = 50  # postings per landed API page


def board_rows(spark, folder):
    p = view(spark, folder, "postings")
    return spread(p.select("job_id", "source_id", "external_id", "title", "company", "location", "workplace", "apply_url", "published_at", F.col("description").alias("body"),
                           (F.col("job_id") % 9).alias("n"), F.floor(F.col("job_id") / PAGE).alias("seq")))


def landed(rows, item, wrapper="jobs"):
    """Landed pages of at most PAGE postings: (source_id, company, token, seq, payload)."""
    jobs = F.transform(F.array_sort(F.collect_list(F.struct(F.col("job_id").alias("k"), item.alias("i")))), lambda x: x["i"])
    payload = F.to_json(F.struct(jobs.alias(wrapper))) if wrapper else F.to_json(jobs)
    return rows.groupBy("source_id", "seq").agg(payload.alias("payload")).withColumns({"company": F.lit(""), "token": F.concat(F.lit("board-"), F.col("source_id").cast("string"))})


def stamp():
    return F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def shown(rows):
    return rows.withColumn("published_at", F.col("published_at").cast("string")).drop("source_url")


HTML = "'<p>' || body || '</p><br>R&amp;D'"
SRC = "b AS (SELECT job_id, source_id, external_id, title, location, workplace, apply_url, published_at, description AS body, job_id % 9 AS n FROM @@postings)"
OUT = "source_id, external_id, {title} AS title, 'board-' || source_id::varchar AS company, {location} AS location, {workplace} AS workplace, {description} AS description, {url} AS apply_url, (published_at)::varchar AS published_at"
UNTITLED = "CASE WHEN n = 0 THEN 'Untitled role' ELSE title END"


def html():
    return F.concat(F.lit("<p>"), "body", F.lit("</p><br>R&amp;D"))


@query("ingest_greenhouse", f"WITH {SRC}, c AS (SELECT *, {HTML} AS html, {HTML} AS body2 FROM b) SELECT {OUT.format(title=UNTITLED, location='location', workplace=_workplace('remote', 'hybrid').replace('body', 'html'), description=K.html_to_text('html'), url='apply_url')} FROM c")
def ingest_greenhouse(spark, folder):
    item = F.struct(F.col("external_id").alias("id"), F.when(F.col("n") != 0, F.col("title")).alias("title"), F.struct(F.col("location").alias("name")).alias("location"), html().alias("content"),
                    F.col("apply_url").alias("absolute_url"), F.when(F.col("n") < 5, stamp()).alias("first_published"), stamp().alias("updated_at"))
    return shown(B.normalize_greenhouse(landed(board_rows(spark, folder), item)))


@query("ingest_lever", f"WITH {SRC}, c AS (SELECT *, {HTML} AS html FROM b) SELECT {OUT.format(title=UNTITLED, location='location', workplace='workplace', description=K.squeeze(K.html_to_text('html') + " || ' Must know C++ Nice' || CASE WHEN n < 5 THEN ' Extra' ELSE '' END"), url='apply_url')} FROM c")
def ingest_lever(spark, folder):
    section = lambda text: F.struct(F.lit(text).alias("content"))
    item = F.struct(F.col("external_id").alias("id"), F.when(F.col("n") != 0, F.col("title")).alias("text"), F.struct("location").alias("categories"), F.initcap("workplace").alias("workplaceType"), html().alias("description"),
                    F.array(section("<li>Must know C++</li>"), section("<b>Nice</b>")).alias("lists"), F.when(F.col("n") < 5, "<i>Extra</i>").alias("additional"),
                    F.when(F.col("n") < 5, F.col("apply_url")).alias("applyUrl"), F.col("apply_url").alias("hostedUrl"), (F.unix_timestamp("published_at") * 1000).alias("createdAt"))
    return shown(B.normalize_lever(landed(board_rows(spark, folder), item, None)))


@query("ingest_ashby", f"""WITH {SRC}, c AS (SELECT * REPLACE (CASE WHEN n < 3 THEN external_id ELSE apply_url END AS external_id), {HTML} AS html FROM b)
SELECT {OUT.format(title=UNTITLED, location='location', workplace="CASE WHEN n = 1 THEN 'remote' ELSE " + _workplace('hybrid', 'remote').replace('body', "CASE WHEN n < 5 THEN html ELSE '' END") + ' END', description=K.html_to_text('html'), url='apply_url')} FROM c""")
def ingest_ashby(spark, folder):
    item = F.struct(F.when(F.col("n") < 3, F.col("external_id")).alias("id"), F.when(F.col("n") != 0, F.col("title")).alias("title"), "location", (F.col("n") == 1).alias("isRemote"),
                    F.when(F.col("n") < 5, html()).alias("descriptionHtml"), html().alias("descriptionPlain"), F.when(F.col("n") < 4, F.col("apply_url")).alias("applyUrl"), F.col("apply_url").alias("jobUrl"), stamp().alias("publishedAt"))
    return shown(B.normalize_ashby(landed(board_rows(spark, folder), item)))


@query("ingest_smartrecruiters", f"""WITH {SRC}, d AS (SELECT *, n < 6 AS detailed FROM b)
SELECT source_id, external_id, CASE WHEN n = 0 THEN 'Untitled role' WHEN detailed THEN title || ' (detail)' ELSE title END AS title, 'board-' || source_id::varchar AS company,
 CASE n % 3 WHEN 0 THEN 'Haifa, Israel' WHEN 1 THEN 'Haifa, North, France' ELSE 'Lod, Israel' END AS location, CASE WHEN n = 4 THEN 'remote' ELSE 'onsite' END AS workplace,
 CASE WHEN detailed THEN 'About' || chr(10) || chr(10) || {K.html_to_text(HTML)} || chr(10) || chr(10) || 'Needs C++' ELSE '' END AS description, apply_url, published_at::varchar AS published_at FROM d""")
def ingest_smartrecruiters(spark, folder):
    rows = board_rows(spark, folder)
    way = F.col("n") % 3
    place = F.struct(F.when(way == 2, "Lod").otherwise("Haifa").alias("city"), F.when(way == 1, "North").when(way == 2, "Lod").alias("region"),
                     F.when(way == 0, "il").when(way == 1, "France").alias("country"), F.when(way == 2, "IL").alias("countryCode"), (F.col("n") == 4).alias("remote"))
    item = F.struct(F.when(F.col("n") != 2, F.col("external_id")).alias("id"), F.col("external_id").alias("uuid"), F.when(F.col("n") != 0, F.col("title")).alias("name"), place.alias("location"), "apply_url", stamp().alias("releasedDate"))
    item = F.struct(*[item[f].alias({"apply_url": "applyUrl"}.get(f, f)) for f in ("id", "uuid", "name", "location", "apply_url", "releasedDate")])
    section = lambda title, text: F.struct(F.lit(title).alias("title"), text.alias("text"))
    sections = F.create_map(F.lit("a"), section("About", html()), F.lit("b"), section("", F.lit("<p>Needs C++</p>")))
    detail = F.struct("external_id", F.when(F.col("n") != 0, F.concat("title", F.lit(" (detail)"))).alias("name"), F.struct(sections.alias("sections")).alias("jobAd"))
    details = rows.filter("n < 6").select("source_id", F.col("external_id").alias("id"), F.to_json(detail).alias("payload"))
    once = landed(rows, item, "content")
    stale = landed(rows.withColumn("title", F.lit("Old title")), item, "content").withColumn("seq", F.col("seq") - 1_000_000)
    return shown(B.normalize_smartrecruiters(stale.unionByName(once), details))


WORKDAY_TENANTS = "CASE source_id % 3 WHEN 0 THEN 'materials' WHEN 1 THEN 'generic' ELSE 'plain' END"


@query("ingest_workday", f"""WITH {SRC}, w AS (SELECT *, {WORKDAY_TENANTS} AS rule, CASE n % 3 WHEN 0 THEN '/job/Israel-Kiryat-Gat/role_R' WHEN 1 THEN '/job/Rehovot-ISR/role_R' ELSE '/job/Paris/role_R' END || job_id::varchar AS path,
  CASE n WHEN 0 THEN 'Rehovot,ISR' WHEN 1 THEN 'Rehovot' WHEN 2 THEN 'Jerusalem' WHEN 3 THEN '' WHEN 4 THEN 'Kiryat Gat  Remote' WHEN 5 THEN 'Paris' WHEN 6 THEN 'Tel Aviv, Israel' ELSE 'Yavne' END AS place FROM b),
k AS (SELECT *, CASE rule WHEN 'materials' THEN regexp_matches(lower(place || ' ' || path || ' ' || title), 'israel|isr|rehovot') WHEN 'generic' THEN regexp_matches(lower(place || ' ' || path || ' ' || title), 'israel|jerusalem|yavne|migdal|haifa|tel aviv|tel-aviv') ELSE contains(path, '/job/Israel-') END AS keep,
  CASE WHEN place = '' THEN 'Israel' ELSE place END AS shown FROM w),
l AS (SELECT *, regexp_replace(shown, ' +', ' ', 'g') AS compact FROM k WHERE keep),
m AS (SELECT * EXCLUDE (location), CASE rule WHEN 'materials' THEN CASE WHEN compact = 'Rehovot,ISR' THEN 'Rehovot, Israel' WHEN compact = 'Rehovot' THEN 'Rehovot, Israel' WHEN contains(lower(compact), 'israel') THEN compact WHEN contains(lower(path), 'rehovot') THEN 'Rehovot, Israel' ELSE compact || ', Israel' END
  WHEN 'generic' THEN CASE WHEN contains(lower(compact), 'israel') THEN compact ELSE coalesce(CASE {' '.join(f"WHEN contains(lower(compact || ' ' || translate(path, '-_', '  ')), '{c.lower()}') THEN '{c}, Israel'" for c in B.WORKDAY_CITIES)} END, compact || ', Israel') END
  ELSE CASE WHEN contains(lower(shown), 'israel') THEN shown ELSE 'Kiryat Gat, Israel' END END AS location FROM l)
SELECT source_id, CASE WHEN n < 4 THEN external_id ELSE 'R' || job_id::varchar END AS external_id, title, 'board-' || source_id::varchar AS company, location, CASE WHEN contains(lower(location), 'remote') THEN 'remote' ELSE 'onsite' END AS workplace,
  CASE WHEN n < 6 THEN {K.html_to_text(HTML)} ELSE '' END AS description, 'https://acme.wd1.myworkdayjobs.com/en-US/jobs' || path AS apply_url, NULL::varchar AS published_at FROM m""")
def ingest_workday(spark, folder):
    n, rows = F.col("n"), board_rows(spark, folder)
    head = F.when(n % 3 == 0, "/job/Israel-Kiryat-Gat/role_R").when(n % 3 == 1, "/job/Rehovot-ISR/role_R").otherwise("/job/Paris/role_R")
    names = ("Rehovot,ISR", "Rehovot", "Jerusalem", "", "Kiryat Gat  Remote", "Paris", "Tel Aviv, Israel", "Yavne", "Yavne")
    place = F.element_at(F.array(*[F.lit(v) for v in names]), (n + 1).cast("int"))
    rows = rows.withColumns({"path": F.concat(head, F.col("job_id").cast("string")), "place": place})
    item = F.struct("title", F.col("path").alias("externalPath"), F.col("place").alias("locationsText"), F.when(n < 4, F.array("external_id")).alias("bulletFields"))
    info = F.struct(F.struct(html().alias("jobDescription"), F.lit("").alias("externalUrl")).alias("jobPostingInfo"))
    details = rows.filter("n < 6").select("source_id", "path", F.to_json(info).alias("payload"))
    tenants = rows.select("source_id").distinct().withColumns({"rule": F.expr(WORKDAY_TENANTS), "host": F.lit("acme.wd1.myworkdayjobs.com"), "site": F.lit("jobs")})
    return shown(B.normalize_workday(landed(rows, item, "jobPostings"), details, tenants))


@query("ingest_structured_feed")
def ingest_structured_feed(spark, folder):
    """Postings found in nested JSON of differing shape (checked against golden rows in the tests)."""
    rows = view(spark, folder, "postings")
    node = F.struct(F.col("job_id").alias("jobId"), F.when(F.col("job_id") % 3 == 0, F.col("title")).alias("jobTitle"), F.when(F.col("job_id") % 3 == 1, F.col("title")).alias("title"),
                    F.struct(F.col("location").alias("name")).alias("location"), F.col("description").alias("description"))
    deep = F.to_json(F.struct(F.struct(F.array(F.struct(node.alias("posting"))).alias("results")).alias("data"), F.lit(1).alias("page")))
    flat = F.to_json(F.array(node))
    feeds = spread(rows.select(F.col("job_id").alias("feed_id"), F.when(F.col("job_id") % 2 == 0, deep).when(F.col("job_id") % 7 == 1, "broken{").otherwise(flat).alias("payload")))
    return S.structured_feed(feeds, ("jid", "jobId"), ("title", "jobTitle"), ("location", "city"), ("description", "requirements"), "https://careers.acme.example/job/{id}", r"\d{1,12}")


MIRROR_ID = r"/job\?jobid=([A-Za-z0-9-]+)"


@query("ingest_mirror_feed", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY source_id, job_id // 300 ORDER BY job_id) - 1 AS pos, {K.html_to_text("'<p>' || description || '</p>'")} AS plain FROM @@postings)
SELECT source_id * 1000000 + job_id // 300 AS feed_id, 'https://career.acme.example/job?jobid=' || external_id AS href, title, external_id,
  title || CASE WHEN job_id % 4 = 0 THEN ' Haifa ' ELSE ' Lod Haifa ' END || plain || ' Must' AS text FROM p WHERE job_id % 5 <> 0""")
def ingest_mirror_feed(spark, folder):
    rows = spread(view(spark, folder, "postings"))
    city = lambda name: F.struct(F.lit(name).alias("City"))
    site = F.when(F.col("job_id") % 5 == 0, "https://other.example").otherwise("https://career.acme.example")
    content = F.struct(F.concat(F.lit(" "), "title").alias("Name"), F.when(F.col("job_id") % 4 == 0, F.array(city("Haifa"))).otherwise(F.array(city("Lod"), city(" Haifa"))).alias("Addresses"),
                       F.concat(F.lit("<p>"), "description", F.lit("</p>")).alias("Description"), F.lit("<b>Must</b>").alias("Requirements"))
    job = F.struct("job_id", F.struct(content.alias("JobContent"), F.struct(F.concat(site, F.lit("/job?jobid="), "external_id").alias("ExternalLink")).alias("SendCVButtonModel")).alias("j"))
    company = F.struct(F.struct(F.transform(F.array_sort(F.collect_list(job)), lambda x: x["j"]).alias("Jobs")).alias("Company"))
    feeds = rows.groupBy("source_id", F.floor(F.col("job_id") / 300).alias("part")).agg(F.to_json(company).alias("payload")).select((F.col("source_id") * 1000000 + F.col("part")).alias("feed_id"), "payload")
    return S.mirror_feed(feeds, "career.acme.example", MIRROR_ID).select("feed_id", "href", "title", "external_id", "text")


LINK_ID = "/([A-Za-z]{2,12})$"


@query("extract_links", rf"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(replace({K.unescape('html')}, '\/', '/'), '["'']([^"'']+)["'']', 1)) AS c FROM pages), d AS (SELECT page_id, replace(trim(c), '&', '&') AS c FROM c),
e AS (SELECT page_id, CASE WHEN starts_with(c, '//') THEN 'https:' || c ELSE c END AS href FROM d) SELECT page_id, href FROM e WHERE regexp_matches(href, '{LINK_ID}') AND regexp_matches(href, '^(?:/|https?://)')""")
def extract_links(spark, folder):
    return S.extract_links(spread(table(spark, folder, "pages")), "page_id", "html", LINK_ID)


@query("extract_ids_template", r"""WITH t AS (SELECT 'page' AS kind, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents),
u AS (SELECT kind, id, unnest(list_distinct(regexp_extract_all(body, '(?:track\(|https?://[^\s/]+/)([A-Za-z0-9_-]+)', 1))) AS external_id FROM t) SELECT kind, id, external_id, 'https://careers.acme.example/jobs/' || external_id || '/' AS href FROM u""")
def extract_ids_template(spark, folder):
    pages = table(spark, folder, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    rows = spread(pages.union(table(spark, folder, "documents").select(F.lit("document"), "doc_id", "text")))
    return S.extract_ids(rows, ["kind", "id"], "body", r"(?:track\(|https?://[^\s/]+/)([A-Za-z0-9_-]+)", "https://careers.acme.example/jobs/{id}/")


@query("sitemap_locations", r"""SELECT page_id // 50 AS map_id, CASE WHEN page_id % 10 = 0 THEN 'https://x.example/map' || page_id::varchar || '.XML?a=1&b=2' ELSE url END AS loc, page_id % 10 = 0 AS is_sitemap FROM pages WHERE page_id % 10 = 0 OR regexp_matches(url, '/\d+')""")
def sitemap_locations(spark, folder):
    loc = F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("https://x.example/map"), F.col("page_id").cast("string"), F.lit(".XML?a=1&b=2"))).otherwise(F.col("url"))
    entry = F.concat(F.lit("<url><loc>\n "), F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    maps = table(spark, folder, "pages").groupBy(F.floor(F.col("page_id") / 50).alias("map_id")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    return S.sitemap_locations(maps, "map_id", "xml", r"/\d+")


SITE = S.Site("https://careers.acme.example/open/", r"(?i)/jobs/(r-\d+)", "https://careers.acme.example/jobs/{id}/", trusted_region=True)
RESOLVED = """rr AS (SELECT *, CASE WHEN href = '' THEN '' WHEN starts_with(href, 'https:') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://careers.acme.example' || href ELSE 'https://careers.acme.example/open/' || href END AS h FROM @@link_rows),
rs AS (SELECT *, regexp_extract(h || ' ' || href || ' ' || onclick, '(?i)/jobs/(r-[0-9]+)', 1) AS external_id FROM rr),
rt AS (SELECT *, CASE WHEN external_id <> '' AND NOT regexp_matches(h, '(?i)/jobs/(r-[0-9]+)') THEN 'https://careers.acme.example/jobs/' || external_id || '/' ELSE h END AS link FROM rs),
ru AS (SELECT *, CASE WHEN title <> '' OR link_text <> '' THEN 3 ELSE 0 END + CASE WHEN text <> '' THEN 2 ELSE 0 END + length(link) / 1000 AS sc FROM rt WHERE external_id <> ''),
rb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, lower(external_id) ORDER BY sc DESC, seq) AS rn FROM ru) WHERE rn = 1)"""


@query("resolve_href", f"WITH {RESOLVED} SELECT seq, external_id, link FROM rt")
def resolve_href(spark, folder):
    return S.resolve_href(view(spark, folder, "link_rows"), SITE).select("seq", "external_id", "link")


@query("dedupe_rows_best", f"WITH {RESOLVED} SELECT source, lower(external_id) AS id_key, seq, link FROM rb")
def dedupe_rows_best(spark, folder):
    return S.dedupe_best(S.resolve_href(view(spark, folder, "link_rows"), SITE), ["source"]).select("source", "id_key", "seq", "link")


@query("hydrate_details", f"""WITH {RESOLVED}, c AS (SELECT * FROM rb), dt AS (SELECT seq AS dseq, link, 'Data Engineer ' || seq::varchar AS dtitle, html FROM rb WHERE seq % 2 = 0),
e AS (SELECT c.seq, c.source, c.title, c.text, c.link, d.dseq IS NOT NULL AS found, d.dtitle, CASE WHEN d.dseq % 4 = 0 THEN 'short' ELSE d.html END AS html FROM c LEFT JOIN (SELECT link, min(dseq) AS dseq, arg_min(dtitle, dseq) AS dtitle, arg_min(html, dseq) AS html FROM dt GROUP BY 1) d ON d.link = c.link),
f AS (SELECT *, {K.clean_pairs('html')} AS cp FROM e), g AS (SELECT *, {K.clean_text('cp')} AS clean FROM f)
SELECT source, seq, CASE WHEN found THEN link || '?canonical' ELSE link END AS href, CASE WHEN found THEN dtitle ELSE title END AS title, CASE WHEN found AND {K.quality('clean')} = 'complete' THEN clean ELSE text END AS text FROM g""")
def hydrate_details(spark, folder):
    best = S.dedupe_best(S.resolve_href(view(spark, folder, "link_rows"), SITE), ["source"])
    first = best.filter("seq % 2 = 0").groupBy("link").agg(F.min(F.struct("seq", "html")).alias("f"))
    # Every other page is a stub without usable text.
    page = F.when(F.col("f.seq") % 4 == 0, "short").otherwise(F.col("f.html"))
    details = first.select("link", F.concat("link", F.lit("?canonical")).alias("canonical"), F.concat(F.lit("Data Engineer "), F.col("f.seq").cast("string")).alias("detail_title"), page.alias("detail_text"))
    return S.hydrate_details(best.drop("html"), details).select("source", "seq", "href", "title", "text")


@query("ingest_rows_official")
def ingest_rows_official(spark, folder):
    """Link rows to postings, both variants (golden rows in the tests)."""
    rows = view(spark, folder, "link_rows")
    plain = S.postings_from_rows(rows, SITE).select(F.lit("links").alias("variant"), "external_id", "title", "location", "workplace", "apply_url")
    search = S.postings_from_search(rows.withColumn("href", F.coalesce(F.nullif("href", F.lit("")), F.lit("/"))), r"(?i)/jobs/(r-\d+)", ("Tel Aviv", "Haifa", "Jerusalem"))
    return plain.union(search.select(F.lit("search"), "external_id", "title", "location", "workplace", "apply_url"))


STAGES = """CASE seq % 7 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'mirror' WHEN 2 THEN 'rendered' WHEN 3 THEN 'static' WHEN 4 THEN 'feed' ELSE 'mirror' END"""


@query("ingest_fallback_chain", f"""WITH t AS (SELECT 's' || (seq % 40)::varchar AS source, {STAGES} AS stage FROM @@link_rows WHERE href <> ''), p AS (SELECT 's' || s_suppkey::varchar AS source, s_suppkey % 2 = 0 AS mirror_first, s_suppkey % 3 = 0 AS errored, s_suppkey % 6 = 0 AS preserve FROM supplier),
r AS (SELECT t.*, CASE WHEN stage = 'feed' THEN 0 WHEN stage = 'static' THEN 1 WHEN stage = 'mirror' AND mirror_first THEN 2 WHEN stage = 'rendered' THEN 3 WHEN stage = 'sitemap' THEN 4 ELSE 5 END AS rk FROM t JOIN p USING (source)),
w AS (SELECT source, min(rk) AS rk FROM r GROUP BY 1), k AS (SELECT r.source, min(stage) AS stage, count(*) AS n FROM r JOIN w ON w.source = r.source AND w.rk = r.rk GROUP BY 1)
SELECT p.source, k.stage, coalesce(k.n, 0) AS rows, CASE WHEN k.n > 0 THEN 'ok' WHEN errored AND preserve THEN 'deferred' WHEN errored THEN 'failed' ELSE 'empty' END AS outcome FROM p LEFT JOIN k USING (source)""")
def ingest_fallback_chain(spark, folder):
    tagged = view(spark, folder, "link_rows").filter("href <> ''").select(F.concat(F.lit("s"), (F.col("seq") % 40).cast("string")).alias("source"), F.expr(STAGES).alias("stage"))
    key = F.col("s_suppkey")
    plans = table(spark, folder, "supplier").select(F.concat(F.lit("s"), key.cast("string")).alias("source"), (key % 2 == 0).alias("mirror_first"), (key % 3 == 0).alias("errored"), (key % 6 == 0).alias("preserve"))
    return S.fallback_chain(tagged, plans)


@query("import_manual", f"""WITH s AS (SELECT source_id, job_id AS seq, title, location, CASE WHEN job_id % 3 = 0 THEN apply_url ELSE 'https://manual.example/' || (job_id % 200)::varchar END AS apply_url FROM @@postings WHERE {K.in_region('location')}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, apply_url ORDER BY seq) AS rn FROM s) WHERE rn = 1)
SELECT f.source_id, sha256(f.apply_url) AS external_id, f.seq, f.title, NOT EXISTS (SELECT 1 FROM @@snap_prev p WHERE p.source_id = f.source_id AND p.apply_url = f.apply_url) AS created FROM f""")
def import_manual(spark, folder):
    p = view(spark, folder, "postings")
    link = F.when(F.col("job_id") % 3 == 0, F.col("apply_url")).otherwise(F.concat(F.lit("https://manual.example/"), (F.col("job_id") % 200).cast("string")))
    submitted = p.select("source_id", F.col("job_id").alias("seq"), "title", "location", link.alias("apply_url"))
    return E.import_manual(submitted, view(spark, folder, "snap_prev")).select("source_id", "external_id", "seq", "title", "created")


@query("export_catalogue", "SELECT p.job_id, p.title, p.company, p.location, p.score, p.status, p.apply_url, coalesce(a.status, '') AS application_status, row_number() OVER (ORDER BY p.discovered_at DESC, p.job_id DESC) AS row_number FROM @@postings p LEFT JOIN @@applications a USING (job_id)")
def export_catalogue(spark, folder):
    rows = R.job_applications(view(spark, folder, "postings"), view(spark, folder, "applications"), "left")
    return E.export_catalogue(rows).drop("discovered_at")


@query("backup_bundle", """SELECT 'profiles' AS dataset, count(*) AS rows, count(*) FILTER (email <> '') AS filled FROM @@profiles UNION ALL SELECT 'sources', count(*), count(*) FILTER (metadata <> '') FROM @@sources
UNION ALL SELECT 'answers', count(*), count(*) FILTER (answer <> '') FROM @@answers UNION ALL SELECT 'applications', count(*), count(*) FILTER (answers <> '') FROM @@applications UNION ALL SELECT 'resumes', count(*), count(*) FILTER (email <> '') FROM @@resumes""")
def backup_bundle(spark, folder):
    tables = {name: view(spark, folder, name) for name in ("profiles", "sources", "answers", "applications", "resumes")}
    tables["profiles"] = tables["profiles"].withColumn("application_password", F.lit("secret"))
    bundle, marks = E.backup_bundle(tables), {"profiles": "email", "sources": "metadata", "answers": "answer", "applications": "answers", "resumes": "email"}
    result = None
    for name, rows in bundle.items():
        assert not set(rows.columns) & set(E.SECRETS)
        line = rows.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"), F.count_if(F.col(marks[name]) != "").alias("filled"))
        result = line if result is None else result.union(line)
    return result


@query("restore_bundle", f"""WITH o AS (SELECT user_id, kind, identifier, career_track, arg_min(name, source_id) AS name FROM @@sources WHERE source_id % 3 <> 0 GROUP BY ALL),
n0 AS (SELECT *, CASE WHEN source_id % 8 = 0 THEN '{L.CS}' ELSE career_track END AS tr FROM @@sources WHERE source_id % 2 = 0), n AS (SELECT user_id, kind, identifier, tr AS career_track, arg_max(name || ' new', source_id) AS name FROM n0 GROUP BY ALL),
ao AS (SELECT user_id, pattern, arg_max(answer, answer_id) AS answer, arg_max(auto_use, answer_id) AS auto_use FROM @@answers WHERE answer_id % 3 <> 0 GROUP BY ALL),
an AS (SELECT user_id, pattern, arg_max(CASE WHEN answer_id % 4 = 0 THEN '' ELSE answer || ' new' END, answer_id) AS answer, arg_max(answer_id % 5 = 0, answer_id) AS auto_use FROM @@answers WHERE answer_id % 2 = 0 GROUP BY ALL),
po AS (SELECT user_id, job_id, status, mode FROM @@applications WHERE application_id % 3 <> 0),
pn AS (SELECT user_id, job_id, CASE WHEN application_id % 5 = 0 THEN 'saved' ELSE status END AS status, 'review' AS mode FROM @@applications a WHERE application_id % 2 = 0 AND application_id % 7 <> 0 AND EXISTS (SELECT 1 FROM @@postings p WHERE p.job_id = a.job_id AND p.user_id = a.user_id))
SELECT 'sources' AS dataset, coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.kind, n.kind) || '/' || coalesce(o.identifier, n.identifier) || '/' || coalesce(o.career_track, n.career_track) AS item, coalesce(n.name, o.name) AS stored,
 CASE WHEN o.kind IS NULL THEN 'insert' WHEN n.kind IS NOT NULL THEN 'update' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.user_id = n.user_id AND o.kind = n.kind AND o.identifier = n.identifier AND o.career_track = n.career_track
UNION ALL SELECT 'answers', coalesce(o.user_id, n.user_id), coalesce(o.pattern, n.pattern), coalesce(n.answer, o.answer) || '/' || coalesce(n.auto_use, o.auto_use)::varchar,
 CASE WHEN o.pattern IS NULL THEN 'insert' WHEN n.pattern IS NOT NULL THEN 'update' ELSE 'keep' END FROM ao o FULL JOIN an n ON o.user_id = n.user_id AND o.pattern = n.pattern
UNION ALL SELECT 'applications', coalesce(o.user_id, n.user_id), coalesce(o.job_id, n.job_id)::varchar, coalesce(n.status, o.status) || '/' || coalesce(n.mode, o.mode),
 CASE WHEN o.job_id IS NULL THEN 'insert' WHEN n.job_id IS NOT NULL THEN 'update' ELSE 'keep' END FROM po o FULL JOIN pn n ON o.user_id = n.user_id AND o.job_id = n.job_id""")
def restore_bundle(spark, folder):
    """Sources, answers and applications of every user's own bundle; every seventh application names a posting of another user."""
    sources, answers, applications = (view(spark, folder, name) for name in ("sources", "answers", "applications"))
    owner = F.col("user_id")
    bundle = sources.filter("source_id % 2 = 0").withColumns({"name": F.concat("name", F.lit(" new")), "career_track": F.when(F.col("source_id") % 8 == 0, "astrology").otherwise(F.col("career_track"))})
    keys = ["user_id", "kind", "identifier", "career_track"]
    old = sources.filter("source_id % 3 <> 0").groupBy(*keys).agg(F.min(F.struct("source_id", "name", "company_name", "enabled")).alias("o")).select(*keys, "o.name", "o.company_name", "o.enabled")
    result = E.restore_sources(old, bundle, owner).select(F.lit("sources").alias("dataset"), "user_id", F.concat_ws("/", "kind", "identifier", "career_track").alias("item"), F.col("name").alias("stored"), "action")
    known = E.last_entries(answers.filter("answer_id % 3 <> 0"), ["user_id", "pattern"], "answer_id", ["answer", "auto_use"])
    entry = F.col("answer_id")
    told = answers.filter("answer_id % 2 = 0").select(entry.alias("seq"), "user_id", "pattern", F.when(entry % 4 != 0, F.concat("answer", F.lit(" new"))).alias("answer"), F.when(entry % 5 == 0, True).alias("auto_use"))
    rows = E.restore_answers(known, told, owner)
    result = result.union(rows.select(F.lit("answers"), "user_id", "pattern", F.concat_ws("/", "answer", F.col("auto_use").cast("string")), "action"))
    entry = F.col("application_id")
    stored = applications.filter("application_id % 3 <> 0").select("user_id", "job_id", "status", "mode", "reminder_at")
    sent = applications.filter("application_id % 2 = 0").select(
        entry.alias("seq"), F.when(entry % 7 == 0, owner + 1).otherwise(owner).alias("user_id"), "job_id", F.when(entry % 5 == 0, "").otherwise(F.col("status")).alias("status"), F.lit(None).cast("string").alias("mode"), "reminder_at")
    rows = E.restore_applications(stored, sent, view(spark, folder, "postings"), owner)
    return result.union(rows.select(F.lit("applications"), "user_id", F.col("job_id").cast("string"), F.concat_ws("/", "status", "mode"), "action"))


@query("migrate_tables", """SELECT 'customer' AS dataset, c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'store/' || c_name ELSE c_name END AS path, 'owner-1' AS user_id FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, 'owner-1' FROM supplier""")
def migrate_tables(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"), F.lit("old").alias("user_id"), F.col("c_acctbal").alias("dropped"))
    paths = customers.filter("id % 2 = 0").select(F.col("path").alias("old_path"), F.concat(F.lit("store/"), "path").alias("new_path"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path"))
    columns = ["id", "path", "user_id", "extra"]
    first = E.migrate_table(customers, columns, "owner-1", paths, "path").select(F.lit("customer").alias("dataset"), "id", "path", "user_id")
    return first.union(E.migrate_table(suppliers, columns, "owner-1").select(F.lit("supplier"), "id", "path", "user_id"))


@query("card_rows", f"""WITH c AS (SELECT seq, {K.squeeze('title')} AS title, {K.squeeze('text')} AS text FROM @@link_rows), k AS (SELECT * FROM c WHERE title <> '' AND lower(title) NOT IN {K.names(S.CARD_HEADINGS_IGNORED)} AND length(title) BETWEEN 3 AND 180
  AND length(text) >= greatest(35, length(title) + 12) AND {K.has_any('lower(text)', S.CARD_SIGNALS)}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY seq) AS rn FROM k) WHERE rn = 1)
SELECT seq, title, text, substring(sha256(title || chr(10) || substring(text, 1, 800)), 1, 16) AS external_id FROM f""")
def card_rows(spark, folder):
    return S.card_rows(view(spark, folder, "link_rows"))
