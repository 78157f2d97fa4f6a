"""Queries for the text, URL, date and feature functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import lexicons as L
from vacantia.functions import contacts as C, dates as D, features as X, locations as P, text as T, titles as H, urls as U
from vacantia.operators.profiles import mirror_latest_job
from vacantia.plans import duck as K
from vacantia.plans.fixtures import spread, table, view
from vacantia.plans.registry import query


def joined(values: Column) -> Column:
    return F.array_join(values, "|")


@query("clean_text", f"""
WITH t AS (SELECT 'page' AS kind, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents),
p AS (SELECT kind, id, {K.clean_pairs('body')} AS pairs FROM t)
SELECT kind, id, {K.clean_text('pairs')} AS clean FROM p""")
def clean_text(spark, folder):
    pages = table(spark, folder, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    documents = table(spark, folder, "documents").select(F.lit("document"), "doc_id", "text")
    return spread(pages.union(documents)).select("kind", "id", T.clean_text(F.col("body")).alias("clean"))


@query("html_to_text", f"SELECT page_id, {K.html_to_text('html')} AS plain FROM pages")
def html_to_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.html_to_text(F.col("html")).alias("plain"))


@query("text_quality", f"""
WITH p AS (SELECT doc_id, {K.clean_pairs('text')} AS pairs FROM documents),
c AS (SELECT doc_id, {K.clean_text('pairs')} AS clean FROM p)
SELECT doc_id, {K.quality('clean')} AS quality FROM c""")
def text_quality(spark, folder):
    return spread(table(spark, folder, "documents")).select("doc_id", T.text_quality(F.col("text")).alias("quality"))


@query("parse_posted_at", """
WITH e AS (SELECT event_id AS id, 'event' AS kind, CASE event_id % 5 WHEN 4 THEN NULL ELSE floor(epoch(ts::timestamp))::bigint END AS seconds FROM events
 UNION ALL SELECT o_orderkey, 'order', CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE floor(epoch(o_orderdate::timestamp))::bigint END FROM orders)
SELECT kind, id, strftime(to_timestamp(seconds) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS posted_at FROM e""")
def parse_posted_at(spark, folder):
    """Each stamp is written the ways boards write it (seconds, milliseconds, ISO forms, junk) and read back."""
    events = table(spark, folder, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("t"))
    orders = table(spark, folder, "orders").select(F.lit("order"), "o_orderkey", F.col("o_orderdate").cast("timestamp"))
    way, t = F.col("id") % 5, F.date_trunc("second", "t")
    text = (F.when(way == 0, F.unix_timestamp(t).cast("string")).when(way == 1, (F.unix_timestamp(t) * 1000).cast("string"))
            .when(way == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(way == 3, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
            .otherwise("soon"))
    # Ten-digit millisecond values (before 1970-04-26) do not occur in these tables.
    return events.union(orders).select("kind", "id", D.parse_posted_at(text).cast("string").alias("posted_at"))


@query("norm_location", f"SELECT job_id, {K.norm_location("location || chr(160) || chr(8207) || ' ， Ａ'")} AS normal FROM @@postings")
def norm_location(spark, folder):
    messy = F.concat(F.col("location"), F.lit(" ‏ ， Ａ"))
    return view(spark, folder, "postings").select("job_id", P.norm_location(messy).alias("normal"))


ROW_TEXT = "location || ' ' || title || ' ' || description"


@query("canonical_city", f"""
WITH p AS (SELECT job_id, location, {ROW_TEXT} AS body FROM @@postings)
SELECT job_id, {K.canonical_city('location')} AS city, {K.canonical_city('body')} AS row_city FROM p""")
def canonical_city(spark, folder):
    body = F.concat_ws(" ", "location", "title", "description")
    return spread(view(spark, folder, "postings")).select(
        "job_id", P.canonical_city(F.col("location")).alias("city"), P.canonical_city(body).alias("row_city"))


@query("location_tokens", f"SELECT job_id, {K.joined(K.location_tokens('location'))} AS tokens FROM @@postings")
def location_tokens(spark, folder):
    return view(spark, folder, "postings").select("job_id", joined(P.location_tokens(F.col("location"))).alias("tokens"))


def _workplace(first, second):
    low = "lower(coalesce(location, '') || ' ' || coalesce(body, ''))"
    return (f"CASE WHEN contains({low}, '{first}') THEN '{first}' WHEN contains({low}, '{second}') THEN '{second}' "
            f"WHEN location <> '' THEN 'onsite' ELSE 'unknown' END")


@query("workplace_detect", f"""
WITH p AS (SELECT job_id, location, description || ' ' || workplace || CASE WHEN job_id % 4 < 2 THEN ' Remote or hybrid' ELSE '' END AS body FROM @@postings)
SELECT job_id, {_workplace('remote', 'hybrid')} AS remote_first, {_workplace('hybrid', 'remote')} AS hybrid_first FROM p""")
def workplace_detect(spark, folder):
    body = F.concat(F.col("description"), F.lit(" "), F.col("workplace"), F.when(F.col("job_id") % 4 < 2, " Remote or hybrid").otherwise(""))
    return spread(view(spark, folder, "postings")).select(
        "job_id", P.workplace_detect(body, F.col("location")).alias("remote_first"),
        P.workplace_detect(body, F.col("location"), "hybrid").alias("hybrid_first"))


@query("url_key", f"""
WITH u AS (SELECT 'page' AS kind, page_id AS id, url FROM pages UNION ALL SELECT 'posting', job_id, apply_url FROM @@postings)
SELECT kind, id, {K.url_key('url')} AS url_key FROM u""")
def url_key(spark, folder):
    pages = table(spark, folder, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    postings = view(spark, folder, "postings").select(F.lit("posting"), "job_id", "apply_url")
    return pages.union(postings).select("kind", "id", U.url_key(F.col("url")).alias("url_key"))


@query("ats_adapter", f"""
WITH a AS (SELECT p.job_id, {K.ats_family('p.apply_url', 's.kind')} AS family FROM @@postings p LEFT JOIN @@sources s USING (source_id))
SELECT job_id, family, family IN {K.AUTO_FAMILIES} AS auto_submit FROM a""")
def ats_adapter(spark, folder):
    rows = view(spark, folder, "postings").join(view(spark, folder, "sources").select("source_id", "kind"), "source_id", "left")
    family = U.ats_family(F.col("apply_url"), F.col("kind"))
    return rows.select("job_id", family.alias("family")).withColumn("auto_submit", U.auto_submit(F.col("family")))


def _cta(col):
    generic = sorted({t.strip(H.CTA_EDGES) for t in L.GENERIC_LINK_TITLES})
    return f"trim(lower({col}), ' .…→-') IN {K.names(generic)}"


def _human(col):
    c = K.squeeze(col)
    return (f"({c} <> '' AND NOT {_cta(c)} AND NOT regexp_matches({c}, '^(?i)ref[0-9]+[a-z]?$') AND NOT regexp_matches("
            rf"regexp_replace({c}, '\s+', '-', 'g'), '^(?i)(?:oracle|seat)-[a-f0-9-]+(?:-t[0-9]+)?-[0-9]+$'))")


@query("title_human", f"SELECT seq, {_human('title')} OR {_human('link_text')} AS human FROM @@link_rows")
def title_human(spark, folder):
    return view(spark, folder, "link_rows").select("seq", H.title_human(F.col("title"), F.col("link_text")).alias("human"))


def _slug(expr, upper):
    words = f"list_filter(string_split(replace({expr}, '_', '-'), '-'), lambda w: w <> '')"
    return (f"array_to_string(list_transform({words}, lambda w: CASE WHEN lower(w) IN {K.names(upper)} THEN upper(w) "
            f"ELSE upper(substring(w, 1, 1)) || lower(substring(w, 2)) END), ' ')")


_PARTS = r"list_filter(string_split(regexp_extract(url, '^([^?]*)', 1), '/'), lambda p: p <> '')"
_LINK_SLUG = f"regexp_replace(coalesce({_PARTS}[-1], ''), '^(?i)(?:job|position)-', '')"


@query("title_resolve", rf"""
WITH p AS (SELECT page_id, url, {K.squeeze("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS heading,
  CASE page_id % 3 WHEN 0 THEN 'Read more' WHEN 1 THEN '' ELSE chr(10) || ' Data Engineer ' || chr(10) || 'Haifa' END AS link_text,
  {_slug(_LINK_SLUG, L.UPPERCASE_SLUG_WORDS)} AS slug FROM pages),
s AS (SELECT *, CASE WHEN heading <> '' THEN heading ELSE {K.squeeze('link_text')} END AS shown,
  CASE page_id % 3 WHEN 0 THEN 'Read more' WHEN 1 THEN heading ELSE 'Data Engineer' END AS preferred FROM p)
SELECT page_id, CASE WHEN shown = '' OR {_cta('shown')} THEN slug ELSE shown END AS title, slug AS slug_title,
  CASE WHEN preferred = '' OR {_cta('preferred')} THEN slug ELSE preferred END AS link_title FROM s""")
def title_resolve(spark, folder):
    heading = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    way = F.col("page_id") % 3
    link = F.when(way == 0, "Read more").when(way == 1, "").otherwise("\n Data Engineer \nHaifa")
    return table(spark, folder, "pages").select(
        "page_id", H.title_resolve(heading, link, F.col("url")).alias("title"),
        H.title_resolve(heading, link, F.col("url"), force_slug=True).alias("slug_title"),
        H.title_resolve(heading, link, F.col("url"), prefer_link_text=True).alias("link_title"))


@query("title_repair", rf"""
WITH r AS (SELECT seq, source, CASE WHEN page_code THEN 'AB1-2c3' ELSE title END AS title, {K.squeeze('text')} AS body
  FROM (SELECT *, seq % 2 = 0 AS page_code FROM @@link_rows))
SELECT seq, CASE WHEN source = 'camtek' AND lower(title) = 'open positions' THEN ''
  WHEN source = 'camtek' AND regexp_matches(title, '^[A-Fa-f0-9]{{2,3}}[.-][A-Fa-f0-9]{{3}}$')
    THEN trim(regexp_extract(body, '(?i)^(.+?)\s+(?:R&D|Marketing|Operations|Engineering|Product|Applications?)\s+Migdal', 1))
  WHEN source = 'speedata' AND regexp_matches(body, '(?i)^(.+?)\s+Israel\s+About the position')
    THEN trim(regexp_extract(body, '(?i)^(.+?)\s+Israel\s+About the position', 1)) ELSE title END AS title FROM r""")
def title_repair(spark, folder):
    rows = view(spark, folder, "link_rows")
    title = F.when(F.col("seq") % 2 == 0, "AB1-2c3").otherwise(F.col("title"))
    return rows.select("seq", H.title_repair(F.col("source"), title, F.col("text")).alias("title"))


@query("slug_title_positional", f"""
WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://careers.acme.example/jobs/senior_c-ml-developer' || CAST(page_id AS VARCHAR) || '/x?y' END AS url FROM pages),
p AS (SELECT page_id, list_filter(string_split({K.path('url')}, '/'), lambda v: v <> '') AS parts FROM u)
SELECT page_id, CASE WHEN parts[-3] = 'jobs' THEN {_slug('parts[-2]', (*L.UPPERCASE_SLUG_WORDS, 'c'))} ELSE '' END AS title FROM p""")
def slug_title_positional(spark, folder):
    made = F.concat(F.lit("https://careers.acme.example/jobs/senior_c-ml-developer"), F.col("page_id").cast("string"), F.lit("/x?y"))
    url = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(made)
    return table(spark, folder, "pages").select("page_id", H.slug_title_positional(url).alias("title"))


@query("native_apply_url", """
SELECT p.job_id, CASE WHEN s.kind = 'greenhouse' THEN 'https://job-boards.greenhouse.io/' || regexp_replace(s.identifier, '^(?i)eu:', '') || '/jobs/' || p.external_id
  ELSE p.apply_url END AS native_url FROM @@postings p LEFT JOIN @@sources s USING (source_id)""")
def native_apply_url(spark, folder):
    rows = view(spark, folder, "postings").join(view(spark, folder, "sources").select("source_id", "kind", "identifier"), "source_id", "left")
    return rows.select("job_id", U.native_apply_url(F.col("kind"), F.col("identifier"), F.col("external_id"), F.col("apply_url")).alias("native_url"))


@query("confirmation_url", """
SELECT attempt_id, started_at::varchar AS started_at, CASE WHEN page_url LIKE 'https://jobs.lever.co/%/thanks/' THEN 'Lever confirmation page reached after submitting the application'
  WHEN page_url LIKE 'https://www.lever.co/hp-b?%leverAppId=%' THEN 'Lever accepted the application (application id: ' || split_part(page_url, 'leverAppId=', 2) || ')' ELSE '' END AS evidence,
  CASE WHEN page_url LIKE 'https://www.lever.co/hp-b?%leverAppId=%' THEN split_part(page_url, 'leverAppId=', 2) ELSE '' END AS external_id
FROM @@attempts""")
def confirmation_url(spark, folder):
    proof = U.confirmation(F.col("page_url"))
    return view(spark, folder, "attempts").select(
        "attempt_id", F.col("started_at").cast("string").alias("started_at"), proof["evidence"].alias("evidence"), proof["application_id"].alias("external_id"))


@query("company_site", "SELECT job_id, CASE " + " ".join(
    f"WHEN {K.has_any('trim(lower(company))', aliases)} THEN {K.text(site)}" for aliases, site in L.CAREER_SITES.values())
    + " WHEN apply_url LIKE 'https://%' THEN 'https://' || split_part(apply_url, '/', 3) ELSE '' END AS site FROM @@postings")
def company_site(spark, folder):
    return view(spark, folder, "postings").select("job_id", U.company_site(F.col("company"), F.col("apply_url")).alias("site"))


@query("question_norm", f"SELECT conv_id, turn, {K.question_norm('text')} AS plain, {K.memory_norm('text')} AS memory FROM conversations")
def question_norm(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", T.question_norm(F.col("text")).alias("plain"), T.memory_norm(F.col("text")).alias("memory"))


def _category(col):
    rules = sorted(L.QUESTION_GROUPS.items(), key=lambda item: -len(item[1]))
    return "CASE " + " ".join("WHEN " + " AND ".join(K.has_any(col, g) for g in groups) + f" THEN {K.text(k)}" for k, groups in rules) + " END"


@query("question_category", f"""
WITH q AS (SELECT seq, {K.question_norm('question')} AS plain FROM @@messages)
SELECT seq, {_category('plain')} AS category FROM q""")
def question_category(spark, folder):
    return view(spark, folder, "messages").select("seq", T.question_category(F.col("question")).alias("category"))


LOW = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"


def title_text() -> Column:
    return F.concat_ws(" ", "title", "description")


@query("experience_extract", f"""
WITH p AS (SELECT job_id, {LOW} AS low FROM @@postings)
SELECT job_id, {K.experience_min('low')} AS experience_min, {K.experience_max('low')} AS experience_max FROM p""")
def experience_extract(spark, folder):
    found = X.experience_extract(title_text())
    return spread(view(spark, folder, "postings")).select("job_id", found.alias("e")).select("job_id", "e.*")


@query("experience_buckets", f"""
WITH p AS (SELECT job_id, {LOW} AS low FROM @@postings),
e AS (SELECT job_id, {K.experience_min('low')} AS lo, {K.experience_max('low')} AS hi FROM p)
SELECT job_id, {K.joined(K.buckets('lo', 'hi'))} AS buckets FROM e""")
def experience_buckets(spark, folder):
    rows = spread(view(spark, folder, "postings")).select("job_id", X.experience_extract(title_text()).alias("e"))
    return rows.select("job_id", joined(X.experience_buckets(F.col("e.experience_min"), F.col("e.experience_max"))).alias("buckets"))


@query("seniority_detect", f"SELECT job_id, {K.seniority('title')} AS level FROM @@postings")
def seniority_detect(spark, folder):
    return view(spark, folder, "postings").select("job_id", X.seniority_detect(F.col("title")).alias("level"))


@query("seniority_of_years", f"SELECT user_id, career_track, {K.years_level('years_experience')} AS level FROM @@profiles")
def seniority_of_years(spark, folder):
    return view(spark, folder, "profiles").select("user_id", "career_track", X.seniority_of_years(F.col("years_experience")).alias("level"))


@query("employment_type", f"WITH p AS (SELECT job_id, {LOW} AS low FROM @@postings) SELECT job_id, {K.first('low', L.EMPLOYMENT_TYPES)} AS employment FROM p")
def employment_type(spark, folder):
    return spread(view(spark, folder, "postings")).select("job_id", X.employment_type(title_text()).alias("employment"))


@query("skills_extract", f"WITH p AS (SELECT job_id, {LOW} AS low FROM @@postings) SELECT job_id, {K.joined(K.keys('low', L.SKILLS))} AS skills FROM p")
def skills_extract(spark, folder):
    return spread(view(spark, folder, "postings")).select("job_id", joined(X.skills_extract(title_text())).alias("skills"))


SKILL_CLASSES_SQL = rf"""
SELECT job_id, lower(coalesce(title, '') || '. ' || coalesce(description, '')) AS low, lower(coalesce(title, '')) AS low_title FROM @@postings"""


def skill_class_ctes(source: str = SKILL_CLASSES_SQL) -> str:
    """CTEs ending in ``classes(job_id, required, preferred, supporting, all_skills)``."""
    pref, req = K.has_any("s", L.PREFERRED_MARKERS), K.has_any("s", L.REQUIRED_MARKERS)
    return rf"""c0 AS ({source}),
c1 AS (SELECT *, string_split_regex(low, '[\n.!?;]+') AS ss FROM c0),
c2 AS (SELECT *, array_to_string(list_filter(ss, lambda s: {pref}), chr(10)) AS pref_text,
   array_to_string(list_filter(ss, lambda s: {req} AND NOT {pref}), chr(10)) AS req_text FROM c1),
c3 AS (SELECT job_id, {K.keys('low', L.SKILLS)} AS all_skills, {K.keys('low_title', L.SKILLS)} AS title_skills,
   {K.keys('pref_text', L.SKILLS)} AS p_skills, {K.keys('req_text', L.SKILLS)} AS r_skills FROM c2),
c4 AS (SELECT job_id, all_skills, list_sort(list_distinct(list_concat(r_skills, title_skills))) AS required, p_skills FROM c3),
c5 AS (SELECT job_id, all_skills, required, list_filter(p_skills, lambda v: NOT list_contains(required, v)) AS preferred FROM c4),
classes AS (SELECT job_id, all_skills, required, preferred, CASE WHEN len(required) = 0 THEN all_skills ELSE
   list_filter(all_skills, lambda v: NOT list_contains(required, v) AND NOT list_contains(preferred, v)) END AS supporting FROM c5)"""


@query("skills_classify", f"WITH {skill_class_ctes()} SELECT job_id, {K.joined('required')} AS required, {K.joined('preferred')} AS preferred, {K.joined('supporting')} AS supporting FROM classes")
def skills_classify(spark, folder):
    from vacantia.operators.job_features import skill_classes

    rows = skill_classes(spread(view(spark, folder, "postings")))
    return rows.select("job_id", *[joined(F.col(c)).alias(c) for c in ("required", "preferred", "supporting")])


@query("role_families", f"SELECT job_id, {K.joined(K.families('title', 'career_track'))} AS families FROM @@postings")
def role_families(spark, folder):
    return view(spark, folder, "postings").select("job_id", joined(X.role_families(F.col("title"), F.col("career_track"))).alias("families"))


def _profile_link(pattern):
    found = f"rtrim(regexp_extract(text, {K.text(pattern)}, 0), '.,;:')"
    return f"CASE WHEN {found} = '' OR regexp_matches({found}, '(?i)^https?://') THEN {found} ELSE 'https://' || {found} END"


_LINKS = f"list_transform(regexp_extract_all(text, {K.text(C.LINK)}), lambda u: rtrim(u, '.,;:'))"


@query("contact_extract", f"""
WITH t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'resume', resume_id, extracted_text FROM @@resumes
  UNION ALL SELECT 'message', conv_id * 1000 + turn, text FROM conversations)
SELECT kind, id, rtrim(regexp_extract(text, {K.text(C.EMAIL)}, 0), '.,;:') AS email, regexp_extract(text, {K.text(C.PHONE)}, 0) AS phone,
  {_profile_link(C.LINKEDIN)} AS linkedin_url, {_profile_link(C.GITHUB)} AS github_url,
  coalesce(list_filter({_LINKS}, lambda u: NOT {K.has_any('lower(u)', C.SOCIAL_HOSTS)})[1], '') AS portfolio_url FROM t""")
def contact_extract(spark, folder):
    rows = contact_texts(spark, folder)
    text = F.col("text")
    return rows.select("kind", "id", C.email(text).alias("email"), C.phone(text).alias("phone"),
                       C.profile_link(text, C.LINKEDIN).alias("linkedin_url"), C.profile_link(text, C.GITHUB).alias("github_url"),
                       C.portfolio(text).alias("portfolio_url"))


def contact_texts(spark, folder) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    resumes = view(spark, folder, "resumes").select(F.lit("resume"), "resume_id", "extracted_text")
    messages = table(spark, folder, "conversations").select(F.lit("message"), F.col("conv_id") * 1000 + F.col("turn"), "text")
    return documents.union(resumes).union(messages)


@query("contact_names")
def contact_names(spark, folder):
    """Name and place from the head of every text (no SQL twin: needs look-around and per-line rules)."""
    return spread(contact_texts(spark, folder)).select("kind", "id", C.name_and_place(F.col("text")).alias("v")).select("kind", "id", "v.*")


@query("phone_norm", r"""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '+972-52-' WHEN 1 THEN '00972 (0)52 ' WHEN 2 THEN '052' ELSE '+1 ' END || CAST(1000000 + doc_id AS VARCHAR) AS phone,
  regexp_extract(text, '(?:\+972[- ()]?|0)5\d(?:[- ()]?\d){7}', 0) AS found FROM documents),
d AS (SELECT doc_id, regexp_replace(phone, '\D', '', 'g') AS a, regexp_replace(found, '\D', '', 'g') AS f FROM t),
e AS (SELECT doc_id, CASE WHEN starts_with(a, '00972') THEN substring(a, 3) ELSE a END AS a, f FROM d)
SELECT doc_id, CASE WHEN regexp_full_match(a, '9720?[0-9]{9}') THEN '0' || right(a, 9) ELSE a END AS made,
  CASE WHEN regexp_full_match(f, '9720?[0-9]{9}') THEN '0' || right(f, 9) ELSE f END AS found FROM e""")
def phone_norm(spark, folder):
    way = F.col("doc_id") % 4
    prefix = F.when(way == 0, "+972-52-").when(way == 1, "00972 (0)52 ").when(way == 2, "052").otherwise("+1 ")
    made = F.concat(prefix, (F.lit(1000000) + F.col("doc_id")).cast("string"))
    return table(spark, folder, "documents").select(
        "doc_id", C.phone_norm(made).alias("made"), C.phone_norm(C.phone(F.col("text"))).alias("found"))


@query("profile_fields", """
SELECT c_custkey AS user_id, split_part(c_name, '#', 1) AS first_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE split_part(c_name, '#', 2) || ' Jr' END AS last_name,
  CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(1 + c_nationkey % 12 AS VARCHAR), 2, '0') || '/2019' ELSE '2019' END AS month,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_mktsegment ELSE 'Company ' || CAST(c_nationkey AS VARCHAR) END AS current_company,
  CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS experiences FROM customer""")
def profile_fields(spark, folder):
    c = table(spark, folder, "customer")
    way = F.col("c_custkey") % 3
    name = F.when(way == 0, F.concat(F.lit("  "), F.substring_index("c_name", "#", 1))).otherwise(
        F.concat(F.regexp_replace("c_name", "#", "  "), F.lit("  Jr ")))
    job = lambda company: F.struct(F.lit("").alias("job_title"), company.alias("company"), F.lit(" ").alias("location"))
    blank, segment = job(F.lit(" ")), job(F.col("c_mktsegment"))
    board = job(F.concat(F.lit("Company "), F.col("c_nationkey").cast("string")))
    history = F.when(way == 0, F.array(blank)).when(way == 1, F.array(blank, segment)).otherwise(F.array(board, segment))
    month = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("2019-"), F.lpad((1 + F.col("c_nationkey") % 12).cast("string"), 2, "0"))).otherwise("2019")
    rows = c.select(F.col("c_custkey").alias("user_id"), C.split_name(name).alias("n"), D.month_first(month).alias("month"), history.alias("work_experiences"))
    rows = mirror_latest_job(rows, ("job_title", "company", "location"))
    return rows.select("user_id", "n.*", "month", F.col("current_company"), F.size("work_experiences").alias("experiences"))


@query("json_default", """
SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, CASE WHEN event_id % 4 = 0 THEN -1 ELSE coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) END AS broken_k FROM events""")
def json_default(spark, folder):
    default = F.struct(F.lit(-1).cast("bigint").alias("k"))
    broken = F.when(F.col("event_id") % 8 == 0, "").when(F.col("event_id") % 4 == 0, "not json").otherwise(F.col("props"))
    read = lambda c: F.coalesce(T.json_default(c, "k bigint", default)["k"], F.lit(-1).cast("bigint"))
    return table(spark, folder, "events").select("event_id", read(F.col("props")).alias("k"), read(broken).alias("broken_k"))
