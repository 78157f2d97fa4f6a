"""Views over the given tables: postings, profiles, sources, applications and so on.

Each view is one SQL text with a few tokens that differ between Spark and DuckDB:

=================  ==========================================================
``@table``         a given table
``@@view``         another view of this module, as a subquery
``a DIV b``        integer division
``DAYS(n)``        interval of n days; ``MINUTES(n)`` likewise
``LIST(text)``     array from text separated by ``|``
``NOW``            the fixed reference time
=================  ==========================================================
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vacantia import lexicons as L

NOW = "2024-01-31 12:00:00"

TITLES = (
    "Backend Software Engineer", "Frontend Developer", "Machine Learning Engineer", "RF Hardware Engineer",
    "DFT Engineer", "Backend STA Engineer", "Logic Design Engineer", "CPU Power Architect",
    "Optical Sub-System Architect", "Design Verification Engineer", "Power Management Firmware Architect",
    "Principal Open-Source Networking Architect", "Procurement Specialist", "RTL Design Engineer", "FPGA Engineer",
    "RF Engineer", "Supply Chain Planner", "PMO Project Manager", "BI Data Analyst", "RTL Verification Engineer",
    "Senior Backend Software Engineer", "Junior Python Developer", "Student Data Analyst", "Warehouse Associate",
    "Team Lead C++ Developer", "Product Manager", "Graduate Software Developer", "Manual QA Engineer",
    "מהנדסת תוכנה", "מהנדס חשמל", "מנהל.ת רכש", "מפתח תוכנה משובצת", "Data Research Analyst", "IT Support Engineer",
    "Full-Stack Developer (React)", "Staff Engineer, Platform", "Operations Coordinator", "Chef",
)
SENTENCES = (
    "Python and Kubernetes required. Docker is an advantage",
    "Requires 0-2 years experience with Linux and Git",
    "At least 3 years of experience; must know SQL and AWS",
    "8 or more years of professional experience, computer science degree",
    "No prior experience required. Full-time position in software and python",
    "Experience working with Kubernetes is a plus",
    "Hands-on experience developing production services in Java is required",
    "דרישות: ניסיון מוכח של 3 שנים לפחות בפיתוח תוכנה משובצת",
    "Verilog and SystemVerilog mandatory; UVM preferred. Electrical Engineering degree, ASIC and FPGA",
    "Excel, SAP and Power BI. Industrial engineering degree, supply chain planning, inventory",
    "Student position, part-time, machine learning and data structures",
    "4 years experience. Security clearance and certification needed",
    "React, TypeScript and node.js nice to have; contract role",
    "PyTorch, LLM and computer vision research, 2-4 yrs",
    "Experience in distributed systems, microservices and golang",
    "Silicon, chip design and soc validation in c++. Minimum 5 years",
    "ניתוח נתונים, אקסל ורכש, עדיפות לבוגרי תעשייה וניהול",
    "Preferred: hands-on experience with AWS, terraform and ansible",
    "Bachelor degree, 1 to 3 years, RF and analog design, matlab advantage",
    "Call 052-123-4567 or write to jobs@example.com, see https://github.com/example",
)
CITIES = (
    "Tel Aviv, Israel", "Haifa", "Herzliya Pituach", "", "Remote", "Chicago, IL", "London, United Kingdom",
    "Jerusalem / Hybrid", "תל אביב", "חיפה, ישראל", "Petach Tikva", "Ra`anana", "Beer Sheva", "Israel", "EMEA",
    "Rishon LeZion", "קריית גת", "New York, NY", "Remote - Israel", "Yokneam",
)
COMPANIES = (
    "Company 0", "Google", "Company 2", "Intel Israel", "Company 4", "Applied Materials", "Company 6", "Mobileye",
    "Company 8", "Redis", "Company 10", "Amazon AWS", "Company 12", "Elbit Systems Ltd", "Company 14",
)
# track number, skills, desired titles, locations, work modes, keywords, exclusions, experience options, resume skills
PROFILE_KINDS = (
    (0, "python|kubernetes|docker|aws|git", "backend software engineer|python developer|full-stack", "Tel Aviv|Haifa",
     "hybrid|remote", "senior|python|automation", "manual qa|student", "3|4|5+", "linux"),
    (0, "c++|linux|data structures|rest api", "software engineer|backend|r&d", "Haifa|Tel Aviv|Israel|Remote",
     "remote|hybrid|onsite", "junior|c++|graduate", "senior|sales", "0|1", "python|sql"),
    (0, "javascript|react|node.js", "frontend", "Jerusalem", "onsite", "entry level|react", "it|lead", "", ""),
    (0, "", "", "", "", "", "", "0|1|2", "java"),
    (1, "excel|sql|power bi|sap", "supply chain|data analyst|pmo", "Israel|Central Israel", "hybrid|onsite",
     "planning|student|operations", "software engineer|frontend", "0|1|2|3", "erp"),
    (1, "procurement|lean|six sigma", "procurement|buyer|planner", "Tel Aviv", "onsite", "inventory|junior",
     "warehouse associate", "2|3", ""),
    (1, "data analysis|statistics", "business analyst", "", "remote", "data analysis", "manager", "", "python|tableau"),
    (1, "Excel|SQL", "project manager|product manager", "Haifa|Jerusalem", "hybrid", "manager", "chef", "5+", "excel"),
    (2, "verilog|fpga|uvm|matlab", "fpga engineer|verification engineer|rtl", "Haifa|Israel", "hybrid|onsite|remote",
     "fpga|asic|graduate", "full stack|sales representative", "0|1|2|3|4|5+", "systemverilog"),
    (2, "rf|analog design|pcb", "rf engineer|hardware engineer", "Tel Aviv|Jerusalem", "onsite", "rf|senior", "frontend",
     "3|4|5+", ""),
    (2, "embedded|c++", "embedded engineer|firmware", "Yokneam", "hybrid", "firmware", "staff|dft", "", "linux|git"),
    (2, "", "electrical engineer", "Israel", "", "hardware|lead", "optical", "1|2", "vhdl"),
)
TRACK_NUMBERS = tuple(enumerate((L.CS, L.IEM, L.EE)))


def sql_text(value: object) -> str:
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    """An inline table; rows of plain strings are numbered from 0."""
    rows = [(i, r) if isinstance(r, str) else r for i, r in enumerate(rows)]
    body = ", ".join("(" + ", ".join(sql_text(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


def pick(expression: str, rows) -> str:
    return f"({expression}) % {len(rows)}"


OWNER = "CASE WHEN {0} % 3 = 0 THEN 7 ELSE {0} % 500 END"

VIEWS: dict[str, str] = {}

VIEWS["postings"] = f"""
SELECT d.doc_id AS job_id, {OWNER.format('d.doc_id')} AS user_id,
  CASE WHEN d.doc_id % 3 = 1 THEN 4 ELSE d.doc_id % 20 END AS source_id,
  'd' || CAST(d.doc_id AS STRING) AS external_id, t.title, co.company, c.city AS location,
  CASE d.doc_id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' ELSE 'unknown' END AS workplace,
  d.text || chr(10) || s.sentence AS description,
  CASE d.doc_id % 7
    WHEN 0 THEN 'https://job-boards.greenhouse.io/acme/jobs/' || CAST(d.doc_id AS STRING)
    WHEN 1 THEN 'https://www.comeet.com/jobs/acme/' || CAST(d.doc_id AS STRING)
    WHEN 2 THEN 'https://jobs.lever.co/mobileye/' || CAST(d.doc_id AS STRING)
    WHEN 3 THEN 'https://jobs.ashbyhq.com/acme/' || CAST(d.doc_id AS STRING) || '/'
    WHEN 4 THEN 'https://acme.wd1.myworkdayjobs.com/site/job/Israel-Haifa/role_R' || CAST(d.doc_id AS STRING)
    WHEN 5 THEN 'https://jobs.smartrecruiters.com/Acme/' || CAST(d.doc_id AS STRING)
    ELSE 'https://careers.acme.example/show?utm=x&gh_jid=' || CAST(d.doc_id AS STRING) END AS apply_url,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL
       ELSE NOW - DAYS(d.doc_id % 60) - MINUTES(d.doc_id % 1440) END AS published_at,
  CASE (d.doc_id DIV 3) % 3 WHEN 0 THEN '{L.CS}' WHEN 1 THEN '{L.IEM}' ELSE '{L.EE}' END AS career_track,
  d.doc_id % 11 <> 0 AS is_active,
  CASE d.doc_id % 6 WHEN 1 THEN 'saved' WHEN 2 THEN 'queued' WHEN 4 THEN 'submitted' ELSE 'new' END AS status,
  CAST((d.doc_id * 37) % 101 AS INT) AS score,
  NOW - MINUTES(d.doc_id % 20000) AS updated_at, NOW - DAYS(d.doc_id % 90) AS discovered_at,
  CASE WHEN d.doc_id % 11 = 0 AND (d.doc_id DIV 11) % 3 <> 0 THEN NOW - DAYS(d.doc_id % 50) END AS removed_at
FROM @documents d
JOIN {values(TITLES, 'i, title')} t ON t.i = {pick('d.doc_id * 7 + d.doc_id DIV 20', TITLES)}
JOIN {values(SENTENCES, 'i, sentence')} s ON s.i = {pick('d.doc_id DIV 2', SENTENCES)}
JOIN {values(CITIES, 'i, city')} c ON c.i = {pick('d.doc_id DIV 3', CITIES)}
JOIN {values(COMPANIES, 'i, company')} co ON co.i = {pick('d.doc_id DIV 5', COMPANIES)}
"""

VIEWS["profiles"] = " UNION ALL ".join(f"""
SELECT c.c_custkey AS user_id, '{track}' AS career_track, c.c_name AS full_name,
  CASE WHEN c.c_custkey % 4 = 0 THEN '' ELSE 'user' || CAST(c.c_custkey AS STRING) || '@mail.example' END AS email,
  CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE '+972-52-' || CAST(1000000 + c.c_custkey AS STRING) END AS phone,
  CASE WHEN c.c_custkey % 6 = 0 THEN ' ' ELSE 'Haifa' END AS location,
  CASE WHEN c.c_custkey % 3 = 0 THEN '' ELSE 'https://linkedin.com/in/u' || CAST(c.c_custkey AS STRING) END AS linkedin_url,
  CASE WHEN c.c_custkey % 7 = 0 THEN '' ELSE '/cv/' || CAST(c.c_custkey AS STRING) || '.pdf' END AS cv_path,
  CAST(c.c_custkey % 8 AS DOUBLE) AS years_experience, LIST(k.options) AS years_options,
  LIST(k.skills) AS skills, LIST(k.titles) AS desired_titles, LIST(k.locations) AS preferred_locations,
  LIST(k.modes) AS preferred_work_modes, LIST(k.keywords) AS keywords, LIST(k.excluded) AS excluded_keywords,
  LIST(k.resume) AS resume_skills, c.c_custkey % 2 = 0 AS work_authorization, c.c_custkey % 9 = 0 AS needs_sponsorship,
  CAST(60 + c.c_custkey % 30 AS INT) AS auto_apply_threshold, c.c_custkey % 3 <> 0 AS auto_submit_enabled,
  CAST(c.c_custkey % 2 AS INT) AS onboarding_version,
  CASE c.c_custkey % 4 WHEN 0 THEN '{L.CS}' WHEN 1 THEN '{L.IEM}' WHEN 2 THEN '{L.EE}' ELSE 'biology' END AS active_track
FROM @customer c
JOIN {values(PROFILE_KINDS, 'track_no, skills, titles, locations, modes, keywords, excluded, options, resume')} k
  ON k.track_no = {number} AND k.resume = CASE c.c_custkey % 4
     {' '.join(f"WHEN {i} THEN {sql_text(kind[8])}" for i, kind in enumerate(k for k in PROFILE_KINDS if k[0] == number))} END
""" for number, track in TRACK_NUMBERS)

VIEWS["sources"] = f"""
SELECT s.s_suppkey AS source_id, s.s_suppkey % 50 AS user_id, s.s_name AS name,
  CASE WHEN s.s_suppkey % 17 = 0 THEN 'demo' ELSE
  CASE (s.s_suppkey DIV 2) % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'workday'
       ELSE 'official_careers' END END AS kind,
  CASE WHEN s.s_suppkey % 10 = 8 THEN 'eu:board-' ELSE 'board-' END || CAST(s.s_suppkey DIV 2 AS STRING) AS identifier,
  'Company ' || CAST(s.s_suppkey DIV 3 AS STRING) AS company_name,
  CASE (s.s_suppkey DIV 4) % 3 WHEN 0 THEN '{L.CS}' WHEN 1 THEN '{L.IEM}' ELSE '{L.EE}' END AS career_track,
  s.s_acctbal > 0 AS enabled, CASE WHEN s.s_suppkey % 7 = 3 THEN 'timeout' ELSE '' END AS last_error,
  CAST(s.s_suppkey % 7 AS INT) AS consecutive_failures, CAST(100 - (s.s_suppkey % 7) * 13 AS INT) AS health_score,
  CASE WHEN s.s_suppkey % 7 > 4 THEN NOW + MINUTES((s.s_suppkey % 13 - 6) * 60) END AS disabled_until,
  CASE WHEN s.s_suppkey % 4 = 0 THEN NULL ELSE NOW - MINUTES(s.s_suppkey * 11) END AS last_scanned_at,
  CASE s.s_suppkey % 6 WHEN 0 THEN '{{"preset":"recommended"}}' WHEN 1 THEN '{{"duplicate_of":3}}' WHEN 2 THEN 'not json'
       WHEN 3 THEN '' WHEN 4 THEN '{{"preset":"recommended","note":"x"}}' ELSE '[1]' END AS metadata
FROM @supplier s
"""

VIEWS["catalogue"] = f"""
SELECT CAST(p.p_partkey AS BIGINT) AS entry, 'Supplier ' || CAST(p.p_partkey AS STRING) AS name,
  CASE (p.p_partkey DIV 2) % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'workday'
       ELSE 'official_careers' END AS kind,
  'board-' || CAST(p.p_partkey DIV 2 AS STRING) AS identifier, 'Company ' || CAST(p.p_partkey DIV 3 AS STRING) AS company_name,
  CASE (p.p_partkey DIV 4) % 3 WHEN 0 THEN '{L.CS}' WHEN 1 THEN '{L.IEM}' ELSE '{L.EE}' END AS career_track
FROM @part p
"""

VIEWS["applications"] = f"""
SELECT a.o_orderkey AS application_id, a.job_id, {OWNER.format('a.job_id')} AS user_id,
  CASE substring(a.o_orderpriority, 1, 1) WHEN '1' THEN 'queued' WHEN '2' THEN 'applying' WHEN '3' THEN 'submitted'
    WHEN '4' THEN CASE a.o_orderstatus WHEN 'P' THEN 'verification_pending' ELSE 'needs_input' END
    ELSE CASE a.o_orderstatus WHEN 'F' THEN 'rejected' WHEN 'O' THEN 'verification_pending' ELSE 'failed' END END AS status,
  CASE a.o_orderstatus WHEN 'F' THEN 'auto' WHEN 'O' THEN 'review' ELSE 'manual' END AS mode,
  CASE WHEN substring(a.o_orderpriority, 1, 1) = '3' AND a.o_orderkey % 3 <> 0
       THEN CAST(a.o_orderdate AS TIMESTAMP) + DAYS(2) END AS submitted_at,
  CAST(a.o_orderdate AS TIMESTAMP) + MINUTES(a.o_orderkey % 1440) AS updated_at,
  CASE WHEN a.o_orderkey % 2 = 0 THEN CAST(a.o_orderdate AS TIMESTAMP) + MINUTES(a.o_orderkey % 700) END AS started_at,
  CASE WHEN a.o_orderkey % 4 = 0 THEN NOW + DAYS(a.o_orderkey % 7 - 3) END AS reminder_at,
  CAST(a.o_orderkey % 5 AS INT) AS attempt_count,
  CASE WHEN a.o_orderkey % 3 = 0 THEN a.o_orderkey % 40 END AS resume_id,
  CASE a.o_orderkey % 3 WHEN 0 THEN '{{"approved_once":"yes","city":"Haifa"}}' WHEN 1 THEN '{{"city":"Lod"}}' ELSE 'broken' END AS answers
FROM (SELECT o.*, o.k * 2 AS job_id, row_number() OVER (PARTITION BY o.k ORDER BY o.o_orderkey) AS rn
      FROM (SELECT q.*, q.o_orderkey % (SELECT count(*) FROM @documents) AS k FROM @orders q) o) a
WHERE a.rn = 1
"""

VIEWS["attempts"] = """
SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-' || CAST(l.l_partkey AS STRING) || '-'
    || CAST(l.l_suppkey AS STRING) AS attempt_id, l.l_orderkey AS application_id, l.l_linenumber AS attempt_number,
  CAST(l.l_shipdate AS TIMESTAMP) AS started_at,
  CASE l.l_returnflag WHEN 'A' THEN 'failed' WHEN 'N' THEN 'submitted' ELSE 'blocked' END AS status,
  CASE l.l_linestatus WHEN 'F' THEN 'verified' ELSE 'unverified' END AS verification_state,
  CASE l.l_partkey % 4 WHEN 0 THEN 'https://jobs.lever.co/acme/' || CAST(l.l_partkey AS STRING) || '/thanks/'
    WHEN 1 THEN 'https://www.lever.co/hp-b?x=1&leverAppId=' || CAST(l.l_partkey AS STRING)
    WHEN 2 THEN 'https://lever.co/hp-b?x=1' ELSE 'https://evil.example/acme/thanks' END AS page_url
FROM @lineitem l
"""

VIEWS["blockers"] = """
SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-' || CAST(l.l_partkey AS STRING) || '-'
    || CAST(l.l_suppkey AS STRING) AS blocker_id, l.l_orderkey AS application_id,
  CASE l.l_partkey % 6 WHEN 0 THEN 'question' WHEN 1 THEN 'file_required' WHEN 2 THEN 'submit_not_sent'
    WHEN 4 THEN 'review' ELSE 'confirmation_missing' END AS kind,
  CASE l.l_linestatus WHEN 'O' THEN 'open' ELSE 'resolved' END AS status,
  CAST(l.l_shipdate AS TIMESTAMP) AS created_at,
  CASE l.l_suppkey % 5 WHEN 0 THEN 'Upload File' WHEN 1 THEN 'Academic Transcript' WHEN 2 THEN 'Are you willing to relocate?'
    WHEN 3 THEN 'גיליון ציונים' ELSE 'Years of experience' END AS field_label,
  CASE l.l_suppkey % 5 WHEN 2 THEN 'Yes|No' ELSE '' END AS options,
  CASE l.l_partkey % 4 WHEN 0 THEN 'https://jobs.lever.co/acme/' || CAST(l.l_partkey AS STRING) || '/thanks'
    WHEN 1 THEN 'https://www.lever.co/hp-b?leverAppId=' || CAST(l.l_partkey AS STRING)
    ELSE 'https://careers.acme.example/apply' END AS page_url
FROM @lineitem l
"""

VIEWS["scan_log"] = """
SELECT CAST(CASE WHEN e.event_id % 3 = 0 THEN 5 ELSE e.user_id END AS BIGINT) AS source_id, e.event_id, CAST(e.ts AS TIMESTAMP) AS ts,
  CASE e.event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'quality_failed' WHEN 'view' THEN 'deferred' ELSE 'ok' END AS outcome
FROM @events e
"""

VIEWS["scan_runs"] = f"""
SELECT e.event_id AS run_id, e.user_id, CASE e.user_id % 3 WHEN 0 THEN '{L.CS}' WHEN 1 THEN '{L.IEM}' ELSE '{L.EE}' END AS career_track,
  CASE e.event_type WHEN 'error' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'view' THEN 'ok' WHEN 'click' THEN 'partial' ELSE 'failed' END AS status,
  CAST(e.ts AS TIMESTAMP) AS requested_at,
  CASE WHEN e.event_type IN ('view', 'click', 'purchase') THEN CAST(e.ts AS TIMESTAMP) + MINUTES(CAST(floor(e.value) AS BIGINT) % 90) END AS finished_at
FROM @events e
"""

VIEWS["resumes"] = f"""
SELECT d.doc_id AS resume_id, {OWNER.format('d.doc_id')} AS user_id,
  CASE (d.doc_id DIV 3) % 3 WHEN 0 THEN '{L.CS}' WHEN 1 THEN '{L.IEM}' ELSE '{L.EE}' END AS career_track,
  d.doc_id % 10 = 0 AS is_default, NOW - DAYS(d.doc_id % 100) AS created_at, LIST(k.skills) AS skills,
  LIST(k.manual) AS manual_skills, d.text || chr(10) || s.sentence AS extracted_text,
  CASE WHEN d.doc_id % 4 = 0 THEN 'cv' || CAST(d.doc_id AS STRING) || '@mail.example' ELSE '' END AS email,
  CASE WHEN d.doc_id % 3 = 0 THEN '052-' || CAST(1000000 + d.doc_id % 500 AS STRING) ELSE '' END AS phone
FROM @documents d
JOIN {values(SENTENCES, 'i, sentence')} s ON s.i = {pick('d.doc_id', SENTENCES)}
JOIN {values(((0, 'python|git|docker', 'go'), (1, 'sql|excel|power bi', ''), (2, 'verilog|fpga|uvm', 'rust|Python'),
              (3, 'c++|linux', ''), (4, '', 'lean')), 'i, skills, manual')} k ON k.i = d.doc_id % 5
"""

VIEWS["rankings"] = """
SELECT p.job_id, p.user_id, 'v2' AS engine, CAST((p.job_id * 53) % 101 AS INT) AS score,
  CASE p.job_id % 6 WHEN 0 THEN 'top_match' WHEN 1 THEN 'strong_match' WHEN 2 THEN 'good_match' WHEN 3 THEN 'low_match'
    WHEN 4 THEN 'stretch' ELSE 'excluded' END AS tier,
  CASE p.job_id % 6 WHEN 4 THEN 'stretch' WHEN 5 THEN 'excluded' ELSE 'realistic' END AS eligibility_state,
  CAST(CASE WHEN p.job_id % 23 = 0 THEN 1 ELSE 2 END AS INT) AS engine_version,
  CAST(CASE WHEN p.job_id % 29 = 0 THEN 1 ELSE 3 END AS INT) AS config_version,
  p.job_id % 13 = 0 AS stale, CASE WHEN p.job_id % 17 = 0 THEN 'ranking failed' ELSE '' END AS error,
  CAST(p.job_id % 9 AS DOUBLE) AS duration_ms, NOW - MINUTES(p.job_id % 5000) AS evaluated_at
FROM @@postings p
"""

VIEWS["link_rows"] = """
SELECT p.page_id AS seq, CASE p.page_id % 3 WHEN 0 THEN 'wix' WHEN 1 THEN 'speedata' ELSE 'camtek' END AS source,
  CASE p.page_id % 5 WHEN 0 THEN 'https://careers.acme.example/jobs/R-' || CAST(p.page_id DIV 3 AS STRING)
    WHEN 1 THEN '/jobs/r-' || CAST(p.page_id DIV 3 AS STRING) WHEN 2 THEN '' WHEN 3 THEN '//careers.acme.example/jobs/R-' || CAST(p.page_id DIV 3 AS STRING)
    ELSE 'jobs/about' END AS href,
  CASE WHEN p.page_id % 5 = 2 THEN 'open("/jobs/R-' || CAST(p.page_id DIV 3 AS STRING) || '")' ELSE '' END AS onclick,
  CASE p.page_id % 4 WHEN 0 THEN 'Read more' WHEN 1 THEN '' WHEN 2 THEN 'REF' || CAST(p.page_id AS STRING) || 'A'
    ELSE 'Senior Engineer ' || CAST(p.page_id % 12 AS STRING) END AS title,
  CASE p.page_id % 6 WHEN 0 THEN 'Apply now' WHEN 1 THEN 'oracle-ab12-t1-77' WHEN 2 THEN '' ELSE 'Developer ' || CAST(p.page_id % 8 AS STRING) END AS link_text,
  CASE p.page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Data Engineer Israel About the position we need an engineer with experience'
    WHEN 2 THEN 'Optics Lead R&D Migdal Haemek, Israel' ELSE 'Looking for a developer in Haifa, Israel, hybrid work ' || p.url END AS text,
  p.url, p.html
FROM @pages p
"""

VIEWS["messages"] = """
SELECT m.conv_id, m.turn, m.conv_id * 1000 + m.turn AS seq, CASE WHEN m.conv_id % 3 = 1 THEN 7 ELSE m.conv_id % 500 END AS user_id, m.role,
  CASE WHEN m.conv_id % 3 = 0 THEN m.text || ' Thank you for applying to Company ' || CAST(m.conv_id % 15 AS STRING) || ' as Backend Software Engineer'
       WHEN m.conv_id % 3 = 1 THEN m.text || ' Company news from Google: application received for Engineer, Developer or Analyst'
       ELSE m.text END AS text,
  CASE m.conv_id % 6 WHEN 0 THEN 'Are you willing to relocate?' WHEN 1 THEN 'Have you previously worked for this company?'
    WHEN 2 THEN 'Do you need a background check, or screening?' WHEN 3 THEN 'Please select your Gender / sex'
    WHEN 4 THEN 'What is your expected salary?' ELSE m.text END AS question
FROM @conversations m
"""

VIEWS["answers"] = """
SELECT m.seq AS answer_id, m.user_id, CASE m.conv_id % 4 WHEN 0 THEN 'category:relocation' WHEN 1 THEN 'what is your expected salary'
    WHEN 2 THEN 'company:' || substring(sha256(CASE m.conv_id % 2 WHEN 0 THEN 'google' ELSE 'company 2' END), 1, 24) || ':notice period'
    ELSE 'q ' || CAST(m.turn AS STRING) END AS pattern,
  'answer ' || CAST(m.seq AS STRING) AS answer, m.turn % 2 = 0 AS auto_use
FROM @@messages m
"""

VIEWS["campaigns"] = f"""
SELECT c.c_custkey AS campaign_id, c.c_custkey AS user_id,
  CASE c.c_custkey % 3 WHEN 0 THEN '{L.CS}' WHEN 1 THEN '{L.IEM}' ELSE '{L.EE}' END AS career_track,
  CAST(c.c_custkey % 60 AS INT) AS min_score, CAST(2 + c.c_custkey % 20 AS INT) AS daily_cap,
  CAST(10 + c.c_custkey % 15 AS INT) AS budget_cap, CAST(c.c_custkey % 9 AS INT) AS spent,
  LIST(CASE c.c_custkey % 3 WHEN 0 THEN 'company 2|redis' WHEN 1 THEN 'google' ELSE '' END) AS blocked_companies,
  c.c_acctbal > 0 AS active
FROM @customer c
"""

VIEWS["responses"] = """
SELECT CAST(l.l_orderkey AS STRING) AS attempt_id, l.l_linenumber * 1000000 + l.l_partkey AS seq,
  CASE l.l_partkey % 3 WHEN 2 THEN 'https://tracker.example/collect' ELSE 'https://jobs.lever.co/acme/apply' END AS url,
  CAST(CASE l.l_suppkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 302 WHEN 2 THEN 400 ELSE 500 END AS INT) AS status,
  CASE l.l_linenumber % 4 WHEN 0 THEN '{"ok":true,"applicationId":"A' || CAST(l.l_partkey AS STRING) || '"}'
    WHEN 1 THEN '{"ok":false,"error":"missing field"}' WHEN 2 THEN 'not json' ELSE '{"error":"busy"}' END AS body,
  CASE WHEN l.l_suppkey % 4 = 1 THEN CASE l.l_partkey % 2 WHEN 0 THEN 'https://jobs.lever.co/acme/thanks' ELSE 'https://jobs.lever.co/acme' END ELSE '' END AS location
FROM @lineitem l
"""

VIEWS["snap_prev"] = """
SELECT p.*, p.description AS body FROM @@postings p WHERE p.job_id % 5 <> 0
"""

VIEWS["snap_curr"] = """
SELECT p.source_id, p.external_id, CASE WHEN p.job_id % 9 = 0 THEN p.title || ' II' ELSE p.title END AS title, p.company,
  CASE WHEN p.job_id % 31 = 0 THEN 'Berlin, Germany' ELSE p.location END AS location, p.workplace, p.description,
  p.apply_url, p.published_at, p.career_track, p.user_id
FROM @@postings p WHERE p.job_id % 4 <> 0
UNION ALL
SELECT (p.source_id + 1) % 20 AS source_id, 'copy-' || p.external_id AS external_id, p.title, p.company || ' Ltd' AS company, p.location, p.workplace,
  p.description, p.apply_url || '?via=copy' AS apply_url, p.published_at, p.career_track, p.user_id
FROM @@postings p WHERE p.job_id % 13 = 0
"""

def _call(sql: str, name: str, template: str) -> str:
    """Rewrite every ``name(argument)`` with a template, minding nested parentheses."""
    out, position, head = [], 0, name + "("
    while (start := sql.find(head, position)) >= 0:
        if start and (sql[start - 1].isalnum() or sql[start - 1] == "_"):
            out.append(sql[position:start + len(head)])
            position = start + len(head)
            continue
        depth, end = 1, start + len(head)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        argument = _call(sql[start + len(head):end - 1], name, template)
        out += [sql[position:start], template.replace("#", argument)]
        position = end
    return "".join(out) + sql[position:]


TEMPLATES = {
    "spark": {"DAYS": "make_dt_interval(cast(# as int))", "MINUTES": "make_dt_interval(0, 0, cast(# as int))",
              "LIST": "filter(split(#, '[|]'), v -> v <> '')", "sha256": "sha2(#, 256)"},
    "duckdb": {"DAYS": "to_days(cast(# as int))", "MINUTES": "to_minutes(cast(# as bigint))",
               "LIST": "list_filter(string_split(#, '|'), lambda v: v <> '')"},
}


def render(sql: str, dialect: str, folder: str = "") -> str:
    while "@@" in sql:
        sql = re.sub(r"@@(\w+)", lambda m: f"({VIEWS[m[1]]})", sql)
    table = (lambda m: f"parquet.`{folder}/{m[1]}.parquet`") if dialect == "spark" else (lambda m: m[1])
    sql = re.sub(r"@([a-z]+)\b(?=[\s,)]|$)", table, sql)
    for name, template in TEMPLATES[dialect].items():
        sql = _call(sql, name, template)
    sql = re.sub(r"\bDIV\b", "div" if dialect == "spark" else "//", sql)
    return re.sub(r"\bNOW\b", f"TIMESTAMP '{NOW}'", sql)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a table is fewer files than cores, as files of one row group cannot be split.

    Looks at the file list only and runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view of this module as a Spark DataFrame."""
    return spark.sql(render(VIEWS[name], "spark", folder))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def oracle(sql: str) -> str:
    """DuckDB text of a check query that may use the tokens above."""
    return render(sql, "duckdb").strip()
