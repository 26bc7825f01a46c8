"""Queries of the read side: windows, search, cards, digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, digest, listings
from .fixtures import AS_OF, fixture, with_fixtures
from .registry import query


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# Documents as listings with the decisions their labels made.
_STATE = with_fixtures("docs", "verdicts", "portals") + """,
state AS (SELECT d.*, v.keep AS ai_keep, v.reason AS ai_reason
  FROM docs d LEFT JOIN (SELECT * FROM verdicts WHERE is_real) v ON v.url = d.url),
shown AS (SELECT * FROM state WHERE is_active AND ai_keep IS NOT FALSE)
"""
_WEEK = f"first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"
_DAY = f"first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY"
_FIELDS = "lower(concat(title, ' ', company, ' ', coalesce(location, ''), ' ', coalesce(department, ''), ' ', coalesce(ai_reason, '')))"
_QUERY = "spain en"


def state_of(spark, sf_dir):
    final = decisions.persisted(decisions.with_group_positions(fixture(spark, sf_dir, "verdicts")))
    return decisions.with_decisions(fixture(spark, sf_dir, "docs"), final)


def shown(spark, sf_dir):
    return listings.visible(state_of(spark, sf_dir))


@query("active_listings", _STATE + "SELECT url, company, ai_keep, ai_reason FROM shown")
def active_listings(spark, sf_dir):
    return shown(spark, sf_dir).select("url", "company", "ai_keep", "ai_reason")


@query("recent_window_7d", _STATE + f"""
SELECT coalesce(p.name, 'Unknown') AS company, s.url, s.title, strftime(s.first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at
FROM shown s LEFT JOIN portals p ON p.company_id = s.company_id WHERE {_WEEK}""")
def recent_window_7d(spark, sf_dir):
    rows = digest.last_days(state_of(spark, sf_dir).drop("company"), fixture(spark, sf_dir, "portals"), _as_of())
    return rows.select("company", "url", "title", "first_seen_at")


@query("range_today", _STATE + f"SELECT url, company FROM state WHERE {_DAY}")
def range_today(spark, sf_dir):
    return listings.in_range(state_of(spark, sf_dir), "today", _as_of()).select("url", "company")


@query("range_7d", _STATE + f"SELECT url, company FROM state WHERE {_WEEK}")
def range_7d(spark, sf_dir):
    return listings.in_range(state_of(spark, sf_dir), "7d", _as_of()).select("url", "company")


@query("search_listings", _STATE + f"SELECT url, company FROM state WHERE contains({_FIELDS}, '{_QUERY}')")
def search_listings(spark, sf_dir):
    return listings.search(state_of(spark, sf_dir), _QUERY.title()).select("url", "company")


@query("listing_cards", _STATE + """
SELECT company, title, url, nullif(location, '') AS location, nullif(department, '') AS department, job_type AS badge,
  ai_reason AS reason, CASE WHEN ai_keep IS NULL THEN 'Filter decision pending' END AS pending,
  strftime(first_seen_at, '%-d %b') AS shown_date FROM shown""")
def listing_cards(spark, sf_dir):
    return listings.cards(shown(spark, sf_dir))


@query("listings_by_company", _STATE + "SELECT company, count(*) AS n_listings FROM shown GROUP BY ALL")
def listings_by_company(spark, sf_dir):
    return listings.count_by_company(shown(spark, sf_dir))


@query("dashboard_header", _STATE + "SELECT count(*) AS n_listings, count(DISTINCT company) AS n_companies FROM shown")
def dashboard_header(spark, sf_dir):
    return listings.header(shown(spark, sf_dir))


@query("showing_n_of_m", _STATE + f"""
SELECT count(*) FILTER ({_WEEK} AND contains({_FIELDS}, '{_QUERY}')) AS n_shown, count(*) AS n_total FROM shown""")
def showing_n_of_m(spark, sf_dir):
    return listings.showing(shown(spark, sf_dir), "7d", _QUERY, _as_of())


@query("dashboard", _STATE + f"""
SELECT company, url, title, department, ai_reason FROM shown WHERE {_WEEK} AND contains({_FIELDS}, 'en')""")
def dashboard(spark, sf_dir):
    rows = listings.dashboard(state_of(spark, sf_dir), "7d", "EN", _as_of())
    return rows.select("company", "url", "title", "department", "ai_reason")


@query("latest_n", _STATE + """
SELECT company, url, strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at FROM state WHERE is_active
ORDER BY state.first_seen_at DESC, url, company LIMIT 20""")
def latest_n(spark, sf_dir):
    rows = listings.newest_first(state_of(spark, sf_dir).where("is_active"), 20)
    return rows.select("company", "url", "first_seen_at")


# Today's new listings are the documents first seen in the last 24 hours.
_NEW = f""", fresh AS (SELECT * FROM docs WHERE {_DAY}),
today AS (SELECT * FROM fresh WHERE url IN (SELECT url FROM verdicts WHERE keep)),
week AS (SELECT * FROM shown WHERE {_WEEK})
"""


def _fresh(spark, sf_dir):
    return listings.recent(fixture(spark, sf_dir, "docs"), _as_of(), 1)


def _sections(spark, sf_dir):
    today = digest.new_today(_fresh(spark, sf_dir), fixture(spark, sf_dir, "verdicts"))
    return today, listings.recent(shown(spark, sf_dir), _as_of(), 7)


@query("section_new_today", _STATE + _NEW + "SELECT company, url, title FROM today")
def section_new_today(spark, sf_dir):
    return _sections(spark, sf_dir)[0].select("company", "url", "title")


_ROWS = _STATE + _NEW + f""",
rows_ AS (SELECT section, company, title, url, location, department, job_type, first_seen_at,
  row_number() OVER (PARTITION BY section, company ORDER BY first_seen_at DESC, url) AS position
  FROM (SELECT '{digest.NEW_TODAY}' AS section, company, title, url, location, department, job_type, first_seen_at FROM today
        UNION ALL SELECT '{digest.LAST_WEEK}', company, title, url, location, department, job_type, first_seen_at FROM week))
"""


def _rows(spark, sf_dir):
    return digest.digest_rows(*_sections(spark, sf_dir))


@query("digest_rows", _ROWS + """SELECT section, company, title, url, location, department, job_type,
  strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at, position, position = 1 AS is_heading FROM rows_""")
def digest_rows(spark, sf_dir):
    return digest.in_digest_order(_rows(spark, sf_dir))


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ROW_HTML = f"""concat({_sql(digest.ROW_OPEN)},
  CASE WHEN job_type <> '' THEN concat({_sql(digest.BADGE_OPEN)}, job_type, '</span> ') ELSE '' END,
  '<a href=''', url, {_sql(digest.LINK_STYLE)}, title, '</a>',
  CASE WHEN department <> '' THEN concat(' &middot; ', department) ELSE '' END,
  CASE WHEN location <> '' THEN concat({_sql(digest.PLACE_OPEN)}, location, '</small>') ELSE '' END, '</p>')"""


@query("digest_fragments", _ROWS + f"""
SELECT section, company, CAST((position - 1) // 100 AS BIGINT) AS part_no,
  string_agg(concat(CASE WHEN position = 1 THEN concat({_sql(digest.COMPANY_HEAD)}, company, '</h4>') ELSE '' END, {_ROW_HTML}), '' ORDER BY position) AS html
FROM rows_ GROUP BY ALL""")
def digest_fragments(spark, sf_dir):
    return digest.digest_fragments(_rows(spark, sf_dir))


@query("digest_section_heads", _ROWS + f"""
SELECT s.section, coalesce(c.n, 0) AS n, CASE WHEN c.n IS NULL
    THEN concat({_sql(digest.SECTION_HEAD)}, s.section, {_sql("</h3>" + digest.EMPTY_TEXT + digest.EMPTY_SECTION + "</p>")})
    ELSE concat({_sql(digest.SECTION_HEAD)}, s.section, ' &mdash; ', c.n, '</h3>') END AS html
FROM (VALUES ('{digest.NEW_TODAY}'), ('{digest.LAST_WEEK}')) s(section)
LEFT JOIN (SELECT section, count(*) AS n FROM rows_ GROUP BY ALL) c ON c.section = s.section""")
def digest_section_heads(spark, sf_dir):
    return digest.section_heads(digest.section_rows(*_sections(spark, sf_dir)))


@query("digest_subject", _STATE + _NEW + """, n AS (SELECT (SELECT count(*) FROM today) AS a, (SELECT count(*) FROM week) AS b)
SELECT a AS n_today, b AS n_week, CASE WHEN a > 0 THEN concat('Listings: ', a, CASE WHEN a = 1 THEN ' nuevo hoy' ELSE ' nuevos hoy' END)
  ELSE concat('Listings: 0 nuevos hoy · ', b, ' activos esta semana') END AS subject FROM n WHERE a > 0 OR b > 0""")
def digest_subject(spark, sf_dir):
    return digest.digest_subject(*_sections(spark, sf_dir))


@query("decision_report", _STATE + _NEW + """
SELECT f.company, f.title, f.url, CASE WHEN v.keep THEN '[KEEP]' ELSE '[DROP]' END AS flag,
  coalesce(v.reason, '(missing)') AS reason, CASE WHEN v.is_real THEN 'real' ELSE 'passthrough' END AS source
FROM fresh f LEFT JOIN verdicts v ON v.url = f.url""")
def decision_report(spark, sf_dir):
    return digest.decision_report(_fresh(spark, sf_dir), fixture(spark, sf_dir, "verdicts"))


@query("preview_sections", _STATE + f""",
sample_ AS (SELECT * FROM state WHERE is_active ORDER BY first_seen_at DESC, url, company LIMIT 20),
kept AS (SELECT *, row_number() OVER (ORDER BY first_seen_at DESC, url, company) AS rn FROM sample_ WHERE url IN (SELECT url FROM verdicts WHERE keep))
SELECT '{digest.NEW_TODAY}' AS section, company, title, url FROM kept WHERE rn <= 3
UNION ALL SELECT '{digest.LAST_WEEK}', company, title, url FROM kept""")
def preview_sections(spark, sf_dir):
    return digest.preview_sections(state_of(spark, sf_dir), fixture(spark, sf_dir, "verdicts"))
