"""Queries on paged portals: every order is a posting on a page of one of five of them, or of a sixth without pages.

The pages go on after the one that ends the list, each portal by its own rule.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import daily
from ..shared import new_path
from ..sources import sinks
from ..sources.captures import request_plan
from ..sources.common import attach_companies
from ..sources.paging import first_pages
from ..sources.registry import parse_sources
from .check_sql import slug_sql
from .deciding import even_titles
from .fixtures import CAREERS_URLS, cases, fixture, with_fixtures
from .portal_pages import markup
from .registry import query

_KINDS = ["workday", "phenom", "successfactors", "html_in_json", "wp_cards", "lever"]
_SITES = [CAREERS_URLS[0], CAREERS_URLS[2], CAREERS_URLS[5], CAREERS_URLS[8], CAREERS_URLS[1], "https://l.example.com/"]
# The posting's number in its link: on later pages of two portals the links repeat.
_LINK = """CASE WHEN portal % 6 = 2 AND page_idx >= 6 THEN id - id % 5 WHEN portal % 6 = 3 THEN portal * 1000 + (id % 1000) % 300 ELSE id END"""
_TOTAL = "CASE portal % 6 WHEN 0 THEN 20 * (4 + portal % 5) WHEN 1 THEN 50 * (3 + portal % 4) - 1 END"
_PLACE = "CASE WHEN portal % 6 = 4 AND page_idx = 11 THEN 'London, UK' ELSE 'Madrid, Spain' END"
_TITLE = "concat('Analyst Madrid ', link, repeat('a', CAST(id % 4 AS INT)))"
_STATUS = "CASE WHEN (portal + page_idx) % 97 = 3 THEN 500 ELSE 200 END"


def _postings(spark, sf_dir, where: str = "true") -> DataFrame:
    rows = fixture(spark, sf_dir, "postings").where(where).select("id", "portal", "page_idx", "pos", F.expr(_LINK).alias("link"), F.expr(_PLACE).alias("place"))
    return rows.withColumn("title", F.expr(_TITLE))


def _bodies(rows: DataFrame) -> DataFrame:
    """(portal, page_idx, parser, body): the postings of a page, at most 50, as their portal shows them."""
    items = F.array_sort(F.collect_list(F.struct("pos", "id", "link", "title", "place")))
    paged = rows.groupBy("portal", "page_idx").agg(items.alias("items")).withColumn("total", F.expr(_TOTAL))
    n = lambda x: x["link"].cast("string")

    def each(make) -> Column:
        return F.transform("items", make)

    shown = [
        F.to_json(F.struct("total", each(lambda x: F.struct(
            x["title"].alias("title"), x["place"].alias("locationsText"), F.concat(F.lit("/job/"), n(x)).alias("externalPath"))).alias("jobPostings"))),
        F.to_json(F.struct(F.struct(F.col("total").alias("totalHits"), F.struct(each(lambda x: F.struct(
            x["title"].alias("title"), x["place"].alias("location"), F.concat(F.lit("https://p.example.com/"), n(x)).alias("applyUrl"),
            n(x).alias("jobId"))).alias("jobs")).alias("data")).alias("refineSearch"))),
        markup("<ul>", F.array_join(each(lambda x: markup('<li><a href="/job/Madrid/', x["link"] + 1000000, '/">', x["title"], "</a></li>")), "\n"), "</ul>"),
        F.to_json(F.struct(F.array_join(each(lambda x: markup('<a class="search-results__req_title" href="/jobs/', x["link"], '">', x["title"], "</a>")), "\n").alias("html"))),
        F.to_json(F.struct(F.array_join(each(lambda x: markup(
            '<li class="careers__list__item"><p class="news-grid__items_title">', x["title"], '</p><div class="news-grid__items_publish_date">', x["place"], "</div></li>")),
            "\n").alias("careers"))),
        F.to_json(each(lambda x: F.struct(n(x).alias("id"), x["title"].alias("text"), F.concat(F.lit("https://l.example.com/"), n(x)).alias("hostedUrl"),
                                          F.struct(x["place"].alias("location")).alias("categories")))),
    ]
    body = F
    for i, one in enumerate(shown):
        body = body.when(F.col("portal") % 6 == i, one)
    return paged.select("portal", "page_idx", F.expr(cases("portal", _KINDS)).alias("parser"), body.alias("body"))


def _settings(rows: DataFrame) -> DataFrame:
    return rows.select("portal").distinct().select(
        F.col("portal").cast("string").alias("company_id"), F.expr(cases("portal", _SITES)).alias("careers_url"), F.lit("Madrid").alias("location_filter"),
        F.lit(None).cast("string").alias("acciona_division"), F.lit(None).cast("string").alias("job_selector"))


def _captures(rows: DataFrame, run_date: str, status: Column) -> DataFrame:
    made = _bodies(rows).select(
        F.col("portal").cast("string").alias("company_id"), F.col("page_idx").cast("int").alias("page_idx"), "parser", F.lit("run").alias("run_id"),
        F.lit(run_date).cast("date").alias("run_date"), status.alias("status"), "body", F.lit("https://x.example.com/api/jobs").alias("request_url"),
        F.lit("application/json").alias("content_type"), F.lit(f"{run_date} 06:00:00").cast("timestamp").alias("captured_at"))
    # Stored as a fetcher would, so that every parser reads its own pages and none is rendered again.
    root = new_path(made.sparkSession, "captures")
    sinks.write_captures(made, root)
    return attach_companies(sinks.read_captures(made.sparkSession, root), _settings(rows))


def _listed_sql(name: str, where: str, status: str) -> str:
    """CTEs that end in ``name``: (portal, page_idx, pos, id, url, title) of a run by the rules, and ``name_bad``, its failed companies."""
    url = f"""CASE portal % 6 WHEN 0 THEN concat('https://acme.wd3.myworkdayjobs.com/job/', link) WHEN 1 THEN concat('https://p.example.com/', link)
      WHEN 2 THEN concat('https://empleo.es.deloitte.com/job/Madrid/', link + 1000000, '/') WHEN 3 THEN concat('https://eyglobal.yello.co/jobs/', link)
      WHEN 4 THEN concat('https://www.alantra.com/careers/apply/#', {slug_sql('title')}) ELSE concat('https://l.example.com/', link) END"""
    return f"""
{name}_rows AS (SELECT *, {url} AS url FROM (SELECT *, {_TITLE} AS title FROM (
  SELECT id, portal, page_idx, pos, {_LINK} AS link, {_PLACE} AS place, {_STATUS if status == "some" else "200"} AS status FROM postings WHERE {where}))),
{name}_fail AS (SELECT DISTINCT portal, page_idx FROM {name}_rows WHERE status >= 400),
{name}_bad AS (SELECT DISTINCT portal FROM {name}_fail WHERE NOT (portal % 6 IN (2, 3) AND page_idx > 0)),
{name}_read AS (SELECT r.* FROM {name}_rows r WHERE status < 400 AND (portal % 6 NOT IN (2, 3)
  OR page_idx < coalesce((SELECT min(page_idx) FROM {name}_fail f WHERE f.portal = r.portal), 1000))),
{name}_items AS (SELECT * FROM {name}_read WHERE portal % 6 <> 4 OR place = 'Madrid, Spain'),
{name}_firsts AS (SELECT portal, url, min(page_idx) AS page_idx FROM {name}_items GROUP BY ALL),
{name}_news AS (SELECT portal, page_idx, count(*) AS n_new FROM {name}_firsts GROUP BY ALL),
{name}_counts AS (SELECT portal, page_idx, count(*) AS n_items, count(DISTINCT url) AS n_urls FROM {name}_items GROUP BY ALL),
{name}_pages AS (SELECT p.portal, p.page_idx, coalesce(c.n_items, 0) AS n_items, coalesce(c.n_urls, 0) AS n_urls, coalesce(n.n_new, 0) AS n_new, {_TOTAL.replace("portal", "p.portal")} AS total
  FROM (SELECT DISTINCT portal, page_idx FROM {name}_read) p LEFT JOIN {name}_counts c ON c.portal = p.portal AND c.page_idx = p.page_idx
  LEFT JOIN {name}_news n ON n.portal = p.portal AND n.page_idx = p.page_idx),
{name}_stops AS (SELECT p.portal, p.page_idx, n_items, n_items = 0 OR CASE p.portal % 6 WHEN 0 THEN (p.page_idx + 1) * 20 >= total WHEN 1 THEN (p.page_idx + 1) * 50 >= total
    WHEN 2 THEN n_urls < coalesce((SELECT nullif(f.n_urls, 0) FROM {name}_pages f WHERE f.portal = p.portal AND f.page_idx = 0), 25) WHEN 3 THEN n_new = 0 ELSE false END AS stop FROM {name}_pages p),
{name}_kept AS (SELECT portal, page_idx FROM {name}_stops s WHERE portal % 6 = 5 OR n_items > 0
  AND page_idx <= coalesce((SELECT min(page_idx) FROM {name}_stops e WHERE e.portal = s.portal AND e.stop), 1000)),
{name}_listed AS (SELECT i.*, row_number() OVER (PARTITION BY i.portal, i.url ORDER BY i.page_idx, i.pos) AS nth
  FROM {name}_items i JOIN {name}_kept k ON k.portal = i.portal AND k.page_idx = i.page_idx),
{name} AS (SELECT portal, page_idx, pos, id, url, title, nth FROM {name}_listed WHERE portal % 6 NOT IN (2, 3) OR nth = 1)"""


@query("pages_left_out", with_fixtures("postings") + "," + _listed_sql("listed", "true", "none") + """
SELECT CAST(portal AS VARCHAR) AS company_id, url, title FROM listed""")
def pages_left_out(spark, sf_dir):
    """Six kinds of portals parsed in one job, each up to the page that ends its list."""
    found = parse_sources(_captures(_postings(spark, sf_dir), "2024-01-31", F.lit(200)), names=_KINDS)
    return found.select("company_id", "url", "title")


@query("request_plan_learned", with_fixtures("postings") + f""",
firsts AS (SELECT portal, {_TOTAL} AS total, {cases("portal", _KINDS)} AS parser FROM (SELECT DISTINCT portal FROM postings WHERE page_idx = 0)),
planned AS (SELECT *, unnest(range(CASE WHEN total IS NULL THEN 1 ELSE greatest(1, CAST(ceil(total / (CASE parser WHEN 'workday' THEN 20.0 ELSE 50.0 END)) AS BIGINT)) END)) AS page_idx
  FROM firsts WHERE parser <> 'lever')
SELECT CAST(portal AS VARCHAR) AS company_id, parser, page_idx FROM planned""")
def request_plan_learned(spark, sf_dir):
    """The pages to fetch after the first: totals and page sizes come from what was captured."""
    rows = _postings(spark, sf_dir, "page_idx = 0")
    captures = _captures(rows, "2024-01-31", F.lit(200)).where("parser <> 'lever'")
    companies = _settings(rows).withColumns({"greenhouse_id": F.lit("g"), "lever_id": F.lit("l")})
    known = companies.join(first_pages(captures), "company_id").join(captures.select("company_id", "parser").distinct(), "company_id")
    return request_plan(known).select("company_id", "parser", "page_idx")


_FIRST, _SECOND = dt.date(2024, 1, 30), dt.date(2024, 1, 31)
_DAY = """
{d}_chunked AS (SELECT *, row_number() OVER (PARTITION BY portal ORDER BY page_idx, pos, url) AS job_no FROM {d}_new),
{d}_first AS (SELECT portal, (job_no - 1) // 25 AS chunk_no FROM {d}_chunked WHERE (job_no - 1) % 25 = 0 AND length(title) % 5 = 0),
{d}_decided AS (SELECT c.*, f.portal IS NULL AS is_real, f.portal IS NOT NULL OR length(c.title) % 2 = 0 AS keep
  FROM {d}_chunked c LEFT JOIN {d}_first f ON f.portal = c.portal AND f.chunk_no = (c.job_no - 1) // 25)"""


@query("daily_run_whole", with_fixtures("postings") + "," + _listed_sql("one", "id % 5 <> 0", "none") + "," + _listed_sql("two", "id % 7 <> 0", "some") + """,
one_snap AS (SELECT * FROM one WHERE nth = 1), two_good AS (SELECT * FROM two WHERE portal NOT IN (SELECT portal FROM two_bad)), two_snap AS (SELECT * FROM two_good WHERE nth = 1),
one_new AS (SELECT * FROM one_snap), two_new AS (SELECT t.* FROM two_snap t WHERE NOT EXISTS (SELECT 1 FROM one_snap o WHERE o.portal = t.portal AND o.url = t.url)),
""" + _DAY.format(d="one").lstrip() + "," + _DAY.format(d="two") + """,
verdicts AS (SELECT portal, url, is_real, keep FROM one_decided UNION ALL SELECT portal, url, is_real, keep FROM two_decided),
seen AS (SELECT DISTINCT portal FROM two_snap),
active AS (SELECT portal, url FROM two_snap UNION SELECT portal, url FROM one_snap WHERE portal NOT IN (SELECT portal FROM seen)),
shown AS (SELECT 'Nuevos hoy' AS section, portal, url FROM two_decided WHERE keep
  UNION ALL SELECT 'Últimos 7 días', a.portal, a.url FROM active a JOIN verdicts v ON v.portal = a.portal AND v.url = a.url WHERE v.keep OR NOT v.is_real),
counts AS (SELECT (SELECT count(*) FROM two_new) AS n_new, (SELECT count(*) FROM two_fail WHERE portal IN (SELECT portal FROM two_bad) AND NOT (portal % 6 IN (2, 3) AND page_idx > 0)) AS n_bad,
  (SELECT count(*) FROM two_good WHERE nth > 1) AS again)
SELECT section, concat('Portal ', portal) AS company, url FROM shown
UNION ALL SELECT 'audit', CASE WHEN n_bad = 0 THEN 'completed' ELSE 'failed' END, concat(n_new, '/', n_bad, '/', again) FROM counts""")
def daily_run_whole(spark, sf_dir):
    """Two days from captures of six kinds of portals to the second day's digest and audit."""
    root = new_path(spark, "days")
    first, second = (_postings(spark, sf_dir, where) for where in ("id % 5 <> 0", "id % 7 <> 0"))
    names = fixture(spark, sf_dir, "postings").select("portal").distinct().select(
        F.col("portal").cast("string").alias("company_id"), F.concat(F.lit("Portal "), "portal").alias("name"))
    daily.run_day(root, _FIRST, names, _captures(first, str(_FIRST), F.lit(200)), scorer=even_titles, names=_KINDS)
    status = F.when((F.col("portal") + F.col("page_idx")) % 97 == 3, 500).otherwise(200)
    daily.run_day(root, _SECOND, names, _captures(second, str(_SECOND), status), scorer=even_titles, names=_KINDS)
    days = daily.day_tables(spark, root)
    audit = days["audit"].where(F.col("run_date") == F.lit(_SECOND))
    told = F.concat_ws("/", *(F.col(c).cast("string") for c in ("new_jobs_found", "n_errors", "repeated_urls")))
    return days["digest"].select("section", "company", "url").unionByName(
        audit.select(F.lit("audit").alias("section"), F.col("status").alias("company"), told.alias("url")))
