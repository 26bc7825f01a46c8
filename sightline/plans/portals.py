"""Queries on captured portal responses: every order becomes a posting on some page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import diagnostics, discovery
from ..sources import captures as cap
from ..sources import json_portals as js
from ..sources import link_portals as lp
from ..sources import markup_portals as mk
from ..sources.common import attach_companies, load_companies
from ..sources.registry import parse_sources, parser_names, resolve_parser
from .check_sql import location_by_filter, real_title_sql, slug_sql, stripped
from .fixtures import CAREERS_URLS, PLACES, TITLES, cases, fixture, quoted, with_fixtures
from .portal_pages import (
    DIVISIONS, FILTERS, PLACES_SQL, as_json, as_markup, captured, escaped, linked, markup, pages,
    postings, settings,
)
from .registry import query
from .texts import _ANCHORS, page_links

_LISTING = ["title", "url", "location", "department", "job_type", "description", "external_id"]


def _plain(found: DataFrame) -> DataFrame:
    return found.select("company_id", *_LISTING)


def _check(where: str, *, first: str | None = None, order: str = "id", late: str | None = None, **fields: str) -> str:
    """Check SQL over the postings: filter, first row per ``first`` in order, then ``late``."""
    columns = ", ".join(f"{fields.get(n, 'NULL::VARCHAR')} AS {n}" for n in _LISTING)
    kept = f"SELECT CAST(portal AS VARCHAR) AS company_id, id, places, {columns} FROM asked WHERE {where}"
    rank = f"row_number() OVER (PARTITION BY company_id, {first} ORDER BY {order})" if first else "1"
    return (
        with_fixtures("postings")
        + f", asked AS (SELECT *, {PLACES_SQL} AS places, {stripped('title')} AS t, {stripped('location')} AS l, coalesce(location, '') AS loc FROM postings),"
        + f" kept AS ({kept}), ranked AS (SELECT *, {rank} AS rn FROM kept WHERE title <> '' AND url <> '')"
        + f" SELECT company_id, {', '.join(_LISTING)} FROM ranked WHERE rn = 1" + (f" AND {late}" if late else "")
    )


def _in(text: str) -> str:
    return location_by_filter(text, "places", FILTERS)


_LOC = "nullif(location, '')"
_WHERE = "places"

# --- JSON portals -------------------------------------------------------------------------------


@query("src_greenhouse", _check(
    _in("location"), title="title", url="concat('https://boards.example.com/', ref, '/', id)", location=_LOC,
    department="department", job_type="CASE WHEN ref % 2 = 0 THEN job_type END", description="substr(description, 1, 500)",
    external_id="CAST(id AS VARCHAR)"))
def greenhouse(spark, sf_dir):
    def item():
        return F.struct(
            "id", "title", F.concat(F.lit("https://boards.example.com/"), "ref", F.lit("/"), "id").alias("absolute_url"),
            F.struct(F.col("location").alias("name")).alias("location"),
            F.array(F.struct(F.col("department").alias("name")), F.struct(F.lit("Other").alias("name"))).alias("departments"),
            F.array(
                F.struct(F.lit("Office").alias("name"), F.lit("x").alias("value")),
                F.struct(F.when(F.col("ref") % 2 == 0, "Contract TYPE").otherwise("Level").alias("name"), F.col("job_type").alias("value")),
            ).alias("metadata"),
            F.col("description").alias("content"),
        )

    return _plain(js.parse_greenhouse(captured(spark, sf_dir, "https://x.example.com/", item, as_json("jobs"))))


@query("src_lever", _check(
    _in("location"), title="title", url="concat('https://jobs.example.com/', id)", location=_LOC, department="department",
    job_type="job_type", description="substr(description, 1, 500)", external_id="concat('L', id)"))
def lever(spark, sf_dir):
    def item():
        return F.struct(
            F.concat(F.lit("L"), "id").alias("id"), F.col("title").alias("text"),
            F.concat(F.lit("https://jobs.example.com/"), "id").alias("hostedUrl"),
            F.struct("location", "department", F.col("job_type").alias("commitment")).alias("categories"),
            F.col("description").alias("descriptionPlain"),
        )

    return _plain(js.parse_lever(captured(spark, sf_dir, "https://x.example.com/", item, as_json())))


@query("src_workday", _check(
    f"{_in('location')} AND ref % 9 <> 0", title="title", url="concat('https://acme.wd3.myworkdayjobs.com/job/', ref)", location=_LOC))
def workday(spark, sf_dir):
    def item():
        path = F.when(F.col("ref") % 9 != 0, F.concat(F.lit("/job/"), "ref")).otherwise("")
        return F.struct("title", F.col("location").alias("locationsText"), path.alias("externalPath"))

    return _plain(js.parse_workday(captured(spark, sf_dir, CAREERS_URLS[0], item, as_json("jobPostings"))))


_PHENOM_PLACE = "coalesce(nullif(location, ''), CASE WHEN ref % 3 = 0 THEN 'Madrid' END)"


@query("src_phenom", _check(
    f"({_in(_PHENOM_PLACE)} OR {_in('CASE WHEN ref % 4 = 0 THEN concat(coalesce(location, chr(63)), chr(44), chr(32), chr(83), chr(112), chr(97), chr(105), chr(110)) ELSE chr(63) END')})",
    title="t", url="CASE ref % 5 WHEN 0 THEN concat('https://a.example.com/?a=1&b=', id) WHEN 1 THEN NULL ELSE concat('https://careers.bcg.com/global/en/job/R', id) END",
    location=_PHENOM_PLACE, department="department", external_id="CASE WHEN ref % 5 <> 1 THEN concat('R', id) END"))
def phenom(spark, sf_dir):
    def item():
        ref = F.col("ref")
        req = F.concat(F.lit("R"), "id")
        return F.struct(
            "title", "location", F.when(ref % 3 == 0, "Madrid").alias("city"),
            F.when(ref % 4 == 0, F.array(F.coalesce("location", F.lit("?")), F.lit("Spain"))).otherwise(F.array(F.lit("?"))).alias("multi_location"),
            F.when(ref % 5 == 0, F.concat(F.lit("https://a.example.com/?a=1&amp;b="), "id")).alias("applyUrl"),
            F.when(ref % 5 == 2, req).alias("jobId"), F.when(~(ref % 5).isin(1, 2), req).otherwise("").alias("reqId"),
            F.col("department").alias("category"),
        )

    def body(items):
        return F.to_json(F.struct(F.struct(F.lit(900).alias("totalHits"), F.struct(items.alias("jobs")).alias("data")).alias("refineSearch")))

    return _plain(js.parse_phenom(captured(spark, sf_dir, CAREERS_URLS[2], item, body)))


def _joined(city: str, country: str) -> str:
    return f"concat_ws(' | ', nullif(l, ''), {city}, {country})"


_CITY = "CASE WHEN ref % 3 = 0 THEN 'Madrid' END"
_COUNTRY = "CASE WHEN ref % 2 = 0 THEN 'Spain' ELSE 'UK' END"


@query("src_resultset", _check(
    _in(_joined(_CITY, _COUNTRY)), title="t", url="concat('https://firm.tal.net/opp/', id)", location=f"coalesce(nullif(l, ''), {_CITY})"))
def resultset(spark, sf_dir):
    def item():
        return F.struct(
            F.col("title").alias("jobTitle"), F.concat(F.lit(" https://firm.tal.net/opp/"), "id").alias("url"), "location",
            F.expr(_CITY).alias("city"), F.expr(_COUNTRY).alias("country"),
        )

    return _plain(js.parse_resultset(captured(spark, sf_dir, CAREERS_URLS[11], item, as_json("resultSet"))))


@query("src_intervieweb", _check(
    f"{_in(_joined(_CITY, _COUNTRY))} AND job_type <> 'P'", title="t",
    url="concat('https://mediobanca.intervieweb.it/jobs/', lower(job_type), '-', id, '/en/')", location=f"coalesce(nullif(l, ''), {_CITY})"))
def intervieweb(spark, sf_dir):
    def item():
        slug = F.when(F.col("job_type") != "P", F.concat(F.lower("job_type"), F.lit("-"), "id")).otherwise(" ")
        return F.struct(slug.alias("slug"), "title", "location", F.expr(_CITY).alias("city"), F.expr(_COUNTRY).alias("nation"))

    return _plain(js.parse_intervieweb(captured(spark, sf_dir, CAREERS_URLS[10], item, as_json())))


@query("src_embedded_json", _check(
    f"{_in('location')} AND {cases('ref', DIVISIONS)} = {cases('portal', DIVISIONS)}", title="t",
    url="CASE ref % 3 WHEN 0 THEN concat('https://a.example.com/', id) WHEN 1 THEN concat('https://www.acciona.com/offer/', id)"
        " ELSE concat('https://www.acciona.com/our-purpose/work-with-us/job-detail?id=', id) END",
    location=_LOC, department="department", external_id="CAST(id AS VARCHAR)"))
def embedded_json(spark, sf_dir):
    def item():
        ref = F.col("ref")
        url = F.when(ref % 3 == 0, F.concat(F.lit("https://a.example.com/"), "id")).when(ref % 3 == 1, F.concat(F.lit("/offer/"), "id"))
        return F.struct(
            "id", F.expr(cases("ref", DIVISIONS)).alias("divisionID"), F.col("department").alias("divisionTitle"),
            F.col("location").alias("primaryLocation"), F.col("title").alias("jobPostingTitle"), url.alias("url"),
        )

    def body(items):
        return markup("<html><body><p>x</p><a-mo-oferta-v2 lang=\"en\" jobs=\"", escaped(F.to_json(items)), "\"></a-mo-oferta-v2></body></html>")

    return _plain(js.parse_embedded_json(captured(spark, sf_dir, CAREERS_URLS[4], item, body)))


# --- markup portals -----------------------------------------------------------------------------

_CONTEXT = "trim(concat(t, ' ', loc))"


@query("src_html_links", _check(
    f"length(t) >= 3 AND {_in(_CONTEXT)}", first="url", title="t", url="concat('https://x.example.com/a/open/', ref)"))
def html_links(spark, sf_dir):
    def item():
        return markup(
            '<div class="c Job-card"><div class="inner"><a href="open/', F.col("ref"), '">', escaped(F.col("title")),
            "</a><br><span>", escaped(F.col("location")), "</span></div></div>",
        )

    body = as_markup('<html><body><script>var a="<div class=job>";</script><a href="/about">About us</a>', "</body></html>")
    return _plain(mk.parse_html_listing(captured(spark, sf_dir, "https://x.example.com/a/list", item, body)))


_SELECTORS = ["ul.jobs > li", "ul.jobs > li:first-child", "div li.r:not(.x)", "a + b"]


@query("src_html_selectors", with_fixtures("postings") + f""",
kept AS (SELECT *, {stripped('title')} AS t, {PLACES_SQL} AS places, row_number() OVER (PARTITION BY portal, page_idx ORDER BY pos) AS nth FROM postings),
fits AS (SELECT *, concat('https://x.example.com/a/open/', ref) AS url FROM kept WHERE length(t) >= 3 AND {_in("trim(concat(t, ' ', coalesce(location, '')))")}
  AND CASE portal % 4 WHEN 0 THEN true WHEN 1 THEN nth = 1 WHEN 2 THEN ref % 2 = 0 ELSE false END),
ranked AS (SELECT *, row_number() OVER (PARTITION BY portal, url ORDER BY id) AS rn FROM fits)
SELECT CAST(portal AS VARCHAR) AS company_id, t AS title, url FROM ranked WHERE rn = 1""")
def html_selectors(spark, sf_dir):
    """Pages read by a configured selector each; the last one is not supported and gives nothing."""
    def item():
        mark = F.when(F.col("ref") % 2 == 0, "r").otherwise("r x")
        return markup('<li class="', mark, '"><a href="open/', F.col("ref"), '">', escaped(F.col("title")), "</a> <span>", escaped(F.col("location")), "</span></li>")

    body = as_markup('<html><body><div><ul class="jobs">', '</ul><ol><li><a href="/about">About Madrid</a></li></ol></div></body></html>')
    pages_ = captured(spark, sf_dir, "https://x.example.com/a/list", item, body)
    chosen = pages_.withColumn("job_selector", F.expr(cases("CAST(company_id AS BIGINT)", _SELECTORS)))
    return mk.parse_html_listing(chosen).select("company_id", "title", "url")


_SF_URL = "concat('https://empleo.es.deloitte.com/job/', replace(replace(loc, ' ', '-'), ',', ''), '/', ref + 1000000, '/')"


@query("src_sf_cards", _check(
    "length(t) >= 4", first="url", late=f"({_in('url')} OR {_in('title')})", title="t", url=_SF_URL, location="places"))
def sf_cards(spark, sf_dir):
    def item():
        place = F.replace(F.replace(F.coalesce("location", F.lit("")), F.lit(" "), F.lit("-")), F.lit(","), F.lit(""))
        href = markup("/job/", place, "/", F.col("ref") + 1000000, "/")
        title = escaped(F.col("title"))
        return markup(
            '<li><a class="t" href="', href, '"><span>', title, "</span></a><a href='", href, "'>Apply to it now</a>",
            '<a href="/job/short/', F.col("ref"), '">No id here</a></li>',
        )

    found = mk.parse_successfactors(captured(spark, sf_dir, CAREERS_URLS[5], item, as_markup("<ul>", "</ul>")))
    return _plain(found.where(F.col("title") != "Apply to it now"))


@query("src_html_in_json", _check(
    "length(t) >= 4", first="url", title="t", url="concat('https://eyglobal.yello.co/jobs/', ref)", location="places"))
def html_in_json(spark, sf_dir):
    def item():
        return markup(
            '<li class=\'search-results__item\'><a class="search-results__req_title" data-x="1" href="/jobs/', F.col("ref"), '">',
            escaped(F.col("title")), "</a></li>",
        )

    def body(items):
        return F.to_json(F.struct(F.array_join(items, "\n").alias("html")))

    return _plain(mk.parse_html_in_json(captured(spark, sf_dir, CAREERS_URLS[8], item, body)))


@query("src_wp_cards", _check(
    f"(l IS NULL OR l = '' OR {_in('l')})", title="t", url=f"concat('https://www.alantra.com/careers/apply/#', {slug_sql('t')})",
    location="nullif(l, '')", department="department"))
def wp_cards(spark, sf_dir):
    def item():
        place = F.when(F.col("location") != "", markup('<div class="news-grid__items_publish_date">', escaped(F.col("location")), "</div>"))
        return markup(
            '<li id="a" class="x careers__list__item y"><p class="news-grid__items_title">', escaped(F.col("title")), "</p>", place,
            '<div class="news-grid__items_cat"> ', escaped(F.col("department")), "</div></li>",
        )

    def body(items):
        return F.to_json(F.struct(F.array_join(items, "\n").alias("careers")))

    return _plain(mk.parse_wp_cards(captured(spark, sf_dir, CAREERS_URLS[1], item, body)))


_ATOM_URL = "CASE ref % 4 WHEN 2 THEN concat('https://firm.tal.net/opp/', ref, '?instant=apply') ELSE concat('https://firm.tal.net/opp/', ref, '-', {slug}) END".format(slug=slug_sql("loc"))


@query("src_atom", _check(
    f"length(t) >= 4 AND ({_in('t')} OR {_in(_ATOM_URL)})", first="url", title="t", url=_ATOM_URL, location="places"))
def atom(spark, sf_dir):
    def item():
        from ..functions.text import slugify

        ref, base = F.col("ref"), markup("https://firm.tal.net/opp/", F.col("ref"))
        full = markup(base, "-", slugify(F.coalesce("location", F.lit(""))))
        apply = markup('<link rel="alternate" href="', base, '?instant=apply"/>')
        plain = markup('<link rel="alternate" type="text/html" href="', full, '"/>')
        links = (
            F.when(ref % 4 == 0, markup('<link rel="self" href="https://firm.tal.net/self"/>', apply, plain))
            .when(ref % 4 == 1, markup(plain, apply)).when(ref % 4 == 2, apply).otherwise(F.lit('<link rel="edit" href="/e"/>'))
        )
        return markup("<entry><title type=\"text\">", escaped(F.col("title")), "</title>", links, "<id> ", full, " </id></entry>")

    body = as_markup('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>All</title>', "</feed>")
    return _plain(mk.parse_atom(captured(spark, sf_dir, CAREERS_URLS[15], item, body)))


@query("src_id_permalink", _check(
    "ref % 6 <> 0", title="regexp_replace(t, '\\s+', ' ', 'g')", url="concat('https://bdo.epreselec.com/Ofertas/Ofertas.aspx?idOferta=', ref)",
    location="places", external_id="CAST(ref AS VARCHAR)"))
def id_permalink(spark, sf_dir):
    def item():
        offer = F.when(F.col("ref") % 6 != 0, markup(' data_idoferta="', F.col("ref"), '"'))
        return markup(
            '<div><a id="ctl00_lbMostrarOferta_', F.col("pos"), '" href="javascript:__doPostBack()"', offer, ">",
            F.replace(escaped(F.col("title")), F.lit(" "), F.lit("\n  ")), '</a><a id="other" data_idoferta="1">x</a></div>',
        )

    return _plain(mk.parse_id_permalink(captured(spark, sf_dir, CAREERS_URLS[3], item, as_markup("<table>", "</table>"))))


@query("src_html_table", _check(
    f"({_in('l')} OR {_in('t')}) AND ref % 7 <> 0", first="url", title="t", url="concat('https://pwc.wd3.myworkdayjobs.com/job/', ref)",
    location="nullif(l, '')", department="department"))
def html_table(spark, sf_dir):
    def item():
        link = F.when(F.col("ref") % 7 != 0, markup('<a href="https://pwc.wd3.myworkdayjobs.com/job/', F.col("ref"), '">Apply</a>'))
        return markup(
            "<tr class=r><td>", escaped(F.col("title")), "</td><td><b>", escaped(F.col("location")), "</b></td><td>",
            F.col("department"), "</td><td>", link, "</td></tr>",
        )

    body = as_markup("<table><tr><th>Title</th><th>Place</th></tr>", "</table>")
    return _plain(mk.parse_html_table(captured(spark, sf_dir, CAREERS_URLS[14], item, body)))


_HEADING = "trim(concat(t, ' ', loc))"


def _any(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {quoted(p)})" for p in parts) + ")"


@query("src_headings", _check(
    f"{_any(_HEADING, vocab.ROLE_STEMS)} AND NOT {_any(_HEADING, vocab.SECTION_PHRASES)} AND {_in(_HEADING)} AND ref % 4 <> 1",
    first="title", title=_HEADING, url="'https://www.dcadvisory.com/recruiting/spain'", location="places"))
def headings(spark, sf_dir):
    def item():
        level = F.when(F.col("ref") % 4 == 0, "h2").when(F.col("ref") % 4 == 1, "h1").when(F.col("ref") % 4 == 2, "h3").otherwise("h4")
        return markup("<", level, ' class="x"><b>', escaped(F.col("title")), "</b> ", escaped(F.col("location")), "</", level, "><p>t</p>")

    body = as_markup('<a href="#apply">Apply below</a><a href="/about">About</a><a href="/recruiting/spain">Here</a>', "")
    return _plain(mk.parse_headings(captured(spark, sf_dir, CAREERS_URLS[7], item, body)))


# --- link portals -------------------------------------------------------------------------------

@query("src_opp_links", _check(
    f"ref % 3 <> 0 AND length(title) >= 4 AND ({_in('title')} OR {_in('concat(chr(47), coalesce(location, chr(45)))')})", first="url", title="title",
    url="concat('https://firm.tal.net/vx/candidate/so/pm/1/pl/2/opp/', ref, '-', coalesce(location, '-'), '/en')", location="places"))
def opp_links(spark, sf_dir):
    place = F.coalesce("location", F.lit("-"))
    shape = F.when(F.col("ref") % 3 == 0, "/vx/candidate/so/pm/1/opp/").otherwise("/vx/candidate/so/pm/1/pl/2/opp/")
    href = markup("https://firm.tal.net", shape, F.col("ref"), "-", place, "/en")
    return _plain(lp.parse_talentlink_links(linked(spark, sf_dir, CAREERS_URLS[15], href=href, text=F.col("title"))))


@query("src_query_routed", _check(
    f"ref % 4 < 2 AND length(t) >= 5 AND {_in('t')}", first="url", title="t",
    url="concat(CASE ref % 4 WHEN 0 THEN 'https://jobs.ubs.com' ELSE '' END, '/TGnewUI/home?PageType=JobDetails&jobid=', ref)"))
def query_routed(spark, sf_dir):
    kind = F.col("ref") % 4
    href = markup(
        F.when(kind == 0, "https://jobs.ubs.com").when(kind == 3, "https://else.example.org").otherwise(""), "/TGnewUI/home?PageType=",
        F.when(kind == 2, "Search").otherwise("JobDetails"), "&jobid=", F.col("ref"),
    )
    return _plain(lp.parse_ubs_links(linked(spark, sf_dir, CAREERS_URLS[16], href=href, text=F.col("title"))))


@query("src_card_links", _check("true", first="url", title="t", url="concat('https://jobs.ca-cib.com/job/', ref)", location="places"))
def card_links(spark, sf_dir):
    href = markup(" https://jobs.ca-cib.com/job/", F.col("ref"))
    return _plain(lp.parse_cegid_links(linked(spark, sf_dir, CAREERS_URLS[6], href=href, text=F.col("title"))))


_BADGES = ["ROLLING • ends soon", "THIS ROUND’S DEADLINE HAS PASSED", "APPLY NOW", "CLOSED", "OPEN NOW", "Rolling", None]
_SHOWN = ["Rolling", "Deadline passed", "Open", "Closed", "Open Now", None, None]


@query("src_status_cards", _check(
    _in("t"), first="job_type", title=f"concat(t, ' (' || ({cases('ref', _SHOWN)}) || ')')",
    url="CASE WHEN ref % 2 = 0 THEN concat('https://www.mckinsey.com/jobs/', ref) ELSE 'https://www.mckinsey.com/careers/students' END",
    location="places", job_type="t").replace("title, url, location, department, job_type, description, external_id FROM ranked",
    "title, url, location, department, NULL::VARCHAR AS job_type, description, external_id FROM ranked"))
def status_cards(spark, sf_dir):
    badge = lp.status_badge(F.expr(cases("ref", _BADGES)))
    apply = F.when(F.col("ref") % 2 == 0, markup("https://www.mckinsey.com/jobs/", F.col("ref")))
    cards = linked(spark, sf_dir, CAREERS_URLS[9], title=F.col("title"), status=badge, apply_href=apply)
    return _plain(lp.parse_cards(cards))


# --- discovery ----------------------------------------------------------------------------------

_HOME = "https://jobs.acme.example.com/en-GB/careers/"
_SHAPES = "id % 6"
_JSON_URL = f"""CASE {_SHAPES} WHEN 0 THEN concat('https://jobs.acme.example.com/open/', ref) WHEN 1 THEN concat('https://www.example.com/open/', ref)
  WHEN 2 THEN concat('https://other.example.org/open/', ref) WHEN 3 THEN concat('https://jobs.acme.example.com/en-GB/careers#job-', ref)
  WHEN 4 THEN 'https://jobs.acme.example.com/es/careers' ELSE concat('https://jobs.acme.example.com/en-GB/careers/?jobId=', ref) END"""
_NORMAL_TITLE = "trim(regexp_replace(title, '\\s+', ' ', 'g'))"


@query("json_discover", _check(
    f"{real_title_sql('title')} AND {_SHAPES} NOT IN (2, 4) AND ({_SHAPES} <> 3 OR loc <> '') AND (loc = '' OR {_in('loc')}) AND portal % 4 <> 3",
    first="url", title=_NORMAL_TITLE, url=_JSON_URL, location=_LOC, department="department", external_id="nullif(CAST(ref AS VARCHAR), '0')"))
def json_discover(spark, sf_dir):
    """Postings two objects deep, beside a list of facets and a mixed list that is not entered.

    Portals 3, 7, ... answer under a path that does not speak of jobs with rows too poor for it.
    """
    rows = postings(spark, sf_dir)

    def url():
        shape = F.col("id") % 6
        ref = F.col("ref").cast("string")
        return (
            F.when(shape == 0, F.concat(F.lit("/open/"), ref)).when(shape == 1, F.concat(F.lit("https://www.example.com/open/"), ref))
            .when(shape == 2, F.concat(F.lit("https://other.example.org/open/"), ref)).when(shape == 4, F.lit("/es/careers"))
            .when(shape == 5, F.concat(F.lit("?jobId="), ref))
        )

    poor = F.col("portal") % 4 == 3
    item = F.to_json(F.struct(
        F.when(F.col("title") == "", "Other").otherwise(F.col("title")).alias("Title"), F.when(~poor, url()).alias("applyUrl"), F.when(~poor, F.col("ref")).alias("jobId"),
        F.when(F.col("location") != "", F.struct(F.lit(1).alias("q"), F.col("location").alias("name"))).alias("locations"),
        F.when(~poor, F.col("department")).alias("category"),
    ))

    def body(items):
        return markup(
            '{"meta": {"facets": [{"name": "x y z", "count": 3}], "mixed": [1, {"title": "A B C", "url": "/open/zz", "id": 1}]},'
            ' "data": {"results": [{"items": [', F.array_join(items, ", "), "]}]}}",
        )

    captures = pages(rows, item, body).withColumn(
        "request_url", F.when(F.col("company_id").cast("long") % 4 == 3, "https://x.example.com/api/list").otherwise("https://x.example.com/api/jobs?facet=1")
    ).withColumns({"content_type": F.lit("application/json; charset=utf-8"), "status": F.lit(200)})
    return _plain(discovery.discover_jobs(attach_companies(captures, settings(rows, _HOME))))


_HREFS = [
    "/jobs/", "/careers/team/", "https://jobs.acme.example.com/job-offer-", "/login/jobs/", "/search/jobs/", "?jobId=", "https://else.example.org/jobs/",
    "/en/careers?x=", "/about/", "/fr/careers/#", "/career/",
]
# Which of the links above are postings by shape; the weak ones need an id of four digits.
_SHAPED = ["yes", "four", "yes", "no", "no", "yes", "no", "no", "no", "no", "weak"]
_DOM_PATH = """CASE id % 11 WHEN 0 THEN concat('/jobs/', slug) WHEN 1 THEN concat('/careers/team/', ref)
  WHEN 2 THEN concat('/job-offer-', slug) WHEN 10 THEN concat('/career/', ref + 10000) ELSE '/en-GB/careers/' END"""
_DOM_CONTEXT = "CASE WHEN ref % 2 = 0 THEN concat(t, ' - ', loc, ' - apply until further notice, all offices') ELSE loc END"
_DOM_SLUG = "concat('senior-data-engineer-', ref)"


@query("dom_discover", with_fixtures("postings") + f""",
asked AS (SELECT *, {PLACES_SQL} AS places, {stripped('title')} AS t, coalesce(location, '') AS loc, {_DOM_SLUG} AS slug FROM postings),
shaped AS (SELECT *, {_DOM_PATH} AS path, {_DOM_CONTEXT} AS context, {cases("id", _SHAPED)} AS shape FROM asked WHERE t <> ''),
titled AS (SELECT *, CASE WHEN {real_title_sql("t")} THEN t WHEN context <> '' AND {real_title_sql("context")} THEN trim(context)
    WHEN id % 11 IN (0, 2) THEN CASE id % 11 WHEN 0 THEN 'Senior Data Engineer' ELSE 'Job Offer Senior Data Engineer' END END AS title2 FROM shaped),
kept AS (SELECT CAST(portal AS VARCHAR) AS company_id, id, title2 AS title,
    CASE id % 11 WHEN 2 THEN concat('https://jobs.acme.example.com', path) WHEN 5 THEN concat('?jobId=', ref) ELSE path END AS url
  FROM titled WHERE (shape IN ('yes', 'weak') OR (shape = 'four' AND ref >= 1000)) AND title2 IS NOT NULL AND length(title2) <= 120
    AND (length(context) <= 40 OR {_in("path")} OR {_in("title2")} OR {_in("context")}))
SELECT company_id, title, url FROM (SELECT *, row_number() OVER (PARTITION BY company_id, url ORDER BY id) AS rn FROM kept) WHERE rn = 1""")
def dom_discover(spark, sf_dir):
    kind = F.col("id") % 11
    tail = F.when(kind.isin(0, 2), F.expr(_DOM_SLUG)).when(kind == 10, (F.col("ref") + 10000).cast("string")).when(kind == 9, "0").otherwise(F.col("ref").cast("string"))
    href = F.concat(F.expr(cases("id", _HREFS)), tail)
    # The careers page itself without an id, and with a fragment of 0, are no postings.
    href = F.when(kind == 7, F.lit("/en/careers?x=12")).otherwise(href)
    rows = postings(spark, sf_dir).withColumn("t", F.trim("title")).withColumn("loc", F.coalesce("location", F.lit("")))
    links = rows.select("company_id", "page_idx", "pos", href.alias("href"), F.col("t").alias("text"), F.expr(_DOM_CONTEXT).alias("context"))
    found = discovery.discover_links(attach_companies(links, settings(rows, _HOME)))
    return found.select("company_id", "title", "url")


@query("merge_by_key", """
WITH base AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS company_id, split_part(split_part(url, '#', 1), '?', 1) AS base, url FROM pages),
both_ AS (SELECT company_id, page_id, 0 AS part, CASE WHEN page_id % 3 = 0 THEN concat(base, '#job-', page_id + 1000) ELSE url END AS u FROM base
  UNION ALL SELECT company_id, page_id, 1, concat(base, '?id=', page_id + 1000) FROM base),
keyed AS (SELECT *, CASE WHEN part = 1 OR page_id % 3 = 0 THEN CAST(page_id + 1000 AS VARCHAR) ELSE lower(u) END AS job_key FROM both_)
SELECT company_id, job_key, u AS url FROM (SELECT *, row_number() OVER (PARTITION BY company_id, job_key ORDER BY contains(u, '#'), part, page_id) AS rn FROM keyed) WHERE rn = 1""")
def merged(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("company_id"),
        F.col("page_id").alias("seq"), "url",
        F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)).alias("base"),
    )
    job_id = (F.col("seq") + 1000).cast("string")
    stub = F.when(F.col("seq") % 3 == 0, F.concat("base", F.lit("#job-"), job_id)).otherwise(F.col("url"))
    json_jobs = rows.select("company_id", "seq", stub.alias("url"))
    link_jobs = rows.select("company_id", "seq", F.concat("base", F.lit("?id="), job_id).alias("url"))
    return discovery.merge_by_key(json_jobs, link_jobs).select("company_id", "job_key", "url")


# --- captures and catalog -----------------------------------------------------------------------

_REQUESTS = ["https://x.example.com/api/jobs?facet=1", "https://x.example.com/api/Facets/jobs", "https://x.example.com/v1/list", "https://x.example.com/wday/cxs/a"]
_TYPES = ["application/json", "text/html", "Application/vnd.api+JSON; charset=utf-8", None, "application/json"]
_BODIES = ['[{"a": 1}]', '{"a": {"b": [1, 2]}}', " \n[1]", "<html>", '{"a": ', "", "12", '["x" 1]']
_CAPTURES = f"""SELECT CAST(o_custkey AS STRING) AS company_id, CAST(o_orderkey AS INT) AS page_idx, {cases("o_orderkey", _REQUESTS)} AS request_url,
  {cases("o_orderkey", _TYPES)} AS content_type, CASE o_orderstatus WHEN 'P' THEN 404 ELSE 200 END AS status,
  {cases("o_custkey", _BODIES).replace("{", "{{").replace("}", "}}")} AS body FROM {{orders}}"""


def _captures(spark, sf_dir):
    return spark.sql(_CAPTURES, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


_CAPTURE_CTE = f"WITH captures AS ({_CAPTURES.format(orders='orders')}) "


@query("capture_admission", _CAPTURE_CTE + """
SELECT company_id, CAST(page_idx AS BIGINT) AS page_idx, request_url, contains(request_url, '/v1/list') AS strict FROM captures
WHERE contains(lower(content_type), 'json') AND status < 400 AND NOT contains(request_url, 'Facets') AND json_valid(body) AND regexp_matches(trim(body, ' ' || chr(10)), '^[\\[{]')""")
def capture_admission(spark, sf_dir):
    return cap.admit_captures(_captures(spark, sf_dir)).select("company_id", "page_idx", "request_url", "strict")


@query("capture_profile", _CAPTURE_CTE + """
SELECT company_id, count(*) FILTER (contains(lower(content_type), 'json')) AS n_json,
  CAST(coalesce(sum(length(body)) FILTER (contains(lower(content_type), 'json')), 0) AS BIGINT) AS json_chars FROM captures GROUP BY ALL""")
def capture_profile(spark, sf_dir):
    return diagnostics.capture_profile(_captures(spark, sf_dir))


@query("capture_first_responses", _CAPTURE_CTE + """
SELECT * FROM (SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY page_idx, request_url) AS position, length(body) AS n_chars, request_url
  FROM captures WHERE contains(lower(content_type), 'json')) WHERE position <= 20""")
def capture_first_responses(spark, sf_dir):
    return diagnostics.first_responses(_captures(spark, sf_dir))


@query("link_profile", _ANCHORS + "SELECT page_id, count(*) AS n_links, count(*) AS n_same_host FROM anchors WHERE href <> '' GROUP BY ALL")
def link_profile(spark, sf_dir):
    return diagnostics.link_profile(page_links(spark, sf_dir), ["page_id"])


@query("link_profile_first", _ANCHORS + """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS position, substr(text, 1, 80) AS text, substr(href, 1, 120) AS href FROM anchors""")
def link_profile_first(spark, sf_dir):
    return diagnostics.first_links(page_links(spark, sf_dir), ["page_id"])


_KINDS = ["workday", "phenom", "successfactors", "html_in_json", "wp_cards", "greenhouse"]
# Thinner and thinner pages, up to the sixtieth.
_PAGE = "(ref % 101) * (ref % 101) * 60 div 10201"
_PAGED = with_fixtures("postings") + f""",
kept AS (SELECT * EXCLUDE (page_idx), {cases("portal", _KINDS)} AS parser, ref - ref % 4 AS link, {_PAGE.replace(" div ", " // ")} AS page_idx FROM postings),
firsts AS (SELECT portal, link, min(page_idx) AS page_idx FROM kept GROUP BY ALL),
news AS (SELECT portal, page_idx, count(*) AS n_new FROM firsts GROUP BY ALL),
pages_ AS (SELECT k.portal, k.page_idx, any_value(k.parser) AS parser, count(*) AS n_items, count(DISTINCT link) AS n_urls FROM kept k GROUP BY ALL),
totals AS (SELECT portal, count(*) AS total FROM kept GROUP BY ALL),
sizes AS (SELECT portal, n_urls AS size FROM pages_ WHERE page_idx = 0),
full_ AS (SELECT p.*, coalesce(n.n_new, 0) AS n_new, t.total, coalesce(s.size, 25) AS size FROM pages_ p JOIN totals t USING (portal)
  LEFT JOIN news n ON n.portal = p.portal AND n.page_idx = p.page_idx LEFT JOIN sizes s ON s.portal = p.portal),
stops AS (SELECT *, CASE parser WHEN 'workday' THEN (page_idx + 1) * 20 >= total WHEN 'phenom' THEN (page_idx + 1) * 50 >= total
  WHEN 'successfactors' THEN n_urls < size WHEN 'html_in_json' THEN n_new = 0 ELSE false END AS stop FROM full_)
SELECT CAST(portal AS VARCHAR) AS company_id, CAST(page_idx AS BIGINT) AS page_idx, parser, n_items FROM stops s
WHERE page_idx <= coalesce((SELECT min(page_idx) FROM stops e WHERE e.portal = s.portal AND e.stop), 1000)"""


@query("paged_source", _PAGED)
def paged_source(spark, sf_dir):
    rows = postings(spark, sf_dir).select(
        "company_id", F.expr(_PAGE).alias("page_idx"), (F.col("ref") - F.col("ref") % 4).alias("url"), F.expr(cases("portal", _KINDS)).alias("parser")
    )
    totals = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("total"), F.first("parser").alias("parser"))
    counted = cap.count_new(rows.drop("parser")).join(totals, "company_id")
    return cap.assemble_pages(counted).select("company_id", "page_idx", "parser", "n_items")


def _companies(spark, sf_dir):
    return resolve_parser(load_companies(fixture(spark, sf_dir, "catalog"), "Madrid"))


_FILTERED = with_fixtures("catalog") + ", effective AS (SELECT *, coalesce(nullif(location_filter, ''), 'Madrid') AS places FROM catalog)"


@query("catalog_effective_filter", _FILTERED + "SELECT company_id, name, ats, places AS location_filter FROM effective")
def catalog_effective_filter(spark, sf_dir):
    return load_companies(fixture(spark, sf_dir, "catalog"), "Madrid").select("company_id", "name", "ats", "location_filter")


# Parser of each careers URL, in the order of the list; None leaves it to the platform.
_EXPECTED = [
    "workday", "wp_cards", "phenom", "id_permalink", "embedded_json", "successfactors", "card_links", "headings", "html_in_json",
    "status_cards", "intervieweb", "resultset", "phenom", None, "html_table", "atom", "query_routed", None, None, "query_routed", None,
]
_ROUTED = _FILTERED + f""", routed AS (SELECT *, CAST(company_id AS BIGINT) % {len(CAREERS_URLS)} AS kind, coalesce({cases("CAST(company_id AS BIGINT)", _EXPECTED)},
  CASE ats WHEN 'playwright' THEN 'discover' WHEN 'html' THEN 'html_listing' WHEN 'taleo' THEN NULL ELSE ats END) AS parser FROM effective)
"""


@query("parser_routing", _ROUTED + "SELECT company_id, ats, careers_url, parser FROM routed")
def parser_routing(spark, sf_dir):
    return _companies(spark, sf_dir).select("company_id", "ats", "careers_url", "parser")


@query("source_errors", _ROUTED + """SELECT company_id, CASE WHEN parser IS NULL THEN concat('unknown platform ', coalesce(ats, '(none)'))
  WHEN parser = 'embedded_json' AND acciona_division IS NULL THEN 'no division configured'
  WHEN parser = 'html_listing' AND CAST(company_id AS BIGINT) % 3 = 0 THEN 'selector not supported: a + b'
  WHEN parser = 'card_links' AND lower(places) <> 'madrid' THEN concat('no country code for ', places) END AS error
FROM routed WHERE error IS NOT NULL""")
def source_errors(spark, sf_dir):
    number = F.col("company_id").cast("long")
    selector = F.when(number % 3 == 0, "a + b").when(number % 3 == 1, "ul > li")
    return cap.source_errors(_companies(spark, sf_dir).withColumn("job_selector", selector), parser_names())


@query("place_codes", _ROUTED + """SELECT company_id, parser, CASE WHEN parser = 'card_links' THEN CASE WHEN lower(places) = 'madrid' THEN '74' END
  WHEN parser = 'id_permalink' THEN '28' END AS code FROM routed""")
def place_codes(spark, sf_dir):
    rows = _companies(spark, sf_dir)
    return rows.select("company_id", "parser", cap.place_code(F.col("parser"), F.col("location_filter")).alias("code"))


@query("request_plan", _ROUTED + """,
sized AS (SELECT *, CAST(company_id AS BIGINT) % 137 AS total, CASE WHEN CAST(company_id AS BIGINT) % 3 = 0 THEN 10 END AS step FROM routed),
paged AS (SELECT *, unnest(range(CASE parser WHEN 'html_table' THEN 4 ELSE greatest(1, coalesce(CAST(ceil(total / (
    CASE parser WHEN 'workday' THEN 20 WHEN 'phenom' THEN 50 WHEN 'successfactors' THEN coalesce(step, 25) WHEN 'html_in_json' THEN step WHEN 'wp_cards' THEN step END)) AS BIGINT), 1)) END)) AS p FROM sized)
SELECT company_id, parser, p AS page_idx, CASE WHEN kind IN (0, 1) OR parser = 'workday' THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN kind = 0 THEN 'https://acme.wd3.myworkdayjobs.com/wday/cxs/acme/External/jobs'
    WHEN kind = 1 THEN 'https://www.alantra.com/wp-admin/admin-ajax.php'
    WHEN kind = 5 THEN concat('https://empleo.es.deloitte.com/search/?sort=x+y&startrow=', p * coalesce(step, 25), '#top')
    WHEN kind = 8 THEN concat('https://eyglobal.yello.co/job_boards/c1riT--B2O/search?query=&filters=139513,180711&page_number=', p + 1)
    WHEN kind = 11 THEN 'https://www.morganstanley.com/web/career_services/webapp/service/careerservice/resultset.json?opportunity=ep&lang=EN&location='
    WHEN kind = 15 THEN 'https://firm.tal.net/vx/mobile-0/appcentre-1/brand-6/candidate/jobboard/vacancy/2/feed'
    WHEN parser = 'workday' THEN CASE kind WHEN 13 THEN 'https://careers.marsh.myworkdayjobs.com/wday/cxs/careers/global/en/other/jobs'
      WHEN 17 THEN 'https://higher.gs.myworkdayjobs.com/wday/cxs/higher/campus/jobs' WHEN 18 THEN 'https://boards.example.myworkdayjobs.com/wday/cxs/boards/acme/jobs' END
    WHEN parser = 'html_table' THEN """ + cases("p", vocab.PROGRAM_PAGES) + """
    WHEN parser = 'greenhouse' THEN concat('https://boards-api.greenhouse.io/v1/boards/', greenhouse_id, '/jobs?content=true')
    WHEN parser = 'lever' THEN concat('https://api.lever.co/v0/postings/', lever_id, '?mode=json') ELSE careers_url END AS url,
  CASE WHEN kind = 0 THEN '{"appliedFacets":{"locations":["3b74"],"jobFamily":["a","b"]},"limit":20,"offset":' || p * 20 || ',"searchText":""}'
    WHEN kind = 17 AND parser = 'workday' THEN '{"appliedFacets":{"LOCATION":["Madrid|London"],"page":["1"]},"limit":20,"offset":' || p * 20 || ',"searchText":""}'
    WHEN parser = 'workday' AND careers_url IS NOT NULL THEN '{"appliedFacets":{},"limit":20,"offset":' || p * 20 || ',"searchText":""}'
    WHEN kind = 1 THEN concat('action=careers_filter&page=', p + 1, '&location=',
      CASE lower(places) WHEN 'madrid' THEN 'Spain+-+Madrid' WHEN 'london' THEN 'UK+-+London' ELSE '' END, '&division=&words=') END AS payload
FROM paged""")
def request_plan(spark, sf_dir):
    number = F.col("company_id").cast("long")
    known = _companies(spark, sf_dir).withColumn("total", number % 137).withColumn("page_size", F.when(number % 3 == 0, 10))
    return cap.request_plan(known)
