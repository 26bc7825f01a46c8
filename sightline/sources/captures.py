"""Captured responses before parsing: admission, page assembly and the request plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.blocks import SELECTOR
from ..functions.text import contains_any, lookup, or_null, strip, strings
from ..functions.urls import (
    facet_params, first_param, grouped_params, let, query_params, url_part,
)
from ..operators.dedupe import compute_once
from .common import source_keys


def admit_captures(captures: DataFrame, check_json: bool = True, body_limit: int | None = None) -> DataFrame:
    """Responses worth reading, with ``strict`` set where the path does not speak of jobs.

    ``check_json=False`` leaves the parse test to a reader that parses the body anyway;
    ``body_limit`` drops longer bodies, if given.
    """
    body = strip(F.col("body"))
    path = F.lower(url_part(F.col("request_url"), "path"))
    kept = captures.where(
        F.lower("content_type").contains("json")
        & (F.col("status") < 400)
        & (F.lit(True) if body_limit is None else F.length("body") <= body_limit)
        & body.rlike(r"^[\[{]")
        & ~contains_any(path, vocab.SKIPPED_RESPONSE_PATHS)
    )
    if check_json:
        kept = kept.where(F.try_parse_json("body").isNotNull())
    return kept.withColumn("strict", ~contains_any(path, vocab.JOB_RESPONSE_WORDS))


# --- page assembly ------------------------------------------------------------------------------

def count_new(items: DataFrame) -> DataFrame:
    """Per page: rows, different URLs, and those of them that no earlier page of the source had.

    ``items`` is read once: a URL's first page is a window over the pages that have it.
    """
    keys = source_keys(items)
    on_page = items.groupBy(*keys, "url", "page_idx").agg(F.count(F.lit(1)).alias("n"))
    first = F.min("page_idx").over(Window.partitionBy(*keys, "url"))
    told = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.lit(True))
    return on_page.withColumn("_new", told & (F.col("page_idx") == first)).groupBy(*keys, "page_idx").agg(
        F.sum("n").alias("n_items"), F.count("url").alias("n_urls"), F.count_if("_new").alias("n_new"))


# How each paged portal ends: at its total in pages of a size, at a page with fewer different URLs
# than the first one, at a page without a new URL, or (no further rule) at an empty page.
PAGE_RULES = {
    "workday": {"size": 20},
    "phenom": {"size": 50},
    "successfactors": {"short_page": True},
    "html_in_json": {"new_only": True},
    "wp_cards": {},
}


def _stops_here(rule: dict) -> Column:
    """No further page is read after this one."""
    stop = F.coalesce(F.col("n_items"), F.lit(0)) == 0
    if "size" in rule:
        stop = stop | ((F.col("page_idx") + 1) * rule["size"] >= F.coalesce("total", F.lit(0)))
    if rule.get("new_only"):
        stop = stop | (F.col("n_new") == 0)
    if rule.get("short_page"):
        stop = stop | (F.col("n_urls") < F.col("_size"))
    return stop


def assemble_pages(pages: DataFrame, rules: dict | None = None) -> DataFrame:
    """Pages a source really contributes: in order, up to the first one that ends the list.

    ``pages`` holds ``parser``, ``page_idx`` from 0, ``n_items``, ``n_urls``, ``n_new`` (see
    ``count_new``; items after the place test for cards, before it for rows of links) and ``total``.
    Captured pages are never cut at a number. ``pages`` is read once: both windows hold a source's pages,
    a few numbers each.
    """
    rules = PAGE_RULES if rules is None else rules
    keys = source_keys(pages)
    stop = F.lit(False)
    for parser, rule in rules.items():
        stop = F.when(F.col("parser") == parser, _stops_here(rule)).otherwise(stop)
    source = Window.partitionBy(*keys)
    told = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.lit(True))
    size = F.max(F.when(F.col("page_idx") == 0, F.coalesce(F.nullif("n_urls", F.lit(0)), F.lit(25)))).over(source)
    marked = pages.where(told).withColumn("_size", F.coalesce(size, F.lit(25))).withColumn("_stop", stop)
    ended = marked.withColumn("_end", F.min(F.when(F.col("_stop"), F.col("page_idx"))).over(source))
    return ended.where(
        (F.coalesce("n_items", F.lit(0)) > 0) & (F.col("_end").isNull() | (F.col("page_idx") <= F.col("_end")))
    ).drop("_size", "_stop", "_end")


# --- failures -----------------------------------------------------------------------------------

_JSON_BODIES = ("greenhouse", "lever", "workday", "phenom", "resultset", "intervieweb", "html_in_json", "wp_cards")
# A later page of these that fails only ends the list.
_LENIENT = ("successfactors", "html_in_json")


def capture_error(parser: Column, status: Column, body: Column) -> Column:
    """Why a captured response cannot be read, or null."""
    return (
        F.when(status >= 400, F.concat(F.lit("status "), status.cast("string")))
        .when(parser.isin(*_JSON_BODIES) & F.try_parse_json(body).isNull(), F.lit("body is no JSON"))
        .when((parser == "atom") & ~F.coalesce(body.contains("<feed"), F.lit(False)), F.lit("body is no feed"))
        .when((parser == "headings") & F.lower(body).contains(vocab.BLOCK_PAGE_TEXT), F.lit("blocked"))
    )


def _judged(captures: DataFrame) -> DataFrame:
    return captures.withColumn("error", capture_error(F.col("parser"), F.col("status"), F.col("body")))


def capture_failures(captures: DataFrame) -> DataFrame:
    """Pages that make a company-run fail: its keys, ``page_idx`` and ``error``.

    A failed response of a discovered site is just not read, since others may hold the listings.
    """
    ends = F.col("parser").isin(*_LENIENT) & (F.col("page_idx") > 0)
    failed = _judged(captures).where(F.col("error").isNotNull() & ~ends & (F.col("parser") != "discover"))
    return failed.select(*source_keys(captures), "page_idx", "error")


def readable_captures(captures: DataFrame, name: str | None = None) -> DataFrame:
    """Captures without an error, of a list that a failed page ends only those before it.

    With ``name`` those of one parser; only a parser whose list a failed page ends is read for that too.
    """
    if name is not None:
        captures = captures.where(F.col("parser") == name)
    judged, keys = _judged(captures), source_keys(captures)
    good = judged.where(F.col("error").isNull()).drop("error")
    if name is not None and name not in _LENIENT:
        return good
    ends = judged.where(F.col("error").isNotNull() & F.col("parser").isin(*_LENIENT))
    ends = ends.groupBy(*keys).agg(F.min("page_idx").alias("_end"))
    return good.join(ends, keys, "left").where(F.col("_end").isNull() | (F.col("page_idx") < F.col("_end"))).drop("_end")


# --- request plan -------------------------------------------------------------------------------

def _form_encoded(s: Column) -> Column:
    """Query encoding with blank as plus; tilde stays, star does not."""
    encoded = F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~"))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


def _encoded_query(pairs: Column) -> Column:
    return F.array_join(
        F.transform(
            pairs,
            lambda p: F.concat(_form_encoded(p["name"]), F.lit("="), _form_encoded(p["value"])),
        ),
        "&",
    )


_BOARD = "/job_boards/([^/?#]+)"
_BRAND = "/brand-([^/]+)/"
_VACANCY = r"/vacancy/(\d+)"


def request_plan(companies: DataFrame) -> DataFrame:
    """Pages to fetch per company: ``page_idx``, ``method``, ``url``, ``payload``.

    Needs ``parser`` (see ``resolve_parser``). A paged portal gets its first page, or all of them
    where a ``total`` column says how many postings there are; without a total the fetcher goes on
    until ``assemble_pages`` would stop. ``page_size`` is the size that a portal's first page had.
    A portal of several program pages gets each of them.
    """
    careers = F.col("careers_url")
    scheme, netloc, path, query, host = (
        url_part(careers, p) for p in ("scheme", "netloc", "path", "query", "host")
    )
    origin = F.concat(scheme, F.lit("://"), netloc)
    parser, page = F.col("parser"), F.col("page_idx")
    total = F.col("total") if "total" in companies.columns else F.lit(0)

    step = F.col("page_size") if "page_size" in companies.columns else F.lit(None).cast("int")
    size = (
        F.when(parser == "workday", F.lit(20)).when(parser == "phenom", F.lit(50))
        .when(parser == "successfactors", F.coalesce(step, F.lit(25))).when(parser.isin("html_in_json", "wp_cards"), step)
    )
    by_total = F.coalesce(F.ceil(F.coalesce(total, F.lit(0)) / size) - 1, F.lit(0))
    programs = len(vocab.PROGRAM_PAGES)
    last_page = F.when(parser == "html_table", programs - 1).otherwise(F.greatest(by_total, F.lit(0))).cast("int")
    planned = companies.withColumn("page_idx", F.explode(F.sequence(F.lit(0), last_page)))

    labels = F.split(host, r"\.")
    tenant, instance = F.get(labels, F.lit(0)), F.get(labels, F.lit(1))
    site = F.array_join(
        F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike("^[a-z]{2}-[A-Z]{2}$")), "/"
    )
    facets = F.to_json(
        F.struct(
            grouped_params(facet_params(query)).alias("appliedFacets"),
            F.lit(20).alias("limit"),
            (page * 20).alias("offset"),
            F.lit("").alias("searchText"),
        )
    )
    kept = F.filter(query_params(query), lambda p: F.lower(p["name"]) != "startrow")
    startrow = F.array(
        F.struct(F.lit("startrow").alias("name"), (page * F.coalesce(step, F.lit(25))).cast("string").alias("value"))
    )
    fragment = url_part(careers, "fragment")
    row_page = F.concat(
        origin, path, F.lit("?"), _encoded_query(F.concat(kept, startrow)),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    label = F.coalesce(lookup(vocab.CARD_LOCATION_LABELS, F.lower("location_filter")), F.lit(""))

    url = (
        F.when(
            parser == "workday",
            F.concat(
                F.lit("https://"), tenant, F.lit("."), instance,
                F.lit(".myworkdayjobs.com/wday/cxs/"), tenant, F.lit("/"), site, F.lit("/jobs"),
            ),
        )
        .when(parser == "successfactors", row_page)
        .when(
            parser == "html_in_json",
            F.concat(
                origin, F.lit("/job_boards/"), F.regexp_extract(path, _BOARD, 1),
                F.lit(f"/search?query=&filters={vocab.BOARD_OFFICE_IDS}&page_number="),
                (page + 1).cast("string"),
            ),
        )
        .when(
            parser == "atom",
            F.concat(
                origin, F.lit("/vx/mobile-0/appcentre-1/brand-"), F.regexp_extract(path, _BRAND, 1),
                F.lit("/candidate/jobboard/vacancy/"), F.regexp_extract(path, _VACANCY, 1),
                F.lit("/feed"),
            ),
        )
        .when(
            parser == "resultset",
            F.concat(
                F.lit("https://www.morganstanley.com/web/career_services/webapp/service/"
                      "careerservice/resultset.json?opportunity="),
                first_param(query, "opportunity", "sg"), F.lit("&lang=EN&location="),
            ),
        )
        .when(
            parser == "greenhouse",
            F.concat(
                F.lit("https://boards-api.greenhouse.io/v1/boards/"), F.col("greenhouse_id"),
                F.lit("/jobs?content=true"),
            ),
        )
        .when(
            parser == "lever",
            F.concat(F.lit("https://api.lever.co/v0/postings/"), F.col("lever_id"), F.lit("?mode=json")),
        )
        .when(parser == "wp_cards", F.concat(origin, F.lit("/wp-admin/admin-ajax.php")))
        .when(parser == "html_table", F.get(strings(vocab.PROGRAM_PAGES), page))
        .otherwise(careers)
    )
    payload = F.when(parser == "workday", facets).when(
        parser == "wp_cards",
        F.concat(
            F.lit("action=careers_filter&page="), (page + 1).cast("string"),
            F.lit("&location="), _form_encoded(label), F.lit("&division=&words="),
        ),
    )
    return planned.select(
        "company_id", "parser", "page_idx",
        F.when(payload.isNotNull(), "POST").otherwise("GET").alias("method"),
        url.alias("url"), payload.alias("payload"),
    )


def source_errors(companies: DataFrame, known: list[str] | tuple = ()) -> DataFrame:
    """Companies that cannot be read at all, with the reason; the others are not affected.

    ``known`` names the parsers there are (see ``registry.parser_names``); without it all pass.
    """
    city = F.lower("location_filter")
    selector = F.col("job_selector") if "job_selector" in companies.columns else F.lit(None).cast("string")

    def reason(parser: Column, path: Column) -> Column:
        return (
            F.when(parser.isNull(), F.concat(F.lit("unknown platform "), F.coalesce("ats", F.lit("(none)"))))
            .when(F.lit(bool(known)) & ~parser.isin(*known), F.concat(F.lit("no parser named "), parser))
            .when(
                (parser == "embedded_json") & or_null(F.col("acciona_division")).isNull(),
                F.lit("no division configured"),
            )
            .when(
                (parser == "html_listing") & ~F.coalesce(or_null(selector).rlike(SELECTOR), F.lit(True)),
                F.concat(F.lit("selector not supported: "), selector),
            )
            .when((parser == "html_in_json") & ~path.rlike(_BOARD), F.lit("no board id in the careers URL"))
            .when(
                (parser == "atom") & ~(path.rlike(_BRAND) & path.rlike(_VACANCY)),
                F.lit("no brand or vacancy in the careers URL"),
            )
            .when(
                (parser == "card_links") & ~F.array_contains(strings(vocab.CARD_LINK_COUNTRY_CODES), city),
                F.concat(F.lit("no country code for "), F.col("location_filter")),
            )
        )

    error = let(
        F.col("parser"), lambda parser: let(url_part(F.col("careers_url"), "path"), lambda path: reason(parser, path))
    )
    return compute_once(companies, F.struct(error.alias("error")), lambda x: x["error"].isNotNull()).select(
        "company_id", "error"
    )


def place_code(parser: Column, location_filter: Column) -> Column:
    """Code a portal's own place filter takes: a country or a province."""
    city = F.lower(location_filter)
    return F.when(parser == "card_links", lookup(vocab.CARD_LINK_COUNTRY_CODES, city)).when(
        parser == "id_permalink",
        F.coalesce(lookup(vocab.PROVINCE_CODES, city), F.lit(vocab.PROVINCE_FALLBACK)),
    )
