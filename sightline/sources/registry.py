"""Which parser reads which company, and one job over all of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import lookup
from ..functions.urls import let, named, url_part
from ..operators import discovery
from . import json_portals, link_portals, markup_portals
from .captures import readable_captures
from .paging import contributed

Parser = Callable[[DataFrame], DataFrame]

# Parsers of captured bodies. A project adds its own with ``CAPTURE_PARSERS["name"] = function``.
CAPTURE_PARSERS: dict[str, Parser] = {
    "greenhouse": json_portals.parse_greenhouse,
    "lever": json_portals.parse_lever,
    "workday": json_portals.parse_workday,
    "phenom": json_portals.parse_phenom,
    "resultset": json_portals.parse_resultset,
    "intervieweb": json_portals.parse_intervieweb,
    "embedded_json": json_portals.parse_embedded_json,
    "html_listing": markup_portals.parse_html_listing,
    "successfactors": markup_portals.parse_successfactors,
    "html_in_json": markup_portals.parse_html_in_json,
    "wp_cards": markup_portals.parse_wp_cards,
    "atom": markup_portals.parse_atom,
    "id_permalink": markup_portals.parse_id_permalink,
    "html_table": markup_portals.parse_html_table,
    "headings": markup_portals.parse_headings,
    "discover": discovery.discover_jobs,
}

# Parsers of rendered links.
LINK_PARSERS: dict[str, Parser] = {
    "atom": link_portals.parse_talentlink_links,
    "query_routed": link_portals.parse_ubs_links,
    "card_links": link_portals.parse_cegid_links,
    "discover": discovery.discover_links,
}

# Parsers of rendered cards (``title``, ``status``, ``apply_href``).
CARD_PARSERS: dict[str, Parser] = {"status_cards": link_portals.parse_cards}


def parser_names() -> list[str]:
    return sorted({*CAPTURE_PARSERS, *LINK_PARSERS, *CARD_PARSERS})


def parser_column(careers_url: Column, ats: Column, rules=None, platforms=None) -> Column:
    """Host rules first, then the configured platform; null when neither is known.

    The rules are a short fixed list, so they become one CASE and no join is needed.
    """
    rules = vocab.HOST_RULES if rules is None else rules
    platforms = vocab.PLATFORM_PARSERS if platforms is None else platforms

    def first_rule(site: Column) -> Column:
        choice = F
        for kind, name, fragment, parser in rules:
            fits = site["host"].endswith(name) if kind == "suffix" else site["host"] == name
            if fragment:
                fits = fits & site["path"].contains(fragment)
            choice = choice.when(fits, parser)
        return choice.otherwise(lookup(platforms, ats))

    url = F.coalesce(careers_url, F.lit(""))
    return let(named(host=url_part(url, "host"), path=F.lower(url_part(url, "path"))), first_rule)


def resolve_parser(companies: DataFrame) -> DataFrame:
    return companies.withColumn("parser", parser_column(F.col("careers_url"), F.col("ats")))


def parse_captures(captures: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Listings of all captures that carry a ``parser``: one branch per parser, then a union.

    Each branch filters on ``parser``; with captures written partitioned by parser the filter
    prunes files, so every body is read once.
    """
    parsers = CAPTURE_PARSERS if parsers is None else parsers
    parts = [parse(captures.where(F.col("parser") == name)) for name, parse in parsers.items()]
    return reduce(DataFrame.unionByName, parts)


def parse_sources(
    captures: DataFrame, links: DataFrame | None = None, cards: DataFrame | None = None, names: list[str] | None = None
) -> DataFrame:
    """Listings of everything captured: readable bodies, rendered links and cards, by ``parser``.

    Of a paged portal only the pages up to the one that ends its list count (see ``paging.contributed``);
    every parser judges its own captures, so a branch reads no others'.
    What responses and links of a discovered site say of one posting is merged to one row.
    ``names`` lists the parsers that the catalog uses, all by default; the plan has a branch each.
    """
    names = parser_names() if names is None else names
    if unknown := sorted(set(names) - set(parser_names())):
        raise ValueError(f"no parser named {', '.join(unknown)}")

    def parts(rows: DataFrame | None, parsers: dict[str, Parser], own) -> dict[str, DataFrame]:
        return {} if rows is None else {n: p(own(rows, n)) for n, p in parsers.items() if n in names}

    def readable(rows: DataFrame, name: str) -> DataFrame:
        return contributed(readable_captures(rows, name), name)

    def routed(rows: DataFrame, name: str) -> DataFrame:
        return rows.where(F.col("parser") == name)

    bodies, anchors, shown = parts(captures, CAPTURE_PARSERS, readable), parts(links, LINK_PARSERS, routed), parts(cards, CARD_PARSERS, routed)
    discovered = [x.pop("discover") for x in (bodies, anchors) if "discover" in x]
    if len(discovered) == 2:
        discovered = [discovery.merge_by_key(*discovered).drop("job_key")]
    return reduce(DataFrame.unionByName, [*bodies.values(), *anchors.values(), *shown.values(), *discovered])
