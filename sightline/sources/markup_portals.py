"""Portals that answer with HTML, HTML inside JSON, or Atom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab
from ..functions.blocks import SELECTOR, listing_blocks
from ..functions.html import all_matches, anchors, attribute, blocks, starts_block, text_of
from ..functions.text import contains_any, norm_text, or_null, slugify, strip, unescape
from ..functions.urls import let, named, url_join, url_part
from .common import flat_map, in_place, keys_of, listings, once_per, sequence, source_keys


def html_blocks(captures: DataFrame) -> DataFrame:
    """Listing blocks of every page: ``pos``, ``href``, ``text``, ``context``."""

    def read(body, selector, page_url):
        for i, block in enumerate(listing_blocks(body, selector, page_url)):
            yield i, *block

    # A selector that is not supported is reported by ``source_errors``; its pages give nothing.
    known = F.coalesce(or_null(F.col("job_selector")).rlike(SELECTOR), F.lit(True))
    return flat_map(
        captures.where(known),
        [*keys_of(captures), "careers_url", "places"],
        ["body", "job_selector", "careers_url"],
        T.StructType.fromDDL("pos int, href string, text string, context string"),
        read,
    )


def parse_html_listing(captures: DataFrame) -> DataFrame:
    """Any listing page: blocks by selector, by class, else job-like anchors."""
    found = html_blocks(captures)
    rows = listings(
        found.where((F.length("text") >= 3) & in_place(F.col("context"))),
        seq=sequence(F.col("pos"), captures),
        title=F.col("text"),
        url=url_join(F.col("careers_url"), F.col("href")),
    )
    return once_per(rows, "url")


def _each(captures: DataFrame, items: Column, fields) -> DataFrame:
    """One row per item with ``pos`` and the computed fields, the body left behind.

    The fields are computed inside the generator, once per item whatever reads them later.
    """
    rows = F.posexplode(F.transform(items, lambda x: named(**fields(x)))).alias("pos", "x")
    carried = [c for c in captures.columns if c != "body"]
    return captures.select(*carried, rows).select(*carried, "pos", "x.*")


def links_from_html(captures: DataFrame) -> DataFrame:
    """Anchors as links: href as written, text, and the text of the innermost block around them."""

    def in_block(piece: Column) -> Column:
        context = F.when(starts_block(piece), text_of(piece)).otherwise("")
        return let(
            context,
            lambda around: F.transform(
                anchors(piece),
                lambda a: named(
                    href=strip(attribute(a["g1"], "href")),
                    text=text_of(a["g2"]),
                    context=around,
                ),
            ),
        )

    found = F.flatten(F.transform(blocks(F.col("body")), in_block))
    carried = [c for c in captures.columns if c != "body"]
    rows = captures.select(*carried, F.posexplode(found).alias("pos", "x"))
    return rows.select(*carried, F.col("pos").cast("long").alias("pos"), "x.*")


def successfactors_cards(captures: DataFrame) -> DataFrame:
    """Job anchors of a page before any location test."""
    found = _each(captures, anchors(F.col("body")), lambda a: {
        "href": strip(attribute(a["g1"], "href")), "text": text_of(a["g2"], ""),
    })
    return found.where(
        F.col("href").contains("/job/") & (F.length("text") >= 4) & F.col("href").rlike(r"/\d{6,}/*$")
    ).withColumn("url", url_join(F.col("careers_url"), F.col("href")))


def parse_successfactors(captures: DataFrame) -> DataFrame:
    """First card per URL, if it is in place. The place is judged before, so no row carries its lists to the sort."""
    cards = successfactors_cards(captures).select(
        *source_keys(captures), sequence(F.col("pos"), captures).alias("seq"), "text", "url", "location_filter",
        in_place(F.col("url"), F.col("text")).alias("fits"),
    )
    return listings(
        once_per(cards, "url").where("fits"),
        seq=F.col("seq"),
        title=F.col("text"),
        url=F.col("url"),
        location=F.col("location_filter"),
    )


_BOARD_ITEM = r'(?i)class="search-results__req_title"[^>]*href="([^"]+)"[^>]*>([^<]+)<'


def board_items(captures: DataFrame) -> DataFrame:
    """Titled items of a board that serves an HTML fragment inside JSON; its office filter stands for the place."""
    fragment = F.get_json_object("body", "$.html")
    rows = _each(captures, all_matches(fragment, _BOARD_ITEM, 1, 2), lambda m: {
        "href": m["g1"], "text": strip(unescape(m["g2"])),
    })
    careers = F.col("careers_url")
    base = F.concat(url_part(careers, "scheme"), F.lit("://"), url_part(careers, "netloc"))
    return listings(
        rows.where(F.length("text") >= 4),
        seq=sequence(F.col("pos"), captures),
        title=F.col("text"),
        url=url_join(base, F.col("href")),
        location=F.col("location_filter"),
    )


def parse_html_in_json(captures: DataFrame) -> DataFrame:
    return once_per(board_items(captures), "url")


_CARD = r'(?is)<li[^>]*class="[^"]*careers__list__item[^"]*"[^>]*>(.*?)</li>'
_CARD_TITLE = r'(?i)class="news-grid__items_title"[^>]*>([^<]+)</p>'
_CARD_PLACE = r'(?i)class="news-grid__items_publish_date"[^>]*>([^<]+)</div>'
_CARD_DEPARTMENT = r'(?i)class="news-grid__items_cat"[^>]*>([^<]+)</div>'


def parse_wp_cards(captures: DataFrame) -> DataFrame:
    """Cards without a page of their own: the URL is the careers page and a slug of the title."""
    fragment = F.get_json_object("body", "$.careers")

    def part(card: Column, pattern: str) -> Column:
        return strip(unescape(or_null(F.regexp_extract(card, pattern, 1))))

    rows = _each(captures, F.regexp_extract_all(fragment, F.lit(_CARD), F.lit(1)), lambda card: {
        "title": part(card, _CARD_TITLE),
        "place": part(card, _CARD_PLACE),
        "department": part(card, _CARD_DEPARTMENT),
    })
    title, place = F.col("title"), F.col("place")
    return listings(
        rows.where((F.coalesce(place, F.lit("")) == "") | in_place(place)),
        seq=sequence(F.col("pos"), captures),
        title=title,
        url=F.concat(F.col("careers_url"), F.lit("#"), slugify(title)),
        location=place,
        department=F.col("department"),
    )


_ATOM = (
    "struct<entry: array<struct<title: string, id: string,"
    " link: array<struct<_href: string, _rel: string>>>>>"
)


def parse_atom(captures: DataFrame) -> DataFrame:
    """Atom feed: the plain alternate link, else one that opens the form, else the entry id."""
    def entry(e: Column) -> dict[str, Column]:
        alternate = F.filter(
            e["link"],
            lambda x: F.coalesce(x["_rel"], F.lit("")).isin("", "alternate")
            & (F.coalesce(x["_href"], F.lit("")) != ""),
        )
        plain = F.filter(alternate, lambda x: ~x["_href"].contains("instant=apply"))
        href = F.coalesce(
            F.get(plain, F.lit(0))["_href"],
            F.get(alternate, F.lit(0))["_href"],
            or_null(strip(e["id"])),
        )
        return {"text": strip(e["title"]), "href": href}

    rows = _each(captures, F.from_xml(F.col("body"), _ATOM)["entry"], entry)
    title, href = F.col("text"), F.col("href")
    found = listings(
        rows.where((F.length(title) >= 4) & in_place(title, href)),
        seq=sequence(F.col("pos"), captures),
        title=title,
        url=href,
        location=F.col("location_filter"),
    )
    return once_per(found, "url")


def parse_id_permalink(captures: DataFrame) -> DataFrame:
    """Rows that open by script: the offer id makes both the URL and the external id."""
    rows = _each(captures, anchors(F.col("body")), lambda a: {
        "element": attribute(a["g1"], "id"),
        "offer": or_null(attribute(a["g1"], "data_idoferta")),
        "text": norm_text(text_of(a["g2"], "")),
    }).where(F.col("element").contains("lbMostrarOferta"))
    return listings(
        rows,
        seq=sequence(F.col("pos"), captures),
        title=F.col("text"),
        url=F.concat(F.lit("https://bdo.epreselec.com/Ofertas/Ofertas.aspx?idOferta="), F.col("offer")),
        location=F.col("location_filter"),
        external_id=F.col("offer"),
    )


def parse_html_table(captures: DataFrame) -> DataFrame:
    """Table rows of two and more cells with a link: title, location, department."""
    table_rows = F.regexp_extract_all(F.col("body"), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    rows = _each(captures, table_rows, lambda row: {
        "cells": F.transform(
            F.regexp_extract_all(row, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)),
            lambda cell: text_of(cell),
        ),
        "href": strip(attribute(F.get(anchors(row), F.lit(0))["g1"], "href")),
    })
    title, place, department = (F.get(F.col("cells"), F.lit(i)) for i in range(3))
    found = listings(
        rows.where((F.size("cells") >= 2) & (F.col("href") != "") & in_place(place, title)),
        seq=sequence(F.col("pos"), captures),
        title=title,
        url=url_join(F.col("careers_url"), F.col("href")),
        location=or_null(place),
        department=or_null(department),
    )
    return once_per(found, "url")


def parse_headings(captures: DataFrame) -> DataFrame:
    """Headings that name a role; all share the page's apply link."""
    def apply_link(a: Column) -> Column:
        return let(
            attribute(a["g1"], "href"),
            lambda href: F.when(
                (href != "") & (text_of(a["g2"]).rlike("(?i)apply") | href.rlike("(?i)recruit|apply")),
                url_join(F.col("careers_url"), href),
            ),
        )

    apply_links = F.filter(
        F.transform(anchors(F.col("body")), apply_link), lambda h: h.isNotNull() & ~h.contains("#")
    )
    heads = F.regexp_extract_all(F.col("body"), F.lit(r"(?is)<h([2-4])\b[^>]*>(.*?)</h\1>"), F.lit(2))
    rows = captures.select(
        "*",
        F.coalesce(F.get(apply_links, F.lit(0)), F.col("careers_url")).alias("apply_url"),
        F.posexplode(F.transform(heads, lambda h: text_of(h))).alias("pos", "text"),
    ).drop("body")
    lowered = F.lower("text")
    found = listings(
        rows.where(
            F.length("text").between(1, 199)
            & contains_any(lowered, vocab.ROLE_STEMS)
            & ~contains_any(lowered, vocab.SECTION_PHRASES)
            & in_place(F.col("text"))
        ),
        seq=sequence(F.col("pos"), captures),
        title=F.col("text"),
        url=F.col("apply_url"),
        location=F.col("location_filter"),
    )
    return once_per(found, "title")
