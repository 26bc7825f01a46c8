"""Portals read from rendered links or cards: ``pos``, ``href``, ``text`` per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_null, strip
from ..functions.urls import url_part
from .common import in_place, listings, once_per, sequence

_OPPORTUNITY_PATH = r"(?i)/candidate/so/pm/[^/]+/pl/[^/]+/opp/[^/?#]+"
_STATUS_BADGE = (
    "(ROLLING|THIS ROUND[’']S DEADLINE HAS PASSED|DEADLINE HAS PASSED|APPLY NOW|CLOSED|OPEN NOW)"
)


def parse_talentlink_links(links: DataFrame) -> DataFrame:
    """Candidate-portal anchors of the opportunity shape."""
    href, text = F.col("href"), F.col("text")
    found = listings(
        links.where(href.rlike(_OPPORTUNITY_PATH) & (F.length(text) >= 4) & in_place(text, href)),
        seq=sequence(F.col("pos"), links),
        title=text,
        url=href,
        location=F.col("location_filter"),
    )
    return once_per(found, "url")


def parse_ubs_links(links: DataFrame) -> DataFrame:
    """Query-routed details on the same host; only the title can show the place."""
    href, title = F.col("href"), strip(F.col("text"))
    host = url_part(href, "host")
    found = listings(
        links.where(
            href.contains("PageType=JobDetails")
            & (F.length(title) >= 5)
            & ((host == "") | (host == url_part(F.col("careers_url"), "host")))
            & in_place(title)
        ),
        seq=sequence(F.col("pos"), links),
        title=title,
        url=href,
    )
    return once_per(found, "url")


def parse_cegid_links(links: DataFrame) -> DataFrame:
    """Title links of a list the portal already filtered by country."""
    found = listings(
        links,
        seq=sequence(F.col("pos"), links),
        title=strip(F.col("text")),
        url=strip(F.col("href")),
        location=F.col("location_filter"),
    )
    return once_per(found, "url")


def status_badge(first_line: Column) -> Column:
    """The upper-case status label in a card's first line, or null."""
    return or_null(F.regexp_extract(first_line, _STATUS_BADGE, 1))


def _title_case(s: Column) -> Column:
    """A capital at the start of every run of letters, also after a hyphen or an apostrophe."""
    runs = F.regexp_extract_all(s, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.initcap(x)), "")


def normal_status(status: Column) -> Column:
    s = F.lower(status)
    return (
        F.when(s.contains("rolling"), "Rolling")
        .when(s.contains("passed"), "Deadline passed")
        .when(s.contains("apply now") | (s == "open"), "Open")
        .when(s == "closed", "Closed")
        .when(s != "", _title_case(s))
    )


def parse_cards(cards: DataFrame) -> DataFrame:
    """Deadline cards (``title``, ``status``, ``apply_href``): the status joins the title."""
    title, status = strip(F.col("title")), normal_status(F.col("status"))
    shown = F.concat(title, F.coalesce(F.concat(F.lit(" ("), status, F.lit(")")), F.lit("")))
    first = once_per(
        cards.withColumn("title", title)
        .withColumn("shown", shown)
        .withColumn("seq", sequence(F.col("pos"), cards))
        .where((title != "") & in_place(title)),
        "title",
    )
    return listings(
        first,
        seq=F.col("seq"),
        title=F.col("shown"),
        url=F.coalesce(or_null(F.col("apply_href")), F.col("careers_url")),
        location=F.col("location_filter"),
    )
