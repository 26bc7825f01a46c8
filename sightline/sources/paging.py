"""Pages of paged portals as they are read: which of the captured ones a source really contributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import json_portals, markup_portals
from .captures import PAGE_RULES, assemble_pages, count_new
from .common import source_keys


def _page_of(seq: str) -> Column:
    return F.shiftright(seq, 32).cast("int")


def _listed(captures: DataFrame, rows: DataFrame) -> DataFrame:
    """(keys, page_idx, url) of rows that carry ``seq``."""
    return rows.select(*source_keys(captures), _page_of("seq").alias("page_idx"), "url")


def _postings(captures: DataFrame, parts: tuple[DataFrame, str]) -> DataFrame:
    rows, url = parts
    return rows.select(*source_keys(captures), F.col("page_idx").cast("int").alias("page_idx"), F.col(url).alias("url"))


# What counts on a page: postings before any test of the place for portals with a total and for rows of links,
# titled board items, and cards that pass the test of the place.
_ITEMS = {
    "workday": lambda c: _postings(c, (json_portals.workday_postings(c), "r.externalPath")),
    "phenom": lambda c: _postings(c, (json_portals.phenom_postings(c), "r.applyUrl")),
    "successfactors": lambda c: _postings(c, (markup_portals.successfactors_cards(c), "url")),
    "html_in_json": lambda c: _listed(c, markup_portals.board_items(c)),
    "wp_cards": lambda c: _listed(c, markup_portals.parse_wp_cards(c)),
}
_TOTALS = {"workday": "$.total", "phenom": "$.refineSearch.totalHits"}


def page_counts(captures: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per captured page of a paged portal: rows, different and new URLs, and the total that it tells."""
    names = [n for n in _ITEMS if names is None or n in names]
    keys = [*source_keys(captures), "page_idx"]
    total = F.lit(None).cast("long")
    for name, path in _TOTALS.items():
        total = F.when(F.col("parser") == name, F.get_json_object("body", path).try_cast("long")).otherwise(total)
    pages = captures.where(F.col("parser").isin(*names)).select(*keys, "parser", total.alias("total"))
    pages = pages.groupBy(*keys, "parser").agg(F.max("total").alias("total"))
    items = reduce(DataFrame.unionByName, [_ITEMS[n](captures.where(F.col("parser") == n)) for n in names])
    counted = count_new(items)
    return pages.join(counted, keys, "left").na.fill(0, ["n_items", "n_urls", "n_new"])


def contributed(captures: DataFrame, name: str) -> DataFrame:
    """Captures of the parser ``name`` less the pages that come after the one that ends a paged portal's list.

    A page is judged by its parsed rows (see ``assemble_pages``); captures of a parser without pages all stay.
    """
    if "page_idx" not in captures.columns or name not in PAGE_RULES:
        return captures
    keys = [*source_keys(captures), "page_idx"]
    kept = assemble_pages(page_counts(captures, [name])).select(*keys)
    return captures.join(kept, keys, "left_semi").select(*captures.columns)


def first_pages(captures: DataFrame) -> DataFrame:
    """(company_id, total, page_size) of paged portals from their captured first page, for ``request_plan``."""
    counted = page_counts(captures.where("page_idx = 0"))
    return counted.groupBy("company_id").agg(
        F.max("total").alias("total"), F.max(F.nullif("n_urls", F.lit(0))).cast("int").alias("page_size"))
