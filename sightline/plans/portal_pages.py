"""Captured pages in the shape of each portal, rendered by Spark from the orders.

A page holds the at most 50 orders of one key range, so no group can grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.common import attach_companies
from .fixtures import cases, fixture

FILTERS = ["Madrid", "Madrid|London", "Sevilla"]
PLACES_SQL = cases("portal", FILTERS)
DIVISIONS = ["Bank_Business_Line", "Road_Business_Line"]


def postings(spark, sf_dir) -> DataFrame:
    return fixture(spark, sf_dir, "postings").withColumn("company_id", F.col("portal").cast("string"))


def pages(rows: DataFrame, item: Column, render) -> DataFrame:
    """Group rows to pages in order; ``render`` turns the array of items into a body."""
    items = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))), lambda x: x["item"]
    )
    return rows.groupBy("company_id", "page_idx").agg(items.alias("items")).select(
        "company_id", "page_idx", render(F.col("items")).alias("body")
    )


def settings(rows: DataFrame, careers_url: str) -> DataFrame:
    """Company settings of the portals that occur."""
    return rows.select("company_id", "portal").distinct().select(
        "company_id",
        F.lit(careers_url).alias("careers_url"),
        F.expr(PLACES_SQL).alias("location_filter"),
        F.expr(cases("portal", DIVISIONS)).alias("acciona_division"),
        F.lit(None).cast("string").alias("job_selector"),
    )


def captured(spark, sf_dir, careers_url: str, item, render) -> DataFrame:
    """Pages of a portal with their company's settings."""
    rows = postings(spark, sf_dir)
    return attach_companies(pages(rows, item(), render), settings(rows, careers_url))


def linked(spark, sf_dir, careers_url: str, **columns: Column) -> DataFrame:
    """Links or cards of a portal, one per order, with their company's settings."""
    rows = postings(spark, sf_dir)
    links = rows.select("company_id", "page_idx", "pos", *[c.alias(n) for n, c in columns.items()])
    return attach_companies(links, settings(rows, careers_url))


def as_json(name: str | None = None):
    """Body that is the JSON list itself, or an object holding it."""
    return lambda items: F.to_json(F.struct(items.alias(name)) if name else items)


def as_markup(before: str, after: str):
    return lambda items: F.concat(F.lit(before), F.array_join(items, "\n"), F.lit(after))


def escaped(s: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(char), F.lit(entity))
    return s


def text(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit(""))


def markup(*parts) -> Column:
    return F.concat(*[text(p) for p in parts])
