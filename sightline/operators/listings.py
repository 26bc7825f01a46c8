"""Read side of the state table: filters, search, cards and counts. ``as_of`` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE_DAYS = {"today": 1, "7d": 7}


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Jobs with their company's name, ``Unknown`` when there is none."""
    names = companies.select("company_id", F.col("name").alias("_name"))
    return jobs.join(names, "company_id", "left").withColumn(
        "company", F.coalesce("_name", F.lit("Unknown"))
    ).drop("_name")


def visible(jobs: DataFrame) -> DataFrame:
    """Active and not dropped; an undecided listing (null) is shown."""
    return jobs.where(F.col("is_active") & F.coalesce(F.col("ai_keep"), F.lit(True)))


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def recent(jobs: DataFrame, as_of: Column, days: int) -> DataFrame:
    """First seen in the last ``days`` times 24 hours, boundary included; future rows pass."""
    return jobs.where(F.col("first_seen_at") >= days_before(as_of, days))


def in_range(jobs: DataFrame, label: str, as_of: Column) -> DataFrame:
    """Date chip: ``today`` (24 hours), ``7d`` or ``all``."""
    return jobs if label == "all" else recent(jobs, as_of, _RANGE_DAYS[label])


def search(jobs: DataFrame, query: str) -> DataFrame:
    """Substring over title, company, location, department and reason joined by blanks.

    A hit may span two fields, so an absent field still leaves its blank.
    """
    if not query:
        return jobs
    fields = ["title", "company", "location", "department", "ai_reason"]
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields])
    return jobs.where(F.lower(text).contains(query.lower()))


def by_name(companies: DataFrame, part: str | None) -> DataFrame:
    return companies.where(F.lower("name").contains(part.lower())) if part else companies


def newest_first(jobs: DataFrame, n: int | None = None) -> DataFrame:
    """Newest first; with ``n`` a top-n that never sorts the whole table."""
    ordered = jobs.orderBy(F.desc("first_seen_at"), "url", "company")
    return ordered if n is None else ordered.limit(n)


def cards(jobs: DataFrame) -> DataFrame:
    """What a listing card shows."""
    day = F.date_format("first_seen_at", "d MMM")
    present = lambda c: F.when(F.col(c) != "", F.col(c))
    return jobs.select(
        "company", "title", "url",
        present("location").alias("location"),
        present("department").alias("department"),
        present("job_type").alias("badge"),
        present("ai_reason").alias("reason"),
        F.when(F.col("ai_keep").isNull(), "Filter decision pending").alias("pending"),
        F.regexp_replace(day, "Sep$", "Sept").alias("shown_date"),
    )


def count_by_company(jobs: DataFrame) -> DataFrame:
    """Listings per company, companies in code-point order."""
    return jobs.groupBy("company").agg(F.count(F.lit(1)).alias("n_listings")).orderBy("company")


def header(jobs: DataFrame) -> DataFrame:
    """Number of listings and companies; per-company counts first, so the distinct is small."""
    per = jobs.groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_listings"), F.count(F.lit(1)).alias("n_companies")
    )


def showing(jobs: DataFrame, label: str, query: str, as_of: Column) -> DataFrame:
    """Showing N of M, in one pass."""
    hit = F.lit(True)
    if label != "all":
        hit = hit & (F.col("first_seen_at") >= days_before(as_of, _RANGE_DAYS[label]))
    if query:
        fields = ["title", "company", "location", "department", "ai_reason"]
        text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields])
        hit = hit & F.lower(text).contains(query.lower())
    return jobs.agg(F.count_if(hit).alias("n_shown"), F.count(F.lit(1)).alias("n_total"))


def dashboard(jobs: DataFrame, label: str, query: str, as_of: Column) -> DataFrame:
    """Visible listings in the chosen range that match the query, grouped by company."""
    shown = search(in_range(visible(jobs), label, as_of), query)
    return shown.orderBy("company", F.desc("first_seen_at"), "url")
