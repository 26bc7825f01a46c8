"""Portals that answer with JSON: captured bodies to listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import attribute
from ..functions.text import or_null, strip
from ..functions.urls import url_part
from .common import in_place, listings, sequence

_DESCRIPTION_LIMIT = 500


def _rows(captures: DataFrame, body: Column, schema: str, path: str | None) -> DataFrame:
    """One row ``r`` per array element of the parsed body; text that does not parse gives none."""
    parsed = F.from_json(body, schema)
    items = parsed[path] if path and "." not in path else parsed
    for step in (path or "").split(".") if path and "." in path else []:
        items = items[step]
    return captures.select("*", F.posexplode(items).alias("pos", "r")).drop("body")


def _cut(text: Column) -> Column:
    return or_null(F.substring(text, 1, _DESCRIPTION_LIMIT))


def _first_text(*names: str) -> Column:
    """First of the fields that is neither null nor empty."""
    return F.coalesce(*[or_null(F.col(f"r.{n}")) for n in names])


def parse_greenhouse(captures: DataFrame) -> DataFrame:
    rows = _rows(
        captures,
        F.col("body"),
        "struct<jobs: array<struct<id: string, title: string, absolute_url: string,"
        " location: struct<name: string>, departments: array<struct<name: string>>,"
        " metadata: array<struct<name: string, value: string>>, content: string>>>",
        "jobs",
    )
    typed = F.filter(F.col("r.metadata"), lambda m: F.lower(m["name"]).contains("type"))
    location = F.col("r.location.name")
    return listings(
        rows.where(in_place(location)),
        seq=sequence(F.col("pos"), captures),
        title=F.col("r.title"),
        url=F.col("r.absolute_url"),
        location=or_null(location),
        department=F.get(F.col("r.departments"), F.lit(0))["name"],
        job_type=F.get(typed, F.lit(0))["value"],
        external_id=F.col("r.id"),
        description=_cut(F.col("r.content")),
    )


def parse_lever(captures: DataFrame) -> DataFrame:
    rows = _rows(
        captures,
        F.col("body"),
        "array<struct<id: string, text: string, hostedUrl: string, descriptionPlain: string,"
        " categories: struct<location: string, department: string, commitment: string>>>",
        None,
    )
    location = F.col("r.categories.location")
    return listings(
        rows.where(in_place(location)),
        seq=sequence(F.col("pos"), captures),
        title=F.col("r.text"),
        url=F.col("r.hostedUrl"),
        location=or_null(location),
        department=or_null(F.col("r.categories.department")),
        job_type=or_null(F.col("r.categories.commitment")),
        external_id=F.col("r.id"),
        description=_cut(F.col("r.descriptionPlain")),
    )


def workday_postings(captures: DataFrame) -> DataFrame:
    """Postings of a page before any test."""
    return _rows(
        captures,
        F.col("body"),
        "struct<jobPostings: array<struct<title: string, locationsText: string,"
        " externalPath: string>>>",
        "jobPostings",
    )


def parse_workday(captures: DataFrame) -> DataFrame:
    """No dedupe: a posting listed twice stays twice until the snapshot is folded."""
    rows = workday_postings(captures)
    location = F.col("r.locationsText")
    host = url_part(F.col("careers_url"), "host")
    return listings(
        rows.where(in_place(location)),
        seq=sequence(F.col("pos"), captures),
        title=F.col("r.title"),
        url=F.concat(F.lit("https://"), host, or_null(F.col("r.externalPath"))),
        location=or_null(location),
    )


def phenom_postings(captures: DataFrame) -> DataFrame:
    """Postings of a page before any test."""
    return _rows(
        captures,
        F.col("body"),
        "struct<refineSearch: struct<data: struct<jobs: array<struct<title: string,"
        " location: string, city: string, multi_location: array<string>, applyUrl: string,"
        " jobId: string, reqId: string, category: string>>>>>",
        "refineSearch.data.jobs",
    )


def parse_phenom(captures: DataFrame) -> DataFrame:
    rows = phenom_postings(captures)
    location = _first_text("location", "city")
    job_id = _first_text("jobId", "reqId")
    host = url_part(F.col("careers_url"), "host")
    built = F.concat(F.lit("https://"), host, F.lit("/global/en/job/"), job_id)
    apply_url = or_null(F.replace(F.col("r.applyUrl"), F.lit("&amp;"), F.lit("&")))
    return listings(
        rows.where(in_place(location, F.array_join(F.col("r.multi_location"), ", "))),
        seq=sequence(F.col("pos"), captures),
        title=strip(F.col("r.title")),
        url=F.coalesce(apply_url, built),
        location=location,
        department=or_null(F.col("r.category")),
        external_id=job_id,
    )


def _place_parts(*names: str) -> tuple[Column, Column, Column]:
    """Stripped fields: the match text of all, and the first two for display."""
    parts = [or_null(strip(F.col(f"r.{n}"))) for n in names]
    return F.concat_ws(" | ", *parts), parts[0], parts[1]


def parse_resultset(captures: DataFrame) -> DataFrame:
    rows = _rows(
        captures,
        F.col("body"),
        "struct<resultSet: array<struct<jobTitle: string, url: string, location: string,"
        " city: string, country: string>>>",
        "resultSet",
    )
    text, location, city = _place_parts("location", "city", "country")
    return listings(
        rows.where(in_place(text)),
        seq=sequence(F.col("pos"), captures),
        title=strip(F.col("r.jobTitle")),
        url=strip(F.col("r.url")),
        location=F.coalesce(location, city),
    )


def parse_intervieweb(captures: DataFrame) -> DataFrame:
    rows = _rows(
        captures,
        F.col("body"),
        "array<struct<slug: string, title: string, location: string, city: string,"
        " nation: string>>",
        None,
    )
    text, location, city = _place_parts("location", "city", "nation")
    slug = or_null(strip(F.col("r.slug")))
    return listings(
        rows.where(in_place(text)),
        seq=sequence(F.col("pos"), captures),
        title=strip(F.col("r.title")),
        url=F.concat(F.lit("https://mediobanca.intervieweb.it/jobs/"), slug, F.lit("/en/")),
        location=F.coalesce(location, city),
    )


def parse_embedded_json(captures: DataFrame) -> DataFrame:
    """A whole catalogue as JSON in an attribute; only the company's division counts.

    A company without a division is an error, reported by ``source_errors``, and yields no rows.
    """
    tag = F.regexp_extract(F.col("body"), r"""(?is)<a-mo-oferta-v2\b((?:[^>"']+|"[^"]*"|'[^']*')*+)>""", 1)
    rows = _rows(
        captures,
        attribute(tag, "jobs"),
        "array<struct<id: string, jobRequisitionId: string, divisionID: string,"
        " divisionTitle: string, primaryLocation: string, jobPostingTitle: string, url: string>>",
        None,
    )
    location = F.col("r.primaryLocation")
    path = F.coalesce(
        or_null(F.col("r.url")),
        F.concat(
            F.lit("/our-purpose/work-with-us/job-detail?id="),
            F.coalesce(F.col("r.id"), F.lit("None")),
        ),
    )
    return listings(
        rows.where((F.col("r.divisionID") == F.col("acciona_division")) & in_place(location)),
        seq=sequence(F.col("pos"), captures),
        title=strip(F.col("r.jobPostingTitle")),
        url=F.when(path.startswith("http"), path).otherwise(
            F.concat(F.lit("https://www.acciona.com"), path)
        ),
        location=or_null(location),
        department=or_null(F.col("r.divisionTitle")),
        external_id=F.coalesce(_first_text("id", "jobRequisitionId"), F.lit("")),
    )
