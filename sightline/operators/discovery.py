"""Postings in responses and pages of unknown shape."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab
from ..functions.jsonwalk import candidates, parsed, posting, readable, score
from ..functions.text import (
    contains_any, contains_path_part, norm_text, real_title, slug_title, title_pick,
)
from ..functions.urls import canonical_key, let, root_domain, strip_locale, url_join, url_part, url_parts
from ..sources.captures import admit_captures
from ..sources.common import flat_map, in_place, keys_of, listings, once_per, sequence, source_keys
from .dedupe import compute_once, first_by


@F.pandas_udf(T.IntegerType())
def job_score(objects: pd.Series) -> pd.Series:
    """0 to 5: how many of title, url, id, location and department a JSON object has."""
    found = objects.map(lambda text: parsed(text) if text is not None else None)
    return found.map(lambda obj: score(obj) if isinstance(obj, dict) else 0).astype("int32")


@F.pandas_udf(T.StringType())
def _flatten_nested(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else readable(parsed(v)))


def flatten_json(raw: Column) -> Column:
    """JSON text of any value as one readable text. Strings stay native; the rest goes to Python."""
    quoted = raw.rlike(r'^\s*"')
    plain = F.get_json_object(F.concat(F.lit('{"v":'), F.when(quoted, raw), F.lit("}")), "$.v")
    return F.when(quoted, plain).otherwise(_flatten_nested(F.when(~quoted, raw)))


# Least part of a list's items that have a title; the others (adverts, closing entries) are left out.
TITLED = 0.5


def json_candidates(captures: DataFrame) -> DataFrame:
    """Candidate objects of admitted captures (they carry ``strict``), in document order."""

    def walk(body, strict):
        for i, obj in enumerate(candidates(body, strict, share=TITLED)):
            yield i, *posting(obj)

    return flat_map(
        captures,
        [*keys_of(captures), "careers_url", "places"],
        ["body", "strict"],
        T.StructType.fromDDL(
            "pos long, raw_title string, raw_url string, raw_id string, raw_location string,"
            " raw_department string"
        ),
        walk,
    )


def _base_path() -> Column:
    return strip_locale(url_part(F.col("careers_url"), "path"))


def _has_job_query(query: Column) -> Column:
    return contains_any(F.lower(query), vocab.JOB_QUERY_KEYS)


def discover_jobs(captures: DataFrame) -> DataFrame:
    """Postings in any JSON responses of a company, first per URL."""
    found = json_candidates(admit_captures(captures, check_json=False))
    careers = F.col("careers_url")
    base = F.regexp_replace(careers, "/+$", "")
    url = F.when(F.col("raw_url").isNotNull(), url_join(careers, F.col("raw_url"))).when(
        F.col("raw_location").isNotNull(), F.concat(base, F.lit("#job-"), F.col("raw_id"))
    )
    home = root_domain(url_part(careers, "netloc"))

    def apart(x: Column) -> Column:
        """On the company's domain, and not the careers page itself."""
        p = x["p"]
        distinctive = (p["fragment"] != "") | _has_job_query(p["query"]) | p["query"].rlike(r"\d{4,}")
        same_domain = (p["netloc"] == "") | (root_domain(p["netloc"]) == home)
        return same_domain & (distinctive | (strip_locale(p["path"]) != _base_path()))

    fields = let(url, lambda u: F.struct(
        norm_text(F.col("raw_title")).alias("title"), u.alias("url"), url_parts(u).alias("p")
    ))
    rows = compute_once(
        found, fields, lambda x: x["url"].isNotNull() & real_title(x["title"]) & apart(x)
    )
    kept = rows.where(F.col("raw_location").isNull() | in_place(F.col("raw_location")))
    return once_per(
        listings(
            kept,
            seq=sequence(F.col("pos"), captures),
            title=F.col("title"),
            url=F.col("url"),
            location=F.col("raw_location"),
            department=F.col("raw_department"),
            external_id=F.col("raw_id"),
        ),
        "url",
    )


_STRONG_PATH = rf"(?:^|[/_-])(?:{'|'.join(vocab.STRONG_PATH_STEMS)})s?(?:[/_-]|$)"


def _posting_shape(p: Column) -> Column:
    """The URL looks like one posting and not like navigation or the careers page."""
    query = p["query"]

    def shaped(path: Column) -> Column:
        ids = F.concat(path, F.lit("?"), F.lower(query))
        strong = contains_path_part(path, vocab.STRONG_PATH_PARTS) | path.rlike(_STRONG_PATH)
        weak = contains_path_part(path, vocab.WEAK_PATH_PARTS)
        has_id = ids.rlike(r"\d{4,}") | ids.rlike("[0-9a-f]{16,}")
        navigation = contains_path_part(path, vocab.NAVIGATION_PATH_PARTS) | path.startswith("/search/")
        return ~navigation & (strong | _has_job_query(query) | (weak & has_id))

    distinctive = ~p["fragment"].isin("", "0") | _has_job_query(query) | query.rlike(r"\d{4,}")
    return (distinctive | (strip_locale(p["path"]) != _base_path())) & let(F.lower(p["path"]), shaped)


def _usable_title(href: Column, text: Column, context: Column) -> Column:
    """From the link text, else the text around it, else the URL slug; null when none is real."""

    def real(title: Column) -> Column:
        return let(title, lambda t: F.when(real_title(t), t))

    slug = slug_title(href)
    return F.coalesce(
        real(title_pick(text, slug)),
        F.when(context != "", real(title_pick(context, slug))),
        real(slug),
    )


def discover_links(links: DataFrame) -> DataFrame:
    """Links of a rendered page (``pos``, ``href``, ``text``, ``context``) that are postings."""
    href, home = F.col("href"), url_part(F.col("careers_url"), "netloc")
    named = links.where((href != "") & (F.col("text") != "")).withColumn(
        "context", F.coalesce("context", F.lit(""))
    )
    shaped = compute_once(
        named,
        F.struct(url_parts(href).alias("p")),
        lambda x: ((x["p"]["netloc"] == "") | (x["p"]["netloc"] == home)) & _posting_shape(x["p"]),
    )
    titled = compute_once(
        shaped,
        F.struct(_usable_title(href, F.col("text"), F.col("context")).alias("title")),
        lambda x: F.length(x["title"]) <= 120,
    )
    placed = in_place(F.col("p.path"), F.col("title"), F.col("context"))
    kept = titled.where((F.length("context") <= 40) | placed)
    return once_per(
        listings(kept, seq=sequence(F.col("pos"), links), title=F.col("title"), url=href), "url"
    )


def merge_by_key(json_jobs: DataFrame, link_jobs: DataFrame) -> DataFrame:
    """One row per canonical key: the first without a fragment, else the first; JSON before links."""
    both = json_jobs.withColumn("_part", F.lit(0)).unionByName(
        link_jobs.withColumn("_part", F.lit(1)), allowMissingColumns=True
    )
    keyed = both.withColumn("job_key", canonical_key(F.col("url")))
    order = [F.col("url").contains("#"), "_part", "seq"]
    return first_by(keyed, [*source_keys(keyed), "job_key"], order).drop("_part")
