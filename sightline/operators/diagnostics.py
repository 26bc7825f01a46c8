"""Diagnostics of a collection run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_part
from .dedupe import top_by


def company_outcomes(tested: DataFrame, found: DataFrame, errors: DataFrame) -> DataFrame:
    """Per tested company: number of listings, or -1 and the error.

    ``tested`` holds company_id; ``found`` one row per listing; ``errors`` (company_id, error).
    """
    counts = found.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        tested.select("company_id").distinct()
        .join(errors.groupBy("company_id").agg(F.min("error").alias("error")), "company_id", "left")
        .join(counts, "company_id", "left")
        .select(
            "company_id", "error",
            F.when(F.col("error").isNotNull(), -1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_jobs"),
        )
    )


def diagnose_summary(outcomes: DataFrame) -> DataFrame:
    n = F.col("n_jobs")
    return outcomes.agg(
        F.count(F.lit(1)).alias("tested"),
        F.count_if(n >= 0).alias("ok"),
        F.count_if(n > 0).alias("with_jobs"),
        F.count_if(n < 0).alias("failed"),
        F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0)).alias("total_jobs"),
    )


def company_samples(outcomes: DataFrame, found: DataFrame, n: int = 3) -> DataFrame:
    """Outcome of each company with its first ``n`` listings (one row per sample)."""
    samples = top_by(found.select("company_id", "seq", "title", "url"), ["company_id"], ["seq"], n)
    shown = samples.select(
        "company_id", "position",
        F.substring("title", 1, 70).alias("title"), F.substring("url", 1, 80).alias("url"),
    )
    ok = outcomes.where("n_jobs > 0").join(shown, "company_id")
    rest = outcomes.where("n_jobs <= 0")
    return ok.unionByName(rest, allowMissingColumns=True)


def capture_profile(captures: DataFrame) -> DataFrame:
    """Per company: JSON responses and their total size."""
    json_body = F.lower("content_type").contains("json")
    return captures.groupBy("company_id").agg(
        F.count_if(json_body).alias("n_json"),
        F.coalesce(F.sum(F.when(json_body, F.length("body"))), F.lit(0)).alias("json_chars"),
    )


def real_links(links: DataFrame) -> DataFrame:
    """Links that lead somewhere (no script, no mail), with ``same_host``."""
    host = url_part(F.col("href"), "netloc")
    return links.where(
        (F.col("href") != "") & ~F.col("href").startswith("javascript:") & ~F.col("href").startswith("mailto:")
    ).withColumn("same_host", (host == "") | (host == url_part(F.col("careers_url"), "netloc")))


def link_profile(links: DataFrame, keys: list[str]) -> DataFrame:
    return real_links(links).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if("same_host").alias("n_same_host")
    )


def first_links(links: DataFrame, keys: list[str], n: int = 40) -> DataFrame:
    """The first ``n`` same-host links of every page, shortened for display."""
    top = top_by(real_links(links).where("same_host"), keys, ["pos"], n)
    return top.select(
        *keys, "position",
        F.substring(F.replace("text", F.lit("\n"), F.lit(" | ")), 1, 80).alias("text"),
        F.substring("href", 1, 120).alias("href"),
    )


def first_responses(captures: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` JSON responses of every company, with their sizes."""
    json_rows = captures.where(F.lower("content_type").contains("json"))
    top = top_by(json_rows, ["company_id"], ["page_idx", "request_url"], n)
    return top.select(
        "company_id", "position", F.length("body").cast("long").alias("n_chars"),
        F.substring("request_url", 1, 140).alias("request_url"),
    )
