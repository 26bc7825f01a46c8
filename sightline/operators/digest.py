"""Daily digest: two sections, their rows, text fragments and the subject line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import number_rows
from .listings import newest_first, recent, visible, with_company

# Wording and markup of the digest.
NEW_TODAY = "Nuevos hoy"
LAST_WEEK = "Últimos 7 días"
EMPTY_SECTION = "Sin novedades."
SECTION_HEAD = "<h3 style='margin:24px 0 4px;color:#374151'>"
EMPTY_TEXT = "<p style='color:#9ca3af;font-size:13px'>"
COMPANY_HEAD = "<h4 style='margin:14px 0 2px;color:#111827'>"
ROW_OPEN = "<p style='margin:4px 0 8px'>"
BADGE_OPEN = "<span style='background:#e5e7eb;border-radius:3px;padding:1px 5px;font-size:11px'>"
LINK_STYLE = "' style='color:#1d4ed8'>"
PLACE_OPEN = "<br><small style='color:#6b7280'>"

PART_SIZE = 100


def new_today(new_jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """New jobs whose URL was kept by any decision, whatever the company."""
    kept = decisions.where("keep").select("url").distinct()
    return new_jobs.join(kept, "url", "left_semi")


def last_days(state: DataFrame, companies: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Active, not dropped, first seen in the window, with company names, newest first."""
    return newest_first(with_company(recent(visible(state), as_of, days), companies))


def section_rows(today: DataFrame, week: DataFrame) -> DataFrame:
    """Rows of both sections, marked by section."""
    columns = ["company", "title", "url", "location", "department", "job_type", "first_seen_at"]
    return today.select(F.lit(NEW_TODAY).alias("section"), *columns).unionByName(
        week.select(F.lit(LAST_WEEK).alias("section"), *columns)
    )


def digest_rows(today: DataFrame, week: DataFrame) -> DataFrame:
    """Rows of both sections with their place in the digest.

    Companies go by lower-cased name, listings newest first. ``position`` counts inside the
    company, and position 1 carries the company heading. The numbering sorts over the cluster, so
    a company whose listings all arrived at once is no burden to one task.
    """
    rows = section_rows(today, week)
    numbered = number_rows(rows, ["section", "company"], [F.desc("first_seen_at"), "url"], "position")
    return numbered.withColumn("is_heading", F.col("position") == 1)


def in_digest_order(rows: DataFrame) -> DataFrame:
    section = F.when(F.col("section") == NEW_TODAY, 0).otherwise(1)
    return rows.orderBy(section, F.lower("company"), "company", "position")


def section_heads(rows: DataFrame) -> DataFrame:
    """Heading text of both sections, with the row count or the note that there is nothing."""
    counts = rows.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    both = F.when(F.col("id") == 0, NEW_TODAY).otherwise(LAST_WEEK)
    names = rows.sparkSession.range(2).select(both.alias("section"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    head = F.concat(F.lit(SECTION_HEAD), F.col("section"))
    return names.join(counts, "section", "left").select(
        "section", n.alias("n"),
        F.when(n == 0, F.concat(head, F.lit(f"</h3>{EMPTY_TEXT}{EMPTY_SECTION}</p>")))
        .otherwise(F.concat(head, F.lit(" &mdash; "), n.cast("string"), F.lit("</h3>")))
        .alias("html"),
    )


def row_html() -> Column:
    def optional(name: str, before: str, after: str) -> Column:
        c = F.col(name)
        return F.when(c != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")

    return F.concat(
        F.lit(ROW_OPEN),
        optional("job_type", BADGE_OPEN, "</span> "),
        F.lit("<a href='"), F.col("url"), F.lit(LINK_STYLE), F.col("title"), F.lit("</a>"),
        optional("department", " &middot; ", ""),
        optional("location", PLACE_OPEN, "</small>"),
        F.lit("</p>"),
    )


def digest_fragments(rows: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Markup per section, company and part of at most ``part_size`` rows.

    The parts in order make up a company's block; a company of any size never becomes one value.
    """
    part = F.floor((F.col("position") - 1) / part_size).cast("long")
    heading = F.when(
        F.col("is_heading"), F.concat(F.lit(COMPANY_HEAD), F.col("company"), F.lit("</h4>"))
    ).otherwise("")
    pieces = F.array_sort(F.collect_list(F.struct("position", F.concat(heading, row_html()).alias("html"))))
    return rows.withColumn("part_no", part).groupBy("section", "company", "part_no").agg(
        F.array_join(F.transform(pieces, lambda p: p["html"]), "").alias("html")
    )


def digest_subject(today: DataFrame, week: DataFrame, name: str = "Listings") -> DataFrame:
    """Subject line; no row when both sections are empty."""
    flags = today.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        week.select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    counts = flags.agg(F.sum("a").alias("n_today"), F.sum("b").alias("n_week"))
    a, b = F.col("n_today"), F.col("n_week")
    return counts.where((a > 0) | (b > 0)).select(
        a.cast("long").alias("n_today"), b.cast("long").alias("n_week"),
        F.when(
            a > 0,
            F.concat(F.lit(f"{name}: "), a.cast("string"), F.lit(" nuevo"), F.when(a == 1, "").otherwise("s"), F.lit(" hoy")),
        ).otherwise(
            F.concat(F.lit(f"{name}: 0 nuevos hoy · "), b.cast("string"), F.lit(" activos esta semana"))
        ).alias("subject"),
    )


def decision_report(new_jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every new job with its verdict; a job without a decision shows as dropped and missing."""
    d = decisions.select("company", "url", F.struct("keep", "reason", "is_real").alias("_d"))
    flag = F.coalesce(F.col("_d.keep"), F.lit(False))
    return new_jobs.join(d, ["company", "url"], "left").select(
        "company", "title", "url",
        F.when(flag, "[KEEP]").otherwise("[DROP]").alias("flag"),
        F.coalesce("_d.reason", F.lit("(missing)")).alias("reason"),
        F.when(F.coalesce(F.col("_d.is_real"), F.lit(False)), "real").otherwise("passthrough").alias("source"),
    )


def preview_sections(jobs: DataFrame, decisions: DataFrame, n: int = 20, k: int = 3) -> DataFrame:
    """Preview from the newest ``n`` active jobs: all kept ones, the first ``k`` also as new today."""
    sample = newest_first(jobs.where("is_active"), n)
    kept = newest_first(new_today(sample, decisions), n)
    head = kept.limit(k)
    return head.select(F.lit(NEW_TODAY).alias("section"), "company", "title", "url").unionByName(
        kept.select(F.lit(LAST_WEEK).alias("section"), "company", "title", "url")
    )
