"""The daily run: from the captures of a day to state, decisions, audit and digest, in one commit.

All tables of a day become visible together (see ``tables``): a run that dies leaves the last complete
day, and running the day again gives the day. Days run in order. What a day writes is read again for its
later steps, so nothing is parsed or scored twice.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .operators import decisions, digest, lifecycle
from .operators.listings import with_company
from .sources.captures import capture_failures, source_errors
from .sources.registry import parse_sources, parser_names

# Tables that grow by a part a day; of the others a day has its own.
HISTORY = ("decisions", "audit", "errors")


def day_errors(run_date: dt.date, captures: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """(run_date, company_id, error) of what could not be read: captured pages, and companies without a way to be read."""
    day = F.lit(run_date).cast("date").alias("run_date")
    found = capture_failures(captures).select(day, "company_id", "error")
    if companies is None:
        return found
    return found.unionByName(source_errors(companies, parser_names()).select(day, "company_id", "error"))


def decide_new(new: DataFrame, scorer: decisions.Scorer | None) -> DataFrame:
    """Decisions on the new listings in chunks; without a scorer all are kept, and none is real.

    ``seq`` orders decisions over companies and inside them, as the chunks were sent.
    """
    jobs = decisions.chunk_jobs(new.withColumnRenamed("seq", "found_at"), ["found_at", "url"])
    if scorer is None:
        decided = decisions.keep_all(jobs)
    else:
        answers = decisions.score_chunks(decisions.chunk_payload(jobs), scorer)
        decided = decisions.decide(jobs, decisions.parse_responses(answers))
    seq = F.struct("company", "job_no").alias("seq")
    rows = decided.select("run_date", "company_id", "company", "url", "title", seq, "keep", "reason", "is_real")
    return decisions.with_group_positions(rows)


def day_audit(run_date: dt.date, sightings: DataFrame, new: DataFrame, errors: DataFrame) -> DataFrame:
    """One row on the run: status, new listings, errors, and repeated URLs inside the snapshots."""
    day = F.lit(run_date).cast("date").alias("run_date")
    counted = ("new_jobs_found", "n_errors", "repeated_urls")

    def rows(df: DataFrame, name: str, n=None) -> DataFrame:
        return df.select(day, *((F.lit(1) if n is None else n).cast("long").alias(c) if c == name else F.lit(0).cast("long").alias(c) for c in counted))

    listed = sightings.groupBy("company_id", "url").agg((F.count(F.lit(1)) - 1).alias("again"))
    one = sightings.sparkSession.range(1)
    every = rows(one, "").unionByName(rows(new, "new_jobs_found")).unionByName(rows(errors, "n_errors"))
    every = every.unionByName(rows(listed, "repeated_urls", F.col("again")))
    sums = every.groupBy("run_date").agg(*(F.sum(c).alias(c) for c in counted))
    return sums.withColumn("status", F.when(F.col("n_errors") == 0, "completed").otherwise("failed"))


def run_day(
    root: str, run_date: dt.date, companies: DataFrame, captures: DataFrame, links: DataFrame | None = None, cards: DataFrame | None = None,
    scorer: decisions.Scorer | None = None, names: list[str] | None = None, checked: DataFrame | None = None, keep: int = 2,
) -> int:
    """Run a day over what was captured and commit it as the version that is returned.

    ``companies`` has ``company_id`` and ``name``; captures, links and cards carry their company's settings
    and ``parser``. ``names`` lists the parsers in use (see ``parse_sources``), ``checked`` the catalog whose
    companies are reported if they cannot be read at all.
    """
    spark = captures.sparkSession
    version, day = run_date.toordinal(), F.lit(run_date).cast("date")
    before = tables.newest(spark, root, before=version)[1]
    parts = [p for p in before if p.table in HISTORY]

    def stored(rows: DataFrame, table: str) -> DataFrame:
        part = tables.write_part(rows, root, table)
        parts.extend(part)
        return tables.read_parts(spark, part, table)

    errors = stored(day_errors(run_date, captures, checked), "errors")
    parsed = parse_sources(captures, links, cards, names)
    sightings = stored(lifecycle.successful(parsed.withColumn("run_date", day), errors), "sightings")
    old = tables.read_parts(spark, before, "state")
    known = sightings.limit(0) if old is None else old
    new = stored(with_company(lifecycle.new_urls(known, sightings), companies), "new")
    decided = stored(decide_new(new, scorer), "decisions")
    state = lifecycle.merge_runs(old, sightings)
    if old is None:
        state = state.withColumns({"ai_keep": F.lit(None).cast("boolean"), "ai_reason": F.lit(None).cast("string")})
    fresh = decisions.persisted(decided).select("url", F.struct("ai_keep", "ai_reason").alias("_fresh"))
    state = state.join(fresh, "url", "left")
    state = state.withColumns({c: F.when(F.col("_fresh").isNull(), F.col(c)).otherwise(F.col(f"_fresh.{c}")) for c in ("ai_keep", "ai_reason")}).drop("_fresh")
    state = stored(state, "state")
    stored(day_audit(run_date, sightings, new, errors), "audit")
    today = digest.new_today(new.withColumn("first_seen_at", day), decided)
    week = digest.last_days(state, companies, day.cast("timestamp"))
    stored(digest.digest_rows(today, week), "digest")
    tables.publish(spark, root, version, parts)
    tables.remove_old(spark, root, keep)
    return version


def day_tables(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last complete day, or of the given version, by name."""
    parts = tables.newest(spark, root)[1] if version is None else tables.parts_of(spark, root, version)
    return {t: tables.read_parts(spark, parts, t) for t in sorted({p.table for p in parts})}
