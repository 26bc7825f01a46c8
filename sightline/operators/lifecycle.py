"""Listings over runs: what is new, what is gone, and the state table.

Sightings carry ``run_date``, ``company_id``, ``seq``, ``url`` and the listing fields. A failed
company-run, and a run that saw nothing, leave a company's history as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LISTING_FIELDS
from .dedupe import first_by


def _fields(df: DataFrame) -> list[str]:
    return [n for n in LISTING_FIELDS if n in df.columns and n != "url"]


def successful(sightings: DataFrame, failed: DataFrame | None) -> DataFrame:
    """Sightings of company-runs that did not fail."""
    if failed is None:
        return sightings
    return sightings.join(failed.select("company_id", "run_date").distinct(), ["company_id", "run_date"], "left_anti")


def _as_state(sightings: DataFrame) -> DataFrame:
    return sightings.select(
        "company_id", "url", "seq", *_fields(sightings),
        F.col("run_date").alias("first_seen_at"), F.col("run_date").alias("last_seen_at"),
    )


def _fold(rows: DataFrame) -> DataFrame:
    """One row per (company, url) from rows that each span first to last seen.

    The newest run's fields win as one struct, so a null there overwrites; inside a run the first
    row by ``seq`` wins. The aggregate combines before the shuffle, so copies of a hot listing
    travel as one row per task. Minimum and maximum do not care in which order runs arrive.
    """
    fields = [*_fields(rows), "seq"]
    newest = F.max_by(F.struct(*fields), F.struct(F.col("last_seen_at"), -F.col("seq")))
    folded = rows.groupBy("company_id", "url").agg(
        newest.alias("f"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )
    return folded.select(
        "company_id", "url", *[F.col(f"f.{n}").alias(n) for n in fields],
        "first_seen_at", "last_seen_at",
    )


def _with_active(rows: DataFrame) -> DataFrame:
    """Fold, and mark what was seen in the company's newest run as active.

    The newest run per company is one row per company from two narrow columns of the same rows; a
    window would have to hold a whole company in one task.
    """
    newest = rows.groupBy("company_id").agg(F.max("last_seen_at").alias("_company_last"))
    return _fold(rows).join(newest, "company_id").withColumn(
        "is_active", F.col("last_seen_at") == F.col("_company_last")
    ).drop("_company_last")


def fold_history(sightings: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """State after all runs, without going run by run."""
    return _with_active(_as_state(successful(sightings, failed)))


def merge_runs(state: DataFrame | None, sightings: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """State after further runs, in any order: old rows and new sightings fold together.

    Whatever else the state holds, such as decisions, stays with its row.
    """
    rows = _as_state(successful(sightings, failed))
    if state is None:
        return _with_active(rows)
    more = [c for c in state.columns if c not in {*rows.columns, "is_active"}]
    now = _with_active(state.select(*rows.columns).unionByName(rows))
    if not more:
        return now
    return now.join(state.select("company_id", "url", *more), ["company_id", "url"], "left")


def settled(base: DataFrame | None, sightings: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Runs that are final as one row per listing, from its first to its last sighting."""
    rows = _as_state(successful(sightings, failed))
    return _fold(rows if base is None else base.select(*rows.columns).unionByName(rows))


def snapshot(sightings: DataFrame) -> DataFrame:
    """One run's rows, the first per (company, url)."""
    return first_by(sightings, ["company_id", "url"], ["seq"])


def new_urls(history: DataFrame, today: DataFrame) -> DataFrame:
    """Listings of today that the company's history does not hold; a returning URL is not new."""
    seen = history.select("company_id", "url")
    return snapshot(today).join(seen, ["company_id", "url"], "left_anti")


def stale_urls(history: DataFrame, today: DataFrame) -> DataFrame:
    """History rows absent from today's non-empty snapshot of the same company."""
    scraped = today.select("company_id").distinct()
    return history.join(scraped, "company_id", "left_semi").join(
        today.select("company_id", "url"), ["company_id", "url"], "left_anti"
    )


def upsert_run(state: DataFrame, today: DataFrame, run_date: Column) -> DataFrame:
    """State after one run as a single full outer join.

    Listed rows take today's fields and become active; rows of a scraped company that are absent
    become inactive; rows of other companies, first-seen dates and decisions stay.
    """
    fields = _fields(today)
    now = snapshot(today).select(
        "company_id", "url", F.struct(*fields, "seq").alias("_now")
    )
    scraped = today.select("company_id").distinct().withColumn("_scraped", F.lit(True))
    both = state.join(now, ["company_id", "url"], "full_outer").join(scraped, "company_id", "left")
    listed = F.col("_now").isNotNull()
    kept = [c for c in state.columns if c not in {"company_id", "url", "seq", *fields,
                                                  "first_seen_at", "last_seen_at", "is_active"}]
    return both.select(
        "company_id", "url",
        *[F.when(listed, F.col(f"_now.{n}")).otherwise(F.col(n)).alias(n) for n in [*fields, "seq"]],
        F.coalesce("first_seen_at", run_date).alias("first_seen_at"),
        F.when(listed, run_date).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(listed, True).when(F.col("_scraped"), False).otherwise(F.col("is_active")).alias("is_active"),
        *kept,
    )


def new_per_run(state: DataFrame) -> DataFrame:
    """How many listings each run saw for the first time."""
    return state.groupBy(F.col("first_seen_at").alias("run_date")).agg(
        F.count(F.lit(1)).alias("new_jobs_found")
    )


def companies_first_seen(sighted: DataFrame) -> DataFrame:
    """Companies get-or-create by name: the settings of the first run stay."""
    return (
        sighted.groupBy("name")
        .agg(F.min_by(F.struct("careers_url", "ats", "run_date"), "run_date").alias("c"))
        .select("name", "c.careers_url", "c.ats", F.col("c.run_date").alias("created_at"))
    )


def run_audit(runs: DataFrame, sightings: DataFrame, errors: DataFrame, unfinished: DataFrame | None = None) -> DataFrame:
    """One row per run: status, new listings, errors, and repeated URLs inside the snapshots.

    ``errors`` holds (run_date, company_id, error). The error texts stay rows (``run_errors``), so
    a run with very many failures is never one value. A run in ``unfinished`` stays ``running``.
    """
    # One row per run and listing serves both the repeats and the first sightings.
    listed = successful(sightings, errors).groupBy("company_id", "url", "run_date").agg(
        F.count(F.lit(1)).alias("n")
    )
    repeats = listed.groupBy("run_date").agg(F.sum(F.col("n") - 1).alias("repeated_urls"))
    first = listed.groupBy("company_id", "url").agg(F.min("run_date").alias("first_seen_at"))
    failures = errors.groupBy("run_date").agg(F.count(F.lit(1)).alias("n_errors"))
    audit = (
        runs.select("run_date").distinct()
        .join(new_per_run(first), "run_date", "left")
        .join(failures, "run_date", "left")
        .join(repeats, "run_date", "left")
        .na.fill(0, ["new_jobs_found", "n_errors", "repeated_urls"])
        .withColumn("status", F.when(F.col("n_errors") == 0, "completed").otherwise("failed"))
    )
    if unfinished is None:
        return audit
    open_runs = unfinished.select("run_date").distinct().withColumn("_open", F.lit(True))
    return audit.join(open_runs, "run_date", "left").withColumn(
        "status", F.when(F.col("_open"), "running").otherwise(F.col("status"))
    ).drop("_open")


def run_errors(errors: DataFrame, companies: DataFrame) -> DataFrame:
    """Error list of every run, by company name."""
    names = companies.select("company_id", F.col("name").alias("company"))
    return errors.join(names, "company_id", "left").select(
        "run_date", F.coalesce("company", F.lit("Unknown")).alias("company"), "error"
    )
