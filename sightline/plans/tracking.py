"""Queries over runs: state, what is new, what is gone, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..operators import diagnostics, lifecycle, listings
from ..shared import new_path
from ..streaming import replay
from .fixtures import FIXTURES, LAST_RUN, fixture, with_fixtures
from .registry import query

_GOOD = with_fixtures("sightings", "failures") + """,
good AS (SELECT s.* FROM sightings s WHERE NOT EXISTS (
    SELECT 1 FROM failures f WHERE f.company_id = s.company_id AND f.run_date = s.run_date)),
spans AS (SELECT company_id, url, min(run_date) AS first_run, max(run_date) AS last_run FROM good GROUP BY ALL),
newest AS (SELECT *, row_number() OVER (PARTITION BY company_id, url ORDER BY run_date DESC, seq) AS rn FROM good),
last_runs AS (SELECT company_id, max(run_date) AS company_run FROM good GROUP BY ALL),
state AS (SELECT s.company_id, s.url, n.title, n.location, n.department, n.job_type, n.seq,
    CAST(s.first_run AS VARCHAR) AS first_seen_at, CAST(s.last_run AS VARCHAR) AS last_seen_at,
    s.last_run = l.company_run AS is_active
  FROM spans s JOIN newest n ON n.company_id = s.company_id AND n.url = s.url AND n.rn = 1
  JOIN last_runs l ON l.company_id = s.company_id)
"""


def state_of(spark, sf_dir):
    return lifecycle.fold_history(fixture(spark, sf_dir, "sightings"), fixture(spark, sf_dir, "failures"))


# An early run, when many listings are still new.
EARLY_RUN = "2024-01-04"


def _split(spark, sf_dir, run=LAST_RUN):
    """Good sightings before a run, and of that run."""
    good = lifecycle.successful(fixture(spark, sf_dir, "sightings"), fixture(spark, sf_dir, "failures"))
    day = F.lit(run).cast("date")
    return good.where(F.col("run_date") < day), good.where(F.col("run_date") == day)


@query("job_state", _GOOD + "SELECT * FROM state")
def job_state(spark, sf_dir):
    return state_of(spark, sf_dir)


@query("state_upserted", _GOOD + "SELECT * FROM state")
def state_upserted(spark, sf_dir):
    before, today = _split(spark, sf_dir)
    return lifecycle.upsert_run(lifecycle.fold_history(before), today, F.lit(LAST_RUN).cast("date"))


@query("state_merged", _GOOD + "SELECT * FROM state")
def state_merged(spark, sf_dir):
    before, today = _split(spark, sf_dir)
    return lifecycle.merge_runs(lifecycle.fold_history(today), before)


@query("new_per_run", _GOOD + "SELECT first_seen_at AS run_date, count(*) AS new_jobs_found FROM state GROUP BY ALL")
def new_per_run(spark, sf_dir):
    return lifecycle.new_per_run(state_of(spark, sf_dir))


_NEW = f"""SELECT company_id, url, title, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id, url ORDER BY seq) AS nth FROM good WHERE run_date = DATE '{EARLY_RUN}') n
  WHERE nth = 1 AND NOT EXISTS (
    SELECT 1 FROM good g WHERE g.company_id = n.company_id AND g.url = n.url AND g.run_date < DATE '{EARLY_RUN}')"""


def _new(spark, sf_dir):
    before, today = _split(spark, sf_dir, EARLY_RUN)
    return lifecycle.new_urls(lifecycle.fold_history(before), today)


@query("new_urls", _GOOD + _NEW)
def new_urls(spark, sf_dir):
    return _new(spark, sf_dir).select("company_id", "url", "title", "seq")


@query("stale_urls", _GOOD + f"""
SELECT DISTINCT g.company_id, g.url FROM good g WHERE g.run_date < DATE '{EARLY_RUN}'
  AND g.company_id IN (SELECT company_id FROM good WHERE run_date = DATE '{EARLY_RUN}')
  AND (g.company_id, g.url) NOT IN (SELECT (company_id, url) FROM good WHERE run_date = DATE '{EARLY_RUN}')""")
def stale_urls(spark, sf_dir):
    before, today = _split(spark, sf_dir, EARLY_RUN)
    return lifecycle.stale_urls(lifecycle.fold_history(before), today).select("company_id", "url")


@query("scoring_delta", _GOOD + f""", names AS ({with_fixtures("companies")[5:]} SELECT * FROM companies)
SELECT coalesce(c.name, 'Unknown') AS company, n.url, n.title FROM ({_NEW}) n LEFT JOIN names c ON c.company_id = n.company_id"""
       .replace("names AS (companies AS", "names AS (WITH companies AS"))
def scoring_delta(spark, sf_dir):
    new = listings.with_company(_new(spark, sf_dir), fixture(spark, sf_dir, "companies"))
    return new.select("company", "url", "title")


@query("companies_first_seen", with_fixtures("sightings", "catalog") + """
SELECT name, careers_url, ats, CAST(run_date AS VARCHAR) AS created_at FROM (
  SELECT c.name, concat(c.careers_url, '&run=', CAST(s.run_date AS VARCHAR)) AS careers_url, c.ats, s.run_date,
         row_number() OVER (PARTITION BY c.name ORDER BY s.run_date) AS rn
  FROM sightings s JOIN catalog c ON c.company_id = s.company_id) WHERE rn = 1""")
def companies_first_seen(spark, sf_dir):
    runs = fixture(spark, sf_dir, "sightings").select("company_id", "run_date").distinct()
    sighted = runs.join(fixture(spark, sf_dir, "catalog"), "company_id").select(
        "name", "ats", "run_date",
        F.concat(F.coalesce("careers_url", F.lit("")), F.lit("&run="), F.col("run_date").cast("string")).alias("careers_url"),
    )
    return lifecycle.companies_first_seen(sighted)


@query("run_audit", _GOOD + """
, repeats AS (SELECT run_date, sum(n - 1) AS r FROM (
    SELECT run_date, company_id, url, count(*) AS n FROM good GROUP BY ALL) GROUP BY ALL)
SELECT CAST(r.run_date AS VARCHAR) AS run_date, coalesce(n.n, 0) AS new_jobs_found, coalesce(e.n, 0) AS n_errors,
       CAST(coalesce(p.r, 0) AS BIGINT) AS repeated_urls, CASE WHEN coalesce(e.n, 0) = 0 THEN 'completed' ELSE 'failed' END AS status
FROM (SELECT DISTINCT run_date FROM sightings) r
LEFT JOIN (SELECT first_seen_at, count(*) AS n FROM state GROUP BY ALL) n ON n.first_seen_at = CAST(r.run_date AS VARCHAR)
LEFT JOIN (SELECT run_date, count(*) AS n FROM failures GROUP BY ALL) e ON e.run_date = r.run_date
LEFT JOIN repeats p ON p.run_date = r.run_date""")
def run_audit(spark, sf_dir):
    sightings, failures = fixture(spark, sf_dir, "sightings"), fixture(spark, sf_dir, "failures")
    return lifecycle.run_audit(sightings, sightings, failures)


@query("run_errors", with_fixtures("failures", "companies") + """
SELECT CAST(f.run_date AS VARCHAR) AS run_date, coalesce(c.name, 'Unknown') AS company, f.error
FROM failures f LEFT JOIN companies c ON c.company_id = f.company_id""")
def run_errors(spark, sf_dir):
    return lifecycle.run_errors(fixture(spark, sf_dir, "failures"), fixture(spark, sf_dir, "companies"))


@query("jobs_with_company", _GOOD.replace("WITH ", with_fixtures("companies") + ",\n", 1) + """
SELECT s.company_id, s.url, coalesce(c.name, 'Unknown') AS company FROM state s LEFT JOIN companies c ON c.company_id = s.company_id""")
def jobs_with_company(spark, sf_dir):
    state = listings.with_company(state_of(spark, sf_dir), fixture(spark, sf_dir, "companies"))
    return state.select("company_id", "url", "company")


@query("active_per_company", _GOOD.replace("WITH ", with_fixtures("companies") + ",\n", 1) + """
SELECT coalesce(c.name, 'Unknown') AS company, count(*) AS n_listings
FROM state s LEFT JOIN companies c ON c.company_id = s.company_id WHERE s.is_active GROUP BY ALL""")
def active_per_company(spark, sf_dir):
    state = state_of(spark, sf_dir).withColumn("ai_keep", F.lit(None).cast("boolean"))
    named = listings.with_company(listings.visible(state), fixture(spark, sf_dir, "companies"))
    return listings.count_by_company(named)


_OUTCOMES = with_fixtures("sightings", "failures") + f""",
tested AS (SELECT DISTINCT company_id FROM sightings),
found AS (SELECT s.* FROM sightings s WHERE run_date = DATE '{LAST_RUN}'),
bad AS (SELECT company_id, min(error) AS error FROM failures WHERE run_date = DATE '{LAST_RUN}' GROUP BY ALL),
outcomes AS (SELECT t.company_id, b.error,
    CASE WHEN b.error IS NOT NULL THEN -1 ELSE (SELECT count(*) FROM found f WHERE f.company_id = t.company_id) END AS n_jobs
  FROM tested t LEFT JOIN bad b ON b.company_id = t.company_id)
"""


def _outcomes(spark, sf_dir):
    sightings = fixture(spark, sf_dir, "sightings")
    last = F.col("run_date") == F.lit(LAST_RUN).cast("date")
    found = sightings.where(last)
    errors = fixture(spark, sf_dir, "failures").where(last)
    return diagnostics.company_outcomes(sightings, found, errors), found


@query("diagnose_summary", _OUTCOMES + """SELECT count(*) AS tested, count(*) FILTER (n_jobs >= 0) AS ok,
  count(*) FILTER (n_jobs > 0) AS with_jobs, count(*) FILTER (n_jobs < 0) AS failed,
  CAST(coalesce(sum(n_jobs) FILTER (n_jobs > 0), 0) AS BIGINT) AS total_jobs FROM outcomes""")
def diagnose_summary(spark, sf_dir):
    return diagnostics.diagnose_summary(_outcomes(spark, sf_dir)[0])


@query("diagnose_companies", _OUTCOMES + """, shown AS (SELECT * FROM (
    SELECT company_id, title, url, row_number() OVER (PARTITION BY company_id ORDER BY seq) AS position FROM found) WHERE position <= 3)
SELECT o.company_id, o.error, CAST(o.n_jobs AS BIGINT) AS n_jobs, coalesce(s.position, 0) AS position, substr(s.title, 1, 70) AS title, substr(s.url, 1, 80) AS url
FROM outcomes o LEFT JOIN shown s ON s.company_id = o.company_id AND o.n_jobs > 0""")
def diagnose_companies(spark, sf_dir):
    return diagnostics.company_samples(*_outcomes(spark, sf_dir)).na.fill(0, ["position"])


@query("diagnose_by_name", with_fixtures("catalog") + "SELECT company_id, name, ats FROM catalog WHERE contains(lower(name), '#00000001')")
def diagnose_by_name(spark, sf_dir):
    return listings.by_name(fixture(spark, sf_dir, "catalog"), "#00000001").select("company_id", "name", "ats")


@query("state_streamed", _GOOD + "SELECT * FROM state")
def state_streamed(spark, sf_dir):
    """The events as a stream of four files, which split runs; the state equals the batch fold."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    root = f"{new_path(spark, 'state')}"
    events.repartition(4, "event_id").write.parquet(f"{root}/events")

    def read(batch):
        made = {n: batch.sparkSession.sql(FIXTURES[n], events=batch) for n in ("sightings", "failures")}
        return made["sightings"], made["failures"]

    stream = replay.read_files(spark, f"{root}/events", events.schema, files_per_batch=1)
    replay.track(stream, read, f"{root}/state", f"{root}/progress", buckets=8).awaitTermination()
    return replay.read_state(spark, f"{root}/state")


@query("repeats_streamed", with_fixtures("sightings") + "SELECT company_id, url, CAST(run_date AS VARCHAR) AS run_date, CAST(1 AS BIGINT) AS n_stored FROM sightings GROUP BY ALL")
def repeats_streamed(spark, sf_dir):
    """Sightings in three batches, of which the second repeats a part of the first and the third all."""
    rows = fixture(spark, sf_dir, "sightings")
    root = f"{new_path(spark, 'repeats')}"
    third = F.pmod(F.xxhash64("seq"), F.lit(3))
    for part in (rows.where(third < 2), rows.where(third > 0), rows):
        part.write.mode("append").parquet(f"{root}/in")  # in as many files as it is read in, all one batch
        stream = replay.drop_repeats(replay.read_files(spark, f"{root}/in", rows.schema))
        replay.track(stream, lambda batch: (batch, None), f"{root}/state", f"{root}/progress", buckets=8).awaitTermination()
    stored = tables.read_table(spark, f"{root}/state", "sightings")
    return stored.groupBy("company_id", "url", "run_date").agg(F.count(F.lit(1)).alias("n_stored"))
