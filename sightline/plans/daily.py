"""Queries on captured runs as a whole: failures, the daily run, stored captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle
from ..shared import new_path, written
from ..sources import sinks
from ..sources.captures import capture_failures
from ..sources.common import attach_companies
from ..sources.registry import parse_sources
from .fixtures import with_fixtures
from .portal_pages import as_json, linked, pages, postings, settings
from .portals import _check, _in
from .registry import query

_HOME = "https://x.example.com/"
_STATUS = "CASE WHEN (portal + page_idx) % 7 = 3 THEN 500 ELSE 200 END"
_BROKEN = "(portal + page_idx) % 11 = 4"
_DAY, _DAY_BEFORE = "2024-01-31", "2024-01-30"


def _captures(spark, sf_dir, rows: DataFrame, run_date: str, failing: bool = True) -> DataFrame:
    """Pages of postings as one run of a portal; if ``failing``, some have an error status, some a broken body."""
    item = F.struct(
        F.concat(F.lit("L"), "id").alias("id"), F.col("title").alias("text"), F.concat(F.lit("https://jobs.example.com/"), "id").alias("hostedUrl"),
        F.struct("location", "department", F.col("job_type").alias("commitment")).alias("categories"), F.col("description").alias("descriptionPlain"))
    made = pages(rows, item, as_json()).withColumn("portal", F.col("company_id").cast("long"))
    made = made.select(
        "company_id", "page_idx", F.lit("lever").alias("parser"), F.lit("run").alias("run_id"), F.lit(run_date).cast("date").alias("run_date"),
        F.expr(_STATUS if failing else "200").alias("status"),
        F.when(F.expr(_BROKEN if failing else "false"), "[broken").otherwise(F.col("body")).alias("body"),
        F.lit("https://x.example.com/api/jobs").alias("request_url"), F.lit("application/json").alias("content_type"),
        F.lit(f"{run_date} 06:00:00").cast("timestamp").alias("captured_at"))
    return attach_companies(made, settings(postings(spark, sf_dir), _HOME))


_PAGES = with_fixtures("postings") + f""",
made AS (SELECT DISTINCT portal, page_idx FROM postings),
failed AS (SELECT CAST(portal AS VARCHAR) AS company_id, CAST(page_idx AS BIGINT) AS page_idx,
  CASE WHEN {_STATUS} = 500 THEN 'status 500' WHEN {_BROKEN} THEN 'body is no JSON' END AS error FROM made)
"""


@query("capture_failures", _PAGES + "SELECT * FROM failed WHERE error IS NOT NULL")
def failures(spark, sf_dir):
    found = capture_failures(_captures(spark, sf_dir, postings(spark, sf_dir), _DAY))
    return found.select("company_id", "page_idx", "error")


_LEVER = _check(
    _in("location"), title="title", url="concat('https://jobs.example.com/', id)", location="nullif(location, '')", department="department",
    job_type="job_type", description="substr(description, 1, 500)", external_id="concat('L', id)")


@query("daily_run", f"""WITH listed AS ({_LEVER}),
u AS (SELECT company_id, url, CAST(split_part(url, '/', 4) AS BIGINT) AS id FROM listed),
bad AS (SELECT DISTINCT company_id FROM ({_PAGES.replace("made AS (SELECT DISTINCT portal, page_idx FROM postings)",
  "made AS (SELECT DISTINCT portal, page_idx FROM postings WHERE id % 7 <> 0)")} SELECT * FROM failed WHERE error IS NOT NULL)),
old AS (SELECT * FROM u WHERE id % 5 <> 0),
now AS (SELECT * FROM u WHERE id % 7 <> 0 AND company_id NOT IN (SELECT company_id FROM bad)),
seen AS (SELECT DISTINCT company_id FROM now),
both_ AS (SELECT company_id, url FROM old UNION SELECT company_id, url FROM now)
SELECT b.company_id, b.company_id IN (SELECT company_id FROM bad) AS failed,
  count(*) FILTER (n.url IS NOT NULL OR b.company_id NOT IN (SELECT company_id FROM seen)) AS n_active,
  count(*) FILTER (o.url IS NULL) AS n_new,
  count(*) FILTER (n.url IS NULL AND b.company_id IN (SELECT company_id FROM seen)) AS n_gone
FROM both_ b LEFT JOIN old o ON o.company_id = b.company_id AND o.url = b.url LEFT JOIN now n ON n.company_id = b.company_id AND n.url = b.url
GROUP BY b.company_id""")
def daily_run(spark, sf_dir):
    """Yesterday's state, today's captures: failures, parsing, folding, and the change per company.

    A company of which any page failed keeps its history as it was.
    """
    rows = postings(spark, sf_dir)
    before = rows.where("id % 5 <> 0")
    whole = _captures(spark, sf_dir, before, _DAY_BEFORE, failing=False)  # yesterday every page could be read
    # What is read again for later steps is stored: pages are rendered and parsed once.
    state = written(lifecycle.fold_history(written(parse_sources(whole, names=["lever"]), "sightings")), "state")
    captures = written(_captures(spark, sf_dir, rows.where("id % 7 <> 0"), _DAY), "captures")
    failed = written(capture_failures(captures).select("company_id", "run_date").distinct(), "failures")
    today = written(parse_sources(captures, names=["lever"]), "sightings")
    after = lifecycle.merge_runs(state, today, failed)
    day = F.lit(_DAY).cast("date")
    return after.join(failed.select("company_id", F.lit(True).alias("_failed")), "company_id", "left").groupBy("company_id").agg(
        F.coalesce(F.max("_failed"), F.lit(False)).alias("failed"), F.count_if("is_active").alias("n_active"),
        F.count_if(F.col("first_seen_at") == day).alias("n_new"), F.count_if(~F.col("is_active")).alias("n_gone"))


@query("parse_all", f"""SELECT company_id, url, title FROM ({_LEVER.replace("postings)", "postings WHERE " + f"{_STATUS} = 200 AND NOT ({_BROKEN}))", 1)})
UNION ALL SELECT CAST(portal AS VARCHAR), concat('https://x.example.com/job/', id), concat('Analyst number ', id) FROM ({with_fixtures("postings")} SELECT * FROM postings)
UNION ALL SELECT CAST(portal AS VARCHAR), 'https://x.example.com/', 'Madrid round' FROM ({with_fixtures("postings")} SELECT DISTINCT portal FROM postings) WHERE portal % 3 < 2""")
def parse_all(spark, sf_dir):
    """Bodies, rendered links of a discovered site, and cards in one job."""
    rows = postings(spark, sf_dir)
    captures = _captures(spark, sf_dir, rows, _DAY)
    n = F.col("id").cast("string")
    links = linked(spark, sf_dir, _HOME, href=F.concat(F.lit("https://x.example.com/job/"), n), text=F.concat(F.lit("Analyst number "), n), context=F.lit(""))
    cards = linked(spark, sf_dir, _HOME, title=F.lit("Madrid round"), status=F.lit(None).cast("string"), apply_href=F.lit(None).cast("string"))
    run = {"run_id": F.lit("run"), "run_date": F.lit(_DAY).cast("date")}
    found = parse_sources(
        captures, links.withColumns(run | {"parser": F.lit("discover")}), cards.withColumns(run | {"parser": F.lit("status_cards")}))
    return found.select("company_id", "url", "title")


@query("stored_captures", _PAGES + "SELECT company_id, page_idx, CAST('lever' AS VARCHAR) AS parser FROM failed")
def stored_captures(spark, sf_dir):
    """Captures written by parser and run, and read back."""
    root = f"{new_path(spark, 'captures')}"
    sinks.write_captures(_captures(spark, sf_dir, postings(spark, sf_dir), _DAY).drop("careers_url", "location_filter", "acciona_division", "job_selector", "places"), root)
    return sinks.read_captures(spark, root).select("company_id", "page_idx", "parser")
