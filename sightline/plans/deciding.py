"""Queries on keep/drop decisions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import decisions
from ..shared import written
from .fixtures import fixture, with_fixtures
from .registry import query

_CHUNKED = with_fixtures("docs", "verdicts") + """,
chunked AS (SELECT *, job_no - 1 - (job_no - 1) % 25 AS chunk_start, CAST((job_no - 1) // 25 AS BIGINT) AS chunk_no
  FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY doc_id) AS job_no FROM docs)),
broken AS (SELECT company, chunk_no, sum(doc_id) % 4 = 0 AS failed, sum(length(title)) AS tokens, count(*) AS n FROM chunked GROUP BY ALL)
"""


def _chunked(spark, sf_dir):
    bucket = F.floor(F.col("doc_id") / 1024)
    return decisions.chunk_jobs(fixture(spark, sf_dir, "docs"), ["doc_id"], bucket)


def _responses(spark, sf_dir, chunked):
    """Answers as a scorer would write them: labelled jobs only, the first one twice with the
    verdict turned round before it, an entry without a URL, entries that are no objects, verdicts as
    text and numbers, and cut-off text for some chunks."""
    verdicts = fixture(spark, sf_dir, "verdicts").select("url", "keep", "reason")
    jobs = chunked.join(verdicts, "url", "left")
    kind = F.col("doc_id") % 3

    def entry(n: int, url: Column, keep: Column, reason: Column) -> Column:
        spelled = F.when(keep, F.when(kind == 1, '"true"').when(kind == 2, "1").otherwise("true")).otherwise(
            F.when(kind == 1, "0").when(kind == 2, '""').otherwise("false"))
        text = F.concat(F.lit('{"url":'), F.coalesce(F.concat(F.lit('"'), url, F.lit('"')), F.lit("null")), F.lit(',"keep":'), spelled,
                        F.lit(',"reason":"'), reason, F.lit('"}'))
        return F.struct("doc_id", F.lit(n).alias("n"), text.alias("d"))

    stray = [F.struct("doc_id", F.lit(3 + i).alias("n"), F.lit(x).alias("d")) for i, x in enumerate(('"stray"', "7", "null", "[]"))]
    entries = F.when(
        F.col("keep").isNotNull(),
        F.array(
            entry(0, F.col("url"), ~F.col("keep"), F.lit("first try")), entry(1, F.col("url"), F.col("keep"), F.col("reason")),
            entry(2, F.lit(None).cast("string"), F.col("keep"), F.col("reason")), *stray),
    ).otherwise(F.array())
    answers = F.array_sort(F.flatten(F.collect_list(entries)))
    text = F.concat(F.lit('{"decisions": ['), F.array_join(F.transform(answers, lambda a: a["d"]), ", "), F.lit("]}"))
    return jobs.groupBy("company", "chunk_no").agg(
        F.when(F.sum("doc_id") % 4 == 0, F.lit('{"decisions": [{"url": ')).otherwise(text).alias("response"),
        F.sum(F.length("title")).alias("input_tokens"),
        F.count(F.lit(1)).alias("output_tokens"),
        (F.count(F.lit(1)) * 1000).alias("duration_ms"),
    )


def _decided(spark, sf_dir):
    """Chunks as the run wrote them, and their answers."""
    chunked = written(_chunked(spark, sf_dir).select("company", "url", "title", "doc_id", "job_no", "chunk_no"), "chunked")
    return chunked, decisions.parse_responses(_responses(spark, sf_dir, chunked))


_DECIDED = _CHUNKED + """,
decided AS (SELECT c.company, c.chunk_no, c.url, b.failed,
    CASE WHEN b.failed OR v.url IS NULL THEN true ELSE v.keep END AS keep,
    CASE WHEN b.failed THEN 'chunk_failed' WHEN v.url IS NULL THEN 'missing_from_model_output' ELSE v.reason END AS reason,
    NOT b.failed AND v.url IS NOT NULL AS is_real
  FROM chunked c JOIN broken b ON b.company = c.company AND b.chunk_no = c.chunk_no
  LEFT JOIN verdicts v ON v.url = c.url)
"""


@query("chunks_of_25", _CHUNKED + "SELECT company, url, job_no, chunk_no FROM chunked")
def chunks_of_25(spark, sf_dir):
    return _chunked(spark, sf_dir).select("company", "url", "job_no", "chunk_no")


@query("chunk_payload", _CHUNKED + """
SELECT company, chunk_no, count(*) AS n_jobs, count(*) AS n_items, string_agg(url, ' ' ORDER BY job_no) AS urls,
  string_agg(coalesce(location, ''), '|' ORDER BY job_no) AS locations, string_agg(title, chr(10) ORDER BY job_no) AS titles
FROM chunked GROUP BY ALL""")
def chunk_payload(spark, sf_dir):
    made = decisions.chunk_payload(_chunked(spark, sf_dir))
    schema = "array<struct<company: string, title: string, url: string, location: string, department: string>>"
    items = F.from_json("payload", schema)
    return made.select(
        "company", "chunk_no", "n_jobs", F.size(items).alias("n_items"),
        F.array_join(F.transform(items, lambda i: i["url"]), " ").alias("urls"),
        F.array_join(F.transform(items, lambda i: i["location"]), "|").alias("locations"),
        F.array_join(F.transform(items, lambda i: i["title"]), "\n").alias("titles"),
    )


@query("response_parse", _CHUNKED + """
SELECT c.company, c.chunk_no, v.url, v.keep, v.reason FROM chunked c JOIN verdicts v ON v.url = c.url
JOIN broken b ON b.company = c.company AND b.chunk_no = c.chunk_no WHERE NOT b.failed""")
def response_parse(spark, sf_dir):
    return decisions.response_decisions(_decided(spark, sf_dir)[1])


@query("decisions_aligned", with_fixtures("docs", "verdicts") + """
SELECT d.company, d.url, coalesce(v.keep, true) AS keep, coalesce(v.reason, 'missing_from_model_output') AS reason, v.url IS NOT NULL AS is_real
FROM docs d LEFT JOIN verdicts v ON v.url = d.url""")
def decisions_aligned(spark, sf_dir):
    jobs = fixture(spark, sf_dir, "docs").select("company", "url")
    return decisions.align(jobs, fixture(spark, sf_dir, "verdicts"), ["url"])


@query("chunk_failover", _DECIDED + "SELECT company, chunk_no, url, keep, reason, is_real FROM decided")
def chunk_failover(spark, sf_dir):
    return decisions.decide(*_decided(spark, sf_dir)).select("company", "chunk_no", "url", "keep", "reason", "is_real")


_CHUNK_STATS = _DECIDED + """,
stats AS (SELECT d.company, d.chunk_no, count(*) AS n_jobs, count(*) FILTER (d.keep) AS n_kept, count(*) FILTER (d.is_real) AS n_real, any_value(d.failed) AS failed,
    CAST(CASE WHEN any_value(d.failed) THEN 0 ELSE any_value(b.tokens) END AS BIGINT) AS input_tokens,
    CASE WHEN any_value(d.failed) THEN 0 ELSE any_value(b.n) END AS output_tokens,
    CASE WHEN any_value(d.failed) THEN 0 ELSE any_value(b.n) * 1000 END AS duration_ms
  FROM decided d JOIN broken b ON b.company = d.company AND b.chunk_no = d.chunk_no GROUP BY d.company, d.chunk_no)
"""


@query("chunk_stats", _CHUNK_STATS + "SELECT * FROM stats")
def chunk_stats(spark, sf_dir):
    return decisions.chunk_stats(decisions.decide_with_usage(*_decided(spark, sf_dir)))


@query("decision_stats", _CHUNK_STATS + """
SELECT CAST(sum(n_jobs) AS BIGINT) AS total, CAST(sum(n_kept) AS BIGINT) AS kept, count(*) AS chunks, count(*) FILTER (failed) AS failed_chunks,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
  (SELECT count(*) FILTER (is_real) FROM decided) AS real_decisions FROM stats""")
def decision_stats(spark, sf_dir):
    return decisions.run_stats(decisions.decide_with_usage(*_decided(spark, sf_dir)))


@query("no_criteria", with_fixtures("docs") + "SELECT company, url, true AS keep, 'preferences_missing' AS reason, false AS is_real FROM docs")
def no_criteria(spark, sf_dir):
    return decisions.keep_all(fixture(spark, sf_dir, "docs").select("company", "url"))


_LOG = with_fixtures("decision_log")


@query("decision_groups", _LOG + """
SELECT keep, reason, count(*) AS n_urls, min(seq) AS first_seq FROM decision_log WHERE is_real GROUP BY ALL""")
def decision_groups(spark, sf_dir):
    return decisions.decision_groups(fixture(spark, sf_dir, "decision_log"))


@query("decision_group_urls", _LOG + "SELECT keep, reason, url FROM decision_log WHERE is_real")
def decision_group_urls(spark, sf_dir):
    return decisions.group_members(fixture(spark, sf_dir, "decision_log"))


@query("state_with_decisions", with_fixtures("decision_log", "docs") + """,
grouped AS (SELECT *, min(seq) OVER (PARTITION BY run_date, keep, reason) AS group_seq FROM decision_log WHERE is_real),
final AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY run_date DESC, group_seq DESC) AS rn FROM grouped)
SELECT d.company, d.url, f.keep AS ai_keep, f.reason AS ai_reason FROM docs d LEFT JOIN final f ON f.url = d.url AND f.rn = 1""")
def state_with_decisions(spark, sf_dir):
    stored = written(decisions.with_group_positions(fixture(spark, sf_dir, "decision_log")), "decisions")
    final = decisions.persisted(stored)
    return decisions.with_decisions(fixture(spark, sf_dir, "docs").select("company", "url"), final)


PART_CRITERIA = decisions.Criteria(
    in_scope_firms=["brand 7", "brand 21"],
    drop=["ring", "rod", "promo"],
    senior=["large", "economy"],
    junior=["small", "red"],
    strong=["gear", "plate"],
    uncertain=["blue", "standard"],
)

_HIT = "list_filter({words}, lambda w: contains({text}, concat(' ', w, ' ')))[1]"


def _criteria_sql() -> str:
    c = PART_CRITERIA
    hits = ", ".join(
        _HIT.format(words=getattr(c, name), text="t") + f" AS {name}_hit"
        for name in ("drop", "senior", "junior", "strong", "uncertain")
    )
    return f"""
WITH texts AS (SELECT p_partkey AS id, concat(' ', lower(p_name), ' ', lower(p_type), ' ') AS t, concat(' ', replace(lower(p_brand), '#', ' '), ' ') AS f FROM part),
hits AS (SELECT id, {hits}, {_HIT.format(words=c.in_scope_firms, text="f")} AS firm FROM texts)
SELECT id, NOT ((drop_hit IS NOT NULL AND firm IS NULL) OR (senior_hit IS NOT NULL AND junior_hit IS NULL)) AS keep,
  CASE WHEN drop_hit IS NOT NULL AND firm IS NULL THEN 'drop: ' || drop_hit
       WHEN senior_hit IS NOT NULL AND junior_hit IS NULL THEN 'senior: ' || senior_hit
       ELSE coalesce('strong: ' || strong_hit, 'uncertain: ' || uncertain_hit, 'default') END AS reason
FROM hits"""


@query("criteria_score", _criteria_sql())
def criteria_score(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.col("p_type").alias("department"), F.col("p_brand").alias("company"),
    )
    return decisions.criteria_score(parts, PART_CRITERIA).select("id", "keep", "reason")


def even_titles(payload: str):
    """A scorer for trials: keeps titles of even length and fails on a chunk it does not like."""
    jobs = json.loads(payload)
    if len(jobs[0]["title"]) % 5 == 0:
        raise RuntimeError("no answer")
    verdicts = [
        {"url": j["url"], "keep": len(j["title"]) % 2 == 0, "reason": j["department"]} for j in jobs
    ]
    return json.dumps({"decisions": verdicts}), len(jobs), len(verdicts), 1


@query("scored_chunks", _CHUNKED + """,
dead AS (SELECT company, chunk_no FROM chunked WHERE (job_no - 1) % 25 = 0 AND length(title) % 5 = 0)
SELECT c.company, c.chunk_no, c.url, d.company IS NOT NULL OR length(c.title) % 2 = 0 AS keep,
  CASE WHEN d.company IS NOT NULL THEN 'chunk_failed' ELSE c.department END AS reason, d.company IS NULL AS is_real
FROM chunked c LEFT JOIN dead d ON d.company = c.company AND d.chunk_no = c.chunk_no""")
def scored_chunks(spark, sf_dir):
    chunked = _chunked(spark, sf_dir)
    answers = decisions.score_chunks(decisions.chunk_payload(chunked), even_titles)
    decided = decisions.decide(chunked, decisions.parse_responses(answers))
    return decided.select("company", "chunk_no", "url", "keep", "reason", "is_real")
