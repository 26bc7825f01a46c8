"""Keep/drop decisions: chunks, the scorer socket, alignment, persistence, criteria."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_null, strings
from .dedupe import number_rows

CHUNK_SIZE = 25
REASON_LIMIT = 500


def chunk_jobs(jobs: DataFrame, order: list, bucket: Column | None = None, size: int = CHUNK_SIZE) -> DataFrame:
    """Number jobs per company in input order and cut them in chunks of ``size``.

    A numbering over all companies would be one task; chunk membership only shows when a chunk
    fails, so numbering per company is the same thing to a reader. ``bucket`` cuts large companies
    where ``order`` is a unique id (see ``number_rows``).
    """
    numbered = number_rows(jobs, ["company"], order, "job_no", bucket)
    return numbered.withColumn("chunk_no", F.floor((F.col("job_no") - 1) / size).cast("long"))


def chunk_payload(chunked: DataFrame) -> DataFrame:
    """JSON list of each chunk's jobs in order; missing location and department are blank."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    job = F.struct("company", "title", "url", text("location"), text("department"))
    items = F.array_sort(F.collect_list(F.struct("job_no", job.alias("job"))))
    return chunked.groupBy("company", "chunk_no").agg(
        F.to_json(F.transform(items, lambda i: i["job"])).alias("payload"),
        F.count(F.lit(1)).alias("n_jobs"),
    )


Scorer = Callable[[str], tuple[str | None, int, int, int]]


def score_chunks(payloads: DataFrame, scorer: Scorer) -> DataFrame:
    """Call ``scorer(payload)`` once per chunk inside the tasks.

    It returns (response text, input tokens, output tokens, milliseconds). A call that raises
    gives a null response, and only that chunk passes through unscored.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunks in batches:
            rows = []
            for c in chunks.itertuples(index=False):
                try:
                    rows.append((c.company, c.chunk_no, *scorer(c.payload)))
                except Exception:
                    rows.append((c.company, c.chunk_no, None, 0, 0, 0))
            yield pd.DataFrame(
                rows,
                columns=["company", "chunk_no", "response", "input_tokens", "output_tokens", "duration_ms"],
            )

    return payloads.select("company", "chunk_no", "payload").mapInPandas(
        run,
        "company string, chunk_no long, response string, input_tokens long, output_tokens long,"
        " duration_ms long",
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Responses with ``decisions`` (null when the text is no valid answer) and ``failed``.

    Entries that are no objects or have no URL are skipped; ``keep`` is true for anything but
    false, nothing, zero and empty values; a missing reason is empty.
    """
    entries = F.from_json(or_null(F.col("response")), "struct<decisions: array<string>>")["decisions"]
    objects = F.filter(F.transform(entries, F.try_parse_json), lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))

    def decision(v: Column) -> Column:
        keep, kind = F.try_variant_get(v, "$.keep", "string"), F.schema_of_variant(F.try_variant_get(v, "$.keep", "variant"))
        no = (kind == "BOOLEAN") & (keep == "false") | keep.isin("", "[]", "{}") | kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (keep.try_cast("double") == 0)
        return F.struct(
            F.try_variant_get(v, "$.url", "string").alias("url"),
            (keep.isNotNull() & ~F.coalesce(no, F.lit(False))).alias("keep"),
            F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")).alias("reason"))

    found = F.filter(F.transform(objects, decision), lambda d: d["url"].isNotNull())
    return responses.withColumn("decisions", found).withColumn("failed", F.col("decisions").isNull())


def response_decisions(parsed: DataFrame) -> DataFrame:
    """One decision per chunk and URL; of repeated URLs the last entry wins."""
    rows = parsed.select("company", "chunk_no", F.posexplode("decisions").alias("pos", "d")).where(
        F.col("d.url").isNotNull()
    )
    return (
        rows.groupBy("company", "chunk_no", F.col("d.url").alias("url"))
        .agg(F.max_by("d", "pos").alias("d"))
        .select("company", "chunk_no", "url", "d.keep", "d.reason")
    )


def align(jobs: DataFrame, decisions: DataFrame, on: list[str]) -> DataFrame:
    """One decision per job: missing ones keep the job and are marked as not real."""
    answered = decisions.select(*on, F.struct("keep", "reason").alias("_d"))
    d = F.col("_d")
    return jobs.join(answered, on, "left").select(
        *jobs.columns,
        F.when(d.isNull(), True).otherwise(F.coalesce(d["keep"], F.lit(False))).alias("keep"),
        F.when(d.isNull(), "missing_from_model_output")
        .otherwise(F.coalesce(d["reason"], F.lit(""))).alias("reason"),
        d.isNotNull().alias("is_real"),
    )


USAGE = ["input_tokens", "output_tokens", "duration_ms"]


def decide_with_usage(chunked: DataFrame, parsed: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """``decide`` with ``failed`` and, on the first job of a chunk, what its answer used.

    The answers of a chunk, about ``size`` of them, are one map by URL, so one join by chunk brings all that
    its jobs need; of repeated URLs the last entry wins, and a failed chunk used nothing.
    """
    # Later entries first: the first of equal URLs is then the one that counts.
    entries = F.reverse(F.coalesce("decisions", F.array().cast("array<struct<url:string,keep:boolean,reason:string>>")))
    urls = F.transform(entries, lambda d: d["url"])
    last = F.filter(entries, lambda d, i: F.array_position(urls, d["url"]) == i + 1)
    answers = F.map_from_arrays(F.transform(last, lambda d: d["url"]), F.transform(last, lambda d: F.struct(d["keep"].alias("keep"), d["reason"].alias("reason"))))
    usage = [c for c in USAGE if c in parsed.columns]
    chunks = parsed.select("company", "chunk_no", F.col("failed").alias("_failed"), answers.alias("_answers"), *(F.col(c).alias(f"_{c}") for c in usage))
    lost = F.coalesce(F.col("_failed"), F.lit(True))
    first = F.col("job_no") == F.col("chunk_no") * size + 1
    d = F.try_element_at("_answers", F.col("url"))
    joined = chunked.withColumn("_first", first).join(chunks, ["company", "chunk_no"], "left").withColumn("_d", d)
    none = F.col("_d").isNull()
    return joined.select(
        *chunked.columns,
        F.when(lost | none, True).otherwise(F.coalesce(F.col("_d.keep"), F.lit(False))).alias("keep"),
        F.when(lost, "chunk_failed").when(none, "missing_from_model_output").otherwise(F.coalesce("_d.reason", F.lit(""))).alias("reason"),
        (~lost & ~none).alias("is_real"),
        lost.alias("failed"), F.col("_first").alias("is_first"),
        *(F.when(F.col("_first"), F.when(lost, 0).otherwise(F.col(f"_{c}"))).cast("long").alias(c) for c in usage),
    )


def decide(chunked: DataFrame, parsed: DataFrame) -> DataFrame:
    """Aligned decisions of all chunks; jobs of a failed chunk are kept and marked."""
    return decide_with_usage(chunked, parsed.select("company", "chunk_no", "decisions", "failed")).drop("failed", "is_first")


def keep_all(jobs: DataFrame, reason: str = "preferences_missing") -> DataFrame:
    """Without criteria every job is kept, and no decision is real."""
    return jobs.select("*", F.lit(True).alias("keep"), F.lit(reason).alias("reason"), F.lit(False).alias("is_real"))


def chunk_stats(decided: DataFrame) -> DataFrame:
    """Per chunk of ``decide_with_usage``: jobs, kept, tokens and time; a failed chunk counts no tokens."""
    return decided.groupBy("company", "chunk_no").agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if("keep").alias("n_kept"),
        F.count_if("is_real").alias("n_real"),
        F.max("failed").alias("failed"),
        *(F.max(c).alias(c) for c in USAGE),
    )


def run_stats(decided: DataFrame) -> DataFrame:
    """Totals of a run of ``decide_with_usage``, one row."""
    return decided.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("keep").alias("kept"),
        F.count_if("is_real").alias("real_decisions"),
        F.count_if("is_first").alias("chunks"),
        F.count_if(F.col("is_first") & F.col("failed")).alias("failed_chunks"),
        *(F.sum(c).alias(c) for c in USAGE),
    )


def decision_groups(decisions: DataFrame) -> DataFrame:
    """Real decisions by (keep, reason): size and first appearance.

    The URLs of a group stay rows (``group_members``): one reason can cover a third of all jobs.
    """
    real = decisions.where("is_real").withColumn("reason", F.substring("reason", 1, REASON_LIMIT))
    return real.groupBy("keep", "reason").agg(
        F.count(F.lit(1)).alias("n_urls"), F.min("seq").alias("first_seq")
    )


def group_members(decisions: DataFrame) -> DataFrame:
    return decisions.where("is_real").select("keep", F.substring("reason", 1, REASON_LIMIT).alias("reason"), "url")


def with_group_positions(decisions: DataFrame) -> DataFrame:
    """Decisions of a run as they are stored: ``group_seq`` says where their (keep, reason) group begins.

    ``decisions`` carries ``run_date`` and ``seq``. Groups are counted before they are joined back, and the
    join is split by adaptive execution where a third of all rows have one reason.
    """
    group = ["run_date", "keep", "reason"]
    rows = decisions.withColumn("reason", F.substring("reason", 1, REASON_LIMIT)).withColumn("_group", F.struct(*group))
    first = rows.where("is_real").groupBy(F.struct(*group).alias("_group")).agg(F.min("seq").alias("group_seq"))
    return rows.join(first, "_group", "left").drop("_group")


def persisted(stored: DataFrame) -> DataFrame:
    """The decision each URL ends up with, whatever the company.

    Only real decisions count. A later run wins; inside a run the (keep, reason) group that first
    appeared later wins, as if each group were written in turn. ``stored`` has the group positions that
    ``with_group_positions`` wrote, so this is one aggregate by URL.
    """
    return (
        stored.where("is_real").groupBy("url")
        .agg(F.max_by(F.struct("keep", "reason"), F.struct("run_date", "group_seq")).alias("d"))
        .select("url", F.col("d.keep").alias("ai_keep"), F.col("d.reason").alias("ai_reason"))
    )


def with_decisions(state: DataFrame, final: DataFrame) -> DataFrame:
    """State with the decisions by URL; undecided rows keep a null."""
    return state.drop("ai_keep", "ai_reason").join(final, "url", "left")


@dataclass
class Criteria:
    """Word lists that stand in for a model's judgement; words are matched whole."""

    in_scope_firms: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    senior: list[str] = field(default_factory=list)
    junior: list[str] = field(default_factory=list)
    strong: list[str] = field(default_factory=list)
    uncertain: list[str] = field(default_factory=list)


def criteria_score(jobs: DataFrame, criteria: Criteria) -> DataFrame:
    """Drop on a drop word outside an in-scope firm, or on a senior word without a junior one.

    Everything else is kept; the reason names the first word that decided. The word lists are a
    short configuration, so they are literals and the job is one scan.
    """
    def words(*columns: str) -> Column:
        text = F.concat_ws(" ", *columns)
        return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}&+]+", " "), F.lit(" "))

    scored = jobs.withColumn("_text", words("title", "department")).withColumn("_firm", words("company"))

    def hit(vocabulary: list[str], text: str = "_text") -> Column:
        spaced = strings(f" {w} " for w in vocabulary)
        return F.trim(F.get(F.filter(spaced, lambda w: F.col(text).contains(w)), F.lit(0)))

    for name in ("drop", "senior", "junior", "strong", "uncertain"):
        scored = scored.withColumn(f"_{name}", hit(getattr(criteria, name)))
    scored = scored.withColumn("_scope", hit(criteria.in_scope_firms, "_firm"))
    outside = F.col("_drop").isNotNull() & F.col("_scope").isNull()
    too_senior = F.col("_senior").isNotNull() & F.col("_junior").isNull()

    def because(kind: str) -> Column:
        return F.concat(F.lit(f"{kind}: "), F.col(f"_{kind}"))

    return scored.select(
        *jobs.columns,
        (~(outside | too_senior)).alias("keep"),
        F.when(outside, because("drop"))
        .when(too_senior, because("senior"))
        .otherwise(F.coalesce(because("strong"), because("uncertain"), F.lit("default")))
        .alias("reason"),
    )
