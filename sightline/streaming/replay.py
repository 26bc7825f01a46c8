"""Incremental tracking: captured files arrive, sightings fold into the state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import tables
from ..operators.dedupe import first_by
from ..operators.lifecycle import fold_history, merge_runs, settled

# Sightings of a batch, and its failed company-runs or None.
Reader = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]

BUCKETS = 64
LISTING = ["company_id", "url", "run_date"]


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drop_repeats(rows: DataFrame, keys: list[str] | None = None, delay: str = "3 days") -> DataFrame:
    """Drop repeats of the keys, of a listing inside a run by default, that arrive within ``delay``.

    The watermark is on the time of arrival: it bounds what is remembered, and no row is late, however
    old the run that it belongs to. A repeat that comes after the delay passes and changes nothing, as
    the fold is idempotent; it goes when its bucket is merged.
    """
    arrived = rows.withColumn("_arrived_at", F.current_timestamp()).withWatermark("_arrived_at", delay)
    return arrived.dropDuplicatesWithinWatermark(keys or LISTING).drop("_arrived_at")


def fold_batch(
    batch: DataFrame, n: int, read: Reader, path: str, buckets: int = BUCKETS, parts: int = 8, keep: int = 2, settle: int | None = None
) -> None:
    """Fold one batch into version ``n`` of the tables ``sightings``, ``failures`` and ``state`` (see ``tables``).

    A run may be split over batches, and its failure may come with any of them, so sightings and failures
    are kept, by hash bucket of the company, and the buckets that a batch touches are folded again from all
    of theirs. Other buckets are neither read nor written: the new version names their old parts. Columns
    that the state has besides, such as decisions, stay with their row.

    A bucket with more than ``parts`` parts of sightings is merged to one, without repeats. With ``settle``
    runs that many days before the bucket's newest are then taken as final: their listings become one row
    each (table ``settled``), and a failure of theirs that comes later has no effect.
    """
    spark = batch.sparkSession
    before = tables.newest(spark, path, before=n)[1]
    sightings, failed = read(batch)
    failed = (sightings.limit(0) if failed is None else failed).select("company_id", "run_date").distinct()
    new = tables.write_buckets(sightings, path, "sightings", "company_id", buckets, "url")
    new += tables.write_buckets(failed, path, "failures", "company_id", buckets, "run_date")
    touched = {p.bucket for p in new}
    own = [p for p in before if p.bucket in touched]
    live = _merged(spark, [p for p in own if p.table != "state"] + new, path, buckets, parts, settle)
    seen = tables.read_parts(spark, live, "sightings")
    seen = sightings.limit(0) if seen is None else seen
    bad, base = (tables.read_parts(spark, live, t) for t in ("failures", "settled"))
    state = fold_history(seen, bad) if base is None else merge_runs(base, seen, bad)
    old = tables.read_parts(spark, own, "state")
    more = [] if old is None else [c for c in old.columns if c not in state.columns]
    if more:
        state = state.join(old.select("company_id", "url", *more), ["company_id", "url"], "left")
    folded = tables.write_buckets(state, path, "state", "company_id", buckets, "url")
    tables.publish(spark, path, n, [p for p in before if p.bucket not in touched] + live + folded)
    tables.remove_old(spark, path, keep)


def _merged(spark: SparkSession, live: list[tables.Part], path: str, buckets: int, most: int, settle: int | None) -> list[tables.Part]:
    """The parts with those of sightings merged where a bucket has more than ``most`` of them."""
    count: dict[int, int] = {}
    for p in live:
        count[p.bucket] = count.get(p.bucket, 0) + (p.table == "sightings")
    full = {b for b, n in count.items() if n > most}
    if not full:
        return live
    own = [p for p in live if p.bucket in full]
    seen, bad, base = (tables.read_parts(spark, own, t) for t in ("sightings", "failures", "settled"))
    merged = first_by(seen, LISTING, ["seq"])
    if settle is not None:
        bucket = tables.bucket_of("company_id", buckets)
        ends = merged.groupBy(bucket.alias("_bucket")).agg(F.date_sub(F.max("run_date"), settle).alias("_end"))  # a row a bucket
        merged = merged.withColumn("_bucket", bucket).join(ends, "_bucket")
        final = settled(base, merged.where("run_date < _end").drop("_bucket", "_end"), bad)
        merged = merged.where("run_date >= _end").drop("_bucket", "_end")
    new = tables.write_buckets(merged, path, "sightings", "company_id", buckets, "url")
    replaced = {"sightings"}
    if settle is not None:
        new += tables.write_buckets(final, path, "settled", "company_id", buckets, "url")
        replaced.add("settled")
    if bad is not None:
        new += tables.write_buckets(bad.distinct(), path, "failures", "company_id", buckets, "run_date")
        replaced.add("failures")
    return [p for p in live if p.bucket not in full or p.table not in replaced] + new


def track(
    stream: DataFrame, read: Reader, state_path: str, checkpoint: str, buckets: int = BUCKETS, parts: int = 8, keep: int = 2, settle: int | None = None
) -> StreamingQuery:
    """Fold every micro-batch into the next version of the state and stop when no file is left.

    Batch n writes version n, so a batch that runs again after a failure writes the same again.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, n: fold_batch(batch, n, read, state_path, buckets, parts, keep, settle))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The state of the newest version that was written to its end, or of the given one."""
    return tables.read_table(spark, path, "state", version)


def put_state(state: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace the state of the newest version, for instance by one with decisions; sightings stay."""
    spark = state.sparkSession
    version, before = tables.newest(spark, path)
    new = tables.write_buckets(state, path, "state", "company_id", buckets, "url")
    tables.publish(spark, path, version, [p for p in before if p.table != "state"] + new)
