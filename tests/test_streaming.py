import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline import tables
from sightline.operators.lifecycle import fold_history
from sightline.plans import QUERIES
from sightline.shared import shared_root
from sightline.sources import sinks
from sightline.streaming import replay
from tests.test_lifecycle import SCHEMA, as_dict, history


def test_replay_equals_the_fold(spark, tmp_path):
    rows, failed = history(seed=5, runs=5, companies=3)
    sightings = spark.createDataFrame(rows, SCHEMA)
    failures = spark.createDataFrame(failed, "run_date date, company_id string")
    source = tmp_path / "in"

    def play(days):
        for n in days:
            sightings.where(F.col("run_date") == F.lit(dt.date(2024, 1, n))).coalesce(1).write.mode("append").parquet(str(source))
        stream = replay.read_files(spark, str(source), sightings.schema, files_per_batch=1)
        query = replay.track(stream, lambda batch: (batch, failures), str(tmp_path / "state"), str(tmp_path / "progress"))
        query.awaitTermination()
        return as_dict(replay.read_state(spark, str(tmp_path / "state")))

    play([2, 5])
    got = play([1, 3, 4])                      # earlier runs that arrive late
    assert got == as_dict(fold_history(sightings, failures))


def test_repeats_inside_the_watermark(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    schema = "company_id string, url string, run_date date, captured_at timestamp"
    rows = [("a", "u", at.date(), at), ("a", "u", at.date(), at + dt.timedelta(hours=5)), ("a", "v", at.date(), at)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = replay.drop_repeats(replay.read_files(spark, str(tmp_path / "in"), T.StructType.fromDDL(schema)))
    query = stream.writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.url for r in spark.table("kept").collect()) == ["u", "v"]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_root(spark) == (named or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def test_a_run_split_over_batches(spark, tmp_path):
    """The failure of a run comes with its second part; a decision stays through every batch."""
    day = [dt.date(2024, 1, n) for n in (1, 2)]
    parts = [
        ([(day[0], "c", 1, "u0", None)], []),
        ([(day[1], "c", 1, "u1", None)], []),
        ([(day[1], "c", 2, "u2", None)], [(day[1], "c")]),
    ]
    schema = "run_date date, company_id string, seq long, url string, title string"
    for rows, _ in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = replay.read_files(spark, str(tmp_path / "in"), T.StructType.fromDDL(schema), files_per_batch=1)

        def read(batch):
            bad = batch.where("url = 'u2'").select("run_date", "company_id")
            return batch, bad

        replay.track(stream, read, str(tmp_path / "state"), str(tmp_path / "progress")).awaitTermination()
        if rows[0][3] == "u0":
            replay.put_state(replay.read_state(spark, str(tmp_path / "state")).withColumn("ai_keep", F.lit(True)), str(tmp_path / "state"))
    got = {r.url: (r.is_active, r.ai_keep) for r in replay.read_state(spark, str(tmp_path / "state")).collect()}
    assert got == {"u0": (True, True)}


def _files(folder):
    return {str(f) for f in folder.rglob("*.parquet") if "_temporary" not in str(f)}


def test_a_batch_touches_only_its_buckets(spark, tmp_path):
    """Files of other buckets are neither written nor replaced; old versions go, and the state stays the fold."""
    rows, failed = history(seed=8, runs=6, companies=12)
    sightings = spark.createDataFrame(rows, SCHEMA)
    failures = spark.createDataFrame(failed, "run_date date, company_id string")
    path = str(tmp_path / "state")
    replay.fold_batch(sightings.where("run_date < '2024-01-05'"), 0, lambda b: (b, failures.where("run_date < '2024-01-05'")), path, buckets=16)
    before, parts = _files(tmp_path / "state" / "data"), tables.parts_of(spark, path, 0)
    one = sightings.first().company_id
    late = sightings.where((F.col("run_date") >= "2024-01-05") & (F.col("company_id") == one))
    replay.fold_batch(late, 1, lambda b: (b, failures.where((F.col("run_date") >= "2024-01-05") & (F.col("company_id") == one))), path, buckets=16)
    bucket = spark.createDataFrame([(one,)], "company_id string").select(tables.bucket_of("company_id", 16)).first()[0]
    new = _files(tmp_path / "state" / "data") - before
    assert new and all(f"bucket={bucket}/" in f for f in new)
    other = {(p.table, p.bucket, p.folder) for p in parts if p.bucket != bucket}
    assert other <= {(p.table, p.bucket, p.folder) for p in tables.parts_of(spark, path, 1)}
    seen = sightings.where((F.col("run_date") < "2024-01-05") | (F.col("company_id") == one))
    assert as_dict(replay.read_state(spark, path)) == as_dict(fold_history(seen, failures))
    # A read of the state opens the newest folder of every bucket and no other.
    opened = {f.removeprefix("file://") for f in replay.read_state(spark, path).inputFiles()}
    assert opened == {f for p in tables.parts_of(spark, path, 1) if p.table == "state" for f in _files(Path(p.folder))}
    for n in (2, 3):
        replay.fold_batch(late.limit(0), n, lambda b: (b, None), path, buckets=16)
    assert tables.versions(spark, path) == [2, 3]
    named = {p.folder for v in (2, 3) for p in tables.parts_of(spark, path, v)}
    assert {str(Path(f).parent) for f in _files(tmp_path / "state" / "data")} == named
    assert as_dict(replay.read_state(spark, path)) == as_dict(fold_history(seen, failures))


def test_buckets_are_merged(spark, tmp_path):
    """Many small batches, with repeats: few parts stay, and runs that are final become one row a listing."""
    rows, failed = history(seed=9, runs=7, companies=3)
    sightings = spark.createDataFrame(rows, SCHEMA)
    failures = spark.createDataFrame(failed, "run_date date, company_id string")
    want = as_dict(fold_history(sightings, failures))
    for settle in (None, 2):
        path = str(tmp_path / f"state{settle}")
        for n in range(7):
            day = F.col("run_date") == F.lit(dt.date(2024, 1, n + 1))
            batch = sightings.where(day).unionByName(sightings.where(day))
            replay.fold_batch(batch, n, lambda b, day=day: (b, failures.where(day)), path, buckets=2, parts=2, settle=settle)
        assert as_dict(replay.read_state(spark, path)) == want
        parts = tables.newest(spark, path)[1]
        assert max(sum(p.table == "sightings" and p.bucket == b for p in parts) for b in (0, 1)) <= 3
        stored = tables.read_parts(spark, parts, "sightings")
        if settle is not None:
            assert tables.read_parts(spark, parts, "settled").count() > 0 and stored.count() < sightings.count()


def test_a_batch_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    rows, _ = history(seed=10, runs=2, companies=2)
    sightings = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "state")
    days = [sightings.where(F.col("run_date") == F.lit(dt.date(2024, 1, n))) for n in (1, 2)]
    replay.fold_batch(days[0], 0, lambda b: (b, None), path)
    with monkeypatch.context() as m:
        m.setattr(tables, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            replay.fold_batch(days[1], 1, lambda b: (b, None), path)
    assert as_dict(replay.read_state(spark, path)) == as_dict(fold_history(days[0]))
    replay.fold_batch(days[1], 1, lambda b: (b, None), path)
    assert as_dict(replay.read_state(spark, path)) == as_dict(fold_history(sightings))
    named = {p.folder for v in tables.versions(spark, path) for p in tables.parts_of(spark, path, v)}
    assert {str(Path(f).parent) for f in _files(tmp_path / "state" / "data")} == named


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "run_date string, n int")
    sinks.write_by_run(rows, str(tmp_path / "runs"))
    sinks.write_by_run(rows.where("n = 2").withColumn("n", F.lit(3)), str(tmp_path / "runs"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == [1, 3]
    sinks.write_state(rows, str(tmp_path / "state"), 0)
    sinks.write_state(rows.where("n = 1"), str(tmp_path / "state"), 1)
    sinks.write_state(rows.where("n = 2"), str(tmp_path / "state"), 1)
    assert [r.n for r in sinks.read_state(spark, str(tmp_path / "state")).collect()] == [2]


def test_repeats_are_written_by_many_tasks(spark, tmp_path):
    """A batch of the query is as many files as its events are, and none is gathered in one task (F8)."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    known = set(Path(shared_root(spark).removeprefix("file:")).glob("repeats-*"))
    found = QUERIES["repeats_streamed"](spark, str(tmp_path))
    assert found.where("n_stored <> 1").count() == 0
    (root,) = set(Path(shared_root(spark).removeprefix("file:")).glob("repeats-*")) - known
    assert len(list((root / "in").glob("*.parquet"))) > 3


def test_the_day_is_rendered_once(spark):
    """Today's captures are stored before failures and listings read them; yesterday's are read once (F7)."""
    plan = QUERIES["daily_run"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_sort(collect_list(") <= 1
