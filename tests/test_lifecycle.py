import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import dedupe, lifecycle

SCHEMA = "run_date date, company_id string, seq long, url string, title string, location string"
DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def history(seed=3, runs=12, companies=5, hot="c0"):
    """Random runs; one company holds about half of the rows, some runs fail, some are empty."""
    rng = random.Random(seed)
    rows, failed, seq = [], [], 0
    for n in range(runs):
        for c in range(companies):
            name = f"c{c}"
            if rng.random() < 0.2:
                failed.append((day(n), name))
            if rng.random() < 0.15:
                continue
            for _ in range(rng.randint(1, 40 if name == hot else 5)):
                seq += 1
                url = f"u{rng.randint(0, 30 if name == hot else 6)}"
                place = rng.choice(["Madrid", None, "London"])
                rows.append((day(n), name, seq, url, f"t{seq}", place))
    return rows, failed


def by_the_run(rows, failed):
    """The daily upsert, one run and company at a time."""
    state = {}
    for run in sorted({r[0] for r in rows}):
        for company in {r[1] for r in rows if r[0] == run}:
            if (run, company) in failed:
                continue
            now = {}
            for _, _, seq, url, title, place in sorted(r for r in rows if r[0] == run and r[1] == company):
                now.setdefault(url, (title, place, seq))
            for url, fields in now.items():
                first = state.get((company, url), (None, run))[1]
                state[company, url] = (fields, first, run, True)
            for key, (fields, first, last, _) in list(state.items()):
                if key[0] == company and key[1] not in now:
                    state[key] = (fields, first, last, False)
    return {k: (*f, a, b, on) for k, (f, a, b, on) in state.items()}


def as_dict(df):
    return {
        (r.company_id, r.url): (r.title, r.location, r.seq, r.first_seen_at, r.last_seen_at, r.is_active)
        for r in df.collect()
    }


@pytest.fixture(scope="module")
def runs(spark):
    rows, failed = history()
    return (
        rows, failed, spark.createDataFrame(rows, SCHEMA),
        spark.createDataFrame(failed, "run_date date, company_id string"),
    )


def test_fold_equals_the_loop(runs):
    rows, failed, sightings, failures = runs
    want = by_the_run(rows, set(failed))
    assert as_dict(lifecycle.fold_history(sightings, failures)) == want
    assert len({k[0] for k in want}) == 5 and not all(v[-1] for v in want.values())


def test_merging_runs_in_any_order(runs):
    rows, failed, sightings, failures = runs
    late = F.col("run_date") >= F.lit(day(7))
    state = lifecycle.merge_runs(None, sightings.where(late), failures)
    state = lifecycle.merge_runs(state, sightings.where(~late), failures)
    assert as_dict(state) == by_the_run(rows, set(failed))


def test_one_upsert_equals_the_fold(runs):
    rows, failed, sightings, failures = runs
    good = lifecycle.successful(sightings, failures)
    last = F.lit(day(11))
    state = lifecycle.fold_history(good.where(F.col("run_date") < last))
    after = lifecycle.upsert_run(state, good.where(F.col("run_date") == last), last)
    assert as_dict(after) == by_the_run(rows, set(failed))


def test_upsert_keeps_decisions_and_other_companies(spark):
    state = spark.createDataFrame(
        [("a", "u1", "old", day(0), day(0), True, 1, False), ("b", "u9", "other", day(0), day(0), True, 2, None)],
        "company_id string, url string, title string, first_seen_at date, last_seen_at date, is_active boolean, seq long, ai_keep boolean",
    )
    today = spark.createDataFrame([("a", "u2", "new", 3)], "company_id string, url string, title string, seq long")
    got = {(r.company_id, r.url): r for r in lifecycle.upsert_run(state, today, F.lit(day(5))).collect()}
    assert got["a", "u1"].is_active is False and got["a", "u1"].ai_keep is False and got["a", "u1"].last_seen_at == day(0)
    assert got["a", "u2"].is_active is True and got["a", "u2"].first_seen_at == day(5)
    assert got["b", "u9"].is_active is True


def test_returning_url_is_not_new(spark):
    seen = spark.createDataFrame([("a", "u1"), ("b", "u2")], "company_id string, url string")
    today = spark.createDataFrame(
        [("a", "u1", 1, "x"), ("a", "u2", 2, "x"), ("a", "u2", 3, "y")], "company_id string, url string, seq long, title string"
    )
    new = lifecycle.new_urls(seen, today).collect()
    assert [(r.url, r.title) for r in new] == [("u2", "x")]       # known to b only; the first of two rows
    assert lifecycle.stale_urls(seen, today).count() == 0          # b was not scraped


def test_run_audit(spark):
    rows = [(day(0), "a", 1, "u1", "t", None), (day(0), "a", 2, "u1", "t", None), (day(1), "a", 3, "u2", "t", None), (day(1), "b", 4, "u3", "t", None)]
    sightings = spark.createDataFrame(rows, SCHEMA)
    errors = spark.createDataFrame([(day(1), "b", "boom")], "run_date date, company_id string, error string")
    open_run = spark.createDataFrame([(day(1),)], "run_date date")
    got = {r.run_date: r for r in lifecycle.run_audit(sightings, sightings, errors).collect()}
    assert (got[day(0)].status, got[day(0)].new_jobs_found, got[day(0)].repeated_urls) == ("completed", 1, 1)
    assert (got[day(1)].status, got[day(1)].new_jobs_found, got[day(1)].n_errors) == ("failed", 1, 1)
    got = {r.run_date: r.status for r in lifecycle.run_audit(sightings, sightings, errors, open_run).collect()}
    assert got == {day(0): "completed", day(1): "running"}


@pytest.mark.parametrize("cut", ["by range of the id", "by sorting"])
def test_numbering_a_hot_key(spark, cut):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 3)}", i) for i in range(3000)] + [(None, 3000), (None, 3001)]
    df = spark.createDataFrame(rows, "k string, n long").repartition(5)
    bucket = F.floor(F.col("n") / 64) if cut == "by range of the id" else None
    got = dedupe.number_rows(df, ["k"], ["n"], "no", bucket).collect()
    want, count = {}, {}
    for k, n in rows:
        count[k] = count.get(k, 0) + 1
        want[n] = count[k]
    assert {r.n: r.no for r in got} == want and set(got[0].asDict()) == {"k", "n", "no"}


def test_first_by_is_pushed_before_the_shuffle(spark):
    key = F.when(F.col("id") % 10 < 7, "hot").otherwise("cold")
    df = spark.range(100).select(key.alias("k"), F.col("id").alias("seq"))
    first = dedupe.first_by(df, ["k"], ["seq"])
    assert sorted(r.seq for r in first.collect()) == [0, 7]
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
