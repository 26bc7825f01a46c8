import datetime as dt

from pyspark.sql import functions as F

from sightline.functions.clock import madrid_hour
from sightline.operators import digest, listings

NOW = dt.datetime(2024, 9, 30, 12)
SCHEMA = (
    "company_id string, company string, url string, title string, location string, department string, job_type string,"
    " first_seen_at timestamp_ntz, is_active boolean, ai_keep boolean, ai_reason string"
)


def job(url, ago, active=True, keep=None, company="Acme", title="Analyst", location="Madrid", reason=None):
    return (company[:1], company, url, title, location, "M&A", None, NOW - ago, active, keep, reason)


ROWS = [
    job("u1", dt.timedelta(hours=24)), job("u2", dt.timedelta(hours=24, seconds=1), keep=True),
    job("u3", dt.timedelta(days=7), keep=False), job("u4", dt.timedelta(days=7), company="beta", location=None, reason="fits"),
    job("u5", dt.timedelta(days=7, seconds=1), company="beta"), job("u6", -dt.timedelta(days=1), active=False),
]


def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def urls(df):
    return sorted(r.url for r in df.collect())


def test_windows_are_rolling_and_inclusive(spark):
    now = F.lit(NOW).cast("timestamp_ntz")
    assert urls(listings.in_range(frame(spark), "today", now)) == ["u1", "u6"]
    assert urls(listings.in_range(frame(spark), "7d", now)) == ["u1", "u2", "u3", "u4", "u6"]
    assert urls(listings.in_range(frame(spark), "all", now)) == ["u1", "u2", "u3", "u4", "u5", "u6"]


def test_undecided_listings_are_visible(spark):
    assert urls(listings.visible(frame(spark))) == ["u1", "u2", "u4", "u5"]


def test_search_spans_fields_and_keeps_blanks(spark):
    assert urls(listings.search(frame(spark), "ANALYST acme")) == ["u1", "u2", "u3", "u6"]
    assert urls(listings.search(frame(spark), "beta  m&a fits")) == ["u4"]       # absent location leaves its blank
    assert len(urls(listings.search(frame(spark), ""))) == 6


def test_card_dates(spark):
    shown = {r.url: r.shown_date for r in listings.cards(frame(spark)).collect()}
    assert shown["u1"] == "29 Sept" and shown["u6"] == "1 Oct"


def test_unknown_company(spark):
    names = spark.createDataFrame([("A", "Acme Ltd")], "company_id string, name string")
    got = {r.url: r.company for r in listings.with_company(frame(spark), names).collect()}
    assert got["u1"] == "Acme Ltd" and got["u4"] == "Unknown"


def test_digest(spark):
    now = F.lit(NOW).cast("timestamp_ntz")
    df = frame(spark)
    none = df.where("false")
    assert digest.digest_subject(none, none).count() == 0
    assert digest.digest_subject(none, df).first().subject == "Listings: 0 nuevos hoy · 6 activos esta semana"
    assert digest.digest_subject(df.limit(1), df).first().subject == "Listings: 1 nuevo hoy"
    assert digest.digest_subject(df.limit(2), none).first().subject == "Listings: 2 nuevos hoy"
    week = listings.recent(listings.visible(df), now, 7)
    rows = digest.digest_rows(none, week)
    ordered = [(r.company, r.url, r.is_heading) for r in digest.in_digest_order(rows).collect()]
    assert ordered == [("Acme", "u1", True), ("Acme", "u2", False), ("beta", "u4", True)]
    heads = {r.section: r.html for r in digest.section_heads(rows).collect()}
    assert "Sin novedades." in heads[digest.NEW_TODAY] and "&mdash; 3" in heads[digest.LAST_WEEK]
    small = {(r.company, r.part_no): r.html for r in digest.digest_fragments(rows, 1).collect()}
    whole = {r.company: r.html for r in digest.digest_fragments(rows).collect()}
    assert small["Acme", 0] + small["Acme", 1] == whole["Acme"] and whole["Acme"].count("<h4") == 1


def test_section_a_matches_on_url_only(spark):
    new = frame(spark).where("url IN ('u1', 'u2')")
    decided = spark.createDataFrame([("u1", True, "other"), ("u2", False, "Acme")], "url string, keep boolean, company string")
    assert urls(digest.new_today(new, decided)) == ["u1"]


def test_madrid_hour(column):
    times = [dt.datetime(2024, 3, 31, 0, 59), dt.datetime(2024, 3, 31, 1, 0), dt.datetime(2024, 7, 1, 5), dt.datetime(2024, 1, 1, 6)]
    assert column([(t,) for t in times], "t timestamp_ntz", madrid_hour(F.col("t"))) == [1, 3, 7, 7]
