import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions import vocab
from sightline.functions.blocks import compiled, listing_blocks
from sightline.schemas import CAPTURES
from sightline.sources import sinks
from sightline.sources import captures as cap
from sightline.sources import json_portals as js
from sightline.sources import link_portals as lp
from sightline.sources import markup_portals as mk
from sightline.sources.common import attach_companies, flat_map, load_companies
from sightline.sources.registry import CAPTURE_PARSERS, parse_captures, parse_sources, parser_names, resolve_parser


@pytest.fixture(scope="module")
def page(spark):
    """Bodies of one company, one per page, ready for a parser."""

    def make(*bodies, careers_url="https://x.example.com/careers/", places="Madrid", division=None, selector=None, **extra):
        rows = spark.createDataFrame(
            [("c1", i, b, *[v[i] if isinstance(v, list) else v for v in extra.values()]) for i, b in enumerate(bodies)],
            "company_id string, page_idx int, body string" + "".join(f", {k} string" for k in extra),
        )
        company = spark.createDataFrame(
            [("c1", careers_url, places, division, selector)],
            "company_id string, careers_url string, location_filter string, acciona_division string, job_selector string",
        )
        return attach_companies(rows, company)

    return make


def rows(df, *names):
    got = df.orderBy("seq").collect()
    return [tuple(r[n] for n in names) for r in got]


def test_greenhouse(page):
    body = json.dumps({"jobs": [
        {"id": 7, "title": "A B", "absolute_url": "u7", "location": {"name": "Madrid"}, "departments": [{"name": "D1"}, {"name": "D2"}],
         "metadata": [{"name": None, "value": "x"}, {"name": "Job Type", "value": "Full"}, {"name": "type", "value": "Late"}], "content": "é" * 600},
        {"id": 8, "title": "No place", "absolute_url": "u8", "location": {"name": None}, "departments": [], "metadata": None, "content": None},
        {"id": 9, "title": "Bare", "absolute_url": "u9", "location": {"name": "Spain"}},
    ]})
    got = rows(js.parse_greenhouse(page(body, "not json", "{}")), "external_id", "department", "job_type", "description", "location")
    assert got == [("7", "D1", "Full", "é" * 500, "Madrid"), ("9", None, None, None, "Spain")]


def test_workday_keeps_repeats(page):
    body = json.dumps({"total": 2, "jobPostings": [{"title": "A", "locationsText": "Madrid", "externalPath": "/job/1"}] * 2 + [{"title": "", "locationsText": "Madrid", "externalPath": "/job/2"}]})
    got = rows(js.parse_workday(page(body, careers_url="https://Acme.wd3.myworkdayjobs.com/en-US/S")), "url")
    assert got == [("https://acme.wd3.myworkdayjobs.com/job/1",)] * 2


def test_phenom(page):
    jobs = [
        {"title": " T1 ", "location": "", "city": "Madrid", "applyUrl": "https://a/?x=1&amp;y=2", "jobId": "J1"},
        {"title": "T2", "location": "Paris", "multi_location": ["Paris", "Madrid"], "reqId": 12},
        {"title": "T3", "location": "Paris", "multi_location": ["Paris"]},
        {"title": "T4", "location": "Madrid"},
    ]
    body = json.dumps({"refineSearch": {"totalHits": 4, "data": {"jobs": jobs}}})
    got = rows(js.parse_phenom(page(body, careers_url="https://careers.marsh.com/x/oliver-wyman")), "title", "url", "location", "external_id")
    assert got == [("T1", "https://a/?x=1&y=2", "Madrid", "J1"), ("T2", "https://careers.marsh.com/global/en/job/12", "Paris", "12")]


def test_embedded_json_needs_its_division(page):
    jobs = json.dumps([
        {"id": 1, "divisionID": "D", "primaryLocation": "Madrid", "jobPostingTitle": "A & \"B\" > c", "url": "/x"},
        {"id": 2, "divisionID": "E", "primaryLocation": "Madrid", "jobPostingTitle": "Other"},
    ]).replace("&", "&amp;").replace('"', "&quot;")
    body = f"<p a='>'><a-mo-oferta-v2 class=\"a > b\" jobs=\"{jobs}\"></a-mo-oferta-v2>"
    assert rows(js.parse_embedded_json(page(body, division="D")), "title", "url", "external_id") == [("A & \"B\" > c", "https://www.acciona.com/x", "1")]
    assert js.parse_embedded_json(page(body)).count() == 0


HTML = """<ul><li class="Job item"><div class="job-title"><a href="/a">First job<br>here</a></div> Madrid
<li class="job item"><a>no link</a> Madrid</li><li class="job"><a href="/a">Again</a> Madrid</li>
<li class="job"><a href="b?x=1">In London</a> London</li><li class=other><a href="/jobs/z">Outside</a> Madrid</li></ul>"""


def test_html_listing_by_class(page):
    got = rows(mk.parse_html_listing(page(HTML, places="Madrid")), "title", "url")
    # The inner block holds no place of its own, the outer one does.
    assert got == [("First job here", "https://x.example.com/a")]


def test_html_listing_by_links_and_selector(page):
    plain = '<p><a href="/jobs/1">One Madrid</a><a href="https://other.org/jobs/2">Two Madrid</a><a href="/about">About Madrid</a></p>'
    assert rows(mk.parse_html_listing(page(plain)), "url") == [("https://x.example.com/jobs/1",)]
    picked = '<div id="l"><p class="r big"><a href="/q">Role Madrid</a></p></div><p class="r"><a href="/w">Out Madrid</a></p>'
    assert rows(mk.parse_html_listing(page(picked, selector="#l p.r, h9")), "url") == [("https://x.example.com/q",)]


def test_selectors():
    body = '<div data-x="ab"><a href="/1" class="t">x</a></div><section><div><a href="/2">y</a></div></section>'
    assert [h for h, *_ in listing_blocks(body, "[data-x^='a']", None)] == ["/1"]
    assert [h for h, *_ in listing_blocks(body, "a.t", None)] == ["/1"]
    assert [h for h, *_ in listing_blocks(body, "section div", None)] == ["/2"]
    assert [h for h, *_ in listing_blocks(body, "a[href*='2']", None)] == ["/2"]


def test_selectors_by_structure():
    body = """<ul id="l"><li class="a"><a href="/1">1</a></li><li class="x"><a href="/2">2</a><ul><li><a href="/3">3</a></li></ul></li></ul>
    <div><li class="z"><a href="/4">4</a></li></div>"""
    expected = {
        "ul > li": "123", "#l > li": "12", "li:first-child": "134", "li:not(.x)": "134", "div li, ul#l>li.x": "24", "ul li li": "3",
        "ul > li > a": "123", "ul li:not(:first-child) > a": "2", "li[class]": "124", "li:not([class])": "3", "ul > a": "", "*:not(a):not(li) > li": "1234",
    }
    for selector, hrefs in expected.items():
        assert "".join(h[1:] for h, *_ in listing_blocks(body, selector, None)) == hrefs, selector
    for odd in ("a + b", "li:nth-child(2)", "a ~ b", "li:not(a b)", "> li", "li >", "li,,a", "a" * 60 + "!", "li:"):
        with pytest.raises(ValueError):
            compiled(odd)


def test_successfactors_first_text_wins_across_pages(page):
    one = '<a href="/job/Madrid-x/123456/">Apply</a><a href="/job/Madrid-x/123456/"><b>Best</b> title</a><a href="/job/Alicante/1234567/">Elsewhere</a><a href="/job/Madrid/12/">Short id</a>'
    got = rows(mk.parse_successfactors(page(one, one.replace("Apply", "Later"))), "title", "url", "location")
    assert got == [("Apply", "https://x.example.com/job/Madrid-x/123456/", "Madrid")]


def test_atom(page):
    feed = """<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom">
    <entry><title>Analyst Madrid</title><link rel="alternate" href="https://t/1?instant=apply"/><link href="https://t/1"/></entry>
    <entry><title type="text">Madrid &amp; more</title><link rel="self" href="https://t/s"/><id> https://t/2 </id></entry>
    <entry><title>Again Madrid</title><id>https://t/2</id></entry><entry><title>abc</title><id>https://t/Madrid</id></entry>
    <entry><title>Paris role</title><id>https://t/3</id></entry></feed>"""
    got = rows(mk.parse_atom(page(feed, "<broken")), "title", "url")
    assert got == [("Analyst Madrid", "https://t/1"), ("Madrid & more", "https://t/2")]


def test_headings(page):
    body = """<h4>Off-cycle Analyst (Spain, Madrid)</h4><h2>Students &amp; Graduates opportunities in Spain</h2><h1>Director Madrid</h1>
    <h3>Office Madrid</h3><h4>Off-cycle Analyst (Spain, Madrid)</h4><a name=x>apply</a><a href="/a#apply">Apply</a><a href="https://recruit.example.org/">Go</a>"""
    assert rows(mk.parse_headings(page(body)), "title", "url") == [("Off-cycle Analyst (Spain, Madrid)", "https://recruit.example.org/")]


def test_table(page):
    body = "<table><tr><th>a</th></tr><tr><td> Role <b>one</b></td><td>Madrid</td><td></td><td><a href='/1'>Apply</a></td></tr><tr><td>Role in Madrid</td><td>Paris</td><td>D</td></tr></table>"
    assert rows(mk.parse_html_table(page(body)), "title", "location", "department", "url") == [("Role one", "Madrid", None, "https://x.example.com/1")]


def test_wp_cards_without_a_place_pass(page):
    card = '<li class="careers__list__item"><p class="news-grid__items_title">{}</p>{}</li>'
    place = '<div class="news-grid__items_publish_date">{}</div>'
    body = json.dumps({"careers": card.format("M&amp;A — Analyst", "") + card.format("B", place.format("Paris")) + card.format("C", place.format("Madrid"))})
    got = rows(mk.parse_wp_cards(page(body)), "title", "url", "location")
    assert got == [("M&A — Analyst", "https://x.example.com/careers/#m-a-analyst", None), ("C", "https://x.example.com/careers/#c", "Madrid")]


def test_status_cards(page):
    cards = page("", "", "", "", title=["BA - Spain", "BA - Spain", "X - Spain", "Y - France"], status=["ROLLING", "CLOSED", None, "CLOSED"], apply_href=["https://a/1", "", None, ""]).withColumn("pos", F.lit(0))
    assert rows(lp.parse_cards(cards), "title", "url") == [("BA - Spain (Rolling)", "https://a/1"), ("X - Spain", "https://x.example.com/careers/")]


def test_normal_status(column):
    cases = {"ROLLING": "Rolling", "THIS ROUND'S DEADLINE HAS PASSED": "Deadline passed", "APPLY NOW": "Open", "open": "Open", "CLOSED": "Closed", "OPEN NOW": "Open Now", "": None}
    assert column(list(cases), "s string", lp.normal_status(F.col("s"))) == list(cases.values())


def test_routing(spark):
    sites = {
        ("playwright", "https://acme.wd3.myworkdayjobs.com/x"): "workday", ("lever", "https://WWW.Alantra.com/c"): "wp_cards",
        ("playwright", "https://careers.marsh.com/global/Oliver-Wyman-search"): "phenom", ("playwright", "https://careers.marsh.com/other"): "discover",
        ("x", "https://a.tal.net/"): "atom", ("x", "https://h.com/?a=b|c [d]"): None, ("greenhouse", None): "greenhouse", (None, None): None,
    }
    df = spark.createDataFrame([(str(i), *k) for i, k in enumerate(sites)], "company_id string, ats string, careers_url string")
    assert [r.parser for r in resolve_parser(df).orderBy(F.col("company_id").cast("int")).collect()] == list(sites.values())


def test_effective_filter(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "London")], "name string, location_filter string")
    assert [r.location_filter for r in load_companies(df, "Madrid").orderBy("name").collect()] == ["Madrid", "Madrid", "London"]


def test_admission(spark):
    base = ("https://x/api/jobs", "application/json", 200, "[1]")
    cases = [
        (base, False), (("https://x/v1/list?jobs", *base[1:]), True), (("https://x/api/JobFacets/x", "Text/JSON", 200, "[1]"), False),
        (("https://x/api/facets", *base[1:]), None), ((base[0], "text/html", 200, "[1]"), None), ((base[0], None, 200, "[1]"), None),
        ((*base[:2], 404, "[1]"), None), ((*base[:3], " \n{}"), False), ((*base[:3], "1"), None), ((*base[:3], "[1"), None),
        ((*base[:3], "[" + " " * 2_100_000 + "]"), False),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, request_url string, content_type string, status int, body string")
    got = {r.i: r.strict for r in cap.admit_captures(df).select("i", "strict").collect()}
    # "/api/JobFacets" holds no "/facet": only whole path parts are skipped.
    assert got == {i: strict for i, (_, strict) in enumerate(cases) if strict is not None}


def test_page_assembly(spark):
    def pages(parser, *sizes, total=None, new=None):
        new = new or sizes
        return [(parser, parser, i, n, n, m, total) for i, (n, m) in enumerate(zip(sizes, new))]

    data = (
        pages("workday", 20, 20, 20, total=40) + pages("phenom", 50, 0, 50, total=500) + pages("successfactors", 10, 10, 9, 10)
        + pages("html_in_json", 5, 5, 5, new=(5, 0, 5)) + pages("wp_cards", *[1] * 25, new=[0] * 25) + pages("other", 3, 3)
    )
    df = spark.createDataFrame(data, "company_id string, parser string, page_idx int, n_items long, n_urls long, n_new long, total long")
    got = {r.company_id: r.n for r in cap.assemble_pages(df).groupBy("company_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"workday": 2, "phenom": 1, "successfactors": 3, "html_in_json": 2, "wp_cards": 25, "other": 2}


def test_all_parsers_in_one_job(page):
    body = json.dumps({"jobs": [{"id": 1, "title": "A B", "absolute_url": "u", "location": {"name": "Madrid"}}]})
    lever = json.dumps([{"id": "L", "text": "C D", "hostedUrl": "v", "categories": {"location": "Madrid"}}])
    captures = page(body, lever, body, parser=["greenhouse", "lever", "lever"], content_type=["x"] * 3, status=["200"] * 3, request_url=["/"] * 3)
    assert set(rows(parse_captures(captures), "url")) == {("u",), ("v",)}
    assert len(CAPTURE_PARSERS) == 16 and len(parser_names()) == 19
    named = {r[-1] for r in vocab.HOST_RULES} | set(vocab.PLATFORM_PARSERS.values())
    assert named <= set(parser_names())


def test_failures_and_readable_pages(page):
    made = page("[1]", "[broken", "[1]", "[1]", "<p>You have been BLOCKED</p>", "x", "{}", "x",
                parser=["lever", "lever", "workday", "successfactors", "headings", "atom", "discover", "successfactors"])
    rows_ = made.withColumn("status", F.when(F.col("parser").isin("workday", "discover"), 500).otherwise(200))
    rows_ = rows_.withColumn("status", F.when((F.col("parser") == "successfactors") & (F.col("body") == "x"), 404).otherwise(F.col("status")))
    failed = {(r.page_idx, r.error) for r in cap.capture_failures(rows_).collect()}
    assert failed == {(1, "body is no JSON"), (2, "status 500"), (4, "blocked"), (5, "body is no feed")}
    assert {r.page_idx for r in cap.readable_captures(rows_.where("parser = 'lever' or parser = 'successfactors'")).collect()} == {0, 3}


def test_captures_are_read_twice(spark, tmp_path):
    empty = spark.createDataFrame([], CAPTURES).withColumn("parser", F.lit("lever"))
    sinks.write_captures(empty, str(tmp_path / "c"))
    for _ in range(2):
        assert sinks.read_captures(spark, str(tmp_path / "c")).columns[-1] == "parser"


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_parsing_reads_captures_a_few_times_a_parser(page):
    """The plan grows with the parsers, not with their product (F1 to F3)."""
    captures = page("[]", run_id="r", parser="lever", status=[200]).withColumns(
        {"status": F.lit(200), "run_date": F.lit("2024-01-31").cast("date")})
    names = ["workday", "phenom", "successfactors", "html_in_json", "wp_cards", "lever"]
    read = _plan(captures).count("LogicalRDD")
    assert _plan(parse_sources(captures, names=names)).count("LogicalRDD") <= 25 * read


def test_pages_are_counted_in_one_reading(spark):
    rows = [("c", 0, "a"), ("c", 0, "a"), ("c", 0, None), ("c", 1, "a"), ("c", 1, "b"), ("d", 3, "a"), (None, 0, "z")]
    items = spark.createDataFrame(rows, "company_id string, page_idx int, url string")
    counted = cap.count_new(items)
    assert _plan(counted).count("LogicalRDD") == 1
    got = {(r.company_id, r.page_idx): (r.n_items, r.n_urls, r.n_new) for r in counted.collect()}
    assert got == {("c", 0): (3, 1, 2), ("c", 1): (2, 2, 1), ("d", 3): (1, 1, 1), (None, 0): (1, 1, 0)}


def test_flat_map_gives_bounded_batches(spark):
    """However many rows a batch yields, the process holds a bounded number of them (F4, F5)."""
    class Rows:
        schema = T.StructType.fromDDL("company_id string, body int")

        def select(self, *names):
            return self

        def mapInArrow(self, run, out):  # noqa: N802
            return run

    run = flat_map(Rows(), ["company_id"], ["body"], T.StructType.fromDDL("pos int"), lambda n: ((i,) for i in range(n)))
    batch = pa.RecordBatch.from_pydict({"company_id": [f"c{i}" for i in range(100)], "body": pa.array([0, 5, 3000, 7] * 25, pa.int32())})
    found = list(run([batch]))
    assert max(b.num_rows for b in found) <= 1024
    assert [(r["company_id"], r["pos"]) for b in found for r in b.to_pylist()] == [(f"c{i}", x) for i in range(100) for x in range([0, 5, 3000, 7][i % 4])]


def test_cards_are_sorted_without_place_lists(page):
    """Which card is first does not need the place lists, so no row carries them there (F9)."""
    body = '<a href="/job/Madrid/1000001/">Analyst one</a><a href="/job/Madrid/1000001/">Apply now</a><a href="/job/Paris/1000002/">Analyst two</a>'
    found = mk.parse_successfactors(page(body))
    window = next(line for line in _plan(found).splitlines() if "Project" in line and "_rn" in line)
    assert "places" not in window and rows(found, "title") == [("Analyst one",)]
