import json

from pyspark.sql import functions as F

from sightline.functions.jsonwalk import candidates, posting, readable
from sightline.functions.location import compile_filter
from sightline.operators import discovery

HOME = "https://jobs.acme.com/es-ES/careers/"


def job(n, **more):
    return {"title": f"Job number {n}", "url": f"/open/{n}", "id": n, **more}


def test_candidate_lists():
    found = lambda data, strict=False: list(candidates(json.dumps(data), strict))
    assert len(found({"a": {"b": [{"c": [job(1), job(2)]}]}})) == 2
    assert found([1, job(1)]) == [] and found([[job(1)]]) == [] and found([]) == []
    assert len(found([job(i) for i in range(501)])) == 501
    assert list(candidates(json.dumps([job(i) for i in range(501)]), False, max_items=500)) == []
    assert found([{"title": "x", "id": 1}], strict=True) == [] and len(found([{"title": "x", "id": 1}])) == 1
    assert found([{"title": "", "url": "/a", "id": 1, "city": "b"}]) == []
    assert len(found([job(1, city="b", team="c"), {"title": "bare"}])) == 2      # mean 3 passes, minimum does not
    assert found([job(i) for i in range(5)] + [{"x": 1}]) == []                     # every item is judged
    assert len(list(candidates(json.dumps([job(i) for i in range(5)] + [{"x": 1}]), False, sample=5))) == 6
    deep = [job(1)]
    for _ in range(8):
        deep = {"d": deep}
    assert len(found({"d": deep})) == 1 and list(candidates(json.dumps({"d": deep}), False, max_depth=8)) == []
    assert list(candidates("[" * 100_000, False)) == []
    assert posting({"title": "a\ud800b", "url": "/x"})[0] == "a?b"
    nested = [job(1, kids=[job(2)]), job(3)]
    assert [o["id"] for o in found(nested)] == [1, 3, 2]
    assert list(candidates("[broken", False)) == []


def test_readable():
    assert readable({"Name": "X", "z": 1}) == "X" and readable({"z": "b", "a": ["c", None, 2]}) == "b, c, 2"
    assert readable([True, {"city": {"text": "M"}}, ""]) == "True, M" and readable(None) == ""


def test_scores_agree_with_the_walk(column):
    cases = {'{"TITLE": "a", "Url": "", "jobId": 0, "city": [], "team": null}': 2, '{"name": "a", "href": "b", "geo": {}, "division": false, "reqId": "1"}': 5, "{}": 0, "[1]": 0}
    assert column(list(cases), "s string", discovery.job_score(F.col("s"))) == list(cases.values())


def capture(spark, body, url="https://x/api/jobs"):
    made = spark.createDataFrame(
        [("c", 0, url, "application/json", 200, body, HOME, "Madrid")],
        "company_id string, page_idx int, request_url string, content_type string, status int, body string, careers_url string, location_filter string",
    )
    return made.withColumn("places", compile_filter("Madrid"))


def test_discovered_rows(spark):
    data = {"list": [
        job(1, location="Madrid"), {**job(2), "url": "https://acme.com/x/2"}, {**job(3), "url": "https://other.org/x/3"}, {**job(4), "url": HOME},
        {**job(5), "url": HOME + "?jobId=a"}, {**job(6), "url": HOME + "#x"}, job(7, location={"city": "Paris"}), {**job(8), "title": 5},
        {"title": "Only place here", "id": "Z 9", "City": "Spain"}, {"title": "Nothing more", "id": 10}, {**job(11), "title": "Single"}, job(1, location="Madrid"),
    ]}
    got = discovery.discover_jobs(capture(spark, json.dumps(data))).orderBy("seq").collect()
    assert [r.url for r in got] == [
        "https://jobs.acme.com/open/1", "https://acme.com/x/2", HOME + "?jobId=a", HOME + "#x", HOME.rstrip("/") + "#job-Z 9",
    ]
    assert (got[-1].external_id, got[-1].location) == ("Z 9", "Spain")
    assert discovery.discover_jobs(capture(spark, json.dumps(data), "https://x/facets")).count() == 0


def test_odd_entries_do_not_hide_a_list(spark):
    jobs = [job(i, location="Madrid") for i in range(1, 61)]
    for at in (0, 3, 60):
        body = json.dumps([*jobs[:at], {"x": 1}, *jobs[at:]])
        assert discovery.discover_jobs(capture(spark, body)).count() == 60
        assert list(candidates(body, True, share=0.5)) == jobs
    most_odd = json.dumps([*jobs[:5], *[{"x": 1}] * 9])                     # the first five decide as well
    assert list(candidates(most_odd, False, share=0.5)) == jobs[:5]
    assert list(candidates(json.dumps([jobs[0], *[{"x": 1}] * 9]), False, share=0.5)) == []


def links(spark, *rows):
    df = spark.createDataFrame(
        [("c", 0, i, *r, HOME) for i, r in enumerate(rows)],
        "company_id string, page_idx int, pos int, href string, text string, context string, careers_url string",
    )
    return df.withColumn("places", compile_filter("Madrid"))


def test_discovered_links(spark):
    far = "Somewhere else entirely, with a text of more than forty characters"
    cases = [
        ("https://jobs.acme.com/job/1", "Risk Analyst", "", "Risk Analyst"),
        ("/ofertas-de-empleo/property-manager/", "Ver oferta", "Ver oferta\nProperty Manager\nMadrid", "Property Manager"),
        ("/jobs/sales-director-portugal/1", "See job", "", "Sales Director Portugal"),
        ("/career/abc", "Risk Analyst", "", None), ("/career/1234", "Risk Analyst", "", "Risk Analyst"),
        ("/career/5ee62d016b800f0fc8e70d1c", "Risk Analyst", "", "Risk Analyst"),
        ("/en/careers?jobid=1", "Risk Analyst", "", "Risk Analyst"), ("/en/careers#0", "Risk Analyst", "", None), ("/en/careers#12", "Risk Analyst", "", None),
        ("https://other.org/job/1", "Risk Analyst", "", None), ("/jobs/login", "Risk Analyst", "", None), ("/search/jobs/1", "Risk Analyst", "", None),
        ("/job/far", "Risk Analyst", far, None), ("/job/far-madrid", "Risk Analyst", far, None), ("/job/madrid/2", "Risk Analyst", far, "Risk Analyst"),
        ("/job/barcelona", "Risk Analyst", "Barcelona", "Risk Analyst"), ("/job/x", "", "Madrid role here", None), ("", "Risk Analyst", "", None),
        ("/job/long", "Risk " * 30, "", None), ("https://jobs.acme.com/job/1", "Second Text", "", None),
    ]
    got = {r.url: r.title for r in discovery.discover_links(links(spark, *[c[:3] for c in cases])).collect()}
    # "/job/far-madrid" names Madrid as a word of its path.
    want = {c[0]: c[3] for c in cases if c[3]} | {"/job/far-madrid": "Risk Analyst"}
    assert got == want


def test_merge(spark):
    j = spark.createDataFrame([("c", 1, "https://x/j#job-12345", "stub"), ("c", 2, "https://x/j/99999", "json")], "company_id string, seq long, url string, title string")
    d = spark.createDataFrame([("c", 1, "https://x/d?id=12345", "link"), ("c", 2, "https://x/k/99999", "late")], "company_id string, seq long, url string, title string")
    assert {r.title for r in discovery.merge_by_key(j, d).collect()} == {"link", "json"}
