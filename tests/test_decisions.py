import json

import pytest
from pyspark.sql import functions as F

from sightline.operators import decisions as D

CRITERIA = D.Criteria(
    in_scope_firms=["santander", "permira", "blackrock", "bcg"],
    drop=["dependiente", "cashier", "warehouse", "marketing", "recruiter", "agriculture"],
    senior=["vp", "director", "head of", "chief", "partner", "managing director", "senior"],
    junior=["associate", "analyst", "intern", "internship", "trainee", "junior", "becario", "graduate"],
    strong=["off cycle", "internship", "private equity", "m&a", "analyst"],
    uncertain=["software", "data", "operations", "intern"],
)
SMOKE = [
    ("Santander CIB", "2026 Off-Cycle Internship — M&A Industrials", "Investment Banking", True, "strong: off cycle"),
    ("Permira", "Private Equity Associate, Compliance", "Compliance", True, "strong: private equity"),
    ("Mango", "Dependiente/a Tienda", "Retail", False, "drop: dependiente"),
    ("Random Co", "Chief Financial Officer — 20+ years experience required", "Executive", False, "senior: chief"),
    ("BlackRock", "Software Engineering Intern — Aladdin Platform", "Technology", True, "uncertain: software"),
    ("BCG", "Marketing Analyst, Agriculture", "x", True, "strong: analyst"),
    ("Farm", "Agriculture Analyst", "x", False, "drop: agriculture"),
    ("Any", "Associate Director", "x", True, "default"),
    ("Any", "MVP builder", None, True, "default"),               # vp is a word, not a substring
]


def test_criteria_on_the_smoke_jobs(spark):
    jobs = spark.createDataFrame([(i, *s[:3]) for i, s in enumerate(SMOKE)], "i int, company string, title string, department string")
    got = D.criteria_score(jobs, CRITERIA).orderBy("i").collect()
    assert [(r.keep, r.reason) for r in got] == [s[3:] for s in SMOKE]


@pytest.fixture(scope="module")
def chunked(spark):
    rows = [("A", f"u{i}", f"t{i}", None, "d", i) for i in range(60)] + [("B", "u0", "x", "Madrid", None, 100)]
    jobs = spark.createDataFrame(rows, "company string, url string, title string, location string, department string, seq long")
    return D.chunk_jobs(jobs, ["seq"], F.floor(F.col("seq") / 7))


def test_chunks_and_payload(chunked):
    sizes = {(r.company, r.chunk_no): r["count"] for r in chunked.groupBy("company", "chunk_no").count().collect()}
    assert sizes == {("A", 0): 25, ("A", 1): 25, ("A", 2): 10, ("B", 0): 1}
    payload = D.chunk_payload(chunked).where("company = 'A' AND chunk_no = 2").first().payload
    items = json.loads(payload)
    assert [i["url"] for i in items] == [f"u{i}" for i in range(50, 60)]
    assert items[0] == {"company": "A", "title": "t50", "url": "u50", "location": "", "department": "d"}


def test_scoring_alignment_and_failover(chunked):
    def scorer(payload):
        urls = [j["url"] for j in json.loads(payload)]
        if "u0" in urls and len(urls) == 25:
            raise TimeoutError
        if "u25" in urls:
            return "not json", 1, 1, 1
        entries = [{"url": u, "keep": False, "reason": "first"} for u in urls[:2]]
        entries += [{"url": urls[0], "keep": True, "reason": "last"}, {"keep": True}, {"url": "zz", "keep": True, "reason": "not asked"}]
        entries += [{"url": u} for u in urls[2:3]]
        return json.dumps({"decisions": entries}), 10, 5, 7

    answers = D.parse_responses(D.score_chunks(D.chunk_payload(chunked), scorer))
    decided = D.decide(chunked, answers)
    got = {(r.company, r.url): (r.keep, r.reason, r.is_real) for r in decided.collect()}
    assert len(got) == 61
    assert got["A", "u0"] == (True, "chunk_failed", False)
    assert got["A", "u30"] == (True, "chunk_failed", False)
    assert got["A", "u50"] == (True, "last", True)
    assert got["A", "u51"] == (False, "first", True)
    assert got["A", "u52"] == (False, "", True)                    # null keep is false, null reason empty
    assert got["A", "u53"] == (True, "missing_from_model_output", False)
    assert got["B", "u0"] == (True, "last", True)
    total = D.run_stats(D.decide_with_usage(chunked, answers)).first()
    assert (total.total, total.chunks, total.failed_chunks, total.input_tokens, total.real_decisions) == (61, 4, 2, 20, 4)


def test_usage_stands_on_the_first_job_of_a_chunk(chunked):
    answers = D.parse_responses(D.score_chunks(D.chunk_payload(chunked), lambda payload: ('{"decisions": []}', 3, 2, 1)))
    rows = D.decide_with_usage(chunked, answers).where("input_tokens is not null").select("company", "job_no", "input_tokens").collect()
    assert sorted(tuple(r) for r in rows) == [("A", 1, 3), ("A", 26, 3), ("A", 51, 3), ("B", 1, 3)]
    assert {(r.company, r.chunk_no): (r.n_jobs, r.output_tokens) for r in D.chunk_stats(D.decide_with_usage(chunked, answers)).collect()} == {
        ("A", 0): (25, 2), ("A", 1): (25, 2), ("A", 2): (10, 2), ("B", 0): (1, 2)}


def test_entries_of_other_types(spark):
    text = '{"decisions": ["stray", 7, null, [1], {"url": "a", "keep": "true"}, {"url": "b", "keep": 1}, {"url": "c", "keep": 0}, {"url": "d", "keep": ""}, {"url": "e", "keep": []}, {"url": "f", "keep": "false"}, {"url": "g", "keep": 0.0}]}'
    parsed = D.parse_responses(spark.createDataFrame([("A", 0, text)], "company string, chunk_no long, response string"))
    assert {r.url: r.keep for r in D.response_decisions(parsed).collect()} == {"a": True, "b": True, "c": False, "d": False, "e": False, "f": True, "g": False}


def test_persisted_ties(spark):
    log = [
        # url, keep, reason, seq, run, real
        ("u1", True, "a", 1, "2024-01-01", True), ("u1", False, "b", 9, "2024-01-02", True), ("u1", True, "c", 99, "2024-01-03", False),
        # Inside one run: group (True, x) first appears at 5, group (False, y) at 2, so x is written later.
        ("u2", False, "y", 2, "2024-01-01", True), ("u3", True, "x", 5, "2024-01-01", True),
        ("u2", True, "x", 6, "2024-01-01", True), ("u3", False, "y", 7, "2024-01-01", True),
        ("u4", True, "z" * 600, 8, "2024-01-01", True),
    ]
    df = spark.createDataFrame(log, "url string, keep boolean, reason string, seq long, run_date string, is_real boolean")
    got = {r.url: (r.ai_keep, r.ai_reason) for r in D.persisted(D.with_group_positions(df)).collect()}
    assert got == {"u1": (False, "b"), "u2": (True, "x"), "u3": (True, "x"), "u4": (True, "z" * 500)}


def test_decision_by_url_reaches_every_company(spark):
    state = spark.createDataFrame([("a", "u"), ("b", "u"), ("a", "v")], "company_id string, url string")
    final = spark.createDataFrame([("u", False, "no")], "url string, ai_keep boolean, ai_reason string")
    got = {(r.company_id, r.url): r.ai_keep for r in D.with_decisions(state, final).collect()}
    assert got == {("a", "u"): False, ("b", "u"): False, ("a", "v"): None}


def test_empty_input_gives_no_decisions(spark):
    none = spark.createDataFrame([], "company string, url string")
    assert D.keep_all(none).count() == 0
