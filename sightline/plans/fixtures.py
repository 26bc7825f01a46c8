"""Inputs of the registered queries, derived from the given tables by plain SELECTs.

Each SELECT runs in Spark and, spelt the same, at the head of the check SQL. Every row of a table
takes part; remainders only vary the derived values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
LAST_RUN = "2024-01-30"

PLACES = [
    "Madrid, Spain", "Barcelona", "London, UK", "Sevilla, Spain", "España", "New York",
    "Glasgow, United Kingdom", "", None, "León", "Madrid / Barcelona", "Milton Keynes, England",
]


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def cases(key: str, values: list[str | None]) -> str:
    """A value picked by the remainder of an integer key."""
    whens = " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {whens} END"


TITLES = [
    "Summer Analyst", "Off-Cycle Internship Madrid", "Director of Sales", "",
    " Risk & Compliance Officer ", "Business Analyst - Spain", "M&A Analyst (London)",
    "Dependiente/a", "Data Engineer", "Students & Graduates opportunities in Spain",
]

CAREERS_URLS = [
    "https://acme.wd3.myworkdayjobs.com/en-US/External?source=x&locations=3b74&jobFamily=a&jobFamily=b",
    "https://www.alantra.com/careers/apply/",
    "https://careers.bcg.com/global/en/search-results",
    "https://bdo.epreselec.com/Ofertas/Ofertas.aspx",
    "https://www.acciona.com/our-purpose/work-with-us/job-offers",
    "https://empleo.es.deloitte.com/search/?q=&startrow=25&sort=x y#top",
    "https://jobs.ca-cib.com/job/list-of-jobs.aspx",
    "https://www.dcadvisory.com/careers/?location=spain",
    "https://eyglobal.yello.co/job_boards/c1riT--B2O?locale=en",
    "https://www.mckinsey.com/careers/students",
    "https://mediobanca.com/en/work-with-us/open-positions.html",
    "https://www.morganstanley.com/careers/search?opportunity=ep&opportunity=sg",
    "https://careers.marsh.com/global/en/Oliver-Wyman-search",
    "https://careers.marsh.com/global/en/other",
    "https://www.pwc.es/es/carrera-profesional.html",
    "https://firm.tal.net/vx/lang-en-GB/brand-6/candidate/jobboard/vacancy/2/adv/",
    "https://jobs.ubs.com/TGnewUI/Search/home?PageType=searchResults#keyWordSearch=",
    "https://higher.gs.com/campus?LOCATION=Madrid|London&page=1",
    "https://boards.example.com/acme",
    "https://user@jobs.ubs.com:443/x",
    None,
]

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_BASE_URL = "split_part(split_part(url, '#', 1), '?', 1)"

FIXTURES: dict[str, str] = {
    "sightings": f"""
        SELECT CAST(ts AS DATE) AS run_date, CAST(user_id AS STRING) AS company_id, event_id AS seq,
               concat('https://jobs.example.com/', user_id, '/job/', event_id % 7) AS url,
               concat(event_type, ' role ', event_id % 7) AS title,
               {cases("event_id", PLACES)} AS location,
               event_type AS department,
               CASE WHEN value > 40 THEN 'Full-time' END AS job_type
        FROM {{events}}""",
    "failures": """
        SELECT CAST(ts AS DATE) AS run_date, CAST(user_id AS STRING) AS company_id,
               concat('timeout after ', CAST(CAST(FLOOR(max(value)) AS BIGINT) AS STRING), ' s') AS error
        FROM {events} WHERE event_type = 'error' AND value > 80
        GROUP BY CAST(ts AS DATE), CAST(user_id AS STRING)""",
    "companies": """
        SELECT CAST(CASE WHEN c_acctbal > 0 THEN c_custkey ELSE c_custkey + 1000000000 END AS STRING) AS company_id, c_name AS name
        FROM {customer}""",
    "catalog": f"""
        SELECT CAST(c_custkey AS STRING) AS company_id, c_name AS name,
               {cases("c_custkey", ["playwright", "workday", "greenhouse", "lever", "html", "taleo", None])} AS ats,
               {cases("c_custkey", CAREERS_URLS)} AS careers_url,
               {cases("c_nationkey", ["Madrid|London", "", None, "Sevilla", "london"])} AS location_filter,
               CASE WHEN c_acctbal > 5000 THEN 'Bank_Business_Line' END AS acciona_division,
               concat('board', c_custkey) AS greenhouse_id, concat('site', c_custkey) AS lever_id
        FROM {{customer}}""",
    "docs": f"""
        SELECT doc_id, concat('https://', source, '.example.com/job/', doc_id) AS url,
               source AS company_id, source AS company, split_part(text, chr(10), 1) AS title,
               {cases("doc_id", PLACES)} AS location, lang AS department,
               CASE WHEN n_chars > 1000 THEN 'Full-time' END AS job_type, text AS description,
               CAST(DATE '2024-01-31' - CAST(doc_id % 14 AS INT) AS {{TS}}) AS first_seen_at,
               doc_id % 11 <> 3 AS is_active
        FROM {{documents}}""",
    "verdicts": """
        SELECT concat('https://', d.source, '.example.com/job/', d.doc_id) AS url,
               d.source AS company, quality = 1 AS keep,
               concat(CASE WHEN toxic = 1 THEN 'off ' ELSE 'good ' END, 'fit for ', d.lang) AS reason,
               d.doc_id AS seq, DATE '2024-01-30' - CAST(d.doc_id % 3 AS INT) AS run_date,
               quality + toxic > 0 AS is_real
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "decision_log": """
        SELECT concat('https://', d.source, '.example.com/job/', d.doc_id) AS url, quality = 1 AS keep,
               concat('fit for ', d.lang) AS reason, d.doc_id AS seq,
               DATE '2024-01-30' - CAST(d.doc_id % 3 AS INT) AS run_date, true AS is_real
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
        UNION ALL
        SELECT concat('https://', d.source, '.example.com/job/', d.doc_id), toxic = 0,
               concat('again ', d.lang, ' ', d.doc_id % 2), 1000000000 - d.doc_id,
               DATE '2024-01-30' - CAST(d.doc_id % 2 AS INT), quality = 1
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "portals": """
        SELECT DISTINCT CASE WHEN source = 'src3' THEN 'no source' ELSE source END AS company_id, concat('Portal ', source) AS name
        FROM {documents}""",
    "postings": f"""
        SELECT o_orderkey AS id, CAST(FLOOR(o_orderkey / 1000) AS BIGINT) AS portal,
               CAST(FLOOR((o_orderkey % 1000) / 50) AS INT) AS page_idx,
               CAST(o_orderkey % 50 AS INT) AS pos, o_custkey AS ref,
               {cases("o_custkey", TITLES)} AS title,
               {cases("o_orderkey", PLACES)} AS location,
               o_orderpriority AS department, o_orderstatus AS job_type,
               repeat(concat(o_orderpriority, ' ', o_custkey, ' é. '), 40) AS description,
               o_totalprice AS price
        FROM {{orders}}""",
    "url_cases": f"""
        SELECT page_id, 0 AS variant, url FROM {{pages}}
        UNION ALL SELECT page_id, 1, concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'jobId=R-', page_id + 10000) FROM {{pages}}
        UNION ALL SELECT page_id, 2, concat(split_part(url, '#', 1), '#job-', page_id, '_ES') FROM {{pages}}
        UNION ALL SELECT page_id, 3, concat({_BASE_URL}, '/2027-global-markets-summer-analyst-', page_id + 25000, 'ABC-e/') FROM {{pages}}
        UNION ALL SELECT page_id, 4, concat({_BASE_URL}, '/a|b [c]?x=1&x=2&utm_source=mail&empty=&bare&y=%20z+w&z=', page_id) FROM {{pages}}
        UNION ALL SELECT page_id, 5, concat({_BASE_URL}, '/AbCdEf', page_id, '/senior_data-engineer') FROM {{pages}}""",
}


def tables(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    return {
        t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql
    }


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name].replace("{TS}", "TIMESTAMP_NTZ")
    return spark.sql(sql, **tables(spark, sf_dir, sql))


def with_fixtures(*names: str) -> str:
    """WITH clause of the named fixtures for the check SQL."""
    plain = {t: t for t in TABLES} | {"TS": "TIMESTAMP"}
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n].format(**plain)})" for n in names)
