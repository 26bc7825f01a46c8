"""Queries on text, URL and place columns, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import madrid_hour
from ..functions.location import compile_filter, compile_filter_column, location_match
from ..functions.text import (
    is_opaque_id, norm_text, real_title, slug_title, slugify, title_pick, unescape,
)
from ..functions.urls import (
    canonical_key, facet_params, query_params, strip_locale, url_join, url_part,
)
from ..functions import vocab
from ..operators.dedupe import first_by
from ..operators.discovery import flatten_json, job_score
from ..sources.markup_portals import links_from_html
from .check_sql import (
    WS, location_by_filter, location_sql, normal, real_title_sql, slug_sql, sql_in, stripped,
)
from .fixtures import cases, fixture, with_fixtures
from .registry import query


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


# --- places -----------------------------------------------------------------------------------

@query("location_match_madrid", with_fixtures("postings") + f"""
SELECT id, location, {location_sql("location", "Madrid")} AS matched FROM postings""")
def location_match_madrid(spark, sf_dir):
    rows = fixture(spark, sf_dir, "postings")
    return rows.select("id", "location", location_match(F.col("location"), "Madrid").alias("matched"))


_FILTERS = ["Madrid|London", "Madrid", "Sevilla", "london", "León, Spain", "New York"]
_TEXT = "concat(title, ' - ', coalesce(location, ''))"


@query("location_match_multi", with_fixtures("postings") + f""",
asked AS (SELECT id, {_TEXT} AS t, {cases("ref", _FILTERS)} AS places FROM postings)
SELECT id, places, {location_by_filter("t", "places", _FILTERS)} AS matched FROM asked""")
def location_match_multi(spark, sf_dir):
    """The filter comes from a column; it is compiled once per distinct filter and joined."""
    rows = fixture(spark, sf_dir, "postings").select(
        "id", F.expr(_TEXT).alias("t"), F.expr(cases("ref", _FILTERS)).alias("places")
    )
    compiled = rows.select("places").distinct().withColumn("terms", compile_filter_column(F.col("places")))
    match = location_match(F.col("t"), F.col("terms"))
    return rows.join(compiled, "places").select("id", "places", match.alias("matched"))


# Words of the generated prose stand for places here.
_PROSE_FILTER = "rewh, inoran"
_PROSE_TERMS = {"rewh": ["rewh", "hehely", "on the"], "inoran": ["inoran"]}
_PROSE_PEERS = {"en": ["rewh", "orre", "thatin", "of the"], "es": ["ononst", "ción"]}


@query("location_match_scale", f"""SELECT doc_id,
  {location_sql("text", _PROSE_FILTER, _PROSE_TERMS, _PROSE_PEERS)} AS matched FROM documents""")
def location_match_scale(spark, sf_dir):
    places = compile_filter(_PROSE_FILTER, _PROSE_TERMS, _PROSE_PEERS)
    return _docs(spark, sf_dir).select("doc_id", location_match(F.col("text"), places).alias("matched"))


# --- titles and text --------------------------------------------------------------------------

@query("norm_text", f"SELECT doc_id, {normal('text')} AS text FROM documents")
def norm(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", norm_text(F.col("text")).alias("text"))


_PICK = rf"""
WITH lines AS (
  SELECT doc_id, i, {stripped("line")} AS line FROM (
    SELECT doc_id, unnest(string_split_regex(text, '[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]+')) AS line,
           generate_subscripts(string_split_regex(text, '[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]+'), 1) AS i
    FROM documents) WHERE {stripped("line")} <> ''),
clean AS (SELECT doc_id, i, line, {stripped(f"regexp_replace(line, '(?i){WS}*expires?:{WS}*[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}', '', 'g')")} AS c FROM lines),
firsts AS (SELECT doc_id, arg_min(c, i) AS first_line, count(*) AS n FROM clean GROUP BY ALL),
usable AS (SELECT doc_id, i, c FROM clean WHERE length(c) >= 4 AND lower(c) NOT IN {sql_in(vocab.GENERIC_TITLES)}
    AND (regexp_matches(c, '{WS}') OR length(c) >= 15)),
longest AS (SELECT doc_id, c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(c) DESC, i) AS rn FROM usable WHERE length(c) <= 150) WHERE rn = 1),
shortest AS (SELECT doc_id, c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(c), i DESC) AS rn FROM usable) WHERE rn = 1)
SELECT d.doc_id, CASE WHEN f.n IS NULL THEN '' WHEN f.n = 1 THEN f.first_line ELSE coalesce(l.c, s.c, f.first_line) END AS title
FROM documents d LEFT JOIN firsts f USING (doc_id) LEFT JOIN longest l USING (doc_id) LEFT JOIN shortest s USING (doc_id)"""


@query("title_pick", _PICK)
def pick(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", title_pick(F.col("text")).alias("title"))


# Every line of every document as a title.
_LINES_SQL = """doc_lines AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS title
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


def _lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "title"))


@query("real_title", with_fixtures("postings") + f""", {_LINES_SQL}
SELECT 'doc' AS kind, doc_id AS id, line_no, {real_title_sql("title")} AS is_real FROM doc_lines
UNION ALL SELECT 'posting', id, 0, {real_title_sql("title")} FROM postings""")
def real(spark, sf_dir):
    docs = _lines(spark, sf_dir).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "line_no", "title")
    posts = fixture(spark, sf_dir, "postings").select(F.lit("posting").alias("kind"), "id", F.lit(0).alias("line_no"), "title")
    return docs.unionByName(posts).select("kind", "id", "line_no", real_title(F.col("title")).alias("is_real"))


@query("slugify", f"WITH {_LINES_SQL} SELECT doc_id, line_no, {slug_sql('title')} AS slug FROM doc_lines")
def slug(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", slugify(F.col("title")).alias("slug"))


_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&copy;": "©", "&middot;": "·", "&nbsp;": " "}


def _unescaped_sql(s: str) -> str:
    for entity, char in _ENTITIES.items():
        s = f"replace({s}, '{entity}', '{char}')"
    return f"replace({s}, '&amp;', '&')"


@query("unescape", f"SELECT page_id, {_unescaped_sql('html')} AS html FROM pages")
def entities(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", unescape(F.col("html")).alias("html"))


@query("opaque_id", with_fixtures("url_cases") + r""",
words AS (SELECT page_id, variant, unnest(string_split_regex(url, '[^A-Za-z0-9]+')) AS word FROM url_cases)
SELECT page_id, CAST(variant AS BIGINT) AS variant, word, length(word) >= 6 AND (
    (regexp_matches(word, '[A-Z]') AND regexp_matches(word, '[a-z]') AND regexp_matches(word, '[0-9]'))
    OR len(regexp_extract_all(word, '[A-Z]+|[^A-Z]+')) >= 5) AS is_opaque FROM words""")
def opaque(spark, sf_dir):
    words = fixture(spark, sf_dir, "url_cases").select(
        "page_id", "variant", F.explode(F.split("url", "[^A-Za-z0-9]+")).alias("word")
    )
    return words.select("page_id", "variant", "word", is_opaque_id(F.col("word")).alias("is_opaque"))


# --- URLs -------------------------------------------------------------------------------------

_PARTS = with_fixtures("url_cases") + """,
cut AS (SELECT page_id, variant, url, split_part(url, '#', 1) AS whole, split_part(split_part(url, '#', 1), '?', 1) AS hier FROM url_cases),
parts AS (SELECT page_id, variant, url, hier, split_part(hier, '://', 1) AS scheme, split_part(split_part(hier, '://', 2), '/', 1) AS netloc,
    substr(hier, length(split_part(hier, '://', 1)) + 4 + length(split_part(split_part(hier, '://', 2), '/', 1))) AS path,
    substr(whole, length(hier) + 2) AS query, substr(url, length(whole) + 2) AS fragment FROM cut)
"""


@query("url_parts", _PARTS + "SELECT page_id, CAST(variant AS BIGINT) AS variant, scheme, netloc, path, query, fragment FROM parts")
def parts(spark, sf_dir):
    u = F.col("url")
    names = ["scheme", "netloc", "path", "query", "fragment"]
    return fixture(spark, sf_dir, "url_cases").select("page_id", "variant", *[url_part(u, n).alias(n) for n in names])


_REFS = ["jobs/x.html", "/a//b?x=1#y", "?q=1", "#f", "../up", "//other.example.org/p", "https://else.example.org/z?q#", "./here/", "", "mailto:a@b.c"]


@query("url_join", _PARTS + f""",
refs AS (SELECT *, unnest({_REFS}) AS ref, regexp_replace(path, '[^/]*$', '') AS folder, concat(scheme, '://', netloc) AS origin FROM parts WHERE variant = 0)
SELECT page_id, ref, CASE ref WHEN 'jobs/x.html' THEN concat(origin, folder, ref) WHEN '/a//b?x=1#y' THEN concat(origin, ref)
  WHEN '?q=1' THEN concat(hier, ref) WHEN '#f' THEN concat(split_part(url, '#', 1), ref)
  WHEN '../up' THEN concat(origin, regexp_replace(folder, '[^/]+/$', ''), 'up') WHEN '//other.example.org/p' THEN concat(scheme, ':', ref)
  WHEN 'https://else.example.org/z?q#' THEN CASE scheme WHEN 'https' THEN 'https://else.example.org/z?q' ELSE ref END
  WHEN './here/' THEN concat(origin, folder, 'here/') WHEN '' THEN url ELSE ref END AS joined FROM refs""")
def join_urls(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", "url", F.explode(F.lit(_REFS)).alias("ref"))
    return rows.select("page_id", "ref", url_join(F.col("url"), F.col("ref")).alias("joined"))


@query("canonical_key", _PARTS + """
SELECT page_id, CAST(variant AS BIGINT) AS variant, CASE WHEN variant = 1 AND fragment = '' THEN concat('r-', page_id + 10000)
  WHEN variant = 2 THEN concat(page_id, '_es') WHEN variant = 3 THEN concat('2027-global-markets-summer-analyst-', page_id + 25000, 'abc-e')
  ELSE lower(url) END AS job_key FROM parts""")
def keys(spark, sf_dir):
    return fixture(spark, sf_dir, "url_cases").select("page_id", "variant", canonical_key(F.col("url")).alias("job_key"))


@query("slug_title", with_fixtures("url_cases") + """
SELECT page_id, CAST(variant AS BIGINT) AS variant, CASE variant WHEN 3 THEN concat('2027 Global Markets Summer Analyst ', page_id + 25000, 'ABC')
  WHEN 5 THEN 'Senior Data Engineer' END AS title FROM url_cases""")
def slug_titles(spark, sf_dir):
    return fixture(spark, sf_dir, "url_cases").select("page_id", "variant", slug_title(F.col("url")).alias("title"))


@query("strip_locale", _PARTS + """, bits AS (SELECT *, string_split(trim(path, '/'), '/') AS bit FROM parts)
SELECT page_id, CAST(variant AS BIGINT) AS variant, CASE WHEN regexp_full_match(bit[1], '[a-z]{2}([-_][A-Za-z]{2})?')
  THEN concat('/', array_to_string(bit[2:], '/')) ELSE rtrim(path, '/') END AS path FROM bits""")
def locales(spark, sf_dir):
    path = url_part(F.col("url"), "path")
    return fixture(spark, sf_dir, "url_cases").select("page_id", "variant", strip_locale(path).alias("path"))


@query("query_params", _PARTS + f""",
pairs AS (SELECT *, list_transform(list_filter(string_split(query, '&'), lambda p: regexp_matches(p, '^[^=]*=.')),
    lambda p: [split_part(p, '=', 1), url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' '))]) AS ps FROM parts)
SELECT page_id, CAST(variant AS BIGINT) AS variant, array_to_string(list_transform(ps, lambda p: concat(p[1], '=', p[2])), ';') AS params,
  array_to_string(list_transform(list_filter(ps, lambda p: p[1] NOT IN {sql_in(vocab.TRACKING_PARAMS)}), lambda p: concat(p[1], '=', p[2])), ';') AS facets FROM pairs""")
def params(spark, sf_dir):
    q = url_part(F.col("url"), "query")
    show = lambda ps: F.array_join(F.transform(ps, lambda p: F.concat(p["name"], F.lit("="), p["value"])), ";")
    return fixture(spark, sf_dir, "url_cases").select(
        "page_id", "variant", show(query_params(q)).alias("params"), show(facet_params(q)).alias("facets")
    )


# --- first occurrence, JSON, hours ------------------------------------------------------------

_ANCHORS = """WITH anchors AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS pos FROM pages)
"""


def page_links(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", F.col("url").alias("careers_url"), F.col("html").alias("body"))
    return links_from_html(pages)


@query("first_occurrence", _ANCHORS + """
SELECT href, page_id, text FROM (SELECT *, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS rn FROM anchors) WHERE rn = 1""")
def first_occurrence(spark, sf_dir):
    return first_by(page_links(spark, sf_dir), ["href"], ["page_id", "pos"]).select("href", "page_id", "text")


# JSON values of six kinds with the order key inside.
_JSON_VALUE = """CASE o_orderkey % 7 WHEN 0 THEN concat('"Madrid \\\\u00e9 ', o_orderkey, '"') WHEN 1 THEN CAST(o_orderkey AS STRING) WHEN 2 THEN 'true'
  WHEN 3 THEN concat('["a", null, [], {{"label": "x', o_orderkey, '", "q": 1}}]') WHEN 4 THEN concat('{{"zone": "Z', o_orderkey, '", "area": ["b", 2.5], "no": null}}')
  WHEN 5 THEN concat('{{"q": 1, "City": {{"text": "T', o_orderkey, '"}}}}') ELSE '""' END""".replace("{{", "{").replace("}}", "}")


@query("flatten_json", """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN concat('Madrid é ', o_orderkey)
  WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN 'True' WHEN 3 THEN concat('a, x', o_orderkey)
  WHEN 4 THEN concat('Z', o_orderkey, ', b, 2.5') WHEN 5 THEN concat('T', o_orderkey) ELSE '' END AS text FROM orders""")
def flattened(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = orders.select(F.col("o_orderkey").alias("id"), F.expr(_JSON_VALUE).alias("raw"))
    return raw.select("id", flatten_json(F.col("raw")).alias("text"))


_JSON_OBJECT = """concat('{"', CASE o_orderkey % 3 WHEN 0 THEN 'Title' WHEN 1 THEN 'displayJobTitle' ELSE 'heading' END, '": "', o_orderpriority, '", "',
  CASE o_custkey % 2 WHEN 0 THEN 'URL' ELSE 'uri' END, '": ', CASE o_orderkey % 5 WHEN 0 THEN '""' ELSE '"/x"' END,
  ', "jobId": ', CASE o_custkey % 3 WHEN 0 THEN 'null' ELSE '0' END, ', "City": ', CASE o_custkey % 5 WHEN 0 THEN '[]' ELSE '{}' END,
  ', "team": ', CASE o_orderstatus WHEN 'P' THEN '""' ELSE 'false' END, '}')"""


@query("json_score", """SELECT o_orderkey AS id, CAST((o_orderkey % 3 < 2)::INT + (o_custkey % 2 = 0 AND o_orderkey % 5 <> 0)::INT
  + (o_custkey % 3 <> 0)::INT + (o_custkey % 5 <> 0)::INT + (o_orderstatus <> 'P')::INT AS BIGINT) AS score FROM orders""")
def scores(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("id"), job_score(F.expr(_JSON_OBJECT)).alias("score"))


@query("madrid_hour_filter", """SELECT event_id, hour(timezone('Europe/Madrid', timezone('UTC', ts + to_days(CAST(event_id % 365 AS INT))))) AS madrid_hour FROM events
WHERE hour(timezone('Europe/Madrid', timezone('UTC', ts + to_days(CAST(event_id % 365 AS INT))))) = 7""")
def on_schedule(spark, sf_dir):
    """Times moved over a year, so that summer time takes part; only the scheduled hour stays."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    moved = F.col("ts") + F.make_dt_interval((F.col("event_id") % 365).cast("int"))
    hours = events.select("event_id", madrid_hour(moved).alias("madrid_hour"))
    return hours.where(F.col("madrid_hour") == 7)
