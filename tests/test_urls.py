from urllib.parse import parse_qsl, urljoin, urlparse

from pyspark.sql import functions as F

from sightline.functions import urls as U

URLS = [
    "https://higher.gs.com/campus?LOCATION=Madrid|London&page=1",
    "https://careers.socgen.com/en/search?refinementList[jobType][0]=INTERNSHIP&x=a b",
    "https://h.com/a;b=1/c;d=2?q#f?g#h",
    "//h.com/p", "/p?q", "?q", "#f", "", "mailto:a@b.c", "HTTP://User@H.com:80/P",
]


def test_parts_equal_the_standard_library(column):
    for part in ("scheme", "netloc", "path", "query", "fragment"):
        want = [getattr(urlparse(u), part) for u in URLS]
        assert column(URLS, "u string", U.url_part(F.col("u"), part)) == want, part
        assert column(URLS, "u string", U.url_parts(F.col("u"))[part]) == want, part
    hosts = [urlparse(u).hostname or "" for u in URLS]
    assert column(URLS, "u string", U.url_part(F.col("u"), "host")) == hosts


def test_join_equals_the_standard_library(column):
    bases = ["http://h.com/a/b/c?q#f", "https://h.com", "http://h.com/a/", "http://h.com/a;z/b;c?x|y [1]"]
    refs = [
        "", "x", "../x", "./y/", "//h2/p?", "/a//b", "/a/../b", "?q=1", "#f", "#", "http://z/q#", "mailto:a@b",
        "a;p=1?x#", "..", "x/..", "https://h/a?", "../../../up", "a//b", "x?y?", "javascript:void(0)",
    ]
    pairs = [(b, r) for b in bases for r in refs]
    got = column(pairs, "u string, r string", U.url_join(F.col("u"), F.col("r")))
    assert [p + (g,) for p, g in zip(pairs, got)] == [p + (urljoin(*p),) for p in pairs]


def test_query_params_equal_the_standard_library(column):
    queries = ["a=1&a=2&b=%20x+y&empty=&bare&=v&c=d=e", "", "x|y=1&z=[2]", "bad=%zz"]
    got = column(queries, "u string", U.query_params(F.col("u")))
    assert [[(p.name, p.value) for p in ps] for ps in got] == [parse_qsl(q) for q in queries]


def test_facets_keep_repeats_and_drop_tracking(column):
    got = column(["f=a&source=x&f=b&utm_term=y&g=c"], "u string", U.grouped_params(U.facet_params(F.col("u"))))
    assert got == [{"f": ["a", "b"], "g": ["c"]}]


def test_canonical_keys(column):
    cases = {
        "https://x.com/jobs#job-R00297547_es": "r00297547_es",
        "https://x.com/jobdetails?id=R00297547_es&title=a": "r00297547_es",
        "https://x.com/jobs#JobAbc": "abc",
        "https://x.com/jobs#job-": "-",
        "https://x.com/jobs?myid=12345": "https://x.com/jobs?myid=12345",
        "https://x.com/jobs?a-id=12345": "12345",
        "https://x.com/jobs?id=123": "https://x.com/jobs?id=123",
        "https://x.com/jobs/12345-Analyst/": "12345-analyst",
        "https://x.com/Jobs/Data": "https://x.com/jobs/data",
    }
    assert column(list(cases), "u string", U.canonical_key(F.col("u"))) == list(cases.values())


def test_strip_locale(column):
    cases = {
        "/es-es/careers/": "/careers", "/es/": "/", "/en_GB/a/b": "/a/b", "/esp/a/": "/esp/a", "/careers/": "/careers",
        "": "", "/": "", "/EN/a": "/EN/a",
    }
    assert column(list(cases), "u string", U.strip_locale(F.col("u"))) == list(cases.values())
