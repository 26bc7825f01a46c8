import html
import time

from pyspark.sql import functions as F

from sightline.functions import text as T



def test_norm_and_strip(column):
    rows = ["  a   b\n\tc　", "", "x"]
    assert column(rows, "s string", T.norm_text(F.col("s"))) == ["a b c", "", "x"]
    assert column(["  x y\x85\n"], "s string", T.strip(F.col("s"))) == ["x y"]


def test_unescape_equals_the_standard_library(column):
    rows = [
        "a &amp; b", "&amp;lt;", "&lt;b&gt; &quot;x&quot; &#39;y&#x27;", "Espa&ntilde;a &euro;5", "&nbsp;&copy;",
        "&unknown; & &", "&#128512;&#x1F600;", "no entity", "",
    ]
    assert column(rows, "s string", T.unescape(F.col("s"))) == [html.unescape(r) for r in rows]


def test_opaque_ids(column):
    rows = ["H0yXGelmdoB7XrPrUxH", "AbCdEf", "Analyst", "25000ABC", "abc12", "aBcDe", "ABCdefGHIj", "McKinseyCo"]
    assert column(rows, "s string", T.is_opaque_id(F.col("s"))) == [True, True, False, False, False, False, False, True]


def test_slug_titles(column):
    cases = {
        "https://x.com/en/job-offers/2027-global-markets-summer-analyst-25000ABC": "2027 Global Markets Summer Analyst",
        # The id stays when a single letter trails it.
        "https://x.com/en/2027-summer-analyst-25000ABC-e": "2027 Summer Analyst 25000ABC",
        "https://x.com/jobs/H0yXGelmdoB7XrPrUxH-Og": None,
        "https://x.com/sales-director-portugal/45831/94440340720": "Sales Director Portugal",
        "https://x.com/property_manager-madrid-12-3/": "Property Manager Madrid",
        "https://x.com/": None,
        "https://x.com/job": None,
        "https://x.com/a-b": None,
        "https://x.com/jefe-de-compañía": "Jefe De Compañía",
    }
    assert column(list(cases), "s string", T.slug_title(F.col("s"))) == list(cases.values())


def test_real_titles(column):
    cases = {
        "Summer Analyst": True, "Internship": False, "View job": False, "a b": False, "Data": False,
        "x" * 150 + " y" * 30: False, "  Risk Officer ": True, "human RESOURCES": False, "": False,
    }
    assert column(list(cases), "s string", T.real_title(F.col("s"))) == list(cases.values())


def test_title_pick(column):
    rows = [
        ("Corporate and Investment Banking Department\nSales Director\nMadrid", "https://x/sales-director/1", "Sales Director"),
        ("Corporate and Investment Banking\nSales Director\nMadrid", "", "Corporate and Investment Banking"),
        ("Risk Analyst Expires: 1/2/2024", "", "Risk Analyst"),
        ("apply\nabc\nMadrid", "", "apply"),                      # nothing acceptable: first line
        ("Apply now\n\n  Junior Analyst expires 3\nMadrid", "", "Junior Analyst expires 3"),
        ("aaa bbb\nccc ddd\nx", "", "aaa bbb"),                   # same length: the first
        ("L" + "o" * 160 + " ng\n" + "S" + "o" * 155 + " ng", "", "S" + "o" * 155 + " ng"),
        ("", "", ""),
        (" \n ", "", ""),
    ]
    got = column([r[:2] for r in rows], "s string, u string", T.title_pick(F.col("s"), T.slug_title(F.col("u"))))
    assert got == [r[2] for r in rows]


def test_slugify(column):
    assert column(["Analista M&A — España!", "x" * 100], "s string", T.slugify(F.col("s"))) == ["analista-m-a-espa-a", "x" * 80]


def test_usual_entities_need_no_search(spark):
    """Markup in an attribute is full of them (F6)."""
    def took(entity):
        rows = spark.range(2).select(F.repeat(F.concat(F.lit(entity), "id"), 50_000).alias("s"))
        start = time.perf_counter()
        assert rows.select(F.max(F.length(T.unescape(F.col("s"))))).first()[0] == 100_000
        return time.perf_counter() - start

    took("&amp;")
    assert took("&quot;") * 3 < took("&zwj;")
