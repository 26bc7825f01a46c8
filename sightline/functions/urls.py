"""URL columns by the RFC 3986 split.

``parse_url`` raises, and ``try_parse_url`` gives null, on a bar, a bracket or a blank, and portals
do use such URLs; a regular expression never fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_GROUPS = {"scheme": 1, "netloc": 2, "rawpath": 3, "query": 4, "fragment": 5}


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def named(**fields: Column) -> Column:
    """Struct with fixed names; inside nested lambdas an aliased struct can lose them."""
    return F.named_struct(*[x for n, c in fields.items() for x in (F.lit(n), c)])


def url_part(url: Column, part: str) -> Column:
    """One part of a URL; absent parts are empty text.

    ``path`` leaves out the parameters after ``;`` in its last segment; ``host`` is the lower-cased
    authority without user and port.
    """
    if part == "path":
        return F.regexp_replace(url_part(url, "rawpath"), ";[^/]*$", "")
    if part == "host":
        no_user = F.regexp_replace(url_part(url, "netloc"), "^.*@", "")
        return F.lower(F.regexp_replace(no_user, r":\d*$", ""))
    found = F.regexp_extract(url, _URL, _GROUPS[part])
    return F.lower(found) if part == "scheme" else found


def url_parts(url: Column) -> Column:
    """All parts of a URL as one struct, from a single match; bind it with ``let`` to reuse it."""
    mark = "\x01"
    cut = F.split(F.regexp_replace(url, _URL, mark.join(f"${g}" for g in range(1, 6))), mark)
    return let(
        cut,
        lambda c: named(
            scheme=F.lower(c[0]), netloc=c[1], rawpath=c[2],
            path=F.regexp_replace(c[2], ";[^/]*$", ""), query=c[3], fragment=c[4],
        ),
    )


def root_domain(netloc: Column) -> Column:
    """Last two labels of a host."""
    return F.substring_index(netloc, ".", -2)


def strip_locale(path: Column) -> Column:
    """``/es-es/careers`` to ``/careers``; the stripped form keeps no trailing slash."""
    bare = F.regexp_replace(path, "^/+|/+$", "")
    locale = "^[a-z]{2}(?:[-_][A-Za-z]{2})?(?:/|$)"
    return F.when(
        bare.rlike(locale), F.concat(F.lit("/"), F.regexp_replace(bare, locale, ""))
    ).otherwise(F.regexp_replace(path, "/+$", ""))


def _tidy_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    kept = F.reduce(
        F.filter(segments, lambda s: s != "."),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(s))),
    )
    open_end = F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(
        F.lit("/"), F.array_join(kept, "/"), F.when(open_end, "/").otherwise("")
    )


def _tidy_marks(s: Column) -> Column:
    """Drop a query or fragment mark that nothing follows."""
    no_fragment = F.regexp_replace(s, "^([^#]*)#$", "$1")
    return F.regexp_replace(no_fragment, r"^([^?#]*)\?(#|$)", "$1$2")


def url_join(base: Column, ref: Column) -> Column:
    """Absolute form of a link found on ``base``."""
    return let(url_parts(base), lambda b: let(url_parts(ref), lambda r: _joined(base, b, ref, r)))


def _joined(base: Column, b: Column, ref: Column, r: Column) -> Column:
    origin = F.concat(b["scheme"], F.lit("://"), b["netloc"])
    folder = F.regexp_replace(F.concat(F.lit("/"), b["rawpath"]), "[^/]*$", "")
    tail = _tidy_marks(F.substr(ref, F.length(r["rawpath"]) + 1))
    whole = _tidy_marks(ref)
    merged = F.when(r["rawpath"].startswith("/"), r["rawpath"]).otherwise(
        F.regexp_replace(F.concat(folder, r["rawpath"]), "/+", "/")
    )
    path = F.when(
        merged.rlike(r"/\.{1,2}(?:/|$)"), _tidy_path(merged)
    ).otherwise(merged)
    return (
        F.when(ref == "", base)
        .when(~r["scheme"].isin("", "http", "https"), ref)
        .when(r["scheme"] != "", F.when(r["scheme"] == b["scheme"], whole).otherwise(ref))
        .when(ref.startswith("//"), F.concat(b["scheme"], F.lit(":"), whole))
        .when(ref.startswith("?"), F.concat(origin, b["rawpath"], whole))
        .when(
            ref.startswith("#"),
            F.concat(F.regexp_replace(base, "#.*$", ""), F.regexp_replace(ref, "^#$", "")),
        )
        .otherwise(F.concat(origin, path, tail))
    )


def query_params(query: Column) -> Column:
    """Name/value pairs in order, repeats kept, decoded; pairs without a value are dropped."""

    def decoded(s: Column) -> Column:
        return F.coalesce(F.try_url_decode(s), F.replace(s, F.lit("+"), F.lit(" ")))

    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    return F.transform(
        pairs,
        lambda p: named(
            name=decoded(F.substring_index(p, "=", 1)),
            value=decoded(F.regexp_replace(p, "(?s)^[^=]*=", "")),
        ),
    )


def first_param(query: Column, name: str, default: str) -> Column:
    hit = F.get(F.filter(query_params(query), lambda p: p["name"] == name), F.lit(0))
    return F.coalesce(hit["value"], F.lit(default))


def facet_params(query: Column) -> Column:
    """Parameters that name a facet: everything but tracking."""
    return F.filter(query_params(query), lambda p: ~p["name"].isin(*vocab.TRACKING_PARAMS))


def grouped_params(pairs: Column) -> Column:
    """Map of name to the list of its values."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    values = F.transform(
        names,
        lambda n: F.transform(
            F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"]
        ),
    )
    return F.map_from_arrays(names, values)


def canonical_key(url: Column) -> Column:
    """One key for the same posting reached through different URLs."""
    names = "|".join(vocab.CANONICAL_ID_KEYS)
    id_param = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{names})=([A-Za-z0-9_-]{{4,}})"

    def key(p: Column) -> Column:
        by_fragment = F.regexp_extract(p["fragment"], "(?i)^job[-_]?(.+)$", 1)
        by_query = F.regexp_extract(p["query"], id_param, 1)
        tail = F.regexp_extract(p["path"], "([^/]*)/*$", 1)
        return (
            F.when(by_fragment != "", by_fragment)
            .when(by_query != "", by_query)
            .when(tail.rlike(r"\d{4,}"), tail)
            .otherwise(url)
        )

    return F.lower(let(url_parts(url), key))
