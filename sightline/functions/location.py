"""Location match: does a text name one of the places asked for, and no rival of it?"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import strings
from .urls import let

_NON_WORD = r"[^\p{L}\p{N}_]+"


def compile_filter(location_filter: str, expansions=None, peers=None) -> Column:
    """Turn a fixed filter such as ``"Madrid, London"`` into literal word lists."""
    expansions = vocab.LOCATION_EXPANSIONS if expansions is None else expansions
    peers = vocab.PEER_CITIES if peers is None else peers
    names = [n.lower() for n in re.split(r"\s*[,|]\s*", location_filter) if n.strip()]
    terms = [t for n in names for t in expansions.get(n, [n])]
    rivals = [
        city
        for cities in peers.values()
        if set(cities) & set(names)
        for city in cities
        if city not in names
    ]
    return _lists(
        words=strings(t for t in terms if " " not in t),
        parts=strings([t for t in terms if " " in t] + names),
        rival_words=strings(c for c in rivals if " " not in c),
        rival_parts=strings(c for c in rivals if " " in c),
    )


def compile_filter_column(location_filter: Column, expansions=None, peers=None) -> Column:
    """The same lists for a filter held in a column; evaluate it on the catalog, then join."""
    expansions = vocab.LOCATION_EXPANSIONS if expansions is None else expansions
    peers = vocab.PEER_CITIES if peers is None else peers
    names = F.transform(
        F.filter(F.split(location_filter, r"\s*[,|]\s*"), lambda n: F.trim(n) != ""), F.lower
    )
    table = F.create_map(
        *[x for name, terms in expansions.items() for x in (F.lit(name), strings(terms))]
    )
    terms = F.flatten(
        F.transform(names, lambda n: F.coalesce(F.try_element_at(table, n), F.array(n)))
    )
    rivals = F.array().cast("array<string>")
    for cities in peers.values():
        cities = strings(cities)
        rivals = F.concat(
            rivals,
            F.when(F.arrays_overlap(cities, names), F.array_except(cities, names)).otherwise(
                F.array().cast("array<string>")
            ),
        )
    has_blank = lambda t: t.contains(" ")
    no_blank = lambda t: ~t.contains(" ")
    return _lists(
        words=F.filter(terms, no_blank),
        parts=F.concat(F.filter(terms, has_blank), names),
        rival_words=F.filter(rivals, no_blank),
        rival_parts=F.filter(rivals, has_blank),
    )


def _lists(**arrays: Column) -> Column:
    return F.struct(*[a.alias(n) for n, a in arrays.items()])


def location_match(text: Column, places: Column | str) -> Column:
    """Rivals reject first; then any accepted word, phrase or filter name accepts.

    Single words are compared with word tokens, phrases and filter names as substrings.
    """
    if isinstance(places, str):
        places = compile_filter(places)

    def any_part(parts: Column, low: Column) -> Column:
        return F.exists(parts, lambda p: low.contains(p))

    def judged(low: Column, tokens: Column) -> Column:
        rejected = F.arrays_overlap(tokens, places["rival_words"]) | any_part(places["rival_parts"], low)
        accepted = F.arrays_overlap(tokens, places["words"]) | any_part(places["parts"], low)
        return ~rejected & accepted

    # A text without any accepted term as a substring fails without being cut into words.
    def matched(low: Column) -> Column:
        hopeful = any_part(places["words"], low) | any_part(places["parts"], low)
        return hopeful & (low != "") & let(F.split(low, _NON_WORD), lambda tokens: judged(low, tokens))

    return F.coalesce(let(F.lower(text), matched), F.lit(False))
