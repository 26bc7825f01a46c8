"""Pieces of check SQL: the location test and title tests, said again for DuckDB."""

from __future__ import annotations

import re

from ..functions import vocab
from .fixtures import quoted

WS = r"[\s\p{Z}\x1c-\x1f\x85]"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]::VARCHAR[]"


def sql_in(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def location_sql(text: str, places: str, expansions=None, peers=None) -> str:
    """Boolean SQL: ``text`` passes the fixed filter ``places``."""
    expansions = expansions or vocab.LOCATION_EXPANSIONS
    peers = peers or vocab.PEER_CITIES
    wanted = [w.lower() for w in re.split(r"\s*[,|]\s*", places)]
    terms = sum((expansions.get(w, [w]) for w in wanted), [])
    rivals = [c for g in peers.values() if set(g) & set(wanted) for c in g if c not in wanted]
    low = f"lower({text})"
    tokens = rf"string_split_regex({low}, '[^\p{{L}}\p{{N}}_]+')"

    def named(names: list[str]) -> str:
        words = [n for n in names if " " not in n]
        tests = [f"list_has_any({tokens}, {sql_list(words)})"] if words else []
        tests += [f"contains({low}, {quoted(n)})" for n in names if " " in n]
        return "(" + (" OR ".join(tests) or "false") + ")"

    inside = " OR ".join(f"contains({low}, {quoted(w)})" for w in wanted)
    return f"coalesce({text} <> '' AND NOT {named(rivals)} AND ({named(terms)} OR {inside}), false)"


def location_by_filter(text: str, filter_column: str, filters: list[str]) -> str:
    whens = " ".join(f"WHEN {quoted(f)} THEN {location_sql(text, f)}" for f in filters)
    return f"(CASE {filter_column} {whens} ELSE false END)"


def stripped(s: str) -> str:
    return f"regexp_replace({s}, '^{WS}+|{WS}+$', '', 'g')"


def normal(s: str) -> str:
    return f"trim(regexp_replace({s}, '{WS}+', ' ', 'g'))"


def real_title_sql(s: str) -> str:
    t = stripped(s)
    labels = sql_in([*vocab.NON_JOB_WORDS, *vocab.GENERIC_TITLES])
    return (
        f"coalesce(length({t}) BETWEEN 5 AND 200 AND lower({t}) NOT IN {labels}"
        f" AND regexp_matches({t}, '{WS}'), false)"
    )


def slug_sql(s: str) -> str:
    return f"substr(trim(regexp_replace(lower({s}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80)"
