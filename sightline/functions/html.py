"""Markup columns. Regular expressions find flat pieces; nested blocks need a parser (blocks.py)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, unescape

_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"
_BLOCK_EDGE = r"(?i)(?=<(?:li|article|tr|section)\b)|(?<=</(?:li|article|tr|section)>)"


def all_matches(s: Column, pattern: str, *groups: int) -> Column:
    """Every match as a struct of the given groups (``g1``, ``g2`` ...)."""
    found = [F.regexp_extract_all(s, F.lit(pattern), F.lit(g)) for g in groups]
    return F.arrays_zip(*[c.alias(f"g{g}") for c, g in zip(found, groups)])


def anchors(body: Column) -> Column:
    """``<a>`` elements in order: ``g1`` attributes, ``g2`` inner markup."""
    return all_matches(body, _ANCHOR, 1, 2)


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute, entities undone; empty text when absent."""
    pattern = rf"""(?is)(?:^|.*?\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)).*$"""
    found = F.when(attrs.rlike(pattern), F.regexp_replace(attrs, pattern, "$1$2$3")).otherwise("")
    return unescape(found)


def text_of(markup: Column, sep: str = " ") -> Column:
    """Text pieces between tags, each stripped, joined by ``sep``."""
    pieces = F.transform(
        F.split(markup, r"(?s)<[^>]*>"), lambda p: strip(unescape(p))
    )
    return F.array_join(F.filter(pieces, lambda p: p != ""), sep)


def blocks(body: Column) -> Column:
    """Body cut at list items, articles, rows and sections, innermost first."""
    return F.split(body, _BLOCK_EDGE)


def starts_block(piece: Column) -> Column:
    return piece.rlike(r"(?i)^<(?:li|article|tr|section)\b")
