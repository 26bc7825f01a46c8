"""Title and text columns: whitespace, entities, slugs, title choice."""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .urls import let, named, url_part

# Unicode white space, spelt so that Java and RE2 agree on it.
WS = r"[\s\p{Z}\x1c-\x1f\x85]"
WS_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]+"
EXPIRY_NOTE = rf"(?i){WS}*expires?:{WS}*\d{{1,2}}/\d{{1,2}}/\d{{4}}"


def strings(values) -> Column:
    """A literal array of strings, empty included; one literal keeps plans small."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\x01".join(values)), "\x01")


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a short fixed table, null when the key is not in it."""
    text = "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit("\x01"), F.lit("\x02")), key)


def strip(s: Column) -> Column:
    """Trim Unicode white space; reads only the ends of the text."""
    return F.trim(s, F.lit(WS_CHARS))


def norm_text(s: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(s, rf"{WS}+", " "))


def or_null(s: Column) -> Column:
    """Empty text counts as absent."""
    return F.when(s != "", s)


def in_vocab(s: Column, words) -> Column:
    """Equal to one of the words in lower case; longer texts are not even lower-cased."""
    longest = max(map(len, words))
    return (F.length(s) <= longest) & F.array_contains(strings(words), F.lower(s))


def contains_path_part(path: Column, parts) -> Column:
    """True when any of the parts, which all begin with a slash, is a substring of the path.

    One pattern that only starts at slashes is cheaper than a search per part.
    """
    return path.rlike("/(?:" + "|".join(re.escape(p.removeprefix("/")) for p in parts) + ")")


def contains_any(s: Column, parts) -> Column:
    """True when any literal part is a substring."""
    return let(s, lambda t: F.exists(strings(parts), lambda p: t.contains(p)))


# --- entities ---------------------------------------------------------------------------------

_ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"
# Names that stand without a semicolon too, the longest first, as a prefix of what follows.
_OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_OPEN = "^&(" + "|".join(_OPEN_NAMES) + ")(.*)$"


def _number_text(entity: Column) -> Column:
    """The character of a numeric reference: windows-1252 for 128 to 159, none for what is no character."""
    digits = F.regexp_replace(F.regexp_extract(entity, r"^&#[xX]?([0-9a-fA-F]+)", 1), "^0+(?=.)", "")
    hexed = F.when(entity.rlike("^&#[xX]"), F.upper(digits)).otherwise(F.conv(digits, 10, 16))
    point = F.when((F.length(digits) <= 7), F.conv(hexed, 16, 10).cast("int")).otherwise(F.lit(1 << 30))
    old = {str(i): bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    character = F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")
    nothing = point.between(1, 8) | point.between(14, 31) | (point == 127) | (point == 11) | point.between(0xFDD0, 0xFDEF) | (point % 65536 >= 65534)
    return (
        F.when((point == 0) | point.between(0xD800, 0xDFFF) | (point > 0x10FFFF), F.lit("\ufffd"))
        .when(point == 13, F.lit("\r"))
        .when(F.coalesce(lookup(old, point.cast("string")), F.lit("")) != "", lookup(old, point.cast("string")))
        .when(nothing, F.lit(""))
        .otherwise(character)
    )


def _entity_text(entity: Column) -> Column:
    """The text an entity stands for by the HTML 5 rules; unknown names stay as they are."""
    closed = {f"&{n}": text for n, text in html5.items()}
    open_name = F.concat(F.lit("&"), F.regexp_extract(entity, _OPEN, 1))
    prefix = F.concat(lookup(closed, open_name), F.regexp_extract(entity, _OPEN, 2))
    return F.when(entity.startswith("&#"), _number_text(entity)).otherwise(F.coalesce(lookup(closed, entity), prefix, entity))


# The entities that writers of markup use; the ampersand comes last, as it may begin another.
_USUAL = {"&quot;": '"', "&lt;": "<", "&gt;": ">", "&#39;": "'", "&amp;": "&"}
_UNUSUAL = "&(?!" + "|".join(name[1:] for name in _USUAL) + ")"


def unescape(s: Column) -> Column:
    """Undo HTML entities, named and numeric, in one pass: what an entity gives is not read again.

    A text with none but the usual ones needs no search in the table of names.
    """
    def usual(t: Column) -> Column:
        for name, char in _USUAL.items():
            t = F.replace(t, F.lit(name), F.lit(char))
        return t

    def plain(t: Column) -> Column:
        gaps, found = F.split(t, _ENTITY, -1), F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0))
        pairs = F.zip_with(gaps, found, lambda gap, e: F.concat(gap, F.coalesce(_entity_text(e), F.lit(""))))
        return F.when(~t.contains("&"), t).when(t.rlike(_UNUSUAL), F.array_join(pairs, "")).otherwise(usual(t))

    return let(s, plain)


# --- slugs --------------------------------------------------------------------------------------

def slugify(s: Column) -> Column:
    dashed = F.regexp_replace(F.lower(s), "[^a-zA-Z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 80)


def is_opaque_id(word: Column) -> Column:
    """Looks like a generated id: mixed case with digits, or four and more changes of case."""
    mixed = word.rlike(r"\p{Lu}") & word.rlike(r"\p{Ll}") & word.rlike(r"\p{Nd}")
    mask = F.regexp_replace(F.regexp_replace(word, r"[^\p{Lu}]+", "a"), r"\p{Lu}+", "A")
    # Without capitals neither can hold.
    return (F.length(word) >= 6) & word.rlike(r"\p{Lu}") & (mixed | (F.length(mask) >= 5))


def _keep_until_last(words: Column, droppable) -> Column:
    """Cut the trailing run of droppable words."""
    last = F.array_max(
        F.transform(words, lambda w, i: F.when(~droppable(w), i + 1).otherwise(F.lit(0)))
    )
    return F.slice(words, 1, F.coalesce(last, F.lit(0)))


def _is_number(w: Column) -> Column:
    return w.rlike(r"^\p{Nd}+$")


def _segment_title(segment: Column) -> Column:
    def mixed_id(w: Column) -> Column:
        return (F.length(w) <= 8) & w.rlike(r"\p{Nd}") & ~_is_number(w)

    def cased(w: Column) -> Column:
        proper = F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))
        return F.when(w.rlike(r"^\p{L}+$"), proper).otherwise(w)

    def from_kept(kept: Column) -> Column:
        title = let(
            norm_text(F.array_join(F.transform(kept, cased), " ")),
            lambda t: F.when(F.length(t).between(5, 120), t),
        )
        return F.when(F.size(kept) >= 2, title)

    def from_words(words: Column) -> Column:
        kept = _keep_until_last(
            _keep_until_last(words, mixed_id), lambda w: (F.length(w) <= 1) | _is_number(w)
        )
        return F.when(~F.exists(words, is_opaque_id), let(kept, from_kept))

    return F.when(
        (F.length(segment) >= 4) & segment.rlike("[-_]"), let(F.split(segment, "[-_]+"), from_words)
    )


def slug_title(url: Column) -> Column:
    """Title read off the URL path: the first segment from the right that yields one, or null."""
    segments = F.filter(F.split(url_part(url, "path"), "/"), lambda s: s != "")
    titles = F.filter(
        F.transform(F.reverse(segments), _segment_title), lambda t: t.isNotNull()
    )
    return F.get(titles, F.lit(0))


# --- titles -------------------------------------------------------------------------------------

def real_title(title: Column) -> Column:
    """Two or more words, 5 to 200 characters, and no known label."""
    labels = [*vocab.NON_JOB_WORDS, *vocab.GENERIC_TITLES]
    real = let(
        strip(title),
        lambda t: F.length(t).between(5, 200) & t.rlike(WS) & ~in_vocab(t, labels),
    )
    return F.coalesce(real, F.lit(False))


def _without_expiry(line: Column) -> Column:
    return F.when(
        F.lower(line).contains("expire"), strip(F.regexp_replace(line, EXPIRY_NOTE, ""))
    ).otherwise(line)


def _comparable(s: Column) -> Column:
    return norm_text(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_\s\p{Z}]", " "))


def title_pick(text: Column, slug: Column | None = None) -> Column:
    """The most title-like line of a text that may hold several lines.

    A line equal to ``slug`` (the title in the URL, see ``slug_title``) wins; then the longest
    line of up to 150 characters; then the shortest one. A text of one line, or with no acceptable
    line, gives its first line.
    """
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")

    def choose(ls: Column) -> Column:
        first = F.coalesce(_without_expiry(F.get(ls, F.lit(0))), F.lit(""))
        usable = F.filter(
            F.transform(ls, _without_expiry),
            lambda c: (F.length(c) >= 4)
            & (c.rlike(WS) | (F.length(c) >= 15))
            & ~in_vocab(c, vocab.GENERIC_TITLES),
        )
        return F.when(F.size(ls) <= 1, first).otherwise(
            F.coalesce(let(usable, best_line), first)
        )

    def best_line(cs: Column) -> Column:
        ranked = F.transform(
            cs, lambda c, i: named(n=F.length(c), i=-i, line=c)
        )
        by_length = let(
            ranked,
            lambda rs: F.coalesce(
                F.array_max(F.filter(rs, lambda r: r["n"] <= 150))["line"], F.array_min(rs)["line"]
            ),
        )
        if slug is None:
            return by_length
        # Only a text of several usable lines ever needs the slug.
        same = let(
            _comparable(slug),
            lambda wanted: F.get(F.filter(cs, lambda c: _comparable(c) == wanted), F.lit(0)),
        )
        return F.coalesce(same, by_length)

    return let(lines, choose)
