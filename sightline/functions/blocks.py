"""Nested HTML blocks for the generic listing parser.

A class-marked ``div`` may hold others of its kind, so a regular expression cannot find where it
ends. The page is one bounded row; Spark spreads the pages and this helper reads one at a time.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urlparse

from .vocab import HTML_JOB_CLASS_WORDS, HTML_JOB_HREF_PARTS

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
_PIECE = re.compile(
    r"""<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|([^<]+|<)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([\w:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# What a selector may be made of: tags, classes, ids, attributes, :first-child and :not() of one of these, joined
# by blanks (inside), ">" (child) and commas.
_TAG, _VALUE = r"(?:[\w-]+|\*)", r"""\[[\w-]+(?:[*^$]?=(?:"[^"]*"|'[^']*'|[^\]"',]*))?\]"""
_MARK = rf"(?:[.#][\w-]+|{_VALUE}|:first-child)"
_PART = rf"(?:{_MARK}|:not\((?:{_TAG}|{_MARK})\))"
_COMPOUND = rf"(?:{_TAG}{_PART}*|{_PART}+)"
_COMPLEX = rf"{_COMPOUND}(?:(?:\s*>\s*|\s+){_COMPOUND})*"
SELECTOR = rf"^\s*{_COMPLEX}(?:\s*,\s*{_COMPLEX})*\s*$"
_TOKEN = re.compile(rf"\s*(?P<join>[>,])\s*|(?P<inside>\s+)|(?P<simple>{_TAG}|{_PART})")
_TEST = re.compile(r"""(?P<name>[.#]?[\w-]+|\*)$|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$]?=)["']?(?P<want>[^"'\]]*)["']?)?\]$""")


class _Element:
    __slots__ = ("tag", "attrs", "text", "link", "marked", "nth", "children")

    def __init__(self, tag, attrs, nth):
        self.tag, self.attrs, self.nth, self.children = tag, attrs, nth, 0
        self.text, self.link = [], self if tag == "a" else None


def _test(simple: str):
    """Whether an element fits one simple selector, as a function."""
    if simple.startswith(":not("):
        inner = _test(simple[5:-1])
        return lambda e: not inner(e)
    if simple == ":first-child":
        return lambda e: e.nth == 1
    name, attr, op, want = _TEST.match(simple).group("name", "attr", "op", "want")
    if attr:
        # A part of a value that is empty fits nothing.
        fits = {
            None: lambda have: True, "=": lambda have: have == want, "*=": lambda have: bool(want) and want in have,
            "^=": lambda have: bool(want) and have.startswith(want), "$=": lambda have: bool(want) and have.endswith(want),
        }[op]
        return lambda e: attr.lower() in e.attrs and fits(e.attrs[attr.lower()])
    if name == "*":
        return lambda e: True
    if name[0] == ".":
        return lambda e: name[1:] in (e.attrs.get("class") or "").split()
    if name[0] == "#":
        return lambda e: e.attrs.get("id") == name[1:]
    return lambda e: e.tag == name.lower()


def compiled(selector: str) -> list[list[tuple[bool, list]]]:
    """Alternatives, each as steps from the chosen element outwards: (is the next one its parent, tests)."""
    if not re.match(SELECTOR, selector):
        raise ValueError(f"selector not supported: {selector}")
    lists, steps = [], [(False, [])]
    for m in _TOKEN.finditer(selector.strip()):
        if m["simple"]:
            steps[-1][1].append(_test(m["simple"]))
        elif m["join"] == ",":
            lists.append(steps)
            steps = [(False, [])]
        else:
            steps.append((m["join"] == ">", []))
    lists.append(steps)
    return [list(reversed(one)) for one in lists]


def _selected(path: list[_Element], selector: list) -> bool:
    """The last element of the open path fits an alternative."""
    def fits(at: int, steps: list) -> bool:
        is_child, tests = steps[0]
        if not all(test(path[at]) for test in tests):
            return False
        if len(steps) == 1:
            return True
        return any(fits(outer, steps[1:]) for outer in ([at - 1] if is_child and at else [] if is_child else range(at - 1, -1, -1)))

    return any(fits(len(path) - 1, steps) for steps in selector)


class _Reader:
    """Open elements of a page, and the ones that are links or chosen."""

    def __init__(self, chosen):
        self.chosen, self.path, self.open, self.found = chosen, [], [], []
        self.outermost = 0

    def read(self, body: str):
        for piece in _PIECE.finditer(body):
            _, closing, tag, attrs, text = piece.groups()
            if text is not None:
                self.text(text)
            elif tag and closing:
                self.close(tag.lower())
            elif tag:
                self.start(tag.lower(), attrs)

    def start(self, tag, attrs):
        if tag == "li":
            self.close("li", within=("ul", "ol"))
        values = {
            name.lower(): unescape(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(attrs)
        } if attrs else {}
        if self.path:
            self.path[-1].children += 1
        else:
            self.outermost += 1
        element = _Element(tag, values, self.path[-1].children if self.path else self.outermost)
        if tag == "a":
            for holder in self.open:
                if holder.link is None:
                    holder.link = element
        self.path.append(element)
        element.marked = self.chosen(self.path)
        if tag == "a" or element.marked:
            self.open.append(element)
            self.found.append(element)
        if tag in _VOID:
            self.close(tag)

    def close(self, tag, within=()):
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i].tag == tag:
                gone = self.path[i:]
                del self.path[i:]
                self.open = [e for e in self.open if e not in gone]
                return
            if self.path[i].tag in within:
                return

    def text(self, data):
        if not self.open:
            return
        data = unescape(data).strip()
        if data:
            for element in self.open:
                element.text.append(data)


def _job_class(path):
    e = path[-1]
    marked = (e.attrs.get("class") or "").lower()
    return e.tag in ("li", "div", "article") and any(w in marked for w in HTML_JOB_CLASS_WORDS)


def listing_blocks(body: str, selector: str | None, page_url: str | None):
    """Yield (href, link text, block text) for every block that may hold a listing."""
    steps = compiled(selector) if selector else None
    reader = _Reader((lambda path: _selected(path, steps)) if steps else _job_class)
    reader.read(body or "")
    picked = [e for e in reader.found if e.marked]
    if not picked and not selector:
        host = urlparse(page_url or "").netloc
        picked = [
            e for e in reader.found
            if "href" in e.attrs
            and urlparse(e.attrs["href"]).netloc in ("", host)
            and any(p in e.attrs["href"].lower() for p in HTML_JOB_HREF_PARTS)
        ]
    for e in picked:
        if e.link is not None and e.link.attrs.get("href"):
            yield e.link.attrs["href"], " ".join(e.link.text), " ".join(e.text)
