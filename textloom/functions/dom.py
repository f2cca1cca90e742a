"""A small document tree for HTML, and a selector algebra over it.

A selector is a nested list, hence JSON: ``["tag", "a"]``, ``["and", s, t]``, ``["path", s, t]`` ... (see ``matches``)."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Element:
    """An element with its attributes, its parent and its contents (elements and strings)."""

    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def elements(self) -> list[Element]:
        return [k for k in self.kids if isinstance(k, Element)]

    def walk(self):
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(reversed(e.elements()))

    def own_text(self) -> str:
        return " ".join("".join(k for k in self.kids if isinstance(k, str)).split())

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                parts.append(e)
            elif e.tag not in ("script", "style"):
                if e.tag == "br" or e.tag in _ENDS_P or e.tag in _CLOSE:
                    parts.append(" ")
                todo.extend(reversed(e.kids))
        return " ".join("".join(parts).split())

    def data(self) -> str:
        return "".join(k for e in self.walk() if e.tag in ("script", "style") for k in e.kids if isinstance(k, str))

    def ancestors(self):
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def before(self) -> list[Element]:
        """The earlier siblings, nearest last."""
        if self.parent is None:
            return []
        s = self.parent.elements()
        return s[: next(i for i, x in enumerate(s) if x is self)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Element("#root", {}, None)

    def _up_to(self, tags: set[str], stop: set[str]) -> None:
        e, found = self.top, None
        while e.parent is not None and e.tag not in stop:
            if e.tag in tags:
                found = e
            e = e.parent
        if found is not None:
            self.top = found.parent

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._up_to({"p"}, {"table", "td", "th", "button"})
        if tag in _CLOSE:
            self._up_to(_CLOSE[tag], _STOP[tag])
        e = Element(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.kids.append(e)
        if tag not in VOID:
            self.top = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        e = self.top
        while e.parent is not None:
            if e.tag == tag:
                self.top = e.parent
                return
            e = e.parent

    def handle_data(self, data):
        self.top.kids.append(data)


#: Scripts and style sheets as a whole, or an ampersand that begins no reference with a semicolon.
_LOOSE = re.compile(r"<(script|style)\b.*?</\1|&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", re.S | re.I)


def parse(html: str, loose: bool = True) -> Element:
    """The tree of a page. ``loose``: names such as ``&amp`` count as references without their semicolon, too, as HTML has it;
    else they stay as they are."""
    b = _Builder()
    b.feed(html if loose else _LOOSE.sub(lambda m: "&amp;" if m[1] is None else m[0], html))
    b.close()
    return b.root


_regex = lru_cache(256)(re.compile)


def matches(s: list, e: Element) -> bool:
    """Whether a selector holds for an element.

    Tests: ``any``, ``root``, ``tag t``, ``id x``, ``class c``, ``attr a``, ``attr= a v``, ``attr^ a v``, ``attr$ a v``,
    ``attr* a v``, ``attr~ a regex``, ``attr!= a v``, ``attr-starts prefix``, ``data x``, ``own-text x``, ``nth a b``.
    Combinations: ``and``, ``or``, ``not``, ``has s`` (a descendant), ``parent s``, ``ancestor s``, ``next s`` (the sibling just
    before), ``after s`` (any sibling before), ``path s t ..`` (children), ``any-path s t ..`` (descendants), ``any-pos s`` (s or within s)."""
    op, a = s[0], s[1:]
    if op == "any":
        return True
    if op == "root":
        return e.parent is None or e.parent.parent is None
    if op == "tag":
        return e.tag == a[0]
    if op == "id":
        return e.attrs.get("id") == a[0]
    if op == "class":
        return a[0].lower() in e.attrs.get("class", "").lower().split()
    if op == "attr":
        return a[0] in e.attrs
    if op == "attr-starts":
        return any(k.startswith(a[0]) for k in e.attrs)
    if op.startswith("attr"):
        v = e.attrs.get(a[0])
        if op == "attr!=":
            return v != a[1]
        if v is None:
            return False
        x, y = v.lower().strip(), a[1].lower()
        return {"attr=": lambda: x == y.strip(), "attr^": lambda: x.startswith(y), "attr$": lambda: x.endswith(y), "attr*": lambda: y in x, "attr~": lambda: bool(_regex(a[1]).search(v))}[op]()
    if op == "data":
        return a[0].lower() in e.data().lower()
    if op == "own-text":
        return a[0].lower() in e.own_text().lower()
    if op == "nth":
        n = 1 + sum(x.tag == e.tag for x in e.before())
        k, b = a
        return n == b if k == 0 else (n - b) % k == 0 and (n - b) // k >= 0
    if op == "and":
        return all(matches(x, e) for x in a)
    if op == "or":
        return any(matches(x, e) for x in a)
    if op == "not":
        return not matches(a[0], e)
    if op == "has":
        return any(matches(a[0], x) for x in e.walk() if x is not e)
    if op == "parent":
        return e.parent is not None and matches(a[0], e.parent)
    if op == "ancestor":
        return any(matches(a[0], x) for x in e.ancestors())
    if op == "next":
        b = e.before()
        return bool(b) and matches(a[0], b[-1])
    if op == "after":
        return any(matches(a[0], x) for x in e.before())
    if op in ("path", "any-path"):
        if not matches(a[-1], e):
            return False
        if len(a) == 1:
            return True
        above = [e.parent] if op == "path" else e.ancestors()
        return any(x is not None and matches([op, *a[:-1]], x) for x in above)
    if op == "any-pos":
        return matches(a[0], e) or any(matches(a[0], x) for x in e.ancestors())
    raise ValueError(f"no selector {op}")


def select(root: Element, s: list) -> list[Element]:
    """All elements for which the selector holds, in document order."""
    return [e for e in root.walk() if e.parent is not None and matches(s, e)]


def unescaped(s: str) -> str:
    return unescape(s)
