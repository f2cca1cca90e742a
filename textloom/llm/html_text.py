"""Layout-aware text of web pages.

A tree builder reads the markup with the implied tags of HTML (``p``, ``li``, ``dt``/``dd``, table parts and
options close where the next begins, void elements have no content, scripts and styles are raw text). The
renderer then walks the tree and emits all visible text: hidden elements are left out, blocks stand on lines
of their own with a blank line around paragraphs, headings, lists and tables, list items carry their bullet or
number and are indented by depth, preformatted text keeps its blanks, and table cells are aligned in columns, of
which a cell may span several and keep them in the rows below. A cell's blocks and lists stand on lines below each
other. Formulas give the text of their parts, fractions and scripts with a blank between, and drawings the
lines of their labels; what they only define or annotate is hidden.

Hidden is what the element's own style, its ``hidden`` attribute or a rule of a style sheet in the page hides, if all
selectors of that rule are a tag, classes and identifiers of the element itself (others are not evaluated, nor are
rules under conditions); ``visibility: visible`` shows again what is in a part that is not visible.

Layout has bounds, text has none: indents grow to ``INDENT`` and columns are padded to ``WIDE`` at most, so that the output
grows with the page; a table in a table is written row by row without columns of its own; list numbers beyond 32 bits
count from 1, as in browsers. All steps take time in proportion to the page, however its tags are nested.

Defined results: null html gives null, empty html an empty text, an empty table no rows; unclosed or stray tags never fail; a
comment or script without an end runs to the end of the page; very long pages are rendered whole; repeated rows
are rendered again; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from html import unescape
from itertools import accumulate, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes object canvas audio video datalist meta link base".split())
FOREIGN = {"svg": frozenset("desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
# within these, elements are those of HTML again; the others are closed by the start of such an element
HTML_WITHIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SCRIPTS = frozenset("mfrac mroot msub msup msubsup munder mover munderover mmultiscripts".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu hr".split())
BLOCK = PARAGRAPH | frozenset("html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup legend li main nav option optgroup search section summary tr caption thead tbody tfoot".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
# a start tag closes these open elements, up to the given boundary
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
SCOPE = frozenset("table td th caption html template".split())

_MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NONE = re.compile(r"(?:^|[;\s{])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s{])visibility\s*:\s*(visible|hidden|collapse)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BRACE = re.compile(r"[{}]")
_SIMPLE = re.compile(r"([a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
INDENT = 64
WIDE = 120
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "foreign")

    def __init__(self, tag: str, attrs: str = "", foreign: str = ""):
        self.tag, self.attrs, self.kids, self.foreign = tag, attrs, [], foreign

    def attr(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in _ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None


class _Stack(list):
    """The open elements, the root first; where each tag is open is known without looking through them."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.at: dict[str, list[int]] = defaultdict(list)

    def open(self, node: Node) -> None:
        self.at[node.tag].append(len(self))
        self.append(node)

    def last(self, tags) -> int:
        """Where the innermost open element of these tags is; 0, the root, if there is none."""
        return max((self.at[t][-1] for t in tags if t in self.at and self.at[t]), default=0)

    def close(self, i: int) -> None:
        """Close the elements from place ``i`` on."""
        while len(self) > max(i, 1):
            self.at[self.pop().tag].pop()


class _Stack(list):
    """The open elements, the root first; where each tag is open is known without looking through them."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.at: dict[str, list[int]] = defaultdict(list)

    def open(self, node: Node) -> None:
        self.at[node.tag].append(len(self))
        self.append(node)

    def last(self, tags) -> int:
        """Where the innermost open element of these tags is; 0, the root, if there is none."""
        return max((self.at[t][-1] for t in tags if t in self.at and self.at[t]), default=0)

    def close(self, i: int) -> None:
        """Close the elements from place ``i`` on."""
        while len(self) > max(i, 1):
            self.at[self.pop().tag].pop()


def parse(html: str) -> Node:
    """The tree of a page; texts are plain strings among a node's kids."""
    root = Node("html")
    stack = _Stack(root)
    at, n = 0, len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        s = m.start() if m else n
        if s > at:
            stack[-1].kids.append(unescape(html[at:s]) if "&" in html[at:s] else html[at:s])
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            tag = m[1].lower()
            if tag == "p" and not stack.last(("p",)):
                stack[-1].kids.append(Node("p"))
            elif tag == "br":
                stack[-1].kids.append(Node("br"))
            elif tag not in ("html", "body"):
                i = stack.last((tag,))
                if i and (tag in ("table", "tr", "tbody", "thead", "tfoot") or i >= stack.last(SCOPE)):
                    stack.close(i)
            continue
        tag = m[2] or m[4]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m[3] if m[2] else m[5]
        if tag in ("html", "body"):
            if attrs and tag == "html":
                root.attrs += " " + attrs
            if tag == "html":
                continue
            while len(stack) > 1 and stack[-1].tag == "head":
                stack.close(len(stack) - 1)
            if stack.last(("body",)):
                continue
        if tag in BREAKOUT:
            while stack[-1].foreign and stack[-1].tag not in HTML_WITHIN:
                stack.close(len(stack) - 1)
        if tag in CLOSES_P and (i := stack.last(("p",))) > stack.last(SCOPE) and i > stack.last(("button",)):
            stack.close(i)
        if tag in IMPLIED:
            ends, bound = IMPLIED[tag]
            low = stack.last(bound)
            first = [x[i] for x in (stack.at[t] for t in ends if t in stack.at) if (i := bisect(x, low)) < len(x)]
            if first:
                stack.close(min(first))
        if tag not in ("head",) and stack[-1].tag == "head" and tag not in HIDDEN and tag not in VOID:
            stack.close(len(stack) - 1)  # content ends the head
        node = Node(tag, attrs, tag if tag in FOREIGN else "" if stack[-1].tag in HTML_WITHIN else stack[-1].foreign)
        stack[-1].kids.append(node)
        if tag in VOID or attrs.endswith("/") and (node.foreign or tag in ("path", "circle", "rect", "use", "g")):
            continue
        if tag in RAW:
            e = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at : e.start() if e else n]
            if tag in ("textarea", "style"):
                node.kids.append(unescape(body) if tag == "textarea" else body)
            at = e.end() if e else n
            continue
        if tag == "plaintext":
            node.kids.append(html[at:])
            break
        stack.open(node)
    return root


class Sheet:
    """What the page's style sheets hide: for a class, an identifier or else a tag, the whole selectors that begin their search there."""

    def __init__(self, root: Node):
        self.rules: dict[str, dict[tuple, str]] = defaultdict(dict)
        todo: list[Node] = [root]
        while todo:
            x = todo.pop()
            if x.tag == "style" and x.kids:
                self._read(_COMMENT.sub(" ", x.kids[0]))
            todo.extend(k for k in reversed(x.kids) if not isinstance(k, str))

    def _read(self, css: str) -> None:
        depth, at, head = 0, 0, ""
        for m in _BRACE.finditer(css):
            if m[0] == "{":
                if depth == 0:
                    head, at = css[at : m.start()].rpartition(";")[2].strip(), m.end()
                depth += 1
            elif depth:
                depth -= 1
                if depth == 0:
                    if head[:1] != "@":
                        self._rule(head, css[at : m.start()])
                    at = m.end()
            else:
                at = m.end()

    def _rule(self, head: str, body: str) -> None:
        show = re.search(r"(?:^|[;\s])display\s*:\s*(?!none)\w", body, re.I)
        seen = _VISIBILITY.search(body)
        what = "none" if _NONE.search(body) else seen[1].lower() if seen else "" if show else None
        if what is None:
            return
        for part in head.split(","):
            m = _SIMPLE.fullmatch(part.strip())
            if m and m[0]:
                more = re.findall(r"[.#][\w-]+", m[2])
                key = (m[1].lower() if m[1] else "", *more)
                own = self.rules[more[0] if more else key[0]]
                own.pop(key, None)
                own[key] = what

    def of(self, node: Node) -> str:
        """"none", "hidden", "collapse", "visible" or nothing: what the last rule for an element says."""
        if not self.rules:
            return ""
        has = {f".{c}" for c in (node.attr("class") or "").split()} | ({f"#{i}"} if (i := node.attr("id")) else set())
        out = ""
        for k in (node.tag, *sorted(has)):
            for key, what in self.rules.get(k, {}).items():
                if key[0] in ("", node.tag) and has.issuperset(key[1:]):
                    out = what if out != "none" or what else ""
        return out


_NO_SHEET = Sheet(Node("html"))


def hidden(node: Node, sheet: Sheet = _NO_SHEET) -> bool:
    """Whether an element and all in it is invisible."""
    return shown(node, sheet) == "none"


def shown(node: Node, sheet: Sheet = _NO_SHEET) -> str:
    """"none" where an element is left out with all in it, "hidden" where it isn't visible but what is in it may be, "visible"
    where it is so by its own style, else nothing."""
    if node.tag in HIDDEN or node.foreign and node.tag in FOREIGN[node.foreign]:
        return "none"
    a = node.attrs
    rule = sheet.of(node) if sheet.rules else ""
    if rule == "collapse":
        rule = "hidden"
    if not a:
        return rule
    low = a.lower()
    if "hidden" in low and node.attr("hidden") is not None:
        return "none"
    if node.tag == "dialog" and node.attr("open") is None:
        return "none"
    if node.foreign == "svg":
        if node.attr("display") == "none":
            return "none"
        rule = {"collapse": "hidden", None: rule}.get(v := node.attr("visibility"), v)
    if "style" in low and (style := node.attr("style")):
        if _NONE.search(style):
            return "none"
        if rule == "none" and re.search(r"(?:^|[;\s])display\s*:", style, re.I):
            rule = ""
        if m := _VISIBILITY.search(style):
            rule = rule if rule == "none" else "visible" if m[1].lower() == "visible" else "hidden"
    return rule


def _visible_within(node: Node, sheet: Sheet) -> list[Node]:
    """The outermost elements in one that isn't visible that are visible again."""
    out, todo = [], [node]
    while todo:
        for k in reversed(todo.pop().kids):
            if not isinstance(k, str):
                s = shown(k, sheet)
                if s == "visible":
                    out.append(k)
                elif s != "none":
                    todo.append(k)
    return out


class _Out:
    """Lines of text with pending blanks and blank lines."""

    __slots__ = ("lines", "line", "gap", "indent", "lead", "space")

    def __init__(self):
        self.lines, self.line, self.gap, self.indent, self.lead, self.space = [], [], 0, 0, "", False

    def end(self, gap: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def start(self) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.line.append(self.lead or " " * min(self.indent, INDENT))
        self.lead = ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if not s:
            return
        if s == " ":
            self.space = bool(self.line)
            return
        if not self.line:
            self.start()
            s = s.lstrip(" ")
        elif self.space and s[0] != " ":
            self.line.append(" ")
        elif self.space:
            pass
        self.space = s[-1] == " "
        self.line.append(s.rstrip(" ") if self.space else s)

    def raw(self, s: str) -> None:
        for i, part in enumerate(s.expandtabs(8).split("\n")):
            if i:
                if not self.line:
                    if self.lines:
                        self.lines.append("")
                else:
                    self.lines.append("".join(self.line).rstrip(" "))
                    self.line = []
            if part:
                if not self.line:
                    self.start()
                self.line.append(part)


def _number(node: Node, name: str, default: int, most: int) -> int:
    x = (node.attr(name) or "").strip()
    return min(int(x[:9]), most) if x.isdecimal() else default


def _table(node: Node, sheet: Sheet) -> list[str]:
    """The lines of a table: its caption, then rows with cells padded to their column's width."""
    rows: list[list[tuple[int, list[str], int]]] = []  # (column, lines, end column)
    held: list[tuple[int, int, float]] = []  # columns and the row up to which a cell from above holds them, in order
    caption: list[str] = []
    todo: list[Node | str | None] = list(reversed(node.kids))
    feet: list[Node] = []

    def tr(k: Node) -> None:
        nonlocal held
        row, at, h, more = [], 0, 0, []
        held = [x for x in held if x[2] > len(rows)]
        for c in k.kids:
            span, down = 1, 1.0
            if isinstance(c, str):
                if not c.strip():
                    continue
                cell = [_SPACE.sub(" ", c).strip()]
            elif hidden(c, sheet):
                continue
            else:
                cell = [x for x in render(c, sheet, True).split("\n") if x.strip()]
                if c.tag in ("td", "th"):
                    span = max(_number(c, "colspan", 1, 1000), 1)
                    down = _number(c, "rowspan", 1, 65534) or float("inf")
            while h < len(held) and held[h][0] <= at:
                at, h = max(at, held[h][1]), h + 1
            row.append((at, cell, at + span))
            if down > 1:
                more.append((at, at + span, len(rows) + down))
            at += span
        if more:
            held = sorted(held + more)
        rows.append(row)

    while todo or feet:
        if not todo:
            held = []
            todo.extend(reversed([y for f in feet for y in (None, *f.kids)]))
            feet = []
            continue
        k = todo.pop()
        if k is None:  # cells end with their group of rows
            held = []
        elif isinstance(k, str):
            if k.strip():  # misplaced text stands before the table
                caption.append(_SPACE.sub(" ", k).strip())
        elif hidden(k, sheet):
            continue
        elif k.tag == "tr":
            tr(k)
        elif k.tag == "tfoot":
            feet.append(k)
        elif k.tag in ("thead", "tbody"):
            held = []
            todo.append(None)
            todo.extend(reversed(k.kids))
        elif k.tag not in ("col", "colgroup"):
            caption += [x for x in render(k, sheet, True).split("\n") if x]
    starts = sorted({at for row in rows for at, _, _ in row})  # only columns in which a cell begins take room
    width = [0] * len(starts)
    place = {at: i for i, at in enumerate(starts)}
    for row in rows:
        for at, cell, end in row:
            if bisect(starts, end - 1) - place[at] == 1:
                width[place[at]] = min(max([width[place[at]], *map(len, cell)]), WIDE)
    for row in rows:  # a spanning cell that needs more widens its last column
        for at, cell, end in row:
            i, j = place[at], bisect(starts, end - 1)
            if j - i > 1:
                have = sum(width[i:j]) + 2 * (j - i - 1)
                need = max(map(len, cell), default=0)
                if need > have:
                    width[j - 1] = min(width[j - 1] + need - have, max(WIDE, width[j - 1]))
    left = list(accumulate((w + 2 for w in width), initial=0))
    lines = caption
    for row in rows:
        for parts in zip_longest(*[cell for _, cell, _ in row], fillvalue=""):
            line, end = [], 0
            for (at, _, _), cell in zip(row, parts):
                if cell:
                    gap = left[place[at]] - end
                    line += [" " * (gap if gap > 1 or not end else 2), cell]
                    end = max(left[place[at]], end + 2 if end else 0) + len(cell)
            lines.append("".join(line).rstrip())
    return [x for x in lines if x]


def render(node: Node, sheet: Sheet = _NO_SHEET, inner: bool = False) -> str:
    """All visible text of a tree, laid out; ``inner`` within a table."""
    out = _Out()
    pre = 0
    lists: list[list] = []  # [ordered, next number, indent before]
    # (node, entering); an explicit stack, since pages may nest deeper than Python's
    todo: list[tuple[Node | str, bool]] = [(node, True)]
    while todo:
        x, entering = todo.pop()
        if isinstance(x, str):
            out.raw(x) if pre else out.text(x)
            continue
        tag = x.tag
        if not entering:
            if tag == "pre" or tag == "textarea":
                pre -= 1
            if tag in ("ul", "ol", "menu"):
                out.end(1)
                out.indent = lists.pop()[2]
                out.end(1 if lists else 2)
            elif tag == "li":
                out.end(1)
                out.lead, out.indent = "", out.indent - (x.kids[-1] if x.kids and isinstance(x.kids[-1], int) else 0)
            elif tag in ("dd", "blockquote"):
                out.end(1 if tag == "dd" else 2)
                out.indent -= 2
            else:
                out.end(2 if tag in PARAGRAPH else 1)
            continue
        state = shown(x, sheet)
        if state == "none":
            continue
        if state == "hidden":
            todo.extend((k, True) for k in _visible_within(x, sheet))
            continue
        if tag == "br":
            if out.line:
                out.end(1)
            elif out.lines or out.lead:
                out.gap = max(out.gap, 2)
            continue
        if tag == "hr":
            out.end(2)
            continue
        if tag == "input":
            kind = (x.attr("type") or "text").lower()
            if kind in ("submit", "button", "reset") and x.attr("value"):
                out.text(f" {x.attr('value')} ")
            continue
        if tag == "table" and not inner:
            out.end(2)
            for line in _table(x, sheet):
                out.start()
                out.line.append(line)
                out.end(1)
            out.end(2)
            continue
        if tag in ("ul", "ol", "menu"):
            out.end(1 if lists else 2)
            first = (x.attr("start") or "").strip() if tag == "ol" else ""
            n = int(first[:12]) if re.fullmatch(r"-?\d{1,10}", first, re.A) else 1
            lists.append([tag == "ol", n if -(2**31) <= n < 2**31 else 1, out.indent])
            todo.append((x, False))
        elif tag == "li":
            out.end(1)
            mark = "- "
            if lists and lists[-1][0]:
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            out.lead = " " * min(out.indent, INDENT) + mark
            out.indent += len(mark)
            todo.append((_Mark(x, len(mark)), False))
        elif tag in ("td", "th", "mtr", "mtd"):  # outside a row, or in a table within a table
            out.text(" ")
        elif tag == "text" and x.foreign == "svg":
            out.end(1)
            todo.append((x, False))
        elif tag == "tspan" and (x.attr("x") or x.attr("y") or x.attr("dy")):
            out.text(" ")
        elif tag in BLOCK:
            out.end(2 if tag in PARAGRAPH else 1)
            if tag in ("dd", "blockquote"):
                out.indent += 2
            todo.append((x, False))
        elif tag == "textarea":
            todo.append((x, False))
        if tag == "pre" or tag == "textarea":
            pre += 1
            if x.kids and isinstance(x.kids[0], str) and x.kids[0].startswith("\n"):
                x.kids[0] = x.kids[0][1:]
        kids = x.kids
        if x.foreign == "math" and tag in ("semantics", "maction"):  # only the first is shown
            kids = [k for k in kids if not isinstance(k, str)][:1]
        elif x.foreign == "math" and tag in SCRIPTS:
            kids = [y for k in kids for y in (" ", k)]
        todo.extend((k, True) for k in reversed(kids))
    out.end(0)
    return "\n".join(out.lines).strip("\n")


class _Mark(Node):
    """The end of a list item, with the width of its mark."""

    __slots__ = ()

    def __init__(self, node: Node, width: int):
        self.tag, self.attrs, self.kids = node.tag, "", [width]


def text_of(html: str | None) -> str | None:
    """The visible text of a page."""
    if html is None:
        return None
    root = parse(html)
    return render(root, Sheet(root) if "<style" in html.lower() else _NO_SHEET)


def _texts(html: pa.Array) -> pa.Array:
    return pa.array([text_of(x) for x in html.to_pylist()], pa.string())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every page."""
    return pages.select(F.col(f"`{id_col}`").alias("page_id"), F.arrow_udf(_texts, "string")(F.col(f"`{html_col}`").cast("string")).alias("text"))
