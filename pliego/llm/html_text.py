"""Layout-aware rendering of HTML to plain text.

A tree builder reads tags and text, closes elements that HTML leaves open
(``<p>``, ``<li>``, table parts, ``<option>``, ``<dt>``), opens missing table
rows, and drops end tags without a start.  The renderer leaves out what a
browser with a window of ``SCREEN`` pixels does not show, separates blocks, indents and marks list items, sets
table cells in aligned columns and keeps the lines of ``<pre>``.
"""
from __future__ import annotations

import html
import re
from collections.abc import Callable, Generator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

# Fixed values of HTML: element sorts, what an opening tag closes, and how far it looks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template title noscript iframe object audio video canvas datalist "
                   "noembed noframes area base col link meta param source track".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre "
                  "search section summary table ul legend caption".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
          "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"},
          "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "body": {"head"}}
SCOPE = {"li": frozenset("ul ol menu table".split()), "dt": frozenset(["dl", "table"]), "dd": frozenset(["dl", "table"]),
         "option": frozenset(["select", "datalist"]), "optgroup": frozenset(["select"])}
TABLE_SCOPE = frozenset(["table"])
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "caption", "legend"}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*(?:>|$)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?(?=[\s;]|$)", re.I)
CSS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[{};]|[^{};\"']+|[\"']", re.S)
SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)$")
WHITE = re.compile(r"[ \t\n\r\f]+")
#: Elements inside svg or math that show nothing.
FOREIGN_UNSEEN = frozenset("title desc defs metadata symbol clippath mask marker pattern annotation annotation-xml mphantom".split())
MEDIA = re.compile(r"(?:(not|only)\s+)?([a-z][\w-]*)?\s*(?:\band\b)?(.*)", re.S)
FEATURE = re.compile(r"(?:(min|max)-)?(?:device-)?(width|height)\s*(:|[<>]=?|=)\s*(\d*\.?\d+)(px|em|rem|)")
#: Window that media queries are answered for, and its other features.
SCREEN = {"width": 1280, "height": 720}
FEATURES = {"orientation": "landscape", "hover": "hover", "pointer": "fine", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference"}
#: Widest table cell that others are padded to; longer cells keep their text and break the alignment.
CELL = 60


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(tag: str, start: int) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(tag, start, len(tag) - tag.endswith(">")):
        value = next((v for v in m.groups()[1:] if v is not None), "")
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out


def build(source: str, aria_hides: bool = False) -> tuple[Node, list[str]]:
    """The tree of a page and the texts of its style sheets for screens."""
    root = Node("#root", {})
    stack, styles, at = [root], [], 0
    foreign = re.search(r"<(?:svg|math)\b", source, re.I) is not None

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    def close(names, scope) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    def element(name: str, attrs: dict[str, str]) -> Node:
        node = Node(name, attrs)
        stack[-1].children.append(node)
        return node

    while True:
        m = TOKEN.search(source, at)
        if not m:
            text(source[at:])
            return root, styles
        text(source[at:m.start()])
        at, tag = m.end(), m[0]
        if tag.startswith("<![CDATA["):
            text(tag[9:].removesuffix("]]>"))
            continue
        if tag[1] in "!?":
            continue
        found = NAME.match(tag)
        name = found[1].lower()
        if tag[1] == "/":
            if name == "br":
                element("br", {})
            elif name == "p" and all(n.tag != "p" for n in stack):
                element("p", {})
            elif any(n.tag == name for n in stack[1:]):
                close({name}, () if name in ("table", "body", "html") else TABLE_SCOPE if name not in TABLE_SCOPE else ())
            continue
        if name in ENDS_P:
            close({"p"}, BLOCK - {"p"})
        for other in sorted(CLOSES.get(name, ())):
            close({other}, SCOPE.get(name, TABLE_SCOPE))
        if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            stack.append(element("tr", {}))
        attrs = attributes(tag, found.end())
        node = element(name, attrs)
        if aria_hides and attrs.get("aria-hidden", "").lower() == "true":
            attrs["hidden"] = ""
        if foreign and (name in FOREIGN_UNSEEN or name == "text" or tag.endswith("/>")) and any(n.tag in ("svg", "math") for n in stack):
            if name in FOREIGN_UNSEEN:
                attrs["hidden"] = ""
            elif name == "text":
                attrs["svg text"] = ""
            if tag.endswith("/>"):
                continue
        if name in VOID or tag.endswith("/>") and name not in RAW and name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
            raw = source[at:end.start() if end else len(source)]
            at = len(source) if not end else source.find(">", end.start()) + 1 or len(source)
            if name == "style":
                if on_screen(attrs.get("media", "")):
                    styles.append(raw)
            elif name == "textarea":
                node.children.append(html.unescape(raw))
            continue
        stack.append(node)


def feature(text: str) -> bool | None:
    """If a media feature holds for SCREEN; None if that isn't known."""
    m = FEATURE.fullmatch(text)
    if not m:
        name, _, value = (x.strip() for x in text.partition(":"))
        return FEATURES[name] == value if name in FEATURES and value else None
    if bool(m[1]) and m[3] != ":" or not m[5] and float(m[4]):
        return None
    own, value = SCREEN[m[2]], float(m[4]) * (16 if m[5] in ("em", "rem") else 1)
    sort = {"min": ">=", "max": "<="}.get(m[1], m[3])
    return {">=": own >= value, "<=": own <= value, ">": own > value, "<": own < value}.get(sort, own == value)


def on_screen(media: str) -> bool:
    """If one of the media queries surely holds on a screen; an empty list does."""
    for query in media.lower().split(",") if media.strip() else ():
        m = MEDIA.fullmatch(query.strip())
        kind, rest = m[2] or "all", m[3].strip()
        inner = [feature(x.strip()) for x in re.findall(r"\(([^()]*)\)", rest)]
        if not m[2] and not inner or re.search(r"\(\s*\(|\bnot\b", rest):
            continue
        if re.search(r"\bor\b", rest):
            holds = True if True in inner else None if None in inner else False
        else:
            holds = False if False in inner else None if None in inner else True
        if kind not in ("all", "screen"):
            holds = False
        if holds is (m[1] != "not"):
            return True
    return not media.strip()


def sheet_rules(sheet: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen, in their order.

    Rules nested in others, and in at-rules that may not hold, are left out.
    """
    out: list[tuple[str, str]] = []
    blocks: list[tuple[str, str, list[str]]] = [("group", "", [])]
    lead = ""
    for t in [*CSS.findall(re.sub(r"/\*.*?(?:\*/|$)", "", sheet, flags=re.S)), None]:
        while t in ("}", None) and len(blocks) > 1:  # the end closes what is open
            kind, selectors, own = blocks.pop()
            if kind == "rule":
                out.append((selectors, ";".join([*own, lead])))
            lead = ""
            if t:
                break
        if t == "{":
            head, lead, kind = lead.strip(), "", "rule"
            name, _, rest = head.partition("(") if head[:7].lower() == "@media(" else head.partition(" ")
            if blocks[-1][0] != "group":
                kind = "skip"
            elif head.startswith("@"):
                holds = {"@media": lambda: on_screen(head[6:]), "@layer": lambda: True,
                         "@supports": lambda: not rest.strip().lower().startswith("not")}.get(name.split("\n")[0].strip().lower())
                kind = "group" if holds and holds() else "skip"
            blocks.append((kind, head, []))
        elif t == ";":
            blocks[-1][2].append(lead)
            lead = ""
        elif t not in ("}", None):
            lead += t
    return out


def declared(style: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a list of declarations: (is important, value)."""
    out: dict[str, tuple[bool, str]] = {}
    for m in DECLARED.finditer(style):
        name, value = m[1].lower(), (bool(m[3]), m[2].lower())
        if value[0] >= out.get(name, value)[0]:
            out[name] = value
    return out


def hidden_rules(styles: list[str]) -> dict[str, list[tuple]]:
    """Rules of one element (tag, classes, id) on its display or visibility, under one of their marks.

    Empty if none of them hides anything.
    """
    out: dict[str, list[tuple]] = {}
    order, hides = 0, False
    for s in styles:
        for selectors, text in sheet_rules(s):
            own = declared(text)
            if not own:
                continue
            for part in selectors.split(","):
                sel = SELECTOR.match(part.strip())
                if sel and sel[0]:
                    marks = re.findall(r"[.#][\w-]+", sel[2])
                    tag, classes = (sel[1] or "").lower(), frozenset(x[1:] for x in marks if x[0] == ".")
                    ids = [x for x in marks if x[0] == "#"]
                    order, hides = order + 1, hides or hiding(own)
                    rank = (False, len(ids), len(marks) - len(ids), bool(tag), order)
                    out.setdefault((ids or marks or [tag])[0], []).append((tag, classes, ids[0][1:] if ids else "", rank, own))
    return out if hides else {}


def hiding(own: dict[str, tuple[bool, str]]) -> bool:
    return own.get("display", (0, ""))[1] == "none" or own.get("visibility", (0, ""))[1] in ("hidden", "collapse")


def hidden(node: Node, rules: dict[str, list[tuple]]) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a:
        return True
    if node.tag == "input" or node.tag == "dialog" and "open" not in a:
        return True
    inline = declared(a["style"]) if "style" in a else {}
    if not rules:
        return hiding(inline)
    best = {k: ((v[0], True), v[1]) for k, v in inline.items()}
    classes = set(a.get("class", "").split())
    for key in (node.tag, f"#{a.get('id')}", *("." + c for c in classes)):
        for tag, cs, i, rank, own in rules.get(key, ()):
            if (not tag or tag == node.tag) and cs <= classes and (not i or i == a.get("id")):
                for k, (important, value) in own.items():
                    at = (important, *rank)
                    if k not in best or at > best[k][0]:
                        best[k] = (at, value)
    return hiding({k: (False, v) for k, (_, v) in best.items()})


class Page:
    """Lines put together from runs of text; keeps at most one blank line between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent: list[str] = []
        self.mark = ""
        self.blank = False
        self.space = False

    def add(self, s: str, keep: bool = False) -> None:
        if keep:
            for n, part in enumerate(s.replace("\r\n", "\n").split("\n")):
                if n:
                    self.end(True)
                if part:
                    self.line.append(part)
            return
        s = WHITE.sub(" ", s)
        if s.startswith(" "):
            s, self.space = s[1:], True
        if not s:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = s.endswith(" ")
        self.line.append(s[:-1] if self.space else s)

    def end(self, always: bool = False) -> None:
        """Ends the line; ``always``: an empty one as well."""
        if self.line or always:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = "".join(self.indent)
            if self.mark:
                lead, self.mark = "".join(self.indent[:-1]) + self.mark, ""
            self.lines.append((lead + "".join(self.line)).rstrip())
        self.line, self.space = [], False

    def gap(self) -> None:
        self.end()
        self.blank = True

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def finished(step: Generator):
    """What a generator returns.  Those it yields are run first, on a stack instead of in frames: tables nest deeply."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def render(node: Node, rules: dict, page: Page) -> Generator:
    """Adds what shows of a tree to a page.  A stack of steps instead of recursion: pages nest deeply."""
    steps: list[tuple] = [("in", node, False, [])]
    while steps:
        kind, n, pre, lists = steps.pop()
        if kind == "do":
            n()
            continue
        if isinstance(n, str):
            page.add(n, pre)
            continue
        if hidden(n, rules):
            continue
        tag = n.tag
        if tag == "br":
            page.end(True)
            continue
        if tag == "img":
            page.add(n.attrs.get("alt", ""))
            continue
        if tag == "table":
            page.gap()
            for line in (yield table_lines(n, rules)):
                page.line.append(line)
                page.end(True)
            page.gap()
            continue
        after: list[Callable[[], None]] = []
        if tag in SPACED and not (tag in ("ul", "ol") and lists):
            page.gap()
            after.append(page.gap)
        elif tag in BLOCK:
            page.end()
            after.append(page.end)
        if tag == "hr":
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            start = n.attrs.get("start", "1")
            lists = [*lists, [tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1]]
        elif tag == "li":
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            page.indent.append(" " * len(mark))
            page.mark = mark
            after.append(lambda: (page.indent.pop(), setattr(page, "mark", "")))
        elif tag in ("blockquote", "dd"):
            page.indent.append("    ")
            after.append(page.indent.pop)
        elif "svg text" in n.attrs:
            page.end()
            after.append(page.end)
        elif tag == "q":
            page.add('"')
            after.append(lambda: page.add('"'))
        children = n.children
        if tag == "details" and "open" not in n.attrs:
            children = [c for c in children if not isinstance(c, str) and c.tag == "summary"]
        pre = pre or tag in ("pre", "textarea")
        for step in reversed(after):  # the block ends before its indent goes
            steps.append(("do", step, False, lists))
        if after and tag in ("li", "blockquote", "dd"):
            steps.append(("do", page.end, False, lists))
        steps += [("in", c, pre, lists) for c in reversed(children)]


def table_lines(table: Node, rules: dict) -> Generator:
    """The rows of a table, cells in columns of even width; lines of a cell stand below each other."""
    rows, lines = [], []
    todo = list(reversed(table.children))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if n.strip():
                rows.append([([WHITE.sub(" ", n).strip()], 1)])
        elif hidden(n, rules):
            continue
        elif n.tag in ("tbody", "thead", "tfoot", "colgroup"):
            todo += reversed(n.children)
        elif n.tag == "tr":
            cells = [c for c in n.children if isinstance(c, str) and c.strip() or isinstance(c, Node) and not hidden(c, rules)]
            row = []
            for c in cells:
                row.append(((yield cell_lines(c, rules)), span(c)))
            rows.append(row)
        else:
            rows.append([((yield cell_lines(n, rules)), 1)])
    width: dict[int, int] = {}
    for cells in rows:
        at = 0
        for text, wide in cells:
            if wide == 1:
                width[at] = max(width.get(at, 0), *(min(CELL, len(x)) for x in text), 0)
            at += wide
    for cells in rows:
        for k in range(max((len(text) for text, _ in cells), default=0)):
            out, at, due = [], 0, 0
            for text, wide in cells:
                out.append(text[k] if k < len(text) else "")
                due = sum(width.get(c, 0) for c in range(at, at + wide)) + 2 * (wide - 1)
                out.append(" " * max(0, due - len(out[-1])) + "  ")
                at += wide
            lines.append("".join(out).rstrip())
    return [x for x in lines if x]


def span(cell) -> int:
    s = cell.attrs.get("colspan", "1") if isinstance(cell, Node) else "1"
    return max(1, min(1000, int(s))) if s.isdecimal() and len(s) < 6 else 1


def cell_lines(cell, rules: dict) -> Generator:
    page = Page()
    if isinstance(cell, str):
        page.add(cell)
    else:
        inner = Node("#cell", {})
        inner.children = cell.children if cell.tag in ("td", "th", "caption") else [cell]
        yield render(inner, rules, page)
    return [x for x in page.text().split("\n") if x] or [""]


def html_to_text(source: str | None, aria_hides: bool = True) -> str | None:
    """The visible text of a page; null stays null, an empty page gives an empty text.

    aria_hides: text hidden from screen readers only is left out as well.
    """
    if not source:
        return source
    root, styles = build(source, aria_hides)
    page = Page()
    finished(render(root, hidden_rules(styles), page))
    return page.text()


def extract_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` with ``text``, the rendered page; an input column of that name is replaced, repeated rows stay.

    Text with ``aria-hidden`` is on the screen and stays.
    """
    def make():
        return lambda pages: [pa.array([html_to_text(p, aria_hides=False) for p in pages], pa.string())]
    return add_columns(df, html_col, T.StructType([T.StructField("text", T.StringType())]), make)
