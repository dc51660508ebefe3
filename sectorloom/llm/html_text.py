"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout-aware rendering.

All visible text comes out: blocks stand apart, list items carry their marks and indents, and table
cells are aligned in columns. The parser never recurses, so that depth is bounded by memory alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorloom.llm.common import bounded_batches, lean_arrays

# fixed values: element names by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas svg datalist".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset".split())
BLOCKS = SPACED | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup li main menu nav section summary legend tr caption option optgroup".split())
ENDS_P = (SPACED | frozenset("address article aside center details dialog div dd dt figcaption footer form header hr main menu nav section summary li".split())) - {"html", "body"}
CELLS = frozenset(("td", "th"))
ROW_GROUPS = frozenset(("thead", "tbody", "tfoot"))
#: An open element of the first kind ends before a new one of the key; nothing beyond the second kind ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": (ROW_GROUPS | {"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": (ROW_GROUPS | {"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": (ROW_GROUPS | {"tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
for _h in ("h1", "h2", "h3", "h4", "h5", "h6"):
    CLOSES[_h] = ({"h1", "h2", "h3", "h4", "h5", "h6"}, BLOCKS - {"h1", "h2", "h3", "h4", "h5", "h6"})

_tag = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>").match
_loose_tag = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>").match
_attribute = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?").findall
_space = re.compile(r"[ \t\n\r\f]+").sub
_css_token = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|<!--|-->|[{}]", re.S).finditer
_display = re.compile(r"(?:^|;)\s*(display|content-visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.I).findall
_visibility = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I).search
_compound = re.compile(r"(?:[A-Za-z][\w-]*)?(?:[.#][A-Za-z_-][\w-]*)*").fullmatch
_simple = re.compile(r"[.#]?[\w-]+").findall


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def _attrs(s: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if s and not s.isspace():
        for name, a, b, c in _attribute(s):
            out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(source: str) -> tuple[Node, Styles]:
    """The tree, and the rules of its style sheets that set display."""
    root = Node("#root")
    stack, sheets = [root], []
    opened: Counter[str] = Counter()
    last_end, at, n = source.rfind(">"), 0, len(source)

    def close(names, barrier) -> None:
        """Ends the innermost open element of these names, unless a barrier lies before it."""
        if not any(opened[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                opened.subtract(x.tag for x in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in barrier:
                return

    def pop() -> None:
        opened[stack.pop().tag] -= 1

    def open_(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        stack.append(node)
        opened[tag] += 1
        return node

    while at < n:
        lt = source.find("<", at)
        if lt < 0 or lt > last_end:
            stack[-1].children.append(source[at:])
            break
        if lt > at:
            text = source[at:lt]
            if stack[-1].tag == "head" and not text.isspace():
                pop()
            stack[-1].children.append(text)
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), lt):
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _tag(source, lt) or _loose_tag(source, lt)
        if m is None:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body"):
                close({tag}, {"table", "td", "th"} - {tag} if tag not in ("table", "tr", "td", "th") and tag not in ROW_GROUPS else {"table"} - {tag})
            continue
        attrs = _attrs(m[3])
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            pop()
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag in ENDS_P:
            close({"p"}, {"table", "td", "th", "button", "caption"})
        if tag in CLOSES:
            names, barrier = CLOSES[tag]
            while any(opened[x] for x in names) and any(x.tag in names for x in stack[_floor(stack, barrier) :]):
                close(names, barrier)
        if tag in CELLS and stack[-1].tag in ("table", *ROW_GROUPS):
            open_("tr", {})
        node = open_(tag, attrs)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            pop()
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            node.children.append(body)
            pop()
            at = n if end is None else source.find(">", end.start()) + 1 or n
            if tag == "style" and _on_screen(attrs.get("media", "")) and not opened["noscript"] and not opened["template"]:
                sheets.append(body)
    return root, _styles(sheets)


def _on_screen(media: str) -> bool:
    """Whether one of the media queries holds on any screen."""
    return any(" ".join(q.split()).lower() in ("", "all", "screen", "only all", "only screen") for q in media.split(","))


def _rules(css: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of the rules at top level or in unconditional @media blocks for screens, in order.

    Braces in comments and quoted text don't count; blocks that are never closed end with the sheet.
    """
    out: list[tuple[str, str]] = []
    opened: list[tuple[str, bool, list[str]]] = []  # of each open block the lead, whether it holds, and its declarations
    now: list[str] = []
    at = 0

    def end() -> None:
        lead, holds, own = opened.pop()
        if holds and not lead.startswith("@"):
            out.append((lead, "".join([*own, *now])))
        now.clear()

    for m in _css_token(css):
        now.append(css[at : m.start()])
        at, token = m.end(), m[0]
        if token == "{":
            before, semicolon, lead = "".join(now).rpartition(";")
            lead = lead.strip()
            now.clear()
            holds = not opened or opened[-1][1] and opened[-1][0].startswith("@")
            if opened:
                opened[-1][2].append(before + semicolon)
            if lead.startswith("@"):
                holds = holds and re.match(r"@media\b", lead, re.I) is not None and _on_screen(lead[6:])
            opened.append((lead, holds, []))
        elif token == "}":
            if opened:
                end()
            now.clear()
        else:
            now.append(" " if token.startswith(("/*", "<!--", "-->")) else token)
    now.append(css[at:])
    while opened:
        end()
    return out


#: By one simple selector of each rule: (all its simple selectors, property, (important, specificity, place), whether it hides).
Styles = dict[str, list[tuple[set[str], str, tuple, bool]]]


def _hides(name: str, value: str) -> bool:
    return value.lower() == ("none" if name.lower() == "display" else "hidden")


def _styles(sheets: list[str]) -> Styles:
    """The rules with selectors without combinators; empty if none hides."""
    out: Styles = {}
    hiding, place = False, 0
    for css in sheets:
        if "display" not in css.lower() and "content-visibility" not in css.lower():
            continue
        for selectors, declarations in _rules(css):
            for name, value, important in _display(declarations):
                place += 1
                for selector in map(str.strip, selectors.split(",")):
                    if not selector or not _compound(selector):
                        continue
                    parts = [x if x[0] in ".#" else x.lower() for x in _simple(selector)]
                    weight = (sum(x[0] == "#" for x in parts), sum(x[0] == "." for x in parts), sum(x[0] not in ".#" for x in parts))
                    hides = _hides(name, value)
                    hiding |= hides
                    out.setdefault(parts[-1], []).append((set(parts), name.lower(), (bool(important), 0, *weight, place), hides))
    return out if hiding else {}


def _floor(stack: list[Node], barrier) -> int:
    """Where the part of the stack begins that lies within the innermost barrier."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in barrier:
            return i + 1
    return 1


class _Flow:
    """Lines of a block context."""

    __slots__ = ("lines", "now", "gap", "indent", "mark", "space")

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.indent, self.mark, self.space = "", "", False

    def text(self, s: str) -> None:
        s = _space(" ", s)
        if s.startswith(" "):
            self.space = True
            s = s[1:]
        if not s:
            return
        if self.space and self.now:
            self.now.append(" ")
        self.space = s.endswith(" ")
        self.now.append(s[:-1] if self.space else s)

    def end_line(self, forced: bool = False) -> None:
        if self.now or forced:
            self.put("".join(self.now))
            self.now = []
        self.space = False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        lead = self.indent
        if self.mark:
            lead, self.mark = self.indent[: -len(self.mark)] + self.mark, ""
        self.lines.append((lead + line).rstrip())

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap |= spaced

    def whole(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


#: Columns are padded up to so many characters each, and lines up to so many before a cell; text beyond is kept, two spaces apart.
WIDEST, FARTHEST = 80, 400
#: Rows that a cell may span.
ROWS = 65534
#: A cell's text, and how many columns and rows it spans.
Cell = tuple[str, int, int]


def _placed(rows: list[list[Cell]]) -> list[list[tuple[int, str, int]]]:
    """(column, text, span) of each row's cells; the columns of a cell that spans rows stay free below it."""
    taken: dict[int, int] = {}
    out = []
    for row in rows:
        at, own, down = 0, [], {}
        for text, span, height in row:
            while at in taken:
                at += 1
            own.append((at, text, span))
            if height > 1:
                down |= dict.fromkeys(range(at, at + span), height)
            at += span
        taken = {c: n - 1 for c, n in (taken | down).items() if n > 1}
        out.append(own)
    return out


def _table(rows: list[list[Cell]]) -> list[str]:
    """Cells in columns as wide as their widest line; a cell that spans columns doesn't widen them."""
    placed = _placed(rows)
    widths: dict[int, int] = {}
    for row in placed:
        for at, text, span in row:
            wide = max(map(len, text.split("\n"))) if span == 1 else 0
            widths[at] = max(widths.get(at, 0), min(wide, WIDEST))
    begins, begin = {}, 0
    for at in sorted(widths):
        begins[at] = min(begin, FARTHEST)
        begin += widths[at] + 2
    out = []
    for row in placed:
        cells = [(begins[at], text.split("\n")) for at, text, _ in row]
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for begin, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(begin) if not line or len(line) + 2 <= begin else line + "  "
                    line += lines[k]
            out.append(line.rstrip())
    return out


def _unseen(node: Node, styles: Styles, parent: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return True
    if parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary":
        return True
    # of the rules that set a property the strongest one holds
    best: dict[str, tuple[tuple, bool]] = {}
    if styles:
        own = {node.tag, *("." + c for c in a.get("class", "").split())}
        if "id" in a:
            own.add("#" + a["id"])
        for x in own:
            for needs, name, weight, hides in styles.get(x, ()):
                if needs <= own and (name not in best or weight > best[name][0]):
                    best[name] = weight, hides
    if a and (s := a.get("style")):
        for place, (name, value, important) in enumerate(_display(s)):
            weight = (bool(important), 1, place)
            if name.lower() not in best or weight > best[name.lower()][0]:
                best[name.lower()] = weight, _hides(name, value)
    return any(hides for _, hides in best.values())


def render(source: str) -> str:
    """The visible text of an HTML source."""
    root, styles = parse(source)
    flows = [_Flow()]
    tables: list[list[list[Cell]]] = []
    lists: list[list] = []
    pre, dark = 0, [False]
    work: list = [(root, root, False)]
    while work:
        node, parent, leaving = work.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if dark[-1] or parent.tag == "details" and "open" not in parent.attrs or parent.tag in ("table", "tr", *ROW_GROUPS) and node.isspace():
                continue
            text = html.unescape(node) if "&" in node else node
            if pre:
                first, *more = text.split("\n")
                flow.now.append(first)
                for line in more:
                    flow.end_line(forced=True)
                    flow.now.append(line)
                flow.now = [x for x in flow.now if x]
            else:
                flow.text(text)
            continue
        tag = node.tag
        if not leaving:
            if _unseen(node, styles, parent):
                continue
            v = _visibility(node.attrs["style"]) if "style" in node.attrs else None
            dark.append(dark[-1] if v is None else v[1].lower() != "visible")
            work.append((node, parent, True))
            work.extend((c, node, False) for c in reversed(node.children))
            if tag == "br":
                flow.end_line(forced=True)
            elif tag == "hr":
                flow.block(True)
            elif tag == "q":
                flow.text("“")
            elif tag == "input" and node.attrs.get("type", "").lower() in ("submit", "button", "reset") and not dark[-1]:
                flow.text(node.attrs.get("value", ""))
            elif tag in CELLS and tables:
                flows.append(_Flow())
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in BLOCKS:
                flow.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag == "table":
                tables.append([])
            elif tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "")
                lists.append([tag, int(start) if re.fullmatch("-?[0-9]{1,9}", start) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                flow.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                node.attrs["#mark"] = flow.mark
                flow.indent += " " * len(flow.mark)
            elif tag in ("blockquote", "dd"):
                flow.indent += "  "
            elif tag == "pre":
                pre += 1
            continue
        dark.pop()
        if tag == "q":
            flow.text("”")
        elif tag in CELLS and tables:
            span, height = node.attrs.get("colspan", "1"), node.attrs.get("rowspan", "1")
            if not tables[-1]:
                tables[-1].append([])
            # no rows means all that follow
            height = int(height) or ROWS if re.fullmatch("[0-9]{1,5}", height) else 1
            tables[-1][-1].append((flow.whole(), min(1000, int(span)) if re.fullmatch("[1-9][0-9]{0,5}", span) else 1, height))
            flows.pop()
        elif tag == "table":
            flow.end_line()
            for line in _table(tables.pop()):
                flow.put(line)
            flow.gap = 1
        elif tag in BLOCKS and not (tag == "tr" and tables):
            flow.block(tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1))
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "li":
            flow.indent = flow.indent[: -len(node.attrs["#mark"])]
            flow.mark = ""
        elif tag in ("blockquote", "dd"):
            flow.indent = flow.indent[:-2]
        elif tag == "pre":
            pre -= 1
    return flows[0].whole()


def _rendered(sources: pa.Array) -> pa.Array:
    return pa.array([None if s is None else render(s) for s in sources.to_pylist()], pa.string())


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages -> all columns and ``text``, the visible text of the whole HTML in ``column``.

    A null source has a null text, an empty one an empty text. Repeated rows and null ids pass through;
    a column named text is replaced. Broken markup is read as browsers would, never an error. An empty
    table gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    return pages.withColumn("text", F.arrow_udf(lean_arrays(_rendered), "string")(F.col(column).cast("string")))
