"""HTML extraction by laying the visible text out as a browser would: blocks, lists and aligned tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm.common import sealed, text_of, unsealed
from attesta.llm.css import Sheet

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style title head template noscript iframe noembed noframes datalist object audio video canvas desc defs metadata annotation annotation-xml".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
BLOCK = PARAGRAPH | frozenset("html body div article aside section nav header footer main address form fieldset li dt dd figcaption details summary hr center legend caption tr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - frozenset("html body li dt dd caption tr summary legend figcaption".split())
#: A start tag of the key ends an open element of the first set, unless one of the second stands between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
HEAD_ONLY = frozenset("title meta link base style script noscript template head html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)|(?P<text>[^<]+|<)", re.DOTALL)
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_GAP = re.compile(r"[ \t\n\r\f]+")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /\n\t") else {}


def tag_end(html: str, at: int) -> int:
    """Where the tag ends whose attributes begin at ``at``: after the next ``>`` outside of quotes; a quote that is never closed
    counts for nothing. -1 for a tag that never ends. Each character is looked at a few times at most."""
    while True:
        m = _STOP.search(html, at)
        if m is None:
            return -1
        if m[0] == ">":
            return m.end()
        close = html.find(m[0], m.end())
        at = close + 1 if close >= 0 else m.end()


def tree(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """The tree in document order: ("open", tag, attributes), ("text", text, {}) and ("close", tag, {}), each open tag closed.

    Implied tags are put in: html, head and body; ends of p, li, dt, dd, option, cells, rows and row groups; rows and row groups
    of cells that stand alone. An end tag without a start tag is left out; the end of a table's or list's parent ends what is
    open inside. From a tag that never ends on, all is text.
    """
    stack: list[str] = []
    count: dict[str, int] = {}
    at = 0

    def push(tag: str, attrs: dict[str, str]) -> tuple[str, str, dict[str, str]]:
        stack.append(tag)
        count[tag] = count.get(tag, 0) + 1
        return "open", tag, attrs

    def pop() -> tuple[str, str, dict[str, str]]:
        tag = stack.pop()
        count[tag] -= 1
        return "close", tag, {}

    def until(ends: set[str], stops: set[str]) -> int:
        """How many elements go so that the outermost of ``ends`` above any of ``stops`` is closed."""
        if not any(count.get(t) for t in ends):
            return 0
        found = 0
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in stops:
                break
            if stack[k] in ends:
                found = len(stack) - k
        return found

    def body() -> Iterator[tuple[str, str, dict[str, str]]]:
        if not count.get("html"):
            yield push("html", {})
        if stack[-1] == "head":
            yield pop()
        if not count.get("body"):
            yield push("body", {})

    while at < len(html):
        m = _TOKEN.match(html, at)
        begin, at = at, m.end()
        tag, shown, inside = (m["tag"] or "").lower(), m["text"], ""
        if tag:
            at = tag_end(html, m.end())
            if at < 0:
                tag, shown, at = "", html[begin:], len(html)
            else:
                inside = html[m.end() : at - 1]
        if shown is not None or m["cdata"] is not None:
            text = shown if shown is not None else m["cdata"]
            if stack and stack[-1] not in ("html", "head") or text.strip(" \t\n\r\f"):
                if not count.get("body"):
                    yield from body()
                yield "text", unescape(text) if shown is not None else text, {}
        elif not tag:
            continue
        elif m["close"]:
            if tag == "p" and not count.get("p"):
                yield from body()
                yield push("p", {})
            if count.get(tag) and tag not in ("html", "body"):
                scope = set() if tag == "table" else {"table"}
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i] == tag or stack[i] in scope)
                if stack[k] == tag:
                    while len(stack) > k:
                        yield pop()
            elif tag == "br":
                yield push("br", {})
                yield pop()
        else:
            attrs = attributes(inside)
            if tag in ("html", "head", "body"):
                if count.get(tag):
                    continue
                if tag != "html" and not count.get("html"):
                    yield push("html", {})
                if tag == "body" and stack[-1] == "head":
                    yield pop()
            elif tag in HEAD_ONLY and not count.get("body"):
                if not count.get("html"):
                    yield push("html", {})
                if not count.get("head"):
                    yield push("head", {})
            elif not count.get("body"):
                yield from body()
            if tag in ENDS_P and count.get("p"):
                for _ in range(until({"p"}, {"table", "td", "th", "button", "object"})):
                    yield pop()
            if tag in IMPLIED_END:
                for _ in range(until(*IMPLIED_END[tag])):
                    yield pop()
            if tag in ("td", "th") and count.get("table") and "tr" not in stack[len(stack) - 1 - stack[::-1].index("table") :]:
                yield push("tr", {})
            yield push(tag, attrs)
            if tag in VOID or inside.endswith("/") and (tag in ("svg", "math") or count.get("svg") or count.get("math")):
                yield pop()
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(html, at)
                raw = html[at : end.start() if end else len(html)]
                at = end.start() if end else len(html)
                yield "text", unescape(raw) if tag in ("title", "textarea") else raw, {}
    while stack:
        yield pop()


def sheet_of(events: list[tuple[str, str, dict[str, str]]]) -> Sheet:
    """The rules of a page's ``style`` elements but those for other media than screens, wherever they stand."""
    texts, reading = [], False
    for kind, tag, attrs in events:
        if kind == "text":
            if reading:
                texts.append(tag)
        elif tag == "style":
            reading = kind == "open" and attrs.get("media", "all").strip().lower() in ("", "all", "screen")
    return Sheet("\n".join(texts))


def unseen(tag: str, attrs: dict[str, str], display: str | None = None) -> bool:
    """Whether an element and all inside it is not shown: by its kind, or by ``display``, which stands above what attributes say."""
    if tag in HIDDEN or tag == "input" and attrs.get("type", "").lower() == "hidden":
        return True
    if display is not None:
        return display == "none"
    return "hidden" in attrs or tag == "dialog" and "open" not in attrs


class _Flow:
    """Lines of one box: inline text collapses its white space, blocks begin new lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = 0
        self.lead: str | None = None

    def text(self, text: str, pre: bool, indent: str) -> None:
        if pre:
            first, *more = text.split("\n")
            self._add(first, indent)
            for t in more:
                self.end(force=True)
                self._add(t, indent)
            return
        parts = _GAP.split(text)
        for k, part in enumerate(parts):
            if k:
                self.space = True
            if part:
                self._add(part, indent)

    def _add(self, part: str, indent: str) -> None:
        if not part:
            return
        if not self.line:
            if self.lines and self.blank:
                self.lines.extend([""] * self.blank)
            self.blank = 0
            self.line.append(self.lead if self.lead is not None else indent)
            self.lead = None
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(part)

    def end(self, force: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        elif force and self.lines:
            self.lines.append("")
        self.space = False

    def paragraph(self) -> None:
        self.end()
        self.blank = 1 if self.lines else 0

    def block(self, lines: list[str], indent: str) -> None:
        self.end()
        for t in lines:
            if not t:
                self.lines.append("")
                continue
            self._add(t, indent)
            self.end()

    def done(self) -> list[str]:
        self.end()
        return self.lines


def width_of(text: str) -> int:
    """Columns that a text takes: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _span(attrs: dict[str, str], name: str, most: int) -> int:
    value = attrs.get(name, "").strip()
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() and len(value) < 7 else 1


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, columns, rows) in columns: each begins where its first column does, two spaces after the widest before it.

    A cell that spans rows is shown in its first one and keeps its columns free in the others; one that spans columns widens
    the last of them where it needs more room. A cell of several lines takes several.
    """
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # column: rows for which it is still taken
    width: dict[int, int] = {}
    for row in rows:
        at, out, new = 0, [], {}
        for lines, columns, depth in row:
            while taken.get(at, 0):
                at += 1
            out.append((at, columns, lines))
            for k in range(at, at + columns) if depth > 1 else ():
                new[k] = depth
            at += columns
        taken = {k: n - 1 for k, n in (taken | new).items() if n > 1}
        placed.append(out)
    size = lambda lines: max(map(width_of, lines), default=0)
    last = 0
    for at, columns, lines in (c for row in placed for c in row):
        last = max(last, at + columns)
        if columns == 1:
            width[at] = max(width.get(at, 0), size(lines))
    for at, columns, lines in sorted((c for row in placed for c in row if c[1] > 1), key=lambda c: c[:2]):
        room = sum(width.get(k, 0) for k in range(at, at + columns)) + 2 * (columns - 1)
        if size(lines) > room:
            width[at + columns - 1] = width.get(at + columns - 1, 0) + size(lines) - room
    begin, ends = [0], 0
    for k in range(last):
        ends += width.get(k, 0) + 2
        begin.append(ends)
    found = []
    for row in placed:
        for i in range(max((len(lines) for *_, lines in row), default=0)):
            line, filled = [], 0
            for at, _, lines in row:
                if i < len(lines) and lines[i]:
                    line += [" " * (begin[at] - filled), lines[i]]
                    filled = begin[at] + width_of(lines[i])
            found.append("".join(line).rstrip())
    return found


def render(html: str) -> str:
    """The visible text: paragraphs apart by an empty line, list items marked and indented, table cells aligned.

    What is hidden goes with all inside it; what is merely invisible keeps its place, and visible elements inside it are shown. Style
    attributes and the simple rules of style sheets decide (:mod:`attesta.llm.css`); what is only kept from screen readers is shown, and
    buttons show their value. Of a select box only the chosen options show: the selected ones, else the first, or all where several may be chosen.
    """
    flow = _Flow()
    flows: list[_Flow] = []
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    spans: list[tuple[int, int]] = []
    lists: list[list] = []
    selects: list[tuple[bool, list[tuple[bool, str]]]] = []
    chosen: list[bool] = []
    skip = pre = 0
    indents = [""]
    visible = [True]
    events, sheet = tree(html), Sheet()
    if "<style" in html or "<style" in html.lower():
        events = list(events)
        sheet = sheet_of(events)
    for kind, tag, attrs in events:
        if skip:
            skip += (kind == "open") - (kind == "close")
        elif kind == "text":
            if visible[-1]:
                flow.text(tag.replace("\r\n", "\n") if pre else tag, pre > 0, indents[-1])
        elif kind == "open":
            display, said = sheet.said(tag, attrs)
            if unseen(tag, attrs, display):
                skip = 1
                continue
            visible.append(said in ("visible", "initial") if said in ("visible", "hidden", "collapse", "initial") else visible[-1])
            if tag == "input":
                if visible[-1] and attrs.get("type", "").lower() in ("submit", "button", "reset"):
                    flow.text(attrs.get("value", ""), False, indents[-1])
            elif tag == "br":
                flow.end(force=True)
            elif tag == "hr":
                flow.paragraph()
            elif tag in ("ul", "ol"):
                (flow.end if lists else flow.paragraph)()
                start = attrs.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                flow.end()
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.lead = indents[-1] + mark
                indents.append(indents[-1] + " " * len(mark))
            elif tag == "blockquote" or tag == "dd":
                flow.paragraph() if tag == "blockquote" else flow.end()
                indents.append(indents[-1] + "  ")
            elif tag == "table":
                flow.paragraph()
                tables.append([])
                flows.append(flow)
                flow = _Flow()
                indents.append("")
            elif tag == "tr" and tables:
                flows[-1].block(flow.done(), indents[-1])
                flow = _Flow()
                tables[-1].append([])
            elif tag in ("td", "th") and tables and tables[-1]:
                flows[-1].block(flow.done(), indents[-1])
                flow = _Flow()
                spans.append((_span(attrs, "colspan", 1000), _span(attrs, "rowspan", 65_534)))
            elif tag == "select":
                selects.append(("multiple" in attrs, []))
                flows.append(flow)
                flow = _Flow()
            elif tag == "option" and selects:
                chosen.append("selected" in attrs)
                flow = _Flow()
            elif tag in PARAGRAPH:
                flow.paragraph()
            elif tag in BLOCK:
                flow.end()
            pre += tag in ("pre", "textarea")
        else:
            visible.pop()
            if tag in ("ul", "ol"):
                if lists:
                    lists.pop()
                (flow.end if lists else flow.paragraph)()
            elif tag == "li":
                flow.end()
                flow.lead = None
                indents.pop()
            elif tag in ("blockquote", "dd"):
                flow.paragraph() if tag == "blockquote" else flow.end()
                indents.pop()
            elif tag in ("td", "th") and tables and tables[-1]:
                tables[-1][-1].append((flow.done(), *spans.pop()))
                flow = _Flow()
            elif tag == "caption" and tables:
                flows[-1].block(flow.done(), indents[-2])
                flow = _Flow()
            elif tag == "table" and tables:
                loose = flow.done()
                flow = flows.pop()
                indents.pop()
                flow.block(loose, indents[-1])
                flow.block([t for t in table_lines(tables.pop()) if t], indents[-1])
                flow.paragraph()
            elif tag == "option" and selects:
                selects[-1][1].append((chosen.pop(), " ".join(flow.done())))
                flow = _Flow()
            elif tag == "select":
                several, options = selects.pop()
                flow = flows.pop()
                shown = [t for on, t in options if on or several] or [t for _, t in options[:1]]
                flow.text(" ".join(shown if several else shown[-1:]), False, indents[-1])
            elif tag in PARAGRAPH:
                flow.paragraph()
            elif tag in BLOCK:
                flow.end()
            pre -= tag in ("pre", "textarea")
    return "\n".join(flow.done()).strip("\n")


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``: the visible text of the whole page, however long. Null and empty pages give empty texts; every row gives
    one row, repeated ones too; an empty table gives an empty result. Where ``out_col`` clashes with a column, the new one stands."""
    pages, named = sealed(pages)
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([render(h) for h in batch.column(len(names)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], [*names, "_out"])

    source = pages.select("*", text_of(named[html_col]).alias("_html"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields)
    return unsealed(source.mapInArrow(run, f"{kept}, _out string"), named, {out_col: "_out"})
