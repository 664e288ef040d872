"""HTML extraction: a small tree builder and a layout-aware text renderer.

The builder follows the parsing rules that decide which text belongs where:
void elements, implied end tags, raw-text elements, character references and
unclosed elements. The renderer drops what a browser doesn't show and lays out
the rest: blocks on lines of their own, paragraphs apart, list markers with
indentation, and the cells of a table aligned in columns.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.kernels import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never shown, whatever is inside.
HIDDEN = frozenset("head script style title template noscript iframe object audio video canvas datalist noembed noframes".split())
#: Start tags that may stand in a head; any other ends it.
IN_HEAD = frozenset("base link meta noframes noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: A blank line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: Start tags that end an open <p>.
ENDS_P = BLOCK - frozenset("body caption html legend option optgroup td th tr tbody thead tfoot".split())
#: Start tag -> open elements that it ends, and the elements at which the search stops.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
}
SCOPE = frozenset(["table", "td", "th", "caption", "html", "button", "object", "template"])

WHITE = " \t\n\r\f"
TAG_NAME = re.compile(r"[a-zA-Z][^ \t\n\r\f/>]*")
BEFORE_NAME, NAME = re.compile(r"[ \t\n\r\f/]*"), re.compile(r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*")
EQUALS, UNQUOTED = re.compile(r"[ \t\n\r\f]*=[ \t\n\r\f]*"), re.compile(r"[^ \t\n\r\f>]*")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
NUMBER = re.compile(r"\s*(-?[0-9]{1,9})")
BLANKS = re.compile(r"[ \t\r\n\f]+")
#: Parts of a table; what else stands in one goes before it.
TABLE_PARTS = frozenset("tbody thead tfoot tr td th".split())


class Node:
    """An element; ``holds`` says that cells or rows of the table around it are inside."""

    __slots__ = ("tag", "attrs", "children", "holds")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.holds = tag, attrs or {}, [], False


def attributes(source: str, at: int) -> tuple[dict[str, str], int] | None:
    """The attributes of a tag from behind its name on, and where it ends; None if it doesn't."""
    found: dict[str, str] = {}
    n = len(source)
    while True:
        at = BEFORE_NAME.match(source, at).end()
        if at >= n:
            return None
        if source[at] == ">":
            return found, at + 1
        name = NAME.match(source, at)
        at, value = name.end(), ""
        equals = EQUALS.match(source, at)
        if equals:
            at = equals.end()
            if source[at : at + 1] in ("'", '"'):
                end = source.find(source[at], at + 1)
                if end < 0:  # a quote that is never closed ends with the tag
                    end = source.find(">", at)
                    if end < 0:
                        return None
                    value, at = source[at + 1 : end], end
                else:
                    value, at = source[at + 1 : end], end + 1
            else:
                unquoted = UNQUOTED.match(source, at)
                value, at = unquoted[0], unquoted.end()
        found.setdefault(name[0].lower(), value)


class Builder:
    """The tree under construction, with the places of the open elements by tag, so that no end tag searches the stack."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}
        self.in_body = False

    def close(self, names, stop) -> None:
        """Ends the innermost open element of these names, unless one of ``stop`` is open inside it."""
        innermost = max((self.open[t][-1] for t in names if self.open.get(t)), default=0)
        if innermost and innermost >= max((self.open[t][-1] for t in stop if self.open.get(t)), default=0):
            for node in self.stack[innermost:]:
                self.open[node.tag].pop()
            del self.stack[innermost:]

    def leave_head(self) -> None:
        if self.open.get("head"):
            self.close(("head",), ())
        self.in_body = True

    def put(self, text: str) -> None:
        if not text:
            return
        if self.stack[-1].tag in ("html", "head") and not self.in_body:
            if not text.strip(WHITE):
                return
            self.leave_head()
        self.stack[-1].children.append(html.unescape(text) if "&" in text else text)

    def start(self, tag: str, attrs: dict[str, str]) -> Node | None:
        """The new element of a start tag; None for what has no element of its own."""
        if tag == "html":
            return None
        if tag == "body":
            self.leave_head()
            self.root.attrs.update(attrs)
            return None
        if tag == "head":
            if self.in_body or self.open.get("head"):
                return None
        elif tag not in IN_HEAD and self.stack[-1].tag in ("html", "head"):
            self.leave_head()
        if tag in ENDS_P:
            self.close(("p",), SCOPE)
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag in TABLE_PARTS and self.open.get("table"):
            for place in range(len(self.stack) - 1, self.open["table"][-1], -1):
                if self.stack[place].holds:
                    break
                self.stack[place].holds = True
        if tag not in VOID and tag not in RAW:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)
        return node


def tree(source: str) -> Node:
    """The element tree of a page; text stands in it as strings with references decoded.

    One pass over the source. A tag that never ends is text, as all behind it.
    """
    b = Builder()
    at, n = 0, len(source)
    while at < n:
        mark = source.find("<", at)
        if mark < 0:
            b.put(source[at:])
            break
        closing = source.startswith("/", mark + 1)
        name = TAG_NAME.match(source, mark + 1 + closing)
        if not name:
            if source.startswith("<!--", mark):
                b.put(source[at:mark])
                end = source.find("-->", mark + 4)
                at = end + 3 if end >= 0 else n
            elif closing or source[mark + 1 : mark + 2] in ("!", "?"):
                end = source.find(">", mark)
                b.put(source[at : mark if end >= 0 else n])
                at = end + 1 if end >= 0 else n
            else:
                b.put(source[at : mark + 1])
                at = mark + 1
            continue
        rest = attributes(source, name.end())
        if rest is None:
            b.put(source[at:])
            break
        b.put(source[at:mark])
        at, tag = rest[1], name[0].lower()
        if closing:
            if tag == "br":
                b.start("br", {})
            elif tag not in ("html", "body"):
                b.close((tag,), ("html",) if tag in SCOPE else SCOPE)
            continue
        node = b.start(tag, rest[0])
        if node is not None and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[ \t\n\r\f/>])", re.I).search(source, at)
            inside = source[at : end.start() if end else n]
            if tag in ("textarea", "xmp"):
                node.children.append(html.unescape(inside) if tag == "textarea" else inside)
            after = source.find(">", end.end()) if end else -1
            at = after + 1 if after >= 0 else n
    return b.root


class Page:
    """Lines under construction: pending white space, the margin before the next block, indentation."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = self.margin = False

    def end(self) -> None:
        self.lines.append("".join(self.line).rstrip())
        self.line = []

    def flush(self) -> None:
        if any(x.strip() for x in self.line):
            self.end()
        self.line, self.gap = [], False

    def block(self, margin: bool) -> None:
        self.flush()
        self.margin |= margin

    def write(self, text: str, indent: str, mark: str = "") -> None:
        if not self.line:
            if self.margin and self.lines:
                self.lines.append("")
            self.margin = False
            # a list marker stands in the indentation of its item's first line
            self.line.append(indent[:-2] + mark if mark else indent)
        self.line.append(text)


def hidden(node: Node) -> bool:
    return node.tag in HIDDEN or bool(node.attrs) and ("hidden" in node.attrs or bool(UNSEEN.search(node.attrs.get("style", ""))))


def number_of(node: Node, name: str, default: int) -> int:
    found = NUMBER.match(node.attrs.get(name, ""))
    return int(found[1]) if found else default


def parts_of(table: Node) -> tuple[list, list[Node], list[list[Node]]]:
    """(what stands before the table, its captions, the cells of each row), not looking into cells and tables inside."""
    before: list = []
    captions: list[Node] = []
    rows: list[list[Node]] = []
    fresh = True  # a cell begins a row
    todo: list = list(reversed(table.children))
    while todo:
        item = todo.pop()
        if item is None:
            fresh = True
        elif isinstance(item, str):
            if item.strip(WHITE):
                before.append(item)
        elif hidden(item) or item.tag in ("colgroup", "col"):
            continue
        elif item.tag in ("td", "th"):
            if fresh:
                rows.append([])
            fresh = False
            rows[-1].append(item)
        elif item.tag == "caption":
            captions.append(item)
        elif item.tag in TABLE_PARTS:
            fresh = True
            todo += [None, *reversed(item.children)]
        elif item.holds or item.tag == "form":
            todo += reversed(item.children)
        else:
            before.append(item)
    return before, captions, rows


def table_lines(rows: list[list[Node]], tables: dict[int, tuple]) -> list[str]:
    """A line for each line of each row; columns are as wide as their widest cell, spanned places are empty."""
    grid: list[list[list[str]]] = []
    spans: dict[int, int] = {}  # by column: rows that a cell above still reaches into
    for row in rows:
        cells: list[list[str]] = []
        for cell in row:
            while spans.get(len(cells)):
                spans[len(cells)] -= 1
                cells.append([""])
            lines = render(cell, tables).split("\n")
            for _ in range(max(1, min(number_of(cell, "colspan", 1), 100))):
                spans[len(cells)] = max(0, number_of(cell, "rowspan", 1) - 1)
                cells.append(lines)
                lines = [""]
        for column in [c for c, left in spans.items() if left and c >= len(cells)]:
            spans[column] -= 1
        if any(any(c) for c in cells):
            grid.append(cells)
    widths = [0] * max((len(r) for r in grid), default=0)
    for row in grid:
        for i, cell in enumerate(row):
            widths[i] = max(widths[i], max(map(len, cell)))
    lines = []
    for row in grid:
        for k in range(max(map(len, row))):
            lines.append(" | ".join((cell[k] if k < len(cell) else "").ljust(w) for cell, w in zip(row, widths)).rstrip())
    return lines


def laid_out(root: Node) -> dict[int, tuple]:
    """By table: (what stands before it, its captions' and rows' lines), the innermost first, so nesting needs no recursion."""
    tables, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "table":
            tables.append(node)
        todo += [c for c in node.children if not isinstance(c, str) and not hidden(c)]
    done: dict[int, tuple] = {}
    for table in reversed(tables):
        before, captions, rows = parts_of(table)
        done[id(table)] = (before, [line for c in captions for line in render(c, done).split("\n")] + table_lines(rows, done))
    return done


def render(root: Node, tables: dict[int, tuple]) -> str:
    """The visible text under a node; an explicit stack, so depth is no limit. ``tables`` has the tables inside."""
    page = Page()
    # (node or text or end marker, indentation, inside <pre>, list state)
    todo: list[tuple] = [(c, "", False, None) for c in reversed(root.children)]
    mark = ""
    while todo:
        item, indent, pre, listing = todo.pop()
        if item is None:
            page.block(listing)
            if mark:
                mark = ""
            continue
        if isinstance(item, str):
            if pre:
                for i, line in enumerate(item.split("\n")):
                    if i:
                        page.end()
                    if line:
                        page.write(line, indent, mark)
                        mark = ""
                continue
            text = BLANKS.sub(" ", item)
            if text[:1] == " ":
                page.gap = page.gap or bool(page.line)
                text = text[1:]
            if not text:
                continue
            ends = text[-1] == " "
            page.write((" " if page.gap and page.line else "") + (text[:-1] if ends else text), indent, mark)
            mark, page.gap = "", ends
            continue
        if hidden(item):
            continue
        tag = item.tag
        if tag == "br":
            if page.line:
                page.flush()
            elif page.lines and page.lines[-1]:
                page.margin = True
            continue
        if tag == "table":
            before, lines = tables[id(item)]
            if before:  # what a table can't hold comes first, then the table itself
                tables[id(item)] = ([], lines)
                todo += [(c, indent, pre, listing) for c in reversed([*before, item])]
                continue
            page.block(True)
            for line in lines:
                page.write(line, indent)
                page.flush()
            page.block(True)
            continue
        if tag == "input":
            if item.attrs.get("type", "").lower() in ("submit", "button", "reset") and item.attrs.get("value"):
                todo.append((f" {item.attrs['value']} ", indent, pre, listing))
            continue
        if tag in BLOCK:
            page.block(tag in SPACED and not (tag in ("ul", "ol") and indent))
            todo.append((None, indent, pre, tag in SPACED and not (tag in ("ul", "ol") and indent)))
        inner, state = indent, listing
        if tag in ("ul", "ol", "menu", "dir"):
            state = [tag, number_of(item, "start", 1)]
        elif tag == "li":
            mark = "- "
            if isinstance(listing, list) and listing[0] == "ol":
                mark = f"{listing[1]}. "
                listing[1] += 1
            inner = indent + "  "
        elif tag in ("dd", "blockquote"):
            inner = indent + "  "
        todo += [(c, inner, pre or tag in ("pre", "xmp"), state) for c in reversed(item.children)]
    page.flush()
    return "\n".join(page.lines).strip("\n")


def to_text(source: str | None) -> str | None:
    """Visible text of one page; null for null, empty where nothing is visible."""
    if source is None:
        return None
    root = tree(source)
    return "" if hidden(root) else render(root, laid_out(root))


def extract(pages: DataFrame, key: str = "page_id", source: str = "html", text: str = "text") -> DataFrame:
    """Each page's key and visible text, one row a row: null html gives null, an empty page an empty text.

    Keys may be null or repeat; other columns, whatever their names, are left
    out. A table without rows gives none. Whole pages are rendered, each in
    memory in proportion to itself.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "s"):
            found = [to_text(x) for x in batch.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found, pa.string())], names=["k", "t"])

    from pyspark.sql import functions as F

    rows = pages.select(F.col(key).alias("k"), F.col(source).alias("s")).mapInArrow(run, f"k {kind}, t string")
    return rows.select(F.col("k").alias(key), F.col("t").alias(text))
