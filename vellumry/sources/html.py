"""HTML as blocks: a small tree on the standard parser, walked once.

Unclosed elements stay open until an ancestor closes. Navigation, scripts and boilerplate classes are not read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

SKIP = frozenset("aside form header iframe menu menuitem nav noscript script style".split())
SKIP_CLASS = re.compile(r"\b(?:hatnote|mw-editsection|navbox(?:-inner|-subgroup)?|navigation-not-searchable|noprint|sidebar)\b")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADS = {f"h{i}": i for i in range(1, 7)}
STRUCTURE = frozenset(HEADS) | frozenset("blockquote dl hr img ol p pre table ul".split())
CONTAINERS = frozenset("article body details div figure label main section span summary".split())
INLINE = frozenset("a abbr b cite em i kbd mark s small strong sub sup time u var".split())
NOTES = frozenset("caution danger error important note tip warning".split())
NOTE = re.compile(r"^\[!(NOTE|WARNING|TIP|IMPORTANT|CAUTION|DANGER)\]", re.I)
DEPTH, SPAN, LEAF_CHARS, VALUE_CHARS = 100, 50, 15, 200


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def strings(self):
        """The texts below, in order. Without recursion, so that no depth of nesting is too deep."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, str):
                    yield c
                else:
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def text(self, sep: str = " ") -> str:
        return sep.join(s for s in (x.strip() for x in self.strings()) if s)

    def raw(self) -> str:
        return "".join(self.strings())

    def nodes(self, *tags: str) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node) and (not tags or c.tag in tags)]

    def all(self, *tags: str):
        stack = self.nodes()[::-1]
        while stack:
            n = stack.pop()
            if n.tag in tags:
                yield n
            stack += n.nodes()[::-1]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _without_boilerplate(n: Node) -> None:
    stack = [n]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or not (c.tag in SKIP or SKIP_CLASS.search(c.attrs.get("class", "")))]
        stack += n.nodes()


def _span(value: str | None) -> int:
    try:
        return min(SPAN, max(1, int(value or 1)))
    except ValueError:
        return 1


def table_grid(table: Node) -> dict | None:
    """{grid, header_rows}: spans fill the grid with missing cells; head rows are those of thead, else leading all-th rows."""
    rows, head = [], 0
    for part in ("thead", "tbody", "tfoot"):
        section = next(table.all(part), None)
        if section:
            found = list(section.all("tr"))
            head += len(found) if part == "thead" else 0
            rows += found
    rows = rows or list(table.all("tr"))
    cells, taken, th = {}, set(), []
    for r, tr in enumerate(rows):
        c, kinds = 0, []
        for cell in tr.nodes("td", "th"):
            while (r, c) in taken:
                c += 1
            wide, high = _span(cell.attrs.get("colspan")), _span(cell.attrs.get("rowspan"))
            taken.update((i, j) for i in range(r, r + high) for j in range(c, c + wide) if (i, j) != (r, c))
            cells[r, c] = (cell.text(), wide)
            kinds.append(cell.tag)
            c += wide
        th.append(bool(kinds) and set(kinds) == {"th"})
    if not cells:
        return None
    width = max(c + w for (_, c), (_, w) in cells.items())
    if not head:
        while head < len(th) and th[head]:
            head += 1
    return {"grid": [[cells[r, c][0] if (r, c) in cells else None for c in range(width)] for r in range(len(rows))], "header_rows": head}


def list_lines(e: Node, depth: int = 0) -> list[str]:
    """Two blanks a level; numbers by place among the items, counted with those that are empty."""
    out = []
    for i, li in enumerate(e.nodes("li")):
        own = " ".join(t for t in ((c.strip() if isinstance(c, str) else c.text()) for c in li.children if isinstance(c, str) or c.tag not in ("ol", "ul")) if t)
        if own:
            out.append("  " * depth + (f"{i + 1}. " if e.tag == "ol" else "- ") + own)
        if depth < DEPTH:
            for nested in li.nodes("ol", "ul"):
                out += list_lines(nested, depth + 1)
    return out


def _pairs(dl: Node) -> list[tuple[str, str]]:
    key, out = None, []
    for c in dl.nodes("dd", "dt"):
        if c.tag == "dt":
            key = c.text()
        elif key is not None:
            value = c.text()
            if value and len(value) <= VALUE_CHARS:
                out.append((key, value))
            key = None
    return out


def _cell(t: str | None) -> str:
    return " " if t is None else re.sub(r"\r\n|\r|\n", " ", t).replace("|", "\\|")


def _draw(grid: list[list[str | None]]) -> str:
    lines = ["| " + " | ".join(map(_cell, row)) + " |" for row in grid]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * len(grid[0])) + " |", *lines[1:]])


def blocks(html: str) -> list[dict]:
    """Blocks (type, content, level, note, grid, header_rows) of a page's body."""
    root = tree(html)
    _without_boilerplate(root)
    out: list[dict] = []

    def add(kind: str, content: str, **more) -> None:
        out.append({"type": kind, "content": content, "level": None, "note": None, "grid": None, "header_rows": None} | more)

    def walk(e: Node, depth: int) -> None:
        if depth > DEPTH:
            return
        for c in e.nodes():
            tag, t = c.tag, None
            if tag in SKIP:
                continue
            if tag in HEADS:
                if t := c.text(""):
                    add("heading", t, level=HEADS[tag])
            elif tag == "p":
                if t := c.text():
                    add("paragraph", t)
            elif tag in ("code", "pre"):
                code = next(c.all("code"), c) if tag == "pre" else c
                lang = next((x[9:] for x in code.attrs.get("class", "").split() if x.startswith("language-")), None) if tag == "pre" else None
                if code.raw().strip():
                    add("code_block", code.raw(), note=lang)
            elif tag == "table":
                if got := table_grid(c):
                    add("table", _draw(got["grid"]), **got)
            elif tag in ("ol", "ul"):
                if lines := list_lines(c):
                    add("list", "\n".join(lines))
            elif tag == "blockquote":
                if t := c.text():
                    kind = next((x.lower() for x in c.attrs.get("class", "").split() if x.lower() in NOTES), None)
                    if kind is None:
                        p = next(c.all("p"), None)
                        m = NOTE.match(p.text("")) if p else None
                        kind = m[1].lower() if m else None
                    add("admonition" if kind else "blockquote", t, note=kind)
            elif tag == "img":
                if c.attrs.get("src") or c.attrs.get("alt"):
                    add("image", c.attrs.get("alt") or c.attrs["src"], note=c.attrs.get("src"))
            elif tag == "hr":
                add("page_break", "")
            elif tag == "dl":
                if pairs := _pairs(c):
                    add("key_value_group", "\n".join(f"- **{k}:** {v}" for k, v in pairs))
                else:
                    walk(c, depth + 1)
            elif tag not in INLINE:
                if any(x.tag in STRUCTURE or x.tag in CONTAINERS for x in c.nodes()):
                    walk(c, depth + 1)
                elif len(t := c.text()) > LEAF_CHARS:
                    add("paragraph", t)

    walk(next(root.all("body"), root), 0)
    return out


def title(html: str) -> str | None:
    found = next(tree(html).all("title"), None)
    return found.text("") if found else None
