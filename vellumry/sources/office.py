"""Word, Excel and PowerPoint files (the XML kinds) read with nothing but zip and XML; equations, pictures and formats are not read."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections import Counter
from xml.etree import ElementTree as ET

from . import files, html

SHEET_ROWS, SHEET_COLUMNS, CELL_CHARS = 500, 20, 80
PROPERTIES = ("Title", "Author", "Subject", "Description", "Category", "Keywords", "Created", "Modified")
_CORE = {"title": "Title", "creator": "Author", "subject": "Subject", "description": "Description", "category": "Category", "keywords": "Keywords", "created": "Created", "modified": "Modified"}
_GENERIC = frozenset("name value id score key field column type date amount total count label description".split())


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e: ET.Element | None, name: str) -> str | None:
    return None if e is None else next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _first(e: ET.Element, *path: str) -> ET.Element | None:
    for step in path:
        e = next((c for c in e if _tag(c) == step), None)
        if e is None:
            return None
    return e


def _every(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if _tag(x) == name]


class _Package:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def targets(self, part: str) -> dict[str, tuple[str, str]]:
        """Relation id -> (kind, part) of a part."""
        folder, name = posixpath.split(part)
        rels = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in rels if rels is not None else ():
            where = r.get("Target", "")
            out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], where.lstrip("/") if where.startswith("/") else posixpath.normpath(f"{folder}/{where}"))
        return out


def _pairs(title: str | None, pairs: list[tuple[str, str]]) -> dict:
    return files._block("key_value_group", "\n".join(f"- **{k}:** {v}" for k, v in pairs), note=title)


def _run_text(p: ET.Element) -> str:
    return "".join(x.text or "" if _tag(x) == "t" else "\t" if _tag(x) == "tab" else "" for x in p.iter() if _tag(x) in ("t", "tab")).strip()


@files.register("docx")
def _docx(data: bytes) -> list[dict]:
    """Properties, headings by style, lists by numbering or style, tables with spans, paragraphs."""
    z = _Package(data)
    out: list[dict] = []
    core = z.xml("docProps/core.xml")
    if core is not None:
        known = {_CORE[_tag(e)]: (e.text or "").strip()[:80] for e in core if _tag(e) in _CORE and (e.text or "").strip()}
        if len(known) >= 2:
            out.append(_pairs("Document Properties", [(k, known[k]) for k in PROPERTIES if k in known]))
    styles, numbering = z.xml("word/styles.xml"), z.xml("word/numbering.xml")
    names = {_attr(s, "styleId"): (_attr(_first(s, "name"), "val") or "").lower() for s in (styles if styles is not None else ()) if _tag(s) == "style"}
    ordered: set[str | None] = set()
    if numbering is not None:
        kinds = {_attr(a, "abstractNumId"): [_attr(_first(lvl, "numFmt"), "val") for lvl in a if _tag(lvl) == "lvl"] for a in numbering if _tag(a) == "abstractNum"}
        ordered = {_attr(n, "numId") for n in numbering if _tag(n) == "num" and (kinds.get(_attr(_first(n, "abstractNumId"), "val")) or ["bullet"])[0] not in ("bullet", "none", None)}
    items: list[tuple[int, bool, str]] = []
    group = None

    def flush() -> None:
        count: dict[int, int] = {}
        lines, before = [], -1
        for level, numbered, text in items:
            for k in [k for k in count if k > level] if level < before else ():
                del count[k]
            if numbered:
                count[level] = count.get(level, 0) + 1
            lines.append("  " * level + (f"{count[level]}. " if numbered else "- ") + text)
            before = level
        if lines:
            out.append(files._block("list", "\n".join(lines)))
        items.clear()

    body = _first(z.xml("word/document.xml"), "body")
    for e in body if body is not None else ():
        if _tag(e) == "tbl":
            flush()
            grid: list[list[str | None]] = []
            for tr in (x for x in e if _tag(x) == "tr"):
                row: list[str | None] = []
                for tc in (x for x in tr if _tag(x) == "tc"):
                    pr = _first(tc, "tcPr")
                    merge = None if pr is None else _first(pr, "vMerge")
                    below = merge is not None and _attr(merge, "val") != "restart"
                    text = None if below else "\n".join(t for p in tc if _tag(p) == "p" and (t := _run_text(p)))
                    row += [text] + [None] * (int((_attr(_first(pr, "gridSpan"), "val") if pr is not None else None) or 1) - 1)
                grid.append(row)
            wide = max(map(len, grid), default=0)
            if wide:
                out.append(files._block("table", html._draw([r + [None] * (wide - len(r)) for r in grid])))
            continue
        text = _run_text(e) if _tag(e) == "p" else ""
        if not text:
            continue
        pr = _first(e, "pPr")
        style = (names.get(s) or (s or "").lower()) if (s := _attr(_first(pr, "pStyle"), "val") if pr is not None else None) else ""
        num = _attr(_first(pr, "numPr", "numId"), "val") if pr is not None else None
        if num and num != "0" or "list bullet" in style or "list number" in style:
            suffix = re.search(r"(\d+)$", style)
            level = int(_attr(_first(pr, "numPr", "ilvl"), "val") or 0) if num and num != "0" else int(suffix[1]) - 1 if suffix else 0
            new = f"num:{num}" if num and num != "0" else style.split(" ")[1]
            if new != group:
                flush()
            group = new
            items.append((level, num in ordered if num and num != "0" else "number" in style, text))
            continue
        flush()
        head = re.fullmatch(r"heading ?([1-6])", style)
        kind = "heading" if head or style in ("title", "subtitle") else "code_block" if "code" in style or "mono" in style else "paragraph"
        out.append(files._block(kind, text, int(head[1]) if head else {"title": 1, "subtitle": 2}.get(style)))
    flush()
    return out


def _place(ref: str) -> tuple[int, int]:
    m = re.match(r"([A-Z]+)(\d+)", ref)
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return int(m[2]) - 1, column - 1


def _shown(text: str) -> str:
    text = text.replace("\n", " ").strip()
    return text[:CELL_CHARS] + "…" if len(text) > CELL_CHARS else text


def is_pairs(grid: list[list[str]]) -> bool:
    """Two columns of 3 to 20 rows whose left cells are different labels of at most six words, under no common header."""
    rows = [r for r in grid if any(c.strip() for c in r)]
    if not grid or len(grid[0]) != 2 or not 3 <= len(rows) <= 20 or any(c.strip().lower() in _GENERIC for c in grid[0]):
        return False
    keys = [r[0].strip() for r in grid if r[0].strip()]
    return len(keys) >= 3 and len(set(keys)) == len(keys) and all(len(k.split()) <= 6 for k in keys) and all(len(r[1]) <= CELL_CHARS for r in grid)


@files.register("xlsm", "xlsx", "xltm", "xltx")
def _xlsx(data: bytes) -> list[dict]:
    """A heading a sheet, then its cells as a table, or as pairs if ``is_pairs``; merged ranges show their first cell."""
    z = _Package(data)
    targets = z.targets("xl/workbook.xml")
    strings = z.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in _every(s, "t")) for s in strings if _tag(s) == "si"] if strings is not None else []
    out: list[dict] = []
    for sheet in _every(z.xml("xl/workbook.xml"), "sheet"):
        name = sheet.get("name", "")
        out.append(files._block("heading", name, 2))
        root = z.xml(targets[_attr(sheet, "id")][1])
        hidden: set[tuple[int, int]] = set()
        for m in _every(root, "mergeCell"):
            a, b = (m.get("ref", "A1:A1").split(":") * 2)[:2]
            (r0, c0), (r1, c1) = _place(a), _place(b)
            hidden |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - {(r0, c0)}
        cells: dict[tuple[int, int], str] = {}
        last = 0
        for c in _every(root, "c"):
            r, col = _place(c.get("r", "A1"))
            last = max(last, r + 1)
            if r > SHEET_ROWS or col >= SHEET_COLUMNS or (r, col) in hidden:
                continue
            value, formula, kind = _first(c, "v"), _first(c, "f"), c.get("t", "n")
            text = "".join(t.text or "" for t in _every(c, "t")) if kind == "inlineStr" else (value.text or "") if value is not None else f"={formula.text}" if formula is not None else ""
            text = shared[int(text)] if kind == "s" else {"0": "False", "1": "True"}.get(text, text) if kind == "b" else text
            cells[r, col] = _shown(text)
        if not cells:
            continue
        rows, wide = max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
        grid = [[cells.get((r, c), "") for c in range(wide)] for r in range(rows)]
        if is_pairs(grid):
            out.append(_pairs(name, [(r[0].strip(), r[1].strip()) for r in grid if r[0].strip()]))
            continue
        out.append(files._block("table", html._draw(grid)))
        if last > rows:
            out.append(files._block("paragraph", f"*({last - rows} additional rows omitted)*"))
    return out


@files.register("pptx")
def _pptx(data: bytes) -> list[dict]:
    """A heading a slide, lists, tables, paragraphs and notes; bullets on three lines or more are kept once."""
    z = _Package(data)
    targets = z.targets("ppt/presentation.xml")
    out: list[dict] = []
    for slide in _every(z.xml("ppt/presentation.xml"), "sldId"):
        part = next(v for k, v in slide.attrib.items() if k.endswith("}id"))
        part = targets[part][1]
        title, rest = [], []
        for e in _first(z.xml(part), "cSld", "spTree"):
            kind = _attr(next(iter(_every(e, "ph")), None), "type")
            (title if kind in ("title", "ctrTitle") else rest).append((e, kind, bool(_every(e, "ph"))))
        if title and (text := " ".join(t for p in _every(title[0][0], "p") if (t := _run_text(p)))):
            out.append(files._block("heading", text, 2))
        for e, kind, placed in rest:
            if _tag(e) == "graphicFrame" and _every(e, "tbl"):
                grid = [[" ".join(t for p in _every(tc, "p") if (t := _run_text(p))) for tc in tr if _tag(tc) == "tc"] for tr in _every(e, "tr")]
                out.append(files._block("table", html._draw(grid)))
            elif _tag(e) == "sp":
                out += _shape([p for p in _every(e, "p") if _run_text(p)], placed and kind in (None, "body", "obj", "subTitle"))
        for kind, note in z.targets(part).values():
            root = z.xml(note) if kind == "notesSlide" else None
            if root is not None:
                bodies = [s for s in _every(root, "sp") if _attr(next(iter(_every(s, "ph")), None), "type") == "body"]
                text = "\n".join(t for s in bodies for p in _every(s, "p") if (t := _run_text(p)))
                if text:
                    out.append(files._block("blockquote", f"[Speaker notes] {text}"))
    return _bullets_once(out)


def _shape(paras: list[ET.Element], body: bool) -> list[dict]:
    if not paras:
        return []
    texts = [_run_text(p) for p in paras]
    props = [_first(p, "pPr") for p in paras]
    levels = [int(p.get("lvl", 0)) if p is not None else 0 for p in props]
    marked = any(p is not None and _first(p, "buNone") is None and (_first(p, "buChar") is not None or _first(p, "buAutoNum") is not None) for p in props)
    short = len(texts) >= 2 and all(len(t.split()) <= 30 and t.count(". ") < 3 for t in texts)
    if marked or any(levels) or body or short:
        return [files._block("list", "\n".join("  " * n + f"- {t}" for n, t in zip(levels, texts)))]
    sizes = [max((int(r.get("sz", 0)) for r in _every(p, "rPr")), default=0) for p in paras]
    return [files._block("heading", t, 3) if n >= 2000 and len(t.split()) <= 12 else files._block("paragraph", t) for t, n in zip(texts, sizes)]


def _bullets_once(blocks: list[dict]) -> list[dict]:
    often = {k for k, n in Counter(x.strip() for b in blocks if b["type"] == "list" for x in b["content"].split("\n")).items() if n >= 3 and k.startswith("- ")}
    out, seen = [], set()
    for b in blocks:
        if b["type"] == "list" and often:
            kept = []
            for line in b["content"].split("\n"):
                if line.strip() not in often or line.strip() not in seen:
                    kept.append(line)
                seen.add(line.strip())
            if not kept:
                continue
            b = {**b, "content": "\n".join(kept)}
        out.append(b)
    return out
