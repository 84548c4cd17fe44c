"""JSON, JSON lines, CSV, XML and feeds as blocks."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

JSON_KEYS, JSON_ITEMS, JSON_CHARS, JSON_DEPTH, JSON_LINES = 20, 3, 120, 3, 200
CSV_ROWS, CSV_COLUMNS, CSV_CHARS = 501, 20, 80


def _lines(value: object, depth: int = 0) -> list[str]:
    pad = "  " * depth
    if depth > JSON_DEPTH:
        return ["..."]
    if isinstance(value, dict):
        out = []
        for k in list(value)[:JSON_KEYS]:
            v = value[k]
            if isinstance(v, (dict, list)):
                out.append(f"{pad}**{k}** ({type(v).__name__}, {len(v)} items)")
                out += _lines(v, depth + 1)
            else:
                out.append(f"{pad}**{k}**: {str(v)[:JSON_CHARS]}")
        return out
    if isinstance(value, list):
        shown = [line for v in value[:JSON_ITEMS] for line in _lines(v, depth + 1)]
        rest = len(value) - JSON_ITEMS
        return [f"{pad}[{len(value)} items]", *shown, *([f"{pad}... {rest} more"] if rest > 0 else [])]
    return [pad + str(value)[:JSON_CHARS]]


def summarise(text: str | None) -> str | None:
    """Readable lines of a JSON text; None if it is none."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return "\n".join(_lines(value)[:JSON_LINES])


def json_summary(c: Column) -> Column:
    """Summary lines of JSON texts: nesting to depth 3, 20 keys an object, 3 items an array; null where it doesn't parse."""
    return F.arrow_udf(lambda texts: pa.array([summarise(t) for t in texts.to_pylist()], pa.string()), "string")(c)


def csv_grid(grid: Column) -> Column:
    """A CSV file's rows as shown: blank rows go, 501 rows and 20 columns at most, cells of at most 80 characters."""
    full = F.filter(grid, lambda r: F.exists(r, lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    cut = lambda c: F.when(F.length(c) > CSV_CHARS, F.concat(F.substring(c, 1, CSV_CHARS), F.lit("…"))).otherwise(F.coalesce(c, F.lit("")))
    return F.transform(F.slice(full, 1, CSV_ROWS), lambda r: F.transform(F.slice(r, 1, CSV_COLUMNS), cut))


_HEADS = ("h1", "h2", "h3", "head", "header", "heading", "name", "section", "title")
XML_BLOCKS, XML_DEPTH = 250, 50


def _name(tag: object) -> str:
    return str(tag).rsplit("}", 1)[-1]


def xml_blocks(text: str) -> list[dict]:
    """Headings for title-like leaves, `tag: text` for other leaves, attributes as a line; the text itself if it isn't XML."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return [{"type": "code_block", "content": text[:40_000], "level": None}]
    out: list[dict] = []

    def walk(e: ET.Element, depth: int) -> None:
        if depth > XML_DEPTH or len(out) >= XML_BLOCKS:
            return
        own = (e.text or "").strip()
        tag = _name(e.tag)
        if e.attrib:
            out.append({"type": "paragraph", "content": f"{tag}: " + ", ".join(f"{_name(k)}={v}" for k, v in e.attrib.items()), "level": None})
        if len(e) == 0:
            if own and tag.lower() in _HEADS:
                out.append({"type": "heading", "content": own, "level": min(6, depth + 1)})
            elif own:
                out.append({"type": "paragraph", "content": f"{tag}: {own}", "level": None})
            return
        for child in e:
            walk(child, depth + 1)

    walk(root, 0)
    return out[:XML_BLOCKS]


def feed_blocks(text: str, items: int = 50) -> list[dict]:
    """Title, description and link of an RSS or Atom feed and of its first ``items`` entries."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return []

    def first(e: ET.Element, *names: str) -> str:
        for child in e:
            if _name(child.tag) in names:
                return (child.text or child.get("href") or "").strip()
        return ""

    channel = next((e for e in root.iter() if _name(e.tag) == "channel"), root)
    out = [{"type": "heading", "content": first(channel, "title"), "level": 1}, {"type": "paragraph", "content": first(channel, "description", "subtitle"), "level": None}]
    for e in [e for e in root.iter() if _name(e.tag) in ("entry", "item")][:items]:
        out += [
            {"type": "heading", "content": first(e, "title"), "level": 2}, {"type": "paragraph", "content": first(e, "description", "summary", "content"), "level": None},
            {"type": "paragraph", "content": first(e, "link"), "level": None},
        ]
    return [b for b in out if b["content"]]
