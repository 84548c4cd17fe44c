"""Files of many formats as documents with blocks: the binary file source, then one parser for each extension.

``register`` adds a format; formats whose libraries are missing here (PDF, Office, audio, images) are registered by
whoever has them. A file that fails keeps its row, with the error, and no blocks.
"""

from __future__ import annotations

import csv
import email
import email.policy
import html as entities
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, markdown, structured

#: Largest file read; archives list so many members and read so many bytes of so many text members.
MAX_BYTES = 500 << 20
LISTED, READ_MEMBERS, MEMBER_BYTES = 500, 100, 32 << 10
CODE_CHARS, OUTPUT_CHARS = 40_000, 2_000

Block = dict
_parsers: dict[str, Callable[[bytes], list[Block]]] = {}

TEXT_LIKE = (
    "c cc cfg conf cpp cs css cxx env go h hpp ini java js jsx kt kts log lua mjs php pl proto ps1 py pyw r rb rs sass scala scss sh sql "
    "swift tex text toml ts tsx txt vue yaml yml zsh"
).split()


def register(*extensions: str):
    def take(f: Callable[[bytes], list[Block]]) -> Callable[[bytes], list[Block]]:
        for e in extensions:
            _parsers[e.lower()] = f
        return f

    return take


def extensions() -> list[str]:
    return sorted(_parsers)


def _block(kind: str, content: str, level: int | None = None, note: str | None = None) -> Block:
    return {"type": kind, "content": content, "level": level, "note": note}


def _decode(data: bytes) -> str:
    return data.decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n")


@register(*TEXT_LIKE)
def _text(data: bytes) -> list[Block]:
    """Paragraphs between empty lines, whole; ``operators.blocks.text_blocks`` is the form with a limit for large files."""
    return [_block("paragraph", p.strip()) for p in re.split(r"\n{2,}", _decode(data).strip()) if p.strip()]


@register("htm", "html", "xhtml")
def _html(data: bytes) -> list[Block]:
    return html.blocks(_decode(data))


@register("markdown", "md")
def _markdown(data: bytes) -> list[Block]:
    return markdown.blocks(_decode(data))


@register("json")
def _json(data: bytes) -> list[Block]:
    text = _decode(data)
    summary = structured.summarise(text)
    code = _block("code_block", text[:CODE_CHARS], note="json")
    return [code] if summary is None else [_block("paragraph", summary), code]


@register("jsonl", "ndjson")
def _jsonl(data: bytes) -> list[Block]:
    lines = [x for x in _decode(data).split("\n") if x.strip()]
    rows = []
    for x in lines:
        try:
            rows.append(json.loads(x))
        except ValueError:
            continue
    if not rows:
        return [_block("paragraph", "\n".join(lines))] if lines else []
    keys = list(dict.fromkeys(k for r in rows if isinstance(r, dict) for k in r))[:30]
    return [
        _block("metadata", f"Records: {len(rows)} | Lines not parsed: {len(lines) - len(rows)} | Keys: {', '.join(keys)}"),
        _block("code_block", "\n".join(json.dumps(r, ensure_ascii=False) for r in rows[:10]), note="json"),
    ]


@register("xml")
def _xml(data: bytes) -> list[Block]:
    return structured.xml_blocks(_decode(data))


@register("atom", "rss")
def _feed(data: bytes) -> list[Block]:
    return structured.feed_blocks(_decode(data))


def _table(rows: list[list[str]]) -> list[Block]:
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return []
    wide = max(map(len, rows))
    cut = lambda c: c if len(c) <= structured.CSV_CHARS else c[: structured.CSV_CHARS] + "…"
    shown = [[cut(c) for c in (r + [""] * wide)[: structured.CSV_COLUMNS]][:wide] for r in rows[: structured.CSV_ROWS]]
    out = [_block("metadata", f"Rows: {len(rows) - 1} | Columns: {wide}"), _block("table", html._draw(shown))]
    if len(rows) > structured.CSV_ROWS:
        out.append(_block("metadata", f"{len(rows) - structured.CSV_ROWS} rows omitted"))
    return out


@register("csv")
def _csv(data: bytes) -> list[Block]:
    return _table(list(csv.reader(io.StringIO(_decode(data)))))


@register("tsv")
def _tsv(data: bytes) -> list[Block]:
    return _table(list(csv.reader(io.StringIO(_decode(data)), delimiter="\t")))


def mail_paragraphs(body: str) -> list[str]:
    body = re.split(r"(?im)^(?:-{5,}Original Message-{5,}|_{20,})", body.replace("\r\n", "\n").replace("\r", "\n"), maxsplit=1)[0]
    out = []
    for part in body.split("\n\n"):
        own = [x for x in map(str.strip, part.split("\n")) if x and not x.startswith(">") and not re.match(r"On .{10,}wrote:\s*$", x)]
        out.append(" ".join(own))
    return [p for p in out if len(p) >= 4]


@register("eml")
def _mail(data: bytes) -> list[Block]:
    m = email.message_from_bytes(data, policy=email.policy.default)
    plain, rich, files = [], [], []
    for part in m.walk():
        if part.get_filename():
            files.append(part.get_filename())
        elif part.get_content_type() in ("text/html", "text/plain"):
            text = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")
            (plain if part.get_content_type() == "text/plain" else rich).append(text)
    body = "\n\n".join(plain) or "\n\n".join(html.tree(t).text("\n") for t in rich)
    head = " | ".join(f"{k}: {m[k]}" for k in ("From", "To", "Cc", "Date") if m[k])
    out = [_block("heading", m["Subject"] or "(no subject)", 1), _block("metadata", head)]
    out += [_block("paragraph", p) for p in mail_paragraphs(body)]
    if files:
        out.append(_block("list", "\n".join(f"- {f}" for f in files)))
    return [b for b in out if b["content"]]


@register("ipynb")
def _notebook(data: bytes) -> list[Block]:
    out: list[Block] = []
    book = json.loads(data)
    lang = book.get("metadata", {}).get("kernelspec", {}).get("language", "python")
    for cell in book.get("cells", []):
        source = "".join(cell.get("source", []))
        if not source.strip():
            continue
        if cell.get("cell_type") == "markdown":
            out += markdown.blocks(source)
        elif cell.get("cell_type") == "code":
            out.append(_block("code_block", source, note=lang))
            for o in cell.get("outputs", []):
                text = "".join(o.get("text", []) or o.get("data", {}).get("text/plain", []))
                if text.strip():
                    out.append(_block("blockquote", text.strip()[:OUTPUT_CHARS]))
    return out


def safe_name(name: str) -> str:
    name = re.sub(r"[\x00-\x1f\x7f]", "", name.replace("\\", "/"))
    parts = [p for p in re.sub(r"^[A-Za-z]:", "", name).split("/") if p not in ("", ".", "..")]
    return "/".join(parts) or "unnamed"


def _archive(members: list[tuple[str, int, Callable[[], bytes]]]) -> list[Block]:
    rows = [["Name", "Bytes"], *[[safe_name(n), str(size)] for n, size, _ in members[:LISTED]]]
    out = [_block("metadata", f"Members: {len(members)}"), _block("table", html._draw(rows))]
    texts = [(n, get) for n, size, get in members if n.rsplit(".", 1)[-1].lower() in (*TEXT_LIKE, "csv", "html", "json", "md", "xml")]
    for n, get in texts[:READ_MEMBERS]:
        out += [_block("heading", safe_name(n), 2), _block("code_block", get()[:MEMBER_BYTES].decode("utf-8", "replace"))]
    return out


@register("zip")
def _zip(data: bytes) -> list[Block]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        def get(i: zipfile.ZipInfo) -> Callable[[], bytes]:
            return lambda: z.open(i).read(MEMBER_BYTES)

        return _archive([(i.filename, i.file_size, get(i)) for i in z.infolist() if not i.is_dir()])


@register("bz2", "gz", "tar", "tgz", "xz")
def _tar(data: bytes) -> list[Block]:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        def get(i: tarfile.TarInfo) -> Callable[[], bytes]:
            return lambda: t.extractfile(i).read(MEMBER_BYTES)

        return _archive([(i.name, i.size, get(i)) for i in t.getmembers() if i.isfile()])


@register("rtf")
def _rtf(data: bytes) -> list[Block]:
    t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), data.decode("latin-1"))
    t = re.sub(r"\{\\(?:\*|fonttbl|colortbl|stylesheet|info|pict)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", t)
    t = re.sub(r"\\par[d]?\b ?", "\n\n", t)
    t = re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", t).replace("\\\\", "\\")
    return _text(t.encode())


@register("epub")
def _epub(data: bytes) -> list[Block]:
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in sorted(n for n in z.namelist() if n.rsplit(".", 1)[-1] in ("htm", "html", "xhtml")):
            out += html.blocks(z.read(n).decode("utf-8", "replace"))
    return out


@register("odp", "ods", "odt")
def _odf(data: bytes) -> list[Block]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        text = z.read("content.xml").decode("utf-8", "replace")
    out: list[Block] = []
    for m in re.finditer(r"<text:(h|p)\b([^>]*?)(?:/>|>(.*?)</text:\1>)", text, re.S):
        t = entities.unescape(re.sub(r"<[^>]+>", "", m[3] or "")).strip()
        if t and m[1] == "h":
            level = re.search(r'outline-level="(\d+)"', m[2])
            out.append(_block("heading", t, min(6, int(level[1])) if level else 1))
        elif t:
            out.append(_block("paragraph", t))
    return out


def guess(name: str, data: bytes) -> str:
    """The lower-cased suffix if it is known, else a guess by the first bytes, else txt."""
    suffix = name.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
    if suffix:
        return suffix
    for magic, kind in ((b"PK\x03\x04", "zip"), (b"%PDF", "pdf"), (b"{\\rtf", "rtf"), (b"\x1f\x8b", "gz"), (b"<?xml", "xml")):
        if data.startswith(magic):
            return kind
    head = data[:512].lstrip().lower()
    return "html" if head.startswith((b"<!doctype html", b"<html")) else "txt"


_BLOCK = "array<struct<type:string,content:string,level:int,page:int>>"
_SCHEMA = f"path string, capture_id string, file_type string, category string, error string, blocks {_BLOCK}"
_struct = pa.list_(pa.struct([("type", pa.string()), ("content", pa.string()), ("level", pa.int32()), ("page", pa.int32())]))


def parsed(files: DataFrame) -> DataFrame:
    """(path, capture_id, file_type, category, error, blocks) of files (path, content binary); no shuffle.

    category is unsupported, failed, or parsed. Blocks come in order; levels only for headings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, capture, data in zip(*(batch.column(c).to_pylist() for c in ("path", "capture_id", "content"))):
                data = data or b""
                kind, error, got = guess(path or "", data), None, []
                parser = _parsers.get(kind)
                if parser is None:
                    category = "unsupported"
                elif len(data) > MAX_BYTES:
                    category, error = "failed", f"{len(data)} bytes are more than {MAX_BYTES}"
                else:
                    category = "parsed"
                    try:
                        got = [{"type": b["type"], "content": b["content"], "level": b["level"], "page": None} for b in parser(data)]
                    except Exception as e:  # noqa: BLE001  one bad file must not end the job; its row says what happened
                        category, error = "failed", f"{type(e).__name__}: {e}"
                rows.append((path, capture, kind, category, error, got))
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.string()] * 5 + [_struct]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["path", "capture_id", "file_type", "category", "error", "blocks"])

    return files.select("path", F.sha2("content", 256).alias("capture_id"), "content").mapInArrow(run, _SCHEMA)


def documents(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Every file below a folder, parsed."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return parsed((r.option("pathGlobFilter", glob) if glob else r).load(folder).select("path", "content"))


from . import office as _office, rest as _rest  # noqa: E402,F401  these register their readers
