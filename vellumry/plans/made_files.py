"""Queries on files that are made of the region and nation tables, one a region in each format, and read back.

The tables have no such files. What each reader should give is known from the rows, so that SQL can say it.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files
from .tables import read


def _regions(spark, sf_dir) -> DataFrame:
    """(key, name, nations): each region with its nations (key, name) in order."""
    n = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("nations"))
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).join(n, "key")


def _each(form: str, between: str = "") -> Column:
    """Each nation by a form with two places, its key and its name."""
    return F.array_join(F.transform("nations", lambda x: F.format_string(form, x["key"], x["name"])), between)


def _text(form: str, *parts: Column) -> Column:
    return F.format_string(form, *parts)


def _read(made: DataFrame, suffix: str) -> DataFrame:
    """(doc_id, idx, type, level or 0, content) of files (key, content) read by the reader of a suffix."""
    named = made.select(F.concat(F.col("key").cast("string"), F.lit(f".{suffix}")).alias("path"), F.col("content").cast("binary").alias("content"))
    got = files.parsed(named).select(F.split("path", r"\.")[0].cast("long").alias("doc_id"), F.posexplode_outer("blocks").alias("idx", "b"))
    return got.filter("b is not null").select("doc_id", "idx", "b.type", F.coalesce("b.level", F.lit(0)).alias("level"), "b.content")


def _query(suffix: str, content: Callable[[], Column]):
    def run(spark, sf_dir):
        return _read(_regions(spark, sf_dir).select("key", content().alias("content")), suffix)

    run.__name__ = f"read_{suffix}"
    return run


def _zipped(members: Callable[[int, str, list[dict]], dict[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    for name, text in members(r["key"], r["name"], r["nations"]).items():
                        z.writestr(name, text)
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.int64()), pa.array(out, pa.binary())], ["key", "content"])

    return run


def _zip_query(suffix: str, members: Callable[[int, str, list[dict]], dict[str, str]]):
    def run(spark, sf_dir):
        return _read(_regions(spark, sf_dir).mapInArrow(_zipped(members), "key long, content binary"), suffix)

    run.__name__ = f"read_{suffix}"
    return run


N = F.col
_HTML = (
    "<!doctype html><html><head><title>x</title><style>p {}</style></head><body><nav>menu</nav><h1>%s</h1><p>Nations of <b>%s</b>.</p><table><thead><tr><th>key</th><th>name</th></tr></thead><tbody>%s</tbody></table>"
    "<h2>List</h2><ul>%s</ul><ol>%s</ol><dl>%s</dl></body></html>"
)
_HTML_PARTS = ("<tr><td>%d</td><td>%s</td></tr>", "<li>%d: %s</li>", "<li>%d<ul><li>%s</li></ul></li>", "<dt>Nation %d</dt><dd>%s</dd>")

MADE = [
    _query("html", lambda: _text(_HTML, N("name"), N("name"), *(_each(p) for p in _HTML_PARTS))),
    _query("md", lambda: _text("# %s\n\nNations of\n%s.\n\n| key | name |\n|---|---|\n%s\n\nList\n----\n\n%s\n\n> quoted %s\n\n```sql\nselect %d\n```\n", N("name"), N("name"), _each("| %d | %s |", "\n"), _each("* %d %s", "\n"), N("name"), N("key"))),
    _query("xml", lambda: _text("<?xml version=\"1.0\"?><region key=\"%d\"><name>%s</name><nations>%s</nations></region>", N("key"), N("name"), _each("<nation><key>%d</key><title>%s</title></nation>"))),
    _query("rss", lambda: _text("<rss><channel><title>%s</title><description>Nations of %s</description>%s</channel></rss>", N("name"), N("name"), _each("<item><link>http://x.org/%d</link><title>%s</title></item>"))),
    _query("eml", lambda: _text(
        "From: a@x.org\r\nTo: b@x.org\r\nSubject: Nations of %s\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n%s\r\n\r\n> an old line\r\n\r\nOn Monday, 3 May, b@x.org wrote:\r\n\r\n-----Original Message-----\r\n\r\nlost\r\n", N("name"), _each("Nation %d is %s.", "\r\n\r\n"))),
    _query("ipynb", lambda: _text('{"metadata": {"kernelspec": {"language": "sql"}}, "cells": [{"cell_type": "markdown", "source": ["# %s"]}, %s, {"cell_type": "code", "source": []}]}', N("name"), _each('{"cell_type": "code", "source": ["select %d"], "outputs": [{"text": ["%s\\n"]}]}', ", "))),
    _query("rtf", lambda: _text("{\\rtf1\\ansi{\\fonttbl{\\f0 Times;}}\\b %s\\b0\\par %s}", N("name"), _each("Nation %d is \\i %s\\i0 .", "\\par "))),
    _query("jsonl", lambda: F.concat(_each('{"key": %d, "name": "%s"}', "\n"), F.lit("\nno json\n"))),
    _query("rst", lambda: _text(
        "===\n%s\n===\n\nNations of **%s**\nwith ``keys``::\n\n    select %d\n      from nation\n\nList\n----\n\n%s\n\n.. note:: made of :ref:`rows`\n\n.. a comment\n\n#. one\n#. two\n\nSee `the site <http://x.org>`_.\n", N("name"), N("name"), N("key"), _each("* %d *is* %s", "\n"))),
    _query("csv", lambda: F.concat(F.lit("key,name\n"), _each('%d,"%s"', "\n"))),
]


def _odf(key: int, name: str, nations: list[dict]) -> dict[str, str]:
    return {"content.xml": f'<d><text:h text:outline-level="2">{name}</text:h>' + "".join(f'<text:p text:style="x">Nation {n["key"]} is <text:span>{n["name"]}</text:span>.</text:p>' for n in nations) + "<text:p/></d>"}


def _epub(key: int, name: str, nations: list[dict]) -> dict[str, str]:
    return {"OPS/b.xhtml": "<html><body>" + "".join(f"<p>Nation {n['key']} is {n['name']}.</p>" for n in nations) + "</body></html>", "OPS/a.xhtml": f"<html><body><h1>{name}</h1></body></html>", "mimetype": "application/epub+zip"}


def _docx(key: int, name: str, nations: list[dict]) -> dict[str, str]:
    def p(text: str, props: str = "") -> str:
        return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"

    def cell(text: str, props: str = "") -> str:
        return f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"

    head = f"<w:tr>{cell('Nations', '<w:gridSpan w:val=\"2\"/>')}</w:tr>"
    rows = "".join(f"<w:tr>{cell(str(n['key']))}{cell(n['name'])}</w:tr>" for n in nations)
    items = "".join(p(n["name"], f'<w:numPr><w:ilvl w:val="{i % 2}"/><w:numId w:val="1"/></w:numPr>') for i, n in enumerate(nations))
    space = 'xmlns:w="w" xmlns:d="d" xmlns:c="c"'
    return {
        "docProps/core.xml": f"<c:p {space}><d:title>{name}</d:title><d:creator>nobody</d:creator></c:p>", "word/styles.xml": f'<w:styles {space}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {space}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
        "word/document.xml": f"<w:document {space}><w:body>{p(name, '<w:pStyle w:val=\"H1\"/>')}{p('Nations of ' + name)}<w:p/><w:tbl>{head}{rows}</w:tbl>{items}{p('End')}</w:body></w:document>",
    }


def _xlsx(key: int, name: str, nations: list[dict]) -> dict[str, str]:
    def row(r: int, cells: list[str]) -> str:
        return f'<row r="{r}">' + "".join(f'<c r="{c}{r}" {x}</c>' for c, x in zip("ABC", cells)) + "</row>"

    text = lambda t: f't="inlineStr"><is><t>{t}</t></is>'
    table = row(1, [text("key"), 't="s"><v>0</v>', text("flag")]) + "".join(row(i + 2, [f"><v>{n['key']}</v>", text(n["name"]), f't="b"><v>{i % 2}</v>']) for i, n in enumerate(nations))
    pairs = "".join(row(i + 1, [text(n["name"]), f"><v>{n['key']}</v>"]) for i, n in enumerate(nations))
    space = 'xmlns:r="http://r/relationships"'
    return {
        "xl/workbook.xml": f'<workbook {space}><sheets><sheet name="{name}" r:id="a"/><sheet name="Keys" r:id="b"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>na</t><t>me</t></si></sst>",
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Type="x/worksheet" Target="worksheets/s1.xml"/><Relationship Id="b" Type="x/worksheet" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/worksheets/s1.xml": f'<worksheet><sheetData>{table}</sheetData><mergeCells><mergeCell ref="B2:C2"/></mergeCells></worksheet>', "xl/worksheets/s2.xml": f"<worksheet><sheetData>{pairs}</sheetData></worksheet>",
    }


def _pptx(key: int, name: str, nations: list[dict]) -> dict[str, str]:
    space = 'xmlns:a="a" xmlns:p="p" xmlns:r="http://r/relationships"'
    para = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    shape = lambda kind, *texts: f'<p:sp><p:nvPr><p:ph type="{kind}"/></p:nvPr><p:txBody>{"".join(map(para, texts))}</p:txBody></p:sp>'
    out = {"ppt/presentation.xml": f'<p:presentation {space}><p:sldIdLst>' + "".join(f'<p:sldId id="{256 + i}" r:id="s{i}"/>' for i in range(len(nations))) + "</p:sldIdLst></p:presentation>"}
    out["ppt/_rels/presentation.xml.rels"] = "<R>" + "".join(f'<Relationship Id="s{i}" Type="x/slide" Target="slides/s{i}.xml"/>' for i in range(len(nations))) + "</R>"
    for i, n in enumerate(nations):
        out[f"ppt/slides/s{i}.xml"] = f"<p:sld {space}><p:cSld><p:spTree>{shape('title', n['name'])}{shape('body', 'In ' + name, 'Key ' + str(n['key']))}</p:spTree></p:cSld></p:sld>"
        out[f"ppt/slides/_rels/s{i}.xml.rels"] = f'<R><Relationship Id="n" Type="x/notesSlide" Target="../notes/n{i}.xml"/></R>'
        out[f"ppt/notes/n{i}.xml"] = f"<p:notes {space}>{shape('body', 'Note ' + str(n['key']))}</p:notes>"
    return out


MADE += [_zip_query("odt", _odf), _zip_query("epub", _epub), _zip_query("docx", _docx), _zip_query("xlsx", _xlsx), _zip_query("pptx", _pptx)]
QUERIES = {f.__name__: f for f in MADE}

_ROWS = """WITH n AS (SELECT r_regionkey AS d, r_name AS r, n_nationkey AS k, n_name AS n, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM region JOIN nation ON n_regionkey = r_regionkey),
 g AS (SELECT d, any_value(r) AS r, count(*) AS c, list({'k': k, 'n': n, 'i': i} ORDER BY i) AS ns FROM n GROUP BY d), b(doc_id, idx, type, level, content) AS ("""


def _sql(*blocks: tuple[str, str, str, str, str]) -> str:
    """Blocks as (table, place, type, level, content) in SQL."""
    parts = " UNION ALL ".join(f"SELECT d, {idx}, '{kind}', {level}, {content} FROM {table}" for table, idx, kind, level, content in blocks)
    return f"{_ROWS}{parts}) SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(idx AS INTEGER) AS idx, type, CAST(level AS INTEGER) AS level, content FROM b"


def _all(form: str, between: str) -> str:
    """All nations of a region; ``form`` says how one, x, is shown."""
    return f"array_to_string(list_transform(ns, lambda x: {form}), {between})"


_NL = "chr(10)"
_DRAWN = "'| key | name |' || chr(10) || '| --- | --- |' || chr(10) || " + _all("'| ' || x.k || ' | ' || x.n || ' |'", _NL)
_IS = "'Nation ' || k || ' is ' || n || '.'"
ORACLE_SQL = {
    "read_html": _sql(
        ("g", "0", "heading", "1", "r"), ("g", "1", "paragraph", "0", "'Nations of ' || r || ' .'"), ("g", "2", "table", "0", _DRAWN), ("g", "3", "heading", "2", "'List'"),
        ("g", "4", "list", "0", _all("'- ' || x.k || ': ' || x.n", _NL)), ("g", "5", "list", "0", _all("x.i || '. ' || x.k || chr(10) || '  - ' || x.n", _NL)), ("g", "6", "key_value_group", "0", _all("'- **Nation ' || x.k || ':** ' || x.n", _NL)),
    ),
    "read_md": _sql(
        ("g", "0", "heading", "1", "r"), ("g", "1", "paragraph", "0", "'Nations of' || chr(10) || r || '.'"), ("g", "2", "table", "0", "replace(" + _DRAWN + ", '| --- | --- |', '|---|---|')"), ("g", "3", "heading", "2", "'List'"),
        ("g", "4", "list", "0", _all("'- ' || x.k || ' ' || x.n", _NL)), ("g", "5", "blockquote", "0", "'quoted ' || r"), ("g", "6", "code_block", "0", "'select ' || d || chr(10)"),
    ),
    "read_xml": _sql(("g", "0", "paragraph", "0", "'region: key=' || d"), ("g", "1", "heading", "2", "r"), ("n", "2 * i", "paragraph", "0", "'key: ' || k"), ("n", "2 * i + 1", "heading", "4", "n")),
    "read_rss": _sql(("g", "0", "heading", "1", "r"), ("g", "1", "paragraph", "0", "'Nations of ' || r"), ("n", "2 * i", "heading", "2", "n"), ("n", "2 * i + 1", "paragraph", "0", "'http://x.org/' || k")),
    "read_eml": _sql(("g", "0", "heading", "1", "'Nations of ' || r"), ("g", "1", "metadata", "0", "'From: a@x.org | To: b@x.org'"), ("n", "i + 1", "paragraph", "0", _IS)),
    "read_ipynb": _sql(("g", "0", "heading", "1", "r"), ("n", "2 * i - 1", "code_block", "0", "'select ' || k"), ("n", "2 * i", "blockquote", "0", "n")),
    "read_rtf": _sql(("g", "0", "paragraph", "0", "r"), ("n", "i", "paragraph", "0", _IS)),
    "read_jsonl": _sql(("g", "0", "metadata", "0", "'Records: ' || c || ' | Lines not parsed: 1 | Keys: key, name'"), ("g", "1", "code_block", "0", _all("'{\"key\": ' || x.k || ', \"name\": \"' || x.n || '\"}'", _NL))),
    "read_rst": _sql(
        ("g", "0", "heading", "1", "r"), ("g", "1", "paragraph", "0", "'Nations of ' || r || chr(10) || 'with keys:'"), ("g", "2", "code_block", "0", "'select ' || d || chr(10) || '  from nation'"), ("g", "3", "heading", "2", "'List'"),
        ("g", "4", "list", "0", _all("'- ' || x.k || ' is ' || x.n", _NL)), ("g", "5", "admonition", "0", "'made of rows'"), ("g", "6", "list", "0", "'1. one' || chr(10) || '2. two'"), ("g", "7", "paragraph", "0", "'See the site.'"),
    ),
    "read_csv": _sql(("g", "0", "metadata", "0", "'Rows: ' || c || ' | Columns: 2'"), ("g", "1", "table", "0", _DRAWN)),
    "read_odt": _sql(("g", "0", "heading", "2", "r"), ("n", "i", "paragraph", "0", _IS)),
    "read_epub": _sql(("g", "0", "heading", "1", "r"), ("n", "i", "paragraph", "0", _IS)),
    "read_docx": _sql(
        ("g", "0", "key_value_group", "0", "'- **Title:** ' || r || chr(10) || '- **Author:** nobody'"), ("g", "1", "heading", "1", "r"), ("g", "2", "paragraph", "0", "'Nations of ' || r"),
        ("g", "3", "table", "0", "'| Nations |   |' || chr(10) || '| --- | --- |' || chr(10) || " + _all("'| ' || x.k || ' | ' || x.n || ' |'", _NL)),
        ("g", "4", "list", "0", _all("CASE WHEN x.i % 2 = 1 THEN (x.i + 1) // 2 || '. ' || x.n ELSE '  1. ' || x.n END", _NL)), ("g", "5", "paragraph", "0", "'End'"),
    ),
    "read_xlsx": _sql(
        ("g", "0", "heading", "2", "r"), ("g", "1", "table", "0", "'| key | name | flag |' || chr(10) || '| --- | --- | --- |' || chr(10) || " + _all("'| ' || x.k || ' | ' || x.n || ' | ' || CASE WHEN x.i = 1 THEN '' WHEN x.i % 2 = 0 THEN 'True' ELSE 'False' END || ' |'", _NL)),
        ("g", "2", "heading", "2", "'Keys'"), ("g", "3", "key_value_group", "0", _all("'- **' || x.n || ':** ' || x.k", _NL)),
    ),
    "read_pptx": _sql(("n", "3 * i - 3", "heading", "2", "n"), ("n", "3 * i - 2", "list", "0", "CASE WHEN i = 1 THEN '- In ' || r || chr(10) ELSE '' END || '- Key ' || k"), ("n", "3 * i - 1", "blockquote", "0", "'[Speaker notes] Note ' || k")),
}
