"""Layout of PDF pages as relations: spans (doc_id, page, text, size, bold, x, y, x1, y1) and pages (doc_id, page, width, height).

Whoever has a PDF library supplies the rows; nothing here reads files. Spans of different pages never meet but by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions.binding import let

TOP, BOTTOM = 0.12, 0.88
IMAGE_CHARS = 50
RANGE_NUMBER = r"^(?i)(?:page\s+[0-9]+(?:\s+(?:of|/)\s+[0-9]+)?|-\s*[0-9]+\s*-)$"
BARE_NUMBER = r"^[0-9]+(?:/[0-9]+)?$"


def page_facts(spans: DataFrame, pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, is_image, is_table, is_multicolumn); tables: (doc_id, page) of pages with a table."""
    w = Window.partitionBy("doc_id", "page")
    s = spans.withColumn("_mid", (F.min("x").over(w) + F.max("x").over(w)) / 2)
    f = s.groupBy("doc_id", "page").agg(
        F.sum(F.length(txt.strip(F.col("text")))).alias("chars"), F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("wide"),
        F.count_if(F.col("x") < F.col("_mid")).alias("left"), F.count_if(F.col("x") >= F.col("_mid")).alias("right"),
    )
    t = tables.select("doc_id", "page").distinct().withColumn("_t", F.lit(True))
    chars = F.coalesce("chars", F.lit(0))
    two = (chars >= IMAGE_CHARS) & (F.col("n") >= 12) & (F.col("wide") > F.col("width") * 0.40) & (F.col("left") >= 4) & (F.col("right") >= 4)
    return pages.join(f, ["doc_id", "page"], "left").join(t, ["doc_id", "page"], "left").select(
        "doc_id", "page", (chars < IMAGE_CHARS).alias("is_image"), F.coalesce("_t", F.lit(False)).alias("is_table"), F.coalesce(two, F.lit(False)).alias("is_multicolumn")
    )


def labelled(facts: DataFrame) -> DataFrame:
    """(doc_id, label, page_count, image_pages, table_pages, multi_col_pages): the first label whose share of pages is reached."""
    n = F.count("*")
    d = facts.groupBy("doc_id").agg(
        n.alias("page_count"), F.count_if("is_image").alias("image_pages"), F.count_if("is_table").alias("table_pages"), F.count_if("is_multicolumn").alias("multi_col_pages")
    )
    share = lambda c: F.col(c) / F.col("page_count")
    label = (
        F.when(share("image_pages") >= 0.80, "scanned").when(share("image_pages") >= 0.20, "hybrid").when(share("table_pages") >= 0.30, "table_heavy")
        .when(share("multi_col_pages") >= 0.30, "layout_heavy").when(1 - share("image_pages") >= 0.80, "native_text").otherwise("low_confidence")
    )
    return d.withColumn("label", label)


def removable(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, text): page numbers, and texts that are in the top or bottom zone of 30 % of the pages (3 at least) or on
    40 % of the pages and in a zone once. Bare numbers count as page numbers only inside a zone."""
    t = txt.strip(F.col("text"))
    s = spans.join(pages, ["doc_id", "page"]).withColumn("text", t).filter("text <> ''")
    rel = F.when(F.col("height") > 0, F.col("y") / F.col("height")).otherwise(0.5)
    s = s.withColumn("_top", rel < TOP).withColumn("_bottom", rel > BOTTOM)
    zone = F.col("_top") | F.col("_bottom")
    numbers = s.filter(F.col("text").rlike(RANGE_NUMBER) | (F.col("text").rlike(BARE_NUMBER) & zone)).select("doc_id", "text")
    count = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    seen = s.groupBy("doc_id", "text").agg(
        F.countDistinct(F.when(F.col("_top"), F.col("page"))).alias("top"), F.countDistinct(F.when(F.col("_bottom"), F.col("page"))).alias("bottom"), F.countDistinct("page").alias("on")
    ).join(count, "doc_id")
    part = lambda p: F.greatest(F.lit(3), F.floor(F.col("n") * p))
    often = (F.col("top") >= part(0.3)) | (F.col("bottom") >= part(0.3)) | ((F.col("on") >= part(0.4)) & ((F.col("top") > 0) | (F.col("bottom") > 0)))
    return numbers.unionByName(seen.filter(often).select("doc_id", "text")).distinct()


def outside(spans: DataFrame, boxes: DataFrame, slack: float = 6) -> DataFrame:
    """spans whose centre is in no box (doc_id, page, x0, y0, x1, y1) of its page, widened by ``slack``."""
    b = boxes.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x") + F.col("x1")) / 2, (F.col("y") + F.col("y1")) / 2
    inside = cx.between(F.col("bx0") - slack, F.col("bx1") + slack) & cy.between(F.col("by0") - slack, F.col("by1") + slack)
    return spans.join(b, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & inside, "left_anti")


def without_margin_numbers(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """spans without the line numbers of a manuscript: six integers or more in the left 8 % that step by 3 or less on average."""
    s = spans.join(pages.select("doc_id", "page", "width"), ["doc_id", "page"])
    mine = (F.col("x") < 0.08 * F.col("width")) & txt.strip(F.col("text")).rlike("^[0-9]{1,6}$")
    s = s.withColumn("_v", F.when(mine, txt.strip(F.col("text")).cast("int")))
    w = Window.partitionBy("doc_id", "page")
    sure = (F.count("_v").over(w) >= 6) & ((F.max("_v").over(w) - F.min("_v").over(w)) / (F.count("_v").over(w) - 1) <= 3)
    return s.withColumn("_drop", F.col("_v").isNotNull() & F.coalesce(sure, F.lit(False))).filter(~F.col("_drop")).drop("_v", "_drop", "width")


def heading_level(size: Column, bold: Column, median: Column, text: Column, centred: Column, has_toc: Column) -> Column:
    """1 to 5 for a heading, else null: by the size against the page's median, weight and capitals.

    Single characters and more than 15 words are never headings; a file with an outline has only its largest ones. Lines
    that begin or end like part of a sentence, or hold an address, need a ratio of 1.6.
    """
    words, ratio = txt.word_count(text), F.when(median > 0, size / median).otherwise(1.0)
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    upper = (letters != "") & (F.upper(text) == text) & (F.lower(text) != text)
    caps = upper & (F.length(letters) >= 0.5 * F.length(text)) & (F.length(text) > 3) & ~(F.contains(text, F.lit(",")) & F.contains(text, F.lit(".")))
    prose = text.rlike(r"^[\p{Ll}.,;:(]|[,;]$|http")
    acronym = (words == 1) & upper
    label = bold & ~prose & ~text.rlike(r"[:.\"]$") & (F.length(text) >= 3) & ~text.rlike(r"^(?i)(?:figure|fig\.|table)\b") & words.between(1, 3) & ~acronym
    return (
        F.when((F.length(txt.strip(text)) == 1) | (words > 15), None)
        .when(ratio >= 2.0, 1).when(ratio >= 1.6, 2).when(has_toc, None)
        .when((ratio >= 1.3) & ~prose & (bold | caps | ((ratio >= 1.5) & (words <= 5))), 3)
        .when((ratio >= 1.15) & ~prose & (bold | caps) & ~acronym, 4).when((ratio >= 1.10) & bold & ~prose, 5)
        .when(caps & centred & ~prose & (ratio >= 0.95) & (F.length(text) < 80), 4).when(label, 4)
    )


def column_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, boundary, transition_rate, flagged) of pages whose reading order jumps between two columns.

    blocks: (doc_id, page, idx, x). Pages of 5 positioned blocks or more whose widest gap of left edges lies in the middle
    60 % and is at least 15 % of the width and 60 points; flagged when 28 % of the steps cross it.
    """
    b = blocks.filter("x is not null").join(pages.select("doc_id", "page", "width"), ["doc_id", "page"])
    xs = b.select("doc_id", "page", "width", "x").distinct()
    gap = xs.withColumn("_n", F.lead("x").over(Window.partitionBy("doc_id", "page").orderBy("x"))).withColumn("_g", F.col("_n") - F.col("x"))
    mid = (F.col("x") + F.col("_n")) / 2
    best = gap.filter(mid.between(F.col("width") * 0.2, F.col("width") * 0.8) & (F.col("_g") >= F.greatest(F.lit(60.0), F.col("width") * 0.15)))
    best = best.groupBy("doc_id", "page").agg(F.max_by(mid, F.struct("_g", -F.col("x"))).alias("boundary"))
    side = b.join(best, ["doc_id", "page"]).withColumn("_s", F.col("x") >= F.col("boundary"))
    step = side.withColumn("_cross", (F.lag("_s").over(Window.partitionBy("doc_id", "page").orderBy("idx")) != F.col("_s")).cast("int"))
    out = step.groupBy("doc_id", "page", "boundary").agg(F.count("*").alias("_n"), (F.sum("_cross") / (F.count("*") - 1)).alias("transition_rate")).filter("_n >= 5").drop("_n")
    return out.withColumn("flagged", F.col("transition_rate") >= 0.28)


#: A line start counts as a column's margin if so many lines share it; lines are so many points high.
MARGIN_LINES, LINE_SLACK = 2, 3.0


def column_boundaries(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, boundary) with boundaries as shares of the width: at most two a page, in order.

    A line takes the spans within 3 points below its first one. Left ends of lines, rounded to hundredths, that two lines
    share are margins; a boundary lies halfway between two margins over 0.10 apart of which the right one is between
    0.30 and 0.70.
    """
    line = lambda s, p: F.when(
        (F.size(s) > 0) & (p["y"] - F.element_at(s, -1)["y"] <= LINE_SLACK),
        F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["y"].alias("y"), F.least(F.element_at(s, -1)["x"], p["x"]).alias("x")))),
    ).otherwise(F.concat(s, F.array(p)))
    on = spans.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")))).alias("s"))
    lines = on.select("doc_id", "page", F.explode_outer(F.aggregate("s", F.expr("cast(array() as array<struct<y: double, x: double>>)"), line)).alias("l")).filter("l is not null")
    rel = lines.join(pages.select("doc_id", "page", "width"), ["doc_id", "page"]).filter("width > 0").withColumn("r", F.col("l.x") / F.col("width"))
    m = rel.filter("r > 0.02 and r < 0.98").groupBy("doc_id", "page", F.bround("r", 2).alias("m")).agg(F.count("*").alias("n")).filter(F.col("n") >= MARGIN_LINES)
    w = Window.partitionBy("doc_id", "page").orderBy("m")
    b = m.withColumn("p", F.lag("m").over(w)).filter((F.col("m") - F.col("p") > 0.10) & (F.col("m") > 0.30) & (F.col("m") < 0.70))
    return b.withColumn("k", F.row_number().over(w)).filter("k <= 2").select("doc_id", "page", ((F.col("p") + F.col("m")) / 2).alias("boundary"))


def column_of(spans: DataFrame, pages: DataFrame, boundaries: DataFrame) -> DataFrame:
    """spans with ``column``: how many of the page's boundaries lie at or left of the span."""
    b = boundaries.groupBy("doc_id", "page").agg(F.collect_list("boundary").alias("_b"))
    s = spans.join(pages.select("doc_id", "page", "width"), ["doc_id", "page"]).join(b, ["doc_id", "page"], "left")
    rel = F.col("x") / F.col("width")
    n = F.coalesce(F.size(F.filter(F.coalesce("_b", F.array().cast("array<double>")), lambda x: x <= rel)), F.lit(0))
    return s.withColumn("column", F.when(F.col("width") > 0, n).otherwise(0)).drop("_b", "width")


def clustered(boxes: DataFrame, line: float = 6, gap: float = 30, least: float = 8) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1): boxes of a formula's characters as one box where they follow one another on a line,
    centres at most ``line`` and ends at most ``gap`` apart; narrower ones than ``least`` are left out."""
    mid = (F.col("y0") + F.col("y1")) / 2
    w = Window.partitionBy("doc_id", "page").orderBy("_m", "x0", "x1", "y0")
    b = boxes.withColumn("_m", mid).withColumn("_new", F.coalesce((F.abs(F.col("_m") - F.lag("_m").over(w)) > line) | (F.col("x0") - F.lag("x1").over(w) > gap), F.lit(True)))
    c = b.withColumn("_c", F.sum(F.col("_new").cast("int")).over(w)).groupBy("doc_id", "page", "_c")
    out = c.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.filter(F.col("x1") - F.col("x0") >= least).drop("_c")


#: Short lower-case words that are no fragments.
SHORT_WORDS = "all and avg bar cfm deg est for gpm high hrs kpa kwh lbs low max mbps mid min mph n/a na net no or pct per psi qty ref rpm sec sum tbd the vs yes".split()


def rejection(grid: Column) -> Column:
    """Why a grid, its first row the header, is no table, or null: the first reason that holds, in this order.

    too_short, too_few_cols, too_many_cols, dot_leader, word_fragment, too_sparse, prose_cells, single_letter_split,
    word_split, line_number_bleed, line_number_col.
    """

    def reasons(g: Column) -> Column:
        full = lambda r: F.filter(F.transform(r, lambda c: txt.strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
        head, rows = full(g[0]), F.slice(g, 2, F.size(g))
        return let(F.struct(head.alias("head"), F.transform(rows, full).alias("rows"), F.flatten(F.transform(rows, full)).alias("cells"), F.aggregate(rows, F.lit(0), lambda s, r: s + F.size(r)).alias("places")), judged)

    def judged(t: Column) -> Column:
        head, rows, cells = t["head"], t["rows"], t["cells"]
        n, cols = F.size(cells), F.size(head)
        share = lambda kept, of, least: (of > 0) & (F.size(kept) / of > least)
        dots = F.filter(rows, lambda r: F.array_join(r, " ").rlike(r"\.{5,}"))
        short = F.filter(cells, lambda c: c.rlike(r"^\p{Ll}{1,4}$") & ~c.isin(*SHORT_WORDS))
        words = F.aggregate(cells, F.lit(0), lambda s, c: s + txt.word_count(c))
        broken = lambda r: F.aggregate(F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.size(r)), lambda a, b: (a.rlike(r"\p{L}$") & b.rlike(r"^\p{Ll}")).cast("int")), F.lit(0), lambda s, x: s + x)
        pairs = lambda r: F.greatest(F.size(r) - 1, F.lit(0))
        single = F.filter(rows, lambda r: (F.size(r) >= 2) & F.coalesce(F.get(r, 0).rlike(r"^\p{L}$") & F.get(r, 1).rlike(r"^\p{Ll}"), F.lit(False)))
        split = F.aggregate(rows, broken(head), lambda s, r: s + broken(r)) / F.nullif(F.aggregate(rows, pairs(head), lambda s, r: s + pairs(r)), F.lit(0))
        several = F.size(rows) >= 2
        return (
            F.when(F.size(rows) == 0, "too_short").when(cols < 2, "too_few_cols").when(cols > 12, "too_many_cols").when(F.size(dots) > F.size(rows) * 0.4, "dot_leader")
            .when(share(short, n, 0.25), "word_fragment").when((t["places"] > 0) & ((t["places"] - n) / t["places"] > 0.65), "too_sparse").when((n > 0) & (words / n > 12), "prose_cells")
            .when(several & (F.size(single) / F.size(rows) > 0.2), "single_letter_split").when(several & (split > 0.3), "word_split")
            .when(head[0].rlike(r"^\d{1,3}\s+[A-Z]"), "line_number_bleed").when((cols <= 3) & head[0].rlike(r"^0*(?:[1-9]|1\d|20)$"), "line_number_col")
        )

    return F.when(F.size(grid) < 2, "too_short").otherwise(reasons(grid))


def stitched_tables(tables: list[dict], slack: float = 30) -> list[dict]:
    """Tables of a document, in order, with the second of two joined to the first where a page break cut them: the next
    table, on the next page, with as many columns, whose header is the same (it is then dropped), or where the first
    ends within ``slack`` of its page's bottom and the second begins within it of its page's top. Until nothing joins.

    A table is a dict of page, header_rows, grid, y0, y1 and height (of its page), and gets ``parts``: (page, rows).
    """
    now = [{**t, "parts": [(t["page"], len(t["grid"]))]} for t in tables]
    while True:
        out, i = [], 0
        while i < len(now):
            a = now[i]
            b = now[i + 1] if i + 1 < len(now) else None
            joined = None if b is None else _stitched(a, b, slack)
            out.append(joined or a)
            i += 2 if joined else 1
        if len(out) == len(now):
            return out
        now = out


def _stitched(a: dict, b: dict, slack: float) -> dict | None:
    width = lambda t: max(map(len, t["grid"]), default=0)
    if a["page"] is None or b["page"] is None or b["page"] != a["page"] + 1 or width(a) != width(b):
        return None
    head = lambda t: [[(c or "").strip() for c in r] for r in t["grid"][: t["header_rows"]]]
    same = bool(head(a)) and head(a) == head(b)
    if not same:
        if None in (a["y1"], b["y0"], a["height"]) or a["height"] <= 0 or a["height"] - a["y1"] > slack or b["y0"] > slack:
            return None
    rest = b["grid"][b["header_rows"] :] if same else b["grid"]
    parts = a["parts"] + [(p, n - (b["header_rows"] if same and k == 0 else 0)) for k, (p, n) in enumerate(b["parts"])]
    return {**a, "grid": a["grid"] + rest, "y1": b["y1"], "parts": parts}


_TABLE = "page: int, header_rows: int, grid: array<array<string>>, y0: double, y1: double, height: double"


def stitched(docs: DataFrame) -> DataFrame:
    """(doc_id, tables) with tables cut by page breaks joined; tables: array of (page, header_rows, grid, y0, y1, height)
    in order, and afterwards parts: array of (page, rows). One pass over whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.struct([("page", pa.int32()), ("rows", pa.int32())])
        kind = pa.list_(pa.struct([("page", pa.int32()), ("header_rows", pa.int32()), ("grid", pa.list_(pa.list_(pa.string()))), ("y0", pa.float64()), ("y1", pa.float64()), ("height", pa.float64()), ("parts", pa.list_(part))]))
        for batch in batches:
            got = [[{**t, "parts": [{"page": p, "rows": n} for p, n in t["parts"]]} for t in stitched_tables(ts or [])] for ts in batch.column("tables").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, kind)], ["doc_id", "tables"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tables").mapInArrow(run, f"doc_id long, tables array<struct<{_TABLE}, parts: array<struct<page: int, rows: int>>>>")


STYLES = ("strike", "under", "bold", "italic", "sup", "sub")


def inline_runs(spans: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """(keys, text): the spans of each block (keys, idx, text and six flags) as one text, runs of one style marked together."""
    w = Window.partitionBy(*keys).orderBy(idx)
    style = F.struct(*[F.coalesce(c, F.lit(False)).alias(c) for c in STYLES])
    s = spans.withColumn("_style", style).withColumn("_new", F.coalesce(F.lag("_style").over(w) != F.col("_style"), F.lit(True)))
    runs = s.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w)).groupBy(*keys, "_run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(idx, "text"))), lambda x: x["text"]), " ").alias("t"), F.first("_style").alias("f"))
    mark = lambda t, on, left, right: F.when(on, F.concat(F.lit(left), t, F.lit(right))).otherwise(t)
    f = F.col("f")
    t = mark(mark(F.col("t"), f["strike"], "~~", "~~"), f["under"], "<u>", "</u>")
    t = F.when(f["bold"] & f["italic"], F.concat(F.lit("***"), t, F.lit("***"))).when(f["bold"], F.concat(F.lit("**"), t, F.lit("**"))).when(f["italic"], F.concat(F.lit("*"), t, F.lit("*"))).otherwise(t)
    t = F.when(f["sup"], F.concat(F.lit("<sup>"), t, F.lit("</sup>"))).when(f["sub"], F.concat(F.lit("<sub>"), t, F.lit("</sub>"))).otherwise(t)
    return runs.withColumn("t", t).groupBy(*keys).agg(txt.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_run", "t"))), lambda x: x["t"]), " ")).alias("text"))


_CELL_FURNITURE = r"(?i)^(?:[0-9]+/[0-9]+/[0-9]{2,4}\s+[0-9]+:[0-9]+\s*(?:AM|PM)\s+Page\s+\S+|page\s+[0-9]+(?:\s+of\s+[0-9]+)?)$|^[0-9]{4}\s+©"


def cell_text(c: Column) -> Column:
    """A cell without unmapped glyphs, invisible characters and footnote marks, blanks collapsed; page furniture is empty."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\(cid:[0-9]+\)|�|[­​-‍﻿]", "")
    t = txt.strip(F.regexp_replace(F.regexp_replace(t, r"[²³¹⁰-⁹]+$", ""), r"\s+", " "))
    return F.when(t.rlike(_CELL_FURNITURE), "").otherwise(t)


def normalised(grid: Column) -> Column:
    """A grid of ``cell_text`` cells, short rows filled; above the first row with a digit, a cell that repeats the one above
    it is what is left of a merged cell, and is emptied."""

    def filled(rows: Column) -> Column:
        wide = F.array_max(F.transform(rows, F.size))
        return let(F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r)))), unghosted)

    def unghosted(rows: Column) -> Column:
        data = F.transform(rows, lambda r: F.exists(r, lambda c: c.rlike("[0-9]")))
        head = F.when(F.array_position(data, True) > 0, F.array_position(data, True) - 1).otherwise(F.size(rows))
        empty = F.array().cast("array<array<string>>")
        return F.aggregate(rows, empty, lambda done, r: F.concat(done, F.array(F.when(
            (F.size(done) > 0) & (F.size(done) < head), F.zip_with(r, F.element_at(done, -1), lambda c, above: F.when((c != "") & (c == above), "").otherwise(c))
        ).otherwise(r))))

    return F.when(F.size(grid) > 0, let(F.transform(grid, lambda r: F.transform(r, cell_text)), filled)).otherwise(grid)
