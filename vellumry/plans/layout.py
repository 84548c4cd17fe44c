"""Page layout on pages that are made of the line items: 50 documents of seven pages, 500 x 800 points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import expectation, pdf
from .tables import grids, read

#: Columns of a span in the SQL that Spark and DuckDB share.
_SPAN = {
    "doc_id": "l_orderkey % 50", "page": "l_linenumber", "x": "CAST((l_partkey % 50) * 10 AS DOUBLE)", "y": "CAST((l_orderkey * 4 + l_suppkey * 36) % 800 AS DOUBLE)", "n": "l_orderkey",
    "text": "CASE WHEN l_orderkey % 11 = 0 THEN concat('Page ', l_linenumber) WHEN l_orderkey % 7 = 0 THEN CAST(l_linenumber AS STRING) WHEN l_quantity < 4 THEN concat('Header ', l_returnflag) ELSE concat('words of item ', l_partkey) END",
}


def spans(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in _SPAN.items()])


def sheets(spark, sf_dir) -> DataFrame:
    """(doc_id, page, width, height) of all pages."""
    return spans(spark, sf_dir).select("doc_id", "page").distinct().withColumns({"width": F.lit(500.0), "height": F.lit(800.0)})


def pdf_page_labels(spark, sf_dir):
    """What kind of document the pages make: an even one has tables on its first pages, every fifth hardly any text."""
    s = spans(spark, sf_dir).filter("doc_id % 5 > 0 or (page > 4 and n % 40 = 0)")
    tables = sheets(spark, sf_dir).filter("doc_id % 2 = 0 and page < 4").select("doc_id", "page")
    return pdf.labelled(pdf.page_facts(s, sheets(spark, sf_dir), tables))


def pdf_removable(spark, sf_dir):
    return pdf.removable(spans(spark, sf_dir), sheets(spark, sf_dir))


def pdf_outside_tables(spark, sf_dir):
    s = spans(spark, sf_dir).withColumns({"x1": F.col("x") + 20, "y1": F.col("y") + 10})
    boxes = sheets(spark, sf_dir).filter("doc_id % 2 = 0").select("doc_id", "page", *[F.lit(v).alias(k) for k, v in (("x0", 100.0), ("y0", 100.0), ("x1", 250.0), ("y1", 400.0))])
    return pdf.outside(s, boxes).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum("x").alias("x"))


def pdf_margin_numbers(spark, sf_dir):
    """Numbers at the left edge: close together on odd pages, far apart on even ones."""
    s = spans(spark, sf_dir).withColumn("text", F.when(F.col("x") < 30, F.when(F.col("page") % 2 == 1, F.col("n") % 9).otherwise(F.col("n")).cast("string")).otherwise(F.col("text")))
    return pdf.without_margin_numbers(s, sheets(spark, sf_dir)).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum("x").alias("x"))


def pdf_column_order(spark, sf_dir):
    b = spans(spark, sf_dir).filter("x < 30 or x between 300 and 320").select("doc_id", "page", F.struct("n", "y").alias("idx"), "x")
    return pdf.column_order(b, sheets(spark, sf_dir)).withColumn("transition_rate", F.bround("transition_rate", 6))


def _two_columns(spark, sf_dir) -> DataFrame:
    """Spans of which the lines begin at a left margin or, on even pages, also at one in the middle."""
    return spans(spark, sf_dir).withColumn("x", F.when(F.col("page") % 2 == 1, 50 + F.col("x") % 3 * 40).when(F.col("y") % 8 == 0, 50.0).otherwise(270 + F.col("n") % 2 * 2))


def pdf_columns(spark, sf_dir):
    s, p = _two_columns(spark, sf_dir), sheets(spark, sf_dir)
    b = pdf.column_boundaries(s, p)
    c = pdf.column_of(s, p, b).groupBy("doc_id", "page").agg(F.count("*").alias("spans"), F.sum("column").alias("right"))
    return c.join(b.groupBy("doc_id", "page").agg(F.bround(F.min("boundary"), 6).alias("first"), F.count("*").alias("boundaries")), ["doc_id", "page"], "left").na.fill(-1.0, ["first"]).na.fill(0, ["boundaries"])


def pdf_formula_boxes(spark, sf_dir):
    b = spans(spark, sf_dir).filter("n % 3 = 0").select("doc_id", "page", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 4 + F.col("n") % 9).alias("x1"), (F.col("y") + 8).alias("y1"))
    return pdf.clustered(b.distinct()).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum("x0").alias("x0"), F.sum("x1").alias("x1"), F.sum("y0").alias("y0"), F.max("y1").alias("y1"))


#: Grids that each give one reason, in the order of the reasons.
_GRIDS = {
    "too_short": [["a", "b"]], "too_few_cols": [["a", ""], ["1", "2"]], "too_many_cols": [["x"] * 13, ["1"] * 13], "dot_leader": [["Part", "Page"], ["One ......", "3"]], "word_fragment": [["Name", "City"], ["Sign", "ore"], ["Fan", "tasy"]],
    "too_sparse": [["A", "B", "C"], ["1", "", ""], ["", "", "2"]], "prose_cells": [["A", "B"], ["w " * 13, "w " * 13]], "single_letter_split": [["Form", "No"], ["Q", "uotation"], ["12", "13"], ["14", "15"]],
    "word_split": [["Company Nam L", "e, Inc."], ["Total due", "from them"], ["12", "13"]], "line_number_bleed": [["1 Supp", "B"], ["2", "3"]], "line_number_col": [["7", "B"], ["8", "Text"]], "none": [["Key", "Value"], ["1", "2.5"], ["2", "3.5"]],
}


def pdf_table_rejection(spark, sf_dir):
    """Reasons for grids that have one, and for the tables of all customers: of two rows under that header, words look split."""
    made = spark.createDataFrame([(-i, g) for i, g in enumerate(_GRIDS.values(), 1)], "table_id bigint, grid array<array<string>>")
    both = made.unionByName(grids(spark, sf_dir).select(F.col("table_id").cast("long").alias("table_id"), "grid"))
    return both.select("table_id", F.coalesce(pdf.rejection(F.col("grid")), F.lit("none")).alias("reason"))


def pdf_stitched_tables(spark, sf_dir):
    """Orders of a customer as one-row tables on pages of their own: the header is the status, so that equal neighbours join."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.row_number().over(_by_order()).alias("page"))
    t = F.struct(
        F.col("page"), F.lit(1).alias("header_rows"), F.array(F.array(F.col("o_orderstatus")), F.array(F.col("o_orderkey").cast("string"))).alias("grid"),
        F.when(F.col("o_orderkey") % 3 == 0, 20.0).otherwise(300.0).alias("y0"), F.when(F.col("o_orderkey") % 2 == 0, 790.0).otherwise(400.0).alias("y1"), F.lit(800.0).alias("height"),
    )
    d = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(t)).alias("tables"))
    s = pdf.stitched(d).select("doc_id", F.explode_outer("tables").alias("t")).filter("t is not null")
    return s.select("doc_id", F.col("t.page").alias("page"), F.size("t.grid").alias("rows"), F.array_join(F.transform("t.parts", lambda p: F.concat_ws(":", p["page"], p["rows"])), ",").alias("parts"))


def pdf_inline_runs(spark, sf_dir):
    """Line items as spans of a block an order, styled by quantity, discount and flags."""
    line = read(spark, sf_dir, "lineitem").filter("l_orderkey % 5 = 0").dropDuplicates(["l_orderkey", "l_linenumber"])
    s = line.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), F.concat(F.lit("w"), F.col("l_linenumber")).alias("text"), (F.col("l_linenumber") % 3 == 0).alias("bold"), (F.col("l_orderkey") % 2 == 0).alias("italic"),
        (F.col("l_linenumber") > 5).alias("strike"), (F.col("l_orderkey") % 7 == 0).alias("under"), (F.col("l_linenumber") == 4).alias("sup"), F.lit(None).cast("boolean").alias("sub"),
    )
    return pdf.inline_runs(s, ["doc_id"])


#: Cells and what stays of them.
_CELLS = {
    "(cid:12)abc (cid:3)": "abc", "  a \t b\n c ": "a b c", "x²⁴": "x", "Page 3 of 9": "", "12/03/2021 10:15 AM Page 4": "", "soft\u00adhy\u200bphen\ufffd": "softhyphen", "1999 © us": "", "²a": "²a", "page nine": "page nine", "": "",
}


def pdf_cells(spark, sf_dir):
    """Grids of a customer: a header of two rows that repeat each other, one row of an odd cell, and the orders, one cell short."""
    odd = F.array(*[F.lit(c) for c in _CELLS])
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit(" "), F.col("o_orderstatus"))))).alias("rows"))
    head = F.array(F.array(F.lit("Order"), F.lit("State"), F.lit("Note")), F.array(F.lit("Order"), F.lit("State "), F.lit("y")), F.array(F.lit("Order"), F.lit(None), F.get(odd, (F.col("o_custkey") % len(_CELLS)).cast("int"))))
    g = o.select("o_custkey", pdf.normalised(F.concat(head, F.col("rows"))).alias("g"))
    return g.select(F.col("o_custkey").alias("doc_id"), F.array_join(F.transform("g", lambda r: F.array_join(r, "|")), ";").alias("grid"))


def page_table_expectation(spark, sf_dir):
    """Events of a user as blocks of five pages, some captions, some lines of numbers or dots; errors as rejected candidates."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("doc_id"), (F.col("event_id") % 5).cast("int").alias("page"))
    content = F.when(F.col("event_id") % 90 == 1, "see Table 3 below").when(F.col("event_id") % 11 == 2, "total 12 13,5%\nno 4").when(F.col("event_id") % 13 == 3, "Part . . . . 4\nOther ..... 5").otherwise("plain words here")
    blocks = e.filter("event_type <> 'error'").select("doc_id", "page", F.when(F.col("event_id") % 17 == 0, "table").otherwise("paragraph").alias("type"), content.alias("content"))
    rejected = e.filter("event_type = 'error' and event_id % 30 < 4").select("doc_id", "page", F.when(F.col("event_id") % 30 == 0, "dot_leader").otherwise("too_sparse").alias("reason"))
    docs = e.select("doc_id").distinct().withColumn("label", F.when(F.col("doc_id") % 4 == 0, "table_heavy").otherwise("native_text"))
    x = expectation.table_expectation(blocks, rejected, docs)
    return x.select("doc_id", "page", F.array_join("signals", ",").alias("signals"), "expected", "confidence")


def pdf_furniture_tables(spark, sf_dir):
    """Tables of two rows at places of the page by order."""
    o = read(spark, sf_dir, "orders")
    content = F.concat(F.lit("| Key | Priority of it |\n| --- | --- |\n| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_orderpriority"), F.lit(" |"))
    y0 = (F.col("o_orderkey") % 700).cast("double")
    return o.select("o_orderkey", expectation.furniture_table(content, y0, y0 + 60, F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(800.0)).alias("furniture"))


def interleaved_parts(spark, sf_dir):
    """Events of a user: errors are images, every third without a picture."""
    e = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("idx"), F.when(F.col("event_type") == "error", "image").otherwise("paragraph").alias("type"),
        F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit("e"), F.col("event_id"))).alias("content"), (F.col("event_id") % 3 > 0).alias("has_image"),
    )
    return expectation.interleaved(e, 5)


def _by_order():
    from pyspark.sql import Window

    return Window.partitionBy("o_custkey").orderBy("o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (pdf_page_labels, pdf_removable, pdf_outside_tables, pdf_margin_numbers, pdf_column_order, pdf_columns, pdf_formula_boxes, pdf_table_rejection, pdf_stitched_tables, pdf_inline_runs, pdf_cells, page_table_expectation, pdf_furniture_tables, interleaved_parts)
}

_S = "s AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _SPAN.items()) + " FROM lineitem), p AS (SELECT DISTINCT doc_id, page, CAST(500 AS DOUBLE) AS width, CAST(800 AS DOUBLE) AS height FROM s)"
_OWN = "PARTITION BY doc_id, page"
_REASONS = " UNION ALL ".join(f"SELECT CAST({-i} AS BIGINT), '{k}'" for i, k in enumerate(_GRIDS, 1))
ORACLE_SQL = {
    "pdf_page_labels": f"""WITH {_S}, u AS (SELECT *, (min(x) OVER ({_OWN}) + max(x) OVER ({_OWN})) / 2 AS mid FROM s WHERE doc_id % 5 > 0 OR (page > 4 AND n % 40 = 0)),
 f AS (SELECT doc_id, page, sum(length(trim(text))) AS chars, count(*) AS n, max(x) - min(x) AS wide, count(*) FILTER (x < mid) AS l, count(*) FILTER (x >= mid) AS r FROM u GROUP BY ALL),
 q AS (SELECT p.doc_id, coalesce(chars, 0) < 50 AS image, doc_id % 2 = 0 AND page < 4 AS tab, coalesce(chars >= 50 AND n >= 12 AND wide > width * 0.4 AND l >= 4 AND r >= 4, false) AS multi FROM p LEFT JOIN f USING (doc_id, page)),
 d AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (image) AS image_pages, count(*) FILTER (tab) AS table_pages, count(*) FILTER (multi) AS multi_col_pages FROM q GROUP BY doc_id)
 SELECT *, CASE WHEN image_pages / page_count >= 0.8 THEN 'scanned' WHEN image_pages / page_count >= 0.2 THEN 'hybrid' WHEN table_pages / page_count >= 0.3 THEN 'table_heavy' WHEN multi_col_pages / page_count >= 0.3 THEN 'layout_heavy'
 WHEN 1 - image_pages / page_count >= 0.8 THEN 'native_text' ELSE 'low_confidence' END AS label FROM d""",
    "pdf_removable": f"""WITH {_S}, r AS (SELECT s.doc_id, s.page, trim(text) AS text, y / 800 < 0.12 AS top, y / 800 > 0.88 AS bottom FROM s WHERE trim(text) <> ''), c AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
 k AS (SELECT doc_id, text, count(DISTINCT page) FILTER (top) AS t, count(DISTINCT page) FILTER (bottom) AS b, count(DISTINCT page) AS o FROM r GROUP BY ALL)
 SELECT DISTINCT doc_id, text FROM r WHERE regexp_matches(text, '^Page [0-9]+$') OR (regexp_matches(text, '^[0-9]+$') AND (top OR bottom))
 UNION SELECT doc_id, text FROM k JOIN c USING (doc_id) WHERE t >= greatest(3, floor(n * 0.3)) OR b >= greatest(3, floor(n * 0.3)) OR (o >= greatest(3, floor(n * 0.4)) AND t + b > 0)""",
    "pdf_outside_tables": f"WITH {_S} SELECT doc_id, page, count(*) AS n, sum(x) AS x FROM s WHERE NOT (doc_id % 2 = 0 AND x + 10 BETWEEN 94 AND 256 AND y + 5 BETWEEN 94 AND 406) GROUP BY ALL",
    "pdf_margin_numbers": f"""WITH {_S}, v AS (SELECT doc_id, page, x, CASE WHEN x < 30 THEN CASE WHEN page % 2 = 1 THEN n % 9 ELSE n END WHEN x < 40 AND regexp_matches(text, '^[0-9]+$') THEN CAST(page AS BIGINT) END AS v FROM s),
 c AS (SELECT doc_id, page, count(v) >= 6 AND (max(v) - min(v)) / (count(v) - 1) <= 3 AS sure FROM v GROUP BY ALL) SELECT doc_id, page, count(*) AS n, sum(x) AS x FROM v JOIN c USING (doc_id, page) WHERE v IS NULL OR NOT coalesce(sure, false) GROUP BY ALL""",
    "pdf_column_order": f"""WITH {_S}, b AS (SELECT doc_id, page, n, y, x FROM s WHERE x < 30 OR x BETWEEN 300 AND 320), d AS (SELECT DISTINCT doc_id, page, x FROM b), g AS (SELECT *, lead(x) OVER ({_OWN} ORDER BY x) AS z FROM d),
 m AS (SELECT doc_id, page, (x + z) / 2 AS boundary FROM g WHERE (x + z) / 2 BETWEEN 100 AND 400 AND z - x >= 75 QUALIFY row_number() OVER ({_OWN} ORDER BY z - x DESC, x) = 1),
 t AS (SELECT doc_id, page, boundary, CAST((x >= boundary) <> lag(x >= boundary) OVER ({_OWN} ORDER BY n, y) AS INTEGER) AS c FROM b JOIN m USING (doc_id, page))
 SELECT doc_id, page, boundary, round_even(sum(c) / (count(*) - 1), 6) AS transition_rate, round_even(sum(c) / (count(*) - 1), 6) >= 0.28 AS flagged FROM t GROUP BY ALL HAVING count(*) >= 5""",
    "pdf_columns": f"""WITH {_S}, u AS (SELECT doc_id, page, y, CASE WHEN page % 2 = 1 THEN 50 + x % 3 * 40 WHEN y % 8 = 0 THEN 50.0 ELSE 270 + n % 2 * 2 END AS x FROM s), l AS (SELECT doc_id, page, min(x) / 500 AS r FROM u GROUP BY doc_id, page, y),
 m AS (SELECT doc_id, page, round_even(r, 2) AS m FROM l WHERE r > 0.02 AND r < 0.98 GROUP BY ALL HAVING count(*) >= 2), g AS (SELECT *, lag(m) OVER ({_OWN} ORDER BY m) AS p FROM m),
 b AS (SELECT doc_id, page, (p + m) / 2 AS b FROM g WHERE m - p > 0.10 AND m > 0.3 AND m < 0.7 QUALIFY row_number() OVER ({_OWN} ORDER BY m) <= 2), f AS (SELECT doc_id, page, round_even(min(b), 6) AS first, count(*) AS boundaries, list(b) AS bs FROM b GROUP BY ALL)
 SELECT u.doc_id, u.page, count(*) AS spans, CAST(sum(coalesce(len(list_filter(bs, lambda v: v <= x / 500)), 0)) AS BIGINT) AS right, coalesce(any_value(first), -1.0) AS first, coalesce(any_value(boundaries), 0) AS boundaries FROM u LEFT JOIN f USING (doc_id, page) GROUP BY ALL""",
    "pdf_formula_boxes": f"""WITH {_S}, b AS (SELECT DISTINCT doc_id, page, x AS x0, y AS y0, x + 4 + n % 9 AS x1, y + 8 AS y1 FROM s WHERE n % 3 = 0),
 l AS (SELECT *, coalesce(abs((y0 + y1) / 2 - lag((y0 + y1) / 2) OVER w) > 6 OR x0 - lag(x1) OVER w > 30, true) AS new FROM b WINDOW w AS ({_OWN} ORDER BY (y0 + y1) / 2, x0, x1, y0)),
 c AS (SELECT *, sum(CAST(new AS INTEGER)) OVER ({_OWN} ORDER BY (y0 + y1) / 2, x0, x1, y0) AS c FROM l), m AS (SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c GROUP BY doc_id, page, c HAVING max(x1) - min(x0) >= 8)
 SELECT doc_id, page, count(*) AS n, sum(x0) AS x0, sum(x1) AS x1, sum(y0) AS y0, max(y1) AS y1 FROM m GROUP BY ALL""",
    "pdf_table_rejection": f"SELECT * FROM ({_REASONS}) t(table_id, reason) UNION ALL SELECT o_custkey, CASE WHEN count(*) = 2 THEN 'word_split' ELSE 'none' END FROM orders GROUP BY o_custkey",
    "pdf_stitched_tables": """WITH o AS (SELECT o_custkey AS d, o_orderkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders),
 j AS (SELECT *, lead(s) OVER w IS NOT DISTINCT FROM s AS same, coalesce(lead(s) OVER w = s OR (k % 2 = 0 AND lead(k) OVER w % 3 = 0), false) AS joins FROM o WINDOW w AS (PARTITION BY d ORDER BY page)),
 r AS (SELECT *, page - max(CASE WHEN NOT joins THEN page ELSE 0 END) OVER (PARTITION BY d ORDER BY page) AS nth FROM j), t AS (SELECT *, joins AND nth % 2 = 1 AS first FROM r),
 f AS (SELECT *, coalesce(lag(first) OVER (PARTITION BY d ORDER BY page), false) AS taken FROM t)
 SELECT CAST(d AS BIGINT) AS doc_id, CAST(page AS INTEGER) AS page, CAST(CASE WHEN NOT first THEN 2 WHEN same THEN 3 ELSE 4 END AS INTEGER) AS rows,
 page || ':2' || CASE WHEN first THEN ',' || (page + 1) || CASE WHEN same THEN ':1' ELSE ':2' END ELSE '' END AS parts FROM f WHERE NOT taken""",
    "pdf_inline_runs": """WITH s AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS i FROM lineitem WHERE l_orderkey % 5 = 0), k AS (SELECT *, (i % 3 = 0)::INT + 2 * (i > 5)::INT + 4 * (i = 4)::INT AS f FROM s),
 r AS (SELECT *, sum(CASE WHEN f IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY i) AS r FROM (SELECT *, lag(f) OVER (PARTITION BY d ORDER BY i) AS p FROM k)),
 t AS (SELECT d, r, any_value(f) AS f, string_agg('w' || i, ' ' ORDER BY i) AS t FROM r GROUP BY d, r), a AS (SELECT d, r, f, CASE WHEN f & 2 > 0 THEN '~~' || t || '~~' ELSE t END AS t FROM t), u AS (SELECT d, r, f, CASE WHEN d % 7 = 0 THEN '<u>' || t || '</u>' ELSE t END AS t FROM a),
 b AS (SELECT d, r, f, CASE WHEN f & 1 > 0 AND d % 2 = 0 THEN '***' || t || '***' WHEN f & 1 > 0 THEN '**' || t || '**' WHEN d % 2 = 0 THEN '*' || t || '*' ELSE t END AS t FROM u)
 SELECT d AS doc_id, string_agg(CASE WHEN f & 4 > 0 THEN '<sup>' || t || '</sup>' ELSE t END, ' ' ORDER BY r) AS text FROM b GROUP BY d""",
    "pdf_cells": f"""SELECT o_custkey AS doc_id, 'Order|State|Note;||y;Order||' || [{", ".join("'" + v + "'" for v in _CELLS.values())}][1 + o_custkey % {len(_CELLS)}] || ';' || string_agg(o_orderkey || '|' || o_orderstatus || '|', ';' ORDER BY CAST(o_orderkey AS VARCHAR)) AS grid FROM orders GROUP BY o_custkey""",
    "page_table_expectation": """WITH e AS (SELECT event_id AS e, event_type AS t, user_id AS d, CAST(event_id % 5 AS INTEGER) AS p FROM events),
 k AS (SELECT d, p, CASE WHEN e % 90 = 1 THEN 'c' WHEN e % 11 = 2 THEN 'n' WHEN e % 13 = 3 THEN 'd' ELSE '' END AS k, e % 17 = 0 AS tab FROM e WHERE t <> 'error'),
 b AS (SELECT d, p, bool_or(NOT tab AND k = 'c') AS c, count_if(NOT tab AND k = 'n') >= 3 AS n, 2 * count_if(NOT tab AND k = 'd') >= 3 AS l, bool_or(tab) AS tab FROM k GROUP BY ALL), r AS (SELECT d, p, bool_or(e % 30 = 0) AS dot FROM e WHERE t = 'error' AND e % 30 < 4 GROUP BY ALL),
 s AS (SELECT d, p, r.dot IS NOT NULL AS r, coalesce(c, false) AS c, coalesce(n, false) AS n, coalesce(dot, false) OR coalesce(l, false) AS l, d % 4 = 0 AND NOT coalesce(tab, false) AS h FROM b FULL JOIN r USING (d, p)),
 f AS (SELECT *, CAST(r AS INTEGER) + CAST(c OR n AS INTEGER) + CAST(l AS INTEGER) + CAST(h AS INTEGER) AS f FROM s)
 SELECT d AS doc_id, p AS page, array_to_string(list_filter([CASE WHEN r THEN 'rejected_candidate' END, CASE WHEN c THEN 'caption_nearby' END, CASE WHEN n THEN 'numeric_alignment' END, CASE WHEN l THEN 'leader_dots' END, CASE WHEN h THEN 'doc_table_heavy' END], lambda x: x IS NOT NULL), ',') AS signals,
 CASE WHEN f >= 2 AND NOT (r AND n AND NOT c AND NOT l AND NOT h) THEN 'true' WHEN f > 0 THEN 'unknown' ELSE 'false' END AS expected, f / 4 AS confidence FROM f""",
    "pdf_furniture_tables": "SELECT o_orderkey, o_orderkey % 10 > 0 AND (o_orderkey % 700 < 80 OR o_orderkey % 700 + 60 > 720) AND (1 + (length(CAST(o_orderkey AS VARCHAR)) <= 6)::INT + (length(replace(o_orderpriority, ' ', '')) <= 6)::INT) / 4 >= 0.45 AS furniture FROM orders",
    "interleaved_parts": """WITH e AS (SELECT user_id AS d, event_id AS i, event_type = 'error' AS im, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'e' || event_id END AS c, event_id % 3 > 0 AS h FROM events), n AS (SELECT *, im AND h AND sum(CAST(im AND h AS INTEGER)) OVER (PARTITION BY d ORDER BY i) <= 5 AS y FROM e),
 p AS (SELECT *, sum(CAST(y AS INTEGER)) OVER (PARTITION BY d ORDER BY i) AS p FROM n), t AS (SELECT d, p * 2 + 1 AS a, 'text' AS type, string_agg(CASE WHEN y THEN '*' || c || '*' WHEN im THEN '[Image: ' || c || ']' ELSE c END, chr(10) || chr(10) ORDER BY i) AS text FROM p WHERE c <> '' GROUP BY d, p),
 a AS (SELECT * FROM t UNION ALL SELECT d, p * 2, 'image', c FROM p WHERE y) SELECT d AS doc_id, CAST(row_number() OVER (PARTITION BY d ORDER BY a) AS INTEGER) AS part, type, text FROM a""",
}
