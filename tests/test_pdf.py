"""Page layout on small span tables."""

import pytest
from pyspark.sql import functions as F

from vellumry import sources
from vellumry.operators import chunks, pdf
from vellumry.plans.tables import compiled


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, p, 600.0, 800.0) for p in range(1, 6)], "doc_id int, page int, width double, height double")


def spans(spark, rows):
    return spark.createDataFrame([(1, p, t, x, y) for p, t, x, y in rows], "doc_id int, page int, text string, x double, y double")


def test_headers_and_numbers_are_removable(spark, pages):
    s = spans(spark, [(p, t, 10.0, y) for p in range(1, 6) for t, y in (("Head", 20.0), (str(p), 790.0), ("7", 400.0), ("body", 400.0), ("Page 1 of 5", 400.0))])
    assert sorted(r.text for r in pdf.removable(s, pages).collect()) == ["1", "2", "3", "4", "5", "Head", "Page 1 of 5"]


def test_pages_are_labelled(spark, pages):
    rows = [(p, "words enough for a page", float(x), 100.0) for p in (1, 2, 3, 4) for x in (10, 10, 10, 10, 10, 10, 400, 400, 400, 400, 400, 400)]
    facts = pdf.page_facts(spans(spark, rows), pages, spark.createDataFrame([(1, 1)], "doc_id int, page int"))
    r = pdf.labelled(facts).first()
    assert (r.label, r.image_pages, r.table_pages, r.multi_col_pages) == ("hybrid", 1, 1, 4)


def test_spans_in_tables_and_margins_go(spark, pages):
    s = spans(spark, [(1, "in", 10.0, 10.0), (1, "out", 300.0, 10.0)]).withColumns({"x1": F.col("x") + 4, "y1": F.col("y") + 4})
    box = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0, 50.0)], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in pdf.outside(s, box).collect()] == ["out"]
    n = spans(spark, [(1, str(i), 5.0, i * 10.0) for i in range(1, 8)] + [(1, "text", 100.0, 10.0), (2, "9", 5.0, 10.0)])
    assert sorted(r.text for r in pdf.without_margin_numbers(n, pages).collect()) == ["9", "text"]


@pytest.mark.parametrize(
    ("size", "bold", "text", "centred", "toc", "level"),
    [
        (24, False, "Title", False, False, 1), (20, False, "part", False, True, 2), (16, True, "Methods", False, True, None), (16, True, "Methods", False, False, 3), (14, True, "Results here", False, False, 4),
        (13.4, True, "Results", False, False, 5), (12, True, "Introduction", False, False, 4), (12, True, "Note:", False, False, None), (12, False, "plain text", False, False, None), (12, False, "SECTION TWO", True, False, 4),
        (12, True, "CFM", False, False, None), (30, True, "x", False, False, None), (30, True, "w " * 16, False, False, None), (16, True, "lower case start", False, False, None),
    ],
)
def test_heading_levels(spark, size, bold, text, centred, toc, level):
    c = pdf.heading_level(F.lit(float(size)), F.lit(bold), F.lit(12.0), F.lit(text), F.lit(centred), F.lit(toc))
    assert spark.range(1).select(c.alias("x")).first().x == level


def test_reading_order(spark, pages):
    b = spark.createDataFrame([(1, 1, i, 72.0 if i % 2 else 320.0) for i in range(8)] + [(1, 2, i, 72.0 if i < 4 else 320.0) for i in range(8)], "doc_id int, page int, idx int, x double")
    assert {r.page: r.flagged for r in pdf.column_order(b, pages).collect()} == {1: True, 2: False}


def test_a_folder_is_compiled(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nbody\n\nbody\n")
    d = sources.documents(spark, str(tmp_path)).withColumnRenamed("path", "doc_id")
    r = compiled(d).first()
    assert (r.file_type, r.readiness_score, r.duplicate_blocks_removed, r.quality_band) == ("md", 95, 1, "HIGH")
    assert [x.content for x in chunks.chunked(d).collect()] == ["# T\n\nbody\n\nbody"]
