"""Signals of how well a table was extracted, and the findings that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.binding import let

GENERIC = r"^(?i)(?:col(?:umn)?[_\s]*[0-9]+|field[_\s]*[0-9]+|header[_\s]*[0-9]+|f[0-9]+)$"
NUMERIC = r"^[-+]?[0-9][0-9,.%\s]*$"
PUNCTUATION = r"^[^\p{L}\p{N}_\s]+$"


def _count(a: Column, test) -> Column:
    return F.size(F.filter(a, test))


def _share(a: Column, test) -> Column:
    return F.when(F.size(a) > 0, _count(a, test) / F.size(a)).otherwise(0.0)


def _median(a: Column) -> Column:
    n = F.size(a)
    return let(F.array_sort(a), lambda s: F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2).otherwise(0.0))


def signals(tables: DataFrame) -> DataFrame:
    """(table_id, name, value, status) in long form of (table_id, header_rows, grid), optionally with page_height,
    page_width and box (x0, y0, x1, y1): one expression per table, exploded once. value is text; status ok, risk, unknown.

    A null cell is missing. Empty tables have only the counts that are zero.
    """
    g, h = F.col("grid"), F.col("header_rows")
    t = tables.withColumn("_w", F.coalesce(F.array_max(F.transform(g, F.size)), F.lit(0))).withColumn("_all", F.flatten(g))
    t = t.withColumn("_c", F.filter("_all", lambda c: c.isNotNull())).withColumn("_f", F.filter(F.transform("_c", text.strip), lambda c: c != ""))
    t = t.withColumn("_n", F.transform("_f", F.length)).withColumn("_hc", F.filter(F.flatten(F.slice(g, F.lit(1), h)), lambda c: c.isNotNull()))
    t = t.withColumn("_hf", F.filter(F.transform("_hc", text.strip), lambda c: c != "")).withColumn("_body", F.slice(g, h + 1, F.greatest(F.size(g) - h, F.lit(0))))
    f, n, hc, hf, body, w = (F.col(x) for x in ("_f", "_n", "_hc", "_hf", "_body", "_w"))
    rows, total = F.size(g), F.size(g) * w
    full = lambda r: F.filter(r, lambda c: c.isNotNull())
    blank = lambda r: F.size(F.filter(r, lambda c: c.isNotNull() & (text.strip(c) != ""))) == 0
    missing = total - F.size("_c")
    nonempty = F.when(F.size("_c") > 0, F.size(f) / F.size("_c")).otherwise(0.0)
    empty_rows, ragged = _count(g, blank), _count(g, lambda r: F.size(full(r)) < w)
    flat = F.transform(body, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(text.strip(c), F.lit(""))), "\x1f"))
    columns = F.sequence(F.lit(0), F.greatest(w - 1, F.lit(0)))
    empty_columns = F.when(w > 0, _count(columns, lambda i: blank(F.transform(g, lambda r: F.get(r, i))))).otherwise(0)
    coverage = F.when(h * w > 0, F.size(hc) / (h * w)).otherwise(0.0)
    widest = lambda rs: F.coalesce(F.array_max(F.transform(rs, lambda r: F.size(full(r)))), F.lit(0))
    hw, bw = widest(F.slice(g, F.lit(1), h)), widest(body)
    mismatch = (F.size(body) > 0) & (hw != bw) & (hw > 0) & (bw > 0)
    names = F.array_sort(F.array_distinct(hf))
    again = F.when(F.size(hf) > 0, _count(body, lambda r: F.array_sort(F.array_distinct(F.filter(F.transform(full(r), text.strip), lambda c: c != ""))) == names)).otherwise(0)
    generic, twice = _count(hf, lambda c: c.rlike(GENERIC)), F.size(hf) - F.size(F.array_distinct(hf))
    single, punct = _share(n, lambda x: x == 1), _share(f, lambda c: c.rlike(PUNCTUATION))
    spaces = _count(F.col("_c"), lambda c: (c != "") & (text.strip(c) == ""))

    def s(name: str, value: Column, risk: Column | bool = False, unknown: bool = False) -> Column:
        status = F.lit("unknown") if unknown else F.when(risk if isinstance(risk, Column) else F.lit(risk), "risk").otherwise("ok")
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), status.alias("status"))

    real = lambda c, d=3: F.bround(c.cast("double"), d)
    out = [
        s("explicit_cell_count", F.size("_c")), s("expected_grid_size", total), s("explicit_empty_cell_count", F.size("_c") - F.size(f)),
        s("missing_coordinate_count", missing, missing > 0), s("span_covered_coordinate_count", F.lit(0)), s("nonempty_cell_ratio", real(nonempty), (nonempty < 0.3) & (F.size("_c") > 0)),
        s("empty_row_count", empty_rows, empty_rows > F.greatest(F.lit(1), F.floor(rows / 2))), s("empty_column_count", empty_columns), s("ragged_row_count", ragged, ragged > 0),
        s("duplicate_row_count", F.size(flat) - F.size(F.array_distinct(flat))),
        s("avg_nonempty_cell_length", real(F.when(F.size(n) > 0, F.aggregate(n, F.lit(0), lambda a, x: a + x) / F.size(n)).otherwise(0.0), 1)), s("median_cell_length", real(_median(n), 1)),
        s("single_char_cell_fraction", real(single), single > 0.5), s("punctuation_only_cell_fraction", real(punct), punct > 0.3), s("numeric_only_cell_fraction", real(_share(f, lambda c: c.rlike(NUMERIC)))),
        s("short_cell_fraction", real(_share(n, lambda x: x <= 3))), s("whitespace_only_cell_count", spaces, spaces > 0),
        s("header_row_count", h), s("header_cell_coverage", real(coverage), (h > 0) & (coverage < 0.8)), s("generic_header_count", generic, generic > 0), s("duplicate_header_names", twice, twice > 0),
        s("empty_header_cells", F.size(hc) - F.size(hf)), s("numeric_only_headers", _count(hf, lambda c: c.rlike(NUMERIC))), s("header_body_width_mismatch", mismatch, mismatch),
        s("repeated_header_in_body", again, again > 0), s("table_one_row", rows == 1, rows == 1), s("table_one_column", w == 1, w == 1),
    ]
    if "box" in tables.columns:
        box, high, wide = F.col("box"), F.col("page_height"), F.col("page_width")
        top, bottom = box["y0"] < high * 0.10, box["y1"] > high * 0.90
        out += [
            s("table_bbox_available", box.isNotNull()), s("table_near_top_margin", top, F.coalesce(top, F.lit(False))), s("table_near_bottom_margin", bottom, F.coalesce(bottom, F.lit(False))),
            s("table_height_fraction", real((box["y1"] - box["y0"]) / high)), s("table_width_fraction", real((box["x1"] - box["x0"]) / wide)),
        ]
    else:
        out.append(s("table_bbox_available", F.lit(False), unknown=True))
    return t.select("table_id", F.inline(F.array(*out)))


def overall(of: DataFrame) -> DataFrame:
    """(table_id, status): candidate_risk if any signal is a risk, unknown if any is unknown, else ok."""
    return of.groupBy("table_id").agg(F.when(F.bool_or(F.col("status") == "risk"), "candidate_risk").when(F.bool_or(F.col("status") == "unknown"), "unknown").otherwise("ok").alias("status"))


def findings(of: DataFrame) -> DataFrame:
    """(table_id, structure_incomplete, cell_fragmentation, header_uncertain, page_furniture) of signals in long form."""
    v = lambda name: F.max(F.when(F.col("name") == name, F.col("value").cast("double")))
    b = lambda name: F.coalesce(F.bool_or((F.col("name") == name) & (F.col("value") == "true")), F.lit(False))
    return of.groupBy("table_id").agg(
        ((v("missing_coordinate_count") > 0) | (v("ragged_row_count") > 0)).alias("structure_incomplete"),
        (((v("single_char_cell_fraction") > 0.5) & (v("numeric_only_cell_fraction") <= 0.7)) | (v("punctuation_only_cell_fraction") > 0.3)).alias("cell_fragmentation"),
        ((v("generic_header_count") > 0) | (v("duplicate_header_names") > 0) | b("header_body_width_mismatch") | (v("repeated_header_in_body") > 0)).alias("header_uncertain"),
        ((b("table_near_top_margin") | b("table_near_bottom_margin")) & (b("table_one_row") | b("table_one_column"))).alias("page_furniture"),
    )
