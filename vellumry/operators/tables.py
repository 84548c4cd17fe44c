"""Tables: a row holds the whole grid (array of rows, null where a cell is missing), and every renderer is an expression.

The first ``header_rows`` rows of a grid are its header. A table is (table_id, header_rows, grid).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.binding import let

RECORD_COLUMNS, PREVIEW_ROWS = 12, 5


def from_rows(rows: DataFrame, key: str | Column, order: list[str], columns: list[str]) -> DataFrame:
    """Tables of the rows that share ``key``, with the column names as header. Nulls become missing cells."""
    key = F.col(key) if isinstance(key, str) else key
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    body = F.transform(F.array_sort(F.collect_list(F.struct(*order, cells.alias("_cells")))), lambda r: r["_cells"])
    head = F.array(F.array(*[F.lit(c) for c in columns]))
    return rows.groupBy(key.alias("table_id")).agg(F.concat(head, body).alias("grid")).select("table_id", F.lit(1).alias("header_rows"), "grid")


def width(grid: Column) -> Column:
    return F.array_max(F.transform(grid, F.size))


def markdown_cell(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, "\r\n|\r|\n", " "), F.lit("|"), F.lit("\\|"))


def plain_cell(c: Column) -> Column:
    return F.regexp_replace(c, "\t|\r\n|\r|\n", " ")


def markdown_row(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.coalesce(markdown_cell(c), F.lit(" "))), " | "), F.lit(" |"))


def separator(columns: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), columns), " | "), F.lit(" |"))


def markdown(grid: Column) -> Column:
    """A pipe table; the separator always follows the first row."""
    lines = F.transform(grid, markdown_row)
    all_lines = F.concat(F.slice(lines, 1, 1), F.array(separator(width(grid))), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when(F.size(grid) > 0, F.array_join(all_lines, "\n")).otherwise("")


def row_range(grid: Column, header_rows: Column, start: Column, end: Column) -> Column:
    """Rows start..end as a pipe table; ranges below the header get the header on top."""
    h = F.greatest(header_rows, F.lit(1))
    lines = F.transform(grid, markdown_row)
    end = F.least(end, F.size(grid) - 1)
    rule = F.array(separator(width(grid)))
    body = F.concat(F.slice(lines, F.lit(1), h), rule, F.slice(lines, start + 1, F.greatest(end - start + 1, F.lit(0))))
    # a range that begins inside the header keeps its rows, with the rule after the header's last row
    inner = F.concat(F.slice(lines, start + 1, F.least(h - start, end - start + 1)), F.when(end >= h - 1, rule).otherwise(F.array().cast("array<string>")), F.slice(lines, h + 1, F.greatest(end - h + 1, F.lit(0))))
    return F.when((F.size(grid) > 0) & (start <= end), F.array_join(F.when(start >= h, body).otherwise(inner), "\n")).otherwise("")


def tsv(grid: Column) -> Column:
    return F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(plain_cell(c), F.lit(" "))), "\t")), "\n")


def column_names(grid: Column, header_rows: Column) -> Column:
    """Names from the header's last row; a name that occurs several times is numbered from 1."""
    raw = F.transform(F.get(grid, header_rows - 1), lambda c: F.coalesce(text.strip(plain_cell(c)), F.lit("")))
    return let(raw, lambda raw: F.transform(raw, lambda x, i: F.when(F.size(F.filter(raw, lambda y: y == x)) == 1, x).otherwise(
        F.concat(x, F.lit("_"), F.size(F.filter(F.slice(raw, F.lit(1), i + 1), lambda y: y == x)).cast("string"))
    )))


def row_records(grid: Column, header_rows: Column) -> Column:
    """`name=value; ...` for each row below the header; empty without a header or beyond RECORD_COLUMNS columns."""
    body = F.slice(grid, header_rows + 1, F.greatest(F.size(grid) - header_rows, F.lit(0)))
    value = let(column_names(grid, header_rows), lambda names: F.transform(body, lambda r: F.array_join(F.transform(r, lambda c, i: F.concat(
        F.get(names, i), F.lit("="), F.coalesce(F.nullif(plain_cell(c), F.lit(" ")), F.lit(""))
    )), "; ")))
    return F.when((header_rows > 0) & (width(grid) <= RECORD_COLUMNS), F.array_join(value, "\n")).otherwise("")


def preview(grid: Column, header_rows: Column, title: Column, path: Column, rows: int = PREVIEW_ROWS) -> Column:
    """Title, size, column names and the first rows, with a reference to the whole table when rows are left out."""
    names = F.transform(F.get(grid, F.lit(0)), lambda c, i: F.concat(F.lit("Col"), (i + 1).cast("string")))
    named = F.transform(F.get(grid, header_rows - 1), lambda c, i: F.coalesce(F.nullif(text.strip(plain_cell(c)), F.lit("")), F.concat(F.lit("Col"), (i + 1).cast("string"))))
    n = F.greatest(F.size(grid) - header_rows, F.lit(0))
    head = F.array(
        F.concat(F.lit("Table: "), F.coalesce(title, F.lit("Untitled"))), F.concat(F.lit("Rows: "), n.cast("string")),
        F.concat(F.lit("Columns: "), F.array_join(F.when(header_rows > 0, named).otherwise(names), ", ")), F.lit(""),
    )
    shown = F.transform(F.slice(grid, header_rows + 1, F.least(n, F.lit(rows))), lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(plain_cell(c), F.lit(" "))), "\t"))
    rest = F.concat(F.lit("["), (n - rows).cast("string"), F.lit(" additional rows omitted. Full structured table: "), F.coalesce(path, F.lit("unavailable")), F.lit("]"))
    return F.array_join(F.concat(head, shown, F.when(n > rows, F.array(F.lit(""), rest)).otherwise(F.array().cast("array<string>"))), "\n")


def reference(table_id: Column, grid: Column, header_rows: Column, path: Column) -> Column:
    n = F.greatest(F.size(grid) - header_rows, F.lit(0))
    return F.concat(
        F.lit("[Table "), table_id.cast("string"), F.lit(": "), n.cast("string"), F.lit(" rows x "), width(grid).cast("string"),
        F.lit(" columns. Full data: "), F.coalesce(path, F.lit("unavailable")), F.lit("]"),
    )


def ranges(grid: Column, header_rows: Column, max_tokens: int) -> Column:
    """Array of (row_start, row_end, oversize, estimated_tokens): rows in groups that fit the budget with the header.

    The first group begins at the header. A row that doesn't fit by itself is a group, marked oversize.
    """
    h = F.greatest(header_rows, F.lit(1))
    return let(text.count_tokens(row_range(grid, header_rows, F.lit(0), h - 1)), lambda head: _ranges(grid, header_rows, max_tokens, head))


def _ranges(grid: Column, header_rows: Column, max_tokens: int, head: Column) -> Column:
    h = F.greatest(header_rows, F.lit(1))
    cost = F.transform(F.slice(grid, h + 1, F.greatest(F.size(grid) - h, F.lit(0))), lambda r: F.greatest(F.lit(1), text.count_tokens(markdown_row(r))))
    kind = "array<struct<row_start:int,row_end:int,oversize:boolean,estimated_tokens:int>>"

    def state(start: Column, n: Column, acc: Column, row: Column, done: Column) -> Column:
        return F.struct(start.alias("start"), n.alias("n"), acc.alias("acc"), row.alias("row"), done.alias("done"))

    def flushed(s: Column) -> Column:
        over = (s["n"] == 1) & (head + s["acc"] > max_tokens)
        got = F.struct(s["start"].alias("row_start"), (s["row"] - 1).alias("row_end"), over.alias("oversize"), F.when(over, head + s["acc"]).otherwise(0).alias("estimated_tokens"))
        return F.array_append(s["done"], got)

    def step(s: Column, c: Column) -> Column:
        more = (s["n"] == 0) | (head + s["acc"] + c <= max_tokens)
        return F.when(more, state(s["start"], s["n"] + 1, s["acc"] + c, s["row"] + 1, s["done"])).otherwise(state(s["row"], F.lit(1), c, s["row"] + 1, flushed(s)))

    split = F.aggregate(cost, state(F.lit(0), F.lit(0), F.lit(0), h, F.array().cast(kind)), step, flushed)
    whole = F.array(F.struct(F.lit(0).alias("row_start"), (F.size(grid) - 1).alias("row_end"), F.lit(False).alias("oversize"), F.lit(0).alias("estimated_tokens")))
    fits = (F.size(grid) <= h) | (text.count_tokens(row_range(grid, header_rows, F.lit(0), F.size(grid) - 1)) <= max_tokens)
    return F.when(fits, whole.cast(kind)).otherwise(split)
