"""Tables in payloads: five ways to write one, and which is chosen for a mode and a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.binding import let
from . import tables

#: A whole table may have so many times the tokens of the block it stands for (and so many where fidelity comes first).
GUARD, FIDELITY_GUARD = 1.05, 3.0
MAX_INLINE = 1200


def candidates(grid: Column, header_rows: Column, table_id: Column, path: Column, title: Column, preview_rows: int = tables.PREVIEW_ROWS, references: bool = True) -> Column:
    """Array of (format, content, tokens, whole, omitted): markdown, TSV, row records (where there is a header for them) and,
    with ``references``, a preview and a bare reference. whole: every row is there; omitted: rows that are not."""
    rows = F.greatest(F.lit(0), F.size(grid) - F.coalesce(header_rows, F.lit(0)))
    left = F.greatest(F.lit(0), rows - preview_rows)
    made = [("markdown", tables.markdown(grid), F.lit(0)), ("tsv", tables.tsv(grid), F.lit(0)), ("row_records", tables.row_records(grid, header_rows), F.lit(0))]
    if references:
        made += [("preview_reference", tables.preview(grid, header_rows, title, path, preview_rows), left), ("json_reference", tables.reference(table_id, grid, header_rows, path), rows)]
    one = lambda name, content, omitted: let(content, lambda c: F.struct(
        F.lit(name).alias("format"), c.alias("content"), text.count_tokens(c).cast("int").alias("tokens"),
        (F.lit(name != "json_reference") & (omitted == 0)).alias("whole"), omitted.cast("int").alias("omitted"),
    ))
    return F.filter(F.array(*[one(*m) for m in made]), lambda c: c["content"].isNotNull() & ((c["content"] != "") | (c["format"] != "row_records")))


def chosen(options: Column, mode: str, block_tokens: Column, strategy: str = "auto", max_inline: int = MAX_INLINE) -> Column:
    """The candidate for a mode (text_first, adaptive or fidelity_first).

    By itself: the whole one of fewest tokens that passes the guard and, unless fidelity comes first, the budget; else the
    preview, else the reference. Strategies full_inline, preview_reference and reference_only ask for theirs.
    """
    of = lambda name: F.get(F.filter(options, lambda c: c["format"] == name), 0)
    last = F.coalesce(of("json_reference"), F.element_at(options, -1))
    if strategy == "reference_only":
        return last
    short = F.coalesce(of("preview_reference"), last)
    if strategy == "preview_reference":
        return short
    whole = F.array_sort(F.filter(options, lambda c: c["whole"]), lambda a, b: F.when(a["tokens"] < b["tokens"], -1).when(a["tokens"] > b["tokens"], 1).otherwise(0))
    if strategy == "full_inline":
        return F.coalesce(F.get(whole, 0), last)
    factor = FIDELITY_GUARD if mode == "fidelity_first" else GUARD
    fits = lambda c: (block_tokens <= 0) | (c["tokens"] <= block_tokens * factor)
    good = F.filter(whole, fits if mode == "fidelity_first" else lambda c: fits(c) & (c["tokens"] <= max_inline))
    return F.coalesce(F.get(good, 0), short)


PRESERVED = ("markdown", "structured_table", "image", "image_and_text", "reference_only", "key_value_group")


def fidelity(elements: DataFrame, issues: DataFrame) -> DataFrame:
    """One row a document: what of its elements a package keeps, and what it may lack.

    elements: (doc_id, element_id, source_kind, type, representation, omit_reason, page, confidence, by_default,
    has_visual); issues: (doc_id, code). An element of a page or region that stands for a table no one extracted is
    unresolved unless a picture of it is kept; pages and ids of these are listed in order.
    """
    rep, omit = F.col("representation"), F.col("representation") == "omit"
    place = F.col("source_kind").isin("page", "page_region")
    missed = place & (F.col("type") == "table") & ~F.col("has_visual")
    table = rep == "structured_table"
    e = elements.groupBy("doc_id").agg(
        F.count_if(~(omit & F.coalesce(F.col("omit_reason") == "structural_marker", F.lit(False)))).alias("meaningful"), F.count_if(rep.isin(*PRESERVED)).alias("preserved"),
        F.count_if(F.col("by_default") & ~rep.isin("omit", "reference_only")).alias("in_default"), F.count_if(rep == "reference_only").alias("reference_only"), F.count_if(omit).alias("omitted"),
        F.count_if(table).alias("structured_tables"), F.count_if(table & F.col("has_visual")).alias("tables_with_visual"), F.count_if(rep.isin("image", "image_and_text") & (F.col("source_kind") == "block")).alias("images"),
        F.count_if(place).alias("regions"), F.count_if(F.col("confidence") == "ambiguous").alias("uncertain"), F.count_if(missed).alias("unresolved"),
        F.array_sort(F.collect_set(F.when(missed, F.col("page")))).alias("unresolved_pages"), F.array_sort(F.collect_set(F.when(missed, F.col("element_id")))).alias("unresolved_ids"),
    )
    i = issues.filter("code = 'W_TABLE_EXPECTED_NOT_EXTRACTED'").groupBy("doc_id").agg(F.count("*").alias("expected_tables"))
    return e.join(i, "doc_id", "left").na.fill(0, ["expected_tables"])
