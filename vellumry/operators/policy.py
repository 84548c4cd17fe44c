"""Decisions by rule: which reader a scan gets, how a block is represented in a payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCR_PAGES, OCR_SHARE = 3, 0.30
STRUCTURAL = ("metadata", "page_break")
#: Ways of extraction that yield cells, not drawn text.
STRUCTURED_METHODS = (
    "csv.native", "docx.native", "html.native", "odf.native", "pdf.booktabs", "pdf.ruled", "pdf.stitched", "pdf.whitespace", "pptx.native",
    "tsv.native", "xls.native", "xlsx.native",
)


def ocr_choice(pages: Column, image_pages: Column, runnable: Column) -> Column:
    """struct(backend, reason): the vision reader for 3 pages or more, 30 % of them images, if it can run."""
    share = image_pages / F.greatest(pages, F.lit(1))
    reason = (
        F.when(image_pages == 0, "no_image_pages").when(pages < OCR_PAGES, "too_few_pages").when(share < OCR_SHARE, "too_few_image_pages")
        .when(~F.coalesce(runnable, F.lit(False)), "backend_unavailable").otherwise("selected")
    )
    return F.struct(F.when(reason == "selected", "vision").otherwise("tesseract").alias("backend"), reason.alias("reason"))


def route(kind: Column, content: Column, mode: str, method: Column, risky: Column, has_bbox: Column, captioned: Column, width: Column, height: Column, confidence: Column) -> Column:
    """struct(representation, reason, visual_fallback) of a block in a payload, by type, mode and quality.

    mode is text_first, fidelity_first or adaptive. The first rule that holds decides.
    """
    faithful = F.lit(mode in ("adaptive", "fidelity_first"))
    blank = F.trim(F.coalesce(content, F.lit(""))) == ""
    small = (width > 0) & (height > 0) & ((width < 50) | (height < 50))

    def out(rep: str, reason: str, fallback: Column | None = None) -> Column:
        return F.struct(F.lit(rep).alias("representation"), F.lit(reason).alias("reason"), (F.lit(False) if fallback is None else F.coalesce(fallback, F.lit(False))).alias("visual_fallback"))

    table = (
        F.when(~F.coalesce(method.isin(*STRUCTURED_METHODS), F.lit(False)), out("markdown", "TABLE_LEGACY_MARKDOWN"))
        .when(F.coalesce(risky, F.lit(False)) & faithful, out("structured_table", "TABLE_STRUCTURED_RISKY", has_bbox))
        .otherwise(out("structured_table", "TABLE_STRUCTURED_RELIABLE"))
    )
    seen = F.coalesce(captioned, F.lit(False))
    image = (
        F.when(~faithful & seen, out("reference_only", "IMAGE_CAPTIONED")).when(~faithful, out("reference_only", "IMAGE_EXCLUDED_TEXT_FIRST"))
        .when(F.coalesce(small, F.lit(False)), out("reference_only", "IMAGE_DECORATIVE")).when(seen, out("image", "IMAGE_CAPTIONED")).otherwise(out("image", "IMAGE_UNCLASSIFIED"))
    )
    return (
        F.when(kind.isin(*STRUCTURAL), out("omit", "STRUCTURAL_MARKER"))
        .when(blank & ~kind.isin("image", "key_value_group", "math", "table"), out("omit", "EMPTY_ELEMENT"))
        .when(kind == "table", table).when(kind == "image", image)
        .when(kind == "math", F.when(~blank, out("markdown", "FORMULA_STRUCTURED")).otherwise(out("markdown", "FORMULA_VISUAL_UNAVAILABLE")))
        .when(kind == "key_value_group", out("key_value_group", "KEY_VALUE_GROUP_STRUCTURED"))
        .when(F.coalesce(confidence == "ambiguous", F.lit(False)), out("image_and_text" if mode in ("adaptive", "fidelity_first") else "markdown", "TEXT_OCR_UNCERTAIN"))
        .otherwise(out("markdown", "TEXT_RELIABLE"))
    )
