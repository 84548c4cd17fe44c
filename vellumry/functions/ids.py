"""Identities by hash: the same content has the same identity wherever and whenever it is compiled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfc, unix_lines


def short(c: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def checksum(content: Column) -> Column:
    return short(unix_lines(nfc(content)))


def block_id(kind: Column, page: Column, index: Column, check: Column) -> Column:
    return short(F.concat_ws(":", kind, F.coalesce(page, F.lit(0)).cast("string"), index.cast("string"), check))


def document_id(file_type: Column, pages: Column, blocks: Column) -> Column:
    """blocks: array of structs (index, type, page, checksum)."""
    parts = F.transform(
        F.array_sort(blocks),
        lambda b: F.concat_ws(":", b["type"], F.coalesce(b["page"], F.lit(0)).cast("string"), b["index"].cast("string"), b["checksum"]),
    )
    return short(F.concat(file_type, F.lit(":"), pages.cast("string"), F.lit(":"), F.array_join(parts, ";")))


def chunk_id(document: Column, index: Column, content: Column) -> Column:
    return short(F.concat_ws(":", document, index.cast("string"), short(content)))


def capture_id(data: Column) -> Column:
    return F.sha2(data, 256)


def vector_id(path: Column, n: Column) -> Column:
    return F.concat(F.substring(F.sha2(path, 256), 1, 12), F.lit("_"), n.cast("string"))
