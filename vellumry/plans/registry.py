"""All queries of the engine and the SQL that checks them, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpora, documents, layout, made_files, pages, payloads, steps

_modules = (documents, corpora, pages, made_files, layout, steps, payloads)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _modules for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _modules for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = "manifest"
