"""Queries on tables in payloads, and on paragraphs that are groups of fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunks, key_values, payload, tables
from .corpora import ORACLE_SQL as _TABLES
from .documents import _tokens
from .tables import grids, read


def table_payload(spark, sf_dir):
    """How the orders of each customer are written in a payload, by mode, for a block that has the tokens of every second row."""
    g = grids(spark, sf_dir)
    title, path = F.concat(F.lit("Customer "), F.col("table_id").cast("string")), F.lit(None).cast("string")
    c = payload.candidates(F.col("grid"), F.col("header_rows"), F.col("table_id"), path, title)
    block = text.count_tokens(tables.tsv(F.filter("grid", lambda r, i: i % 2 == 0)))
    g = g.select("table_id", c.alias("c"), block.alias("block"))
    modes = [F.struct(F.lit(m).alias("mode"), payload.chosen(F.col("c"), m, F.col("block"), max_inline=60).alias("got")) for m in ("adaptive", "fidelity_first")]
    modes.append(F.struct(F.lit("full_inline").alias("mode"), payload.chosen(F.col("c"), "adaptive", F.col("block"), "full_inline").alias("got")))
    return g.select("table_id", F.explode_outer(F.array(*modes)).alias("m")).select("table_id", "m.mode", "m.got.format", "m.got.tokens", "m.got.omitted")


#: Paragraphs by customer: two addresses, a dialogue, two fields without evidence, one line, too long a text.
_PARAGRAPHS = (
    "concat('Email: a', c_custkey, '@x.org\\nnot a field\\nReply: b@x.org')", "concat('Ann: Hello there.\\nBob: Fine ', c_custkey, '.')", "concat('Colour: blue-ish\\nShape: round ', c_custkey)",
    "concat('Email: a', c_custkey, '@x.org')", "concat('Email: a@x.org\\nReply: b@x.org\\n', repeat('long ', 150))",
)


def _paragraphs(spark, sf_dir):
    content = " ".join(["CASE c_custkey % 5", *[f"WHEN {i} THEN {p}" for i, p in enumerate(_PARAGRAPHS)], "END AS content"])
    return read(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "0 AS idx", "CASE WHEN c_custkey % 50 = 0 THEN 'code_block' ELSE 'paragraph' END AS type", content)


def kv_promoted(spark, sf_dir):
    """Paragraphs of the customers after promotion, without the long ones, which stay."""
    return key_values.promoted(_paragraphs(spark, sf_dir), ["doc_id", "idx"]).filter("doc_id % 5 < 4").select("doc_id", "type", "content")


def kv_possible(spark, sf_dir):
    return key_values.possible(_paragraphs(spark, sf_dir), ["doc_id", "idx"]).select("doc_id", "entries", "reason")


_ELEMENT = {
    "doc_id": "user_id", "element_id": "event_id", "source_kind": "CASE event_id % 10 WHEN 0 THEN 'page' WHEN 1 THEN 'page_region' ELSE 'block' END", "type": "CASE WHEN event_type = 'error' THEN 'table' ELSE 'paragraph' END",
    "representation": "CASE event_type WHEN 'click' THEN 'markdown' WHEN 'view' THEN 'omit' WHEN 'purchase' THEN 'image' WHEN 'error' THEN 'structured_table' ELSE 'reference_only' END",
    "omit_reason": "CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'structural_marker' WHEN event_type = 'view' THEN 'decorative' END", "page": "CAST(event_id % 6 AS INT)",
    "confidence": "CASE event_id % 4 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'inferred' ELSE 'extracted' END", "by_default": "event_id % 5 > 0", "has_visual": "event_id % 7 = 0",
}


def package_fidelity(spark, sf_dir):
    """Events of a user as elements of a package."""
    e = read(spark, sf_dir, "events")
    issues = e.filter("event_id % 9 = 0").selectExpr("user_id AS doc_id", "CASE WHEN event_id % 2 = 0 THEN 'W_TABLE_EXPECTED_NOT_EXTRACTED' ELSE 'OTHER' END AS code")
    f = payload.fidelity(e.selectExpr(*[f"{v} AS {k}" for k, v in _ELEMENT.items()]), issues)
    return f.withColumns({c: F.array_join(c, ",") for c in ("unresolved_pages", "unresolved_ids")})


def chunk_confidence(spark, sf_dir):
    """Events of a user and page as blocks of a chunk."""
    b = read(spark, sf_dir, "events").selectExpr("user_id AS doc_id", "CAST(event_id % 6 AS INT) AS chunk", "event_id AS block_id", f"{_ELEMENT['confidence']} AS confidence")
    return chunks.confidence_summary(b, ["doc_id", "chunk"]).withColumns({f"{k}_ids": F.array_join(f"{k}_ids", ",") for k in chunks.CONFIDENCES})


QUERIES = {f.__name__: f for f in (table_payload, kv_promoted, kv_possible, package_fidelity, chunk_confidence)}

_ROW = "array_to_string([CAST(o_orderkey AS VARCHAR), o_orderstatus, printf('%.2f', o_totalprice), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority], chr(9))"
_HEAD = "array_to_string(['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'], chr(9))"
ORACLE_SQL = {
    "table_payload": f"""WITH md AS ({_TABLES["table_markdown"]}), ts AS ({_TABLES["table_tsv"]}), rr AS ({_TABLES["table_row_records"]}), pv AS ({_TABLES["table_preview"]}),
 q AS (SELECT o_custkey AS table_id, {_ROW} AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
 h AS (SELECT table_id, count(*) AS n, {_HEAD} || coalesce(chr(10) || string_agg(x, chr(10) ORDER BY r) FILTER (r % 2 = 0), '') AS t FROM q GROUP BY table_id), b AS (SELECT table_id, n, {_tokens("t")} AS block FROM h),
 c AS (SELECT table_id, 1 AS o, 'markdown' AS f, content AS t FROM md UNION ALL SELECT table_id, 2, 'tsv', content FROM ts UNION ALL SELECT table_id, 3, 'row_records', content FROM rr UNION ALL SELECT table_id, 4, 'preview_reference', content FROM pv
 UNION ALL SELECT table_id, 5, 'json_reference', replace(reference, ', t.json', '') FROM pv),
 k AS (SELECT c.table_id, o, f, {_tokens("t")} AS k, block, CASE f WHEN 'json_reference' THEN n WHEN 'preview_reference' THEN greatest(0, n - 5) ELSE 0 END AS om FROM c JOIN b USING (table_id)),
 e AS (SELECT *, f <> 'json_reference' AND om = 0 AND CASE mode WHEN 'adaptive' THEN k <= block * 1.05 AND k <= 60 WHEN 'fidelity_first' THEN k <= block * 3 ELSE true END AS ok FROM k, (VALUES ('adaptive'), ('fidelity_first'), ('full_inline')) m(mode))
 SELECT table_id, mode, f AS format, CAST(k AS INTEGER) AS tokens, CAST(om AS INTEGER) AS omitted FROM e
 QUALIFY row_number() OVER (PARTITION BY table_id, mode ORDER BY ok DESC, CASE WHEN ok THEN k ELSE 0 END, CASE WHEN ok THEN o WHEN f = 'preview_reference' THEN 0 ELSE 9 END) = 1""",
    "kv_promoted": """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 50 = 0 THEN 'code_block' WHEN c_custkey % 5 = 0 THEN 'key_value_group' ELSE 'paragraph' END AS type,
 CASE c_custkey % 5 WHEN 1 THEN 'Ann: Hello there.' || chr(10) || 'Bob: Fine ' || c_custkey || '.' WHEN 2 THEN 'Colour: blue-ish' || chr(10) || 'Shape: round ' || c_custkey WHEN 3 THEN 'Email: a' || c_custkey || '@x.org'
 ELSE CASE WHEN c_custkey % 50 = 0 THEN 'Email: a' || c_custkey || '@x.org' || chr(10) || 'not a field' || chr(10) || 'Reply: b@x.org' ELSE '- **Email:** a' || c_custkey || '@x.org' || chr(10) || '- **Reply:** b@x.org' END END AS content
 FROM customer WHERE c_custkey % 5 < 4""",
    "kv_possible": "SELECT c_custkey AS doc_id, CAST(2 AS BIGINT) AS entries, CASE c_custkey % 5 WHEN 0 THEN 'heuristic_disabled' ELSE 'insufficient_positive_evidence' END AS reason FROM customer WHERE c_custkey % 5 IN (0, 2) AND c_custkey % 50 > 0",
    "package_fidelity": f"""WITH e AS (SELECT {", ".join(f"{v} AS {k}" for k, v in _ELEMENT.items())} FROM events), m AS (SELECT *, source_kind <> 'block' AND type = 'table' AND NOT has_visual AS missed FROM e),
 i AS (SELECT user_id AS doc_id, count(*) AS n FROM events WHERE event_id % 9 = 0 AND event_id % 2 = 0 GROUP BY ALL)
 SELECT doc_id, count(*) FILTER (representation <> 'omit' OR omit_reason IS DISTINCT FROM 'structural_marker') AS meaningful, count(*) FILTER (representation <> 'omit') AS preserved, count(*) FILTER (by_default AND representation NOT IN ('omit', 'reference_only')) AS in_default,
 count(*) FILTER (representation = 'reference_only') AS reference_only, count(*) FILTER (representation = 'omit') AS omitted, count(*) FILTER (representation = 'structured_table') AS structured_tables, count(*) FILTER (representation = 'structured_table' AND has_visual) AS tables_with_visual,
 count(*) FILTER (representation = 'image' AND source_kind = 'block') AS images, count(*) FILTER (source_kind <> 'block') AS regions, count(*) FILTER (confidence = 'ambiguous') AS uncertain, count(*) FILTER (missed) AS unresolved,
 coalesce(string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) FILTER (missed), '') AS unresolved_pages, coalesce(string_agg(element_id, ',' ORDER BY element_id) FILTER (missed), '') AS unresolved_ids, coalesce(any_value(i.n), 0) AS expected_tables
 FROM m LEFT JOIN i USING (doc_id) GROUP BY doc_id""",
    "chunk_confidence": f"""WITH b AS (SELECT user_id AS doc_id, CAST(event_id % 6 AS INTEGER) AS chunk, event_id AS i, {_ELEMENT["confidence"]} AS c FROM events)
 SELECT doc_id, chunk, {", ".join(f"count(*) FILTER (c = '{k}') AS {k}, coalesce(string_agg(i, ',' ORDER BY i) FILTER (c = '{k}'), '') AS {k}_ids" for k in chunks.CONFIDENCES)} FROM b GROUP BY ALL""",
}
