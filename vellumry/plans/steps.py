"""Single steps on rows that are made of the tables, with what each should give in SQL: page furniture, runs of headings,
markdown, issues of PDF files, queue and index upkeep, preferences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, evals, quality, search
from ..streaming import ingest
from .tables import read

_BLOCK = (
    "user_id % 20 AS doc_id", "CAST(event_id % 6 + 1 AS INT) AS page", "CAST(event_id + 1 AS INT) AS idx", "concat(event_type, ' of ', event_id) AS content", "CASE WHEN event_id % 9 = 0 THEN 'heading' ELSE 'paragraph' END AS type",
)


def page_furniture_removed(spark, sf_dir):
    """Events as blocks of six pages, each page between a running head and a foot; odd documents' heads are numbered sections."""
    e = read(spark, sf_dir, "events").selectExpr(*_BLOCK)
    p = e.select("doc_id", "page").distinct()
    head = p.select("doc_id", "page", F.lit(0).alias("idx"), F.when(F.col("doc_id") % 2 == 1, "1.2 Running head").otherwise("Running head").alias("content"), F.lit("heading").alias("type"))
    foot = p.select("doc_id", "page", F.lit(2_000_000_000).alias("idx"), F.lit("Confidential").alias("content"), F.lit("paragraph").alias("type"))
    pages = p.groupBy("doc_id").agg(F.count("*").alias("pages"))
    kept = blocks.without_furniture(e.unionByName(head).unionByName(foot), pages)
    return kept.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.count_if(F.col("idx") == 0).alias("heads"), F.count_if(F.col("content") == "Confidential").alias("feet"))


def headings_merged(spark, sf_dir):
    """Events of a user in order as blocks: clicks and views are headings, of a level by the hour's parity."""
    b = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").cast("int").alias("idx"), F.when(F.col("event_type").isin("click", "view"), "heading").otherwise("paragraph").alias("type"),
        F.concat_ws(" ", "event_type", "event_id").alias("content"), F.when(F.col("event_type").isin("click", "view"), (F.hour("ts") % 2 + 1).cast("int")).alias("level"), F.lit(1).alias("page"),
    )
    return blocks.merged_headings(b).select("doc_id", "idx", "type", "content", "parts")


def blocks_as_markdown(spark, sf_dir):
    """Events as blocks of a kind by type, drawn for export and for a chunk."""
    kinds = F.create_map(*[F.lit(x) for x in ("click", "heading", "error", "code_block", "login", "blockquote", "purchase", "admonition", "view", "page_break")])
    e = read(spark, sf_dir, "events").select("event_id", F.coalesce(kinds[F.col("event_type")], F.lit("image")).alias("k"), F.concat(F.lit("line\n"), F.col("event_id").cast("string")).alias("c"), (F.col("event_id") % 6 + 1).cast("int").alias("l"))
    draw = lambda export: blocks.to_markdown(F.col("k"), F.col("c"), F.col("l"), F.lit("json"), F.lit("tip"), export)
    return e.select("event_id", draw(True).alias("exported"), draw(False).alias("in_chunk"))


def pdf_issues(spark, sf_dir):
    """Issues of PDF files that are made of the customers, two headings and two paragraphs each."""
    c = F.col("c_custkey").cast("int")
    block = lambda kind, content, level, page: F.struct(F.lit(kind).alias("type"), content.alias("content"), level.cast("int").alias("level"), page.cast("int").alias("page"))
    none = F.lit(None)
    b = F.array(
        block("heading", F.lit("H"), c % 4 + 1, F.lit(1)), block("heading", F.lit("S"), c % 4 + 1 + c % 3, F.lit(1)),
        block("paragraph", F.repeat(F.lit("x"), c % 50 * 200), none, F.lit(1)), block("paragraph", F.repeat(F.lit("(cid:7)"), c % 7 * 10), none, F.when(c % 2 == 0, 3).otherwise(2)),
    )
    d = read(spark, sf_dir, "customer", heavy=True).select(c.alias("doc_id"), b.alias("blocks"), F.lit("pdf").alias("file_type"), (c % 3 + 3).alias("pages"), (c * 10).alias("original_tokens"))
    i = quality.issues(d).select("doc_id", F.explode_outer("issues").alias("i")).filter("i is not null")
    return i.groupBy("doc_id", F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


def queue_steps(spark, sf_dir):
    """Orders as files: those of even customers are known, a third with other content; new and changed ones are queued, the
    oldest ten are taken and marked, and the states counted."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("content_hash"), F.col("o_orderkey").alias("added_at"), "o_custkey")
    known = o.filter("o_custkey % 2 = 0").withColumn("content_hash", F.when(F.col("added_at") % 3 == 0, "old").otherwise(F.col("content_hash"))).withColumn("status", F.lit("done")).drop("o_custkey")
    jobs = ingest.enqueued(known, o.drop("o_custkey"))
    taken = ingest.oldest(jobs, 10).select("path", F.when(F.col("added_at") % 2 == 0, "done").otherwise("low_quality").alias("status"))
    return ingest.stats(ingest.marked(jobs, taken))


def index_upsert(spark, sf_dir):
    """An index of line items by order, into which the orders' new items go: those of every third order replace the old."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("part"), F.lit("old").alias("version"))
    new = read(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 0 and l_linenumber = 1").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("part"), F.lit("new").alias("version"))
    return search.upserted(items, new).groupBy("version").agg(F.count("*").alias("n"), F.sum("part").alias("parts"))


def preferences(spark, sf_dir):
    """Line items as pairs of results: the quantity over 25 as score difference, returned and open ones as failures."""
    line = read(spark, sf_dir, "lineitem")
    p = evals.preference(F.col("l_quantity") - 25, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return line.groupBy(p.alias("preferred")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


QUERIES = {f.__name__: f for f in (page_furniture_removed, headings_merged, blocks_as_markdown, pdf_issues, queue_steps, index_upsert, preferences)}

_Q = quality
_CODES = {
    "HEADING_HIERARCHY": f"CAST(c % 4 + 1 > 2 AS INTEGER)",
    "HEADING_SKIP": f"CAST(c % 3 = 2 AS INTEGER)",
    "LARGE_BLOCK": f"CAST(c % 50 * 200 > {_Q.LARGE_BLOCK_CHARS} AS INTEGER)",
    "EMPTY_BLOCK": f"CAST(c % 50 = 0 AS INTEGER) + CAST(c % 7 = 0 AS INTEGER)",
    "MISSING_PAGE": f"pages - 2",
    "NEAR_EMPTY_OUTPUT": f"CAST(pages >= {_Q.LEAST_PAGES} AND chars < pages * {_Q.PAGE_CHARS} AS INTEGER)",
    "LOW_TEXT_DENSITY": f"CAST(chars < pages * {_Q.PAGE_CHARS} AS INTEGER)",
    "GLYPH_ARTIFACTS": f"CAST(c % 7 * 10 >= {_Q.GLYPHS} AND c % 7 * 10 > {_Q.GLYPH_SHARE} * (chars + 3) AS INTEGER)",
    "TOKEN_BLOAT": f"CAST(pages >= {_Q.LEAST_PAGES} AND c * 10 > pages * {_Q.PAGE_TOKENS} AS INTEGER)",
}
ORACLE_SQL = {
    "page_furniture_removed": """WITH e AS (SELECT user_id % 20 AS doc_id, event_id % 6 + 1 AS page, CASE WHEN event_id % 9 = 0 THEN 'heading' ELSE 'paragraph' END AS type FROM events), p AS (SELECT DISTINCT doc_id, page FROM e),
 n AS (SELECT doc_id, count(*) >= 3 AS many FROM p GROUP BY doc_id), a AS (SELECT doc_id, type, 0 AS head, 0 AS foot FROM e UNION ALL SELECT doc_id, 'heading', 1, 0 FROM p JOIN n USING (doc_id) WHERE doc_id % 2 = 1 OR NOT many
 UNION ALL SELECT doc_id, 'paragraph', 0, 1 FROM p JOIN n USING (doc_id) WHERE NOT many) SELECT doc_id, type, count(*) AS n, CAST(sum(head) AS BIGINT) AS heads, CAST(sum(foot) AS BIGINT) AS feet FROM a GROUP BY ALL""",
    "headings_merged": f"""WITH b AS (SELECT user_id AS d, event_id AS i, event_type IN ('click', 'view') AS h, event_type || ' ' || event_id AS c, CASE WHEN event_type IN ('click', 'view') THEN hour(ts) % 2 + 1 END AS l FROM events),
 s AS (SELECT *, CAST(NOT coalesce(h AND lag(h) OVER w AND l = lag(l) OVER w, false) AS INTEGER) AS new FROM b WINDOW w AS (PARTITION BY d ORDER BY i)), r AS (SELECT *, sum(new) OVER (PARTITION BY d ORDER BY i) AS r FROM s),
 g AS (SELECT d, r, count(*) > 1 AND max(length(c)) < {blocks.SHORT} AND sum(length(c)) + count(*) - 1 < {blocks.HEADING_RUN} AS one FROM r GROUP BY d, r)
 SELECT d AS doc_id, CAST(min(i) AS INTEGER) AS idx, CASE WHEN any_value(h) THEN 'heading' ELSE 'paragraph' END AS type, string_agg(c, ' ' ORDER BY i) AS content, CAST(count(*) AS INTEGER) AS parts FROM r JOIN g USING (d, r) GROUP BY d, r, CASE WHEN one THEN 0 ELSE i + 1 END""",
    "blocks_as_markdown": """WITH e AS (SELECT event_id, event_type AS t, 'line' || chr(10) || event_id AS c, event_id % 6 + 1 AS l FROM events),
 d AS (SELECT event_id, t, c, CASE t WHEN 'click' THEN repeat('#', CAST(l AS INTEGER)) || ' ' || c WHEN 'error' THEN '```json' || chr(10) || c || chr(10) || '```' WHEN 'purchase' THEN '> **TIP**: ' || c WHEN 'login' THEN NULL WHEN 'view' THEN NULL ELSE '![' || c || ']' END AS plain FROM e)
 SELECT event_id, coalesce(plain, CASE t WHEN 'login' THEN '> ' || replace(c, chr(10), chr(10) || '> ') ELSE '---' END) AS exported, coalesce(plain, CASE t WHEN 'login' THEN '> ' || c ELSE '' END) AS in_chunk FROM d""",
    "pdf_issues": f"""WITH d AS (SELECT CAST(c_custkey AS INTEGER) AS c, CAST(c_custkey % 3 + 3 AS INTEGER) AS pages, 2 + c_custkey % 50 * 200 + c_custkey % 7 * 70 AS chars FROM customer),
 i AS ({" UNION ALL ".join(f"SELECT c, '{k}' AS code, {v} AS n FROM d" for k, v in _CODES.items())})
 SELECT c AS doc_id, code, CAST(n AS BIGINT) AS n FROM i WHERE n > 0""",
    "queue_steps": """WITH j AS (SELECT o_orderkey AS k, o_custkey % 2 = 0 AND (o_orderkey % 3 > 0 OR o_orderstatus = 'old') AS done FROM orders), t AS (SELECT k FROM j WHERE NOT done ORDER BY k, CAST(k AS VARCHAR) LIMIT 10)
 SELECT CASE WHEN k IN (SELECT k FROM t) THEN CASE WHEN k % 2 = 0 THEN 'done' ELSE 'low_quality' END WHEN done THEN 'done' ELSE 'pending' END AS status, count(*) AS n FROM j GROUP BY ALL""",
    "index_upsert": """WITH f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber = 1), a AS (SELECT 'old' AS version, l_partkey AS p FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM f)
 UNION ALL SELECT 'new', l_partkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber = 1) SELECT version, count(*) AS n, CAST(sum(p) AS BIGINT) AS parts FROM a GROUP BY version""",
    "preferences": """SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'neither' WHEN l_returnflag = 'R' THEN 'b' WHEN l_linestatus = 'O' THEN 'a' WHEN l_quantity - 25 >= 5 THEN 'b' WHEN l_quantity - 25 <= -5 THEN 'a' ELSE 'tie' END AS preferred,
 count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY ALL""",
}
