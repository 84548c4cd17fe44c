"""Queries on whole corpora: duplicates, packing, ledger, search, measures, requests in time, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, evals, search, tables
from .documents import _WS, _tokens
from .tables import grids, read


def shingles(spark, sf_dir):
    return corpus.shingle_counts(read(spark, sf_dir, "documents"))


def minhash_signature(spark, sf_dir):
    return corpus.signatures(read(spark, sf_dir, "documents")).select("doc_id", F.array_join("sig", ",").alias("signature"))


def near_duplicates_05(spark, sf_dir):
    return corpus.duplicates(read(spark, sf_dir, "documents"), 0.5)


def near_duplicates_08(spark, sf_dir):
    return corpus.duplicates(read(spark, sf_dir, "documents"), 0.8)


def corpus_status(spark, sf_dir):
    """Documents as files (language as extension, English and German supported) by what becomes of them."""
    d = read(spark, sf_dir, "documents")
    dup = corpus.duplicates(d, 0.5).select("doc_id", F.lit(True).alias("is_duplicate"))
    files = d.join(dup, "doc_id", "left").select("doc_id", F.col("lang").alias("extension"), F.when(F.contains("text", F.lit("|")), "table").alias("error"), "text", "is_duplicate")
    return corpus.status(files, ["de", "en"]).groupBy("category").agg(F.count("*").alias("n"))


def _sizes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("source", "doc_id", text.count_tokens(F.col("text")).cast("long").alias("tokens"))


def token_packing(spark, sf_dir):
    return corpus.packs(_sizes(spark, sf_dir), "source", "doc_id", 5000)


def _ledger(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    return d.select(
        "doc_id", F.col("lang").alias("file_type"), text.count_tokens(F.col("text")).alias("original_tokens"),
        text.count_tokens(F.array_join(F.array_distinct(lines), "\n")).alias("optimized_tokens"), (F.col("n_chars") / 1000).alias("elapsed_seconds"),
    )


def ledger_stats(spark, sf_dir):
    return corpus.ledger_stats(_ledger(spark, sf_dir))


def ledger_recent(spark, sf_dir):
    return corpus.ledger_recent(_ledger(spark, sf_dir), "doc_id").select("doc_id", "file_type", "original_tokens", "optimized_tokens")


def tfidf_search(spark, sf_dir):
    return search.tfidf(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def readiness_gate(spark, sf_dir):
    """For each of two score thresholds: documents let in and held, and benchmark items found whole among the top 3 of
    a search over what was let in. The score of a document is 100 less its share of repeated lines."""
    d = read(spark, sf_dir, "documents").withColumn("_l", F.split("text", "\n"))
    d = d.select("doc_id", "text", F.floor(100 * F.size(F.array_distinct("_l")) / F.size("_l")).alias("score"))
    b, out = read(spark, sf_dir, "benchmark"), None
    for threshold in (0, 94):
        kept = d.filter(F.col("score") >= threshold)
        hits = (
            search.tfidf(kept, b).join(kept.select("doc_id", F.lower("text").alias("t")), "doc_id").join(b.select("item_id", F.lower("text").alias("q")), "item_id")
            .filter(F.contains("t", "q")).agg(F.countDistinct("item_id").alias("hits"))
        )
        one = d.agg(F.count_if(F.col("score") >= threshold).alias("indexed"), F.count_if(F.col("score") < threshold).alias("held")).crossJoin(hits).withColumn("threshold", F.lit(threshold))
        out = one if out is None else out.unionByName(one)
    return out


def _centroids(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("label", "i").agg(F.avg("v").alias("v"))
    return m.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: F.bround(x["v"], 6)).alias("embedding"))


def vector_search(spark, sf_dir):
    """The five vectors nearest to the mean of each label, by cosine distance."""
    return search.nearest(read(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), 5).withColumn("distance", F.bround("distance", 4))


def vector_search_l2(spark, sf_dir):
    return search.nearest(read(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), 5, "l2").withColumn("distance", F.bround("distance", 3))


def classifier_metrics(spark, sf_dir):
    """How well 'has no repeated line' predicts quality, by language."""
    d = read(spark, sf_dir, "documents").withColumn("_l", F.split("text", "\n"))
    d = d.select("doc_id", "lang", (F.size(F.array_distinct("_l")) == F.size("_l")).alias("clean")).join(read(spark, sf_dir, "labels"), "doc_id")
    return evals.confusion(d, F.col("quality") == 1, F.col("clean"), ["lang"])


def runtime_percentiles(spark, sf_dir):
    return evals.percentiles(read(spark, sf_dir, "events"), "value", [50, 90, 95, 99], ["event_type"])


def kv_cache_cost(spark, sf_dir):
    d = _sizes(spark, sf_dir).groupBy("source").agg(F.avg("tokens").alias("tokens"))
    for m, gb in (("8b", 18.0), ("70b", 40.0)):
        d = d.withColumn("_c", evals.cache_cost(F.col("tokens"), m, gb)).withColumns({f"gb_{m}": F.bround("_c.request_gb", 6), f"concurrent_{m}": F.col("_c.concurrent")})
    return d.withColumn("ttft_ratio", F.bround(evals.prefill_ratio(F.col("tokens"), F.lit(1000.0)), 6)).withColumn("tokens", F.bround("tokens", 6)).drop("_c")


def anls(spark, sf_dir):
    """Each benchmark item without its last word as an answer, held against what is accepted: the item, and the one before."""
    # DuckDB counts edits in bytes: letters outside ASCII are one mark here
    b = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "_").alias("text"), (F.col("item_id") + 1).alias("next"))
    other = b.select(F.col("next").alias("item_id"), F.col("text").alias("other"))
    given = F.regexp_replace("text", r"\s+\S+\s*$", "")
    one = lambda c: evals.answer_similarity(given, F.col(c), 0.5)
    return b.join(other, "item_id", "left").select("item_id", F.bround(F.greatest(one("text"), F.coalesce(one("other"), F.lit(0.0))), 6).alias("anls"))


def segment_paragraphs(spark, sf_dir):
    """Events of a user as spoken segments: a pause over an hour or a purchase ends the paragraph."""
    e = evals.session_numbers(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3600.0, F.col("event_type") == "purchase")
    return e.groupBy("user_id", "session").agg(F.count("*").alias("segments"), F.min("event_id").alias("first_event"))


def debounce_sessions(spark, sf_dir):
    """Events that follow one another within two hours are one change of a user's file."""
    e = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
    return e.select("user_id", "n", "last_event")


def rate_limit(spark, sf_dir):
    """At most 3 events of a user in any hour."""
    e = evals.rate_limited(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3, 3600)
    return e.select("event_id", "user_id", "recent", "allowed")


def repeated_bullets(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return evals.kept_once(d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("idx").alias("places"))


def sanitize_member_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.member_name(F.regexp_replace("url", "^https?:", "")).alias("name"))


def stratified_sample(spark, sf_dir):
    """Five documents of each source."""
    return evals.sampled(read(spark, sf_dir, "documents"), "source", "doc_id", 5).select("doc_id", "source")


def ocr_auto_policy(spark, sf_dir):
    """Conversations as scans: turns are pages, short turns image pages; which reader is chosen and why."""
    from ..operators.policy import ocr_choice

    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("pages"), F.count_if(F.length("text") < 200).alias("image_pages"))
    choice = ocr_choice(F.col("pages"), F.col("image_pages"), F.col("conv_id") % 2 == 0)
    return c.select("conv_id", choice["backend"].alias("backend"), choice["reason"].alias("reason"))


def table_markdown(spark, sf_dir):
    return grids(spark, sf_dir).select("table_id", tables.markdown(F.col("grid")).alias("content"))


def table_tsv(spark, sf_dir):
    return grids(spark, sf_dir).select("table_id", tables.tsv(F.col("grid")).alias("content"))


def table_row_records(spark, sf_dir):
    return grids(spark, sf_dir).select("table_id", tables.row_records(F.col("grid"), F.col("header_rows")).alias("content"))


def table_preview(spark, sf_dir):
    g = grids(spark, sf_dir)
    title, path = F.concat(F.lit("Customer "), F.col("table_id").cast("string")), F.lit(None).cast("string")
    return g.select(
        "table_id", tables.preview(F.col("grid"), F.col("header_rows"), title, path).alias("content"),
        tables.reference(F.col("table_id"), F.col("grid"), F.col("header_rows"), F.lit("t.json")).alias("reference"),
    )


def table_split(spark, sf_dir):
    g = grids(spark, sf_dir).select("table_id", F.explode_outer(tables.ranges(F.col("grid"), F.col("header_rows"), 60)).alias("r")).filter("r is not null")
    return g.select("table_id", "r.row_start", "r.row_end", "r.oversize", "r.estimated_tokens")


def table_quality_signals(spark, sf_dir):
    from ..operators.table_quality import signals

    return signals(grids(spark, sf_dir)).select("table_id", "name", "value", "status")


def table_findings(spark, sf_dir):
    from ..operators.table_quality import findings, signals

    return findings(signals(grids(spark, sf_dir)))


def parse_json_doc(spark, sf_dir):
    """The kind and the summary of the events' properties."""
    from ..sources.structured import json_summary

    return read(spark, sf_dir, "events").select("event_id", json_summary(F.col("props")).alias("summary"))


def parse_jsonl(spark, sf_dir):
    """The events of each user as a file of JSON lines: how many parse, and their keys."""
    e = read(spark, sf_dir, "events").select("user_id", F.try_parse_json("props").alias("v"), F.json_object_keys("props").alias("k"))
    return e.groupBy("user_id").agg(F.count("*").alias("lines"), F.count("v").alias("parsed"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("k")))), ",").alias("keys"))


def csv_table_block(spark, sf_dir):
    """Suppliers of each nation as a CSV file's block: capped cells, a note of how many rows there are."""
    from ..sources.structured import csv_grid

    s = read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name", F.format_string("%.2f", "s_acctbal").alias("s_acctbal"))
    t = tables.from_rows(s, "s_nationkey", ["s_suppkey"], ["s_suppkey", "s_name", "s_acctbal"])
    return t.select("table_id", (F.size("grid") - 1).alias("rows"), tables.markdown(csv_grid(F.col("grid"))).alias("content"))


def enqueue(spark, sf_dir):
    """Documents offered again to a queue that holds the even ones as done: what is to be processed."""
    from ..streaming.ingest import to_process

    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("content_hash"))
    jobs = d.filter("cast(path as bigint) % 2 = 0").withColumn("status", F.when(F.col("path").endswith("0"), "error").otherwise("done"))
    return to_process(d, jobs).groupBy(F.substring("path", -1, 1).alias("digit")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        shingles, minhash_signature, near_duplicates_05, near_duplicates_08, corpus_status, token_packing, ledger_stats, ledger_recent, tfidf_search, readiness_gate,
        vector_search, vector_search_l2, classifier_metrics, runtime_percentiles, kv_cache_cost, anls, segment_paragraphs, debounce_sessions, rate_limit, repeated_bullets,
        sanitize_member_name, stratified_sample, ocr_auto_policy, table_markdown, table_tsv, table_row_records, table_preview, table_split, table_quality_signals,
        table_findings, parse_json_doc, parse_jsonl, csv_table_block, enqueue,
    )
}

_GRAMS = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
 g AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w))"""
_COEFF = ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(corpus.coefficients()))
_SIG = f"""{_GRAMS}, h AS (SELECT DISTINCT doc_id, CAST('0x' || substr(sha1(s), 1, 8) AS BIGINT)::HUGEINT AS h FROM g), c(k, a, b) AS (VALUES {_COEFF}),
 m AS (SELECT doc_id, k, min(((a * h + b) % {(1 << 61) - 1}) % 4294967296) AS v FROM h, c GROUP BY doc_id, k), sig AS (SELECT doc_id, list(v::BIGINT ORDER BY k) AS sig FROM m GROUP BY doc_id)"""
_LEDGER = f"""l AS (SELECT doc_id, lang AS file_type, {_tokens("text")} AS o, greatest(1, {_tokens("text")} - coalesce(r, 0)) AS p, n_chars / 1000 AS e FROM documents LEFT JOIN
  (SELECT doc_id, sum(t) AS r FROM (SELECT doc_id, (count(*) - 1) * (CASE WHEN trim(x) = '' THEN 0 ELSE {_tokens("x")} END) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY doc_id, x) GROUP BY doc_id) USING (doc_id))"""


def _tfidf(docs: str) -> str:
    return f"""qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[./][a-z0-9]+)*')) AS term FROM benchmark),
 dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[./][a-z0-9]+)*') AS t FROM {docs}), e AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM dt),
 tf AS (SELECT doc_id, n, term, count(*) AS c FROM e WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, ln(((SELECT count(*) FROM {docs}) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
 qw AS (SELECT item_id, term, coalesce(idf, 1.0) AS idf FROM qt LEFT JOIN df USING (term)), qn AS (SELECT item_id, sqrt(sum(idf * idf)) AS qn FROM qw GROUP BY item_id),
 sc AS (SELECT item_id, doc_id, sum(idf * (c / n * idf)) AS dot, sqrt(sum((c / n * idf) * (c / n * idf))) AS own FROM qw JOIN tf USING (term) GROUP BY item_id, doc_id),
 top AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round_even(dot / (own * qn), 6) DESC, doc_id) AS INTEGER) AS rank, doc_id, round_even(dot / (own * qn), 6) AS score FROM sc JOIN qn USING (item_id))"""


def _gate(threshold: int) -> str:
    return f"""SELECT {threshold} AS threshold, (SELECT count(*) FROM sc0 WHERE score >= {threshold}) AS indexed, (SELECT count(*) FROM sc0 WHERE score < {threshold}) AS held,
   (WITH kept AS (SELECT doc_id, text FROM sc0 WHERE score >= {threshold}), {_tfidf("kept")} SELECT count(DISTINCT t.item_id) FROM top t JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = t.item_id WHERE t.rank <= 3 AND contains(lower(d.text), lower(b.text))) AS hits"""


_CENTER = "c AS (SELECT label AS query_id, list(v ORDER BY i) AS q FROM (SELECT label, i, round_even(avg(v::DOUBLE), 6) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
_GRID = """o AS (SELECT o_custkey AS table_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS r, count(*) OVER (PARTITION BY o_custkey) AS n,
  [CAST(o_orderkey AS VARCHAR), o_orderstatus, printf('%.2f', o_totalprice), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority] AS c FROM orders)"""
_NAMES = "['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']"
_HEAD = f"'| ' || array_to_string({_NAMES}, ' | ') || ' |' || chr(10) || '| --- | --- | --- | --- | --- |'"

ORACLE_SQL = {
    "shingles": f"WITH {_GRAMS} SELECT doc_id, count(*) AS n, count(DISTINCT s) AS different, min(s) AS least FROM g GROUP BY doc_id",
    "minhash_signature": f"WITH {_SIG} SELECT doc_id, array_to_string(sig, ',') AS signature FROM sig",
    "near_duplicates_05": f"WITH {_SIG} SELECT doc_id, f AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS f FROM sig) WHERE doc_id > f",
    "near_duplicates_08": f"""WITH {_SIG}, u AS (SELECT sig, min(doc_id) AS f FROM sig GROUP BY sig), p AS (SELECT x.sig AS sig, min(y.f) AS b FROM u x JOIN u y ON y.f <= x.f
   AND len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) >= 52 GROUP BY x.sig) SELECT doc_id, b AS duplicate_of FROM sig JOIN p USING (sig) WHERE doc_id > b""",
    "corpus_status": f"""WITH {_SIG}, d AS (SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS f FROM sig) WHERE doc_id > f)
 SELECT CASE WHEN lang NOT IN ('de', 'en') THEN 'unsupported' WHEN contains(text, '|') THEN 'failed' WHEN trim(text) = '' THEN 'low_quality' WHEN d.doc_id IS NOT NULL THEN 'duplicate' ELSE 'processed' END AS category, count(*) AS n
 FROM documents t LEFT JOIN d USING (doc_id) GROUP BY category""",
    "token_packing": f"""WITH RECURSIVE s AS (SELECT source, doc_id, {_tokens("text")} AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
 f AS (SELECT source, i, t AS cur, 0 AS pack FROM s WHERE i = 1 UNION ALL SELECT s.source, s.i, CASE WHEN f.cur + s.t > 5000 THEN s.t ELSE f.cur + s.t END, CASE WHEN f.cur + s.t > 5000 THEN f.pack + 1 ELSE f.pack END
   FROM f JOIN s ON s.source = f.source AND s.i = f.i + 1), p AS (SELECT source, pack, count(*) AS documents, sum(t) AS token_count FROM f JOIN s USING (source, i) GROUP BY source, pack)
 SELECT source, pack, row_number() OVER (ORDER BY source, pack) - 1 AS chunk_index, documents, token_count FROM p""",
    "ledger_stats": f"""WITH {_LEDGER} SELECT file_type, count(*) AS compilations, sum(o) AS original_tokens, sum(p) AS optimized_tokens, sum(greatest(0, o - p)) AS saved_tokens, round_even(sum(e), 1) AS elapsed_seconds,
   round_even((1 - sum(p) / sum(o)) * 100, 1) AS reduction_percent FROM l GROUP BY ROLLUP (file_type)""",
    "ledger_recent": f"WITH {_LEDGER} SELECT doc_id, file_type, o AS original_tokens, p AS optimized_tokens FROM l ORDER BY doc_id DESC LIMIT 10",
    "anls": """WITH a AS (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS text FROM benchmark), b AS (SELECT item_id, trim(lower(text)) AS t, trim(lower(regexp_replace(text, '\\s+\\S+\\s*$', ''))) AS p FROM a),
 s AS (SELECT x.item_id, 1 - levenshtein(x.p, x.t) / greatest(length(x.p), length(x.t), 1) AS a, 1 - levenshtein(x.p, y.t) / greatest(length(x.p), length(y.t), 1) AS b FROM b x LEFT JOIN b y ON y.item_id = x.item_id - 1)
 SELECT item_id, round_even(greatest(CASE WHEN a >= 0.5 THEN a ELSE 0 END, CASE WHEN coalesce(b, 0) >= 0.5 THEN b ELSE 0 END), 6) AS anls FROM s""",
    "tfidf_search": f"WITH {_tfidf('documents')} SELECT * FROM top WHERE rank <= 3",
    "readiness_gate": "WITH sc0 AS (SELECT doc_id, text, floor(100 * len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10)))) AS score FROM documents) " + " UNION ALL ".join(_gate(t) for t in (0, 94)),
    "vector_search": f"""WITH {_CENTER}, d AS (SELECT query_id, vec_id, round_even(1 - list_dot_product(q, embedding::DOUBLE[]) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS d FROM c, embeddings)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, round_even(d, 4) AS distance FROM d QUALIFY rank <= 5""",
    "vector_search_l2": f"""WITH {_CENTER}, d AS (SELECT query_id, vec_id, round_even(list_sum(list_transform(list_zip(q, embedding), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS d FROM c, embeddings)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, round_even(d, 3) AS distance FROM d QUALIFY rank <= 5""",
    "classifier_metrics": """WITH d AS (SELECT lang, quality = 1 AS e, len(list_distinct(string_split(text, chr(10)))) = len(string_split(text, chr(10))) AS p FROM documents JOIN labels USING (doc_id)),
 c AS (SELECT lang, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (e AND NOT p) AS fn FROM d GROUP BY lang),
 m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS a, coalesce(tp / nullif(tp + fn, 0), 0) AS b FROM c)
 SELECT lang, tp, fp, tn, fn, tp + fp + tn + fn AS n, round_even(a, 4) AS precision, round_even(b, 4) AS recall, round_even(coalesce(2 * a * b / nullif(a + b, 0), 0), 4) AS f1,
   round_even(coalesce(fp / nullif(fp + tn, 0), 0), 4) AS false_positive_rate, round_even(coalesce(tn / nullif(fp + tn, 0), 0), 4) AS specificity FROM m""",
    "runtime_percentiles": "SELECT event_type, " + ", ".join(f"round_even(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (50, 90, 95, 99)) + " FROM events GROUP BY event_type",
    "kv_cache_cost": f"""WITH d AS (SELECT source, avg({_tokens("text")}) AS t FROM documents GROUP BY source)
 SELECT source, round_even(t, 6) AS tokens, round_even(t * 131072 / 1073741824, 6) AS gb_8b, CAST(greatest(1, floor(18 / (t * 131072 / 1073741824))) AS INTEGER) AS concurrent_8b, round_even(t * 327680 / 1073741824, 6) AS gb_70b,
   CAST(greatest(1, floor(40 / (t * 327680 / 1073741824))) AS INTEGER) AS concurrent_70b, round_even((t / 1000) * (t / 1000), 6) AS ttft_ratio FROM d""",
    "segment_paragraphs": """WITH e AS (SELECT *, coalesce(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w > 3600 OR lag(event_type) OVER w = 'purchase', true) AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(nw::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, session, count(*) AS segments, min(event_id) AS first_event FROM s GROUP BY user_id, session""",
    "debounce_sessions": """WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR, true) AS nw FROM events), s AS (SELECT *, sum(nw::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
 SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM s GROUP BY user_id, s""",
    "rate_limit": """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent,
   count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) <= 3 AS allowed FROM events""",
    "repeated_bullets": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
 k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n, min(idx) OVER (PARTITION BY doc_id, line) AS f FROM l) SELECT doc_id, count(*) AS lines, sum(idx) AS places FROM k WHERE n < 3 OR idx = f GROUP BY doc_id""",
    "sanitize_member_name": """SELECT page_id, coalesce(nullif(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(replace(regexp_replace(url, '^https?:', ''), '\\', '/'), '[\\x00-\\x1f\\x7f]', '', 'g'), '^[A-Za-z]:', ''), '/'),
   lambda p: p NOT IN ('', '.', '..')), '/'), ''), 'unnamed') AS name FROM pages""",
    "ocr_auto_policy": """WITH c AS (SELECT conv_id, count(*) AS p, count(*) FILTER (length(text) < 200) AS i FROM conversations GROUP BY conv_id)
 SELECT conv_id, CASE WHEN p >= 3 AND i / p >= 0.3 AND conv_id % 2 = 0 THEN 'vision' ELSE 'tesseract' END AS backend,
   CASE WHEN i = 0 THEN 'no_image_pages' WHEN p < 3 THEN 'too_few_pages' WHEN i / p < 0.3 THEN 'too_few_image_pages' WHEN conv_id % 2 <> 0 THEN 'backend_unavailable' ELSE 'selected' END AS reason FROM c""",
    "table_markdown": f"WITH {_GRID} SELECT table_id, {_HEAD} || chr(10) || string_agg('| ' || array_to_string(c, ' | ') || ' |', chr(10) ORDER BY r) AS content FROM o GROUP BY table_id",
    "table_tsv": f"WITH {_GRID} SELECT table_id, array_to_string({_NAMES}, chr(9)) || chr(10) || string_agg(array_to_string(c, chr(9)), chr(10) ORDER BY r) AS content FROM o GROUP BY table_id",
    "table_row_records": f"WITH {_GRID} SELECT table_id, string_agg(array_to_string(list_transform(list_zip({_NAMES}, c), lambda z: z[1] || '=' || z[2]), '; '), chr(10) ORDER BY r) AS content FROM o GROUP BY table_id",
    "table_preview": f"""WITH {_GRID} SELECT table_id, 'Table: Customer ' || table_id || chr(10) || 'Rows: ' || n || chr(10) || 'Columns: ' || array_to_string({_NAMES}, ', ') || chr(10) || chr(10) || string_agg(array_to_string(c, chr(9)), chr(10) ORDER BY r) FILTER (r <= 5)
   || CASE WHEN n > 5 THEN chr(10) || chr(10) || '[' || (n - 5) || ' additional rows omitted. Full structured table: unavailable]' ELSE '' END AS content, '[Table ' || table_id || ': ' || n || ' rows x 5 columns. Full data: t.json]' AS reference FROM o GROUP BY table_id, n""",
    "table_split": f"""WITH RECURSIVE {_GRID}, s AS (SELECT table_id, r, n, {_tokens("'| ' || array_to_string(c, ' | ') || ' |'")} AS t FROM o), w AS (SELECT table_id, sum(t) + {11 + 11} AS total FROM s GROUP BY table_id),
 f AS (SELECT table_id, r, t AS acc, 0 AS g FROM s WHERE r = 1 UNION ALL SELECT s.table_id, s.r, CASE WHEN 22 + f.acc + s.t <= 60 THEN f.acc + s.t ELSE s.t END, CASE WHEN 22 + f.acc + s.t <= 60 THEN f.g ELSE f.g + 1 END
   FROM f JOIN s ON s.table_id = f.table_id AND s.r = f.r + 1)
 SELECT table_id, CASE WHEN g = 0 OR total <= 60 THEN 0 ELSE min(r) END AS row_start, CAST(max(r) AS INTEGER) AS row_end, total > 60 AND count(*) = 1 AND 22 + sum(t) > 60 AS oversize,
   CASE WHEN total > 60 AND count(*) = 1 AND 22 + sum(t) > 60 THEN CAST(22 + sum(t) AS INTEGER) ELSE 0 END AS estimated_tokens FROM (SELECT table_id, r, t, total, CASE WHEN total <= 60 THEN 0 ELSE g END AS g FROM f JOIN s USING (table_id, r) JOIN w USING (table_id)) GROUP BY table_id, g, total""",
    "parse_json_doc": """SELECT event_id, array_to_string(list_transform(json_keys(props), lambda k: '**' || k || '**: ' || json_extract_string(props, '$.' || k)), chr(10)) AS summary FROM events""",
    "parse_jsonl": """SELECT user_id, count(*) AS lines, count(*) FILTER (json_valid(props)) AS parsed, (SELECT string_agg(DISTINCT k, ',' ORDER BY k) FROM (SELECT unnest(json_keys(props)) AS k FROM events i WHERE i.user_id = e.user_id)) AS keys FROM events e GROUP BY user_id""",
    "csv_table_block": """WITH s AS (SELECT s_nationkey AS table_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, '| ' || s_suppkey || ' | ' || s_name || ' | ' || printf('%.2f', s_acctbal) || ' |' AS l FROM supplier)
 SELECT table_id, CAST(count(*) AS INTEGER) AS rows, '| s_suppkey | s_name | s_acctbal |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(l, chr(10) ORDER BY r) FILTER (r <= 500) AS content FROM s GROUP BY table_id""",
    "enqueue": "SELECT substr(doc_id::VARCHAR, -1) AS digit, count(*) AS n FROM documents WHERE doc_id % 2 = 1 OR doc_id % 10 = 0 GROUP BY digit",
}
