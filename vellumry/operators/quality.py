"""Structure issues, repetition, content measures, deductions and the readiness score of documents.

Everything is an expression over a document's own row: no operator here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.binding import let

LARGE_BLOCK_CHARS = 10_000
REPEAT_CHARS, REPEAT_TIMES, REPEAT_LINES = 20, 5, 3
PAGE_CHARS, PAGE_TOKENS, LEAST_PAGES = 80, 1500, 3
GLYPHS, GLYPH_SHARE = 10, 0.02
#: Starting score of each format, by how much its conversion loses; formats not listed start at DEFAULT_BASE.
DEFAULT_BASE = 72
BASE = {
    95: "c cpp cs go java js jsx markdown md py rb rs sh sql toml ts tsx yaml yml", 93: "text txt", 92: "rst", 90: "csv latex tex tsv",
    88: "json jsonl ndjson", 87: "htm html pdf", 85: "atom rss xlsx", 83: "docx ipynb ods xlsm", 82: "xml", 80: "docm epub odt pptx xls",
    78: "eml msg odp pptm", 75: "flac wav", 72: "m4a mp3", 70: "aac jpeg jpg ogg opus png tif tiff webp", 68: "7z bmp mp4 tar tgz zip",
    65: "bz2 doc gif gz webm xz", 63: "rtf", 62: "ppt",
}
IMAGE_TYPES = ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")


def base_score(file_type: Column) -> Column:
    table = {t: score for score, types in BASE.items() for t in types.split()}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[file_type], F.lit(DEFAULT_BASE))


def repeated_lines(contents: Column) -> Column:
    """How many different lines of REPEAT_CHARS or more occur REPEAT_TIMES or more: found in the sorted lines."""
    lines = F.flatten(F.transform(contents, lambda c: F.split(c, "\n")))
    sorted_ = F.array_sort(F.filter(F.transform(lines, text.strip), lambda x: F.length(x) >= REPEAT_CHARS))
    return let(sorted_, lambda long: F.size(F.array_distinct(F.filter(long, lambda x, i: F.get(long, i + (REPEAT_TIMES - 1)) == x))))


def issues(docs: DataFrame) -> DataFrame:
    """docs (doc_id, file_type, pages, blocks, original_tokens, ...) with a column ``issues``: array of (severity, code, idx, page).

    Codes: EMPTY_DOCUMENT alone when there are no blocks; else HEADING_HIERARCHY (first heading below level 2),
    HEADING_SKIP, LARGE_BLOCK, EMPTY_BLOCK, MISSING_PAGE (pdf), NEAR_EMPTY_OUTPUT, LOW_TEXT_DENSITY (pdf),
    GLYPH_ARTIFACTS, REPEATED_CONTENT, TOKEN_BLOAT (pdf).
    """
    b, pages, pdf = F.col("blocks"), F.coalesce("pages", F.lit(0)), F.col("file_type") == "pdf"
    none = F.lit(None).cast("int")

    def one(code: str, idx: Column = none, page: Column = none) -> Column:
        return F.struct(F.lit("warning").alias("severity"), F.lit(code).alias("code"), idx.cast("int").alias("idx"), page.cast("int").alias("page"))

    empty = F.array().cast("array<struct<severity:string,code:string,idx:int,page:int>>")
    at = F.transform(b, lambda x, i: F.struct(i.alias("i"), x["type"].alias("type"), x["level"].alias("level"), x["page"].alias("page"), x["content"].alias("content")))
    heads = F.filter(at, lambda x: (x["type"] == "heading") & x["level"].isNotNull())
    chars = F.aggregate(b, F.lit(0), lambda s, x: s + F.length(text.strip(x["content"])))
    body = F.aggregate(F.filter(b, lambda x: x["type"].isin("heading", "paragraph", "table")), F.lit(0), lambda s, x: s + F.length(text.strip(x["content"])))
    joined = F.array_join(F.transform(b, lambda x: x["content"]), " ")
    glyphs = text.glyph_codes(joined)
    prose = F.transform(F.filter(b, lambda x: x["type"].isin("heading", "paragraph")), lambda x: x["content"])
    with_page = F.array_distinct(F.filter(F.transform(b, lambda x: x["page"]), lambda p: p.isNotNull()))
    missing = F.when(pdf & (pages > 0), F.array_except(F.sequence(F.lit(1), F.greatest(pages, F.lit(1))), with_page)).otherwise(F.array().cast("array<int>"))

    def when(test: Column, code: str) -> Column:
        return F.when(test, F.array(one(code))).otherwise(empty)

    found = F.concat(
        when(F.get(heads, F.lit(0))["level"] > 2, "HEADING_HIERARCHY"),
        let(heads, lambda hs: F.transform(F.filter(hs, lambda h, i: (i > 0) & (h["level"] > F.get(hs, i - 1)["level"] + 1)), lambda h: one("HEADING_SKIP", h["i"], h["page"]))),
        F.transform(F.filter(at, lambda x: F.length(x["content"]) > LARGE_BLOCK_CHARS), lambda x: one("LARGE_BLOCK", x["i"], x["page"])),
        F.transform(F.filter(at, lambda x: text.strip(x["content"]) == ""), lambda x: one("EMPTY_BLOCK", x["i"], x["page"])),
        F.transform(missing, lambda p: one("MISSING_PAGE", none, p)),
        when((pages >= LEAST_PAGES) & (chars < pages * PAGE_CHARS), "NEAR_EMPTY_OUTPUT"),
        when(pdf & (pages > 0) & (body < pages * PAGE_CHARS), "LOW_TEXT_DENSITY"),
        when((glyphs >= GLYPHS) & (glyphs > GLYPH_SHARE * F.greatest(F.length(joined), F.lit(1))), "GLYPH_ARTIFACTS"),
        when(repeated_lines(prose) >= REPEAT_LINES, "REPEATED_CONTENT"),
        when(pdf & (pages >= LEAST_PAGES) & (F.col("original_tokens") > pages * PAGE_TOKENS), "TOKEN_BLOAT"),
    )
    return docs.withColumn("issues", F.when(F.size(b) > 0, found).otherwise(F.array(one("EMPTY_DOCUMENT"))))


def deductions(docs: DataFrame) -> DataFrame:
    """docs with ``deductions``: array of (rule_id, penalty, suppressed), zero rules left out, in the order applied.

    Needs issues, file_type, pages, blocks; optional columns ocr_required and ocr_available (boolean), image_pages and
    asset_images (int) describe scanned files and count as false, false, 0, 0 when absent.
    """
    have = set(docs.columns)
    opt = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    pages, b, pdf = F.coalesce("pages", F.lit(0)), F.col("blocks"), F.col("file_type") == "pdf"

    def count(*codes: str, severity: str = "warning") -> Column:
        return F.size(F.filter("issues", lambda i: (i["severity"] == severity) & i["code"].isin(*codes)))

    n_of = lambda kind: F.size(F.filter(b, lambda x: x["type"] == kind))
    errors = F.size(F.filter("issues", lambda i: i["severity"] == "error"))
    missing, large, heads = count("MISSING_PAGE"), count("LARGE_BLOCK"), count("HEADING_SKIP", "HEADING_HIERARCHY")
    share = F.when(pages > 0, F.bround(missing / pages * 100)).otherwise(0)
    need = opt("ocr_required", False)
    near, low = count("NEAR_EMPTY_OUTPUT") > 0, count("LOW_TEXT_DENSITY") > 0
    sparse = ~need & pdf & near & opt("ocr_available", False)
    scan = F.least(F.lit(40), F.floor(40 * opt("image_pages", 0) / F.greatest(pages, F.lit(1))).cast("int") + 10)
    generic = F.size(F.filter(b, lambda x: (x["type"] == "table") & x["content"].rlike("Col[12]")))
    hidden = F.lit("[Image not extracted")
    placeholder = F.size(F.filter(b, lambda x: (x["type"] == "paragraph") & F.contains(x["content"], hidden)))
    real = F.size(F.filter(b, lambda x: (x["type"] != "image") & ~((x["type"] == "paragraph") & F.contains(x["content"], hidden))))
    only = (placeholder > 0) & (real == 0) & ~need & (opt("asset_images", 0) == 0)

    early = [
        ("PARSE_ERRORS", errors > 0, F.least(F.lit(30), errors * 12), None),
        ("MISSING_PAGE", (missing > 0) & (pages > 0), F.least(F.lit(30), missing * 4) + F.when(share >= 50, 8).otherwise(0), None),
        ("LARGE_BLOCK", large > 0, F.least(F.lit(10), large * 4), None),
        ("HEADING_ISSUES", heads > 0, F.least(F.lit(8), heads * 2), None),
    ]
    before = base_score(F.col("file_type"))
    for _, test, amount, _ in early:
        before = before - F.when(test, amount).otherwise(0)
    rules = [
        *early,
        ("IMAGE_PLACEHOLDER_NO_FALLBACK", only, F.greatest(F.lit(0), before - 55), None),
        ("OCR_REQUIRED", need, scan, None),
        ("OCR_ATTEMPTED_SPARSE", sparse, scan, None),
        ("NEAR_EMPTY_OUTPUT", near, F.lit(25), need | sparse),
        ("LOW_TEXT_DENSITY", low, F.lit(20), need | sparse),
        ("GLYPH_ARTIFACTS", count("GLYPH_ARTIFACTS") > 0, F.lit(25), None),
        ("REPEATED_CONTENT", count("REPEATED_CONTENT") > 0, F.lit(8), None),
        ("TOKEN_BLOAT", count("TOKEN_BLOAT") > 0, F.lit(8), None),
        ("NO_HEADINGS_MULTIPAGE", (n_of("heading") == 0) & (pages > 3), F.lit(6), None),
        ("COL_GENERIC_TABLES", generic > 0, F.least(F.lit(5), generic * 2), None),
        ("NO_TEXT_IN_IMAGE", F.col("file_type").isin(*IMAGE_TYPES) & (n_of("paragraph") == 0), F.lit(10), None),
    ]
    each = [
        F.when(test, F.struct(F.lit(rule).alias("rule_id"), amount.cast("int").alias("penalty"), (F.lit(False) if held is None else held).alias("suppressed")))
        for rule, test, amount, held in rules
    ]
    return docs.withColumn("deductions", F.array_compact(F.array(*each)))


def readiness(docs: DataFrame) -> DataFrame:
    """docs with readiness_score and quality_band: the format's base less the deductions in force, within 0..100; 10 for
    documents without a token."""
    off = F.aggregate(F.filter("deductions", lambda d: ~d["suppressed"]), F.lit(0), lambda s, d: s + d["penalty"])
    score = F.greatest(F.lit(0), F.least(F.lit(100), base_score(F.col("file_type")) - off))
    score = F.when(F.col("original_tokens") == 0, 10).otherwise(score).cast("int")
    return docs.withColumn("readiness_score", score).withColumn("quality_band", text.quality_band(score))


def _grams(tokens: Column, n: int) -> Column:
    """Sorted (hash, place) of the n-grams."""
    return F.array_sort(F.transform(
        F.sequence(F.lit(1), F.size(tokens) - n + 1),
        lambda i: F.struct(F.xxhash64(F.array_join(F.slice(tokens, i, n), " ")).alias("h"), i.alias("i")),
    ))


def ngram_repetition(docs: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, n_chars, max_count, ratio, preview, digest, unsafe) of the n-gram that occurs most; of equals the first.

    One linear pass over the sorted hashes of the document's own n-grams. Texts too short for one n-gram have count 0.
    unsafe: 200 characters or more, 50 occurrences or more, and a tenth of all n-grams.
    """
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']+"), 0)
    t = docs.select("doc_id", F.length("text").alias("n_chars"), tokens.alias("t"))
    g = _grams(F.col("t"), n)

    def state(h: Column, n_: Column, i: Column, best: Column) -> Column:
        return F.struct(h.alias("h"), n_.alias("n"), i.alias("i"), best.alias("best"))

    def top(n_: Column, i: Column) -> Column:
        return F.struct(n_.alias("n"), (-i).alias("i"))

    zero = state(F.lit(0).cast("bigint"), F.lit(0), F.lit(0), top(F.lit(0), F.lit(0)))
    best = F.aggregate(g, zero, lambda s, x: F.when(
        (s["n"] > 0) & (s["h"] == x["h"]), state(s["h"], s["n"] + 1, s["i"], F.greatest(s["best"], top(s["n"] + 1, s["i"])))
    ).otherwise(state(x["h"], F.lit(1), x["i"], F.greatest(s["best"], top(F.lit(1), x["i"])))), lambda s: s["best"])
    enough = F.size("t") >= n
    t = t.withColumn("_b", F.when(enough, best))
    gram = F.array_join(F.slice("t", -F.col("_b.i"), F.lit(n)), " ")
    t = t.withColumn("_g", F.coalesce(F.when(enough, gram), F.lit(""))).withColumn("max_count", F.coalesce("_b.n", F.lit(0)))
    ratio = F.when(enough, F.col("max_count") / (F.size("t") - n + 1)).otherwise(0.0)
    short = F.when(F.length("_g") <= 100, F.col("_g")).otherwise(F.concat(F.substring("_g", 1, 99), F.lit("…")))
    return t.select(
        "doc_id", "n_chars", "max_count", F.bround(ratio, 6).alias("ratio"), short.alias("preview"),
        F.when(F.col("_g") == "", "").otherwise(F.sha2("_g", 256)).alias("digest"),
        ((F.col("n_chars") >= 200) & (F.col("max_count") >= 50) & (ratio >= 0.10)).alias("unsafe"),
    )


def repeat_ratio(c: Column, n: int = 4, least_words: int = 8) -> Column:
    """Share of the n-word windows that occur more than once; 0 for texts under ``least_words`` words."""

    def repeated(h: Column) -> Column:
        return F.size(F.filter(h, lambda x, i: F.coalesce(F.get(h, i + 1) == x, F.lit(False)) | F.coalesce(F.get(h, i - 1) == x, F.lit(False))))

    def share(words: Column) -> Column:
        return F.when(F.size(words) >= least_words, let(F.array_sort(gram_hashes(words, n)), repeated) / (F.size(words) - n + 1)).otherwise(0.0)

    return let(F.regexp_extract_all(c, F.lit(r"[^\s]+"), 0), share)


def gram_hashes(words: Column, n: int) -> Column:
    """Hashes of the n-word windows of a bound array; an array of fewer words has one."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))


def is_repetitive(c: Column) -> Column:
    """Of recognised text: 16 words or more, of whose 4-word windows more than 0.15 repeat an earlier one."""
    def test(words: Column) -> Column:
        return (F.size(words) >= 16) & let(gram_hashes(words, 4), lambda g: (F.size(g) - F.size(F.array_distinct(g))) / F.size(g) > 0.15)

    return let(F.regexp_extract_all(c, F.lit(r"[^\s]+"), 0), test)


def image_line_ratio(c: Column) -> Column:
    lines = F.filter(F.split(c, "\n"), lambda x: text.strip(x) != "")
    return F.when(F.size(lines) > 0, F.bround(F.size(F.filter(lines, lambda x: x.rlike(r"!\[[^\]]*\]\([^)]*\)"))) / F.size(lines), 4))


def _outside_fences(c: Column) -> Column:
    """Array of arrays: the lines between code fences, one array for each stretch outside of code."""
    parts = F.split(F.regexp_replace(c, "\n$", ""), r"(?m)^[ \t]*```.*$")
    last = F.size(parts) - 1
    inner = F.transform(parts, lambda p, i: F.struct(
        F.when(i > 0, F.regexp_replace(p, r"^\n", "")).otherwise(p).alias("p"), i.alias("i"), (((i > 0) | (last > 0)) & p.isin("", "\n")).alias("none")
    ))
    even = F.filter(inner, lambda x: (x["i"] % 2 == 0) & ~x["none"])
    return F.transform(even, lambda x: F.transform(F.split(F.when(x["i"] < last, F.regexp_replace(x["p"], r"\n$", "")).otherwise(x["p"]), "\n"), text.strip))


def content_metrics(docs: DataFrame) -> DataFrame:
    """(doc_id, token_count, line_count, heading_count, table_count, noise_line_count, duplicate_line_count,
    empty_line_count, avg_paragraph_tokens, quality_score) of markdown in ``text``; fenced code is not looked at.

    Noise is a line of one to three characters or a page number; paragraphs are runs of other plain lines. The score
    gives 60 points for lines that are neither noise nor repeated and 40 for paragraphs of 20 to 300 words.
    """
    stretches = _outside_fences(F.col("text"))
    t = docs.select("doc_id", "text", stretches.alias("_s")).withColumn("_l", F.flatten("_s"))
    noisy = lambda x: F.length(x).between(1, 3) | x.rlike(r"^(?i)(?:[0-9]+$|page\s+[0-9]+)")
    head = lambda x: x.rlike(r"^#{1,6}\s+")
    full = F.filter("_l", lambda x: x != "")
    # a blank between stretches ends a paragraph, as a fence does
    lines = F.flatten(F.transform("_s", lambda s: F.concat(s, F.array(F.lit("")))))
    ends = lambda x: (x == "") | (~noisy(x) & (head(x) | x.startswith("|")))
    zero = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("words"))
    paragraphs = F.aggregate(lines, zero, lambda s, x: F.when(
        ends(x), F.struct(F.lit(0).alias("cur"), (s["n"] + F.when(s["cur"] > 0, 1).otherwise(0)).alias("n"), (s["words"] + s["cur"]).alias("words"))
    ).when(noisy(x), s).otherwise(F.struct((s["cur"] + text.word_count(x)).alias("cur"), s["n"].alias("n"), s["words"].alias("words"))))
    count = lambda test: F.size(F.filter(full, test))
    all_lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n")))
    t = t.select(
        "doc_id", F.greatest(F.lit(1), text.word_count(F.col("text"))).alias("token_count"), all_lines.alias("line_count"),
        count(lambda x: ~noisy(x) & head(x)).alias("heading_count"), count(lambda x: ~noisy(x) & ~head(x) & x.startswith("|")).alias("table_count"),
        count(noisy).alias("noise_line_count"), (F.size(full) - F.size(F.array_distinct(full))).alias("duplicate_line_count"),
        F.when(F.col("text") == "", 0).otherwise(F.size("_l") - F.size(full)).alias("empty_line_count"), paragraphs.alias("_p"),
    ).withColumn("avg_paragraph_tokens", F.when(F.col("_p.n") > 0, F.bround(F.col("_p.words") / F.col("_p.n"), 1)).otherwise(0.0)).drop("_p")
    bad = F.least(F.lit(1.0), (F.col("noise_line_count") + F.col("duplicate_line_count")) / F.greatest(F.lit(1), F.col("line_count") - F.col("empty_line_count")))
    a = F.col("avg_paragraph_tokens")
    coherent = F.when(a == 0, 0.5).when(a < 5, 0.15).when(a < 20, 0.15 + (a - 5) / 15 * 0.85).when(a <= 300, 1.0).when(a <= 800, 1.0 - (a - 300) / 1000).otherwise(0.5)
    return t.withColumn("quality_score", (F.floor((1 - bad) * 60) + F.floor(coherent * 40)).cast("int"))


def structural_metrics(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, headings, image_refs, tables, markdown_length) of markdown in ``text``."""
    c = F.col("text")
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n"), text.strip), lambda x: x != "")
    first = lambda x: F.regexp_extract(x, r"^[^\n]*", 0)
    plain = F.filter(parts, lambda x: ~first(x).startswith("#") & ~(first(x).startswith("|") & first(x).endswith("|")))
    lines = F.transform(F.split(c, "\n"), text.strip)
    row = lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) > 1)
    rule = lambda x: x.rlike(r"^\|[-:| ]*-[-:| ]*$")
    # a table's separator: the line above is its header and isn't itself below another table's row of the same run
    tables = let(lines, lambda lines: F.filter(lines, lambda x, i: rule(x) & F.coalesce(row(F.get(lines, i - 1)), F.lit(False)) & ~F.coalesce(rule(F.get(lines, i - 1)) | row(F.get(lines, i - 2)), F.lit(False))))
    return docs.select(
        "doc_id", F.size(plain).alias("paragraphs"), F.regexp_count(c, F.lit(r"(?m)^ {0,3}#{1,6}\s")).alias("headings"),
        F.regexp_count(c, F.lit(r"!\[[^\]]*\]\([^)]+\)")).alias("image_refs"), F.size(tables).alias("tables"), F.length(c).alias("markdown_length"),
    )
