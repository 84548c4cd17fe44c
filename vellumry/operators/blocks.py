"""Blocks of documents: made from text, cleaned, freed of repetition and page furniture, merged.

A document stays one row with an array of blocks wherever an operator needs only that document, so that nothing is
shuffled; ``exploded`` gives one row a block. A block is struct(type, content, level, page, index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.binding import let

LARGE_CHARS = 50_000
TOC_LINES = 60
SHORT, MERGED = 60, 300
HEADING_RUN = 150
#: Blocks that are never duplicates of one another.
EXEMPT = ("image", "key_value_group")


def block(kind: str, content: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), content.alias("content"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("page")
    )


def exploded(docs: DataFrame, blocks: str = "blocks") -> DataFrame:
    """One row a block: the document's other columns, then idx and the block's fields."""
    rest = [c for c in docs.columns if c != blocks]
    # of an inner explode Spark infers a filter on the array, and would compute the array a second time for it
    return docs.select(*rest, F.posexplode_outer(blocks).alias("idx", "_b")).filter("idx is not null").select(*rest, "idx", "_b.*")


def paragraph_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, blocks) of plain texts of any length: every paragraph between empty lines is a block. Null texts have none."""
    parts = F.filter(F.transform(F.split(text.strip(text.unix_lines(F.col("text"))), "\n{2,}"), text.strip), lambda x: x != "")
    none = F.filter(F.array(block("paragraph", F.lit(""))), lambda _: F.lit(False))
    return docs.select("doc_id", F.coalesce(F.transform(parts, lambda x: block("paragraph", x)), none).alias("blocks"))


def text_blocks(docs: DataFrame, name: Column | None = None) -> DataFrame:
    """(doc_id, blocks) of plain texts as the reference gives them to a reader: a paragraph between empty lines is a block.

    Texts beyond LARGE_CHARS get a description, an outline of their headings, paragraphs up to that many characters and
    a note of what is left out: that limit is what the reference promises its readers. Null texts have no blocks.
    """
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")) if name is None else name
    t = docs.select("doc_id", name.alias("_name"), text.unix_lines(F.col("text")).alias("_t"), F.octet_length("text").alias("_bytes"))
    t = t.withColumn("_p", F.transform(F.split(text.strip(F.col("_t")), "\n{2,}"), text.strip)).withColumn("_n", F.length("_t"))
    p, n = F.col("_p"), F.col("_n")
    zero = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("cut"))
    fold = F.aggregate(
        p, zero,
        lambda a, x: F.when(a["cut"].isNotNull(), a).otherwise(F.when(
            a["chars"] + F.length(x) > LARGE_CHARS, F.struct(a["chars"].alias("chars"), a["i"].alias("i"), a["i"].alias("cut"))
        ).otherwise(F.struct((a["chars"] + F.length(x)).alias("chars"), (a["i"] + 1).alias("i"), F.lit(None).cast("int").alias("cut")))),
    )
    t = t.withColumn("_f", F.when(n > LARGE_CHARS, fold)).withColumn("_cut", F.coalesce("_f.cut", F.size("_p")))
    words = F.format_number(text.word_count(F.col("_t")), 0)
    about = F.concat(
        F.lit("File: "), F.col("_name"), F.lit(" | Size: "), F.format_number("_bytes", 0), F.lit(" bytes | Words: ~"), words,
        F.lit(" | Paragraphs: "), F.size(p).cast("string"),
    )
    heads = F.transform(F.filter(p, text.is_prose_heading), lambda x: text.strip(F.regexp_extract(x, r"^[^\n]*", 0)))
    outline = F.concat(
        F.lit("**Structure ("), F.size(heads).cast("string"), F.lit(" sections)**\n"),
        F.array_join(F.transform(F.slice(heads, 1, TOC_LINES), lambda h: F.concat(F.lit("- "), h)), "\n"),
    )
    left = F.concat(
        F.lit("[Truncated: "), F.format_number("_f.chars", 0), F.lit(" of "), F.format_number(n, 0), F.lit(" chars shown ("),
        F.floor(100 * F.col("_f.chars") / n).cast("string"), F.lit("%). "), (F.size(p) - F.col("_cut")).cast("string"),
        F.lit(" paragraphs omitted. Full document: ~"), words, F.lit(" words.]"),
    )
    none = F.filter(F.array(block("metadata", F.lit(""))), lambda _: F.lit(False))
    large = n > LARGE_CHARS
    kept = F.filter(F.slice(p, F.lit(1), F.col("_cut")), lambda x: x != "")
    blocks = F.concat(
        F.when(large, F.array(block("metadata", about))).otherwise(none),
        F.when(large & (F.size(heads) > 0), F.array(block("paragraph", outline))).otherwise(none),
        F.transform(kept, lambda x: block("paragraph", x)),
        F.when(F.col("_f.cut").isNotNull(), F.array(block("metadata", left))).otherwise(none),
    )
    return t.select("doc_id", F.coalesce(blocks, none).alias("blocks"))


def line_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, blocks): every line that isn't blank as a paragraph, for texts without empty lines between paragraphs."""
    lines = F.filter(F.transform(F.split(text.unix_lines(F.col("text")), "\n"), text.strip), lambda x: x != "")
    none = F.filter(F.array(block("paragraph", F.lit(""))), lambda _: F.lit(False))
    return docs.select("doc_id", F.coalesce(F.transform(lines, lambda x: block("paragraph", x)), none).alias("blocks"))


def cleaned(docs: DataFrame) -> DataFrame:
    """Blocks in normal form: page numbers and empty blocks go, lists and code stay as they are, images always stay."""
    b = F.col("blocks")
    composed = F.zip_with(b, text.nfc_all(F.transform(b, lambda x: x["content"])), lambda x, c: x.withField(
        "content", F.when(x["type"].isin("list", "code_block"), x["content"]).otherwise(text.tidy(c))
    ))
    kept = F.filter(composed, lambda x: (x["type"] == "image") | ((x["content"] != "") & ~((x["type"] == "paragraph") & text.is_page_number(x["content"]))))
    return docs.withColumn("blocks", kept)


def deduplicated(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, idx, type, content, ...) without later blocks of equal content; images and key-value groups stay."""
    free = F.col("type").isin(*EXEMPT)
    first = F.min(F.when(~free, F.col("idx"))).over(Window.partitionBy("doc_id", "_check"))
    return (
        blocks.withColumn("_check", F.sha2(text.unix_lines(F.col("content")), 256)).withColumn("_first", first)
        .filter(free | (F.col("idx") == F.col("_first"))).drop("_check", "_first")
    )


def deduplicated_array(blocks: Column) -> Column:
    """The same for an array of blocks of one kind without pages, in place and without a shuffle."""
    return F.array_distinct(blocks)


def furniture(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, checksum, is_header, is_footer) of contents on many pages that open or close a page.

    blocks: (doc_id, page, idx, content); pages: (doc_id, pages). Documents under 3 pages have none; a content repeats
    when it is on at least 2 and on 40 % of the pages, rounded down.
    """
    b = blocks.filter("page is not null").withColumn("checksum", ids.checksum(F.col("content")))
    ends = b.groupBy("doc_id", "page").agg(F.min_by("checksum", "idx").alias("first"), F.max_by("checksum", "idx").alias("last"))
    least = F.greatest(F.lit(2), F.floor(F.col("pages") * 0.4))
    many = (
        b.groupBy("doc_id", "checksum").agg(F.countDistinct("page").alias("on_pages"))
        .join(pages.filter("pages >= 3"), "doc_id").filter(F.col("on_pages") >= least).select("doc_id", "checksum", "on_pages")
    )
    edge = ends.select("doc_id", F.explode(F.array(F.struct(F.col("first").alias("checksum"), F.lit(True).alias("head")), F.struct(F.col("last").alias("checksum"), F.lit(False).alias("head")))).alias("e")).select("doc_id", "e.*")
    roles = edge.groupBy("doc_id", "checksum").agg(F.bool_or("head").alias("is_header"), F.bool_or(~F.col("head")).alias("is_footer"))
    return many.join(roles, ["doc_id", "checksum"])


def without_furniture(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks without page headers and footers; key-value groups and numbered section headings stay."""
    gone = furniture(blocks, pages).select("doc_id", "checksum")
    keep = (F.col("type") == "key_value_group") | ((F.col("type") == "heading") & F.col("content").rlike(text.NUMBERED_SECTION))
    b = blocks.withColumn("checksum", ids.checksum(F.col("content")))
    return b.join(gone.withColumn("_gone", F.lit(True)), ["doc_id", "checksum"], "left").filter(F.col("_gone").isNull() | keep).drop("_gone", "checksum")


def merged_headings(blocks: DataFrame) -> DataFrame:
    """Runs of headings of one level on one page become one heading when all are short and so is the result."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    same = (F.col("type") == "heading") & (F.lag("type").over(w) == "heading") & F.col("level").eqNullSafe(F.lag("level").over(w)) & F.col("page").eqNullSafe(F.lag("page").over(w))
    run = blocks.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    r = Window.partitionBy("doc_id", "_run")
    total = F.sum(F.length("content")).over(r) + F.count("*").over(r) - 1
    joins = (F.count("*").over(r) > 1) & (F.max(F.length("content")).over(r) < SHORT) & (total < HEADING_RUN)
    run = run.withColumn("_one", joins).withColumn("_run", F.when(F.col("_one"), F.struct("_run", F.lit(0).alias("i"))).otherwise(F.struct("_run", F.col("idx").alias("i"))))
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda x: x["content"]), " ")
    return run.groupBy("doc_id", "_run").agg(
        F.min("idx").alias("idx"), F.first("type").alias("type"), text_of.alias("content"), F.first("level").alias("level"), F.first("page").alias("page"), F.count("*").cast("int").alias("parts")
    ).drop("_run")


def merge_fragments(blocks: Column) -> Column:
    """Pairs of neighbouring paragraphs of one page, the first short, become one block; a merged block takes part in no
    further pair. Blocks without a page are left alone. One pass over the array; only where a pair ends is remembered."""
    return let(blocks, _merge_bound)


def _merge_bound(blocks: Column) -> Column:
    n = F.size(blocks)

    def pairs(i: Column) -> Column:
        a, b = F.get(blocks, i), F.get(blocks, i + 1)
        return (
            (a["type"] == "paragraph") & a["page"].isNotNull() & (F.length(a["content"]) < SHORT) & (b["type"] == "paragraph")
            & (b["page"] == a["page"]) & (F.length(a["content"]) + 1 + F.length(b["content"]) <= MERGED)
        )

    # candidates in a row (0, 1, 2 ...) pair alternately from the first: pair at i iff the run of candidates up to i has odd length
    can = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(pairs(i), F.lit(False)))
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(False).alias("taken"), F.lit(0).alias("i"))
    starts = F.aggregate(
        can, zero,
        lambda s, c: F.struct(
            F.when(c & ~s["taken"], F.array_append(s["starts"], s["i"])).otherwise(s["starts"]).alias("starts"),
            (c & ~s["taken"]).alias("taken"), (s["i"] + 1).alias("i"),
        ),
        lambda s: s["starts"],
    )
    # the blocks between two pairs are copied whole; each pair is one block
    def joined(starts: Column) -> Column:
        edges = F.concat(F.array(F.lit(-2)), starts, F.array(n))
        parts = F.transform(edges, lambda s, k: F.concat(
            F.when((s >= 0) & (s < n), F.array(F.get(blocks, s).withField("content", F.concat(F.get(blocks, s)["content"], F.lit(" "), F.get(blocks, s + 1)["content"])))).otherwise(F.slice(blocks, 1, 0)),
            F.when(s < n, F.slice(blocks, s + 3, F.coalesce(F.get(edges, k + 1), n) - s - 2)).otherwise(F.slice(blocks, 1, 0)),
        ))
        return F.flatten(parts)

    return F.when(n > 0, let(starts, joined)).otherwise(blocks)


def to_markdown(kind: Column, content: Column, level: Column, language: Column, note: Column, export: bool = False) -> Column:
    """A block as markdown. An export quotes every line and draws page breaks; a chunk quotes the first line only."""
    quoted = F.concat(F.lit("> "), F.replace(content, F.lit("\n"), F.lit("\n> "))) if export else F.concat(F.lit("> "), content)
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), content))
        .when(kind == "code_block", F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), content, F.lit("\n```")))
        .when(kind == "blockquote", quoted)
        .when(kind == "admonition", F.concat(F.lit("> **"), F.upper(F.coalesce(note, F.lit("note"))), F.lit("**: "), content))
        .when(kind == "image", F.concat(F.lit("!["), content, F.lit("]")))
        .when(kind == "page_break", F.lit("---" if export else ""))
        .otherwise(content)
    )
