"""Whether pages should have tables, and tables that are page furniture: experimental signals, which change no score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

CAPTION = r"(?i)\btable\s+\S+"
NUMBER = r"^[-+]?[0-9,]+(?:\.[0-9]+)?%?$"
LEADERS = r"\.{4,}|(?:\. ){3,}"
LEAST_LINES = 3
MARGIN, SHORT_CELL, SHORT_SHARE = 0.10, 6, 0.45


def table_expectation(blocks: DataFrame, rejected: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, page, signals, expected, confidence) of every page with a block or a rejected candidate.

    blocks: (doc_id, page, type, content); rejected: (doc_id, page, reason); docs: (doc_id, label). Signals by family:
    rejected_candidate (parser), caption_nearby and numeric_alignment (text), leader_dots (content), doc_table_heavy
    (archetype). Two families make a table expected, but a rejected candidate and aligned numbers alone see the same thing;
    confidence is the share of the four families.
    """
    lines = F.filter(F.split("content", "\n"), lambda x: text.strip(x) != "")
    numeric = F.filter(lines, lambda x: (F.size(F.split(text.strip(x), r"\s+")) >= 3) & (F.size(F.filter(F.split(text.strip(x), r"\s+"), lambda t: t.rlike(NUMBER))) >= 2))
    para = F.col("type") == "paragraph"
    b = blocks.groupBy("doc_id", "page").agg(
        F.bool_or(F.col("type").isin("paragraph", "heading", "caption") & F.col("content").rlike(CAPTION)).alias("caption"), F.sum(F.when(para, F.size(numeric)).otherwise(0)).alias("numeric"),
        F.sum(F.when(para, F.size(F.filter(lines, lambda x: x.rlike(LEADERS)))).otherwise(0)).alias("dots"), F.bool_or(F.col("type") == "table").alias("has"),
    )
    r = rejected.groupBy("doc_id", "page").agg(F.count("*").alias("rejected"), F.bool_or(F.col("reason") == "dot_leader").alias("rejected_dots"))
    p = b.join(r, ["doc_id", "page"], "full").join(docs.select("doc_id", "label"), "doc_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    fires = {
        "rejected_candidate": yes(F.col("rejected") > 0), "caption_nearby": yes(F.col("caption")), "numeric_alignment": yes(F.col("numeric") >= LEAST_LINES),
        "leader_dots": yes(F.col("rejected_dots")) | yes(F.col("dots") >= LEAST_LINES), "doc_table_heavy": yes(F.col("label") == "table_heavy") & ~yes(F.col("has")),
    }
    p = p.withColumns({f"_{k}": v for k, v in fires.items()})
    s = lambda k: F.col(f"_{k}")
    words = s("caption_nearby") | s("numeric_alignment")
    families = sum((c.cast("int") for c in (s("rejected_candidate"), words, s("leader_dots"), s("doc_table_heavy"))), F.lit(0))
    same = s("rejected_candidate") & s("numeric_alignment") & ~s("caption_nearby") & ~s("leader_dots") & ~s("doc_table_heavy")
    expected = F.when((families >= 2) & ~same, "true").when(families > 0, "unknown").otherwise("false")
    signals = F.filter(F.array(*[F.when(s(k), F.lit(k)) for k in fires]), lambda x: x.isNotNull())
    return p.select("doc_id", "page", signals.alias("signals"), expected.alias("expected"), (families / 4).alias("confidence"))


def furniture_table(content: Column, y0: Column, y1: Column, height: Column) -> Column:
    """Whether a table in markdown lies in the top or bottom tenth of its page and mostly has cells of six characters or fewer."""
    rows = F.filter(F.split(content, "\n"), lambda x: ~text.strip(x).rlike(r"^[|:\- ]*$"))
    cells = F.filter(F.flatten(F.transform(rows, lambda x: F.split(x, r"\|"))), lambda c: text.strip(c) != "")
    short = F.size(F.filter(cells, lambda c: F.length(F.replace(text.strip(c), F.lit(" "), F.lit(""))) <= SHORT_CELL)) / F.nullif(F.size(cells), F.lit(0))
    return F.coalesce((height > 0) & ((y0 < height * MARGIN) | (y1 > height - height * MARGIN)) & (short >= SHORT_SHARE), F.lit(False))


def interleaved(blocks: DataFrame, images: int = 20) -> DataFrame:
    """(doc_id, part, type, text): a document for a model that takes text and images, text joined between the images.

    blocks: (doc_id, idx, type, content, has_image). The first ``images`` blocks with an image are parts of their own and
    their content follows as a caption; other image blocks are named in the text.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("idx")
    image = (F.col("type") == "image") & F.coalesce("has_image", F.lit(False))
    b = blocks.withColumn("_n", F.sum(image.cast("int")).over(w)).withColumn("_in", image & (F.col("_n") <= images))
    b = b.withColumn("_part", F.sum(F.col("_in").cast("int")).over(w))
    content = F.coalesce("content", F.lit(""))
    t = F.when(F.col("type") == "image", F.when(content == "", "").when(F.col("_in"), F.concat(F.lit("*"), content, F.lit("*"))).otherwise(F.concat(F.lit("[Image: "), content, F.lit("]")))).otherwise(content)
    texts = b.withColumn("_t", t).filter(text.strip(F.col("_t")) != "").groupBy("doc_id", "_part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "_t"))), lambda x: x["_t"]), "\n\n").alias("text"))
    parts = b.filter("_in").select("doc_id", (F.col("_part") * 2).alias("_at"), F.lit("image").alias("type"), content.alias("text")).unionByName(texts.select("doc_id", (F.col("_part") * 2 + 1).alias("_at"), F.lit("text").alias("type"), "text"))
    return parts.withColumn("part", F.row_number().over(Window.partitionBy("doc_id").orderBy("_at"))).select("doc_id", "part", "type", "text")
