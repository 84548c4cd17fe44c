"""Chunks: neighbouring blocks up to a token budget, cut at headings, with an optional overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .blocks import to_markdown

MAX_TOKENS, MIN_TOKENS = 512, 50
#: Blocks of these kinds are chunks by themselves.
ALONE = ("key_value_group", "structured_table")


def _state(start: Column, tokens: Column, i: Column, done: Column, last: Column) -> Column:
    return F.struct(start.alias("start"), tokens.alias("tokens"), i.alias("i"), done.alias("done"), last.alias("last"))


def spans(blocks: Column, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, overlap: int = 0) -> Column:
    """Array of (first block, block after the last) of each chunk; ``blocks``: array of (type, tokens, ...).

    A heading begins a chunk. Other blocks join the chunk unless it would pass ``max_tokens`` and already has
    ``min_tokens``. After such a cut the next chunk repeats the last blocks of this one that fit ``overlap``. Blocks of
    the kinds in ALONE are a chunk each. The fold's state is a few numbers and the list of spans.
    """
    pair = "array<struct<a:int,b:int>>"
    zero = _state(F.lit(0), F.lit(0), F.lit(0), F.array().cast(pair), F.lit(None).cast("string"))

    def closed(s: Column) -> Column:
        span = F.struct(s["start"].alias("a"), s["i"].alias("b"))
        return F.when(s["start"] < s["i"], F.array_append(s["done"], span)).otherwise(s["done"])

    def step(s: Column, b: Column) -> Column:
        kind, n, i = b["type"], b["tokens"], s["i"]
        alone = kind.isin(*ALONE)
        own = F.array_append(closed(s), F.struct(i.alias("a"), (i + 1).alias("b")))
        full = (s["tokens"] + n > max_tokens) & (s["tokens"] >= min_tokens)
        if overlap:
            tail = F.aggregate(
                F.reverse(F.slice(blocks, s["start"] + 1, i - s["start"])),
                F.struct(F.lit(0).alias("sum"), F.lit(0).alias("k"), F.lit(True).alias("open")),
                lambda t, x: F.when(t["open"] & (t["sum"] + x["tokens"] <= overlap), F.struct((t["sum"] + x["tokens"]).alias("sum"), (t["k"] + 1).alias("k"), F.lit(True).alias("open")))
                .otherwise(F.struct(t["sum"].alias("sum"), t["k"].alias("k"), F.lit(False).alias("open"))),
            )
            cut = _state(i - tail["k"], tail["sum"] + n, i + 1, closed(s), kind)
        else:
            cut = _state(i, n, i + 1, closed(s), kind)
        return (
            F.when(kind == "heading", _state(i, n, i + 1, closed(s), kind))
            .when(alone, _state(i + 1, F.lit(0), i + 1, own, kind))
            .when(full, cut)
            .otherwise(_state(s["start"], s["tokens"] + n, i + 1, s["done"], kind))
        )

    return F.aggregate(blocks, zero, step, closed)


def chunked(docs: DataFrame, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, overlap: int = 0) -> DataFrame:
    """(doc_id, chunk, heading, content, token_count, first_block, n_blocks) of (doc_id, blocks).

    One row a chunk, made in place from each document's array of blocks: no shuffle. heading is the last heading at or
    before the chunk. Documents without blocks have no chunk.
    """
    none = F.lit(None).cast("string")
    sized = docs.select("doc_id", F.transform("blocks", lambda b: F.struct(
        b["type"].alias("type"), text.count_tokens(to_markdown(b["type"], b["content"], b["level"], none, none)).alias("tokens"), b["content"].alias("content"), b["level"].alias("level")
    )).alias("b"))
    cut = sized.select("doc_id", "b", F.posexplode_outer(spans(F.col("b"), max_tokens, min_tokens, overlap)).alias("chunk", "s")).filter("chunk is not null")
    part = F.slice("b", F.col("s.a") + 1, F.col("s.b") - F.col("s.a"))
    content = F.array_join(F.transform(part, lambda b: to_markdown(b["type"], b["content"], b["level"], none, none)), "\n\n")
    # within the chunk a heading can only be its first block; else the nearest one before it
    heads = F.filter(F.slice("b", F.lit(1), F.col("s.a") + 1), lambda b: b["type"] == "heading")
    return cut.select(
        "doc_id", "chunk", F.get(heads, F.size(heads) - 1)["content"].alias("heading"), content.alias("content"),
        F.col("s.a").alias("first_block"), (F.col("s.b") - F.col("s.a")).alias("n_blocks"),
    ).withColumn("token_count", text.count_tokens(F.col("content")))


CONFIDENCES = ("extracted", "inferred", "ambiguous")


def confidence_summary(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, and for each confidence its count and the block ids in order) of chunks' blocks (keys, block_id, confidence)."""
    c = F.col("confidence")
    each = [x for k in CONFIDENCES for x in (F.count_if(c == k).alias(k), F.array_sort(F.collect_list(F.when(c == k, F.col("block_id")))).alias(f"{k}_ids"))]
    return blocks.groupBy(*keys).agg(*each)
