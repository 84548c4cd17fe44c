"""Whole corpora: 64-value MinHash duplicates, status of files, packing into token budgets, the ledger."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.shared import small, written

PERMUTATIONS, SHINGLE = 64, 5
BUDGET = 60_000
LEDGER_KEEP, LEDGER_FULL = 10_000, 12_000
_PRIME = (1 << 61) - 1
_LOW = np.uint64(0xFFFFFFFF)
WORD = r"[\p{L}\p{N}_]+"
_word = re.compile(r"\w+")


def coefficients(n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """(a, b) of each permutation, from a chain of SHA-1 digests that begins with zero."""
    out: dict[int, int] = {}
    h = 0
    while len(out) < n:
        h = int.from_bytes(hashlib.sha1((h % (1 << 64)).to_bytes(8, "big"), usedforsecurity=False).digest(), "big")
        out.setdefault(h % (1 << 32) | 1, (h >> 32) % (1 << 32))
    return list(out.items())


def shingles(c: Column, k: int = SHINGLE) -> Column:
    """Array of the k-word shingles of the lower-cased words; a text of fewer words has one shingle of all of them."""
    return let(F.regexp_extract_all(F.lower(c), F.lit(WORD), 0), lambda words: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " ")
    ))


def shingle_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n, different, least) of each document's shingles. Null texts have none.

    Shingles are several times their text, so they are counted where they are and one row a document is shuffled. Only
    the texts of ids that occur in several rows are brought together, for the shingles that these have in common.
    """
    docs = docs.filter("text is not null").select("doc_id", "text")
    grams = docs.select("doc_id", shingles(F.col("text")).alias("_g"))
    own = grams.select("doc_id", F.size("_g").cast("long").alias("n"), F.size(F.array_distinct("_g")).cast("long").alias("different"), F.array_min("_g").alias("least"))
    out = own.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("different").alias("different"), F.min("least").alias("least"))
    again = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_id")
    if again.isEmpty():
        return out
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    shared = docs.join(small(again, 16), same, "left_semi").select("doc_id", F.explode_outer(shingles(F.col("text"))).alias("_s"))
    shared = shared.groupBy(F.col("doc_id").alias("_id")).agg(F.countDistinct("_s").alias("_all"))
    joined = out.join(shared, same, "left")
    return joined.select("doc_id", "n", F.coalesce("_all", "different").alias("different"), "least")


def _signer():
    a, b = (np.array(x, np.uint64)[:, None] for x in zip(*coefficients()))
    prime = np.uint64(_PRIME)

    def signature(h: np.ndarray) -> np.ndarray:
        low = np.full(len(a), 0xFFFFFFFF, np.uint64)
        for at in range(0, len(h), 1 << 14):
            # a and h are below 2^32, so the product fits; modulo 2^61 - 1 by folding the high bits
            x = a * h[None, at : at + (1 << 14)]
            x = (x & prime) + (x >> np.uint64(61)) + b
            x = np.where(x >= prime, x - prime, x)
            low = np.minimum(low, (x & _LOW).min(axis=1))
        return low.astype(np.int64)

    return signature


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, sig): the 64 least permuted hashes of each text's shingles. One pass over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _signer()
        for batch in batches:
            sigs = []
            for text in batch.column("text").to_pylist():
                w = _word.findall(text.lower())
                grams = {" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}
                first = b"".join(hashlib.sha1(v.encode(), usedforsecurity=False).digest()[:4] for v in grams)
                sigs.append(sign(np.frombuffer(first, ">u4").astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "sig"])

    # whole texts are sent, a fifth of what their shingles would be
    return docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sig array<long>")


def agreeing(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def duplicates(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, duplicate_of): documents of which an earlier one (in doc_id order, itself a duplicate or not) is a near
    copy; duplicate_of is the earliest.

    The reference's banding makes its default (up to 0.6) mean equal signatures, and from 0.7 on any equal value a
    candidate, kept when the share of equal values reaches the threshold. Both are computed exactly: equal signatures
    are one group; for a threshold of t values at most 64 - t differ, so one of 64 - t + 1 bands must agree whole, and
    those bands replace the single values as join keys.
    """
    # the signatures cost the most and are read several times: they are written once
    sigs = written(signatures(docs), "signatures")
    least = sigs.groupBy("sig").agg(F.min("doc_id").alias("first"))
    if threshold < 0.65:
        return sigs.join(least, "sig").filter(F.col("doc_id") > F.col("first")).select("doc_id", F.col("first").alias("duplicate_of"))
    need = int(np.ceil(threshold * PERMUTATIONS - 1e-9))
    edges = np.linspace(0, PERMUTATIONS, PERMUTATIONS - need + 2).round().astype(int)
    bands = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", int(s) + 1, int(e - s))) for i, (s, e) in enumerate(zip(edges, edges[1:]))])
    keyed = least.select("sig", "first", F.explode(bands).alias("band"))
    several = keyed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    keyed = written(keyed.join(several, "band", "left_semi"), "bands")
    pair = keyed.alias("x").join(keyed.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("y.first") < F.col("x.first")))
    near = pair.filter(agreeing(F.col("x.sig"), F.col("y.sig")) >= need).groupBy(F.col("x.first").alias("first")).agg(F.min("y.first").alias("before"))
    return (
        sigs.join(least, "sig").join(near, "first", "left")
        .withColumn("duplicate_of", F.least("first", "before")).filter(F.col("doc_id") > F.col("duplicate_of")).select("doc_id", "duplicate_of")
    )


def status(files: DataFrame, extensions: list[str]) -> DataFrame:
    """files (source, extension, error, text, is_duplicate) with ``category``: the first that holds of unsupported,
    failed, low_quality, duplicate, processed."""
    return files.withColumn("category", (
        F.when(~F.coalesce(F.lower("extension").isin(*extensions), F.lit(False)), "unsupported").when(F.col("error").isNotNull(), "failed")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "low_quality").when(F.coalesce("is_duplicate", F.lit(False)), "duplicate").otherwise("processed")
    ))


def _jumps(tokens: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(running sums, packs, rest): how many packs a pack that begins at each row and those after it make up to the last
    row, and how full the last one is."""
    m = len(tokens)
    cum = np.concatenate(([0], np.cumsum(tokens, dtype=np.int64)))
    over = np.searchsorted(cum, cum[:-1] + budget, "right")
    # the row that goes over begins a pack, unless the pack has no token yet: then the row after it does
    after = np.where(cum[over - 1] > cum[:-1], over - 1, over)
    packs, rest = np.ones(m + 1, np.int64), np.zeros(m + 1, np.int64)
    rest[:m] = cum[m] - cum[:m]
    for i, j in zip(range(m - 1, -1, -1), after[::-1].tolist()):
        if j < m:
            packs[i], rest[i] = packs[j] + 1, rest[j]
    return cum, packs, rest


def packed(sizes: DataFrame, group: str, order: str, budget: int = BUDGET) -> DataFrame:
    """sizes (group, order, tokens) with ``pack``, numbered from 0 within the group: next fit in order.

    A document above the budget is a pack by itself. Rows are range-partitioned by group and order, so that a group that
    holds a third of all rows is many parts. What a part does to the pack that reaches it depends only on the first
    row that no longer fits; each part's answer for every such row (at most ``budget`` different ones) is computed apart,
    one pass over two rows a part then says how full the pack before each part is, and the parts number their packs.
    """
    spark = sizes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = sizes.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col("tokens").cast("long").alias("_t"))
    rows = written(rows.repartitionByRange(parts, "_g", "_o").withColumn("_p", F.spark_partition_id()), "parts")
    lists = "total long, packs long, rest long, sums array<long>, packs_at array<long>, rest_at array<long>"
    kind = rows.schema["_g"].dataType.simpleString()

    def segments(tables: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, object, np.ndarray]]:
        """(part, group, tokens) of each group of each part, in order."""
        now, held = None, []
        for batch in tables:
            p, g, t = batch.column("_p").to_pylist(), batch.column("_g").to_pylist(), batch.column("_t").to_numpy(zero_copy_only=False)
            edges = [0, *[i for i in range(1, len(p)) if p[i] != p[i - 1] or g[i] != g[i - 1]], len(p)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if held and now != (p[a], g[a]):
                        yield *now, np.concatenate(held)
                        held = []
                    now = (p[a], g[a])
                    held.append(t[a:b])
        if held:
            yield *now, np.concatenate(held)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(p: object, g: object, t: np.ndarray) -> pa.RecordBatch:
            cum, packs, rest = _jumps(t, budget)
            n = int(np.searchsorted(cum[1:], budget, "right")) + 1
            value = {"_g": g, "_p": p, "total": int(cum[-1]), "packs": int(packs[0]), "rest": int(rest[0]), "sums": cum[1:][:n].tolist(), "packs_at": packs[:n].tolist(), "rest_at": rest[:n].tolist()}
            return pa.RecordBatch.from_pylist([value], schema=schema)

        number = pa.int64()
        schema = None
        first, last = None, None
        for p, g, t in segments(batches):
            if schema is None:
                schema = pa.schema([("_g", seen[0]), ("_p", pa.int32()), ("total", number), ("packs", number), ("rest", number), *[(c, pa.list_(number)) for c in ("sums", "packs_at", "rest_at")]])
            if first != p:  # the first group of a part may go on from the one before, the last into the next
                if last:
                    yield row(*last)
                yield row(p, g, t)
                first, last = p, None
            else:
                last = (p, g, t)
        if last:
            yield row(*last)

    from pyspark.sql.pandas.types import to_arrow_type

    seen = [to_arrow_type(rows.schema["_g"].dataType)]
    ordered = rows.repartition(parts, "_p").sortWithinPartitions("_p", "_g", "_o")
    ends = written(ordered.mapInArrow(answers, f"_g {kind}, _p int, {lists}"), "ends")

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, full, base = object(), 0, 0
        for batch in batches:
            fulls, bases = [], []
            for r in batch.to_pylist():
                if r["_g"] != now:
                    now, full, base = r["_g"], 0, 0
                fulls.append(full)
                bases.append(base)
                if full == 0:
                    full, base = r["rest"], base + r["packs"] - 1
                else:
                    e = int(np.searchsorted(r["sums"], budget - full, "right"))
                    if e == len(r["sums"]):
                        full += r["total"]
                    else:
                        full, base = r["rest_at"][e], base + r["packs_at"][e]
            yield pa.RecordBatch.from_arrays([batch.column("_g"), batch.column("_p"), pa.array(fulls, pa.int64()), pa.array(bases, pa.int64())], ["_g", "_p", "_full", "_base"])

    # two rows a part, of bounded size, in order
    starts = written(ends.repartition(1).sortWithinPartitions("_g", "_p").mapInArrow(carried, f"_g {kind}, _p int, _full long, _base long"), "starts")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, pack = object(), 0, 0
        for batch in batches:
            out = []
            for p, g, n, full, base in zip(*(batch.column(c).to_pylist() for c in ("_p", "_g", "_t", "_full", "_base"))):
                if (p, g) != now:
                    now, total, pack = (p, g), full or 0, base or 0
                if total + n > budget and total > 0:
                    pack, total = pack + 1, 0
                total += n
                out.append(pack)
            yield pa.RecordBatch.from_arrays([batch.column("_g"), batch.column("_o"), batch.column("_t"), pa.array(out, pa.int64())], ["_g", "_o", "_t", "pack"])

    s = starts.select(F.col("_g").alias("_sg"), F.col("_p").alias("_sp"), "_full", "_base")
    with_start = rows.join(small(s, 64), (F.col("_p") == F.col("_sp")) & F.col("_g").eqNullSafe(F.col("_sg")), "left")
    done = with_start.select("_p", "_g", "_o", "_t", "_full", "_base").repartition(parts, "_p").sortWithinPartitions("_p", "_g", "_o")
    got = done.mapInArrow(numbered, f"_g {kind}, _o {rows.schema['_o'].dataType.simpleString()}, _t long, pack long")
    return got.select(F.col("_g").alias(group), F.col("_o").alias(order), F.col("_t").cast(sizes.schema["tokens"].dataType).alias("tokens"), "pack")


def packs(sizes: DataFrame, group: str, order: str, budget: int = BUDGET) -> DataFrame:
    """(group, pack, chunk_index, documents, token_count): packs numbered over all groups in order.

    The number before a group is the count of packs of the groups before it: a window over one row a group.
    """
    p = packed(sizes, group, order, budget).groupBy(group, "pack").agg(F.count("*").alias("documents"), F.sum("tokens").alias("token_count"))
    counts = p.groupBy(group).agg(F.count("*").alias("n"))
    offset = counts.select(group, F.coalesce(F.sum("n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return p.join(offset, group).select(group, "pack", (F.col("offset") + F.col("pack")).alias("chunk_index"), "documents", "token_count")


def ledger_stats(entries: DataFrame) -> DataFrame:
    """Totals of a ledger (file_type, original_tokens, optimized_tokens, elapsed_seconds) over all and by file type.

    file_type is null in the row over all. One aggregation with grouping sets.
    """
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("optimized_tokens"))
    out = entries.rollup("file_type").agg(
        F.count("*").alias("compilations"), F.sum("original_tokens").alias("original_tokens"), F.sum("optimized_tokens").alias("optimized_tokens"),
        F.sum(saved).alias("saved_tokens"), F.bround(F.sum("elapsed_seconds"), 1).alias("elapsed_seconds"),
    )
    share = F.when(F.col("original_tokens") > 0, F.bround((1 - F.col("optimized_tokens") / F.col("original_tokens")) * 100, 1)).otherwise(0.0)
    return out.withColumn("reduction_percent", share)


def ledger_compacted(entries: DataFrame, order: str) -> DataFrame:
    """The last LEDGER_KEEP entries once there are more than LEDGER_FULL; else all."""
    if entries.limit(LEDGER_FULL + 1).count() <= LEDGER_FULL:
        return entries
    return entries.orderBy(F.desc(order)).limit(LEDGER_KEEP)


def ledger_recent(entries: DataFrame, order: str, n: int = 10) -> DataFrame:
    return entries.orderBy(F.desc(order)).limit(n)
