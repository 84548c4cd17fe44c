"""Operator 7: near-duplicate documents by BagMinHash signatures over weighted word bigrams.

Each distinct bigram with multiplicity w owns the weight axis [0, w), cut at 1, 2, 4, 8 ...: every dyadic interval has
its own seeded Poisson process in time, and a point lies at a place in its interval, so that a bigram with a larger
weight sees a superset of the points. A signature value is the earliest point of its component. Two signatures agree in
a component with a probability equal to the weighted Jaccard similarity sum(min)/sum(max). Points are drawn in rounds,
and a process stops once its time passes the latest value of the document's signature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._near import band_keys, binary_array, groups, list_array
from ._shared import portions, small, written
from ._words import U64, bags, mix, shingles, text_slices, words

SIZE, BANDS, SHINGLE = 128, 32, 2
#: A pair is a near copy at this exact weighted Jaccard of its bigrams: about one word in eight replaced.
THRESHOLD = 0.6
DOUBT = 0.42


def bagminhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, m: int = SIZE) -> np.ndarray:
    """(rows, m) signature values of the rows' weighted elements; a row without any keeps the value of infinity."""
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1
    who = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(who)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level == 0, 1.0, np.exp2(level - 1.0))
    low = np.where(level == 0, 0.0, width)
    whole = low + width <= weight[who]
    key = mix(element[who] + level.astype(U64) * U64(0xD6E8FEB86659FD93))
    doc, weight = row[who], weight[who]
    time = np.zeros(len(who))
    best = np.full(rows * m, np.inf)
    turn = 0
    while len(doc):
        turn += 1
        draw = mix(key + U64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log1p(-(draw >> U64(11)).astype(np.float64) * 2.0**-53) / width
        place = mix(draw + U64(0xA0761D6478BD642F))
        inside = whole | (low + (place >> U64(32)).astype(np.float64) * 2.0**-32 * width < weight)
        at = doc * m + (place & U64(m - 1)).astype(np.int64)
        np.minimum.at(best, at[inside], time[inside])
        live = time < best.reshape(rows, m).max(axis=1)[doc]
        if not live.all():
            doc, weight, time, key, width, low, whole = (x[live] for x in (doc, weight, time, key, width, low, whole))
    return best.reshape(rows, m)


def _bag(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for first, last, data, offsets in text_slices(texts):
        h, row, _, _ = words(data, offsets)
        yield first, last, *bags(*shingles(h, row, last - first, SHINGLE))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        for first, last, row, element, weight in _bag(batch.column("text")):
            some = np.unique(row)
            if not len(some):
                continue
            values = bagminhash(np.searchsorted(some, row), element, weight, len(some)).view(U64)
            values = mix(values)
            sig = (values & U64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(first + some)), list_array(band_keys(values, BANDS)), binary_array(sig, np.arange(len(some) + 1) * SIZE)],
                ["node", "bands", "sig"],
            )


def occurrence_sets(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int) -> pa.Array:
    """The multisets as sorted 32-bit hashes of (element, occurrence), one binary value a row."""
    n = weight.astype(np.int64)
    who = np.repeat(np.arange(len(row)), n)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    key = row[who].astype(U64) << U64(32) | mix(element[who] + (nth.astype(U64) << U64(44))) >> U64(32)
    key.sort()
    return binary_array((key & U64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(key >> U64(32), np.arange(rows + 1).astype(U64)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        for first, last, row, element, weight in _bag(batch.column("text")):
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(first, last - first), occurrence_sets(row, element, weight, last - first)], ["node", "bag"]
            )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("text")).filter("text rlike '[\\\\p{L}\\\\p{N}]'").withColumn("node", F.xxhash64("text"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, label) for every text of a group of two or more distinct near-copy texts; node is xxhash64(text)."""
    keyed = _keyed(docs).select("node", "text")
    banded = written(keyed.mapInArrow(_sign, "node long, bands array<long>, sig binary"), "signed")

    def texts_of(nodes: DataFrame) -> DataFrame:
        some = keyed.join(small(nodes, 48), "node", "left_semi")
        return written(some.mapInArrow(_bags, "node long, bag binary").groupBy("node").agg(F.first("bag").alias("bag")), "bags")

    return groups(banded, texts_of, threshold, min(DOUBT, threshold))[1]


def grouped(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, label, n, kept_doc_id, kept_node) of each distinct (doc_id, text) in a group of several rows.

    label names the group; n is how many rows share this doc_id and text; the kept row of a group is the one with the
    least doc_id (null last), then the least text hash.
    """
    ids = _keyed(docs).groupBy("node", "doc_id").agg(F.count("*").alias("n"))
    labelled = ids.join(near_groups(docs, threshold), "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("text"))
    least = labelled.groupBy("label").agg(F.min(order).alias("kept"), F.sum("n").alias("size")).filter("size > 1")
    return labelled.join(least, "label").select(
        "doc_id", "node", "label", "n", F.col("kept.id").alias("kept_doc_id"), F.col("kept.text").alias("kept_node")
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, kept_doc_id): one row for each row of ``docs`` that repeats, exactly or nearly, the kept one.

    Groups are the connected components of pairs whose bigram multisets have a weighted Jaccard of ``threshold`` or
    more, equal texts included; the kept row is the one of least doc_id. Texts that are null or hold no letter or digit
    are in no group. Rows repeated with the same doc_id and text appear once for each repetition beyond the first.
    Texts of one word have that word as their only element. Other columns of ``docs`` are not read. Texts are told
    apart by a 64-bit hash: among 30 billion documents about 24 pairs of different texts are expected to share one.
    """
    g = grouped(docs, threshold)
    kept = (F.col("doc_id").eqNullSafe(F.col("kept_doc_id"))) & (F.col("node") == F.col("kept_node"))
    times = F.col("n") - F.when(kept, 1).otherwise(0)
    return g.filter(times > 0).select("doc_id", "kept_doc_id", F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("_")).drop("_")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group, all columns as they were; rows in no group stay.

    Only the rows that go are sent to the filter (broadcast when counted small), so the texts that stay are not moved.
    """
    g = written(grouped(docs, threshold), "grouped")
    h, node, key, one = (_fresh(docs, x) for x in ("hash", "node", "id", "one"))
    kept = (F.col("doc_id").eqNullSafe(F.col("kept_doc_id"))) & (F.col("node") == F.col("kept_node"))
    gone = g.filter(~kept | (F.col("n") > 1)).select(F.col("doc_id").alias(key), F.col("node").alias(node), (kept & (F.col("n") > 1)).alias(one))
    marked = docs.withColumn(h, F.xxhash64("text"))
    same = (F.col(h) == F.col(node)) & F.col("doc_id").eqNullSafe(F.col(key))
    stay = marked.join(small(gone.select(key, node), 96), same, "left_anti").drop(h)
    repeated = gone.filter(one)
    if not repeated.limit(1).count():
        return stay
    # the kept row itself occurs several times: one of the repetitions returns
    back = marked.join(small(repeated.select(key, node), 96), same, "left_semi").dropDuplicates(["doc_id", h]).drop(h)
    return stay.unionByName(back)


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, in any letter case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table that repeats another, with the document kept in its place."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
