"""Operator 10: passages and paragraphs that repeat across documents, by MinHash banding over paragraphs.

A paragraph is a line. Two granularities are searched:

* Whole paragraphs of PARAGRAPH_WORDS words or more: MinHash over word bigrams, bands tuned for the recall asked at the
  threshold, colliding paragraphs joined, exact Jaccard verified, groups formed by connected components.
* Passages anywhere: a text is cut where a word pair's hash is the least of its neighbourhood (the one-row MinHash of
  that window), so equal passages are cut equally wherever they stand and however their lines are wrapped. It is cut a
  second time with line breaks as forced cuts, for short passages of whole lines. Windows of two pieces or more, each
  overlapping the next by a piece, join on the hash of all their words, which is Jaccard 1; overlapping windows kept by
  the same document make up a passage.

In each group the document of least doc_id keeps its text; every other occurrence is a removal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._near import band_keys, binary_array, groups, list_array
from ._shared import portions, small, written
from ._words import U64, bags, mix, shingles, span_hashes, text_slices, words
from .minhash_dedup import occurrence_sets

THRESHOLD, RECALL, ROWS = 0.75, 0.97, 4
#: Words of the least paragraph compared, and of the least removal that one other document holds whole.
PARAGRAPH_WORDS = MIN_WORDS = 16
#: Words on either side that decide a cut; words of the least piece at an edge; words of the least window that is joined.
REACH, PIECE_WORDS, WINDOW_WORDS = 3, 3, 8


def tuned_bands(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` values that finds a pair at the threshold with probability ``recall``."""
    return int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sliced(texts: pa.Array) -> Iterator[tuple]:
    """Per slice: rows, offsets, words (hash, row, start, end), number of line breaks before each word, bytes."""
    for first, last, data, offsets in text_slices(texts, lower=False):
        data = _LOWER[data]  # ASCII only: byte positions stay those of the text
        h, row, s, e = words(data, offsets)
        if len(h):
            yield first, last, data, offsets, h, row, s, e, np.cumsum(data == 10)[s]


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and the word after the last of the runs that begin where ``new`` is set."""
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(new))


def _lines(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    return new


def cuts(h: np.ndarray, paragraph: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Whether the pair of words at each place has the least hash among those ``reach`` places around it in its
    paragraph. No cut leaves fewer than PIECE_WORDS at a paragraph's beginning or end."""
    pair = h.copy()
    pair[:-1] = mix(h[:-1] * U64(0x9FB21C651E98DF25) + h[1:])
    pair[-1:] = pair[:-1][paragraph[1:] != paragraph[:-1]] = U64((1 << 64) - 1)
    least = pair != U64((1 << 64) - 1)
    for k in range(1, reach + 1):
        apart = paragraph[k:] != paragraph[:-k]
        least[k:] &= apart | (pair[k:] < pair[:-k])
        least[:-k] &= apart | (pair[:-k] <= pair[k:])
        if k == PIECE_WORDS:
            least[k:] &= ~apart
        if k == PIECE_WORDS - 1:
            least[:-k] &= ~apart
    least[:PIECE_WORDS] = least[1 - PIECE_WORDS :] = False
    return least


def _positions(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[pa.Array]:
    """Word and character positions of runs inside their texts."""
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    begin = np.searchsorted(row, np.arange(len(offsets)))
    r = row[first]
    base = chars[offsets[:-1]]
    return [pa.array(x, pa.int32()) for x in (first - begin[r], last - begin[r], chars[s[first]] - base[r], chars[e[last - 1]] - base[r])]


def windows(first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of the windows over pieces that begin at the words ``first``: from each piece
    on, two pieces or as many as WINDOW_WORDS words need, inside their row. A row of one piece is a window itself."""
    n = len(first)
    ends = np.append(first[1:], len(row))
    last = np.maximum(np.arange(n) + 1, np.searchsorted(ends, first + WINDOW_WORDS))
    inside = last < n
    last[~inside] = n - 1
    same = inside & (row[first] == row[first[last]])
    of = row[first]
    alone = np.ones(n, bool)
    alone[1:] &= of[1:] != of[:-1]
    alone[:-1] &= of[1:] != of[:-1]
    alone &= ends - first >= WINDOW_WORDS
    return np.append(first[same], first[alone]), np.append(ends[last[same]], ends[alone])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, _, data, offsets, h, row, s, e, line in _sliced(batch.column("text")):
            # cut over the whole text, where line breaks are white space, and line by line; most windows are the same
            spans = []
            for new in (_lines(row, np.zeros_like(line)), _lines(row, line)):
                first = np.flatnonzero(new | cuts(h, np.cumsum(new, dtype=np.int32)))
                spans.append(np.stack(windows(first, row)))
            both = np.concatenate(spans, 1)
            first, last = np.divmod(np.unique(both[0] * (len(h) + 1) + both[1]), len(h) + 1)
            if len(first):
                ids = batch.column("doc_id").take(pa.array(at + row[first]))
                key = pa.array(span_hashes(h, first, last).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids, key, *_positions(data, offsets, row, first, last, s, e)], ["doc_id", "key", "w0", "w1", "c0", "c1"])


def _paragraphs(batches: Iterator[pa.RecordBatch], give: str) -> Iterator[pa.RecordBatch]:
    """Paragraphs long enough: with their signatures, their bags or their positions."""
    bands = tuned_bands(THRESHOLD, RECALL)
    seeds = mix(np.arange(1, bands * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    for batch in portions(batches):
        for at, _, data, offsets, h, row, s, e, line in _sliced(batch.column("text")):
            first, last = _runs(_lines(row, line))
            long = last - first >= PARAGRAPH_WORDS
            first, last = first[long], last[long]
            if not len(first):
                continue
            node = pa.array(span_hashes(h, first, last).view(np.int64))
            if give == "place":
                ids = batch.column("doc_id").take(pa.array(at + row[first]))
                yield pa.RecordBatch.from_arrays([ids, node, *_positions(data, offsets, row, first, last, s, e)], ["doc_id", "node", "w0", "w1", "c0", "c1"])
                continue
            size = last - first
            which = np.repeat(np.arange(len(first)), size)
            word = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            g, p = shingles(h[word], which, len(first), 2)
            if give == "bag":
                yield pa.RecordBatch.from_arrays([node, occurrence_sets(*bags(g, p), len(first))], ["node", "bag"])
                continue
            starts = np.searchsorted(p, np.arange(len(first)))
            sig = np.empty((len(first), len(seeds)), U64)
            for k, seed in enumerate(seeds):
                sig[:, k] = np.minimum.reduceat(g * seed, starts)
            sig = mix(sig)
            low = (sig & U64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([node, list_array(band_keys(sig, bands)), binary_array(low, np.arange(len(first) + 1) * len(seeds))], ["node", "bands", "sig"])


def _near_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, w0, w1, c0, c1, kept_doc_id) of paragraphs that nearly repeat one of an earlier document."""
    text = docs.select("text")
    banded = written(text.mapInArrow(lambda b: _paragraphs(b, "sign"), "node long, bands array<long>, sig binary"), "paragraphs")

    def bags_of(nodes: DataFrame) -> DataFrame:
        all_bags = text.mapInArrow(lambda b: _paragraphs(b, "bag"), "node long, bag binary")
        return written(all_bags.join(small(nodes, 48), "node", "left_semi").groupBy("node").agg(F.first("bag").alias("bag")), "bags")

    labels = groups(banded, bags_of, THRESHOLD, THRESHOLD - 0.3)[1]
    places = docs.select("doc_id", "text").mapInArrow(lambda b: _paragraphs(b, "place"), "doc_id long, node long, w0 int, w1 int, c0 int, c1 int")
    found = written(places.join(small(labels, 64), "node").drop("node"), "places")
    least = found.groupBy("label").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("hi")).filter("kept_doc_id < hi").drop("hi")
    return found.join(least, "label").filter("doc_id <> kept_doc_id").drop("label")


def _joined(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of equal ``keys`` joined where they overlap, or where they touch if they are passages already."""
    w = Window.partitionBy(*keys).orderBy("w0", "w1")
    before = F.max("w1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("w0") > before if keys == ["doc_id"] else F.col("w0") >= before
    return (
        spans.withColumn("region", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "region")
        .agg(F.min("w0").alias("w0"), F.max("w1").alias("w1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.collect_set("kept_doc_id").alias("kept"))
        .drop("region")
    )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row for each removal: doc_id, start and end (characters, end exclusive), n_words, kept_doc_ids.

    A removal is made up of passages of MIN_WORDS words or more, each kept by one document of lower doc_id: kept_doc_ids
    lists these. Passages that overlap or touch are one removal. A passage may begin and end up to about ten words
    inside the repetition, at the first cut. Letter case (of ASCII), punctuation and spacing are ignored. Repetition inside one document is no
    repetition across documents and is not reported; rows with the same doc_id count as one document. Rows whose text
    or doc_id is null are ignored; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    found = docs.mapInArrow(_windows, "doc_id long, key long, w0 int, w1 int, c0 int, c1 int")
    # keys alone are aggregated first, with map-side combining: a window in millions of documents is one row a task
    shared = found.groupBy("key").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("hi")).filter("kept_doc_id < hi").drop("hi")
    exact = found.join(shared, "key").filter("doc_id <> kept_doc_id").drop("key")
    held = _joined(exact, ["doc_id", "kept_doc_id"]).filter(F.col("w1") - F.col("w0") >= MIN_WORDS).drop("kept")
    spans = held.unionByName(_near_lines(docs))
    return _joined(spans, ["doc_id"]).select(
        "doc_id", F.col("c0").alias("start"), F.col("c1").alias("end"), (F.col("w1") - F.col("w0")).alias("n_words"), F.array_sort("kept").alias("kept_doc_ids")
    )


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the documents table that repeats one of an earlier document."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
