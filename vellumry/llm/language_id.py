"""Operator 1: language identification by error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a binary linear classifier over hashed byte n-grams of
lower-cased letters (1 to 3 bytes). Decoding sums, over the bits, the logistic loss of the predicted margin against the
codeword's bit, weighted by how well that bit separates the training rows; the codeword of least loss wins. The gap to
the second codeword, in loss per bit, flags ambiguous texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import portions, small, written

#: Training rows per language, and of all languages together, at most; the only bounded sample of this operator.
TRAIN_ROWS, TRAIN_TOTAL = 400, 8000
#: Features: 2^BITS hashed n-grams.
BITS = 13
#: A decision is ambiguous below this gap, in logistic loss per bit of codeword.
GAP = 0.03
_SIZE = 1 << BITS
_STEP = 1 << 20

_FOLD = np.zeros(256, np.uint32)
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[97 + _c] = 97 + _c
    _FOLD[65 + _c] = 97 + _c


def features(raw: np.ndarray) -> np.ndarray:
    """Hashed n-gram numbers of a text's bytes; everything but letters counts as one blank."""
    c = _FOLD[raw]
    c = c[(c != 0) | np.append(True, c[:-1] != 0)] if len(c) else c
    c = np.concatenate(([0], c, [0])).astype(np.uint32)
    two = c[:-1] * np.uint32(0x01000193) ^ c[1:] * np.uint32(0x9E3779B1)
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
    return np.concatenate([(x * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS) for x in (c + np.uint32(7), two, three)])


def codewords(k: int) -> np.ndarray:
    """(k, bits) of -1 and 1: every split of the languages for few of them, else a fixed random code of wide distance."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        splits = [[1 if i == 0 or not (n >> (i - 1)) & 1 else -1 for i in range(k)] for n in range(1, 1 << (k - 1))]
        return np.array(splits, float).T
    bits, best, widest = int(10 * np.log2(k)) + 1, None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (k, bits))
        near = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        if near > widest and (np.abs(code.sum(0)) < k).all():
            best, widest = code, near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (features, bits)
    bias: np.ndarray
    trust: np.ndarray  # of each bit, summing to 1

    def margins(self, text: bytes) -> np.ndarray | None:
        """A margin for each bit, or None for a text without a letter."""
        raw = np.frombuffer(text, np.uint8)
        if not _FOLD[raw].any():
            return None
        total, n = np.zeros(self.weights.shape[1]), 0
        for at in range(0, len(raw), _STEP):  # only bounds memory: every byte counts
            f = features(raw[at : at + _STEP])
            total += self.weights[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        return total / n + self.bias

    def decode(self, margin: np.ndarray) -> np.ndarray:
        """The weighted loss of each language."""
        return (np.logaddexp(0, -self.code * margin) * self.trust).sum(1)


def shares(text: bytes) -> np.ndarray:
    """The share of each feature in a text."""
    count, raw = np.zeros(_SIZE, np.int64), np.frombuffer(text, np.uint8)
    for at in range(0, max(1, len(raw)), _STEP):
        count += np.bincount(features(raw[at : at + _STEP]), minlength=_SIZE)
    return (count / count.sum()).astype(np.float32)


def fit(texts: list[str], languages: list[str], steps: int = 150) -> Model:
    """``fit_shares`` of texts."""
    return fit_shares([shares(t.encode("utf-8", "replace")) for t in texts], languages, steps)


def fit_shares(rows: list[np.ndarray], languages: list[str], steps: int = 150) -> Model:
    """Ridge-regularised logistic regressions, one a bit, by full-batch gradient steps with momentum."""
    names = sorted(set(languages))
    code = codewords(len(names))
    if len(names) < 2:
        return Model(names, code, np.zeros((_SIZE, 1), np.float32), np.ones(1), np.ones(1))
    x = np.stack(rows)
    scale = np.sqrt((x**2).mean(0) + 1e-7)
    x /= scale
    total = np.sqrt((x**2).sum(1).mean())
    x /= total
    which = np.array([names.index(v) for v in languages])
    y = code[which].astype(np.float32)
    # every language weighs the same, however many rows it has
    row = (len(rows) / (len(names) * np.bincount(which)))[which].astype(np.float32)[:, None]
    w, vw = np.zeros((2, _SIZE, y.shape[1]), np.float32)
    b, vb = np.zeros((2, 1, y.shape[1]), np.float32)
    for _ in range(steps):
        g = -y * row / (1 + np.exp(y * (x @ w + b))) / len(rows)
        vw = 0.9 * vw - 2.0 * (x.T @ g + 1e-5 * w)
        vb = 0.9 * vb - 2.0 * g.sum(0)
        w, b = w + vw, b + vb
    trust = np.exp(-(np.logaddexp(0, -y * (x @ w + b)) * row).mean(0))
    return Model(names, code, (w / scale[:, None] / total).astype(np.float32), b[0].astype(float), trust / trust.sum())


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, lang): at most ``rows`` labelled rows a language, those of least hash; needs no shuffle of other texts.

    The hash covers the text, so that null and repeated ids are sampled like others; of every language with a labelled
    row at least the row of least hash is there, however often it repeats.
    """
    h = F.xxhash64("text", "lang", "doc_id")
    labelled = docs.select("text", "lang", h.alias("_h")).filter("lang is not null and text rlike '\\\\p{L}'")
    counts = written(labelled.groupBy("lang").agg(F.count("*").alias("_n"), F.min("_h").alias("_least")), "languages")
    languages = max(1, counts.count())
    rows = max(1, min(rows, TRAIN_TOTAL // languages))
    share = F.pmod("_h", F.lit(1 << 30)) / (1 << 30)
    some = labelled.join(small(counts, 96), "lang").filter((share * F.col("_n") < 2 * rows) | (F.col("_h") == F.col("_least")))
    order = Window.partitionBy("lang").orderBy("_h", "text")
    return some.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= rows).select("text", "lang")


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        rows = [shares(t.as_buffer()) for t in pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")]
        at = [np.flatnonzero(x) for x in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array([i.astype(np.uint16).tobytes() for i in at], pa.binary()), pa.array([x[i].tobytes() for x, i in zip(rows, at)], pa.binary())],
            ["lang", "place", "share"],
        )


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on the labelled rows of ``docs``; without any, the model knows no language and every text is undetermined.

    Texts stay where they are: the driver gets their features, whose size is bounded.
    """
    some = training_rows(docs, rows).mapInArrow(_shares, "lang string, place binary, share binary")
    x, languages = [], []
    for r in sorted(some.toLocalIterator(), key=lambda r: (r.lang, bytes(r.place), bytes(r.share))):
        x.append(np.zeros(_SIZE, np.float32))
        x[-1][np.frombuffer(r.place, np.uint16)] = np.frombuffer(r.share, np.float32)
        languages.append(r.lang)
    return fit_shares(x, languages)


def _verdicts(texts: pa.Array, model: Model) -> tuple[list, list, list]:
    best, gaps, ambiguous = [], [], []
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    for value in raw:
        margin = model.margins(value.as_buffer()) if model.languages else None
        if margin is None:
            best.append(None), gaps.append(0.0), ambiguous.append(True)
            continue
        loss = model.decode(margin)
        order = np.argsort(loss, kind="stable")
        gap = float(loss[order[1]] - loss[order[0]]) if len(order) > 1 else float("inf")
        best.append(model.languages[order[0]]), gaps.append(gap), ambiguous.append(gap < GAP)
    return best, gaps, ambiguous


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, predicted, gap, ambiguous) of every row, in one pass without a shuffle.

    predicted is null, and ambiguous true, for a text that is null, empty or without a letter; equal losses go to the
    language that sorts first. ``lang`` is the declared label, carried as it is; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            best, gaps, ambiguous = _verdicts(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(best, pa.string()), pa.array(gaps, pa.float64()), pa.array(ambiguous, pa.bool_())],
                ["doc_id", "lang", "predicted", "gap", "ambiguous"],
            )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return kept.mapInArrow(run, "doc_id long, lang string, predicted string, gap double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or ambiguous, all columns as they were."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield batch.filter(pa.array([not x for x in _verdicts(batch.column(at), shared.value)[2]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document of the table, by a model fitted on a bounded sample of its labelled rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
