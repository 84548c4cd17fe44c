"""From signatures to verified groups, for documents (operator 7) and paragraphs (operator 10) alike.

A bucket is never one row. First every member is compared with the bucket's least node, one row a member. Only where a
bucket then still holds several components, the members outside its least node's component are compared with the rest
of it, in blocks of bounded size whose signatures are compared inside the block; only pairs that look alike leave it.
No pair is left out: a pair whose ends are already connected cannot change the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import small, written

#: Members of a block, on average; a bucket has as many blocks as it needs.
BLOCK = 512


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(rows, bands) keys: a hash of each band's values and the band's number."""
    from ._words import U64, mix

    rows, m = signature.shape
    parts = signature.reshape(rows, bands, m // bands).astype(U64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (rows, bands)).copy()
    for k in range(parts.shape[2]):
        key = mix(key * U64(0x9FB21C651E98DF25) + parts[:, :, k])
    return key.view(np.int64)


def list_array(values: np.ndarray) -> pa.Array:
    """A (rows, k) array as a list column."""
    rows, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * k + 1, k), pa.int32()), pa.array(values.ravel()))


def binary_array(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """values[ends[i]:ends[i+1]] as binary rows."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * raw.itemsize).astype(np.int32)), pa.py_buffer(raw.tobytes())]
    )


def _matrix(values: pa.Array) -> np.ndarray:
    """Binary values of one width as the rows of a byte matrix."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(len(values), -1)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaccard estimated from one byte of each signature value, row by row, corrected for chance agreement."""
    return ((x == y).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def overlap(a: bytes, b: bytes) -> float:
    """Exact Jaccard of two multisets, each a sorted run of distinct (element, occurrence) hashes."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return 0.0
    both = np.concatenate((x, y))
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(x) + len(y) - same)


def _estimates(left: pa.Array, right: pa.Array) -> np.ndarray:
    return agreement(_matrix(left), _matrix(right))


def _overlaps(left: pa.Array, right: pa.Array) -> np.ndarray:
    return np.array([overlap(p.as_buffer(), q.as_buffer()) for p, q in zip(left, right)])


def _filter(test: Callable[[pa.Array, pa.Array], np.ndarray], least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = test(batch.column("x"), batch.column("y"))
            keep = np.flatnonzero(score >= least)
            if len(keep):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(score[keep])], ["a", "b", "jaccard"]
                )

    return run


def _compare(pairs: DataFrame, table: DataFrame, column: str, test: Callable, least: float) -> DataFrame:
    """Pairs (a, b, jaccard) whose ``column`` values pass; each pair moves one value, the other side joins in place."""
    value = table.select("node", column)
    return (
        pairs.join(value.select(F.col("node").alias("b"), F.col(column).alias("y")), "b")
        .join(value.select(F.col("node").alias("a"), F.col(column).alias("x")), "a")
        .select("a", "b", "x", "y")
        .mapInArrow(_filter(test, least), "a long, b long, jaccard double")
    )


def _parts(block: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, labels and signatures of a block."""
    node, label, sig = block.values.flatten()
    return node.to_numpy(), label.to_numpy(), _matrix(sig)


def _across(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of two blocks whose labels differ and whose signatures look alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("l"), batch.column("r")):
                (x, p, s), (y, q, t) = _parts(left), _parts(right)
                for node, label, sig in zip(x, p, s):
                    at = np.flatnonzero((q != label) & (agreement(sig, t) >= least))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node, y[at])), pa.array(np.maximum(node, y[at]))], ["a", "b"])

    return run


def groups(banded: DataFrame, bags: Callable[[DataFrame], DataFrame], least: float, doubt: float) -> tuple[DataFrame, DataFrame]:
    """(verified pairs a < b with their jaccard, node -> label of their components).

    banded: node, bands array<long>, sig binary of one width; equal nodes may repeat. bags: given a table of nodes,
    returns (node, bag) once for each. least: exact Jaccard that a pair must reach. doubt: estimate below which a pair
    is dropped before its bags are moved (four standard errors under ``least`` or lower). A key that a third of all
    rows share is aggregated before it is shuffled, and where its members join it, adaptive execution splits it.
    """
    keyed = banded.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("hi")).filter("a < hi").drop("hi")
    shared = written(shared, "shared")
    members = written(keyed.join(small(shared, 64), "key").select("key", "a", "node").distinct(), "members")
    nodes = members.select("node").distinct()
    sigs = banded.join(small(nodes, 48), "node", "left_semi").groupBy("node").agg(F.first("sig").alias("sig"))
    sigs = written(sigs, "signatures")
    # both rounds compare nodes of buckets, so that one pass over the texts gives the bags of both
    held = bags(nodes)

    def verified(likely: DataFrame) -> DataFrame:
        return written(_compare(likely.select("a", "b"), held, "bag", _overlaps, least), "verified")

    stars = members.filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    first = verified(written(_compare(stars, sigs, "sig", _estimates, doubt), "likely"))
    labels = written(components(first), "labels")
    rest = _rest(members, labels, sigs, doubt)
    if rest is None:
        return first, labels
    pairs = first.unionByName(verified(rest))
    return pairs, written(components(pairs), "labels")


def _rest(members: DataFrame, labels: DataFrame, sigs: DataFrame, doubt: float) -> DataFrame | None:
    """Pairs that look alike and whose ends share a bucket but no component yet; None without a bucket of several."""
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = written(labelled, "labelled")
    mixed = (
        labelled.groupBy("key")
        .agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("node")).alias("print"), F.max(F.when(F.col("node") == F.col("a"), F.col("label"))).alias("main"),
        )
        .filter("lo < hi")
        # buckets of the same members are looked at once
        .groupBy("lo", "hi", "n", "print", "main")
        .agg(F.min("key").alias("key"))
    )
    mixed = written(mixed.select("key", "main", F.ceil(F.col("n") / BLOCK).alias("blocks")), "mixed")
    if not mixed.limit(1).count():
        return None
    blocks = (
        labelled.join(small(mixed, 64), "key")
        .join(sigs, "node")
        .groupBy("key", (F.col("label") != F.col("main")).alias("stray"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
        .agg(F.collect_list(F.struct("node", "label", "sig")).alias("m"))
    )
    blocks = written(blocks, "blocks")
    left = blocks.filter("stray").select("key", F.col("block").alias("i"), F.col("m").alias("l"))
    right = blocks.select("key", "stray", F.col("block").alias("j"), F.col("m").alias("r"))
    both = left.join(right, "key").filter("not stray or i <= j").select("l", "r")
    return written(both.mapInArrow(_across(doubt), "a long, b long").distinct(), "rest")
