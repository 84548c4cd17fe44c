"""Operator 6: packing documents into token windows, best fit decreasing with certified bin counts.

Each partition is packed by itself and its bin count is compared with a lower bound: the largest value that any of three
families of dual-feasible functions proves. Where a gap remains, the partition's bins that are not full are opened,
their documents are exchanged with those of the other gapped partitions under a new hash, and best fit decreasing runs
again; a round counts only if it saves bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bpe import SHORT, Merges, alike, kinds, piece_starts
from ._shared import portions, written
from ._words import U64, span_hashes, text_slices
from .chat_format import TOKENIZER, _tokenizer

CAPACITY = 2048
#: Pieces that one partition packs; the number of partitions grows with the input.
PART_ROWS = 20_000
ROUNDS = 3


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size (given in descending order): the fullest bin that still takes it, else a new one."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with r left
    out, bins = np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        fits = rooms >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                rooms &= ~(1 << r)
        else:
            r, b = capacity, bins
            bins += 1
        out[i] = b
        open_bins[r - s].append(b)
        rooms |= 1 << (r - s)
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual-feasible functions in integer arithmetic.

    Three families: thresholds (small sizes to 0, large to 1), rounding u(k), and the step functions of
    Fekete and Schepers; the largest rounded-up total is the bound.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    s = np.flatnonzero(count)
    n = count[s].astype(np.int64)
    best = int(-(-(s * n).sum() // capacity))
    for e in s[2 * s <= capacity].tolist():
        value = np.where(s > capacity - e, capacity, np.where(s >= e, s, 0))
        best = max(best, int(-(-(value * n).sum() // capacity)))
        q = capacity // e
        if q >= 2 and 2 * e < capacity:
            step = np.where(2 * s > capacity, q - (capacity - s) // e, np.where(s >= e, 1, 0))
            best = max(best, int(-(-(step * n).sum() // q)))
    for k in range(1, 33):
        whole = (k + 1) * s % capacity == 0
        value = np.where(whole, s * k, (k + 1) * s // capacity * capacity)
        best = max(best, int(-(-(value * n).sum() // (capacity * k))))
    return best


def _packer(capacity: int, turn: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        size = table.column("size").to_numpy()
        bins = best_fit(size, capacity)
        fill = np.bincount(bins, weights=size).astype(np.int64)
        n = len(size)
        new = {"round": np.full(n, turn), "bin": bins, "fill": fill[bins], "part_bins": np.full(n, len(fill)), "part_bound": np.full(n, lower_bound(size, capacity))}
        return table.select(["doc_id", "piece", "size", "part"]).append_column("round", pa.array(new["round"], pa.int32())).append_column(
            "bin", pa.array(bins)
        ).append_column("fill", pa.array(new["fill"])).append_column("part_bins", pa.array(new["part_bins"])).append_column("part_bound", pa.array(new["part_bound"]))

    return run


_SCHEMA = "doc_id long, piece int, size long, part long, round int, bin long, fill long, part_bins long, part_bound long"


#: Places, a power of two, for pieces whose counts a task remembers by a 64-bit hash of their bytes.
KNOWN_PIECES = 1 << 21


class _Counts:
    """Tokens of texts. A piece is encoded when it is met first, or when another has taken its place since."""

    def __init__(self, enc):
        self.enc, self.merges = enc, Merges.of(enc)
        self.key = np.arange(KNOWN_PIECES, dtype=U64) ^ U64(1)  # no key belongs where it is
        self.count = np.zeros(KNOWN_PIECES, np.int32)

    def of(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        if self.merges is None:  # nothing is known of its pieces
            for at in range(0, len(texts), 16):
                out[at : at + 16] = [len(x) for x in self.enc.encode_batch_fast(texts[at : at + 16].to_pylist(), add_special_tokens=False)]
            return out
        for first, last, data, offsets in text_slices(texts, lower=False):
            if not len(data):
                continue
            kind = kinds(data)
            s = piece_starts(data, kind, offsets[:-1][offsets[:-1] < len(data)])
            e = np.append(s[1:], len(data))
            key = span_hashes(data.astype(U64) + U64(1), s, e)
            slot = (key & U64(KNOWN_PIECES - 1)).astype(np.int64)
            count = self.count[slot]
            missing = np.flatnonzero(self.key[slot] != key)
            if len(missing):
                _, where, back = np.unique(key[missing], return_index=True, return_inverse=True)
                one = missing[where]
                new = self._encoded(data, kind, s[one], e[one])
                count[missing] = new[back]
                _, place = np.unique(slot[one], return_index=True)
                self.key[slot[one[place]]], self.count[slot[one[place]]] = key[one[place]], new[place]
            total = np.zeros(len(s) + 1, np.int64)
            np.cumsum(count, out=total[1:])
            out[first:last] = np.diff(total[np.searchsorted(s, offsets)])
        return out

    def _encoded(self, data: np.ndarray, kind: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        short = alike(kind, s, e) & (e - s <= SHORT)
        out = np.empty(len(s), np.int64)
        out[short] = self.merges.counts(data, s[short], (e - s)[short])
        if not short.all():
            raw = data.tobytes()
            pieces = [raw[i:j].decode() for i, j in zip(s[~short].tolist(), e[~short].tolist())]
            out[~short] = [len(x) for x in self.enc.encode_batch_fast(pieces, add_special_tokens=False)]
        return out


_counts: dict[str, _Counts] = {}


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens): tokens of the whole text by op3's tokenizer, plus one for the separator; texts without a word
    are left out. Pieces are told apart by a 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counts:  # kept for the tasks that follow in this process
            _counts[tokenizer] = _Counts(_tokenizer(tokenizer))
        counts = _counts[tokenizer]
        for batch in portions(batches):
            text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            some = pc.match_substring_regex(text, r"[^\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]")
            ids, text = batch.column("doc_id").filter(some), text.filter(some)
            yield pa.RecordBatch.from_arrays([ids, pa.array(1 + counts.of(text), pa.int64())], ["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, tokens long")


def pack(docs: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """One row a piece: doc_id, piece, size, the bin (round, part, bin), its fill, and its partition's certificate
    (part_bins used, part_bound proved necessary).

    A document longer than ``capacity`` is cut into full windows and a rest, numbered by ``piece``. Documents whose text
    is null or has no word are not packed. Rows with equal or null doc_id are packed as separate documents. Ties between
    equal sizes go by doc_id (null last), then piece. Other columns are not read; only ids and sizes are shuffled.
    """
    tokens = token_counts(docs)
    pieces = tokens.select(
        "doc_id", "tokens", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int"))).alias("piece")
    ).select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("long").alias("size"))
    pieces = written(pieces, "pieces")

    def packed(rows: DataFrame, turn: int) -> DataFrame:
        parts = max(1, -(-rows.count() // part_rows))
        part = F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "size"), F.lit(parts)).alias("part")
        return written(rows.select("doc_id", "piece", "size", part).groupBy("part").applyInArrow(_packer(capacity, turn), _SCHEMA), "packed")

    state = packed(pieces, 0)
    for turn in range(1, rounds + 1):
        loose = state.filter((F.col("part_bins") > F.col("part_bound")) & (F.col("fill") < capacity))
        bins = loose.select("round", "part", "bin").distinct().count()
        if not bins or state.select("round", "part").filter("part_bins > part_bound").distinct().limit(2).count() < 2:
            break
        again = packed(loose.select("doc_id", "piece", "size"), turn)
        if again.select("part", "bin").distinct().count() >= bins:
            break
        gapped = F.col("part_bins") > F.col("part_bound")
        closed = state.filter(~gapped | (F.col("fill") == capacity))
        # what stays of an opened partition are full bins, which certify themselves
        full = closed.filter(gapped).select("round", "part", "bin").distinct().groupBy("round", "part").agg(F.count("*").alias("full"))
        closed = closed.join(full, ["round", "part"], "left").select(
            "doc_id", "piece", "size", "part", "round", "bin", "fill",
            F.coalesce("full", "part_bins").alias("part_bins"), F.coalesce("full", "part_bound").alias("part_bound"),
        )
        state = written(closed.unionByName(again), "state")
    return state


def op6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table packed into windows of CAPACITY tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
