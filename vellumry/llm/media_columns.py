"""Operator 4: columns of lossless WebP images decoded to pixel arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import portions
from .webp import CROSS_COLOUR, PALETTE, PREDICTOR, SUBTRACT_GREEN, Damaged, decode, encode

#: Rows decoded between two output batches, which bounds memory.
CHUNK = 256


def decoded(images: DataFrame, key: str = "image_id", column: str = "image") -> DataFrame:
    """(key, width, height, pixels, error): pixels is an array of ARGB values in row order, as unsigned longs.

    An image that is null gives nulls throughout; bytes that are no whole lossless WebP (empty, cut off, lossy, another
    format) give nulls and the reason in ``error``, as do images of more than ``webp.MAX_PIXELS`` pixels, which no row of
    longs can hold. Rows are independent: repeated rows and keys are each returned, a
    null key is carried. Other columns are not read. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                rows = []
                for value in part.column(1):
                    data = value.as_py()
                    if data is None:
                        rows.append((None, None, None, None))
                        continue
                    try:
                        width, height, pixels = decode(data)
                        rows.append((width, height, np.array(pixels, np.int64), None))
                    except Damaged as e:
                        rows.append((None, None, None, str(e)))
                w, h, p, e = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(p, pa.list_(pa.int64())), pa.array(e, pa.string())],
                    [key, "width", "height", "pixels", "error"],
                )

    kept = images.select(F.col(key).cast("long").alias(key), F.col(column).cast("binary").alias(column))
    return kept.mapInArrow(run, f"{key} long, width int, height int, pixels array<long>, error string")


#: The ways of coding that the test table goes through, by vec_id.
_WAYS = (
    dict(),
    dict(transforms=(PREDICTOR,), cache_bits=4, matches=True),
    dict(transforms=(CROSS_COLOUR, SUBTRACT_GREEN), cache_bits=2),
    dict(transforms=(PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN), matches=True, mode=3),
    dict(transforms=(PALETTE,), matches=True),
    dict(transforms=(PALETTE, PREDICTOR), cache_bits=6, mode=7),
)


def images_of(embeddings: DataFrame) -> DataFrame:
    """(image_id, image): each vector as an 8-pixel wide lossless WebP, value i being red and blue of pixel i and green
    of the pixel that many before the end; null and empty vectors give a null image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            files = []
            for key, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                if not vector or None in vector:
                    files.append(None)
                    continue
                v = np.clip(np.floor((np.array(vector, np.float64) + 1) * 127.5), 0, 255).astype(np.int64)
                v = np.append(v, np.zeros(-len(v) % 8, np.int64))
                pixels = (255 << 24 | v << 16 | v[::-1] << 8 | v).tolist()
                files.append(encode(8, len(v) // 8, pixels, **_WAYS[(key or 0) % len(_WAYS)]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(files, pa.binary())], ["image_id", "image"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "image_id long, image binary")


def op4_webp_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a media column: the embeddings table, which is the one with pixel-like values, coded as images and decoded."""
    return decoded(images_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor((CAST(x AS DOUBLE) + 1) * 127.5))) AS BIGINT)) AS v FROM embeddings)
SELECT vec_id AS image_id, 8::INTEGER AS width, (len(v) // 8)::INTEGER AS height,
  list_transform(range(1, len(v) + 1), lambda i: 4278190080 + v[i] * 65536 + v[len(v) + 1 - i] * 256 + v[i]) AS pixels, CAST(NULL AS VARCHAR) AS error
FROM v
"""
