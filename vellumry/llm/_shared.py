"""What the operators share: small portions of batches, and the tables and joins of ``functions.shared``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from ..functions.shared import small, written

__all__ = ["portions", "small", "written"]

#: Rows looked at together: texts can be long, and Python holds what it looks at several times over.
BATCH_ROWS = 500


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most BATCH_ROWS rows; Spark bounds the bytes of a batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)
