"""Tables in the folder that all executors share, and joins whose strategy follows a counted size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its rows, counted first, stay under this.
BROADCAST_BYTES = 24 << 20
#: Rows that Python looks at together. Spark bounds the bytes of a batch; as Python objects they are many times as large.
SLICE_ROWS = 64
_own: dict[str, str] = {}
_registered: set[str] = set()


def folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir. Where none is set, a temporary one serves a session that runs
    in a single process; on a cluster, whose machines would each write to their own disk, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "folder" not in _own:
            _own["folder"] = tempfile.mkdtemp(prefix="vellumry-")
        base = _own["folder"]
    return f"{base.rstrip('/')}/vellumry-{spark.sparkContext.applicationId}"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the application is ending; the cluster may be gone already
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    base = folder(spark)
    if base not in _registered:
        _registered.add(base)
        atexit.register(_drop, spark, base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marks ``df`` for broadcast if its counted rows fit BROADCAST_BYTES; otherwise Spark shuffles both sides."""
    rows = df.limit(BROADCAST_BYTES // row_bytes + 1).count()
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in order, in slices of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
