"""A watched folder: files arrive, are queued once for each content, compiled, gated and indexed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import parsed

LEAST_SCORE = 70
QUIET = "2 seconds"


def arrivals(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Stream of (path, modificationTime, content) of files created or changed below a folder."""
    return (
        spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "modificationTime", "content")
    )


def debounced(events: DataFrame, key: str = "path", at: str = "ts", quiet: str = QUIET, late: str = "10 seconds") -> DataFrame:
    """One row for each burst of events of a key: a session ends after ``quiet`` without one. Later than ``late`` is dropped."""
    return (
        events.withWatermark(at, late).groupBy(key, F.session_window(at, quiet).alias("w")).agg(F.count("*").alias("events"))
        .select(key, F.col("w.start").alias("first"), F.col("w.end").alias("settled"), "events")
    )


def to_process(found: DataFrame, jobs: DataFrame) -> DataFrame:
    """found (path, content_hash) without those that ``jobs`` (path, content_hash, status) has as done with that content."""
    return found.join(jobs.filter("status = 'done'").select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def enqueued(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """jobs with new or changed paths pending; added_at of ``found`` (path, content_hash, added_at) replaces the old one."""
    new = to_process(found, jobs).withColumn("status", F.lit("pending"))
    return jobs.join(new.select("path"), "path", "left_anti").unionByName(new, allowMissingColumns=True)


def oldest(jobs: DataFrame, n: int = 1) -> DataFrame:
    return jobs.filter("status = 'pending'").orderBy("added_at", "path").limit(n)


def marked(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """jobs with the status (done, low_quality or error) of ``done`` (path, status)."""
    d = done.select("path", F.col("status").alias("_s"))
    return jobs.join(d, "path", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def last_of_batch(batch: DataFrame) -> DataFrame:
    """The newest version of each path in a micro-batch."""
    w = Window.partitionBy("path").orderBy(F.desc("modificationTime"))
    return batch.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def watch(stream: DataFrame, table: str, checkpoint: str, compile: Callable[[DataFrame], DataFrame], available: bool = True):
    """Compiles every file of ``stream`` into the Parquet folder ``table``, partitioned by micro-batch; starts and returns
    the query. ``compile`` takes parsed files and returns rows with readiness_score; those under LEAST_SCORE are left out.

    A batch that is run again after a failure replaces its own partition, so each file is indexed once.
    """

    def one(batch: DataFrame, number: int) -> None:
        files = parsed(last_of_batch(batch).select("path", "content"))
        rows = compile(files).filter(F.col("readiness_score") >= LEAST_SCORE)
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    w = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available else w.trigger(processingTime="5 seconds")).start()


def rate_limited(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """Stream of (key, ts, allowed) of a stream (key, ts) with a watermark: at most ``limit`` allowed requests of a key in
    any ``seconds``. A key's state is its allowed times within the window, and goes once the window has passed."""

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        for frame in frames:
            out = []
            for ts in frame["ts"].sort_values():
                now = ts.timestamp()
                recent = [t for t in recent if t > now - seconds]
                ok = len(recent) < limit
                if ok:
                    recent.append(now)
                out.append((key[0], ts, ok))
            yield pd.DataFrame(out, columns=["key", "ts", "allowed"])
        state.update((recent,))
        if recent:
            state.setTimeoutTimestamp(max(int((recent[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    return requests.groupBy("key").applyInPandasWithState(one, "key string, ts timestamp, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
