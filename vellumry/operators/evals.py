"""Measures that compare results: confusion counts, answer similarity, percentiles, costs, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: layers, key-value heads, head size, bytes a value.
MODELS = {"8b": (32, 8, 128, 2), "70b": (80, 8, 128, 2)}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(rows: DataFrame, expected: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, n and precision, recall, f1, false_positive_rate, specificity, rounded to 4 places; 0 where undefined."""
    e, p = expected.cast("boolean"), predicted.cast("boolean")
    c = rows.groupBy(*(by or [])).agg(
        F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(~e & ~p).alias("tn"), F.count_if(e & ~p).alias("fn")
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    out = {
        "n": tp + fp + tn + fn, "precision": F.bround(precision, 4), "recall": F.bround(recall, 4),
        "f1": F.bround(_ratio(2 * precision * recall, precision + recall), 4), "false_positive_rate": F.bround(_ratio(fp, fp + tn), 4),
        "specificity": F.bround(_ratio(tn, fp + tn), 4),
    }
    return c.withColumns(out)


def answer_similarity(answer: Column, truth: Column, least: float = 0.5) -> Column:
    """One less the edit distance over the longer length, of stripped lower-cased texts; 0 below ``least``."""
    p, g = text.strip(F.lower(answer)), text.strip(F.lower(truth))
    s = 1 - F.levenshtein(p, g) / F.greatest(F.length(p), F.length(g), F.lit(1))
    return F.when(g == "", None).when(s >= least, s).otherwise(0.0)


def contains_all(c: Column, facts: Column) -> Column:
    """Whether a text holds every string of an array, in any case."""
    return F.forall(facts, lambda f: F.contains(F.lower(c), F.lower(f)))


def percentiles(rows: DataFrame, value: str, points: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, as p50 and so on."""
    return rows.groupBy(*(by or [])).agg(*[F.bround(F.percentile(F.col(value), F.lit(p / 100)), 6).alias(f"p{p:g}") for p in points])


def cache_cost(tokens: Column, model: str, budget_gb: float) -> Column:
    """struct(bytes_per_token, request_gb, concurrent) of a key-value cache for requests of so many tokens."""
    layers, heads, size, width = MODELS[model]
    each = 2 * layers * heads * size * width
    gb = tokens * each / 1024**3
    return F.struct(
        F.lit(each).alias("bytes_per_token"), F.bround(gb, 9).alias("request_gb"), F.when(gb > 0, F.greatest(F.lit(1), F.floor(budget_gb / gb).cast("int"))).otherwise(0).alias("concurrent")
    )


def prefill_ratio(tokens: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, F.pow(tokens / baseline, 2)).otherwise(0.0)


def sampled(rows: DataFrame, bucket: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each bucket, those of least hash of (seed, key): the same rows on every run and partitioning."""
    w = Window.partitionBy(bucket).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def preference(delta: Column, a_failed: Column, b_failed: Column, margin: float = 5) -> Column:
    """Which of two results is preferred: a failed one never, else by a score difference (b less a) of ``margin``."""
    return (
        F.when(a_failed & b_failed, "neither").when(a_failed, "b").when(b_failed, "a")
        .when(delta >= margin, "b").when(delta <= -margin, "a").otherwise("tie")
    )


def session_numbers(events: DataFrame, key: str, at: Column, gap: float, end: Column | None = None) -> DataFrame:
    """events with ``session`` (from 1 for each key): a new one begins after a pause of more than ``gap``, or after a row
    for which ``end`` holds. ``at`` is a number."""
    w = Window.partitionBy(key).orderBy(at, *[F.col(c) for c in events.columns if c != key][:1])
    new = at - F.lag(at).over(w) > gap
    if end is not None:
        new |= F.lag(end).over(w)
    return events.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def rate_limited(requests: DataFrame, key: str, at: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """requests with ``recent`` (requests of the key in the last ``seconds``, this one included) and ``allowed``."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(t).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= limit)


def kept_once(lines: DataFrame, least: int = 3) -> DataFrame:
    """lines (doc_id, idx, line): lines that occur ``least`` times or more in a document stay once, at their first place."""
    w = Window.partitionBy("doc_id", "line")
    return (
        lines.withColumn("_n", F.count("*").over(w)).withColumn("_first", F.min("idx").over(w))
        .filter((F.col("_n") < least) | (F.col("idx") == F.col("_first"))).drop("_n", "_first")
    )
