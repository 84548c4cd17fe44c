"""Search: TF-IDF over terms and nearest vectors. Every document is scored; only each query's best k are kept."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import slices, small

TERM = r"[a-z0-9]+(?:[./][a-z0-9]+)*"
#: Query vectors, in bytes, that are sent to every task at once; more are searched in several passes.
QUERY_BYTES = 16 << 20


def terms(c):
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), 0)


def tfidf(docs: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k documents (doc_id, text) most similar to each query (item_id, text).

    A query term weighs its inverse document frequency, a document's term that times its share of the document; the
    score is the cosine over the query's terms. Equal scores rank by doc_id; documents without a query term have none.
    Two passes over the documents, neither of which moves them: one counts the documents of each term asked for, one
    scores each document against weights that travel in parts of a bounded size, and keeps k rows a task and query.
    """
    q = queries.select("item_id", F.explode_outer(F.array_distinct(terms("text"))).alias("term")).filter("term is not null")
    n = docs.count()
    there = docs.select(F.explode_outer(F.array_distinct(terms("text"))).alias("term")).filter("term is not null")
    df = there.join(small(q.select("term").distinct(), 96), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.when(F.col("df").isNotNull(), F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).otherwise(1.0)
    weights = q.join(df, "term", "left").select(F.col("item_id").cast("long").alias("item_id"), "term", idf.alias("idf")).orderBy("item_id", "term")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, part, size = None, [], 0
    for r in weights.toLocalIterator():
        if size > QUERY_BYTES and r[0] != part[-1][0]:
            found, part, size = _scored(own, part, k, found), [], 0
        part.append(r)
        size += 48 + len(r[1])
    found = _scored(own, part, k, found)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _scored(docs: DataFrame, weights: list, k: int, before: DataFrame | None) -> DataFrame:
    """``before`` and the best k scores of each task for the queries of (item_id, term, idf) rows."""
    if not weights:
        return docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score double") if before is None else before
    items = np.array(sorted({r[0] for r in weights}), np.int64)
    number = {t: i for i, t in enumerate(sorted({r[1] for r in weights}))}
    term = np.array([number[r[1]] for r in weights], np.int64)
    query, idf = np.searchsorted(items, [r[0] for r in weights]), np.array([r[2] for r in weights], np.float64)
    norm = np.sqrt(np.bincount(query, idf**2, len(items)))
    order = np.argsort(term, kind="stable")
    query, idf, first = query[order], idf[order], np.searchsorted(term[order], np.arange(len(number) + 1))
    shared = docs.sparkSession.sparkContext.broadcast((items, number, query, idf, first, norm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, number, query, idf, first, norm = shared.value
        word = re.compile(TERM)
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for batch in slices(batches):
            rows = [best]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = word.findall((text.as_py() or "").lower())
                tf = Counter(number[w] for w in words if w in number)
                if not tf:
                    continue
                at = np.array(sorted(tf))
                size = first[at + 1] - first[at]
                entry = np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                w = np.repeat(np.array([tf[t] for t in at.tolist()], np.float64) / len(words), size) * idf[entry]
                dot, own = np.bincount(query[entry], idf[entry] * w, len(items)), np.bincount(query[entry], w * w, len(items))
                some = np.flatnonzero(own)
                rows.append((some, np.full(len(some), doc), (dot[some] / (np.sqrt(own[some]) * norm[some])).round(6)))
            if len(rows) > 1:
                which, doc, score = (np.concatenate(x) for x in zip(*rows))
                order = np.lexsort((doc, -score, which))
                which, doc, score = which[order], doc[order], score[order]
                keep = np.arange(len(which)) - np.searchsorted(which, which) < k
                best = which[keep], doc[keep], score[keep]
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(items[best[0]]), pa.array(best[1]), pa.array(best[2])], ["item_id", "doc_id", "score"])

    one = docs.mapInArrow(run, "item_id long, doc_id long, score double")
    return one if before is None else before.unionByName(one)


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows): cosine distance, squared Euclidean distance or one less the inner product."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    dot = q @ x.T
    if metric == "ip":
        return 1 - dot
    if metric == "l2":
        return (q**2).sum(1)[:, None] - 2 * dot + (x**2).sum(1)[None, :]
    size = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None, :]
    return 1 - np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, rank, vec_id, distance) of the k vectors (vec_id, embedding) nearest to each query (query_id, embedding).

    The search is exact. Queries travel to the vectors in parts of a bounded size; each Arrow batch yields its own best
    k, so that k rows a batch and query are shuffled. Ties rank by vec_id; null vectors are left out.
    """
    rows = queries.filter("embedding is not null").select("query_id", "embedding").orderBy("query_id")
    sc, found, part = vectors.sparkSession.sparkContext, None, []

    def one(part: list) -> DataFrame:
        shared = sc.broadcast((np.array([r[0] for r in part]), np.array([r[1] for r in part], np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                vec = np.array(batch.column("vec_id"))
                d = _distances(np.stack(batch.column("embedding").to_pylist()), q, metric).round(6)
                order = np.lexsort((np.broadcast_to(vec, d.shape), d))[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, order.shape[1])), pa.array(vec[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], ["query_id", "vec_id", "distance"]
                )

        own = vectors.filter("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        return own.mapInArrow(run, "query_id long, vec_id long, distance double")

    for r in rows.select(F.col("query_id").cast("long"), "embedding").toLocalIterator():
        part.append(r)
        if len(part) * len(r[1]) * 4 > QUERY_BYTES:
            found = one(part) if found is None else found.unionByName(one(part))
            part = []
    if part or found is None:
        last = one(part) if part else vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double")
        found = last if found is None else found.unionByName(last)
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def upserted(index: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """index with all rows of the sources in ``new`` replaced by the rows of ``new``."""
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def check_config(stored: dict, wanted: dict) -> None:
    """Raises ValueError when an index was built with another model, metric or dimension."""
    for name in ("model", "metric", "dimension"):
        if name in stored and name in wanted and stored[name] != wanted[name]:
            raise ValueError(f"index has {name} {stored[name]!r}, asked for {wanted[name]!r}")
