"""Operator 5: host reputation by empirical Bayes.

Each page outcome is bad (1) or good (0). Counts are summed for hosts, registered domains and public suffixes, and each
level's rate is shrunk towards its parent's: a beta prior has the parent's posterior mean, and a strength fitted to
how much the level's rates differ from their parents' by the method of moments. A host is filtered only if the lower
bound of its posterior (of the normal approximation to the beta) exceeds a threshold, so that hosts without evidence
stay. Suffixes follow the Public Suffix List.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import small, written

#: Posterior mean less Z standard deviations must exceed BAD for a host's pages to go.
Z, BAD = 1.645, 0.2
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+)"


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and trailing dot, an IPv6 address in its brackets; null if it has none."""
    h = F.regexp_extract(F.lower(url), _HOST, 1)
    return F.nullif(F.regexp_replace(h, r"\.+$", ""), F.lit(""))


def suffix_rules() -> list[str]:
    """The Public Suffix List's rules of two labels or more."""
    with open(os.path.join(os.path.dirname(__file__), "public_suffixes.txt"), encoding="utf-8") as f:
        return [line.strip() for line in f if not line.startswith("#")]


@cache
def _rules() -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    rules = suffix_rules()
    return (
        frozenset(r for r in rules if r[0] not in "*!"), frozenset(r[2:] for r in rules if r.startswith("*.")), frozenset(r[1:] for r in rules if r[0] == "!")
    )


def levels(name: str) -> tuple[str, str]:
    """(registered domain, public suffix) of a host. An address, a name without a dot and a suffix are all three."""
    if "." not in name or name[0] == "[" or name.replace(".", "").isdigit():
        return name, name
    plain, wild, exception = _rules()
    parts = name.split(".")
    n = len(parts)
    labels = 1
    for k in range(1, n + 1):
        end = ".".join(parts[n - k :])
        if end in exception:
            labels = k - 1
            break
        if end in plain:
            labels = max(labels, k)
        if end in wild and k < n:
            labels = max(labels, k + 1)
    return ".".join(parts[max(0, n - labels - 1) :]), ".".join(parts[n - labels :])


def with_levels(hosts: DataFrame) -> DataFrame:
    """``hosts`` (host, n, y) with their domain and suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [levels(h) for h in batch.column("host").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d for d, _ in got], pa.string()), pa.array([s for _, s in got], pa.string())], [*batch.schema.names, "domain", "suffix"])

    return hosts.select("host", "n", "y").mapInArrow(run, "host string, n long, y long, domain string, suffix string")


def strength(level: DataFrame) -> DataFrame:
    """One row: the prior strength s of a level with columns n, y and parent mean m.

    Under a beta-binomial, E (y - n m)^2 = n m (1 - m) (1 + (n - 1) / (s + 1)); summing both sides gives s.
    """
    v = F.col("n") * F.col("m") * (1 - F.col("m"))
    got = level.agg(
        F.sum(F.pow(F.col("y") - F.col("n") * F.col("m"), 2) - v).alias("excess"), F.sum(v * (F.col("n") - 1)).alias("pairs")
    )
    s = F.when(F.col("excess") > 0, F.col("pairs") / F.col("excess") - 1).otherwise(MAX_STRENGTH)
    return got.select(F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), F.coalesce(s, F.lit(MAX_STRENGTH)))).alias("s"))


def _shrunk(level: DataFrame) -> DataFrame:
    """Adds a and b, the posterior beta parameters, and mean."""
    labelled = level.filter("n > 0")
    joined = level.crossJoin(F.broadcast(strength(labelled)))
    a = F.col("s") * F.col("m") + F.col("y")
    total = F.col("s") + F.col("n")
    return joined.withColumn("a", a).withColumn("b", total - a).withColumn("mean", a / total)


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, domain, suffix, n_labelled, n_bad, mean, lower, blocked) of every host of ``pages``.

    A page is bad if any label row of its page_id has toxic = 1 or quality = 0, good if it has label rows and none of
    these; nulls in a label count as not bad. Pages with a null page_id or without labels count only as part of their
    host. With no label at all the global rate is 0.
    """
    outcome = (
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    )
    hosts = pages.select("page_id", host(F.col("url")).alias("host")).filter("host is not null")
    hosts = hosts.join(outcome, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y"))
    # hosts and domains are read by several levels: each is computed once
    hosts = written(with_levels(hosts), "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    whole = suffixes.agg(F.coalesce(F.try_divide(F.sum("y"), F.sum("n")), F.lit(0.0)).alias("m"))
    by_suffix = _shrunk(suffixes.crossJoin(F.broadcast(whole))).select("suffix", F.col("mean").alias("m"))
    by_domain = _shrunk(domains.join(by_suffix, "suffix")).select("domain", F.col("mean").alias("m"))
    by_host = _shrunk(hosts.join(by_domain, "domain"))
    sd = F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1)))
    lower = F.greatest(F.lit(0.0), F.col("mean") - Z * sd)
    return by_host.select(
        "host", "domain", "suffix", F.col("n").alias("n_labelled"), F.col("y").alias("n_bad"),
        F.round("mean", 6).alias("mean"), F.round(lower, 6).alias("lower"), (F.round(lower, 6) > BAD).alias("blocked"),
    )


def filtered(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, url, host, mean, lower, keep) of every page; pages of blocked hosts have keep = false.

    Pages whose URL is null or has no host have null reputation and keep = true; equal rows are each returned. Other
    columns (such as the page itself) are not read.
    """
    known = written(reputation(pages, labels).select("host", "mean", "lower", "blocked"), "known")
    return (
        pages.select("page_id", "url", host(F.col("url")).alias("host"))
        .join(small(known, 200), "host", "left")
        .select("page_id", "url", "host", "mean", "lower", (~F.coalesce("blocked", F.lit(False))).alias("keep"))
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every page of the table, learnt from the labels of the pages with the same id."""
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _shrink_sql(name: str, source: str) -> str:
    return f"""
{name}_s AS (SELECT greatest({MIN_STRENGTH}, least({MAX_STRENGTH}, coalesce(CASE WHEN sum((y - n * m) * (y - n * m) - n * m * (1 - m)) > 0
    THEN sum(n * m * (1 - m) * (n - 1)) / sum((y - n * m) * (y - n * m) - n * m * (1 - m)) - 1 ELSE {MAX_STRENGTH} END, {MAX_STRENGTH}))) AS s
  FROM {source} WHERE n > 0),
{name} AS (SELECT x.*, s * m + y AS a, s + n - (s * m + y) AS b, (s * m + y) / (s + n) AS mean FROM {source} x, {name}_s)"""


ORACLE = f"""
WITH outcome AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
located AS (SELECT page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '{_HOST}', 1), '\\.+$', ''), '') AS host FROM pages),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS y FROM located LEFT JOIN outcome USING (page_id) WHERE host IS NOT NULL GROUP BY 1),
rules AS (SELECT CASE WHEN r LIKE '!%' THEN r[2:] WHEN r LIKE '*.%' THEN r[3:] ELSE r END AS rule, CASE WHEN r LIKE '!%' THEN 'e' WHEN r LIKE '*.%' THEN 'w' ELSE 'p' END AS kind
  FROM (SELECT unnest(string_split('{" ".join(suffix_rules())}', ' ')) AS r)),
h1 AS (SELECT *, string_split(host, '.') AS p FROM h0),
ends AS (SELECT host, len(p) AS size, k, array_to_string(p[len(p) - k + 1:], '.') AS rule FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM h1)),
found AS (SELECT host, max(k - 1) FILTER (WHERE kind = 'e') AS but, max(CASE WHEN kind = 'p' THEN k WHEN kind = 'w' AND k < size THEN k + 1 END) AS labels FROM ends JOIN rules USING (rule) GROUP BY 1),
h2 AS (SELECT h1.*, regexp_matches(host, '^[0-9.]+$') OR host LIKE '[%' OR NOT contains(host, '.') AS whole, coalesce(but, labels, 1) AS k FROM h1 LEFT JOIN found USING (host)),
h3 AS (SELECT host, n, y, CASE WHEN whole THEN host ELSE array_to_string(p[len(p) - k + 1:], '.') END AS suffix,
  CASE WHEN whole THEN host ELSE array_to_string(p[greatest(1, len(p) - k):], '.') END AS domain FROM h2),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM h3 GROUP BY 1, 2),
s0 AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM d0 GROUP BY 1),
s1 AS (SELECT s0.*, g.m FROM s0, (SELECT coalesce(sum(y) / nullif(sum(n), 0), 0.0) AS m FROM s0) g),
{_shrink_sql("s2", "s1")},
d1 AS (SELECT d0.*, s2.mean AS m FROM d0 JOIN s2 USING (suffix)),
{_shrink_sql("d2", "d1")},
h4 AS (SELECT h3.*, d2.mean AS m FROM h3 JOIN d2 USING (domain)),
{_shrink_sql("h5", "h4")},
known AS (SELECT host, round(mean, 6) AS mean, round(greatest(0.0, mean - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) AS lower FROM h5)
SELECT page_id, url, host, mean, lower, coalesce(lower <= {BAD}, true) AS keep FROM located LEFT JOIN known USING (host)
"""
