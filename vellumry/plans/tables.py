"""The input tables as the operators want them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocks, quality


#: Tables of whole texts, whose operators spend their time on each row.
TEXTS = ("documents", "pages")


def read(spark: SparkSession, sf_dir: str, name: str, heavy: bool | None = None) -> DataFrame:
    """A table. Texts (or what ``heavy`` says is as slow to work on) in fewer splits than there are cores are spread over all of them: that is a shuffle of less than one
    split a core; larger inputs have splits enough and are read as they are."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if (name in TEXTS if heavy is None else heavy) and df.rdd.getNumPartitions() < cores else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, type, content, level, page): the lines of the documents as paragraphs, in normal form."""
    return blocks.exploded(blocks.cleaned(blocks.line_blocks(read(spark, sf_dir, "documents"))))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, type, content, level, page): conversations as documents, turns as pages, lines as blocks."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "content"))
    return c.select(
        "doc_id", (F.col("page") * 100_000 + F.col("i")).cast("int").alias("idx"), F.lit("paragraph").alias("type"), text.strip(F.col("content")).alias("content"),
        F.lit(None).cast("int").alias("level"), "page",
    ).filter("content <> ''")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, header_rows, grid): the orders of each customer as a table."""
    from ..operators import tables

    orders = read(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", F.format_string("%.2f", "o_totalprice").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
    )
    return tables.from_rows(orders, "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])


def compiled(docs: DataFrame, file_type: str = "txt", pages: int = 1) -> DataFrame:
    """Parsed documents (doc_id, blocks) through cleaning, removal of repeated blocks, validation and scoring.

    One row a document from end to end, so the whole chain is one stage over the scan. Columns file_type and pages of
    ``docs`` are used if they are there.
    """
    words = lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + text.word_count(x["content"]) + F.regexp_count(x["content"], F.lit(text.CJK)))
    d = blocks.cleaned(docs)
    d = d.withColumns({k: F.lit(v) for k, v in {"file_type": file_type, "pages": pages}.items() if k not in docs.columns})
    d = d.withColumn("original_tokens", F.when(F.size("blocks") > 0, F.greatest(F.lit(1), words(F.col("blocks")))).otherwise(0))
    d = d.withColumn("_n", F.size("blocks")).withColumn("blocks", blocks.deduplicated_array(F.col("blocks")))
    d = d.withColumn("duplicate_blocks_removed", F.col("_n") - F.size("blocks")).drop("_n")
    d = d.withColumn("optimized_tokens", F.when(F.size("blocks") > 0, F.greatest(F.lit(1), words(F.col("blocks")))).otherwise(0))
    return quality.readiness(quality.deductions(quality.issues(d)))
