"""First-wins deduplication by content hash, with a record of what was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.shared import settled
from sluice.operators.visited import Visited


def path_parts(path: Column) -> Column:
    """Files are ordered by the parts of their paths, not by their characters."""
    return F.split(path, "/")


def place() -> Column:
    """Where a chunk stands: of equal ones the first stays."""
    return F.struct(path_parts(F.col("source_file")).alias("path"), "seq", "part", "chunk_id")


def first_of(chunks: DataFrame) -> DataFrame:
    """hash, first (place of the first chunk with it), n: a partial aggregate, so hot hashes don't gather."""
    return chunks.groupBy("hash").agg(F.min(place()).alias("first"), F.count("*").alias("n"))


def split_duplicates(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks that are the first with their hash; and the others, with the id of the first (original_id).

    Hashes that occur once never meet a join: bits tell which chunks may have one that occurs again, and only these move. Chunks
    are read twice, so they should come from a table.
    """
    again = settled(first_of(chunks).filter("n > 1").drop("n"))
    n, seen = again.count(), Visited(chunks.sparkSession)
    if not n:
        return chunks, chunks.limit(0).withColumn("original_id", F.lit(None).cast("string"))
    seen.add(again.select(F.col("hash").alias("url")), n)
    doubtful, single = seen.split(chunks, "hash")
    marked = doubtful.withColumn("__order", place()).join(again, "hash", "left")
    kept = marked.filter(F.col("first").isNull() | (F.col("__order") == F.col("first"))).select(chunks.columns)
    dropped = marked.filter(F.col("__order") != F.col("first")).withColumn("original_id", F.col("first.chunk_id")).drop("__order", "first")
    return single.unionByName(kept), dropped


def first_seen(rows: DataFrame, by: str, order: Column) -> DataFrame:
    """The first row of each value by an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter("__n = 1").drop("__n")
