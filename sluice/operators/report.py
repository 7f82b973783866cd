"""Counts of a run, and its log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def by_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("content_type").agg(F.count("*").alias("n"))


def by_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_type").agg(F.count("*").alias("n"))


def _as_map(counts: DataFrame, key: str):
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))))


def totals(kept: DataFrame, dropped: DataFrame, skipped: dict | None = None) -> DataFrame:
    """One row: chunks, duplicates, and too_small_skipped and tables_split as they were observed (see build_chunks); else they are 0."""
    out = kept.agg(F.count("*").alias("total_chunks")).crossJoin(dropped.agg(F.count("*").alias("duplicates_skipped")))  # one row each
    return out.withColumns({k: F.lit((skipped or {}).get(k, 0)).cast("long") for k in ("too_small_skipped", "tables_split")})


def report(kept: DataFrame, dropped: DataFrame, skipped: dict | None = None) -> DataFrame:
    """One row: totals, and counts by type and source as maps."""
    out = totals(kept, dropped, skipped)
    types = _as_map(by_type(kept), "content_type").toDF("chunks_by_type")
    return out.crossJoin(types).crossJoin(_as_map(by_source(kept), "source_type").toDF("chunks_by_source"))


#: Kinds of chunks, and of sources.
CONTENT_TYPES, SOURCE_TYPES = ("table", "profile", "regulation", "list", "section"), ("html", "pdf")


def counted(kept: DataFrame) -> tuple[DataFrame, Observation]:
    """The same chunks, and their counts as they come with whatever job writes them."""
    seen = Observation()
    counts = [F.count_if(F.col(c) == v).alias(f"{c}={v}") for c, vs in (("content_type", CONTENT_TYPES), ("source_type", SOURCE_TYPES)) for v in vs]
    return kept.observe(seen, F.count(F.lit(1)).alias("n"), *counts), seen


def observed_report(spark: SparkSession, kept: dict, dropped: int, skipped: dict) -> DataFrame:
    """The row of report(), from counts that came with writes."""
    maps = [{v: kept[f"{c}={v}"] for v in vs if kept[f"{c}={v}"]} for c, vs in (("content_type", sorted(CONTENT_TYPES)), ("source_type", SOURCE_TYPES))]
    row = (kept["n"], dropped, skipped.get("too_small_skipped", 0), skipped.get("tables_split", 0), *maps)
    return spark.createDataFrame([row], "total_chunks long, duplicates_skipped long, too_small_skipped long, tables_split long, chunks_by_type map<string,long>, chunks_by_source map<string,long>")


def duplicate_lines(dropped: DataFrame) -> DataFrame:
    """A line of the error log for each duplicate, without its time."""
    return dropped.select(F.format_string("DUPLICATE: hash=%s..., original=%s, source=%s", F.substring("hash", 1, 16), F.col("original_id"), F.col("source_file")).alias("value"))


def event_lines(kept: DataFrame) -> DataFrame:
    """A JSON line for each chunk made, without its time."""
    return kept.select(F.to_json(F.struct(F.lit("chunk_created").alias("event"), "chunk_id", "content_type", "word_count", "source_file")).alias("value"))
