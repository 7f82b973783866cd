"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sluice.conf import ChunkConf
from sluice.functions import text as T
from sluice.functions.classify import classify
from sluice.operators.entities import entity_refs
from sluice.operators.segment import segments
from sluice.operators.shared import settled
from sluice.operators.stretches import segments_of

CHUNK = "chunk_id string, text string, source_type string, source_file string, section_hierarchy array<string>, content_type string, entity_refs array<string>, page_range array<int>, word_count int, hash string"


def file_stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"\A.+\.[^.]+\z"), F.regexp_replace(name, r"\.[^.]+\z", "")).otherwise(name)


def source_type(path: Column) -> Column:
    return F.when(path.contains("pdfs"), "pdf").otherwise("html")


def with_skip(docs: DataFrame, raw: str, source_file: str) -> DataFrame:
    """source_file, raw (with line feeds only) and the length of its front matter."""
    rows = docs.select(F.col(source_file).alias("source_file"), F.regexp_replace(F.col(raw), "\r\n?", "\n").alias("raw"))
    return rows.withColumn("skip", F.length(F.regexp_extract("raw", T.FRONT, 0)))


def build_chunks(docs: DataFrame, registry: DataFrame | None = None, conf: ChunkConf = ChunkConf(), raw: str = "raw", source_file: str = "source_file", seen: Observation | None = None) -> DataFrame:
    """The chunks of documents (source_file, raw), with seq and part, in the order of which they stand in their file.

    source_file tells documents apart; small and empty chunks are dropped before any costly column is made. seen: gets the counts
    of small_segments when the chunks are written.
    """
    return _chunks(segments(with_skip(docs, raw, source_file), "source_file", "raw", conf, F.col("skip")), registry, conf, seen)


def build_large_chunks(stretches: DataFrame, registry: DataFrame | None = None, conf: ChunkConf = ChunkConf(), seen: Observation | None = None) -> DataFrame:
    """The same of documents that come in stretches (see readers.large_markdown)."""
    return _chunks(segments_of(stretches, conf).withColumnRenamed("key", "source_file"), registry, conf, seen)


def _skips(conf: ChunkConf) -> list[Column]:
    small = ~F.col("tabular") & (F.col("text") != "") & (F.col("word_count") < conf.min_words)
    return [F.count_if(small).alias("too_small_skipped"), F.count_if(F.col("tabular") & (F.col("parts") > 1) & (F.col("part") == 1)).alias("tables_split")]


def _counted(found: DataFrame) -> DataFrame:
    """Segments without white space at their ends, and their words."""
    return found.withColumn("text", T.strip(F.col("text"))).withColumn("word_count", T.word_count(F.col("text")))


def _chunks(found: DataFrame, registry: DataFrame | None, conf: ChunkConf, seen: Observation | None = None) -> DataFrame:
    found = _counted(found)
    if seen is not None:
        found = found.observe(seen, *_skips(conf))
    found = found.filter((F.col("text") != "") & (F.col("tabular") | (F.col("word_count") >= conf.min_words)))
    path = F.col("source_file")
    kind = source_type(path)
    out = found.withColumn("hash", T.content_hash(F.col("text"))).select(
        F.concat(T.chunk_id(kind, file_stem(path), F.col("hierarchy"), F.col("hash")), F.when(F.col("parts") > 1, F.concat(F.lit("_part"), F.col("part"))).otherwise(F.lit(""))).alias("chunk_id"),
        "text",
        kind.alias("source_type"),
        "source_file",
        F.col("hierarchy").alias("section_hierarchy"),
        F.when(F.col("tabular"), "table").otherwise(classify(F.col("text"), path, F.col("hierarchy"))).alias("content_type"),
        "page_range",
        "word_count",
        "hash",
        "seq",
        "part",
    )
    if registry is None:
        return out.withColumn("entity_refs", F.array().cast("array<string>"))
    return entity_refs(settled(out), registry, "text")  # which reads them twice


def small_segments(docs: DataFrame, conf: ChunkConf = ChunkConf(), raw: str = "raw", source_file: str = "source_file") -> DataFrame:
    """One row: chunks that were too small, and tables that were split; by a pass of its own, where chunks aren't made anyway (see build_chunks)."""
    return _counted(segments(with_skip(docs, raw, source_file), "source_file", "raw", conf, F.col("skip"))).agg(*_skips(conf))


def columns_of_chunk(chunks: DataFrame) -> DataFrame:
    """In the order of the chunk's schema."""
    return chunks.select(*(x.split()[0] for x in CHUNK.split(", ")))


def with_word_count(chunks: DataFrame) -> DataFrame:
    """A word count of 0 for a text that isn't empty is counted again."""
    return chunks.withColumn("word_count", F.when((F.coalesce("word_count", F.lit(0)) == 0) & (F.col("text") != ""), T.word_count(F.col("text"))).otherwise(F.col("word_count")))
