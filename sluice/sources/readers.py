"""Readers of what the engine takes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import FRONT
from sluice.operators.chunks import CHUNK, with_word_count
from sluice.operators.entities import ENTITY


def relative(spark: SparkSession, path: Column, root: str) -> Column:
    """The path of a file's address from the root folder; whole where it lies elsewhere."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/") + "/"
    own = F.regexp_replace(path, r"\A[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "")
    own = F.url_decode(F.replace(own, F.lit("+"), F.lit("%2B")))
    return F.when(own.startswith(top), F.substr(own, F.lit(len(top) + 1))).otherwise(own)


def _top(paths: tuple[str, ...], root: str | None) -> str:
    return root if root is not None else paths[0].rstrip("/").rpartition("/")[0] or "."


def markdown(spark: SparkSession, *paths: str, root: str | None = None, below_bytes: int | None = None) -> DataFrame:
    """source_file, raw of all .md files below the paths, whole; source_file is the path from root, by default the folder that
    holds the first path. In the order of path parts by dedup.path_parts. below_bytes: only files that are smaller."""
    rows = spark.read.text(list(paths), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    if below_bytes is not None:
        rows = rows.filter(F.col("_metadata.file_size") < below_bytes)
    return rows.select(relative(spark, F.col("_metadata.file_path"), _top(paths, root)).alias("source_file"), F.col("value").alias("raw"))


def large_markdown(spark: SparkSession, *paths: str, root: str | None = None, least_bytes: int = 0, stretch_bytes: int = 4 << 20) -> DataFrame:
    """key (the source_file), nth, text, front of .md files of at least so many bytes, read in splits: stretches of whole lines."""
    import pandas as pd

    rows = spark.read.text(list(paths), recursiveFileLookup=True, pathGlobFilter="*.md").filter(F.col("_metadata.file_size") >= least_bytes)
    lines = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))

    def packed(batches):
        place, begin, held, size = None, 0, [], 0
        for b in batches:
            for path, block, line in b.itertuples(index=False):
                if held and ((path, block) != place or size >= stretch_bytes):
                    yield pd.DataFrame([(place[0], begin, "\n".join(held))], columns=["path", "nth", "text"])
                    begin, held, size = begin + size, [], 0
                if (path, block) != place:
                    place, begin = (path, block), block
                held.append(line)
                size += len(line.encode()) + 1
        if held:
            yield pd.DataFrame([(place[0], begin, "\n".join(held))], columns=["path", "nth", "text"])

    made = lines.mapInPandas(packed, "path string, nth long, text string")
    # a line break at a file's end is followed by an empty line, which the source of lines doesn't give
    tails = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    ended = [(r["path"], r["size"]) for r in tails.toLocalIterator() if _ends_a_line(spark, r["path"], r["size"])]
    made = made.unionByName(spark.createDataFrame([(p, n, "") for p, n in ended], "path string, nth long, text string"))
    cut = F.when(F.col("nth") == 0, F.regexp_extract("text", FRONT, 0)).otherwise(F.lit(""))
    key = relative(spark, F.col("path"), _top(paths, root)).alias("key")
    return made.withColumn("front", cut).select(key, "nth", F.substr("text", F.length("front") + 1).alias("text"), "front")


def _ends_a_line(spark: SparkSession, path: str, size: int) -> bool:
    """Whether a file's last byte is a line break."""
    place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        stream.seek(max(size - 1, 0))
        return stream.read() in (10, 13)
    finally:
        stream.close()


def entities(spark: SparkSession, *paths: str) -> DataFrame:
    """Entities with load_seq (the file's place, then the entity's) and source; missing files and broken ones give none."""
    schema = ENTITY + ", _broken string"
    out = spark.createDataFrame([], ENTITY + ", load_seq struct<file:int,at:long>, source string")
    for n, path in enumerate(paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            continue
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path).filter("_broken is null and coalesce(id, '') <> ''").drop("_broken")
        out = out.unionByName(rows.select("*", F.struct(F.lit(n).alias("file"), F.monotonically_increasing_id().alias("at")).alias("load_seq"), F.lit(path).alias("source")))
    return out


def chunks(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Chunks from JSON lines, or from files that hold one JSON array each."""
    return with_word_count(spark.read.schema(CHUNK).option("multiLine", array).json(path))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all PDF files below the path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "content")
