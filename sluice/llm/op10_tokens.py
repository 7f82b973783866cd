"""Token counts through a digest cache.

The cache is a table (digest, n_tokens) in a shared folder, partitioned by tokenizer and by the digest's first bits. Contents are
looked up by their SHA-256 and the tokenizer's own digest; only distinct contents that it lacks are encoded, and their counts are
appended. Copies of one text meet in a partial aggregate before the shuffle, so a text that fills a third of the table moves once
a task; the join of counts back to rows moves digests, not texts, and adaptive execution splits its hot digests.

A run reads those partitions of the cache that its own digests fall in, and goes on with the counts of its own digests alone; the
rest of the cache is neither grouped nor copied. A partition of more than MERGE files is merged into one or a few before it is
read. Counts depend on nothing but tokenizer and text, so what a run that was cut short has appended is right, and a digest that is
there twice (two runs at once, a merge cut short between writing and deleting) counts once. Merging deletes files, so runs that use
one folder at the same time set merge to None, and one of them may merge afterwards.

The query's cache stays: it is the folder that spark.sluice.tokenCache names, else one below the shared folder, so a second run
encodes only what the first hadn't met. Adaptive execution splits a hot digest's partition where it is larger than
spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes; below that a task reads it whole, some 40 bytes a row.

Null texts are empty and have 0 tokens; repeated rows and ids keep their rows; an empty table gives no rows. Only id and text are
read, so other columns can't clash. A very long text is a block of its own in a worker. The count
doesn't depend on what the cache held before.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import blocks, ensure_checkpoints, keyed_text, remove, settled, table

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string, prefix int"
TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Digests that are broadcast at most (32 bytes each), so that only their texts, and nothing of the cache, move.
SMALL = 200_000
#: Partitions of the cache, at most 256, and files of one partition beyond which they are merged.
PREFIXES, MERGE = 64, 16


def encoder(path: str):
    """text -> number of ids, by the library that the file's ending names."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    own = bpe.load(path)
    return lambda text: len(own.ids(text))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, key: str = "doc_id", text: str = "text", merge: int | None = MERGE) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row; encodes what cache_path lacks and appends it there."""
    spark = docs.sparkSession
    version = bpe.version(tokenizer_path)
    rows = keyed_text(docs, key, text).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    known, wanted = None, rows
    if merge is not None:
        merge_files(spark, cache_path, version, merge)
    if stored(spark, cache_path, version) is not None:  # digests meet the cache first, so texts that it knows don't move
        own = settled(rows.select("digest").distinct())
        prefixes = [r[0] for r in own.select(prefix("digest")).distinct().collect()]
        known = settled(once(stored(spark, cache_path, version, prefixes).join(few(own), "digest", "left_semi")))
        missing = settled(own.join(known, "digest", "left_anti"))
        if missing.isEmpty():
            return _counted(rows, known)
        wanted = rows.join(few(missing), "digest", "left_semi")
    misses = wanted.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches):
        count = encoder(tokenizer_path)
        for b in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(array("q", map(count, b.column("text").to_pylist())), pa.int64())], names=["digest", "n_tokens"])

    new = settled(misses.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long"))
    _append(new, cache_path, version)
    return _counted(rows, new if known is None else known.unionByName(new))


def _counted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with their digest's count; both sides of the join are plain shuffles, which can be split where a digest is hot."""
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(known, "digest").select("doc_id", "n_bytes", "n_tokens")


def few(digests: DataFrame) -> DataFrame:
    return F.broadcast(digests) if digests.count() <= SMALL else digests


def prefix(digest: str) -> Column:
    return (F.conv(F.hex(F.substring(digest, 1, 1)), 16, 10).cast("int") % PREFIXES).alias("prefix")


def once(counts: DataFrame) -> DataFrame:
    return counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def stored(spark: SparkSession, path: str, version: str, prefixes: list[int] | None = None) -> DataFrame | None:
    """digest, n_tokens of one tokenizer, of all partitions or some; a digest may come twice. None where there is no cache yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer") == version)
    return (rows if prefixes is None else rows.filter(F.col("prefix").isin(prefixes))).select("digest", "n_tokens")


def _append(counts: DataFrame, path: str, version: str) -> None:
    """Each partition's rows go to one file, or several where they are many, sorted by digest."""
    rows = counts.select("digest", "n_tokens", F.lit(version).alias("tokenizer"), prefix("digest")).hint("rebalance", "prefix")
    rows.sortWithinPartitions("prefix", "digest").write.mode("append").partitionBy("tokenizer", "prefix").parquet(path)


def merge_files(spark: SparkSession, path: str, version: str, most: int = MERGE) -> int:
    """Merges the files of partitions that have more than so many; how many partitions that were."""
    rows = stored(spark, path, version)
    if rows is None:
        return 0
    files: dict[int, list[str]] = {}
    for name in rows.inputFiles():
        if f"/tokenizer={version}/" in name:
            files.setdefault(int(name.rsplit("/prefix=", 1)[1].split("/")[0]), []).append(name)
    crowded = {p: names for p, names in files.items() if len(names) > most}
    if crowded:
        _append(once(stored(spark, path, version, list(crowded))), path, version)
        for name in (x for names in crowded.values() for x in names):
            remove(spark, spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name)).toString())  # names come percent-encoded
    return len(crowded)


def cache_folder(spark: SparkSession) -> str:
    """Where the query's cache is, run after run."""
    return spark.conf.get("spark.sluice.tokenCache", None) or f"{ensure_checkpoints(spark).rstrip('/')}/token-counts"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of all documents by the byte-level vocabulary."""
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache_folder(spark))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
