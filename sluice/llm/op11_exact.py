"""Exact dedup through a persistent digest index, bucketed and sorted by digest. Native operations only.

The index is a Parquet table (digest, doc_id, row, batch) below a folder, bucketed and sorted by the SHA-256 of normalised
texts, one partition a batch. A batch of new data is grouped by digest, so copies meet in a partial aggregate before anything
moves; groups whose digest an earlier batch has are dropped by a sort-merge anti-join, for which the index isn't shuffled, as
it is in buckets (of which there should be at least as many as shuffle partitions, else Spark deals it out anew); the others are appended as the batch's partition. A batch that runs again replaces its own partition and
changes nothing else.

Of a batch's equal texts the row with the largest id stays; of batches the earlier one. The query wants the largest id of all,
so its rows arrive in two batches, larger ids first. Text is read once: what moves after that is digests. Decisions return to
rows by digest: the few digests with a thousandth of all rows and more (at most 1,000 by counting) are broadcast, so a hot text
doesn't meet in one task, and all others are joined by a shuffle.

Texts are equal when they are identical after lower-casing A-Z; a null text is empty. A null id is smaller than all others,
and of rows with equal texts and ids one stays. An empty table gives no rows. Only id and text are read, so other columns can't
clash. A very long text is one value in a task, hashed whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, keyed_text, lower_ascii, remove, settled, shared_path, table

#: A digest is hot from this part of all rows, and from so many rows; so there are at most HOT_PART hot ones.
HOT_PART, HOT_ROWS = 1000, 1000
COLUMNS = "digest binary, doc_id long, row long"


def normal_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z in lower case."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.unhex(F.sha2(F.when(ascii_only, F.lower(text)).otherwise(lower_ascii(text)).cast("binary"), 256))


class DigestIndex:
    """The index in a folder, opened or begun there. buckets: how many, when it is begun; the shuffle partitions by default."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.name = spark, path.rstrip("/"), f"digest_index_{uuid.uuid4().hex}"
        place = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        held = [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []
        begun = next((int(x.partition("-")[2]) for x in held if x.startswith("buckets-")), None)
        self.buckets = begun or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.where = f"{self.path}/buckets-{self.buckets}"
        files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(self.where))
        spark.sql(f"CREATE TABLE {self.name} ({COLUMNS}, batch int) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.where}'")
        if begun:
            spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def rows(self, before: int | None = None) -> DataFrame:
        """digest, doc_id, row, batch: each digest once. before: only of batches before that one."""
        out = self.spark.table(self.name)
        return out if before is None else out.filter(F.col("batch") < before)

    def unseen(self, batch: int, found: DataFrame) -> DataFrame:
        """digest, doc_id, row: the digests of found (digest, doc_id, row) that no batch before this one has, each with its row of the largest id."""
        groups = found.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"))
        new = groups.join(self.rows(batch).select("digest").hint("merge"), "digest", "left_anti")
        return new.select("digest", "top.doc_id", "top.row")

    def add(self, batch: int, found: DataFrame) -> None:
        """Appends what is unseen as the batch's partition."""
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = {batch})")
        remove(self.spark, f"{self.where}/batch={batch}")  # what an earlier try of this batch has left
        out = self.unseen(batch, found).withColumn("batch", F.lit(batch))
        out.write.insertInto(self.name)

    def kept(self, batch: int) -> DataFrame:
        """doc_id, row of the rows of a batch that stay."""
        return self.rows().filter(F.col("batch") == batch).select("doc_id", "row")

    def close(self) -> None:
        """Forgets the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """digest, doc_id, row (a number of its own for each row)."""
    rows = keyed_text(docs, key, text)
    return rows.select(normal_digest(F.col("text")).alias("digest"), "doc_id", F.monotonically_increasing_id().alias("row"))


def decisions(rows: DataFrame, index: DigestIndex, shelf: Shelf) -> DataFrame:
    """Adds keep_id, group_size and kept to rows (digest, doc_id, row) whose digests the index has."""
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    held = index.rows().select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    groups = shelf.keep(sizes.join(held.hint("merge"), "digest"))
    hot = F.col("group_size") >= max(HOT_ROWS, -(-rows.count() // HOT_PART))
    few = F.broadcast(groups.filter(hot))
    out = rows.join(few, "digest").unionByName(rows.join(few.select("digest"), "digest", "left_anti").join(groups.filter(~hot), "digest"))
    return out.withColumn("kept", F.col("row") == F.col("keep_row"))


def exact_duplicates(docs: DataFrame, index_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row, through a new index in the folder."""
    spark = docs.sparkSession
    shelf, index = Shelf(spark, "exact"), DigestIndex(spark, index_path)
    try:
        rows = shelf.keep(digests(docs, key, text))
        ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
        upper = F.coalesce(F.col("doc_id") > ((ends["low"] or 0) + (ends["high"] or 0)) // 2, F.lit(False))
        index.add(0, rows.filter(upper))
        index.add(1, rows.filter(~upper))
        out = decisions(rows, index, shelf)
        return settled(out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")))
    finally:
        index.close()
        shelf.close()


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, through an index of their own, which goes when all rows have their decision."""
    path = shared_path(spark, "digest-index")
    try:
        return exact_duplicates(table(spark, sf_dir, "documents"), path)
    finally:
        remove(spark, path)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST, r)
"""
