"""Documents as they arrive: new Markdown files become chunks, and a chunk whose hash was seen in an earlier batch is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.conf import ChunkConf
from sluice.operators import chunks as K
from sluice.operators.dedup import split_duplicates
from sluice.operators.report import duplicate_lines
from sluice.operators.shared import exists, remove, settled, written
from sluice.sources.readers import relative

FILE = "source_file string, raw string"
SEEN = "hash string, chunk_id string, batch long"


def files(spark: SparkSession, path: str, max_files: int = 1000, root: str | None = None) -> DataFrame:
    """A stream of whole Markdown files below a folder; source_file is the path from root, by default the folder that holds it."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", max_files).load(path)
    top = root if root is not None else path.rstrip("/").rpartition("/")[0] or "."
    return rows.select(relative(spark, F.col("_metadata.file_path"), top).alias("source_file"), F.col("value").alias("raw"))


class SeenHashes:
    """The hashes of earlier batches' chunks with their ids, in folders by the first digits of the hash.

    A batch reads only the folders of its own hashes, of those only as many files as merging leaves: every MERGE batches a folder's
    files become one. What a batch adds is named after it, so a batch that runs again replaces its own and sees none of it.
    """

    MERGE = 16

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits

    def before(self, batch: int, hashes: DataFrame) -> DataFrame:
        """hash, original_id of a batch's hashes (hash) that an earlier batch has."""
        prefix = F.substring("hash", 1, self.digits)
        rows, kinds = [], {r[0] for r in hashes.select(prefix).distinct().collect()}  # 256 at most
        for folder, first, last in self._folders():
            if first < batch:
                rows.append(self.spark.read.schema(SEEN + ", prefix string").parquet(folder).filter(F.col("prefix").isin(sorted(kinds)) & (F.col("batch") < batch)))
        if not rows or not kinds:
            return self.spark.createDataFrame([], "hash string, original_id string")
        out = rows[0]
        for x in rows[1:]:
            out = out.unionByName(x)
        return out.join(hashes.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.min_by("chunk_id", "batch").alias("original_id"))

    def add(self, batch: int, kept: DataFrame) -> None:
        rows = kept.select("hash", "chunk_id", F.lit(batch).cast("long").alias("batch"), F.substring("hash", 1, self.digits).alias("prefix"))
        rows.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/{batch}-{batch}")
        own = [x for x in self._folders() if x[2] <= batch]
        for size in (self.MERGE, self.MERGE**2, self.MERGE**3):
            level = [x for x in own if x[2] - x[1] + 1 == size // self.MERGE and x[1] // size == batch // size]
            if len(level) == self.MERGE:
                self._merge(level)
                own = [x for x in self._folders() if x[2] <= batch]

    def _merge(self, level: list[tuple[str, int, int]]) -> None:
        first, last = level[0][1], level[-1][2]
        rows = self.spark.read.schema(SEEN + ", prefix string").parquet(level[0][0])
        for folder, *_ in level[1:]:
            rows = rows.unionByName(self.spark.read.schema(SEEN + ", prefix string").parquet(folder))
        rows.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/{first}-{last}")
        for folder, *_ in level:  # until they are gone both are read, which changes nothing
            remove(self.spark, folder)

    def _folders(self) -> list[tuple[str, int, int]]:
        """Whole ones, with their first and last batch, in order."""
        if not exists(self.spark, self.path):
            return []
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [x.getPath().getName() for x in place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place)]
        found = [(f"{self.path}/{n}", *map(int, n.split("-"))) for n in names if n.replace("-", "").isdigit()]
        return sorted((x for x in found if exists(self.spark, f"{x[0]}/_SUCCESS")), key=lambda x: (x[1], x[2]))


def chunk_stream(stream: DataFrame, out: str, checkpoint: str, registry: DataFrame | None = None, conf: ChunkConf = ChunkConf()) -> StreamingQuery:
    """Appends each batch's new chunks to a Parquet table, a folder a batch; a batch that runs again replaces its own. Lines for
    duplicates, within the batch and of earlier ones, go to {out}_log and seen hashes to {out}_seen.

    Segmentation needs a document's lines in order, which streams don't offer, so it works on batches. Within a batch the first in
    the order of files wins, and an earlier batch wins over a later one.
    """

    def batch(rows: DataFrame, n: int) -> None:
        seen = SeenHashes(rows.sparkSession, f"{out}_seen")
        kept, dropped = split_duplicates(settled(K.build_chunks(rows, registry, conf)))
        kept = settled(kept)
        earlier = settled(seen.before(n, kept.select("hash")))
        new = written(K.columns_of_chunk(kept.join(earlier, "hash", "left_anti")), f"{out}/batch={n}")
        repeats = kept.join(earlier, "hash").select("hash", "original_id", "source_file")
        inside = dropped.select("hash", "original_id", "source_file").join(earlier.withColumnRenamed("original_id", "older"), "hash", "left")
        inside = inside.select("hash", F.coalesce("older", "original_id").alias("original_id"), "source_file")
        duplicate_lines(repeats.unionByName(inside)).write.mode("overwrite").text(f"{out}_log/batch={n}")
        seen.add(n, new)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type in tumbling windows, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
