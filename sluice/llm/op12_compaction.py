"""Compaction that is planned in Spark SQL and carried out: small files of a day are packed first-fit into groups, and each group of
several becomes one file.

1. ``start`` writes a table as files, one for each (day, lot, piece), in a flat folder: rows go to the partition of their file's
   number and are sorted there, so a task writes one file, streaming.
2. ``PLAN`` collects each day's small files as sorted structs, folds them by aggregate() into an array of groups, each file into the
   earliest group that has room for it, and explodes the groups into one row a source file.
3. ``compact`` writes the plan and the merged files beside the data, in a folder that readers ignore, then moves the merged files in
   and deletes their sources. ``publish`` can run again: if the driver was lost while files moved, it ends with the same folder.
   Other files aren't touched.
4. ``describe`` reads the final files back. A digest over a whole file takes its rows in order in one task, streaming.

What is planned with is a row a file. A day has at most 600 files however many rows it holds, since a lot has at least a 150th of
all rows: so the number of files grows with the days only. Tables of days and files are broadcast up to SMALL rows and joined by
a shuffle beyond. Names of merged groups' sources come to the driver one partition at a time to be deleted.

A null time is a day of its own (null); null keys count as empty text in hashes and come first in a file. Rows that are equal in time
and key stand in any order in a starting file, and merging keeps it. Any other columns, whatever their names, are kept as they are
(but for one named _metadata). An empty table gives no files and no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, remove, settled, shared_path, table

#: Days or files that are broadcast at most, of some 100 bytes each.
SMALL = 50_000
#: Parts of all rows: a lot's least, a small file's most, a merged file's most.
LOT, FEW, MOST = 150, 600, 400
WORK = "_compaction"

PLAN = """
WITH days AS (
  SELECT day, array_sort(collect_list(struct(-n_rows AS less, lot, piece, path))) AS files FROM {files} WHERE n_rows < :few GROUP BY day),
folded AS (
  SELECT day, aggregate(
    files,
    cast(array() AS array<struct<n: bigint, files: array<struct<less: bigint, lot: bigint, piece: bigint, path: string>>>>),
    (groups, f) -> element_at(transform(
      array(array_position(transform(groups, g -> g.n - f.less <= :most), true)),
      at -> if(at = 0,
        array_append(groups, named_struct('n', -f.less, 'files', array(f))),
        transform(groups, (g, i) -> if(i = at - 1, named_struct('n', g.n - f.less, 'files', array_append(g.files, f)), g)))), 1)
  ) AS groups FROM days),
grouped AS (SELECT day, posexplode(groups) AS (at, g) FROM folded),
several AS (SELECT day, at, g.files AS files FROM grouped WHERE size(g.files) > 1)
SELECT day, at, files[0].lot AS lot, files[0].piece AS piece, array_join(transform(files, f -> concat(f.lot, '-', f.piece)), ',') AS sources, posexplode(files.path) AS (place, path) FROM several
"""

RESULT = "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean"


def share(rows: int, part: int) -> int:
    """Just over one part of all rows."""
    return 1 + rows // part


def day_of(time: Column) -> Column:
    return F.unix_date(time.cast("date")).cast("long")


def hash_of(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def lot_of(h: Column, lots: Column) -> Column:
    return F.floor(h / 16) % lots


def piece_of(h: Column) -> Column:
    return F.least(h % 4, F.floor(h / 4) % 4)


def small(df: DataFrame) -> DataFrame:
    """To be broadcast, if its size allows it."""
    return F.broadcast(df) if df.count() <= SMALL else df


def numbered(files: DataFrame, name: str, *by: str) -> DataFrame:
    """Adds numbers from 0 without gaps: by day, and within a day (of at most 600 files) by other columns. One task sees a row a day."""
    inside = files.withColumn(name, F.row_number().over(Window.partitionBy("day").orderBy(*by)))
    days = inside.groupBy("day").agg(F.max(name).alias("held"))
    before = F.sum("held").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held") - 1
    days = days.select(F.col("day").alias("of"), before.alias("before"))
    return inside.join(days, F.col("day").eqNullSafe(F.col("of"))).withColumn(name, (F.col(name) + F.col("before")).cast("int")).drop("of", "before")


class Layout:
    """How a table of so many rows is laid out in files: the lots of each day. time and key name two of its columns."""

    def __init__(self, df: DataFrame, shelf: Shelf, time: str = "arrived_at", key: str = "click_id"):
        self.shelf, self.time, self.key = shelf, time, key
        counts = shelf.keep(df.groupBy(day_of(F.col(time)).alias("day")).agg(F.count("*").alias("n")))
        self.rows = counts.agg(F.sum("n")).first()[0] or 0
        self.days = counts.select(F.col("day").alias("of"), (1 + F.floor(F.col("n") / share(self.rows, LOT))).alias("lots"))

    def named(self, rows: DataFrame, time: Column, key: Column, *columns: Column) -> DataFrame:
        """day, lot, piece of each row, and the columns."""
        out = rows.select(day_of(time).alias("day"), hash_of(key).alias("h"), *columns)
        out = out.join(small(self.days), F.col("day").eqNullSafe(F.col("of")))
        return out.withColumns({"lot": lot_of(F.col("h"), F.col("lots")), "piece": piece_of(F.col("h"))}).drop("of", "lots", "h")


def start(df: DataFrame, folder: str, layout: Layout) -> None:
    """Writes the starting files of df, unless it has no rows."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("whole")
    rows = layout.named(df, F.col(layout.time), F.col(layout.key), whole)
    files = layout.shelf.keep(numbered(rows.select("day", "lot", "piece").distinct(), "id", "lot", "piece").withColumnsRenamed({"day": "d", "lot": "l", "piece": "p"}))
    if n := files.count():
        same = F.col("day").eqNullSafe(F.col("d")) & (F.col("lot") == F.col("l")) & (F.col("piece") == F.col("p"))
        dealt = rows.join(small(files), same).repartitionById(n, "id")
        dealt.sortWithinPartitions(f"whole.`{layout.time}`", f"whole.`{layout.key}`").select("whole.*").write.parquet(folder)


def placed(spark: SparkSession, folder: str, **columns: str) -> DataFrame:
    """path, place (in its file) and some columns, under the names given, of the rows of the folder's files."""
    own = [F.col(f"`{c}`").alias(name) for name, c in columns.items()]
    return spark.read.parquet(folder).select(*own, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"))


def first_rows(rows: DataFrame, layout: Layout, *sums: Column) -> DataFrame:
    """A row a file of rows (path, place, time, key): path, n_rows, sums, and the day, lot and piece of its first row."""
    first = F.min_by(F.struct("time", "key"), "place").alias("first")
    files = rows.groupBy("path").agg(F.count("*").alias("n_rows"), first, *sums)
    return layout.named(files, F.col("first.time"), F.col("first.key"), *(F.col(c) for c in files.columns if c != "first"))


def plan(spark: SparkSession, files: DataFrame, rows: int) -> DataFrame:
    """Of files (day, lot, piece, n_rows, path) of a table with so many rows: day, at (number of its group), lot and piece (of the group's
    first source), sources, place (in its group), path. Only groups of several."""
    return spark.sql(PLAN, args={"few": share(rows, FEW), "most": share(rows, MOST)}, files=files)


def compact(spark: SparkSession, folder: str, layout: Layout) -> DataFrame:
    """Plans, merges and publishes; returns the plan."""
    work = f"{folder}/{WORK}"
    files = layout.shelf.keep(first_rows(placed(spark, folder, time=layout.time, key=layout.key), layout))
    plan(spark, files, layout.rows).write.parquet(f"{work}/plan")
    made = layout.shelf.keep(spark.read.parquet(f"{work}/plan"))  # publishing removes the other
    groups = numbered(made.filter("place = 0").select("day", "at"), "id", "at")
    groups = layout.shelf.keep(made.select("day", "at", F.col("place").alias("nth"), F.col("path").alias("source")).join(groups.withColumnsRenamed({"day": "d", "at": "a"}), F.col("day").eqNullSafe(F.col("d")) & (F.col("at") == F.col("a"))))
    if n := groups.filter("nth = 0").count():
        data = spark.read.parquet(folder)
        whole = F.struct(*(F.col(f"`{c}`") for c in data.columns)).alias("whole")
        rows = data.select(whole, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"))
        merged = rows.join(small(groups.select("source", "id", "nth")), F.col("path") == F.col("source")).repartitionById(n, "id")
        merged.sortWithinPartitions("nth", "place").select("whole.*").write.parquet(f"{work}/files")
    _files(spark, work).create(_path(spark, f"{work}/ready")).close()
    publish(spark, folder)
    return made


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, folder: str) -> None:
    """Moves merged files into the folder, then deletes their sources. Can run again; without a finished merge it only clears up."""
    work, files = f"{folder}/{WORK}", _files(spark, folder)
    make, address = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.java.net.URI  # looked up once
    if files.exists(_path(spark, f"{work}/ready")):
        if files.exists(_path(spark, f"{work}/files")):
            waiting = files.listFiles(_path(spark, f"{work}/files"), False)
            while waiting.hasNext():
                one = waiting.next().getPath()
                if one.getName().startswith("part-"):
                    files.rename(one, make(f"{folder}/merged-{one.getName()}"))
        for r in spark.read.parquet(f"{work}/plan").select("path").toLocalIterator():
            files.delete(make(address(r["path"])), False)
    remove(spark, work)


def ids_digest(rows: DataFrame, n: int) -> DataFrame:
    """id, ids_sha256 of n files: rows (id, place, key) of a file meet in one task, in order, and are hashed as they come."""
    tasks = min(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def task(batches):
        made: dict[int, object] = {}
        for b in batches:
            ids, keys = b.column("id").to_numpy(), b.column("key").to_pylist()
            ends = [i + 1 for i in range(len(ids) - 1) if ids[i] != ids[i + 1]] if len(ids) and ids[0] != ids[-1] else []
            for s, e in zip([0, *ends], [*ends, len(ids)], strict=True):
                if s < e:
                    text = ",".join("" if k is None else str(k) for k in keys[s:e])
                    if (held := made.get(int(ids[s]))) is None:
                        made[int(ids[s])] = hashlib.sha256(text.encode())
                    else:
                        held.update(f",{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([x.hexdigest() for x in made.values()], pa.string())], names=["id", "ids_sha256"])

    return rows.repartitionById(tasks, F.col("id") % tasks).sortWithinPartitions("id", "place").select("id", "key").mapInArrow(task, "id int, ids_sha256 string")


def describe(spark: SparkSession, folder: str, layout: Layout, made: DataFrame, value: str = "value") -> DataFrame:
    """A row for each final file (see RESULT); made is the plan."""
    rows = placed(spark, folder, time=layout.time, key=layout.key, value=value)
    cents = F.sum(F.coalesce(F.floor(100 * F.col("value") + F.lit(0.5)).cast("long"), F.lit(0))).alias("cents")
    files = first_rows(rows, layout, F.min("key").alias("min_click_id"), F.max("key").alias("max_click_id"), cents)
    groups = made.filter("place = 0").select(F.col("day").alias("d"), F.col("lot").alias("l"), F.col("piece").alias("p"), "sources")
    files = files.join(groups, F.col("day").eqNullSafe(F.col("d")) & (F.col("lot") == F.col("l")) & (F.col("piece") == F.col("p")), "left").drop("d", "l", "p")
    files = layout.shelf.keep(numbered(files, "id", "lot", "piece"))
    digests = ids_digest(rows.select("path", "place", "key").join(small(files.select("path", "id")), "path"), files.count())
    out = files.join(digests, "id").withColumns({"rewritten": F.col("sources").isNotNull(), "sources": F.coalesce("sources", F.concat("lot", F.lit("-"), "piece")), "columns": F.lit(",".join(spark.read.parquet(folder).columns))})
    return out.select(*(x.split()[0] for x in RESULT.split(", ")))


def op12_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clicks: written to a new folder below the shared one, compacted there, and read back; the folder stays."""
    clicks, folder, shelf = table(spark, sf_dir, "clicks"), shared_path(spark, "compacted"), Shelf(spark, "compaction")
    try:
        layout = Layout(clicks, shelf)
        if not layout.rows:
            return spark.createDataFrame([], RESULT)
        start(clicks, folder, layout)
        return settled(describe(spark, folder, layout, compact(spark, folder, layout)))
    finally:
        shelf.close()
