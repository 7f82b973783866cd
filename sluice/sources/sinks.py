"""Writers of what the engine makes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.chunks import columns_of_chunk
from sluice.operators.dedup import path_parts
from sluice.operators.entities import ENTITY
from sluice.operators.report import duplicate_lines, event_lines
from sluice.operators.shared import _place


def chunks(kept: DataFrame, path: str) -> None:
    """JSON lines, in parallel."""
    columns_of_chunk(kept).write.mode("overwrite").json(path)


def chunk_array(kept: DataFrame, path: str) -> None:
    """One file with one JSON array, in the order of files and chunks. It is written by one task, as the rows come."""
    spark, own = kept.sparkSession, f"{path}.parts"
    rows = kept.orderBy(path_parts(F.col("source_file")), "seq", "part")
    lines = columns_of_chunk(rows).select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))

    def array(batches):
        import pandas as pd

        first = True
        for b in batches:
            if len(b):
                yield pd.DataFrame({"value": [("[" if first and not i else ",") + x for i, x in enumerate(b["value"])]})
                first = False
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    lines.coalesce(1).mapInPandas(array, "value string").write.mode("overwrite").text(own)
    files, place = _place(spark, own)
    made = [x.getPath() for x in files.listStatus(place) if x.getPath().getName().startswith("part-") and x.getLen()]
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files.delete(target, True)
    if made:
        files.rename(made[0], target)
    else:  # a table without rows has no task
        empty = files.create(target)
        empty.write(bytearray(b"[]"))
        empty.close()
    files.delete(place, True)


class Together:
    """Outputs below one folder that are published together: each is written below a staging folder, and when all are whole they take
    the places of the old ones. If writing fails the old ones stay; if publishing is cut short, opening the folder again ends it."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out, self.names = spark, out.rstrip("/"), []
        self.staging = f"{self.out}/_staging-{uuid.uuid4().hex}"
        self._finish()

    def path(self, name: str) -> str:
        """Where to write an output now."""
        self.names.append(name)
        return f"{self.staging}/{name}"

    def publish(self) -> None:
        files, _ = _place(self.spark, self.out)
        files.create(self._at(f"{self.staging}/_ready")).close()
        self._finish()

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _finish(self) -> None:
        """Moves what is ready, removes what was left unfinished."""
        files, place = _place(self.spark, self.out)
        for folder in [x.getPath() for x in files.listStatus(place)] if files.exists(place) else []:
            if not folder.getName().startswith("_staging-"):
                continue
            if files.exists(self._at(f"{folder}/_ready")):
                for one in [x.getPath() for x in files.listStatus(folder) if x.getPath().getName() != "_ready"]:
                    target = self._at(f"{self.out}/{one.getName()}")
                    files.delete(target, True)
                    files.rename(one, target)
            files.delete(folder, True)

    def __enter__(self) -> Together:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.publish()
        else:
            files, _ = _place(self.spark, self.out)
            files.delete(self._at(self.staging), True)


def report(row: DataFrame, path: str) -> None:
    """One row as pretty JSON."""
    row.select(F.to_json(F.struct(*row.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def error_log(dropped: DataFrame, path: str) -> None:
    duplicate_lines(dropped).select(F.format_string("[%s] %s", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "value").alias("value")).write.mode("overwrite").text(path)


def event_log(kept: DataFrame, path: str) -> None:
    event_lines(kept).write.mode("overwrite").text(path)


def markdown(pages: DataFrame, path: str) -> None:
    """name, markdown as a table, not as a file a page."""
    pages.write.mode("overwrite").parquet(path)


def entities(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def empty_entities(spark: SparkSession, path: str) -> None:
    """An empty table of entities, unless there is one."""
    spark.createDataFrame([], ENTITY).write.mode("ignore").json(path)
