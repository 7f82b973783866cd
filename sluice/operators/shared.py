"""Tables that are written on the way to the shared folder, so that later steps don't run earlier ones again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it names none, a temporary one in local mode
    and one below the warehouse, which is shared, elsewhere."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        local = sc.master.startswith("local[") or sc.master == "local"
        sc.setCheckpointDir(named or (tempfile.mkdtemp(prefix="checkpoints-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"))
    return named or str(sc._jsc.sc().getCheckpointDir().get())


def settled(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared one."""
    return f"{ensure_checkpoints(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _place(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    files, where = _place(spark, path)
    files.delete(where, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """The same rows, from a table in that folder; what an earlier try has left there goes."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(spark: SparkSession, path: str) -> DataFrame | None:
    """The table in the folder, if it was written to its end."""
    return spark.read.parquet(path) if exists(spark, f"{path}/_SUCCESS") else None
