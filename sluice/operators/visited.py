"""What was seen, as bits beside the exact tables: most new values are known to be new without a join."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits a URL, and the most bits of a table (they are broadcast: 32 MB). Beyond it more new links look like seen ones, which costs a join.
BITS_EACH, MOST_BITS, LEAST_BITS = 16, 1 << 28, 1 << 16
#: Values up to which a table is broadcast as it is; bits begin beyond.
FEW = 20_000
#: Bits of one block, which is a row on its way to the driver.
BLOCK = 1 << 16


def positions(url: Column, n_bits: int) -> Column:
    """Four bits of a URL."""
    first, step = F.pmod(F.xxhash64(url), F.lit(n_bits)), F.crc32(url.cast("binary"))
    return F.array(*(F.pmod(first + step * F.lit(i), F.lit(n_bits)) for i in range(4)))


def blocks_of(urls: DataFrame, column: str, n_bits: int) -> np.ndarray:
    """The bits of a table's URLs, set by tasks in blocks of bytes; the driver gets at most n_bits / 8 bytes a task's share of blocks."""

    def task(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.unique(b.column(0).to_numpy(zero_copy_only=False))
            for k in np.unique(at // BLOCK):
                inside = at[at // BLOCK == k] % BLOCK
                np.bitwise_or.at(held.setdefault(int(k), np.zeros(BLOCK // 8, dtype=np.uint8)), inside >> 3, np.uint8(1) << (inside & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])

    out = np.zeros(n_bits // 8, dtype=np.uint8)
    at = urls.select(F.explode(positions(F.col(column), n_bits)).alias("at")).repartition(16, F.expr(f"at div {BLOCK}"))  # a block is one task's
    for r in at.mapInArrow(task, "block long, bits binary").toLocalIterator():
        out[r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out


class Visited:
    """Grows level by level; levels are tables in the shared folder, so a larger table of bits can be made of them anew."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.count, self.bits = spark, [], 0, np.zeros(LEAST_BITS // 8, dtype=np.uint8)

    def add(self, level: DataFrame, n: int) -> None:
        """The n URLs of a level (url)."""
        self.levels.append(level.select("url"))
        self.count += n
        if self.count <= FEW:
            return
        wanted = LEAST_BITS
        while wanted < min(MOST_BITS, BITS_EACH * self.count):
            wanted *= 2
        if wanted // 8 != len(self.bits):
            self.bits = blocks_of(self.everything(), "url", wanted)
        elif n:
            self.bits |= blocks_of(self.everything() if self.count - n <= FEW else level, "url", wanted)

    def everything(self) -> DataFrame:
        out = self.levels[0]
        for x in self.levels[1:]:
            out = out.unionByName(x)
        return out

    def split(self, rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """The rows whose value in a column may have been added, and those whose value surely wasn't."""
        if self.count <= FEW:
            known = F.broadcast(self.everything().withColumnRenamed("url", "__known"))
            same = F.col(column) == F.col("__known")
            return rows.join(known, same, "left_semi"), rows.join(known, same, "left_anti")
        n_bits, shared = len(self.bits) * 8, self.spark.sparkContext.broadcast(self.bits)

        @F.pandas_udf("boolean")
        def maybe(at: pd.Series) -> pd.Series:
            x = np.stack(at.to_numpy()) if len(at) else np.empty((0, 4), dtype=np.int64)
            return pd.Series((((shared.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1) == 1).all(axis=1))

        marked = rows.withColumn("__maybe", maybe(positions(F.col(column), n_bits)))
        return marked.filter("__maybe").drop("__maybe"), marked.filter("not __maybe").drop("__maybe")

    def unseen(self, urls: DataFrame) -> DataFrame:
        """The rows of urls (url) that no level has: those with a bit missing as they are, the others by an anti-join."""
        if not self.count:
            return urls
        if self.count <= FEW:
            return self.split(urls, "url")[1]
        doubtful, sure = self.split(urls, "url")
        return sure.unionByName(doubtful.join(self.everything(), "url", "left_anti"))
