"""What the operators of this subpackage share: blocks of texts as numpy arrays, hashes of words and windows, folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.shared import ensure_checkpoints, settled  # noqa: F401 the operators here take them from this module

#: Bytes of text that a worker turns into arrays at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
MASK = (1 << 64) - 1
#: An odd multiplier of the rolling hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, so other columns can't clash with an operator's own; a null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared one."""
    return f"{ensure_checkpoints(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


class Shelf:
    """Tables that an operator writes to the shared folder on its way and removes when it has used them."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path, self.n = spark, shared_path(spark, what), 0
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, read back."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if id(t) in self.held:
                remove(self.spark, self.held.pop(id(t))[1])

    def close(self) -> None:
        self.held.clear()
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of one block of a bit table, and how many tasks make the blocks at most.
BLOCK_BITS, BLOCK_TASKS = 1 << 20, 64


def bit_table(positions: DataFrame, column: str, n_bits: int) -> np.ndarray:
    """n_bits bits as bytes, those at the column's values set. Blocks of bytes are made by tasks, so the driver gets n_bits / 8 bytes."""

    def task(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.unique(b.column(0).to_numpy(zero_copy_only=False))
            cut = np.flatnonzero(np.diff(at // BLOCK_BITS, prepend=-1))
            for part in np.split(at, cut[1:]) if len(at) else ():
                block = held.setdefault(int(part[0]) // BLOCK_BITS, np.zeros(BLOCK_BITS // 8, dtype=np.uint8))
                inside = part % BLOCK_BITS
                np.bitwise_or.at(block, inside >> 3, np.uint8(1) << (inside & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])

    out = np.zeros(-(-n_bits // BLOCK_BITS) * (BLOCK_BITS // 8), dtype=np.uint8)
    tasks = min(BLOCK_TASKS, -(-n_bits // BLOCK_BITS))
    dealt = positions.select(F.col(column).alias("at")).distinct().repartition(tasks, F.expr(f"at div {BLOCK_BITS}"))
    for r in dealt.mapInArrow(task, "block long, bits binary").collect():
        out[r["block"] * (BLOCK_BITS // 8) : (r["block"] + 1) * (BLOCK_BITS // 8)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out[: (n_bits + 7) // 8]


class KeySet:
    """64-bit keys for workers: sorted while they are at most ``most``, else the bits of their residues.

    The bits also take in some other keys; whoever asks must be right in that case too.
    """

    def __init__(self, keys: DataFrame, column: str, most: int, n_bits: int = 1 << 28):
        found = keys.select(F.col(column).alias("key"))
        self.sorted, self.bits, self.n_bits = np.empty(0, dtype=np.uint64), None, n_bits
        if (n := found.count()) > most:
            self.bits = bit_table(found.select(F.pmod("key", F.lit(n_bits)).alias("at")), "at", n_bits)
        elif n:
            self.sorted = np.sort(np.array([r["key"] for r in found.collect()], dtype=np.int64).view(np.uint64))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            at = keys & np.uint64(self.n_bits - 1)
            return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        if not len(self.sorted):
            return np.zeros(len(keys), dtype=bool)
        return self.sorted[np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)] == keys


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most limit bytes in a column of strings, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


@lru_cache(maxsize=4)
def _powers(base: int, step: int, n: int) -> np.ndarray:
    """base^0, base^step, base^(2 step), ..: n of them."""
    out = np.full(n, pow(base, step, 1 << 64), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, at: np.ndarray | int) -> np.ndarray:
    """base^i modulo 2^64 for each i, or for all below a number; from two short tables."""
    low = _powers(base, 1, 2048)
    if isinstance(at, int):
        return np.multiply.outer(_powers(base, 2048, 1 << max(10, (at >> 11).bit_length()))[: (at >> 11) + 1], low).ravel()[:at]
    top = int(at.max(initial=0)) >> 11
    return _powers(base, 2048, 1 << max(10, top.bit_length()))[at >> 11] * low[at & 2047]


BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with span_hash(H, s, e) the same for equal bytes buf[s:e], wherever they stand."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[buf] * powers(BASE, len(buf)), out=out[1:])
    return out


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (h[e] - h[s]) * powers(INVERSE, s)


WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, each followed by one space in ``buf``.

    start, end: of each word in buf; doc: its text's number; first: the number of each text's first word, and the total.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.raw, self.raw_start = raw, np.concatenate([[0], np.cumsum(lengths)])
        solid = ~WHITE[raw]
        self.solid = solid
        before = np.concatenate([[False], solid[:-1]])
        starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(~solid & before)
        keep = solid | before
        self.buf = np.where(solid, raw, np.uint8(32))[keep]
        self.end = np.cumsum(ends - starts + 1) - 1
        self.start = self.end - (ends - starts)
        self.first = np.searchsorted(starts, self.raw_start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same for the same word."""
        return mix(span_hash(prefix_hash(self.buf), self.start, self.end))

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each window of n words within one text, and the window's hash."""
        if len(hashes) < n:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        m = len(hashes) - n + 1
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(n):
            out = out * np.uint64(BASE) + hashes[at + j]
        return at, mix(out)
