"""Media columns: payloads as 8-bit audio, cut into chunks by content, each distinct chunk stored once, read back and verified.

A payload is a text's UTF-8 bytes and zeros up to a positive multiple of 64; as media it is a WAV file of unsigned 8-bit
mono samples, so the samples are the payload's bytes. A rolling gear hash over the last 32 bytes cuts chunks where its
masked bits are 0, between a least and a greatest length; equal stretches of different payloads give equal chunks.

1. Each task lists its distinct payloads: key (SHA-256 of the text), the owner (the smallest id that has the text) and the
   ordered digests of the chunks. Partial aggregates leave one row a payload; another finds digests of several payloads,
   whose home is the payload with the smallest key.
2. The store has a row for each payload: its ordered digests, and the bytes of those chunks whose home it is. Rows of
   documents that own no payload, and chunks that live elsewhere, are left out by joins with the (fewer) payloads and
   digests that occur more than once. Each chunk is stored once.
3. Payloads whose chunks are all in their own row are read back without a shuffle. For the others the missing digests
   are joined to the rows that hold them. Each chunk's digest is checked, then the payload's, before features are computed;
   a mismatch fails the task.
4. Values go back to all rows by key; adaptive execution splits the joins' hot keys, whose rows hold no bytes.

Adaptive execution splits a hot key's partition where it is larger than spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes;
below that a task reads it whole, some 60 bytes a row.

Only id and text are read, so other columns can't clash. A very long text is a payload of many chunks; a worker holds some 10
bytes a byte of it, and its row of the store the chunks that live there.
Null and empty texts are one payload of 64 zeros. Rows with equal or null ids stay rows of their own. An empty table gives
no rows. A store's folder must be new or empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, keyed_text, remove, settled, shared_path, table, texts_of

PAD = 64
RATE = 8000
LEAST, GREATEST, MASK_BITS = 1024, 16384, 11
#: Keys or digests that are broadcast at most (60 bytes each); beyond it they are joined by a shuffle.
SMALL = 500_000
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
VALUES = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: bytes) -> bytes:
    return text + bytes(max(PAD, -len(text) // PAD * -PAD) - len(text))


def wav_header(n: int) -> bytes:
    """Of n unsigned 8-bit mono samples (n is even)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def gear_cuts(payloads: list[bytes]) -> list[list[int]]:
    """The ends of each payload's chunks."""
    buf = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    h = GEAR[buf]
    for k in (1, 2, 4, 8, 16):  # after each step h covers twice as many bytes
        shifted = h[:-k] << np.uint32(k)
        h[k:] += shifted
    marks = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    out, base = [], 0
    for p in payloads:
        ends, at, n = [], 0, len(p)
        own = (marks[np.searchsorted(marks, base) : np.searchsorted(marks, base + n, side="right")] - base).tolist()
        for m in own:
            while m - at > GREATEST:
                at += GREATEST
                ends.append(at)
            if m - at >= LEAST:
                at = m
                ends.append(at)
        while n - at > GREATEST:
            at += GREATEST
            ends.append(at)
        if at < n:
            ends.append(n)
        out.append(ends)
        base += n
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=20).digest()


def chunked(texts: list[bytes]):
    """(payload, chunks, digests) of each text."""
    payloads = [payload_of(t) for t in texts]
    for p, ends in zip(payloads, gear_cuts(payloads), strict=True):
        chunks = [p[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        yield p, chunks, [digest_of(c) for c in chunks]


def feature_of(payload: bytes) -> str:
    """Samples, their mean, root mean square about 128, peak, and crossings of 128, from whole numbers."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"{len(x)}:{x.sum() / len(x):.6f}:{(np.square(x).sum() / len(x)) ** 0.5:.6f}:{np.abs(x).max()}:{crossings}"


def values_of(payload: bytes) -> tuple:
    media = wav_header(len(payload)) + payload
    samples = media[44:]
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples)


def with_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    return keyed_text(docs, key, text).withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def payload_list(rows: DataFrame) -> DataFrame:
    """key, owner, digests: each distinct payload once."""

    def task(batches):
        seen: dict[bytes, int | None] = {}
        for b in blocks(batches, "text"):
            ids, keys = b.column("doc_id").to_pylist(), b.column("key").to_pylist()
            fresh = []
            for i, (k, d) in enumerate(zip(keys, ids, strict=True)):
                if k not in seen or d is not None and (seen[k] is None or d < seen[k]):
                    seen[k] = d
                    fresh.append(i)
            if len(seen) > 500_000:
                seen.clear()
            if fresh:
                texts = texts_of(b)
                digests = [d for _, _, d in chunked([texts[i] for i in fresh])]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in fresh], pa.binary()), pa.array([ids[i] for i in fresh], pa.int64()), pa.array(digests, pa.list_(pa.binary()))], names=["key", "owner", "digests"])

    listed = rows.mapInArrow(task, "key binary, owner long, digests array<binary>")
    return listed.groupBy("key").agg(F.min("owner").alias("owner"), F.first("digests").alias("digests"))


def write_store(docs: DataFrame, store: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the store and returns key, digests of each payload."""
    rows = with_key(docs, key, text)
    payloads = settled(payload_list(rows))
    homes = payloads.select("key", F.explode(F.array_distinct("digests")).alias("digest")).groupBy("digest").agg(F.min("key").alias("home"), F.max("key").alias("other"))
    shared = homes.filter("home < other").select("digest", "home")
    away = payloads.select("key", F.explode(F.array_distinct("digests")).alias("digest")).join(shared, "digest").filter("key <> home").groupBy("key").agg(F.collect_set("digest").alias("away"))
    copies = settled(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")).filter("n > 1").select("key", "owner"))
    if copies.count() <= SMALL:
        own = rows.join(F.broadcast(copies.withColumn("copied", F.lit(True))), "key", "left").filter("copied is null or doc_id <=> owner")
    else:  # by key and id, so copies of one text go to many tasks
        owners = payloads.select(F.col("key").alias("k"), "owner")
        own = rows.join(owners, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("owner")), "left_semi")
    away = settled(away)
    small = (away.agg(F.sum(F.size("away") + 1)).first()[0] or 0) <= SMALL
    own = own.select("key", "text").join(F.broadcast(away) if small else away, "key", "left")

    def task(batches):
        seen: set[bytes] = set()
        for b in blocks(batches, "text"):
            keys, away = b.column("key").to_pylist(), b.column("away").to_pylist()
            held: list[list] = []
            texts = texts_of(b)
            for k, gone, n, (_, chunks, digests) in zip(keys, away, map(len, texts), chunked(texts), strict=True):
                if k in seen:  # equal rows
                    continue
                if gone is not None or len(seen) < 100_000:
                    seen.add(k)
                mine = {d: c for d, c in zip(digests, chunks, strict=True) if not gone or d not in gone}
                held.append([k, n, digests, list(mine), list(mine.values()), len(set(digests)) - len(mine)])
            if held:
                kinds = [pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["key", "n", "digests", "own", "data", "missing"])

    out = own.mapInArrow(task, "key binary, n long, digests array<binary>, own array<binary>, data array<binary>, missing long")
    out.write.option("compression", "zstd").parquet(store)
    return payloads.select("key", "digests")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The values of each payload in the store, rebuilt from its chunks."""
    kept = spark.read.parquet(store)
    lacking = kept.filter("missing > 0")
    wanted = lacking.select("key", F.explode(F.array_except(F.array_distinct("digests"), "own")).alias("digest"))
    held = kept.select(F.explode(F.arrays_zip("own", "data")).alias("chunk")).select(F.col("chunk.own").alias("digest"), F.col("chunk.data").alias("data"))
    needs = settled(wanted.select("digest").distinct())
    needed = held.join(F.broadcast(needs) if needs.count() <= SMALL else needs, "digest").dropDuplicates(["digest"])
    fetched = wanted.join(needed, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "data")).alias("more"))
    whole = kept.filter("missing = 0").withColumn("more", F.lit(None).cast("array<struct<digest:binary,data:binary>>"))
    full = whole.unionByName(lacking.join(fetched, "key")).select("key", "n", "digests", "own", "data", "more")

    def task(batches):
        for b in batches:
            rows = []
            for key, n, digests, own, data, more in zip(*(b.column(i) for i in range(6)), strict=True):
                chunks = dict(zip(own.as_py(), data.as_py(), strict=True)) | {x["digest"]: x["data"] for x in more.as_py() or ()}
                if any(digest_of(c) != d for d, c in chunks.items()):
                    raise ValueError("a stored chunk doesn't fit its digest")
                payload = b"".join(chunks[d] for d in digests.as_py())
                if hashlib.sha256(payload[: n.as_py()]).digest() != key.as_py() or payload != payload_of(payload[: n.as_py()]):
                    raise ValueError("a payload read back doesn't fit its key")
                rows.append((key.as_py(), *values_of(payload)))
            if rows:
                kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in VALUES.split(", ")])

    return full.mapInArrow(task, VALUES).dropDuplicates(["key"])


def media(docs: DataFrame, store: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the payloads of docs to the store, and returns what each row's has when read back."""
    write_store(docs, store, key, text)
    rows = with_key(docs, key, text).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "key")
    return rows.join(settled(read_store(docs.sparkSession, store)), "key").drop("key")  # settled: a join of plain shuffles can be split


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, through a new store in the shared folder, which goes when all payloads have been read back."""
    store = shared_path(spark, "media")
    try:
        return media(table(spark, sf_dir, "documents"), store)
    finally:
        remove(spark, store)
