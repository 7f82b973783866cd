"""Packing: best-fit decreasing into windows of a fixed number of tokens.

A document is its ids and then id 0. Documents of a window's length or more are first cut into full windows, each a
sequence of its own. What remains is packed by decreasing length: a segment tree over remaining capacities finds the
open window with the least room that still holds the piece. A task packs its own rows in groups of GROUP remainders, so
memory is bounded (some 500 bytes a piece, 32 MB a group, and one document's ids) and there is no shuffle; a group's few open
windows at the end are the only ones with much padding. Full windows are handed on as they come and close no open ones. A sequence id is the task's number and a counter, so a task that runs again on
the same input gives the same ids.

Null and empty texts are one id (0); repeated rows and ids are packed as rows of their own; an empty table has no pieces. Only
id and text are read, so other columns can't clash. A very long text is many full windows; its ids are held at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import keyed_text, table

WINDOW = 1024
GROUP = 1 << 16
TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of how many there are at each capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.at: dict[int, list] = {}

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, capacity: int, window) -> None:
        if capacity:
            self.at.setdefault(capacity, []).append(window)
            self._add(capacity, 1)

    def tightest(self, length: int):
        """Takes out the window with the least capacity of at least length: (capacity, window), or None."""
        i, tree = length + self.leaves, self.tree
        while not tree[i]:  # up to the first subtree further right that has one
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(number of its window, offset there) of each piece; pieces are no longer than a window."""
    out, windows, n = [(0, 0)] * len(lengths), OpenWindows(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = windows.tightest(lengths[i])
        if found is None:
            found, n = (window, n), n + 1
        room, at = found
        out[i] = (at, window - room)
        windows.put(room - lengths[i], at)
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, group: int = GROUP, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: which ids of which document stand where in which sequence; with_ids adds the ids themselves."""

    def task(batches):
        own, first = bpe.load(tokenizer_path), TaskContext.get().partitionId() << 33
        full, rest = [], []

        def flush(all_of_it: bool):
            nonlocal first, full, rest
            rows = full + rest if all_of_it else full
            if not rows:
                return
            places = [(first + i, 0) for i in range(len(full))]
            first += len(full)
            if all_of_it:
                places += [(first + w, offset) for w, offset in best_fit_decreasing([r[2] for r in rest], window)]
                rest = []
            first = max((s for s, _ in places), default=first - 1) + 1
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.int64()) for c in zip(*places, strict=True)]
            if with_ids:
                arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
            full = []
            for b in pa.Table.from_arrays(arrays, names=names).to_batches(max_chunksize=20_000):
                yield b

        for batch in batches:
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*own.ids(content), 0], dtype="<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    row = (doc, start, len(piece), zlib.crc32(piece), len(ids)) + ((piece.astype(np.int32),) if with_ids else ())
                    (full if len(piece) == window else rest).append(row)
                if len(rest) >= group or len(full) >= group:
                    yield from flush(len(rest) >= group)
        yield from flush(True)

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return keyed_text(docs, key, text).mapInArrow(task, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as windows of 1024 ids of the byte-level vocabulary."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
