"""Substring dedup: words covered by a window of words that also starts in a document with a smaller id are removed.

The unit is a window of WINDOW consecutive words. The minimiser of a window is the smallest hash of its runs of RUN
words; equal windows have equal minimisers. Consecutive windows of one document with one minimiser make a super-k-mer,
which travels as one string: the text from its first window's first word to its last window's last word, each word
followed by one space. Strings of one bucket (a range of minimisers) travel packed and compressed. In the bucket, sorting
brings equal windows together, so each window's count and smallest document are exact. Sorting goes by a 64-bit rolling
hash; each run of windows that is found repeated is then compared byte by byte with what it repeats, and a bucket
where a comparison fails is done again with whole strings as keys.

Scale. A task drops strings that it has met in a document with a smaller id, as their windows are decided there and
then (decisions travel separately, dealt by document), so thousands of copies of a document send each string once a
task. A minimiser that still has more than HOT strings (a passage in many different surroundings) would make one bucket
too large; a first pass counts strings and their bytes by minimiser, and the windows of hot ones travel one by one as
128-bit digests, each once a task in its smallest document, so that no bucket gathers them. Up to HOT_KEYS hot minimisers are
broadcast as they are, more as bits of their residues, where some others count as hot too, which costs but changes nothing.
The number of buckets is the counted bytes over BUCKET_BYTES. A bucket's strings carry one of SUBS numbers of their minimisers,
and a worker sorts those of a few numbers at a time, up to PIECE_BYTES, so its memory doesn't depend on how even buckets are.
Decided stretches are joined to the texts by id and a hash of the text; while few documents have any, only their texts move.

Rows with a null id are never removed from and remove nothing; of rows that share an id none counts as smaller, and each
is judged by its own text. Null and
empty texts have no words; texts of fewer than WINDOW words have no windows. An empty table gives no rows. Columns on the way get
names that the input doesn't have. A very long text is a block of its own in a worker, which holds some 60 bytes a byte of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeySet, Shelf, Words, blocks, fresh, keyed_text, mix, prefix_hash, settled, span_hash, table, texts_of

WINDOW, RUN = 50, 6
#: Bytes of strings in a bucket, about; those that a worker sorts at once; text in a task that is searched for equal strings at once.
BUCKET_BYTES, PIECE_BYTES, COMBINE_BYTES = 8 << 20, 1 << 20, 5 << 20
#: Parts of a bucket, by minimiser.
SUBS = 256
HOT, HOT_KEYS = 2_000, 1_000_000
#: Keys of documents with stretches that are broadcast at most (16 bytes each), so that the other texts needn't move.
FETCH = 2_000_000
SPANS = "doc_id long, row long, start long, stop long"


class Strings:
    """The super-k-mers of one block of documents."""

    def __init__(self, ids: list, rows: list, texts: list[bytes], window: int, run: int):
        self.words = w = Words(texts)
        hashes = w.hashes()
        n = window - run + 1  # runs in a window
        empty = np.empty(0, dtype=np.int64)
        self.first = self.last = empty
        self.minimiser = empty.astype(np.uint64)
        self.ids, self.rows, self.window = ids, rows, window
        if len(w) < window:
            return
        runs = np.zeros(len(w) - run + 1, dtype=np.uint64)
        for j in range(run):
            runs = mix(runs + hashes[j : len(w) - run + 1 + j])
        least, width = runs, 1
        while 2 * width <= n:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < n:
            least = np.minimum(least[: len(least) - (n - width)], least[n - width :])
        m = len(w) - window + 1
        at = np.flatnonzero(w.doc[:m] == w.doc[window - 1 :])
        if not len(at):
            return
        least = least[at]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)])
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(at)]]) - 1
        self.first, self.last, self.minimiser = at[heads], at[tails], least[heads]  # first words of the first and last window

    def __iter__(self) -> Iterator[tuple[int, tuple[int, int, int, int], bytes]]:
        """(minimiser, (id, row, number of its first word in the document, windows), string); without rows of null id."""
        w, buf = self.words, self.words.buf.tobytes()
        if not len(self.first):
            return
        doc = w.doc[self.first]
        stop = w.end[self.last + self.window - 1] + 1
        for m, d, a, n, p, q in zip(self.minimiser.tolist(), doc.tolist(), (self.first - w.first[doc]).tolist(), (self.last - self.first + 1).tolist(), w.start[self.first].tolist(), stop.tolist(), strict=True):
            if self.ids[d] is not None:
                yield m, (self.ids[d], self.rows[d], a, n), buf[p:q]


def keep_least(kept: dict, key, place: tuple, decided: list, window: int) -> None:
    """Keeps the key's place of smallest id, and all its places in that id; the others are decided."""
    old = kept.get(key)
    if old is None:
        kept[key] = [place]
    elif old[0][0] < place[0]:
        decided.append(stretch(place, window))
    elif place[0] < old[0][0]:
        decided += [stretch(x, window) for x in old]
        kept[key] = [place]
    elif place not in old[-2:]:
        old.append(place)


def stretch(place: tuple[int, int, int, int], window: int) -> tuple[int, int, int, int]:
    doc, row, start, n = place
    return doc, row, start, start + n + window - 1


def combined(batches, window: int, run: int):
    """For each part of a task's rows: {(minimiser, string): places (id, row, start, windows)}, and decided stretches."""
    kept: dict[tuple[int, bytes], list] = {}
    decided: list = []
    size = 0
    for b in blocks(batches, "text"):
        texts = texts_of(b)
        for m, place, s in Strings(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), texts, window, run):
            keep_least(kept, (m, s), place, decided, window)
        size += sum(map(len, texts))
        if size >= COMBINE_BYTES:
            yield kept, decided
            kept, decided, size = {}, [], 0
    yield kept, decided


def joined(stretches: list) -> list:
    """The same words covered, by stretches that don't touch."""
    out: list = []
    for doc, row, start, stop in sorted(stretches):
        if out and out[-1][:2] == (doc, row) and start <= out[-1][3]:
            out[-1] = (doc, row, out[-1][2], max(stop, out[-1][3]))
        else:
            out.append((doc, row, start, stop))
    return out


def packed(rows: list[tuple[int, int, int, int, int, bytes]]) -> bytes:
    """(id, row, start, windows, part, string) of each, compressed."""
    head = np.array([(d, row, a, n, len(s), sub) for d, row, a, n, sub, s in rows], dtype=np.int64)
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(rows)).tobytes() + head.T.tobytes() + b"".join(r[5] for r in rows))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, a row for each string, and the strings' bytes."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    head = np.frombuffer(raw, dtype=np.int64, count=6 * n, offset=8).reshape(6, n).T
    return head, np.frombuffer(raw, dtype=np.uint8, offset=8 + 48 * n)


def pieces(blobs: list[bytes], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The strings of a bucket in pieces of at most limit bytes, or one part's; a part is never cut."""
    parts = [unpacked(x) for x in blobs]
    head, buf = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    if len(buf) <= limit:
        yield head, buf
        return
    ends = np.cumsum(head[:, 4])
    order = np.argsort(head[:, 5], kind="stable")
    sub, done = head[order, 5], np.concatenate([[0], np.cumsum(head[order, 4])])
    last = np.concatenate([np.flatnonzero(sub[1:] != sub[:-1]) + 1, [len(sub)]])  # where each part ends
    at = 0
    while at < len(sub):
        k = int(np.searchsorted(done[last], done[at] + limit, side="right")) - 1
        to = int(last[k]) if k >= 0 and last[k] > at else int(last[np.searchsorted(last, at, side="right")])
        own = order[at:to]
        yield head[own], np.concatenate([buf[p:q] for p, q in zip((ends[own] - head[own, 4]).tolist(), ends[own].tolist(), strict=True)])
        at = to


def _windows_of(head: np.ndarray, buf: np.ndarray, window: int):
    """Of each window: its string, its first word there, its first and last byte."""
    ends = np.cumsum(head[:, 4])
    spaces = np.flatnonzero(buf == 32)  # each word ends with one
    starts = np.concatenate([[0], spaces[:-1] + 1]) if len(spaces) else spaces
    first_word = np.searchsorted(starts, ends - head[:, 4])
    n = head[:, 3]
    string = np.repeat(np.arange(len(head)), n)
    number = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
    word = first_word[string] + number
    return string, number, starts[word], spaces[word + window - 1]


def repeats(head: np.ndarray, buf: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(id, row, start, stop) in words: stretches covered by windows that also start in a smaller id among these strings."""
    ids, rows, starts = head[:, 0], head[:, 1], head[:, 2]
    string, number, s, e = _windows_of(head, buf, window)
    value = mix(span_hash(prefix_hash(buf), s, e))
    order = np.lexsort((ids[string], value))
    sorted_value = value[order]
    group = np.concatenate([[True], sorted_value[1:] != sorted_value[:-1]])
    leader = order[np.flatnonzero(group)][np.cumsum(group) - 1]
    least = np.empty_like(leader)
    least[order] = leader
    repeated = ids[string[least]] < ids[string]
    at = np.flatnonzero(repeated)
    if not len(at):
        return []
    # runs of windows that repeat the neighbours of what the one before repeats
    cut = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (string[at[1:]] != string[at[:-1]]) | (least[at[1:]] != least[at[:-1]] + 1) | (string[least[at[1:]]] != string[least[at[:-1]]])])
    a = at[np.flatnonzero(cut)]
    b = at[np.concatenate([np.flatnonzero(cut)[1:], [len(at)]]) - 1]
    raw = buf.tobytes()
    if any(raw[p:q] != raw[x:y] for p, q, x, y in zip(s[a].tolist(), e[b].tolist(), s[least[a]].tolist(), e[least[b]].tolist(), strict=True)):
        smallest: dict[bytes, int] = {}
        spans = list(zip(string.tolist(), number.tolist(), s.tolist(), e.tolist(), strict=True))
        for k, _, p, q in spans:
            smallest[raw[p:q]] = min(smallest.get(raw[p:q], ids[k]), ids[k])
        return [(int(ids[k]), int(rows[k]), int(starts[k]) + i, int(starts[k]) + i + window) for k, i, p, q in spans if smallest[raw[p:q]] < ids[k]]
    first = starts[string[a]] + number[a]
    return list(zip(ids[string[a]].tolist(), rows[string[a]].tolist(), first.tolist(), (first + (b - a) + window).tolist(), strict=True))


def _span_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*joined(rows), strict=True) if rows else ((),) * 4)], names=["doc_id", "row", "start", "stop"])


def with_row(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows of one id apart."""
    return keyed_text(docs, key, text).withColumn("row", F.xxhash64("text"))


def measured(rows: DataFrame, window: int, run: int, hot: int, shelf: Shelf) -> tuple[KeySet, int]:
    """Minimisers with more than hot different strings by task, and the bytes of all strings."""

    def task(batches):
        for kept, _ in combined(batches, window, run):
            values, counts = np.unique(np.fromiter((m for m, _ in kept), dtype=np.uint64, count=len(kept)), return_counts=True)
            size = sum(len(s) * len(places) for (_, s), places in kept.items())
            yield pa.RecordBatch.from_arrays([pa.array([None, *values.view(np.int64).tolist()], pa.int64()), pa.array([size, *counts.tolist()], pa.int64())], names=["minimiser", "n"])

    counts = rows.mapInArrow(task, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    counts = shelf.keep(counts.filter((F.col("n") > hot) | F.col("minimiser").isNull()))
    size = counts.filter("minimiser is null").agg(F.sum("n").alias("n")).first()["n"] or 0
    return KeySet(counts.filter("minimiser is not null"), "minimiser", HOT_KEYS), size


def repeated_spans(docs: DataFrame, window: int = WINDOW, run: int = RUN, key: str = "doc_id", text: str = "text", hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, row (a hash of the text), start, stop (in words): stretches whose windows also start in a document with a smaller id; they may overlap."""
    spark = docs.sparkSession
    rows = with_row(docs, key, text)
    shelf = Shelf(spark, "minimisers")
    try:
        hot_keys, size = measured(rows, window, run, hot, shelf)
    finally:
        shelf.close()
    hot_keys = spark.sparkContext.broadcast(hot_keys)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, size // bucket_bytes)
    piece = min(PIECE_BYTES, bucket_bytes)

    def strings(batches):
        """kind 0: strings of a bucket; 1: decided stretches, by document; 2: a hot window's digest and place."""
        for kept, decided in combined(batches, window, run):
            mine: dict[int, list] = {}
            alone: dict[bytes, list] = {}
            is_hot = hot_keys.value.holds(np.fromiter((m for m, _ in kept), dtype=np.uint64, count=len(kept))).tolist()
            for ((m, s), places), one_by_one in zip(kept.items(), is_hot, strict=True):
                if not one_by_one:
                    mine.setdefault(m % buckets, []).extend((*place, m // buckets % SUBS, s) for place in places)
                    continue
                words = s.split()
                for i in range(places[0][3]):
                    digest = hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=16).digest()
                    for doc, row, start, _ in places:
                        keep_least(alone, digest, (doc, row, start + i, 1), decided, window)
            kept.clear()
            yield from sent_rows([(0, bucket, None, None, None, None, packed(x)) for bucket, x in mine.items()])
            mine.clear()
            yield from sent_rows([(1, doc, doc, row, a, b, None) for doc, row, a, b in joined(decided)])
            yield from sent_rows([(2, int.from_bytes(d[:8], "little", signed=True), *stretch(place, window), d) for d, places in alone.items() for place in places])

    def sent_rows(out):
        kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
        for i in range(0, len(out), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 512], strict=True), kinds, strict=True)], names=["kind", "bucket", "doc_id", "row", "start", "stop", "data"])

    def bucketed(batches):
        """Rows come sorted by kind and bucket."""
        now, held = None, []

        def close():
            if held and now[0] == 0:
                for head, buf in pieces([x[-1] for x in held], piece):
                    yield _span_batch(repeats(head, buf, window))
            elif held:
                least: dict[bytes, int] = {}
                for doc, *_, digest in held:
                    least[digest] = min(doc, least.get(digest, doc))
                if found := [(doc, row, a, b) for doc, row, a, b, digest in held if least[digest] < doc]:
                    yield _span_batch(found)

        for b in batches:
            for kind, bucket, *rest in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if kind != 1:
                    if (kind, bucket) != now:
                        yield from close()
                        now, held = (kind, bucket), []
                    held.append(rest)
            yield b.filter(pc.equal(b.column("kind"), 1)).select(["doc_id", "row", "start", "stop"])
        yield from close()

    sent = rows.mapInArrow(strings, "kind int, bucket long, doc_id long, row long, start long, stop long, data binary")
    dealt = sent.repartition(max(parts, min(buckets, 20_000)), "kind", "bucket").sortWithinPartitions("kind", "bucket")
    return dealt.mapInArrow(bucketed, SPANS)


def covered(n: int, spans: pa.ListScalar) -> np.ndarray:
    """Which of n words the stretches cover."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, spans.values.field("start").to_numpy(), 1)
    np.add.at(change, spans.values.field("stop").to_numpy(), -1)
    return np.cumsum(change[:-1]) > 0


def beside(rows: DataFrame, spans: DataFrame, doc: str, row: str, found: str) -> DataFrame:
    """rows (whose columns doc and row are id and text hash) and their stretches as a column, null where there are none; only texts that have some move."""
    held = settled(spans.groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(found)))
    if held.count() > FETCH:
        return rows.join(held, [doc, row], "left").select(*rows.columns, found)
    keys = F.broadcast(held.select(doc, row))
    none = F.lit(None).cast(held.schema[found].dataType).alias(found)
    some = rows.join(keys, [doc, row], "left_semi").join(held, [doc, row]).select(*rows.columns, found)
    return some.unionByName(rows.join(keys, [doc, row], "left_anti").select(*rows.columns, none))


def cut_words(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of each row."""
    rows = beside(with_row(docs, key, text), spans, "doc_id", "row", "spans")

    def task(batches):
        for b in blocks(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for content, found in zip(texts_of(b), b.column("spans"), strict=True):
                words = content.split()
                n_words.append(len(words))
                if found.is_valid:
                    words = [words[i] for i in np.flatnonzero(~covered(len(words), found)).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(task, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with all columns; a text that loses words is what is left of them, joined by one space, the others are as they were."""
    doc, row, found_in = fresh(docs, "doc", "row", "spans")
    keyed = docs.withColumns({doc: F.col(key).cast("long"), row: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    rows = beside(keyed, spans, doc, row, found_in).select(*docs.columns, found_in)

    def task(batches):
        for b in blocks(batches, text):
            texts = b.column(text).to_pylist()
            for i, found in enumerate(b.column(found_in)):
                if found.is_valid:
                    words = texts[i].encode().split()
                    gone = covered(len(words), found)
                    texts[i] = b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x).decode()
            at = b.schema.get_field_index(text)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type)).drop_columns([found_in])

    return rows.mapInArrow(task, docs.schema)


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, windows of 50 words."""
    docs = table(spark, sf_dir, "documents")
    out = cut_words(docs, repeated_spans(docs))
    return out.select("doc_id", "n_words", "n_removed", sha256_of(F.col("kept")).alias("kept_sha256"))
