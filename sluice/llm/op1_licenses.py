"""License scan: ordered signature rules behind a keyword prefilter.

A text becomes its lower-case words joined by one space. A rule's regular expression runs only where its keyword occurs,
and keywords are looked for only behind a few words that they share. Detections are intervals of words. Tags come first,
then longer detections before shorter ones, then the order of the rules; a detection is suppressed if it overlaps, or
lies within, one that came before it. Base phrases are found by rules like the others, but all their places are counted
and their labels always stay.

Every row is judged by itself, in blocks of bounded size, so there is no shuffle and no skew. Null and empty texts have no
words, null first and last words, empty labels and score 0; rows with equal or null ids are judged each by itself; an
empty table gives no rows. Only id and text are read, so other columns can't clash. Detections of a very long text are resolved
in n log n steps; it is a block of its own in a worker.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, keyed_text, table, texts_of
from .license_rules import CONFIDENCE, Rule, compile_rules, gates

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_found long, spans array<struct<label:string,kind:string,start:long,stop:long>>"

#: ASCII characters outside words become spaces, A-Z a-z; all other bytes stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@lru_cache(maxsize=1)
def gated_rules() -> tuple[tuple[bytes, tuple[tuple[bytes, tuple[Rule, ...]], ...]], ...]:
    """Gate word, then keywords behind it, then their rules."""
    rules = compile_rules()
    return tuple((gate, tuple((k, tuple(r for r in rules if r.keyword == k)) for k in keys)) for gate, keys in gates([r.keyword for r in rules]).items())


def resolve(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """The detections (rule, start, stop) that no other one suppresses, by start."""
    starts: list[int] = []  # of those that stay, which don't overlap
    kept: list[tuple[Rule, int, int]] = []
    for rule, start, stop in sorted(found, key=lambda x: (x[0].kind != "tag", x[1] - x[2], x[0].priority, x[1])):
        at = bisect_left(starts, start)
        if (not at or kept[at - 1][2] <= start) and (at == len(kept) or stop <= starts[at]):
            starts.insert(at, start)
            kept.insert(at, (rule, start, stop))
    return kept


def detections(folded: bytes) -> list[tuple[Rule, int, int]]:
    """Each match of each rule whose keyword occurs, as words [start, stop); folded begins and ends with a space."""
    out, before, at = [], 0, 0
    places: list[tuple[int, int, Rule]] = []
    for gate, keywords in gated_rules():
        if gate in folded:
            for rule in (r for keyword, rules in keywords if keyword in folded for r in rules):
                places += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(folded)]
    if not places:
        return []
    for start, end, rule in sorted(places, key=lambda x: (x[0], x[1], x[2].priority)):
        before, at = before + folded.count(b" ", at, start), start
        out.append((rule, before - 1, before + folded.count(b" ", start, end)))
    return out


def scan_text(text: bytes) -> tuple:
    """The values of one row after doc_id."""
    words = text.translate(FOLD).split()
    folded = b" " + b" ".join(words) + b" "
    found = detections(folded)
    if not found:
        return len(words), 0, None, None, "", "", 0.0, 0, []
    base = [(r, s, e) for r, s, e in found if r.kind == "base"]
    kept = resolve([x for x in found if x[0].kind != "base"])
    base_labels = {r.label for r, _, _ in base}
    labels = base_labels | {r.label for r, _, _ in kept}
    miss = float(np.prod([1 - CONFIDENCE[r.kind] for r, _, _ in kept + base]))
    starts = [s for _, s, _ in base]
    spans = [{"label": r.label, "kind": r.kind, "start": s, "stop": e} for r, s, e in sorted(kept + base, key=lambda x: (x[1], x[2], x[0].priority))]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(1 - miss, 9), len(kept), spans


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Word counts, base places, labels, score and the spans of all detections that stay."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_found", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))]

    def task(batches):
        for b in blocks(batches, "text"):
            rows = [scan_text(t) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    return keyed_text(docs, key, text).mapInArrow(task, SCHEMA)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")

