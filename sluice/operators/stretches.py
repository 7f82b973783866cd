"""Segmentation of documents that are too large for one task: cut into stretches of whole lines, in order, at any lines.

1. Each stretch is summed up: lines, headings' lowest level and its own open titles, whether its ends are table lines, its last
   boundary, its page markers. No text leaves its task.
2. A scan over a document's summaries gives each stretch what is in force at its first line: line number, open titles (those of
   before that are above the lowest level since, then its own), the segment that goes on, the page. Summaries combine
   associatively; one task scans a document's, a row a stretch.
3. Segments that begin and end in a stretch are cut into pieces there, as ``segment.segments`` does. Lines of segments that cross
   from one stretch to another are dealt out by segment, sorted, and cut as they come: a task holds one piece at a time.

The pieces equal those of ``segment.segments`` on the whole text. Null texts have no lines. Within a document nth is unique.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.conf import ChunkConf
from sluice.operators.segment import heading, marked_pages, table_parts
from sluice.operators.shared import settled

STATE = "key string, nth long, offset long, before boolean, segment long, levels array<int>, titles array<string>, now long, mark_lines array<long>, mark_pages array<long>, opens boolean, stays boolean"
PIECE = "key string, seq int, part int, parts int, tabular boolean, text string, start_line int, end_line int, hierarchy array<string>, page_range array<int>"
LINE = "key string, segment long, no long, tabular boolean, line string, level int, titles array<string>, words int, now long, mark long"
#: States that are broadcast at most; more are joined.
SMALL = 20_000


def is_bar(line: str) -> bool:
    return line.lstrip()[:1] == "|"


def summary(text: str, front: str, aligned: bool) -> tuple:
    """lines, first level, first bar, last bar, last boundary but the first line (or -1), lowest level, levels, titles, mark lines, mark pages, front lines."""
    lines = text.split("\n")
    stack: list[tuple[int, str]] = []
    lowest, boundary, before, first = 7, -1, is_bar(lines[0]), heading(lines[0])[0]
    for i, line in enumerate(lines):
        level, title = heading(line)
        bar = is_bar(line)
        if i and (level in (1, 2) or bar != before):
            boundary = i
        if level:
            lowest = min(lowest, level)
            stack = [x for x in stack if x[0] < level] + [(level, title)]
        before = bar
    shift = 0 if aligned else front.count("\n")
    marks = ([] if aligned else marked_pages(front)) + [(i + shift, p) for i, p in marked_pages(text)]
    return len(lines), first, is_bar(lines[0]), before, boundary, lowest, [x[0] for x in stack], [x[1] for x in stack], [x[0] for x in marks], [x[1] for x in marks], shift


def scan_states(rows: pd.DataFrame) -> pd.DataFrame:
    """One document's summaries in order to the states of its stretches."""
    out, offset, before, segment, stack = [], 0, False, 0, []
    shift = int(rows["shift"].max()) if len(rows) else 0
    marks: list[tuple[int, int]] = []
    for r in rows.itertuples():
        own = 0 if r.front_has else shift  # marks of the stretch that has the front matter count it already
        marks += [(offset + own + i, p) for i, p in zip(r.mark_lines, r.mark_pages, strict=True)]
        opens = r.first_level in (1, 2) or r.first_bar != before or not out
        out.append([r.key, r.nth, offset, before, segment, [x[0] for x in stack], [x[1] for x in stack], opens, r.lines])
        if r.boundary >= 0:
            segment = offset + r.boundary
        elif opens:
            segment = offset
        stack = [x for x in stack if x[0] < r.lowest] + list(zip(r.levels, r.titles, strict=True))
        offset, before = offset + r.lines, r.last_bar
    marks.sort(key=lambda x: x[0])
    at, now, made = 0, 0, []
    for k, (key, nth, first, bar, seg, levels, titles, opens, n) in enumerate(out):
        while at < len(marks) and marks[at][0] < first:
            now, at = marks[at][1], at + 1
        held = [m for m in marks[at : at + n + 1] if m[0] < first + n]
        made.append((key, nth, first, bar, seg, levels, titles, now, [m[0] for m in held], [m[1] for m in held], opens, k + 1 < len(out) and not out[k + 1][7]))
    return pd.DataFrame(made, columns=[x.split()[0] for x in STATE.split(", ")])


def fragments(text: str, s: dict) -> Iterator[tuple[bool, int, bool, list[tuple]]]:
    """whole, segment, tabular and annotated lines (no, line, level, titles, words, now, mark) of the segments, or parts of them, in a stretch."""
    stack = list(zip(s["levels"], s["titles"], strict=True))
    marks, now, before = dict(zip(s["mark_lines"], s["mark_pages"], strict=True)), s["now"], s["before"]
    titles, held, first, segment = [x[1] for x in stack], [], True, s["segment"]
    tabular = before
    for i, line in enumerate(text.split("\n")):
        no, bar = s["offset"] + i, is_bar(line)
        level, title = heading(line)
        if (s["opens"] if not i else level in (1, 2) or bar != before):
            if held:
                yield not first, segment, tabular, held
                first = False
            elif not i:
                first = False
            held, segment, tabular = [], no, bar
        if level:
            stack = [x for x in stack if x[0] < level] + [(level, title)]
            titles = [x[1] for x in stack]
        now = marks.get(no, now)
        held.append((no, line, level, titles, len(line.split()), now, marks.get(no)))
        before = bar
    yield not first and not s["stays"], segment, tabular, held


def pieces(lines: Iterable[tuple], tabular: bool, words: int, conf: ChunkConf) -> Iterator[tuple]:
    """seq, part, parts, tabular, text, start, end, hierarchy, pages of one segment, whose lines come in order and whose words are known.
    Only a table's lines, and otherwise those of one piece, are held."""

    def made(held: list[tuple], part: int, parts: int, texts: list[str]):
        pages = [held[0][5]] * bool(held[0][5]) + [x[6] for x in held[1:] if x[6] is not None]
        return held[0][0], part, parts, tabular, "\n".join(texts), held[0][0], held[-1][0], held[-1][3], [min(pages), max(pages)] if pages else None

    if tabular:
        held = list(lines)  # a table's parts share its range of lines and pages
        split = table_parts([x[1] for x in held], conf.table_rows)
        for k, part in enumerate(split, 1):
            yield made(held, k, len(split), part)
        return
    held, count = [], 0
    for x in lines:
        if words > conf.soft_words and x[2] == 3 and count > conf.soft_words:
            if held:
                yield made(held, 1, 1, [y[1] for y in held])
            held, count = [x], x[4]
        elif words > conf.soft_words and x[2] == 0 and count > conf.max_words and not x[1].strip():
            if held:
                yield made(held, 1, 1, [y[1] for y in held])
            held, count = [], 0
        else:
            held.append(x)
            count += x[4]
    if held:
        yield made(held, 1, 1, [y[1] for y in held])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def segments_of(stretches: DataFrame, conf: ChunkConf = ChunkConf()) -> DataFrame:
    """The columns of segment.segments, of stretches (key, nth, text, front: the front matter before the first stretch, else empty)."""
    rows = stretches.select(F.col("key").cast("string").alias("key"), F.col("nth").cast("long").alias("nth"), "text", F.coalesce("front", F.lit("")).alias("front")).filter("text is not null")
    aligned = conf.page_lines == "aligned"
    fields = "lines long, first_level int, first_bar boolean, last_bar boolean, boundary long, lowest int, levels array<int>, titles array<string>, mark_lines array<long>, mark_pages array<long>, shift long"

    def summed(batches):
        for b in batches:
            yield pd.DataFrame([(k, n, f != "", *summary(t, f, aligned)) for k, n, t, f in b[["key", "nth", "text", "front"]].itertuples(index=False)], columns=["key", "nth", "front_has", *(x.split()[0] for x in fields.split(", "))])

    sums = rows.mapInPandas(summed, f"key string, nth long, front_has boolean, {fields}")
    states = settled(sums.groupBy("key").applyInPandas(lambda x: scan_states(x.sort_values("nth")), STATE))
    cut = rows.drop("front").join(F.broadcast(states) if states.count() <= SMALL else states, ["key", "nth"])

    def inside(batches):
        for b in batches:
            for s in b.to_pylist():
                out = [(s["key"], *p) for whole, _, tabular, held in fragments(s["text"], s) if whole for p in pieces(held, tabular, sum(x[4] for x in held), conf)]
                if out:
                    yield _batch(out, PIECE)

    def across(batches):
        for b in batches:
            for s in b.to_pylist():
                out = [(s["key"], seg, x[0], tabular, *x[1:]) for whole, seg, tabular, held in fragments(s["text"], s) if not whole for x in held]
                if out:
                    yield _batch(out, LINE)

    lines = cut.mapInArrow(across, LINE)
    totals = lines.groupBy("key", "segment").agg(F.sum("words").alias("all_words"))
    lines = lines.join(totals, ["key", "segment"]).repartition("key", "segment").sortWithinPartitions("key", "segment", "no")
    names = ["no", *(x.split()[0] for x in LINE.split(", ")[4:])]

    def folded(batches):
        def every():
            for b in batches:
                yield from b.to_pylist()

        for (key, _), own in groupby(every(), lambda r: (r["key"], r["segment"])):
            head = next(own)
            stream = (tuple(r[c] for c in names) for r in chain([head], own))
            for p in pieces(stream, head["tabular"], head["all_words"], conf):
                yield _batch([(key, *p)], PIECE)

    return cut.mapInArrow(inside, PIECE).unionByName(lines.mapInArrow(folded, PIECE))
