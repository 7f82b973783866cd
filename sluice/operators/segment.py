"""Segmentation of Markdown by structure.

A document is one row and its segments depend on all lines before them, so segments are made where the document is, by one
pass over its lines in Arrow batches: no shuffle, and time and memory in proportion to the document. Functions of single lines
and the hard segments of a table of lines are native columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.conf import ChunkConf
from sluice.functions.text import SPACE, word_count

HEADING = rf"(?dU)\A(#{{1,6}}){SPACE}+(.+)$"
MARKER = rf"(?U)<!--{SPACE}*page:{SPACE}*(\d+){SPACE}*-->"


def heading_level(line: Column) -> Column:
    """1 to 6, or 0 for other lines."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_title(line: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(line, HEADING, 2), rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_table_line(line: Column) -> Column:
    return line.rlike(rf"(?U)\A{SPACE}*\|")


def lines(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, line_no (from 0), line, level, title, tabular, blank, words."""
    out = docs.select(key, F.posexplode(F.split(F.col(body), "\n")).alias("line_no", "line"))
    return out.withColumns({"level": heading_level(F.col("line")), "title": heading_title(F.col("line")), "tabular": is_table_line(F.col("line")), "blank": ~F.col("line").rlike(rf"(?U)[^\s\x1c-\x1f]"), "words": word_count(F.col("line"))})


def hard_segments(rows: DataFrame, key: str) -> DataFrame:
    """Adds seg: a new one begins at headings of level 1 and 2 and where tables begin and end."""
    order = Window.partitionBy(key).orderBy("line_no")
    new = F.col("level").between(1, 2) | (F.col("tabular") != F.lag("tabular", 1, False).over(order))
    return rows.withColumn("new", new.cast("int")).withColumn("seg", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


# --- one pass over the lines of a document ------------------------------------------------------------------------------

SPACES = r"[\s\x1c-\x1f]"
_HEADING = re.compile(rf"(#{{1,6}}){SPACES}+(.+)$")
_MARKER = re.compile(rf"<!--{SPACES}*page:{SPACES}*(\d+){SPACES}*-->")
_SEPARATOR = re.compile(rf"{SPACES}*\|[\s\x1c-\x1f\-:]+\|")
#: Characters of texts that are handed on at once.
OUT_CHARS = 4 << 20


def heading(line: str) -> tuple[int, str]:
    found = _HEADING.match(line) if line[:1] == "#" else None
    return (len(found[1]), found[2].strip()) if found else (0, "")


def table_parts(rows: list[str], size: int) -> list[list[str]]:
    """A table's lines as parts of up to size data rows, each below the lines up to the separator; else one part."""
    n = len(rows)
    first = next((i for i, x in enumerate(rows, 1) if _SEPARATOR.match(x)), 0)
    if n <= 3 or first in (0, n):
        return [rows]
    return [rows[:first] + rows[at : at + size] for at in range(first, n, size)]


def scan(body: str, conf: ChunkConf) -> Iterator[tuple[bool, int, list[str], list[str]]]:
    """tabular, first line, lines and open titles of each piece.

    A new segment begins at headings of level 1 and 2 and where tables begin and end. Within one of more than soft_words words
    a third-level heading beyond soft_words, and a blank line, which goes, beyond max_words begin a new piece.
    """
    lines = body.split("\n")
    open_titles: list[tuple[int, str]] = []
    segment: list[tuple[str, int, list[str], int]] = []  # line, level, open titles, words
    start, tabular, before = 0, False, False

    def closed():
        if not segment:
            return
        if tabular or sum(x[3] for x in segment) <= conf.soft_words:
            yield tabular, start, [x[0] for x in segment], segment[-1][2]
            return
        words, at = 0, 0
        for i, (line, level, _, n) in enumerate(segment):
            if level == 3 and words > conf.soft_words:
                if i > at:
                    yield False, start + at, [x[0] for x in segment[at:i]], segment[i - 1][2]
                words, at = n, i
            elif level == 0 and words > conf.max_words and not line.strip():
                if i > at:
                    yield False, start + at, [x[0] for x in segment[at:i]], segment[i - 1][2]
                words, at = 0, i + 1
            else:
                words += n
        if at < len(segment):
            yield False, start + at, [x[0] for x in segment[at:]], segment[-1][2]

    titles: list[str] = []
    for i, line in enumerate(lines):
        level, title = heading(line)
        bar = line.lstrip()[:1] == "|"
        if level in (1, 2) or bar != before:
            yield from closed()
            segment, start, tabular = [], i, bar
        if level:
            open_titles = [x for x in open_titles if x[0] < level] + [(level, title)]
            titles = [x[1] for x in open_titles]
        segment.append((line, level, titles, len(line.split())))
        before = bar
    yield from closed()


def marked_pages(raw: str) -> list[tuple[int, int]]:
    """Line and page of the first marker of each line that has one."""
    if "<!--" not in raw:
        return []
    out = []
    for i, line in enumerate(raw.split("\n")):
        if "<!--" in line and (found := _MARKER.search(line)) and int(found[1]) < 1 << 31:
            out.append((i, int(found[1])))
    return out


class Pages:
    """Page ranges of stretches of lines that come in order."""

    def __init__(self, marks: list[tuple[int, int]]):
        self.marks, self.at, self.now = marks, 0, 0

    def of(self, start: int, end: int) -> list[int] | None:
        """The smallest and largest page: that in force at the start (unless it is 0), and those begun up to the end."""
        while self.at < len(self.marks) and self.marks[self.at][0] <= start:
            self.now = self.marks[self.at][1]
            self.at += 1
        pages, k = [self.now] if self.now else [], self.at
        while k < len(self.marks) and self.marks[k][0] <= end:
            pages.append(self.marks[k][1])
            k += 1
        return [min(pages), max(pages)] if pages else None


def segments(docs: DataFrame, key: str, body: str, conf: ChunkConf = ChunkConf(), skip: Column | None = None) -> DataFrame:
    """key, seq, part, parts, tabular, text, start_line, end_line, hierarchy, page_range: all segments, before empty and small ones go.

    skip: how many characters at the beginning of the text (front matter) belong to no line; page markers' lines are counted with
    them unless page_lines is aligned. A null text has no segments, an empty one has one empty line.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(body).alias("body"), (F.lit(0) if skip is None else skip).cast("int").alias("skip")).filter("body is not null")
    schema = f"key {kind.simpleString()}, seq int, part int, parts int, tabular boolean, text string, start_line int, end_line int, hierarchy array<string>, page_range array<int>"
    names = ["key", "seq", "part", "parts", "tabular", "text", "start_line", "end_line", "hierarchy", "page_range"]
    types = [pa.int32()] * 3 + [pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]

    def task(batches):
        for b in batches:
            keys, out, size = b.column("key"), [], 0

            def sent(out=out, keys=keys):
                places, *rest = zip(*out, strict=True)
                return pa.RecordBatch.from_arrays([keys.take(pa.array(places)), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], names=names)

            for i in range(b.num_rows):
                raw, cut = b.column("body")[i].as_py(), b.column("skip")[i].as_py()
                text = raw[cut:] if cut else raw
                pages = Pages(marked_pages(text if conf.page_lines == "aligned" else raw))
                for tabular, start, lines, titles in scan(text, conf):
                    end = start + len(lines) - 1
                    held = pages.of(start, end)
                    split = table_parts(lines, conf.table_rows) if tabular else [lines]
                    for k, part in enumerate(split, 1):
                        made = "\n".join(part)
                        out.append((i, start, k, len(split), tabular, made, start, end, titles, held))
                        size += len(made)
                    if size > OUT_CHARS:
                        yield sent()
                        out.clear()
                        size = 0
            if out:
                yield sent()

    made = rows.mapInArrow(task, schema)
    return made if key == "key" else made.withColumnRenamed("key", key)


def page_markers(raw: Column) -> Column:
    """line_no and page of the first marker of each line that has one."""
    found = F.transform(F.split(raw, "\n"), lambda x, i: F.struct(i.alias("line_no"), F.regexp_extract(x, MARKER, 1).alias("page")))
    return F.transform(F.filter(found, lambda x: x["page"] != ""), lambda x: F.struct(x["line_no"].alias("line_no"), x["page"].try_cast("int").alias("page")))
