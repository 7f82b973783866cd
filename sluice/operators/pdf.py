"""Tables and pages of PDF files as Markdown, from extracted page structures (page_num, text, tables)."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import collapse, strip, word_count
from sluice.operators.chunks import file_stem

PAGES = "array<struct<page_num:int,text:string,tables:array<array<array<string>>>>>"
TEXT_WORDS = 50


def table_to_markdown(rows: Column) -> Column:
    """Cells without line breaks and with escaped bars; rows padded to the longest; the first is the header."""
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731 lambdas of rows would evaluate x for each row
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: F.replace(collapse(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|"))))

    def lines(cells: Column, width: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        return once(F.transform(cells, line), lambda made: F.array_join(F.concat(F.slice(made, 1, 1), F.array(rule), F.slice(made, 2, F.greatest(F.size(made), F.lit(1)))), "\n"))

    made = once(cells, lambda c: once(F.array_max(F.transform(c, F.size)), lambda width: lines(c, width)))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, F.lit("")).otherwise(made)


def pages_words(pages: Column) -> Column:
    return F.aggregate(pages, F.lit(0), lambda n, p: n + word_count(p["text"]))


def is_text_based(pages: Column, least: int = TEXT_WORDS) -> Column:
    return F.coalesce(pages_words(pages), F.lit(0)) >= least


def total_tables(pages: Column) -> Column:
    return F.aggregate(pages, F.lit(0), lambda n, p: n + F.size(p["tables"]))


def _page_lines(p: Column, tables: bool) -> Column:
    """The lines of a page: its marker, its tables, its paragraphs, each followed by an empty line."""
    spaced = lambda xs: F.flatten(F.transform(xs, lambda x: F.array(x, F.lit(""))))
    text = strip(F.coalesce(p["text"], F.lit("")))
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), collapse), lambda x: x != "")
    held = F.filter(F.transform(p["tables"], table_to_markdown), lambda x: x != "") if tables else F.array().cast("array<string>")
    parts = F.concat(F.array(F.concat(F.lit("<!-- page: "), p["page_num"].cast("string"), F.lit(" -->"))), held, paragraphs)
    return F.when((text != "") | (F.size(held) > 0), spaced(parts)).otherwise(F.array().cast("array<string>"))


def pdf_to_markdown(name: Column, structured: Column, plain: Column, recognised: Column | None = None) -> Column:
    """Markdown of one file: its structured pages if they hold text enough, else the plain ones (or recognised ones that do)."""
    if recognised is not None:
        plain = F.when(~is_text_based(plain) & is_text_based(recognised), recognised).otherwise(plain)
    stem = file_stem(name)
    front = F.array(F.lit("---"), F.concat(F.lit('title: "'), stem, F.lit('"')), F.concat(F.lit('source_file: "'), name, F.lit('"')), F.lit("source_type: pdf"), F.lit("---"), F.lit(""), F.concat(F.lit("# "), stem), F.lit(""))
    body = F.when(is_text_based(structured), F.flatten(F.transform(structured, lambda p: _page_lines(p, True)))).otherwise(F.flatten(F.transform(plain, lambda p: _page_lines(p, False))))
    empty = (F.coalesce(F.size(structured), F.lit(0)) <= 0) & (F.coalesce(F.size(plain), F.lit(0)) <= 0)
    return F.when(~empty, F.array_join(F.concat(front, body), "\n"))


def extract_pages(files: DataFrame, reader, opened=None) -> DataFrame:
    """path, pages of files (path, content) from Spark's binaryFile source; reader: bytes -> list of (page, text, tables).
    With opened (path -> bytes) files need a path alone: the task that reads a file opens it, so no content moves.

    A file that the reader fails on has no pages, and why stands in the worker's log. No PDF library is bundled; hand in a
    function of one that is installed.
    """

    def task(batches):
        import pandas as pd

        for b in batches:
            out = []
            for path, content in zip(b["path"], b["path"] if opened else b["content"], strict=True):
                try:
                    out.append([{"page_num": n, "text": t, "tables": x} for n, t, x in reader(opened(path) if opened else content)])
                except Exception as e:  # noqa: BLE001 a broken file must not stop the others
                    logging.getLogger("sluice").warning("%s can't be read: %s", path, e)
                    out.append([])
            yield pd.DataFrame({"path": b["path"], "pages": out})

    return files.select("path", *([] if opened else ["content"])).mapInPandas(task, f"path string, pages {PAGES}")


def plain_reader():
    """A reader by pypdf; None where it isn't installed."""
    import importlib.util

    if not importlib.util.find_spec("pypdf"):
        return None

    def read(content: bytes):
        import io

        from pypdf import PdfReader

        return [(n, (p.extract_text() or "").strip(), []) for n, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]

    return read


def default_reader():
    """A reader (see extract_pages) by pdfplumber, which finds tables too, or pypdf; an error where neither is installed."""
    import importlib.util

    if importlib.util.find_spec("pdfplumber"):

        def read(content: bytes):
            import io

            import pdfplumber

            with pdfplumber.open(io.BytesIO(content)) as file:
                return [(n, (p.extract_text() or "").strip(), p.extract_tables() or []) for n, p in enumerate(file.pages, 1)]

        return read
    if (plain := plain_reader()) is not None:
        return plain
    raise ModuleNotFoundError("no PDF library (pdfplumber, pypdf) is installed; hand in a reader")


def installed_recognising_reader():
    """recognising_reader(), or None where it can't be had."""
    try:
        return recognising_reader()
    except ModuleNotFoundError:
        return None


def recognising_reader(dpi: int = 300, lang: str = "eng"):
    """A reader of scanned files by pdf2image and pytesseract; an error where they aren't installed."""
    import importlib.util

    if not (importlib.util.find_spec("pdf2image") and importlib.util.find_spec("pytesseract")):
        raise ModuleNotFoundError("pdf2image and pytesseract aren't installed; hand in a reader")

    def read(content: bytes):
        import pdf2image
        import pytesseract

        return [(n, pytesseract.image_to_string(image, lang=lang).strip(), []) for n, image in enumerate(pdf2image.convert_from_bytes(content, dpi=dpi), 1)]

    return read
