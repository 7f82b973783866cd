"""The engine's stages from files to files."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluice.conf import ChunkConf, CrawlConf
from sluice.functions.urls import normalize
from sluice.operators import chunks as K
from sluice.operators import crawl, entities, html, pdf, report
from sluice.operators.dedup import split_duplicates
from sluice.operators.shared import exists, settled, whole, written
from sluice.sources import http, readers, sinks

log = logging.getLogger("sluice")


@dataclass
class Run:
    kept: DataFrame
    dropped: DataFrame
    report: DataFrame


def chunk_documents(docs: DataFrame, registry: DataFrame | None = None, conf: ChunkConf = ChunkConf()) -> Run:
    """Documents (source_file, raw) to distinct chunks, duplicates and a report. Chunks are made once, in the shared folder, for all of these."""
    seen = Observation()
    made = settled(K.build_chunks(docs, registry, conf, seen=seen))
    kept, dropped = split_duplicates(made)
    return Run(kept, dropped, report.report(kept, dropped, seen.get if conf.strict_report else None))


def chunk_stage(spark: SparkSession, folders: list[str], entity_files: list[str], out: str, conf: ChunkConf = ChunkConf(), array: bool = False) -> Run:
    """Reads, chunks and writes chunks (with array also as one JSON array, chunks.json), report, error log and event log below out,
    which are published together. Counts come with the writes; a file of large_bytes and more is segmented by several tasks."""
    found = entities.lookup(readers.entities(spark, *entity_files))
    small, large = Observation(), Observation()
    docs = readers.markdown(spark, *folders, below_bytes=conf.large_bytes)
    made = K.build_chunks(docs, found, conf, seen=small)
    parts = readers.large_markdown(spark, *folders, least_bytes=conf.large_bytes)
    several = not parts.isEmpty()
    if several:
        made = made.unionByName(K.build_large_chunks(parts, found, conf, seen=large))
    kept, dropped = split_duplicates(settled(made))
    gone = Observation()
    with sinks.Together(spark, out) as place:
        counted, seen = report.counted(kept)
        sinks.chunks(counted, place.path("chunks"))
        sinks.error_log(dropped.observe(gone, F.count(F.lit(1)).alias("n")), place.path("errors"))
        sinks.event_log(kept, place.path("events"))
        if array:
            sinks.chunk_array(kept, place.path("chunks.json"))
        skipped = {k: v + (large.get[k] if several else 0) for k, v in small.get.items()} if conf.strict_report else {}
        row = report.observed_report(spark, seen.get, gone.get["n"], skipped)
        sinks.report(row, place.path("chunk_report"))
    if not seen.get["n"]:
        log.warning("no chunks were made from %s", ", ".join(folders))
    return Run(kept, dropped, row)


@dataclass
class Scraped:
    """Pages and PDF files that were reached, and how many of them became Markdown."""

    pages: DataFrame
    found_pages: int
    found_pdfs: int
    made_pages: int
    made_pdfs: int


def fetched_pages(spark: SparkSession, urls: DataFrame, conf: CrawlConf) -> DataFrame:
    """url, html of pages over HTTP; failed ones have none."""
    return http.page_fetcher(conf)(urls)


def live_pages(spark: SparkSession, start: list[str], conf: CrawlConf, folder: str) -> tuple[DataFrame, DataFrame]:
    """What a crawl over HTTP finds (url, depth, kind), and the pages (url, html), each fetched once. The folder holds the crawl's
    state: a run that was stopped goes on there."""
    made = crawl.Crawl(spark, start, conf, http.page_fetcher(conf), folder, keep_pages=True)
    found, pages = made.run(), made.pages()
    if (rest := whole(spark, f"{folder}/rest")) is None:  # pages at the greatest depth
        urls = found.filter("kind = 'page'").select("url")
        rest = written(fetched_pages(spark, urls if pages is None else urls.join(pages, "url", "left_anti"), conf), f"{folder}/rest")
    return found, rest if pages is None else pages.unionByName(rest)


def fetched_before(spark: SparkSession, folder: str) -> DataFrame:
    """url, html of the pages that a crawl over HTTP has in its folder."""
    out = whole(spark, f"{folder}/rest").select("url", "html")
    return out.unionByName(spark.read.parquet(f"{folder}/pages").select("url", "html")) if exists(spark, f"{folder}/pages") else out


def scrape_stage(pages: DataFrame | None, start: list[str], conf: CrawlConf, out: str, at: str | None = None, pdfs: str | None = None, reader=None, spark: SparkSession | None = None) -> Scraped:
    """Discovers pages, over HTTP or in a table of pages, converts them and writes them as a table, and the PDF files that were reached
    too, if a folder to land them in is given and a reader (see pdf.extract_pages). Without pages the crawl's state is below out."""
    spark = spark or pages.sparkSession
    if pages is None:
        found, rows = live_pages(spark, start, conf, f"{out}_crawl")
        rows = rows.filter("html is not null")
    else:
        found = settled(crawl.discover(pages, start, conf))
        rows = pages.withColumn("url", normalize(F.col("url"))).join(found.filter("kind = 'page'").select("url"), "url", "left_semi")
    counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    sinks.markdown(html.scrape(rows, at), out)
    made, made_pdfs = spark.read.parquet(out), 0
    if pdfs is not None and counts.get("pdf"):
        made_pdfs = pdf_urls_to_markdown(found.filter("kind = 'pdf'").select("url"), pdfs, f"{out}_pdfs", reader, conf).count()
    n = made.count()
    log.info("%s of %s pages and %s of %s PDF files became Markdown", n, counts.get("page", 0), made_pdfs, counts.get("pdf", 0))
    return Scraped(made, counts.get("page", 0), counts.get("pdf", 0), n, made_pdfs)


def pdf_urls_to_markdown(urls: DataFrame, folder: str, out: str, reader=None, conf: CrawlConf = CrawlConf(base_url=""), plain=None, recognising=None) -> DataFrame:
    """url, name, markdown of PDF files: downloaded to a shared folder, read and written as a table. Files that can't be had
    or read have no row.

    reader gives structured pages, plain those of files whose structured ones hold too few words, recognising those of files that
    then have too few still (see pdf.extract_pages); by default whatever library for each is installed, and none where none is.
    """
    landed = http.download(urls, folder, conf).filter("file is not null")
    files = landed.select(F.col("file").alias("path"))
    none = F.lit(None).cast(pdf.PAGES)
    structured = settled(pdf.extract_pages(files, reader or pdf.default_reader(), http.opened).withColumnRenamed("pages", "structured"))
    short = structured.filter(~pdf.is_text_based(F.col("structured"))).select("path")
    read = lambda f, rows, name: None if f is None else settled(pdf.extract_pages(files.join(rows, "path", "left_semi"), f, http.opened).withColumnRenamed("pages", name))
    texts = read(plain or (pdf.plain_reader() if reader is None else None), short, "plain")
    rows = structured.join(texts, "path", "left") if texts is not None else structured.withColumn("plain", F.when(~pdf.is_text_based(F.col("structured")), F.col("structured")))
    scanned = read(recognising or (pdf.installed_recognising_reader() if reader is None else None), rows.filter(~pdf.is_text_based(F.col("structured")) & ~pdf.is_text_based(F.col("plain"))).select("path"), "recognised")
    rows = rows.withColumn("recognised", none) if scanned is None else rows.join(scanned, "path", "left")
    names = landed.select("url", "file", F.element_at(F.split("path", "/"), -1).alias("name"))
    made = names.join(rows.withColumnRenamed("path", "file"), "file").select("url", "name", pdf.pdf_to_markdown(F.col("name"), F.col("structured"), F.col("plain"), F.col("recognised")).alias("markdown"))
    sinks.markdown(made.filter("markdown is not null"), out)
    return urls.sparkSession.read.parquet(out)


def entity_stage(pages: DataFrame, base_url: str, out: str) -> DataFrame:
    """People's links of pages as entities, written as JSON; and empty tables of courses and programs, if there are none."""
    made = entities.faculty_entities(crawl.faculty_links(pages, base_url).select("name", "url"))
    sinks.entities(made, out)
    for kind in ("courses", "programs"):
        sinks.empty_entities(pages.sparkSession, f"{out.rstrip('/')}_{kind}")
    return made
