"""python -m sluice --stage scrape|entities|chunk|all ..."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from sluice.conf import ChunkConf, CrawlConf
from sluice.pipeline import chunk_stage, entity_stage, fetched_before, scrape_stage


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="sluice")
    a.add_argument("--stage", choices=["scrape", "entities", "chunk", "all"], default="all")
    a.add_argument("--pages", help="Parquet table of pages (url, html); without it the scrape stage crawls over HTTP from --start")
    a.add_argument("--base-url", default="https://")
    a.add_argument("--start", nargs="*", default=[])
    a.add_argument("--include", nargs="*", default=["."])
    a.add_argument("--max-depth", type=int, default=3)
    a.add_argument("--max-urls", type=int, default=100)
    a.add_argument("--delay", type=float, default=1.0, help="seconds between requests to a host")
    a.add_argument("--fetch-tasks", type=int, default=4)
    a.add_argument("--pdfs", help="folder to land PDF files in")
    a.add_argument("--markdown", nargs="*", default=[], help="folders of Markdown files")
    a.add_argument("--entities", nargs="*", default=[], help="JSON files of entities; later ones win")
    a.add_argument("--out", required=True)
    a.add_argument("--strict-report", action="store_true")
    a.add_argument("--array", action="store_true", help="chunks also as one JSON array")
    a.add_argument("-v", "--verbose", action="store_true")
    o = a.parse_args(argv)
    spark = SparkSession.builder.appName("sluice").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if o.verbose else "WARN")
    logging.basicConfig(level=logging.INFO if o.verbose else logging.WARNING)
    pages = spark.read.parquet(o.pages) if o.pages else None
    if o.stage in ("scrape", "all") and (pages is not None or o.start):
        conf = CrawlConf(base_url=o.base_url, include=tuple(o.include), max_depth=o.max_depth, max_urls=o.max_urls, delay_seconds=o.delay, tasks=o.fetch_tasks)
        done = scrape_stage(pages, o.start, conf, f"{o.out}/markdown", pdfs=o.pdfs, spark=spark)
        print(f"found {done.found_pages} pages and {done.found_pdfs} PDF files; {done.made_pages} pages and {done.made_pdfs} PDF files became Markdown")
        if pages is None:
            pages = fetched_before(spark, f"{o.out}/markdown_crawl")
    if o.stage in ("entities", "all") and pages is not None:
        made = entity_stage(pages, o.base_url, f"{o.out}/entities")
        print(f"{made.count()} entities")
    if o.stage in ("chunk", "all") and o.markdown:
        run = chunk_stage(spark, o.markdown, o.entities, o.out, ChunkConf(strict_report=o.strict_report), o.array)
        run.report.show(truncate=False, vertical=True)


if __name__ == "__main__":
    main()
