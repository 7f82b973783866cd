"""Breadth-first crawling, over HTTP or over a table of pages (url, html) that stands for the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.conf import CrawlConf
from sluice.functions import urls as U
from sluice.functions.text import collapse
from sluice.operators.dedup import first_seen
from sluice.operators.shared import exists, new_folder, remove, settled, whole, written
from sluice.operators.visited import Visited


def link_graph(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url (normalised), link: each page's distinct links."""
    rows = pages.select(U.normalize(F.col(url)).alias("url"), F.explode(U.links(F.col(html), F.col(url))).alias("link"))
    return rows.distinct()


def page_table(pages: DataFrame, url: str = "url", html: str = "html"):
    """A fetcher (a table of URLs to url, html) over a table of pages, which stands for the network."""
    rows = pages.select(U.normalize(F.col(url)).alias("url"), F.col(html).alias("html"))
    return lambda urls: rows.join(urls, "url", "left_semi")


class Crawl:
    """Breadth-first discovery whose state is a folder: found/depth=n (url, kind), links/depth=n (url) and, if pages are kept,
    pages/depth=n (url, html). A crawl that was stopped goes on in its folder after the last table that was whole.

    Each level's candidates are the distinct links of the pages expanded before it. Those that can't be wanted go first; those that
    a level before has are told apart by bits, and by a join where the bits leave doubt. Within the level in which max_urls is
    reached, the smallest URLs stay. Pages at the greatest depth are listed, neither fetched nor followed; nor are pages beyond
    max_urls.
    """

    def __init__(self, spark: SparkSession, start: list[str] | DataFrame, conf: CrawlConf, fetch, folder: str, keep_pages: bool = False):
        self.spark, self.conf, self.fetch, self.folder, self.keep_pages = spark, conf, fetch, folder.rstrip("/"), keep_pages
        first = start.select(F.col(start.columns[0]).alias("url")) if isinstance(start, DataFrame) else spark.createDataFrame([(u,) for u in start], "url string")
        self.start = first.filter("url is not null").select(U.normalize(F.col("url")).alias("url")).distinct()

    def _wanted(self, links: DataFrame) -> DataFrame:
        """url, kind of what is listed: wanted PDF files, and valid pages."""
        url, conf = F.col("url"), self.conf
        valid = U.is_valid(url, conf.base_url, conf.include, conf.exclude)
        kind = F.when(U.wanted_pdf(url, valid), "pdf").when(valid & ~U.is_pdf(url), "page")
        return links.select("url", kind.alias("kind")).filter("kind is not null")

    def run(self) -> DataFrame:
        """url, depth, kind of all that is reached."""
        seen, room, conf = Visited(self.spark), self.conf.max_urls, self.conf
        for depth in range(conf.max_depth + 1):
            at = f"depth={depth}"
            level = whole(self.spark, f"{self.folder}/found/{at}")
            if level is None:
                links = self.start if not depth else self.spark.read.parquet(f"{self.folder}/links/depth={depth - 1}")
                fresh = settled(seen.unseen(self._wanted(links)))
                held = fresh.filter("kind = 'page'")
                if held.count() > room:
                    fresh = fresh.filter("kind = 'pdf'").unionByName(held.orderBy("url").limit(room))
                level = written(fresh, f"{self.folder}/found/{at}")
            counts = {r["kind"]: r["count"] for r in level.groupBy("kind").count().collect()}
            room -= counts.get("page", 0)
            if room <= 0 or depth == conf.max_depth or not counts.get("page"):
                break
            if whole(self.spark, f"{self.folder}/links/{at}") is None:
                pages = self._pages(level.filter("kind = 'page'").select("url"), at)
                written(pages.select(F.explode(U.links(F.col("html"), F.col("url"))).alias("url")).distinct(), f"{self.folder}/links/{at}")
            seen.add(level, sum(counts.values()))
        return self.found()

    def _pages(self, urls: DataFrame, at: str) -> DataFrame:
        if not self.keep_pages:
            return self.fetch(urls)
        kept = whole(self.spark, f"{self.folder}/pages/{at}")
        return written(self.fetch(urls), f"{self.folder}/pages/{at}") if kept is None else kept

    def found(self) -> DataFrame:
        rows = self.spark.read.schema("url string, kind string, depth int").parquet(f"{self.folder}/found")
        return rows.select("url", "depth", "kind")

    def pages(self) -> DataFrame | None:
        """url, html of the pages that were fetched, if they are kept and there are any."""
        path = f"{self.folder}/pages"
        return self.spark.read.schema("url string, html string, depth int").parquet(path).select("url", "html") if exists(self.spark, path) else None


def discover(pages: DataFrame, start: list[str] | DataFrame, conf: CrawlConf, url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """url, depth, kind (page or pdf) of all that is reached from the start (URLs, or a table whose first column has them) in a table of
    pages, sorted. Only pages that are expanded are read for links. folder: where the crawl's state is, by default a new one that
    goes afterwards."""
    spark: SparkSession = pages.sparkSession
    place = folder or new_folder(spark, "crawl")
    found = settled(Crawl(spark, start, conf, page_table(pages, url, html), place).run())
    if folder is None:
        remove(spark, place)
    return found.orderBy("kind", "url")


ANCHOR = r"""(?is)<a\s([^>]*?)href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""


def plain(html: Column) -> Column:
    """The text between tags, each piece stripped, as one."""
    return F.array_join(F.transform(F.split(html, r"(?s)<[^>]*>"), collapse), "")


def faculty_links(pages: DataFrame, base_url: str, url: str = "url", html: str = "html") -> DataFrame:
    """page, name, url: people's links of each page, the first of each target."""
    whole = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(0))
    rows = pages.select(F.col(url).alias("page"), F.posexplode(whole).alias("at", "anchor"))
    rows = rows.select("page", "at", F.regexp_extract("anchor", ANCHOR, 2).alias("url"), plain(F.regexp_extract("anchor", ANCHOR, 3)).alias("name"))
    rows = rows.filter(F.col("url").contains("/faculty/") & F.col("url").startswith(base_url) & (F.length("name") > 3))
    return first_seen(rows.withColumn("__by", F.struct("page", "url")), "__by", F.col("at")).select("page", "name", "url")
