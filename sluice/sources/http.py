"""Pages and files over HTTP, with retries and spacing: as a Spark data source (opt-in: spark.dataSource.register(HttpPages)) or from
a table of URLs. A host's URLs are dealt to several tasks, which keep the delay between them (see pacing)."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from http.client import HTTPException

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.conf import CrawlConf
from sluice.functions.urls import pdf_filename
from sluice.operators.shared import remove, written
from sluice.sources.pacing import Steps, host_of, paced


class HttpPages(DataSource):
    """Options: urls (separated by line breaks), retries, delay, timeout, user_agent, headers (a JSON object), partitions."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    """Deals each host's URLs evenly to the partitions; a partition keeps to its own steps."""

    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.conf = CrawlConf(
            base_url="",
            retries=int(options.get("retries", 3)),
            delay_seconds=float(options.get("delay", 1.0)),
            timeout_seconds=float(options.get("timeout", 30.0)),
            user_agent=options.get("user_agent", "Mozilla/5.0"),
            headers=json.loads(options.get("headers", "{}")),
            tasks=int(options.get("partitions", 4)),
        )

    def partitions(self):
        dealt: list[list[str]] = [[] for _ in range(self.conf.tasks)]
        seen: dict[str, int] = {}
        for url in self.urls:
            n = seen[host_of(url)] = seen.get(host_of(url), -1) + 1
            dealt[n % self.conf.tasks].append(url)
        return [InputPartition((k, own)) for k, own in enumerate(dealt)]

    def read(self, partition):
        task, urls = partition.value
        for url, found in fetched(urls, task, self.conf):
            yield url, None if found is None else found[0].decode(found[1], "replace")


def once(url: str, conf: CrawlConf) -> tuple[bytes, str] | None:
    """What stands there and its character set, or None where it can't be had."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": conf.user_agent} | dict(conf.headers)), timeout=conf.timeout_seconds) as r:
            return r.read(), r.headers.get_content_charset() or "utf-8"
    except (OSError, ValueError):
        return None


def fetched(urls: list[str], task: int, conf: CrawlConf) -> Iterator[tuple[str, tuple[bytes, str] | None]]:
    """Each of a task's URLs with its content, or None after the settings' retries."""
    return paced(urls, Steps(task, conf.tasks, conf.delay_seconds), lambda url: once(url, conf), conf.retries, conf.delay_seconds)


def fetch_bytes(url: str, retries: int = 3, delay: float = 1.0, timeout: float = 30.0, agent: str = "Mozilla/5.0", headers: dict | None = None) -> tuple[bytes, str] | None:
    """One URL on its own; waits longer after each failure."""
    conf = CrawlConf(base_url="", retries=retries, delay_seconds=delay, timeout_seconds=timeout, user_agent=agent, headers=headers or {})
    for n in range(retries):
        if (found := once(url, conf)) is not None:
            return found
        if n < retries - 1:
            time.sleep(delay * (n + 1))
    return None


def fetch(url: str, retries: int = 3, delay: float = 1.0, timeout: float = 30.0, agent: str = "Mozilla/5.0") -> str | None:
    """The page as text, or None."""
    found = fetch_bytes(url, retries, delay, timeout, agent)
    return None if found is None else found[0].decode(found[1], "replace")


def dealt(urls: DataFrame, tasks: int) -> DataFrame:
    """url, task of the distinct URLs of a table's first column: a host's URLs go to all tasks alike, whatever their number."""
    rows = urls.select(F.col(urls.columns[0]).alias("url")).filter("url is not null").distinct()
    return rows.withColumn("task", F.pmod(F.xxhash64("url"), F.lit(tasks)).cast("int")).repartitionById(tasks, "task")


def fetch_table(urls: DataFrame, conf: CrawlConf, text: bool = True) -> DataFrame:
    """url, content of each URL of a table (its first column), by the settings' retries, delay, time limit, agent and headers;
    texts come as UTF-8. A batch of URLs is fetched and handed on before the next one is read."""

    def task(batches):
        import pandas as pd

        for b in batches:
            for k, own in b.groupby("task")["url"]:
                rows = [(url, None if found is None else found[0].decode(found[1], "replace").encode() if text else found[0]) for url, found in fetched(list(own), int(k), conf)]
                yield pd.DataFrame(rows, columns=["url", "content"])

    return dealt(urls, conf.tasks).mapInPandas(task, "url string, content binary")


def page_fetcher(conf: CrawlConf):
    """For crawl.Crawl: a table of URLs to url, html."""
    return lambda urls: fetch_table(urls, conf).select("url", F.decode("content", "utf-8").alias("html"))


#: Bytes that a download holds at once.
BLOCK = 1 << 20
LANDED = "url string, file string, n_bytes long"


def place_of(name: str):
    """The file system and path of a place as Spark names it (nothing in it is percent-encoded), for a worker."""
    from pyarrow import fs

    if (local := re.match(r"(?:file:(?://)?)?(/.*)", name, re.S)) is not None:
        return fs.LocalFileSystem(), local[1]
    scheme, _, rest = name.partition("://")
    return fs.FileSystem.from_uri(f"{re.sub('^s3[an]$', 's3', scheme)}://{urllib.parse.quote(rest, safe='/:@')}")


def opened(file: str) -> bytes:
    """A landed file's content."""
    files, path = place_of(file)
    with files.open_input_stream(path) as f:
        return f.read()


class Landing:
    """A file on its way: blocks go to a part of its own, a further attempt asks for what is missing, and the whole part is renamed."""

    def __init__(self, url: str, files, part: str, conf: CrawlConf):
        self.url, self.files, self.part, self.conf = url, files, part, conf
        self.done, self.mark, self.sink = 0, None, None

    def begin(self) -> None:
        self.end()
        self.done, self.mark, self.sink = 0, None, self.files.open_output_stream(self.part)

    def end(self) -> None:
        if self.sink is not None:
            self.sink.close()
        self.sink = None

    def attempt(self) -> int | None:
        """Bytes of the whole part; None where the rest couldn't be had."""
        asked = {"User-Agent": self.conf.user_agent, "Accept-Encoding": "identity"} | dict(self.conf.headers)
        if self.done and self.mark:  # without a mark nobody can tell whether the rest belongs to the same file
            asked |= {"Range": f"bytes={self.done}-", "If-Range": self.mark}
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, headers=asked), timeout=self.conf.timeout_seconds) as r:
                if self.sink is None or r.status != 206 or not (r.headers["Content-Range"] or "").startswith(f"bytes {self.done}-"):
                    if r.status == 206:  # another range than the missing one
                        self.mark = None
                        return None
                    self.begin()
                    tag = r.headers["ETag"] or ""
                    self.mark = tag if tag and not tag.startswith("W/") else None
                length = r.headers["Content-Length"]
                whole = None if length is None else self.done + int(length)
                while block := r.read(BLOCK):
                    self.sink.write(block)
                    self.done += len(block)
        except (OSError, ValueError, HTTPException):
            return None
        return self.done if whole in (None, self.done) else None


def download(urls: DataFrame, folder: str, conf: CrawlConf) -> DataFrame:
    """url, path (the PDF file's name), file (where it stands below the folder), n_bytes of each distinct URL of a table's first column.

    Tasks write files block by block to the shared file system, under a name of their own, and rename what is whole, so that no reader
    meets a piece of a file; one that broke off is asked for the rest where the server tells that it is the same file. What can't be
    had leaves nothing, and no file. What stands whole in the folder from an earlier run isn't fetched again. Files are named by their
    URL's digest, so those of one name all stay.
    """
    spark = urls.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()

    def task(batches):
        import pandas as pd

        files, base = place_of(root)
        for sub in ("files", "parts"):
            files.create_dir(f"{base}/{sub}", recursive=True)
        for b in batches:
            names = {u: f"{hashlib.sha256(u.encode()).hexdigest()}.pdf" for u in b["url"]}
            there = {u: info.size for u, info in zip(names, files.get_file_info([f"{base}/files/{n}" for n in names.values()]), strict=True) if info.is_file}
            for url, n in there.items():
                yield pd.DataFrame([(url, f"{root}/files/{names[url]}", n)], columns=["url", "file", "n_bytes"])
            for k, own in b.groupby("task")["url"]:
                steps, landings = Steps(int(k), conf.tasks, conf.delay_seconds), {}

                def attempt(url, landings=landings):
                    if url not in landings:
                        landings[url] = Landing(url, files, f"{base}/parts/{uuid.uuid4().hex}", conf)
                    return landings[url].attempt()

                for url, n in paced([u for u in own if u not in there], steps, attempt, conf.retries, conf.delay_seconds):
                    landing = landings.pop(url)
                    begun = landing.sink is not None
                    landing.end()
                    if n is not None:
                        files.move(landing.part, f"{base}/files/{names[url]}")
                    elif begun:
                        files.delete_file(landing.part)
                    yield pd.DataFrame({"url": [url], "file": [None if n is None else f"{root}/files/{names[url]}"], "n_bytes": pd.array([n], "Int64")})

    got = dealt(urls, conf.tasks).mapInPandas(task, LANDED)
    out = written(got.select("url", pdf_filename(F.col("url")).alias("path"), "file", "n_bytes"), f"{folder}/list")
    remove(spark, f"{folder}/parts")  # of tasks that were lost
    return out
