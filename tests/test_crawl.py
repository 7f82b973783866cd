"""Crawls over HTTP against a local server, pacing, and the bits beside visited URLs."""

import random
import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sluice.conf import CrawlConf
from sluice.operators import crawl
from sluice.operators.visited import Visited
from sluice.sources import http
from sluice.sources.pacing import Steps, paced


def site():
    """path -> links: cycles, a page that is gone, PDF files, links out."""
    rng = random.Random(4)
    links = {f"/in/{i}": [f"/in/{rng.randrange(40)}" for _ in range(3)] + [f"/in/{i}", "/out/x"] for i in range(30)}  # 30 and beyond aren't there
    links["/in/0"] += ["/in/a.PDF", "/files/syllabus.pdf", "/files/other.pdf", "/in/1#part", "/in/2/"]
    return links


@pytest.fixture
def server():
    links, log = site(), []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            log.append((time.time(), self.path, self.headers["X-Own"]))
            ok = self.path in links and self.path != "/in/7"
            self.send_response(200 if ok else 500)
            self.end_headers()
            if ok:
                self.wfile.write(("<h1>" + self.path + "</h1>" + "".join(f'<a href="{x}">l</a>' for x in links[self.path])).encode())

        def log_message(self, *a):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", log
    made.shutdown()


def brute(start, max_depth, max_urls):
    links, found, level = site(), {}, sorted(start)
    for depth in range(max_depth + 1):
        pages = sorted(x for x in level if x.startswith("/in/") and not x.lower().endswith(".pdf"))[: max_urls - sum(k == "page" for _, k in found.values())]
        found |= {x: (depth, "pdf") for x in level if x.lower().endswith(".pdf") and (x.startswith("/in/") or "syllabus" in x)} | {x: (depth, "page") for x in pages}
        if sum(k == "page" for _, k in found.values()) >= max_urls or not pages:
            break
        level = {x.partition("#")[0].rstrip("/") for p in pages if p != "/in/7" for x in links.get(p, ())} - set(found)
    return {(x, *v) for x, v in found.items()}


def conf_of(base, **more):
    return CrawlConf(base_url=base, include=("/in/",), delay_seconds=0.0, retries=1, **more)


def rows_of(found, base):
    return {(r.url.removeprefix(base), r.depth, r.kind) for r in found.collect()}


@pytest.mark.parametrize("depth, most", [(3, 200), (2, 200), (3, 9), (0, 5)])
def test_live_crawl_equals_brute_force(spark, server, tmp_path, depth, most):
    base, log = server
    conf = conf_of(base, max_depth=depth, max_urls=most)
    made = crawl.Crawl(spark, [f"{base}/in/0/"], conf, http.page_fetcher(conf), str(tmp_path / "state"), keep_pages=True)
    assert rows_of(made.run(), base) == brute(["/in/0"], depth, most)
    asked = [p for _, p, _ in log]
    assert len(asked) == len(set(asked))  # nothing is fetched twice
    expanded = {x for x, d, k in brute(["/in/0"], depth, most) if k == "page" and d < depth}
    assert set(asked) <= expanded  # only what is expanded


def test_crawl_goes_on_in_its_folder(spark, server, tmp_path):
    base, log = server
    conf, folder = conf_of(base, max_depth=3), str(tmp_path / "state")
    calls = []

    def breaks(urls):
        if calls:
            raise RuntimeError("lost")
        calls.append(1)
        return http.page_fetcher(conf)(urls)

    with pytest.raises(RuntimeError):
        crawl.Crawl(spark, [f"{base}/in/0"], conf, breaks, folder, keep_pages=True).run()
    assert len(log) == 1
    made = crawl.Crawl(spark, [f"{base}/in/0"], conf, http.page_fetcher(conf), folder, keep_pages=True)
    assert rows_of(made.run(), base) == brute(["/in/0"], 3, 200)
    asked = [p for _, p, _ in log]
    assert asked.count("/in/0") == 1 and len(asked) == len(set(asked))
    n = len(asked)
    assert rows_of(made.run(), base) == brute(["/in/0"], 3, 200) and len(log) == n  # a finished one fetches nothing


def test_command_line_scrapes_a_live_site(spark, server, tmp_path):
    from sluice.__main__ import main

    base, log = server
    main(["--stage", "scrape", "--start", f"{base}/in/0", "--base-url", base, "--include", "/in/", "--max-depth", "1", "--delay", "0", "--out", str(tmp_path)])
    got = {r.name: r.markdown for r in spark.read.parquet(str(tmp_path / "markdown")).collect()}
    want = {x for x, _, k in brute(["/in/0"], 1, 100) if k == "page" and x in site() and x != "/in/7"}
    assert len(got) == len(want) and all(any(f"# {x}" in m for m in got.values()) for x in want)


def test_requests_of_a_host_keep_their_distance(spark, server):
    base, log = server
    delay = 0.3
    conf = CrawlConf(base_url=base, delay_seconds=delay, retries=2, tasks=4, headers={"X-Own": "1"})
    urls = spark.createDataFrame([(f"{base}/in/{i}",) for i in (*range(10), 35)], "url string")
    got = {r.url.removeprefix(base): r.content for r in http.fetch_table(urls, conf).collect()}
    assert len(got) == 11 and got["/in/7"] is None and got["/in/35"] is None and got["/in/3"].startswith(b"<h1>/in/3")
    times = sorted(t for t, _, _ in log)
    assert len(times) == 13 and {x for *_, x in log} == {"1"}  # two that failed came twice
    assert min(b - a for a, b in zip(times, times[1:])) > delay * 0.8
    log.clear()
    spark.dataSource.register(http.HttpPages)
    made = spark.read.format("http_pages").options(urls="\n".join(f"{base}/in/{i}" for i in range(8, 16)), retries=1, delay=delay, partitions=4, headers='{"X-Own": "2"}').load().collect()
    times = sorted(t for t, _, _ in log)
    assert len(made) == 8 == len(times) and {x for *_, x in log} == {"2"} and min(b - a for a, b in zip(times, times[1:])) > delay * 0.8


def test_paced_by_a_clock_of_its_own():
    """Tasks of very different speed, hosts of every size, failures: no two requests of a host within the delay."""
    rng, delay, tasks = random.Random(9), 1.0, 3
    begun = defaultdict(list)
    for task in range(tasks):
        now = [1000.0 + rng.random() * 40]  # a late task

        def attempt(url, now=now):
            begun[url.split("/")[2]].append(now[0])
            now[0] += rng.choice([0.01, 0.2, 3.0])
            return None if rng.random() < 0.2 else url

        def sleep(s, now=now):
            now[0] += s + 0.001

        urls = [f"http://h{rng.choice([0, 0, 0, 1, 2, i])}/{task}-{i}" for i in range(60)]
        got = list(paced(urls, Steps(task, tasks, delay), attempt, 2, delay, lambda now=now: now[0], sleep))
        assert sorted(u for u, _ in got) == sorted(urls) and all(x in (u, None) for u, x in got)
    for times in begun.values():
        times.sort()
        assert all(b - a >= delay for a, b in zip(times, times[1:]))


def test_visited_bits(spark, monkeypatch):
    from sluice.operators import visited

    few = Visited(spark)
    few.add(spark.range(100).selectExpr("concat('u', id) AS url"), 100)
    assert few.unseen(spark.range(90, 120).selectExpr("concat('u', id) AS url")).count() == 20
    monkeypatch.setattr(visited, "FEW", 50)
    url = "concat('https://a.example/', id) AS url"
    seen = Visited(spark)
    assert seen.unseen(spark.range(5).selectExpr(url)).count() == 5
    seen.add(spark.range(0, 100).selectExpr(url), 100)
    small = len(seen.bits)
    seen.add(spark.range(100, 9000).selectExpr(url), 8900)  # a larger table of bits
    assert len(seen.bits) > small
    rest = seen.unseen(spark.range(8900, 9990).selectExpr(url))
    assert sorted(r.url for r in rest.collect()) == sorted(f"https://a.example/{i}" for i in range(9000, 9990))
    fresh = spark.range(10_000, 40_000).selectExpr(url)
    plan = seen.unseen(fresh)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("LeftAnti") == 1
    n_bits, bits = len(seen.bits) * 8, seen.bits
    doubtful = sum(all(bits[x >> 3] >> (x & 7) & 1 for x in r[0]) for r in fresh.select(visited.positions(fresh.url, n_bits)).collect())
    assert doubtful < 30_000 * 0.05  # so few links go into the join
