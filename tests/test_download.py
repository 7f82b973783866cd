"""Streamed downloads against a local server that breaks off."""

import hashlib
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sluice.conf import CrawlConf
from sluice.sources import http

SIZE = 40 << 20


def block(i):
    return hashlib.sha256(str(i).encode()).digest() * 2048  # 64 KiB


def content(start=0):
    for i in range(start // 65536, SIZE // 65536):
        yield block(i)[start % 65536 if i == start // 65536 else 0 :]


@pytest.fixture
def server():
    """/whole.pdf; /breaks.pdf and /unmarked.pdf break off at first; /changed.pdf breaks off and is another file then; /never.pdf
    always breaks off; /gone.pdf isn't there; /empty.pdf is empty."""
    log = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked, path = self.headers["Range"], self.path.split("?")[0]
            seen = sum(p == self.path for p, _ in log)
            log.append((self.path, asked))
            if path == "/gone.pdf":
                return self.send_error(404)
            if path == "/empty.pdf":
                self.send_response(200)
                self.send_header("Content-Length", "0")
                return self.end_headers()
            tag = None if path == "/unmarked.pdf" else f'"{seen}"' if path == "/changed.pdf" else '"one"'
            start = int(asked[6:-1]) if asked and self.headers["If-Range"] == tag else 0
            self.send_response(206 if start else 200)
            self.send_header("Content-Length", str(SIZE - start))
            if tag:
                self.send_header("ETag", tag)
            if start:
                self.send_header("Content-Range", f"bytes {start}-{SIZE - 1}/{SIZE}")
            self.end_headers()
            for n, x in enumerate(content(start)):
                if n == 100 and (path == "/never.pdf" or seen == 0 and path != "/whole.pdf"):
                    return
                self.wfile.write(x)

        def log_message(self, *a):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", log
    made.shutdown()


CONF = CrawlConf(base_url="", delay_seconds=0.0, retries=3, tasks=2)


def test_files_land_whole_or_not_at_all(spark, server, tmp_path):
    base, log = server
    paths = ["/whole.pdf", "/breaks.pdf", "/unmarked.pdf", "/changed.pdf", "/never.pdf", "/gone.pdf", "/empty.pdf", "/whole.pdf?v=2"]
    urls = spark.createDataFrame([(base + x,) for x in [*paths, "/whole.pdf"]] + [(None,), ("no url",)], "u string")
    folder = str(tmp_path / "a folder")
    want = hashlib.sha256(b"".join(content())).hexdigest()
    got = {r.url.removeprefix(base): r for r in http.download(urls, folder, CONF).collect()}
    assert set(got) == {*paths, "no url"}
    whole = [x for x in paths if x not in ("/never.pdf", "/gone.pdf", "/empty.pdf")]
    for x in whole:
        assert got[x].n_bytes == SIZE and hashlib.sha256(http.opened(got[x].file)).hexdigest() == want
    assert http.opened(got["/empty.pdf"].file) == b"" and got["/empty.pdf"].n_bytes == 0
    assert all(got[x].file is None and got[x].n_bytes is None for x in ("/never.pdf", "/gone.pdf", "no url"))
    assert len({got[x].file for x in whole}) == 5  # two files of one name
    left = sorted(x.name for x in (tmp_path / "a folder").rglob("*") if x.is_file() and "list" not in x.parts and x.suffix != ".crc")
    assert len(left) == 6 and all(x.endswith(".pdf") for x in left)
    asked = {p: [r for q, r in log if q == p] for p in paths}
    assert asked["/breaks.pdf"] == [None, f"bytes={100 * 65536}-"] and asked["/unmarked.pdf"] == [None, None]
    assert len(asked["/never.pdf"]) == 3 and len(asked["/changed.pdf"]) == 2

    before = len(log)  # a further run fetches what isn't there
    again = {r.url.removeprefix(base): r for r in http.download(urls, folder, CONF).collect()}
    assert {k: (r.file, r.n_bytes) for k, r in again.items()} == {k: (r.file, r.n_bytes) for k, r in got.items()}
    assert {p for p, _ in log[before:]} == {"/never.pdf", "/gone.pdf"}


def test_a_download_holds_a_block(server, tmp_path):
    import tracemalloc

    base, _ = server
    files, path = http.place_of(str(tmp_path))
    landing = http.Landing(f"{base}/whole.pdf", files, f"{path}/part", CONF)
    tracemalloc.start()
    assert landing.attempt() == SIZE
    landing.end()
    assert tracemalloc.get_traced_memory()[1] < 8 * http.BLOCK
    tracemalloc.stop()
