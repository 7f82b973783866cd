import gc
import json

from pyspark.sql import functions as F

from sluice.conf import CrawlConf
from sluice.operators import crawl, entities, html, pdf
from sluice.sources import http, readers

PEOPLE = [
    {"id": "faculty_john_doe", "name": "Dr. John Doe", "aliases": ["John Doe"], "type": "faculty"},
    {"id": "faculty_jane_smith", "name": "Prof. Jane Smith", "aliases": ["Jane Smith", "J. Smith"], "type": "faculty"},
    {"id": "course_os", "name": "Operating Systems", "aliases": ["OS Course"], "type": "course"},
    {"id": "", "name": "Nobody", "aliases": []},
]


def registry(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps(PEOPLE))
    (tmp_path / "broken.json").write_text("[{")
    return readers.entities(spark, str(tmp_path / "f.json"), str(tmp_path / "missing.json"), str(tmp_path / "broken.json"))


def test_registry(spark, tmp_path):
    loaded = registry(spark, tmp_path)
    assert loaded.count() == 3 and [r.n for r in entities.load_counts(loaded).collect()] == [3]
    assert entities.get_entity(loaded, "course_os").first()["name"] == "Operating Systems"
    found = entities.lookup(loaded)
    rows = spark.createDataFrame([("dr. JOHN doe",), ("j smith",), ("unknown",)], "t string")
    assert {r.t: r.entity_id for r in entities.exact(rows, found, "t").collect()} == {"dr. JOHN doe": "faculty_john_doe", "j smith": "faculty_jane_smith", "unknown": None}
    near = spark.createDataFrame([("dr john dor",), ("dr jon doe",), ("operating system",), ("dr john d",)], "norm string")
    assert {r.norm: r.entity_id for r in entities.fuzzy(near, found).collect()} == {"dr john dor": "faculty_john_doe", "dr jon doe": "faculty_john_doe"}


def test_refs_in_texts(spark, tmp_path):
    found = entities.lookup(registry(spark, tmp_path))
    rows = [(1, "Dr. John Doe teaches Operating Systems; John Doe again"), (2, "a talk by Dr. Jon Doe"), (3, "Dr. Jon Doe presented work"), (4, ""), (5, None)]
    got = {r.k: r.entity_refs for r in entities.entity_refs(spark.createDataFrame(rows, "k int, t string"), found, "t").collect()}
    assert got == {1: ["course_os", "faculty_john_doe"], 2: ["faculty_john_doe"], 3: [], 4: [], 5: []}
    none = entities.lookup(readers.entities(spark))
    assert [r.entity_refs for r in entities.entity_refs(spark.createDataFrame(rows[:1], "k int, t string"), none, "t").collect()] == [[]]


def test_later_entity_wins_and_empty_alias(spark):
    rows = [("a", "X", ["Same", ""], "faculty", "", 0), ("b", "Y", ["same!"], "course", "", 1)]
    found = entities.lookup(spark.createDataFrame(rows, "id string, name string, aliases array<string>, type string, url string, load_seq int"))
    assert {r.norm: (r.entity_id, r.is_faculty) for r in found.collect()} == {"x": ("a", True), "y": ("b", False), "same": ("b", True), "": ("a", True)}
    assert entities.entity_refs(spark.createDataFrame([("zzz",)], "t string"), found, "t").first().entity_refs == ["a"]


def test_automata_equal_join(spark, tmp_path, monkeypatch):
    found = entities.lookup(registry(spark, tmp_path))
    rows = spark.createDataFrame([(1, "dr john doe and jane smith"), (2, "nothing"), (3, None)], "k int, norm string")
    names = found.withColumnRenamed("norm", "name")
    want = sorted(rows.join(names, F.col("norm").contains(F.col("name"))).select("k", "entity_id").distinct().collect())
    assert sorted(entities.contained(rows, found, "k", "norm").collect()) == want and len(want) == 2
    other = entities.lookup(spark.createDataFrame([("z", "nothing", [], "course", "", 0)], "id string, name string, aliases array<string>, type string, url string, load_seq int"))
    assert [tuple(r) for r in entities.contained(rows, other, "k", "norm").collect()] == [(2, "z")]  # a worker's automaton is that of the registry
    monkeypatch.setattr(entities, "LETTERS", 1)
    assert sorted(entities.contained(rows, found, "k", "norm").collect()) == want


def test_html_to_markdown():
    page = "<html><head><title>T</title><script>var x = '<p>no</p>';</script></head><body><nav>menu</nav><h1>Title</h1><h2>Two</h2><h3>Three</h3><p>Some <b>bold</b> &amp; <i>it</i><p>next<ul><li>a<li>b</ul><table><tr><th>A<th>B<tr><td>1<td>2</table><a href='mailto:x'>mail</a> <a href='/y'>link</a><img src=i.png alt=pic><img src=j.png></body></html>"
    got = html.convert(page, "https://a.example/p", "2024-01-01T00:00:00")
    assert got.startswith('---\ntitle: "Title"\nsource_url: "https://a.example/p"\nsource_type: html\nscraped_at: "2024-01-01T00:00:00"\n---\n\n# Title')
    for part in ("## Two", "### Three", "Some **bold** & *it*", "- a\n- b", "| A | B |\n| --- | --- |\n| 1 | 2 |", "mail [link](/y)", "![pic](i.png)"):
        assert part in got
    assert "var x" not in got and "menu" not in got and "j.png" not in got
    assert html.convert("", "https://a.example/some-page_x/") == "# Some Page X\n\n"
    assert html.convert("<div class='head-ad-x'>z</div><main>m</main><p>o</p>", "https://a.example/q") == "# Q\n\nm"


def test_pages_are_converted_once_and_a_hundred_at_a_time(spark):
    pages = spark.createDataFrame([("https://a.example/p", "<main>x<nav>n</nav></main>"), ("https://a.example/q", "<![x[a]]>"), ("https://a.example/r", None), (None, "<p>y")], "url string, html string")
    out = html.scrape(pages)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "ArrowEvalPython" not in plan
    want = [(u, html.convert(p, u or "")) for u, p in pages.collect() if p is not None and p != "<![x[a]]>"]
    assert sorted(((r.url, r.markdown) for r in out.collect()), key=str) == sorted(want, key=str)


def test_a_converted_page_leaves_nothing_to_the_collector():
    page = "<nav><i>n</i></nav><main><p>a<b>c</b><p>d<img src=i><table><tr><td>1</table></main>" * 50
    html.convert(page, "u")
    gc.collect()
    gc.disable()
    try:
        html.convert(page, "u")
        assert gc.collect() < 50
    finally:
        gc.enable()


def test_markdown_cleaning_is_the_same_in_both_forms(spark):
    texts = ["a\n\n\n\nb  \n \n\nc", "#x\n##y z\n#", "", " \n\n a \n", "a\n \n \nb"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(html.clean_markdown(F.col("t"))).collect()]
    assert got == [html.clean_markdown_text(t) for t in texts]


def test_profiles(spark):
    page = "<h1>Dr. A B</h1><p>Assistant Professor</p>\n<p>Qualification: M.Tech, PhD</p>\n<p>AICTE ID: 1-23</p>"
    p = spark.createDataFrame([(page, "u"), ("", "v")], "h string, u string").select(html.profile(F.col("h"), F.col("u")).alias("p")).collect()
    assert tuple(p[0].p) == ("Dr. A B", "Assistant Professor", "M.Tech, PhD", "", "1-23", "", "u") and tuple(p[1].p) == ("", "", "", "", "", "", "v")


def test_faculty_links(spark):
    page = '<a href="https://a.example/faculty/1"> Dr. <b>A</b> </a><a href="https://a.example/faculty/1">other name</a><a href="https://a.example/faculty/2">abc</a><a href="/faculty/3">Long name</a>'
    got = crawl.faculty_links(spark.createDataFrame([("p", page)], "url string, html string"), "https://a.example").collect()
    assert [tuple(r) for r in got] == [("p", "Dr.A", "https://a.example/faculty/1")]


def test_crawl(spark):
    link = lambda *u: "".join(f'<a href="{x}">x</a>' for x in u)
    pages = [("https://a.example/in/0", link("/in/1/", "/in/2#f", "/out", "/syllabus.pdf", "/in/z.PDF")), ("https://a.example/in/1", link("/in/0", "/in/3")), ("https://a.example/in/3", link("/in/4"))]
    table = spark.createDataFrame(pages, "url string, html string")
    conf = CrawlConf(base_url="https://a.example", include=("/in/",), max_depth=2)
    got = {(r.url.removeprefix("https://a.example/"), r.depth, r.kind) for r in crawl.discover(table, ["https://a.example/in/0/"], conf).collect()}
    assert got == {("in/0", 0, "page"), ("in/1", 1, "page"), ("in/2", 1, "page"), ("syllabus.pdf", 1, "pdf"), ("in/z.PDF", 1, "pdf"), ("in/3", 2, "page")}
    few = crawl.discover(table, ["https://a.example/in/0/"], CrawlConf(base_url="https://a.example", include=("/in/",), max_urls=2))
    assert few.filter("kind = 'page'").count() == 2


def test_pdf_pages(spark):
    rows = [[[" a  b ", None], ["x|y"]], [], [["h"], ["1", "2", "3"]]]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "r array<array<string>>").select(pdf.table_to_markdown(F.col("r"))).collect()]
    assert got == ["| a b |  |\n| --- | --- |\n| x\\|y |  |", "", "| h |  |  |\n| --- | --- | --- |\n| 1 | 2 | 3 |"]
    many = " ".join(["w"] * 50)
    page = lambda n, t, x=(): (n, t, list(x))
    data = [("a.pdf", [page(1, many, [[["h"], ["1"]]]), page(2, "")], []), ("b.pdf", [page(1, "few", [[["h"]]])], [page(1, "p\n q\n\nr")]), ("c.pdf", [], [])]
    df = spark.createDataFrame(data, f"n string, s {pdf.PAGES}, p {pdf.PAGES}")
    a, b, c = (r[0] for r in df.select(pdf.pdf_to_markdown(F.col("n"), F.col("s"), F.col("p"))).collect())
    assert a == f'---\ntitle: "a"\nsource_file: "a.pdf"\nsource_type: pdf\n---\n\n# a\n\n<!-- page: 1 -->\n\n| h |\n| --- |\n| 1 |\n\n{many}\n'
    assert b.endswith("# b\n\n<!-- page: 1 -->\n\np q\n\nr\n") and c is None
    files = spark.createDataFrame([("x.pdf", bytearray(b"1")), ("y.pdf", bytearray(b""))], "path string, content binary")
    got = {r.path: len(r.pages) for r in pdf.extract_pages(files, lambda c: [(1, c.decode()[0], [])]).collect()}
    assert got == {"x.pdf": 1, "y.pdf": 0}


def test_http_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            ok = self.path == "/ok"
            self.send_response(200 if ok else 500)
            self.end_headers()
            self.wfile.write(b"<p>hi</p>" if ok else b"")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(http.HttpPages)
    got = {r.url: r.html for r in spark.read.format("http_pages").options(urls=f"{base}/ok\n{base}/no", retries=2, delay=0).load().collect()}
    server.shutdown()
    assert got == {f"{base}/ok": "<p>hi</p>", f"{base}/no": None}


def test_streamed_files(spark, tmp_path):
    from sluice.streaming.ingest import chunk_stream, files

    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    text = " ".join(["w"] * 90)
    (folder / "a.md").write_text(text)
    for n in range(2):
        chunk_stream(files(spark, str(folder)), out, str(tmp_path / "ck")).awaitTermination()
        (folder / "b.md").write_text(text.upper())
        (folder / "c.md").write_text(text + " v")
    assert spark.read.parquet(out).count() == 2


def test_stages(spark, tmp_path):
    from sluice.__main__ import main

    folder = tmp_path / "md"
    folder.mkdir()
    (folder / "a.md").write_text("# A\n" + " ".join(["w"] * 90) + " Dr. John Doe")
    (tmp_path / "f.json").write_text(json.dumps(PEOPLE))
    main(["--stage", "chunk", "--markdown", str(folder), "--entities", str(tmp_path / "f.json"), "--out", str(tmp_path / "out")])
    assert readers.chunks(spark, str(tmp_path / "out" / "chunks")).first().entity_refs == ["faculty_john_doe"]
    assert spark.read.text(str(tmp_path / "out" / "events")).count() == 1


def test_scrape_stage_counts(spark, tmp_path):
    from sluice.pipeline import entity_stage, scrape_stage

    base = "https://a.example"
    pages = [(f"{base}/in/{i}", f'<h1>Page {i}</h1><a href="/in/{i + 1}">n</a><a href="/in/f{i}.pdf">f</a><a href="{base}/faculty/{i}">Person {i}</a>') for i in range(3)]
    table = spark.createDataFrame([*pages, (f"{base}/in/x", None)], "url string, html string")
    conf = CrawlConf(base_url=base, include=("/in/",))
    done = scrape_stage(table, [f"{base}/in/0"], conf, str(tmp_path / "md"))
    assert (done.found_pages, done.found_pdfs, done.made_pages, done.made_pdfs) == (4, 3, 3, 0)
    found = [(r.kind, r.url) for r in crawl.discover(table, [f"{base}/in/0"], conf).collect()]
    assert found == sorted(found)
    assert entity_stage(table, base, str(tmp_path / "faculty")).count() == 3
    assert spark.read.schema(entities.ENTITY).json(str(tmp_path / "faculty_courses")).count() == 0 and (tmp_path / "faculty_programs").is_dir()


def test_pdf_urls_to_markdown(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from sluice.pipeline import fetched_pages, pdf_urls_to_markdown

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers["User-Agent"], self.headers["X-Own"]))
            ok = "bad" not in self.path
            self.send_response(200 if ok else 404)
            self.end_headers()
            self.wfile.write(b"some words of a file" if ok else b"")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    conf = CrawlConf(base_url=base, delay_seconds=0.0, retries=2, user_agent="own agent", headers={"X-Own": "1"})
    urls = spark.createDataFrame([(f"{base}/a.pdf",), (f"{base}/other/a.pdf",), (f"{base}/view",), (f"{base}/bad.pdf",)], "url string")
    got = pdf_urls_to_markdown(urls, str(tmp_path / "landed"), str(tmp_path / "md"), lambda c: [(1, c.decode(), [])], conf)
    rows = {r.url.removeprefix(base): r for r in got.collect()}
    assert set(rows) == {"/a.pdf", "/other/a.pdf", "/view"} and rows["/a.pdf"].name == "a.pdf" and rows["/view"].name.startswith("document_")
    assert "some words of a file" in rows["/a.pdf"].markdown
    assert [p for p, *_ in seen].count("/bad.pdf") == 2 and {x[1:] for x in seen} == {("own agent", "1")}
    assert {r.url.removeprefix(base): r.html for r in fetched_pages(spark, urls, conf).collect()} == {"/a.pdf": "some words of a file", "/other/a.pdf": "some words of a file", "/view": "some words of a file", "/bad.pdf": None}
    server.shutdown()


def test_paths_are_relative(spark, tmp_path):
    for name in ("pages", "pdfs"):
        (tmp_path / "data" / name / "sub dir").mkdir(parents=True)
        (tmp_path / "data" / name / "sub dir" / "x.md").write_text("t")
    folders = [str(tmp_path / "data" / n) for n in ("pages", "pdfs")]
    assert sorted(r.source_file for r in readers.markdown(spark, *folders).collect()) == ["pages/sub dir/x.md", "pdfs/sub dir/x.md"]
    assert sorted(r.source_file for r in readers.markdown(spark, *folders, root=str(tmp_path)).collect()) == ["data/pages/sub dir/x.md", "data/pdfs/sub dir/x.md"]
    elsewhere = readers.markdown(spark, *folders, root="/nowhere").first().source_file
    assert elsewhere.startswith("/") and elsewhere.endswith("x.md")


def test_deep_pages_stay(spark):
    n = 5000
    rows = spark.createDataFrame([("https://a.example/deep", "<div>" * n + "<p>inside</p>" + "</div>" * n)], "url string, html string")
    assert html.scrape(rows).first().markdown == "# Deep\n\ninside"


def test_html_to_markdown_by_construction():
    """Random simple pages whose Markdown is known from how they are put together."""
    import random

    rng = random.Random(12)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"])
    text = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))

    def inline():
        kind, t = rng.randrange(6), text(4)
        return {0: (f"<b>{t}</b>", f"**{t}**"), 1: (f"<i>{t}</i>", f"*{t}*"), 2: (f"<a href='/x'>{t}</a>", f"[{t}](/x)"), 3: (f"<a href='mailto:a'>{t}</a>", t), 4: (f"<code>{t}</code>", f"`{t}`")}.get(kind, (t, t))

    def line():
        parts = [inline() for _ in range(rng.randint(1, 4))]
        return " ".join(a for a, _ in parts), " ".join(b for _, b in parts)

    def block():
        kind = rng.randrange(7)
        a, b = line()
        if kind == 0:
            n, t = rng.randint(1, 6), text(5)
            return f"<h{n}>{t}</h{n}>", f"{'#' * n} {t}"
        if kind == 1:
            items = [line() for _ in range(rng.randint(1, 4))]
            return "<ul>" + "".join(f"<li>{x}</li>" for x, _ in items) + "</ul>", "\n".join(f"- {y}" for _, y in items)
        if kind == 2:
            items = [line() for _ in range(rng.randint(1, 4))]
            return "<ol>" + "".join(f"<li>{x}" for x, _ in items) + "</ol>", "\n".join(f"{i}. {y}" for i, (_, y) in enumerate(items, 1))
        if kind == 3:
            rows = [[text(2) for _ in range(3)] for _ in range(rng.randint(1, 4))]
            made = "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in rows) + "</table>"
            out = ["| " + " | ".join(r) + " |" for r in rows]
            return made, "\n".join([out[0], "| --- | --- | --- |", *out[1:]])
        if kind == 4:
            return f"<div class='{rng.choice(['popup', 'x-menu', 'sidebar-a', 'ad-b'])}'>{a}</div><script>{a}</script><!-- {a} -->", ""
        if kind == 5:
            return f"<img src=a.png width=20 alt=x><img src=b.png><div><img src='c.png' alt='pic'></div>", "![pic](c.png)"
        return f"<p>{a}</p>", b

    for _ in range(300):
        blocks = [block() for _ in range(rng.randint(1, 8))]
        inside = rng.choice(["<main>{}</main><p>outside</p>", "<article>{}</article>", "<div class=content>{}</div><div>outside</div>", "<div id='main-x'>{}</div>", "{}"])
        page = "<html><head><title>The title</title></head><body><nav>menu</nav>" + inside.format("\n".join(a for a, _ in blocks)) + "<footer>end</footer></body></html>"
        want = "\n\n".join(b for _, b in blocks if b)
        title = next((b.lstrip("# ") for a, b in blocks if a.startswith("<h1>")), "The title")
        got = html.convert(page, "https://a.example/u")
        assert got == (want if want.startswith("#") else f"# {title}\n\n{want}"), page
