import json
import random
import re

from pyspark.sql import functions as F

from sluice.conf import ChunkConf
from sluice.functions import classify as C
from sluice.operators import chunks as K
from sluice.operators import dedup, report, segment
from sluice.pipeline import chunk_documents
from sluice.plans import inputs, queries


def build(spark, rows, conf=ChunkConf(), registry=None):
    return K.build_chunks(spark.createDataFrame(rows, "source_file string, raw string"), registry, conf).orderBy("source_file", "seq", "part").collect()


def prose(n, word="w"):
    return " ".join([word] * n)


def test_least_size(spark):
    got = build(spark, [("a.md", prose(79)), ("b.md", prose(80)), ("c.md", prose(81)), ("d.md", "   \n"), ("e.md", "")])
    assert [(r.source_file, r.word_count) for r in got] == [("b.md", 80), ("c.md", 81)]
    assert got[0].source_type == "html" and got[0].section_hierarchy == [] and got[0].page_range is None


def test_soft_and_hard_limits(spark):
    docs = [(f"{n}.md", f"{prose(n)}\n### Next\n{prose(90)}") for n in (600, 601)] + [(f"b{n}.md", f"{prose(n)}\n\n{prose(90)}") for n in (700, 701)]
    got = build(spark, docs)
    assert {f: [r.word_count for r in got if r.source_file == f] for f in ("600.md", "601.md", "b700.md", "b701.md")} == {"600.md": [692], "601.md": [601, 92], "b700.md": [790], "b701.md": [701, 90]}


def test_hierarchy_is_that_at_the_end(spark):
    raw = f"# A\n## B\n### C\n{prose(90)}\n#### D\n{prose(5)}\n## E\n{prose(90)}\n# F \n```\n# G\n{prose(90)}"
    assert [r.section_hierarchy for r in build(spark, [("x.md", raw)])] == [["A", "B", "C", "D"], ["A", "E"], ["G"]]


def test_tables(spark):
    table = lambda n: "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | x |" for i in range(n))
    for n, parts in ((1, 1), (50, 1), (51, 2), (120, 3)):
        got = build(spark, [("pdfs/t.md", "# T\n" + table(n))])
        assert len(got) == parts and all(r.content_type == "table" and r.source_type == "pdf" and r.text.startswith("| a | b |\n| --- | --- |") for r in got)
        assert [r.chunk_id.endswith(f"_part{i + 1}") for i, r in enumerate(got)] == [parts > 1] * parts
    odd = "|  | x |\n| --- | --- |\n" + "\n".join(f"| {i} | y |" for i in range(60))
    assert [r.text.split("\n")[:2] for r in build(spark, [("o.md", odd)])] == [["|  | x |", "| --- | --- |"], ["|  | x |", "| 49 | y |"]]
    bare = "\n".join(f"| {i} |" for i in range(80))
    assert len(build(spark, [("n.md", bare)])) == 1


def test_page_ranges(spark):
    front = '---\ntitle: "x"\nsource_file: "x.pdf"\nsource_type: pdf\n---\n\n'
    body = f"# x\n\n<!-- page: 1 -->\n\n{prose(90)}\n\n## y\n<!-- page: 2 -->\n{prose(90)}\n## z\n{prose(90)}"
    compat = [r.page_range for r in build(spark, [("pdfs/x.md", front + body)])]
    aligned = [r.page_range for r in build(spark, [("pdfs/x.md", front + body)], ChunkConf(page_lines="aligned"))]
    assert aligned == [[1, 1], [1, 2], [2, 2]] and compat == [None, [1, 1], [1, 1]]
    assert [r.page_range for r in build(spark, [("z.md", f"<!-- page: 0 -->\n{prose(90)}")])] == [None]


def reference_fold(lines, soft, most):
    """The state machine line by line: (text, start, end, titles, tabular)."""
    out, now, start, stack, i = [], [], 0, [], 0
    flush = lambda end: out.append(("\n".join(now), start, end, [t for _, t in stack], False))
    count = lambda x: sum(len(y.split()) for y in x)
    while i < len(lines):
        if m := re.match(r"(#{1,6})\s+(.+)$", lines[i]):
            n = len(m[1])
            if now and (n <= 2 or n == 3 and count(now) > soft):
                flush(i - 1)
                now, start = [], i
            stack = [x for x in stack if x[0] < n] + [(n, m[2].strip())]
            now.append(lines[i])
        elif re.match(r"\s*\|", lines[i]):
            j = i
            while j < len(lines) and re.match(r"\s*\|", lines[j]):
                j += 1
            if now:
                flush(i - 1)
                now = []
            out.append(("\n".join(lines[i:j]), i, j - 1, [t for _, t in stack], True))
            start, i = j, j
            continue
        elif not lines[i].strip() and count(now) > most:
            flush(i - 1)
            now, start = [], i + 1
        else:
            now.append(lines[i])
        i += 1
    if now:
        flush(len(lines) - 1)
    return out


def test_segments_equal_the_line_by_line_version(spark):
    rng = random.Random(3)
    pool = ["", " ", "# A", "## B", "### C", "#### D", "a b c", "d e f g h i", "| x |", " | y |", "#no", "j"]
    docs = [(str(k), "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))) for k in range(300)]
    conf = ChunkConf(soft_words=8, max_words=12, table_rows=1000)
    got = segment.segments(spark.createDataFrame(docs, "k string, body string"), "k", "body", conf).orderBy("k", "seq").collect()
    mine: dict = {}
    for r in got:
        mine.setdefault(r.k, []).append((r.text, r.start_line, r.end_line, r.hierarchy, r.tabular))
    for k, body in docs:
        want = [x for x in reference_fold(body.split("\n"), 8, 12)]
        got_k = [(t, e, h, tab) for t, _, e, h, tab in mine.get(k, [])]
        assert got_k == [(t, e, h, tab) for t, _, e, h, tab in want], body


def test_partitioning_makes_no_difference(spark):
    docs = [(f"d{i}.md", f"# T{i}\n{prose(100 + i)}\n\n| a |\n| - |\n| {i % 3} |") for i in range(20)]
    want = None
    for n in ("1", "4", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = [tuple(map(str, r)) for r in build(spark, docs)]
        assert want is None or got == want
        want = got
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_first_wins(spark):
    docs = [("b/x.md", prose(90)), ("a/z.md", prose(90).upper()), ("a-b/x.md", prose(90)), ("c.md", prose(90, "v"))]
    run = chunk_documents(spark.createDataFrame(docs, "source_file string, raw string"))
    assert sorted(r.source_file for r in run.kept.collect()) == ["a/z.md", "c.md"]
    dropped = run.dropped.collect()
    assert sorted(r.source_file for r in dropped) == ["a-b/x.md", "b/x.md"] and len({r.original_id for r in dropped}) == 1
    row = run.report.first()
    assert (row.total_chunks, row.duplicates_skipped, row.too_small_skipped, row.chunks_by_type, row.chunks_by_source) == (2, 2, 0, {"section": 2}, {"html": 2})
    assert all(r.value.startswith("DUPLICATE: hash=") for r in report.duplicate_lines(run.dropped).collect())
    assert {json.loads(r.value)["event"] for r in report.event_lines(run.kept).collect()} == {"chunk_created"}


def test_totals_come_with_the_pass_that_makes_chunks(spark, tmp_path, monkeypatch):
    passes, table = [], "\n".join(["| a | b |", "|---|---|", *(f"| {i} | x |" for i in range(60))])
    docs = spark.createDataFrame([("a.md", f"short\n{table}\n \nshort too"), ("b.md", prose(90)), ("c.md", prose(90)), ("d.md", ""), ("e.md", None)], "source_file string, raw string").repartition(3)
    want = K.small_segments(docs).first().asDict()
    monkeypatch.setattr(K, "segments", lambda *x: passes.append(1) or segment.segments(*x))
    run = chunk_documents(docs, conf=ChunkConf(strict_report=True))
    got = run.report.first().asDict()
    assert len(passes) == 1 and {k: got[k] for k in want} == want == {"too_small_skipped": 2, "tables_split": 1}
    assert (got["total_chunks"], got["duplicates_skipped"]) == (3, 1)
    none = chunk_documents(docs.limit(0), conf=ChunkConf(strict_report=True)).report.first()
    assert (none.total_chunks, none.duplicates_skipped, none.too_small_skipped, none.tables_split, none.chunks_by_type) == (0, 0, 0, 0, {})
    passes.clear()
    texts = [(i, "w " * n, "s", "en") for i, n in enumerate((10, 90, 90, 0, 800), 1)]
    spark.createDataFrame(texts, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    row = queries.report_totals(spark, str(tmp_path)).first()
    found = K.build_chunks(inputs.markdown_docs(spark, str(tmp_path))).groupBy("hash").count().collect()
    assert (row.total_chunks, row.duplicates_skipped) == (len(found), sum(r["count"] - 1 for r in found)) and row.duplicates_skipped
    assert len(passes) == 2  # the query's, and that of the line above
    small = K.small_segments(inputs.markdown_docs(spark, str(tmp_path))).first()
    assert (row.too_small_skipped, row.tables_split) == (small.too_small_skipped, small.tables_split)


def test_strict_report(spark):
    table = "| a |\n| - |\n" + "\n".join("| x |" for _ in range(60))
    run = chunk_documents(spark.createDataFrame([("a.md", f"short\n{table}"), ("b.md", prose(90))], "source_file string, raw string"), conf=ChunkConf(strict_report=True))
    assert (run.report.first().too_small_skipped, run.report.first().tables_split) == (1, 1)


def test_json_round_trip(spark, tmp_path):
    from sluice.sources import readers, sinks

    run = chunk_documents(spark.createDataFrame([("a.md", prose(90)), ("b.md", "<!-- page: 3 -->\n" + prose(95))], "source_file string, raw string"))
    sinks.chunks(run.kept, str(tmp_path / "chunks"))
    sinks.report(run.report, str(tmp_path / "report"))
    back = readers.chunks(spark, str(tmp_path / "chunks")).orderBy("source_file").collect()
    assert [(r.word_count, r.page_range) for r in back] == [(90, None), (99, [3, 3])]
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect()))["total_chunks"] == 2
    (tmp_path / "c.json").write_text('[{"chunk_id": "x", "text": "Hello world", "word_count": 0}]')
    assert readers.chunks(spark, str(tmp_path / "c.json"), array=True).first().word_count == 2


def test_classifier(spark):
    cases = [
        ("| a | b |\n|---|---|\n| 1 | 2 |", "", [], "table"),
        ("Dr. John Mathew\nAssociate Professor", "", [], "profile"),
        ("Qualification: PhD\nEmail: a@b", "", ["Our Team"], "profile"),
        ("as in R2023", "", [], "regulation"),
        ("text", "Curriculum.md", [], "regulation"),
        ("- a\n- b\nc", "", [], "list"),
        ("a) x\n1. y\n• z", "", [], "list"),
        ("-\n-", "", [], "section"),
        ("hundreds of things and a method", "", [], "profile"),
        ("plain", "", [], "section"),
        ("", "regulation", [], "section"),
        (None, "", [], "section"),
    ]
    rows = spark.createDataFrame([(i, t, f, h) for i, (t, f, h, _) in enumerate(cases)], "i int, t string, f string, h array<string>")
    got = {r[0]: r[1] for r in rows.select("i", C.classify(F.col("t"), F.col("f"), F.col("h"))).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_profile_rule_on_long_texts(spark):
    texts = ["Word Another " * 10_000, "Dr. Some One " * 6_000, "Dr. " + "Abc D. " * 8_000 + " hod"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(C.names_person(F.col("t"))).collect()] == [False, False, True]


def test_order_of_paths(spark):
    rows = spark.createDataFrame([("a-b/x",), ("a/y",), ("a/x/z",)], "p string")
    assert [r.p for r in rows.orderBy(dedup.path_parts(F.col("p"))).collect()] == ["a/x/z", "a/y", "a-b/x"]


def test_long_runs_of_initials(spark):
    """Neither long runs of initials nor what nearly is a name overflow the stack; matches are those of the plain pattern."""
    import random
    import re

    from sluice.functions import classify as C

    rng = random.Random(7)
    plain = re.compile(r"(?:dr|prof|mrs|mr|ms)\.?\s*[a-z][a-z]+(?:\s+[a-z]\.?\s*)*\s+[a-z][a-z]", re.I)
    texts = ["".join(rng.choice(["dr", "Mr.", " ", "  ", "a", "b.", "jo", "doe", "\n", "."]) for _ in range(rng.randint(2, 14))) + " professor" for _ in range(3000)]
    long = ["Dr. john " + "a. " * 100_000 + "professor", "Dr. john " + "a b. " * 100_000 + "doe professor", "dr jo" * 50_000 + " professor", "Dr. john" + " a" * 100_000 + "professor"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts + long], "t string").coalesce(1).select(C.names_person(F.col("t"))).collect()]
    cut = [t[: t.lower().rindex("professor")] for t in texts]
    assert got[: len(texts)] == [bool(plain.search(t)) for t in cut] and 0 < sum(got[: len(texts)]) < len(texts)
    assert got[len(texts) :] == [False, True, True, False]


def test_shuffle_of_one_document_is_linear(spark):
    """Segmentation moves nothing, however many lines and markers a document has."""
    docs = spark.createDataFrame([("data/pdfs/a.md", "\n".join(f"<!-- page: {i} -->\nline {i}" for i in range(3000)))], "source_file string, raw string")
    plan = K.build_chunks(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    (row,) = K.build_chunks(docs, conf=ChunkConf(max_words=10**6, soft_words=10**6)).collect()
    assert row.page_range == [1, 2999]  # page 0 before its first line does not count
