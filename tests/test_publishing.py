"""Outputs that are published together, counts that come with writes, duplicates across batches, PDF files' fallbacks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sluice.conf import ChunkConf
from sluice.operators import chunks as K
from sluice.operators import dedup
from sluice.pipeline import chunk_documents, chunk_stage, pdf_urls_to_markdown
from sluice.sources import readers, sinks
from sluice.streaming import ingest


def prose(n, w="w"):
    return " ".join([w] * n)


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "md"
    place.mkdir()
    table = "| a |\n| - |\n" + "\n".join("| x |" for _ in range(60))
    for name, text in {"a": "# A\n" + prose(90), "b": "# A\n" + prose(90), "c": f"short é\n{table}", "d": "## D\n" + prose(100, "v") + "\n## E\nfew"}.items():
        (place / f"{name}.md").write_text(text)
    return place


def test_stage_writes_and_counts(spark, folder, tmp_path):
    conf, out = ChunkConf(strict_report=True), str(tmp_path / "out")
    run = chunk_stage(spark, [str(folder)], [], out, conf, array=True)
    want = chunk_documents(readers.markdown(spark, str(folder)), conf=conf).report.first().asDict()
    assert run.report.first().asDict() == want and want["duplicates_skipped"] == 1 and want["too_small_skipped"] == 2 and want["tables_split"] == 1
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{out}/chunk_report").collect()))["chunks_by_type"] == want["chunks_by_type"]
    assert spark.read.text(f"{out}/errors").count() == 1
    array = json.load(open(f"{out}/chunks.json"))
    lines = [json.loads(r.value) for r in spark.read.text(f"{out}/chunks").collect()]
    whole = lambda xs: sorted(json.dumps({k: x.get(k) for k in array[0]}, sort_keys=True) for x in xs)
    assert whole(array) == whole(lines) and [x["source_file"] for x in array] == sorted(x["source_file"] for x in array)
    assert "é" in open(f"{out}/chunks.json").read() or not any("é" in x["text"] for x in array)
    assert sorted(map(str, readers.chunks(spark, f"{out}/chunks.json", array=True).collect())) == sorted(map(str, readers.chunks(spark, f"{out}/chunks").collect()))
    assert not [x for x in os.listdir(out) if x.startswith("_staging")]


def test_large_files_beside_small_ones(spark, folder, tmp_path):
    small = chunk_stage(spark, [str(folder)], [], str(tmp_path / "o1"), ChunkConf(strict_report=True))
    mixed = chunk_stage(spark, [str(folder)], [], str(tmp_path / "o2"), ChunkConf(strict_report=True, large_bytes=250))
    rows = lambda p: sorted(map(str, readers.chunks(spark, f"{tmp_path}/{p}/chunks").collect()))
    assert rows("o1") == rows("o2") and small.report.first() == mixed.report.first()


def test_failed_run_leaves_old_outputs(spark, folder, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    chunk_stage(spark, [str(folder)], [], out)
    before = {n: sorted(r.value for r in spark.read.text(f"{out}/{n}").collect()) for n in ("chunks", "errors", "events", "chunk_report")}
    (folder / "e.md").write_text("# E\n" + prose(95, "u"))
    monkeypatch.setattr(sinks, "event_log", lambda *a: (_ for _ in ()).throw(RuntimeError("full")))
    with pytest.raises(RuntimeError):
        chunk_stage(spark, [str(folder)], [], out)
    monkeypatch.undo()
    assert {n: sorted(r.value for r in spark.read.text(f"{out}/{n}").collect()) for n in before} == before
    assert not [x for x in os.listdir(out) if x.startswith("_staging")]


def test_publishing_ends_when_opened_again(spark, tmp_path):
    out = str(tmp_path / "out")
    with sinks.Together(spark, out) as place:
        spark.range(3).write.parquet(place.path("a"))
        spark.range(3).write.parquet(place.path("b"))
    place = sinks.Together(spark, out)
    spark.range(5).write.parquet(place.path("a"))
    spark.range(5).write.parquet(place.path("b"))
    open(f"{place.staging}/_ready", "w").close()  # as if the driver was lost after one move
    sinks._place(spark, out)[0].delete(place._at(f"{out}/a"), True)
    os.rename(f"{place.staging}/a", f"{out}/a")
    sinks.Together(spark, out)
    assert [spark.read.parquet(f"{out}/{x}").count() for x in "ab"] == [5, 5]
    left = sinks.Together(spark, out)
    spark.range(9).write.parquet(left.path("a"))  # and lost before it was whole
    sinks.Together(spark, out)
    assert spark.read.parquet(f"{out}/a").count() == 5 and not [x for x in os.listdir(out) if x.startswith("_staging")]


def test_empty_array(spark, tmp_path):
    rows = K.build_chunks(spark.createDataFrame([("a.md", "few")], "source_file string, raw string"))
    sinks.chunk_array(rows, str(tmp_path / "x.json"))
    assert json.load(open(tmp_path / "x.json")) == []


@pytest.mark.parametrize("few", [20_000, 0])
def test_split_equals_window(spark, monkeypatch, few):
    from pyspark.sql import Window

    from sluice.operators import visited

    monkeypatch.setattr(visited, "FEW", few)

    rows = spark.range(3000).select((F.col("id") % 700).cast("string").alias("hash"), F.concat(F.lit("a/"), F.col("id") % 13, F.lit(".md")).alias("source_file"), F.col("id").cast("int").alias("seq"), F.lit(1).alias("part"), F.concat(F.lit("c"), "id").alias("chunk_id"))
    rows = rows.unionByName(spark.range(5000).select(F.concat(F.lit("s"), "id").alias("hash"), F.lit("b.md").alias("source_file"), F.col("id").cast("int").alias("seq"), F.lit(1).alias("part"), F.concat(F.lit("d"), "id").alias("chunk_id")))
    kept, dropped = dedup.split_duplicates(rows)
    order = Window.partitionBy("hash").orderBy(dedup.place())
    want = rows.withColumn("n", F.row_number().over(order)).withColumn("original_id", F.first("chunk_id").over(order))
    assert sorted(r.chunk_id for r in kept.collect()) == sorted(r.chunk_id for r in want.filter("n = 1").collect())
    assert sorted((r.chunk_id, r.original_id) for r in dropped.collect()) == sorted((r.chunk_id, r.original_id) for r in want.filter("n > 1").collect())
    assert [len(x.collect()) for x in dedup.split_duplicates(rows.filter("source_file = 'b.md'"))] == [5000, 0]


def test_seen_hashes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest.SeenHashes, "MERGE", 3)
    seen = ingest.SeenHashes(spark, str(tmp_path / "seen"), digits=1)
    hashes = lambda *xs: spark.createDataFrame([(x, f"id-{x}-{i}") for i, x in enumerate(xs)], "hash string, chunk_id string")
    for n in range(10):
        for _ in range(1 + (n == 4)):  # a batch that runs again
            got = {r.hash: r.original_id for r in seen.before(n, hashes(*(f"{k}x" for k in range(n + 1)))).collect()}
            assert got == {f"{k}x": f"id-{k}x-0" for k in range(n)}
            seen.add(n, hashes(f"{n}x"))
    assert len(seen._folders()) <= 4  # merged


def test_duplicates_across_batches(spark, tmp_path):
    place, out = tmp_path / "in", str(tmp_path / "out")
    place.mkdir()
    for n, names in enumerate((("a", "b"), ("c",), ("d",))):
        for x in names:
            (place / f"{x}.md").write_text(prose(90) if x != "d" else prose(90, "v"))
        ingest.chunk_stream(ingest.files(spark, str(place)), out, str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.batch, r.source_file) for r in rows) == [(0, "in/a.md"), (2, "in/d.md")]
    first = next(r.chunk_id for r in rows if r.batch == 0)
    log = sorted(r.value for r in spark.read.text(f"{out}_log").select("value").collect())
    assert len(log) == 2 and all(f"original={first}" in x for x in log) and log[0].endswith("source=in/b.md") and log[1].endswith("source=in/c.md")


def test_pdf_fallbacks(spark, tmp_path, monkeypatch):
    from sluice import pipeline

    content = {"t": "tables", "p": "plain", "s": "scan", "n": "nothing"}
    for k, v in content.items():
        (tmp_path / k).write_text(v)
    monkeypatch.setattr(pipeline.http, "download", lambda *a: spark.createDataFrame([(f"u/{k}.pdf", f"{k}.pdf", f"file:{tmp_path}/{k}") for k in content], "url string, path string, file string"))
    asked = tmp_path / "asked"
    asked.mkdir()
    many, seen = prose(60), prose(70, "s")
    place = str(asked)

    def structured(c):
        return [(1, many if c == b"tables" else "few", [[["h"], ["1"]]])]

    def plain(c):
        open(f"{place}/plain-{c.decode()}", "w").close()
        return [(1, many if c == b"plain" else "less", [])]

    def scan(c):
        open(f"{place}/scan-{c.decode()}", "w").close()
        return [(1, seen if c == b"scan" else "no", [])]

    urls = spark.createDataFrame([("x",)], "url string")
    got = {r.name[0]: r.markdown for r in pdf_urls_to_markdown(urls, "x", str(tmp_path / "out"), structured, plain=plain, recognising=scan).collect()}
    assert "| h |" in got["t"] and many in got["p"] and "| h |" not in got["p"] and seen in got["s"] and "less" in got["n"]
    assert sorted(x.name for x in asked.iterdir()) == ["plain-nothing", "plain-plain", "plain-scan", "scan-nothing", "scan-scan"]
