"""op11, op12 and op13 against brute force, and what they promise on lost runs, replays and odd rows."""

import datetime
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sluice.llm import op11_exact, op12_compaction, op13_middle
from sluice.llm.common import Shelf

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()


def test_exact(spark, folder, documents):
    got = op11_exact.op11_exact(spark, folder).collect()
    groups = defaultdict(list)
    for key, text in documents:
        groups[digest(text)].append(key)
    largest = {d: max((k for k in keys if k is not None), default=None) for d, keys in groups.items()}
    assert Counter((r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in got) == Counter((k, d, largest[d], len(keys)) for d, keys in groups.items() for k in keys)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_hot_texts_and_empty(spark, empty, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("Hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 100)).alias("text"))
    got = op11_exact.exact_duplicates(rows, str(tmp_path / "index")).collect()
    hot = [r for r in got if r.text_sha256 == digest("hot")]
    assert len(got) == 3000 and len(hot) == 2000 and {r.group_size for r in hot} == {2000} and [r.doc_id for r in hot if r.kept] == [2998]
    assert op11_exact.op11_exact(spark, empty).collect() == []


def test_index_stays_and_replays(spark, tmp_path):
    path = str(tmp_path / "index")
    found = lambda *texts: op11_exact.digests(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    index = op11_exact.DigestIndex(spark, path, 5)
    index.add(0, found("a", "b", "B"))
    index.close()
    again = op11_exact.DigestIndex(spark, path)  # as another session opens it
    assert again.buckets == 5 and again.rows().count() == 2
    for _ in range(2):  # a batch that runs twice
        again.add(1, found("A", "c", "d", "d"))
        assert sorted(r.doc_id for r in again.kept(1).collect()) == [1, 3]
    assert sorted((r.batch, r.doc_id) for r in again.rows().collect()) == [(0, 0), (0, 2), (1, 1), (1, 3)]
    plan = again.unseen(2, found("x"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan, plan
    assert "Exchange" not in plan[plan.rindex("Sort [digest") :], plan  # the index isn't shuffled
    again.close()


def middle(key, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    x = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if text == "" or any(z in text for z in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    return key, n, form, len(a), len(m), sha(f"<S>{s}<P>{a}<M>{m}" if form == "spm" else f"<P>{a}<S>{s}<M>{m}"), sha(text)


def test_middle(spark, folder, empty, documents):
    got = Counter(map(tuple, op13_middle.op13_middle(spark, folder).collect()))
    assert got == Counter(middle(*d) for d in documents)
    assert {k[2] for k in got} == {"plain", "psm", "spm"}
    assert op13_middle.op13_middle(spark, empty).collect() == []


def test_middle_round_trip_beside_sentinels(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("<<>PSM \n") for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["<P", "<S> x", "a<", "<M", "M>", "x" * 100_000 + " <", "w " * 50_000]
    made = op13_middle.fill_in_middle(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rate=100, spm_rate=50)
    got = {r.doc_id: r for r in made.withColumn("back", op13_middle.restored(F.col("output"), F.col("form"))).collect()}
    assert all(got[i].back == t for i, t in enumerate(texts))
    assert all((got[i].form == "plain") == (t == "" or any(s in t for s in ("<P>", "<S>", "<M>"))) for i, t in enumerate(texts))
    assert all(r.prefix + r.middle + r.suffix == r.text for r in got.values() if r.form != "plain")


# --- compaction --------------------------------------------------------------------------------------------------------


def make_clicks(n, seed=3, days=9):
    rng = random.Random(seed)
    began = datetime.datetime(1969, 12, 28)
    rows = []
    for i in range(n):
        day = 0 if rng.random() < 0.4 else rng.randrange(days)  # a hot day; days before 1970 too
        rows.append((i, began + datetime.timedelta(days=day, seconds=rng.randrange(86400) // 600 * 600), rng.choice([None, rng.randint(-9999, 99999) / 100]), 7, f"{{{i}}}"))
    rows += [rows[5]] * 3 + [(None, rows[0][1], 1.005, 1, None), (n + 1, None, 2.5, 1, "x"), (n + 2, None, None, 1, "y")]
    rng.shuffle(rows)
    return rows


SCHEMA = "click_id long, arrived_at timestamp_ntz, value double, day int, path string"


def brute(rows):
    total = len(rows)
    share = lambda x: 1 + total // x
    name = lambda k: "" if k is None else str(k)
    day = lambda t: None if t is None else (t.date() - datetime.date(1970, 1, 1)).days
    counts, files = Counter(day(r[1]) for r in rows), defaultdict(list)
    for r in rows:
        h, d = zlib.crc32(name(r[0]).encode()), day(r[1])
        files[d, h // 16 % (1 + counts[d] // share(150)), min(h % 4, h // 4 % 4)].append(r)
    for held in files.values():
        held.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[0] is not None, r[0] or 0))
    out, groups = [], defaultdict(list)
    for (d, lot, piece), held in sorted(files.items(), key=lambda x: (-len(x[1]), x[0][1:])):
        if len(held) >= share(600):
            out.append((d, [(lot, piece)], held))
        elif (g := next((g for g in groups[d] if len(g[1]) + len(held) <= share(400)), None)) is not None:
            g[0].append((lot, piece))
            g[1].extend(held)
        else:
            groups[d].append(([(lot, piece)], list(held)))
    out += [(d, *g) for d, gs in groups.items() for g in gs]
    result = set()
    for d, sources, held in out:
        ids = [r[0] for r in held if r[0] is not None]
        cents = sum(0 if r[2] is None else int((100 * r[2] + 0.5) // 1) for r in held)
        sha = hashlib.sha256(",".join(name(r[0]) for r in held).encode()).hexdigest()
        result.add((d, *sources[0], len(held), min(ids), max(ids), cents, ",".join(f"{a}-{b}" for a, b in sources), sha, "click_id,arrived_at,value,day,path", len(sources) > 1))
    return result


@pytest.fixture(scope="module")
def clicks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clicks"))
    rows = make_clicks(900)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/clicks.parquet")
    return path, rows


def local(path):
    return "/" + path.partition(":")[2].lstrip("/")


def test_compaction(spark, clicks):
    path, rows = clicks
    got = op12_compaction.op12_compaction(spark, path).collect()
    want = brute(rows)
    assert {tuple(r[c] for c in r.__fields__ if c != "path") for r in got} == want and len(got) == len(want)
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)
    folder = os.path.dirname(local(got[0].path))
    assert {os.path.join(folder, x) for x in os.listdir(folder) if not x.startswith(("_", "."))} == {local(r.path) for r in got}
    assert not os.path.exists(f"{folder}/{op12_compaction.WORK}")
    for r in got:
        held = pq.ParquetFile(local(r.path)).read()
        assert ",".join(held.column_names) == r.columns
        assert hashlib.sha256(",".join("" if k is None else str(k) for k in held["click_id"].to_pylist()).encode()).hexdigest() == r.ids_sha256
    every = lambda x: Counter(map(tuple, x))
    assert every(spark.read.parquet(folder).collect()) == every(rows)


def test_compaction_publishes_again(spark, clicks, tmp_path, monkeypatch):
    path, rows = clicks
    table, folder, shelf = spark.read.parquet(f"{path}/clicks.parquet"), str(tmp_path / "data"), Shelf(spark, "test")
    layout = op12_compaction.Layout(table, shelf)
    op12_compaction.start(table, folder, layout)
    began = {x: open(f"{folder}/{x}", "rb").read() for x in os.listdir(folder) if x.startswith("part-")}
    monkeypatch.setattr(op12_compaction, "publish", lambda *a: None)  # as if the driver was lost before it
    made = op12_compaction.compact(spark, folder, layout)
    monkeypatch.undo()
    assert Counter(map(tuple, spark.read.parquet(folder).collect())) == Counter(map(tuple, rows))  # readers see the old files still
    waiting = sorted(x for x in os.listdir(f"{folder}/_compaction/files") if x.startswith("part-"))
    os.rename(f"{folder}/_compaction/files/{waiting[0]}", f"{folder}/merged-{waiting[0]}")  # and one was moved
    op12_compaction.publish(spark, folder)
    op12_compaction.publish(spark, folder)
    got = op12_compaction.describe(spark, folder, layout, made).collect()
    assert {tuple(r[c] for c in r.__fields__ if c != "path") for r in got} == brute(rows)
    for r in got:
        if not r.rewritten:  # byte for byte
            assert open(local(r.path), "rb").read() == began[os.path.basename(local(r.path))]
    shelf.close()


def test_compaction_of_few_and_no_rows(spark, tmp_path):
    for k, rows in enumerate(([], make_clicks(9)[:1], [(1, datetime.datetime(2024, 1, 1), 1.0, 1, "a")] * 4)):
        path = str(tmp_path / str(k))
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/clicks.parquet")
        got = op12_compaction.op12_compaction(spark, path).collect()
        assert len(got) == bool(rows) and sum(r.n_rows for r in got) == len(rows)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in op12_compaction.op12_compaction(spark, str(tmp_path / "0")).schema] == [x.replace("long", "bigint") for x in op12_compaction.RESULT.split(", ")]
