"""Documents cut at any lines give the pieces of the whole text."""

import random

import pytest

from sluice.conf import ChunkConf
from sluice.operators import segment, stretches

NAMES = "seq part parts tabular text start_line end_line hierarchy page_range".split()


def document(rng, n):
    kinds = [lambda: "# " + rng.choice("ABC"), lambda: "## b", lambda: "### c " + rng.choice("xyz"), lambda: "#### d", lambda: "| a | b |", lambda: "|---|", lambda: "", lambda: f"<!-- page: {rng.randrange(40)} -->", lambda: "w " * rng.randint(1, 9)]
    weights = [1, 1, 3, 1, 3, 1, 5, 2, 12]
    lines, table = [], 0
    for _ in range(n):
        table = table - 1 if table else (rng.randint(2, 9) if rng.random() < 0.05 else 0)
        lines.append("| r | s |" if table else rng.choices(kinds, weights)[0]())
    return "\n".join(lines)


def cut(rng, text, at_most):
    lines, out = text.split("\n"), []
    while lines:
        n = rng.randint(1, at_most)
        out.append("\n".join(lines[:n]))
        lines = lines[n:]
    return out


@pytest.mark.parametrize("mode", ["compat", "aligned"])
def test_random_cuts(spark, mode):
    conf, rng = ChunkConf(soft_words=20, max_words=30, table_rows=3, page_lines=mode), random.Random(1 + len(mode))
    docs, rows = [], []
    for k in range(500):
        front = rng.choice(["", "", "---\ntitle: x\n<!-- page: 3 -->\n---\n\n"])
        text = document(rng, rng.choice([1, 3, 40, 120]))
        docs.append((str(k), front + text, len(front)))
        rows += [(str(k), nth, part, front if not nth else "") for nth, part in enumerate(cut(rng, text, rng.choice([1, 4, 60])))]
    whole = spark.createDataFrame(docs, "key string, raw string, skip int")
    want = segment.segments(whole, "key", "raw", conf, whole.skip).collect()
    got = stretches.segments_of(spark.createDataFrame(rows, "key string, nth long, text string, front string").repartition(6), conf).collect()
    order = lambda rs: sorted([r.key, *(r[c] for c in NAMES)] for r in rs)
    assert order(got) == order(want)


def test_a_file_in_splits(spark, tmp_path):
    from sluice.operators.chunks import build_chunks, build_large_chunks
    from sluice.sources import readers

    rng = random.Random(3)
    for name, front, end in (("a", "---\ntitle: t\n---\n\n", "\n"), ("b", "", ""), ("c", "", "\n\n")):
        (tmp_path / f"{name}.md").write_bytes((front + document(rng, 4000) + end).replace("\n", "\r\n" if name == "b" else "\n").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        large = readers.large_markdown(spark, str(tmp_path), root=str(tmp_path), least_bytes=0, stretch_bytes=3000)
        assert large.rdd.getNumPartitions() > 3 and large.groupBy("key").count().filter("count < 4").isEmpty()
        got = build_large_chunks(large).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = build_chunks(readers.markdown(spark, str(tmp_path), root=str(tmp_path))).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 20
