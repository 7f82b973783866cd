"""Queries that take whole texts, against brute-force versions."""

from sluice.plans.queries import QUERIES

TEXTS = ["one two three four five\nsix\n\na|b  c d e", "", None, "x " * 3000 + "\ny"]


def markdown_of(text):
    rows = [["a b", ""]] + [[w.replace("|", "\\|") for w in line.split()] for line in (text or "").split("\n")]
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def test_every_word_is_a_cell(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.markdown for r in QUERIES["table_to_markdown_words"](spark, str(tmp_path)).collect()}
    assert got == {i: markdown_of(t) for i, t in enumerate(TEXTS)}
