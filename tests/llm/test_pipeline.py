"""The pipeline's stages on small tables, each against a brute-force version of it on its own input."""

from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from test_operators import LOWER, ORACLE_SQL, WORD, base_counts, repeats
from tokenizers import Tokenizer


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        if name != "packing":
            assert got.columns == docs.columns
        rows = [r.asDict() for r in got.collect()]
        out.append(([r.asDict() for r in docs.collect()], rows))
        if name != "packing":
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_quality(stages, folder):
    """The base rules in Python, and the method's verdicts as the SQL has them."""
    before, after = stages[0]
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    kept = c.sql(f"SELECT doc_id, n_words FROM ({ORACLE_SQL['op5_quality']}) WHERE kept").fetchall()
    assert Counter((r["doc_id"], len(WORD.findall(r["text"]))) for r in after) == Counter(kept)
    bad = [r for r in before if (c := base_counts(r["text"] or ""))[0] < 20 or 100 * c[4] > 30 * c[0]]
    assert bad and all(r not in after for r in bad) and all(r in before for r in after) and len(after) >= 50


def test_one_of_each_group(stages):
    before, after = stages[1]
    docs = [(r["doc_id"], r["text"]) for r in before]
    # groups by their smallest id and text, as texts of one id may be of several groups
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and group[i] != group[j]:
                was = group[i]
                group = [group[j] if g == was else g for g in group]
    with_id = {g for g, (d, _), s in zip(group, docs, sets, strict=True) if d is not None and s}
    kept = [(r["doc_id"], r["text"]) for r in after if r["doc_id"] is not None and shingles(r["text"])]
    least = {g: min(d for h, (d, _), s in zip(group, docs, sets, strict=True) if h == g and d is not None and s) for g in with_id}
    assert Counter(d for d, _ in kept) == Counter(least.values()) and all(k in docs for k in kept)
    free = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows if r["doc_id"] is None or not shingles(r["text"]))
    assert free(before) == free(after) and len(after) < len(before)


def test_substrings(stages):
    before, after = stages[2]
    docs = [(r["doc_id"], r["text"]) for r in before]
    want = Counter()
    for (d, t), (w, gone) in zip(docs, repeats(docs), strict=True):
        want[d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t] += 1
    assert Counter((r["doc_id"], r["text"]) for r in after) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_packing(stages):
    """Every id of every document lies in one piece, and sequences hold their pieces without gaps."""
    before, after = stages[3]
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], len(exact.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in before)
    whole, sequences = Counter(), {}
    for r in after:
        whole[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = Counter()
    for (d, n), k in want.items():
        total[d] += n * k
    assert whole == total and Counter((r["doc_id"], r["doc_tokens"]) for r in after if r["start"] == 0) == want
    for parts in sequences.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024


def test_run(spark, folder, empty):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
