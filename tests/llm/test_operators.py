"""Each query on small tables with nulls, empty and long texts, ties and clashing columns, against a brute-force version."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def same(got, want, columns):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert rows(spark, name, empty) == []


def test_op1_base(spark, folder, documents):
    got = rows(spark, "op1_licenses", folder)
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    want = []
    for d, t in documents:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(i, x) for i in range(len(w)) for p, x in phrases.items() if tuple(w[i : i + len(p)]) == p]
        want.append((d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    same(got, want, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"])
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert labels[413][0] == "apache,apache-2.0,gpl,gpl-3.0,mit" and labels[414] == ("bsd-3-clause", 1.0) and labels[400] == ("", 0.0)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) for r in got)


def test_op1_labels_and_scores_by_brute_force(spark):
    """Every rule against every text, without keywords or gates, and overlaps resolved pair by pair."""
    import random

    from sluice.llm import op1_licenses as o
    from sluice.llm.license_rules import CONFIDENCE, compile_rules

    rng, rules = random.Random(13), compile_rules()
    phrases = ["MIT License", "Apache License, Version 2.0", "GNU General Public License v3", "SPDX-License-Identifier: Apache-2.0", "BSD 3-Clause License", "licensed under the Mozilla Public License 2.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Creative Commons Attribution 4.0", "see the LICENSE file", "license", "mit", "plain words"]
    docs = [(i, rng.choice(["\n", " "]).join(rng.choice(phrases) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    want = []
    for d, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        folded = (" " + " ".join(words) + " ").encode()
        found = [(r, folded[: m.start()].count(b" ") - 1, folded[: m.end()].count(b" ") - 0) for r in rules for m in r.pattern.finditer(folded)]
        base = [x for x in found if x[0].kind == "base"]
        kept = []
        for r, s, e in sorted((x for x in found if x[0].kind != "base"), key=lambda x: (x[0].kind != "tag", x[1] - x[2], x[0].priority, x[1])):
            if all(e <= p or q <= s for _, p, q in kept):
                kept.append((r, s, e))
        score = 1 - math.prod(1 - CONFIDENCE[r.kind] for r, _, _ in kept + base) if kept or base else 0.0
        want.append((d, ",".join(sorted({r.label for r, _, _ in kept + base})), round(score, 6)))
    got = [(r.doc_id, r.labels, round(r.score, 6)) for r in o.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want) and len({x[1] for x in want}) > 20


def test_op1_resolves_as_pair_by_pair():
    import random

    from sluice.llm import op1_licenses as o

    rng, rules = random.Random(9), o.compile_rules()
    for n in (0, 1, 40, 400):
        found = [(rng.choice(rules), a := rng.randrange(300), a + rng.randint(1, 9)) for _ in range(n)]
        kept = []
        for r, s, e in sorted(found, key=lambda x: (x[0].kind != "tag", x[1] - x[2], x[0].priority, x[1])):
            if all(e <= p or q <= s for _, p, q in kept):
                kept.append((r, s, e))
        assert o.resolve(found) == sorted(kept, key=lambda x: x[1])
    import time

    began = time.process_time()
    assert len(o.scan_text(b"SPDX-License-Identifier: MIT\n" * 20_000)[-1]) == 20_000 and time.process_time() - began < 20


def test_op6_list_as_a_table(spark, folder):
    from sluice.llm import op6_urls as o

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    listed = spark.createDataFrame([(x.upper(),) for x in o.BLOCKED] * 2 + [(None,)], "domain string")
    assert sorted(map(str, o.filter_urls(pages, blocked=listed).collect())) == sorted(map(str, o.filter_urls(pages).collect()))


def test_op2_round_trip(spark, folder, documents):
    got = rows(spark, "op2_packing", folder)
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for d, t in documents:
        ids.setdefault(d, []).append(exact.encode(t or "", add_special_tokens=False).ids + [0])
    pieces = Counter()
    for d, lists in ids.items():
        for x in lists:
            for s in range(0, len(x), 1024):
                part = x[s : s + 1024]
                pieces[d, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(x)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == pieces
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_op2_takes_the_tightest_window():
    import random

    from sluice.llm import op2_packing as o

    rng = random.Random(3)
    for n in (0, 1, 5, 300):
        lengths = [rng.randint(1, rng.choice([3, 40, 100])) for _ in range(n)]
        room, want = [], {}
        for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
            fit = [r for r in room if r >= lengths[i]]
            at = len(room) if not fit else max(w for w, r in enumerate(room) if r == min(fit))
            if not fit:
                room.append(100)
            want[i] = (min(fit) if fit else 100) - lengths[i]
            room[at] -= lengths[i]
        got = o.best_fit_decreasing(lengths, 100)
        assert sorted(100 - o_ - lengths[i] for i, (_, o_) in enumerate(got)) == sorted(want.values())  # the room that each piece leaves
        assert len({w for w, _ in got}) == len(room)


def test_op2_padding_and_groups(spark):
    """Little padding, also where full windows fill groups of their own between remainders."""
    import random

    from sluice.llm import op2_packing as o

    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["alpha", "of", "the"]) for _ in range(rng.choice([rng.randint(2000, 4000), rng.randint(1, 60), rng.randint(1, 700)])))) for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    for group in (1 << 16, 100):
        got = o.pack(table, public_tokenizers.path(o.TOKENIZER), group=group).collect()
        used = Counter()
        for r in got:
            used[r.sequence_id] += r.length
        assert sum(1024 - x for x in used.values()) < (0.01 if group > 100 else 0.05) * 1024 * len(used) and max(used.values()) <= 1024


def repeats(documents, n=50):
    first = {}
    words = [WORD.findall(t or "") for _, t in documents]
    for (d, _), w in zip(documents, words, strict=True):
        for i in range(len(w) - n + 1 if d is not None else 0):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(documents, words, strict=True):
        gone = {j for i in range(len(w) - n + 1 if d is not None else 0) if first[tuple(w[i : i + n])] < d for j in range(i, i + n)}
        out.append((w, gone))
    return out


def test_op4_removal(spark, folder, documents):
    want = [(d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()) for (d, _), (w, gone) in zip(documents, repeats(documents), strict=True)]
    assert sum(x[2] for x in want) > 500
    same(rows(spark, "op4_substrings", folder), want, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def test_op4_with_hot_minimisers(spark, folder, documents):
    from sluice.llm import op4_substrings as o

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = o.cut_words(docs, o.repeated_spans(docs, hot=1, bucket_bytes=1 << 12)).collect()
    want = [(d, len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)) for (d, _), (w, gone) in zip(documents, repeats(documents), strict=True)]
    same([r.asDict() for r in got], want, ["doc_id", "n_removed", "kept"])


def test_op4_with_few_large_buckets_and_residue_bits(spark, folder, documents, monkeypatch):
    """A bucket is sorted in pieces, hot minimisers beyond HOT_KEYS are bits of residues, and columns may clash."""
    from sluice.llm import op4_substrings as o

    monkeypatch.setattr(o, "PIECE_BYTES", 3000)
    monkeypatch.setattr(o, "HOT_KEYS", 1)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"doc": F.lit(1), "Spans": F.lit(2), "__id": F.lit(3)})
    want = [(d, len(gone), " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t) for (d, t), (w, gone) in zip(documents, repeats(documents), strict=True)]
    for hot in (2000, 3):
        spans = o.repeated_spans(docs, hot=hot, bucket_bytes=1 << 30)
        out = o.remove_repeats(docs, spans)
        assert out.columns == docs.columns
        same([r.asDict() for r in out.collect()], [(d, t) for d, _, t in want], ["doc_id", "text"])


def test_op4_pieces_hold_each_string_once():
    import numpy as np

    from sluice.llm import op4_substrings as o

    rows = [(i, 0, 0, 1, i * 7 % 5, b"w%d " % i * (i % 3 + 1)) for i in range(100)]
    got = []
    for head, buf in o.pieces([o.packed(rows[:40]), o.packed(rows[40:])], 120):
        ends = np.cumsum(head[:, 4])
        assert len(buf) == ends[-1] and (len(buf) <= 120 or len(set(head[:, 5].tolist())) == 1)
        got += [(int(h[0]), buf[e - h[4] : e].tobytes()) for h, e in zip(head, ends, strict=True)]
    assert sorted(got) == [(r[0], r[5]) for r in rows]


def base_counts(t):
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen = 0, set()
    for x in t.split("\n"):
        if WORD.search(x):
            lines += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(covered)


def test_op5_base_and_verdicts(spark, folder, documents):
    got = rows(spark, "op5_quality", folder)
    want = []
    for d, t in documents:
        c = base_counts(t or "")
        want.append((d, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    same(got, want, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert all(r["kept"] == (not r["base_failed"]) for r in got if r["doc_id"] in {i for i in range(30) if i % 4})  # what the sample trusts


def test_op5_scores_by_hand(spark, folder, documents):
    """The same log-likelihood ratios, one n-gram at a time."""
    import numpy as np

    from sluice.llm import op5_quality as o
    from sluice.llm.common import Words

    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    good = {k for k, q in o.sampled_labels(labels).items() if q}
    assert good >= {1, 2, 3, 9999} and not good & {0, 4, 407}

    def grams(t):
        w = Words([(t or "").encode()])
        return o.buckets(w, w.hashes())[0].tolist()

    raw, target = Counter(), Counter()
    for d, t in documents:
        raw.update(grams(t))
        if d in good:
            target.update(grams(t))
    n, m, b = sum(raw.values()), sum(target.values()), o.BUCKETS
    ratio = lambda x: round(o.SCALE * (math.log((target[x] + 0.5) / (m + 0.5 * b)) - math.log((raw[x] + 0.5) / (n + 0.5 * b))))
    want = {(d, t): sum(map(ratio, grams(t))) / (o.SCALE * (o.PRIOR + len(grams(t)))) for d, t in documents}
    got = o.judge(docs, o.fit(docs, labels)).select("doc_id", "n_words", "score").collect()
    by_count = {}
    for (d, t), s in want.items():
        by_count.setdefault((d, len(WORD.findall(t or ""))), []).append(s)
    assert all(any(abs(r.score - s) < 1e-9 for s in by_count[r.doc_id, r.n_words]) for r in got)
    assert np.isfinite([r.score for r in got]).all()


@pytest.mark.parametrize("name", ["op1_licenses", "op4_substrings", "op8_media", "op9_jaccard"])
def test_equals_its_sql(spark, documents, tmp_path, name):
    """On documents with ids of their own, as the SQL tells documents apart by id."""
    docs = [(i, t) for i, (_, t) in enumerate(documents)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = c.sql(ORACLE_SQL[name])
    same(rows(spark, name, str(tmp_path)), want.fetchall(), want.columns)


def test_op5_equals_its_sql(spark, folder):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = c.sql(ORACLE_SQL["op5_quality"])
    same(rows(spark, "op5_quality", folder), want.fetchall(), want.columns)


def test_op6_equals_its_sql(spark, folder):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    want = c.sql(ORACLE_SQL["op6_urls"])
    same(rows(spark, "op6_urls", folder), want.fetchall(), want.columns)


def test_op6_exact_beyond_the_size_limit_and_with_a_small_cascade(spark, folder):
    from sluice.llm import op6_urls as o

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    want = sorted(map(str, o.filter_urls(pages).collect()))
    assert sorted(map(str, o.filter_urls(pages, size_limit=0).collect())) == want
    assert {r.verdict for r in o.filter_urls(pages, rules=(), blocked=()).collect()} == {"allow"}
    keys = spark.range(5000).selectExpr("xxhash64(id) AS key", "id % 10 = 0 AS listed")
    levels = o.cascade(keys)
    import numpy as np

    found = {r.key: r.listed for r in keys.collect()}
    got = o.member(levels, np.array(list(found), dtype=np.int64).view(np.uint64))
    assert got.tolist() == list(found.values()) and len(levels) > 1


def test_op7_texts(spark, folder):
    got = rows(spark, "op7_html", folder)
    texts = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert texts[0, "https://a.example.com/en/1"] == "T & t\n\none\n\ntwo x" and texts[1, "https://A.example.com/en/7?x#y"] == "U\n\nthree"
    assert texts[2, "http://casino-win.example.org/fr/1"] == "a < b < c" and texts[3, "http://www.casino-win.example.org/es/2"] == "" and texts[4, None] == ""
    assert texts[5, "no scheme"] == "H\n\ntext" and texts[6, "x://"] == "plain" and texts[6, "https://shop.example.net/de/8"] == "a\n\nb\n\nd"
    assert texts[None, "https://x.com/en/"] == " ".join(["w"] * 5000) and texts[7, "a://b://c/en/"] == "x" and len(got) == 11
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_op8_media(spark, folder, documents):
    got = rows(spark, "op8_media", folder)
    want = []
    for d, t in documents:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64) or bytes(64)
        m = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(p), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(p)) + p
        want.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()))
    same(got, want, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"])
    expected = {}
    for _, t in documents:
        p = (t or "").encode()
        x = [v - 128 for v in p + bytes(-len(p) % 64 or (0 if p else 64))]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
        expected[hashlib.sha256(bytes(v + 128 for v in x)).hexdigest()] = f"{len(x)}:{sum(x) / len(x):.6f}:{(sum(v * v for v in x) / len(x)) ** 0.5:.6f}:{max(map(abs, x))}:{crossings}"
    assert all(r["feature"] == expected[r["payload_sha256"]] for r in got)
    features = {}
    for r in got:
        assert features.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]


def test_op8_store_holds_each_chunk_once(spark, tmp_path, monkeypatch):
    import random

    from sluice.llm import op8_media as o

    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh ijk\n") for _ in range(60_000))
    docs = [(i, f"{rng.random()}" * (i + 1) + shared[i * 10 :]) for i in range(6)] + [(9, shared), (10, shared)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for k, small in enumerate((500_000, -1)):
        monkeypatch.setattr(o, "SMALL", small)
        got = o.media(table, str(tmp_path / f"store{k}")).collect()
        assert {r.doc_id: r.n_bytes for r in got} == {d: len(t) for d, t in docs}
        held = spark.read.parquet(str(tmp_path / f"store{k}")).selectExpr("explode(own) AS d")
        assert held.count() == held.distinct().count()
        stored = spark.read.parquet(str(tmp_path / f"store{k}")).selectExpr("sum(aggregate(data, 0L, (n, x) -> n + length(x))) AS n").first().n
        assert stored < 0.5 * sum(len(t) for _, t in docs)


def jaccard(documents):
    sets, parent = [], list(range(len(documents)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, t in documents:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(documents):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(documents, sets, strict=True))]


@pytest.mark.parametrize("hot", [200, 1])
def test_op9_components(spark, folder, documents, hot):
    from sluice.llm.op9_jaccard import jaccard_components

    got = jaccard_components(spark.read.parquet(f"{folder}/documents.parquet"), hot=hot).collect()
    want = jaccard(documents)
    assert len({c for _, _, c in want}) < len(documents) - 15
    same([r.asDict() for r in got], want, ["doc_id", "n_shingles", "component_id"])


def variants(rng, words, n, most):
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(100_000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("chunk", "rounds"), [(7, 2), (7, 0)])
def test_op9_chains_and_split_blocks(spark, monkeypatch, chunk, rounds):
    """A chain whose ends don't link, many variants of one text, and blocks that are compared in parts."""
    import random

    from sluice.llm import op9_jaccard as o

    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    docs = [(k, " ".join(words[k * 6 : k * 6 + 120])) for k in range(30)]
    docs += list(enumerate(variants(rng, words[:100], 60, 6), 1000))
    monkeypatch.setattr(o, "CHUNK", chunk)
    monkeypatch.setattr(o, "ROUNDS", rounds)
    got = o.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    same([r.asDict() for r in got], jaccard(docs), ["doc_id", "n_shingles", "component_id"])


def test_components(spark, monkeypatch):
    """A long path, stars around small and large nodes, a random graph, and tasks that hold few nodes."""
    import random

    from sluice.llm import graph
    from sluice.llm.common import Shelf

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(-300, 300)] + [(1000, x) for x in range(2000, 2300)] + [(9999, x) for x in range(3000, 3300)] + [(7, 7)]
    edges += [(5000 + rng.randrange(400), 5000 + rng.randrange(400)) for _ in range(300)]
    rng.shuffle(edges)
    up: dict[int, int] = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in sorted(edges, reverse=True):
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    for nodes in (10, 1_000_000):
        monkeypatch.setattr(graph, "NODES", nodes)
        shelf = Shelf(spark, "graph")
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5), shelf).collect()}
        shelf.close()
        want = {x: find(x) for a, b in edges for x in (a, b) if a != b}
        assert got == want
    shelf = Shelf(spark, "graph")
    assert graph.components(spark.createDataFrame([], "a long, b long"), shelf).collect() == []


def test_op9_large_group(spark):
    """2000 near copies, of which some link with few others or none."""
    import random

    from sluice.llm import op9_jaccard as o

    rng = random.Random(3)
    docs = list(enumerate(variants(rng, [f"w{i}" for i in range(90)], 2000, 7)))
    got = o.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    hashes = [o.shingle_sets([t.encode()], 5)[0] for _, t in docs]
    classes = o.Classes(range(len(docs)))
    for i, a in enumerate(hashes):
        both = o.np.array([o.np.count_nonzero(o.np.isin(b, a, assume_unique=True)) if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) else 0 for b in hashes[:i]])
        for j in o.np.flatnonzero(100 * both >= 80 * (len(a) + o.np.array([len(b) for b in hashes[:i]]) - both)) if i else ():
            if classes.label[i] != classes.label[j]:
                classes.join(i, j)
    least = {}
    for i, c in enumerate(classes.label):
        least.setdefault(c, i)
    assert 1 < len(least) < 2000
    same([r.asDict() for r in got], [(i, least[c]) for i, c in enumerate(classes.label)], ["doc_id", "component_id"])


def test_sizes_drop_no_link():
    import numpy as np

    from sluice.llm import op9_jaccard as o

    rng = np.random.default_rng(6)
    for _ in range(200):
        n = rng.integers(1, 30)
        sizes, labels = np.sort(rng.integers(1, rng.choice([5, 60, 500]), n)), rng.integers(0, rng.choice([1, 3, 30]), n)
        want = [any(labels[i] != labels[j] and 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j]) for j in range(n)) for i in range(n)]
        assert o.near_in_size(sizes, labels, 80).tolist() == want


def test_signature_trees_lose_no_link():
    import numpy as np

    from sluice.llm import op9_jaccard as o

    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, rng.integers(3, 300), dtype=np.uint64)
        for _ in range(4):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.03, 0.3])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 5), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    n = len(sets)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if 100 * (x := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - x)}
    true = o.Classes(range(n))
    for i, j in want:
        if true.label[i] != true.label[j]:
            true.join(i, j)
    for times, verify, sides in ((2, None, None), (8, lambda i, j: o.linked(sets[i], sets[j], 80), None), (8, None, [1 + i % 2 for i in range(n)])):
        classes, tried = o.Classes(range(n)), []
        check = lambda i, j: tried.append((i, j)) or verify is None or verify(i, j)  # noqa: B023, E731
        got = o.block_links([len(s) for s in sets], [o.bitmap(s, times) for s in sets], sides or [0] * n, classes, np.arange(n), 80, check)
        assert want and len(got) < n and len(tried) < n * (n - 1) // 8
        assert all(classes.label[i] == classes.label[j] for i, j in want if not sides or sides[i] != sides[j])
        if verify:
            assert {tuple(sorted(np.flatnonzero(classes.label == c))) for c in set(classes.label)} == {tuple(sorted(np.flatnonzero(true.label == c))) for c in set(true.label)}
            assert all((min(p), max(p)) in want for p in got)


def test_op10_counts(spark, folder, documents):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(d, len((t or "").encode()), n := len(exact.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in documents]
    same(rows(spark, "op10_token_counts", folder), want, ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def test_op10_query_keeps_its_cache(spark, folder, tmp_path):
    from sluice.llm import op10_tokens as o

    spark.conf.set("spark.sluice.tokenCache", str(tmp_path / "kept"))
    try:
        first = rows(spark, "op10_token_counts", folder)
        held = spark.read.parquet(str(tmp_path / "kept")).count()
        assert sorted(map(str, rows(spark, "op10_token_counts", folder))) == sorted(map(str, first))
        assert spark.read.parquet(str(tmp_path / "kept")).count() == held > 0
    finally:
        spark.conf.unset("spark.sluice.tokenCache")
    assert o.cache_folder(spark) == o.cache_folder(spark)


def test_op10_cache_encodes_only_misses(spark, tmp_path):
    from sluice.llm.op10_tokens import count_tokens

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in count_tokens(first, path, cache).collect()) == [1, 2, 2]
    assert spark.read.parquet(cache).count() == 2
    second = spark.createDataFrame([(1, "a b"), (4, "d e f")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in count_tokens(second, path, cache).collect()) == [2, 3]
    assert spark.read.parquet(cache).count() == 3
    other = public_tokenizers.path("piece_bpe_32k.model")
    assert sorted(r.n_tokens for r in count_tokens(second, other, cache).collect())[0] > 0 and spark.read.parquet(cache).count() == 5


def test_op10_reads_its_digests_partitions_and_merges_files(spark, tmp_path):
    import hashlib

    from sluice.llm import bpe
    from sluice.llm import op10_tokens as o

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "a cache")  # names of files come percent-encoded
    version, exact = bpe.version(path), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda texts, **k: {r.doc_id: r.n_tokens for r in o.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, cache, **k).collect()}
    want = lambda texts: {i: len(exact.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    prefixes = lambda texts: {hashlib.sha256(t.encode()).digest()[0] % o.PREFIXES for t in texts}
    texts = [f"text number {i} of {i * i}" for i in range(150)]
    assert count(texts) == want(texts)
    files = lambda: [int(x.rsplit("/prefix=", 1)[1].split("/")[0]) for x in o.stored(spark, cache, version).inputFiles()]
    assert set(files()) == prefixes(texts)
    scan = plan = o.stored(spark, cache, version, sorted(prefixes(texts[:3])))._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().head()
    plan.executeCollect()  # a run of three texts opens three partitions at most
    assert scan.metrics().apply("numPartitions").value() == len(prefixes(texts[:3]))

    held = next(iter(prefixes(texts[:1])))
    same_prefix = [t for i in range(3000) if prefixes([t := f"later {i}"]) == {held}][:6]
    for t in same_prefix:  # a small file a run
        assert count([t, texts[0]], merge=3) == want([t, texts[0]])
        assert files().count(held) <= 4
    before = sorted(map(tuple, o.stored(spark, cache, version).collect()))
    assert len(before) == len(set(before)) == 156
    o._append(o.stored(spark, cache, version, [held]), cache, version)  # a merge that was cut short before it deleted
    assert count(same_prefix + texts) == want(same_prefix + texts)
    assert o.merge_files(spark, cache, version, 1) and o.merge_files(spark, cache, version, 1) == 0
    assert sorted(map(tuple, o.stored(spark, cache, version).collect())) == before


def test_op3_samples(spark, folder, documents):
    import sentencepiece

    from sluice.llm import op3_pieces as o

    path = public_tokenizers.path(o.MODEL)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = o.sample(docs, path, with_ids=True).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {}
    for d, t in documents:
        texts.setdefault(d, set()).add(zlib.crc32((t or "").replace("\u2581", " ").encode()))
    for r in got:
        assert r.text_crc32 in texts[r.doc_id] and r.n_pieces == len(r.ids) and 0 <= r.inclusion <= 1
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.text_crc32, r.sample), set()).add((tuple(r.ids), r.perturbed))
    assert all(len(x) == 1 for x in by.values())  # equal rows draw the same
    for (d, t, n), x in by.items():
        if n == 2:
            (a, p), (b, q) = next(iter(by[d, t, 1])), next(iter(x))
            assert a != b and p >= q
    assert {r.n_pieces for r in got if r.doc_id in (400, 401)} == {0}
    again = o.sample(docs.repartition(5), path, with_ids=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    ids = o.encode(docs, path)
    plain = {(r.doc_id, tuple(r.ids)) for r in ids.collect()}
    assert plain == {(d, tuple(model.encode(t or ""))) for d, t in documents}
    back = {(r.doc_id, r.text) for r in o.decode(ids, path).collect()}
    assert back == {(d, (t or "").replace("\u2581", " ")) for d, t in documents}


def test_op3_long_text_without_spaces(spark, monkeypatch):
    """One unit of many characters, units that are laid out again, and thresholds that don't depend on a state's number."""
    from sluice.llm import op3_pieces as o

    path = public_tokenizers.path(o.MODEL)
    docs = spark.createDataFrame([(1, "abcdefgh" * 12_000), (2, "the abcdefgh"), (3, "  two  spaces "), (4, "the abcdefgh the")], "doc_id long, text string")
    got = {(r.doc_id, r.sample): r for r in o.sample(docs, path, with_ids=True).collect()}
    assert len(got) == 8 and got[1, 1].text_crc32 == zlib.crc32(b"abcdefgh" * 12_000)
    monkeypatch.setattr(o, "KEPT", 0)
    monkeypatch.setattr(o, "LAID_OUT", 1)
    assert {(r.doc_id, r.sample): r for r in o.sample(docs.coalesce(1), path, with_ids=True).collect()} == got
    lattice = o.load(path)
    alone, late = o.Table(lattice, ["the end"]), o.Table(lattice, ["some other words come before", "the end"])
    u, v = alone.words[0][1], late.words[1][1]
    span = lambda t, w: slice(t.first[t.base[w]], t.first[t.stop[w]])
    assert (alone.cum[span(alone, u)] == late.cum[span(late, v)]).all() and (alone.logs[span(alone, u)] == late.logs[span(late, v)]).all()
    units = o.Units()
    for text in ("▁a▁b", "a▁b", "▁▁a▁", "", "▁", "a▁▁▁b▁c"):
        units.numbers(text)
        assert [o.unit_of(list(units)[i]) for i in units.numbers(text)] == o.UNITS.findall(text)


def test_op3_distribution():
    import numpy as np

    from sluice.llm import op3_pieces as o

    lattice = o.load(public_tokenizers.path(o.MODEL))
    m = lattice.model
    weight = {m.id_to_piece(i): (i, -math.log(2 - m.get_score(i))) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}

    def every(word):
        if not word:
            return [((), 0.0)]
        return [((weight[word[:j]][0], *r), weight[word[:j]][1] + x) for j in range(1, len(word) + 1) if word[:j] in weight for r, x in every(word[j:])]

    t = o.Table(lattice, ["ab the"])
    first, second = (every(u) for u in o.UNITS.findall(m.normalize("ab the")))
    p = {a + b: math.exp(x + y) for a, x in first for b, y in second}
    z = sum(p.values())
    n, seen, weighed = 4000, Counter(), Counter()
    for found, kappa in o.top_k(t, [t.words[0]] * n, 3, [int(x) for x in np.random.default_rng(8).integers(0, 1 << 63, n)]):
        ids = [tuple(t.ids(arcs).tolist()) for arcs, _, _ in found]
        assert len(set(ids)) == 3 and all(abs(math.exp(x) - p[i] / z) < 1e-9 for i, (_, x, _) in zip(ids, found, strict=True))
        seen[ids[0]] += 1
        for i, (_, x, _) in zip(ids, found, strict=True):
            weighed[i] += 1 / o.inclusion(x, kappa)
    for i, q in sorted(p.items(), key=lambda x: -x[1])[:2]:
        assert abs(seen[i] / n - q / z) < 0.03
    assert abs(sum(weighed[i] / n * p[i] / z for i in p) - 1) < 0.01
    short = o.Table(lattice, ["a"])
    [(found, kappa)] = o.top_k(short, short.words, 50, [1])
    assert len(found) < 50 and kappa == -math.inf and abs(sum(math.exp(x) for _, x, _ in found) - 1) < 1e-9
