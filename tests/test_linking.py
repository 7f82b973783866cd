"""Entity links against brute force: edit distances, registries of every size, very long words."""

import random

import pytest

from sluice.operators import entities, visited


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def edited(rng, text, n):
    for _ in range(n):
        at, kind = rng.randrange(len(text) + 1), rng.randrange(3)
        text = text[:at] + rng.choice("abdr ") + text[at + (kind == 0) :] if kind < 2 else text[: max(at - 1, 0)] + text[at:]
    return text


@pytest.fixture(scope="module")
def registry(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    names = {rng.choice(["", "dr ", "prof ", "mr ", "ms ", "mrs "]) + " ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(150)} | {"", "a", "ab", "dr a", "mrs"}
    rows = [(n, f"e{i}", rng.random() < 0.8) for i, n in enumerate(sorted(names))]
    return rows, spark.createDataFrame(rows, "norm string, entity_id string, is_faculty boolean").coalesce(2)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_fuzzy_equals_brute_force(spark, registry, k):
    rows, found = registry
    rng = random.Random(k)
    said = {edited(rng, rng.choice(rows)[0], rng.randint(0, k + 1)) for _ in range(250)} | {"", "b", "dr", "dr " + "x" * 100_000 + " y"}
    want = {}
    for m in said:
        near = [(distance(m, n), n, e) for n, e, faculty in rows if faculty and abs(len(n) - len(m)) <= k and distance(m, n) <= k]
        if near:
            want[m] = min(near)[2]
    got = entities.fuzzy(spark.createDataFrame([(m,) for m in sorted(said)], "norm string"), found, most=k)
    assert {r.norm: r.entity_id for r in got.collect()} == want and len(want) > 50


def test_long_words_cost_nothing(spark):
    found = spark.createDataFrame([("dr john doe", "j", True)], "norm string, entity_id string, is_faculty boolean")
    rows = spark.createDataFrame([(0, "Dr. " + "x" * 100_000 + " doe"), (1, "it was Dr. Jon Doe"), (2, None), (3, "")], "k int, t string")
    assert {r.k: r.entity_refs for r in entities.entity_refs(rows, found, "t").collect()} == {0: [], 1: ["j"], 2: [], 3: []}


def linked(rows, texts):
    return {(i, e) for i, t in enumerate(texts) if t is not None for n, e, _ in rows if n in t}


def test_large_registries_are_joined(spark, registry, monkeypatch):
    rows, found = registry
    rng = random.Random(8)
    texts = [" ".join(rng.choice(rows)[0] for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "\U0001f600" * 9, "x" * 100_000]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = linked(rows, texts)
    assert {tuple(r) for r in entities.contained(table, found, "k", "t").collect()} == want
    monkeypatch.setattr(entities, "LETTERS", 10)
    monkeypatch.setattr(visited, "FEW", 10)
    got = entities.contained(table, found, "k", "t").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    refs = {r.k: r.entity_refs for r in entities.entity_refs(table, found, "t").collect()}
    monkeypatch.undo()
    one = {r.k: r.entity_refs for r in entities.entity_refs(table, found, "t").collect()}
    assert refs == one and len(one) == len(texts)
    monkeypatch.setattr(entities, "GUESSES", 0)
    assert {r.k: r.entity_refs for r in entities.entity_refs(table, found, "t").collect()} == one


def test_texts_stay_where_they_are(spark, registry):
    _, found = registry
    out = entities.entity_refs(spark.createDataFrame([(1, "dr jon doe")], "k int, t string"), found, "t")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
