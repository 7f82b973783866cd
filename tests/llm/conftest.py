import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in for with on at by from this that tion ing ered an ble".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def make_documents():
    """Small documents of every kind that the operators must stand: (doc_id, text)."""
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(5, 200)) for _ in range(30)]
    passage = sentence(rng, 70)
    docs = list(enumerate(base))
    docs += [(100 + i, f"{sentence(rng, rng.randint(0, 60))} {passage} {sentence(rng, rng.randint(0, 60))}") for i in range(12)]
    near = sentence(rng, 150).split()
    for i in range(14):  # near copies
        words = list(near)
        words[rng.randrange(150)] = f"changed{i}"
        docs.append((200 + i, " ".join(words)))
    docs += [(300 + i, base[3]) for i in range(8)]  # copies
    docs += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "ONE"), (405, "a b c"), (406, "A  b\nC"), (407, "x " * 300), (408, "y" * 5000)]
    docs += [(409, "日本語 текст ünï \x1c\xa0 <|endoftext|>  end"), (410, "line one here\nline one here\nother\n\n\nline one here"), (411, "a\u2581b \u2581 c"), (412, "nul\0byte\0")]
    docs += [(413, "Released under the MIT License. mit\nlicense; Apache License, Version 2.0 and GNU General Public License v3"), (414, "SPDX-License-Identifier: BSD-3-Clause")]
    docs += [(5, base[5]), (5, base[5]), (6, "another text of id six " + passage), (None, passage + " tail"), (None, base[7]), (None, None)]  # repeated rows, ids, null ids
    docs += [(500, sentence(rng, 3000))]
    return docs


PAGES = [
    (0, "https://a.example.com/en/1", "<html><nav>n</nav><article><h1>T &amp; t</h1><p>one<p>two<br>x</article><footer>f</footer>"),
    (1, "https://A.example.com/en/7?x#y", "<html><nav>m</nav><article><h1>U</h1><p>three</p></article><footer>g</footer></html>"),
    (2, "http://casino-win.example.org/fr/1", "<p>a < b &lt; c</p><script>if (a<b) x('</p>')</script><div class='cookie-notice'>c</div>"),
    (3, "http://www.casino-win.example.org/es/2", ""),
    (4, None, None),
    (5, "no scheme", "<div class=sidebar>s</div><main><header><h2>H</h2></header>text<div id='comments'>c</div></main>"),
    (6, "x://", "plain"),
    (6, "https://shop.example.net/de/8", "<table><tr><td>a</td><td>b</td></tr></table><!-- c --> d"),
    (None, "https://x.com/en/", "<p>" + "w " * 5000),
    (7, "a://b://c/en/", "<a href='1'>x"),
    (8, "https://com/en/x", "<p" + "<" * 2000),
]


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """A folder of tables with clashing columns besides their own."""
    path = str(tmp_path_factory.mktemp("tables"))
    extra = {c: F.lit(7) for c in ("row", "digest", "key", "n_words", "hash", "spans", "sequence_id", "component_id", "host", "region", "score", "kind")}
    docs = make_documents()
    spark.createDataFrame(docs, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), **extra}).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1 if i % 4 else 0, 0) for i in range(30)] + [(407, 0, 1), (9999, 1, 0), (None, 1, 0), (3, 1, 0), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns(extra).repartition(2).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.fixture(scope="session")
def documents():
    return make_documents()
