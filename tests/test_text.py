import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sluice.functions import text as T
from sluice.functions import urls as U


def values(spark, rows, column, name="x"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"{name} string").select(column(F.col(name))).collect()]


def test_normalization_and_hash(spark):
    rows = ["---\ntitle: Test\n---\n\n# Hello", "HELLO World", "hello    world\n\n\ntest", "a  b\x1cc \x85", "", "---\nno end"]
    assert values(spark, rows, T.normalize_for_hash) == ["# hello", "hello world", "hello world test", "a b c", "", "--- no end"]
    got = values(spark, ["Hello World", "hello  world", "other"], T.content_hash)
    assert got[0] == got[1] == hashlib.sha256(b"hello world").hexdigest() != got[2]


def test_slug_and_ids(spark):
    assert values(spark, ["Hello World", "Hello! World?", "!!!", "a - b_c", "_x_"], T.slugify) == ["hello_world", "hello_world", "", "a_b_c", "x"]
    assert values(spark, ["a very long title"], lambda c: T.slugify(c, 10)) == ["a_very_lon"]
    row = spark.range(1).select(
        T.chunk_id(F.lit("html"), F.lit("faculty"), F.array(F.lit("CSE"), F.lit("Faculty")), F.lit("abc123def456")).alias("a"),
        T.chunk_id(F.lit("pdf"), F.lit("x"), F.array().cast("array<string>"), F.lit("abc123def456")).alias("b"),
        T.chunk_id(F.lit("pdf"), F.lit("x"), F.array(F.lit("A"), F.lit("B"), F.lit("!")), F.lit("abc123def456")).alias("c"),
        T.chunk_id(F.lit("pdf"), F.lit("x"), F.array(F.lit("?"), F.lit("!")), F.lit("abc123def456")).alias("d"),
    ).first()
    assert tuple(row) == ("html_faculty_cse_faculty_abc123de", "pdf_x_root_abc123de", "pdf_x_b_abc123de", "pdf_x__abc123de")


def test_frontmatter_and_words(spark):
    assert values(spark, ["---\na: 1\nb: 2\n---\n\nBody\n", "Body"], T.remove_frontmatter) == ["Body\n", "Body"]
    assert values(spark, ["Hello world", "", "  a b\x1fc ", None], T.word_count) == [2, 0, 3, 0]


def test_entity_names(spark):
    rows = ["Dr. JOHN DOE", "Dr.John", "Dr John", "Prof.Smith", "Dr.  John   Doe", "Dr. John's (PhD)", "professor", "address", "Mrs. X", None, "x²"]
    assert values(spark, rows, T.normalize_entity) == ["dr john doe", "dr john", "dr john", "prof smith", "dr john doe", "dr johns phd", "prof essor", "addr ess", "mr s x", "", "x²"]
    assert values(spark, ["Mrs. X", "Dr. A B", "A B"], lambda c: F.array_join(T.aliases(c), "|")) == ["Mrs. X|s. X", "Dr. A B|A B", "A B"]
    assert values(spark, ["Dr. A  B's"], T.entity_id) == ["faculty_dr_a_bs"]


def test_edit_distance(spark):
    rows = spark.createDataFrame([("hello", "hello"), ("hello", "hallo"), ("hello", "helo"), ("abc", "xyz")], "a string, b string")
    assert [r[0] for r in rows.select(T.edit_distance(F.col("a"), F.col("b"))).collect()] == [0, 1, 1, 3]


def test_urls(spark):
    rows = ["https://a.example/x/", "https://a.example/x", "HTTPS://a.example/x;p?q=1#top", "mailto:x", "https://a.example"]
    assert values(spark, rows, U.normalize) == ["https://a.example/x", "https://a.example/x", "https://a.example/x?q=1", "mailto://x", "https://a.example"]
    assert values(spark, ["a.pdf", "a.PDF", "a.html"], U.is_pdf) == [True, True, False]
    assert values(spark, ["https://a.example/in/1", "https://a.example/in/x.JPG", "https://b.example/in/1", "https://a.example/out"], lambda c: U.is_valid(c, "https://a.example", ("/in/",), (r"\.(jpg|png)$",))) == [True, False, False, False]
    names = values(spark, ["https://a.example/", "https://a.example/departments/cs/", "https://a.example/faculty/x.md"], U.markdown_filename)
    assert names[0] == "index.md" and names[2] == "faculty_x.md" and re.fullmatch(r"cs_[0-9a-f]{6}\.md", names[1])
    assert values(spark, ["https://a.example/x/y.pdf"], U.pdf_filename) == ["y.pdf"]


def test_links(spark):
    page = '<a href="/x/">1</a><a class=k href=\'y?a=1&amp;b=2#f\'>2</a><a name=z>3</a><a href="https://b.example/">4</a><a href="/x">5</a>'
    got = spark.createDataFrame([(page, "https://a.example/d/"), ("", "https://a.example")], "h string, u string").select(U.links(F.col("h"), F.col("u"))).collect()
    assert got[0][0] == ["https://a.example/d/y?a=1&b=2", "https://a.example/x", "https://b.example"] and got[1][0] == []


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 100_000, "x " * 100_000])
def test_long_texts(spark, text):
    assert values(spark, [text], T.word_count) == [len(text.split())]
    assert values(spark, [text], T.normalize_for_hash) == [" ".join(text.split())]
