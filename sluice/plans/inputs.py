"""What the queries run on: documents, Markdown, tables, people and mentions derived from the tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import words

BASE_URL = "https://"
NL = "\n"

# DuckDB: classes of RE2 for Unicode white space and word characters
S = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
S_IN = r"\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column() -> Column:
    """The text below front matter, in mixed case and with odd white space."""
    return F.concat(F.lit("---\ntitle: x\n---\n\n \u00a0"), F.upper("source"), F.lit("\t\u2003\n"), F.coalesce("text", F.lit("")), F.lit(" \u00a0"))


TEXT_SQL = "('---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || chr(10) || ' ' || chr(160) || upper(source) || chr(9) || chr(8195) || chr(10) || coalesce(text, '') || ' ' || chr(160))"


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source_file, raw: front matter, headings of levels 1 to 3, page markers in every third file, tables in every fifth."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    every = lambda x, i, n, what: F.when((i + 1) % n == 0, what).otherwise(F.lit(""))
    line = lambda x, i: F.concat(
        F.when(F.col("doc_id") % 3 == 0, every(x, i, 6, F.concat(F.lit("<!-- page: "), F.floor((i + 1) / 6).cast("string"), F.lit(" -->\n")))).otherwise(F.lit("")),
        every(x, i, 4, F.concat(F.lit("### part "), (i + 1).cast("string"), F.lit("\n"))),
        x,
        F.lit("\n"),
    )
    rows = F.array_join(F.transform(words(F.col("text")), lambda w, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), w, F.lit(" |"))), "\n")
    raw = F.concat(
        F.format_string('---\ntitle: "%s"\nsource_type: html\n---\n\n# %s\n\n## %s\n\n', F.col("doc_id").cast("string"), "source", "lang"),
        F.array_join(F.transform(F.split("text", "\n"), line), "\n"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\n| n | word |\n| --- | --- |\n"), rows, F.lit("\n"))).otherwise(F.lit("")),
    )
    place = F.concat(F.lit("data/"), F.when(F.col("doc_id") % 4 == 0, "pdfs/").otherwise("pages/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select("doc_id", place.alias("source_file"), raw.alias("raw"))


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{S}+'), lambda w: w <> '')"


def sql_collapse(x: str) -> str:
    return f"array_to_string({sql_words(x)}, ' ')"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\A{S}+', ''), '{S}+\\z', '')"


def sql_front(x: str) -> str:
    return f"regexp_replace({x}, '(?s)\\A---{S}*\\n.*?\\n---{S}*\\n', '')"


MD_SQL = f"""
md AS (
  SELECT doc_id, 'data/' || CASE WHEN doc_id % 4 = 0 THEN 'pdfs/' ELSE 'pages/' END || source || '/doc_' || doc_id || '.md' AS source_file,
    '---' || chr(10) || 'title: "' || doc_id || '"' || chr(10) || 'source_type: html' || chr(10) || '---' || chr(10) || chr(10)
    || '# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10)
    || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i:
         CASE WHEN doc_id % 3 = 0 AND i % 6 = 0 THEN '<!-- page: ' || (i // 6) || ' -->' || chr(10) ELSE '' END
         || CASE WHEN i % 4 = 0 THEN '### part ' || i || chr(10) ELSE '' END || x || chr(10)), chr(10))
    || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '| n | word |' || chr(10) || '| --- | --- |' || chr(10)
         || array_to_string(list_transform({sql_words("coalesce(text, '')")}, lambda w, i: '| ' || i || ' | ' || w || ' |'), chr(10)) || chr(10) ELSE '' END AS raw
  FROM documents)"""

LINES_SQL = f"""
body AS (SELECT source_file, raw, {sql_front("raw")} AS body FROM md),
ls AS (SELECT source_file, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT source_file, string_split(body, chr(10)) AS l FROM body)),
f AS (
  SELECT source_file, line_no, line, length(regexp_extract(line, '\\A(#{{1,6}}){S}+(.+)$', 1)) AS level,
    {sql_strip(f"regexp_extract(line, '" + chr(92) + f"A(#{{1,6}}){S}+(.+)$', 2)")} AS title,
    regexp_matches(line, '\\A{S}*\\|') AS tabular, NOT regexp_matches(line, '[^{S_IN}]') AS blank, len({sql_words("line")}) AS words
  FROM ls),
s AS (
  SELECT *, sum(CASE WHEN level IN (1, 2) OR tabular <> before THEN 1 ELSE 0 END) OVER (PARTITION BY source_file ORDER BY line_no) AS seg
  FROM (SELECT *, lag(tabular, 1, false) OVER (PARTITION BY source_file ORDER BY line_no) AS before FROM f))"""

SEGMENTS_SQL = f"""{LINES_SQL},
t AS (SELECT source_file, seg, min(line_no) AS head, sum(words) AS total, bool_or(tabular) AS tabular FROM s GROUP BY ALL),
w AS (SELECT s.*, t.head FROM s JOIN t USING (source_file, seg) WHERE t.total > 600 AND NOT t.tabular),
fold AS (
  SELECT source_file, seg, line_no, words AS acc, 0 AS grp, false AS gone FROM w WHERE line_no = head
  UNION ALL
  SELECT w.source_file, w.seg, w.line_no,
    CASE WHEN w.level = 3 AND fold.acc > 600 THEN w.words WHEN w.level = 0 AND w.blank AND fold.acc > 700 THEN 0 ELSE fold.acc + w.words END,
    fold.grp + CASE WHEN w.level = 3 AND fold.acc > 600 THEN 1 WHEN w.level = 0 AND w.blank AND fold.acc > 700 THEN 1 ELSE 0 END,
    w.level = 0 AND w.blank AND fold.acc > 700
  FROM fold JOIN w ON w.source_file = fold.source_file AND w.seg = fold.seg AND w.line_no = fold.line_no + 1),
g AS (
  SELECT s.source_file, s.seg, coalesce(fold.grp, 0) AS grp, s.line_no, s.line, s.tabular
  FROM s LEFT JOIN fold ON s.source_file = fold.source_file AND s.seg = fold.seg AND s.line_no = fold.line_no WHERE NOT coalesce(fold.gone, false)),
c AS (
  SELECT source_file, seg, grp, bool_or(tabular) AS tabular, list(line ORDER BY line_no) AS l, min(line_no) AS start_line, max(line_no) AS end_line FROM g GROUP BY ALL),
q AS (
  SELECT c.source_file, c.start_line, {", ".join(f"coalesce(max(f.line_no) FILTER (f.level = {n}), -1) AS q{n}, arg_max(f.title, f.line_no) FILTER (f.level = {n}) AS t{n}" for n in range(1, 7))}
  FROM c LEFT JOIN f ON f.source_file = c.source_file AND f.level > 0 AND f.line_no <= c.end_line GROUP BY ALL),
h AS (
  SELECT source_file, start_line, list_filter([{", ".join(f"CASE WHEN q{n} > {'greatest(' + ', '.join(f'q{m}' for m in range(1, n)) + ')' if n > 2 else 'q1' if n == 2 else '-1'} THEN t{n} END" for n in range(1, 7))}], lambda x: x IS NOT NULL) AS hierarchy FROM q),
p AS (
  SELECT c.*, h.hierarchy, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '\\A{S}*\\|[{S_IN}\\-:]+\\|')), true), 0) AS sep FROM c JOIN h USING (source_file, start_line)),
u AS (
  SELECT *, CASE WHEN NOT tabular OR len(l) <= 3 OR sep = 0 OR sep = len(l) THEN [l]
    ELSE list_transform(range((len(l) - sep + 49) // 50), lambda k: list_concat(l[1:sep], l[sep + k * 50 + 1:least(len(l), sep + (k + 1) * 50)])) END AS split FROM p),
pieces AS (
  SELECT source_file, start_line AS seq, unnest(range(len(split))) + 1 AS part, len(split) AS parts, tabular, unnest(split) AS rows, start_line, end_line, hierarchy FROM u)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all kinds of parts: those with a red name are courses; two share an alias."""
    names = table(spark, sf_dir, "part").filter("p_name is not null").groupBy("p_name").agg(F.min("p_partkey").alias("load_seq"))
    kind = F.when(F.col("p_name").startswith("red"), "course").otherwise("faculty")
    name = F.concat(F.lit("Dr. "), F.initcap("p_name"))
    return names.select(F.concat(kind, F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("id"), name.alias("name"), F.array(F.col("p_name"), F.concat(F.lit("Prof."), F.element_at(F.split("p_name", " "), -1), F.lit(" x"))).alias("aliases"), kind.alias("type"), F.lit("").alias("url"), "load_seq")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, text that names a person, a third of them with a letter less and a third with a letter more."""
    p = table(spark, sf_dir, "part").filter("p_name is not null")
    name = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.substring("p_name", 1, 2), F.substr("p_name", F.lit(4)))).when(F.col("p_partkey") % 3 == 2, F.concat(F.col("p_name"), F.lit("e"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", F.concat(F.lit("A Talk  by Dr."), name).alias("text"))


def sql_entity(x: str) -> str:
    out = f"lower(coalesce({x}, ''))"
    for t in ("dr", "prof", "mr", "ms", "mrs"):
        out = f"regexp_replace({out}, '{t}\\.?{S}*', '{t} ', 'g')"
    return sql_collapse(f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_{S_IN}]', '', 'g')")


PEOPLE_SQL = f"""
people AS (
  SELECT CASE WHEN starts_with(p_name, 'red') THEN 'course' ELSE 'faculty' END || '_' || replace(p_name, ' ', '_') AS id,
    'Dr. ' || p_name AS name, [p_name, 'Prof.' || string_split(p_name, ' ')[-1] || ' x'] AS aliases,
    CASE WHEN starts_with(p_name, 'red') THEN 'course' ELSE 'faculty' END AS type, min(p_partkey) AS load_seq FROM part WHERE p_name IS NOT NULL GROUP BY p_name),
keys AS (
  SELECT {sql_entity("name")} AS norm, id, type, load_seq, 0 AS n FROM people
  UNION ALL SELECT {sql_entity("a")}, id, type, load_seq, n FROM (SELECT id, type, load_seq, unnest(aliases) AS a, unnest(range(1, len(aliases) + 1)) AS n FROM people)),
lookup AS (SELECT norm, arg_max(id, load_seq * 1000 + n) AS entity_id, bool_or(type = 'faculty') AS is_faculty FROM keys GROUP BY norm),
talks AS (
  SELECT p_partkey, 'A Talk  by Dr.' || CASE WHEN p_partkey % 3 = 1 THEN p_name[1:2] || p_name[4:] WHEN p_partkey % 3 = 2 THEN p_name || 'e' ELSE p_name END AS text FROM part WHERE p_name IS NOT NULL),
norms AS (SELECT p_partkey, {sql_entity("text")} AS norm FROM talks),
spoken AS (SELECT p_partkey, unnest(regexp_extract_all(norm, '(?:dr|prof|mr|ms|mrs){S}+[a-z]+(?:{S}+[a-z]+){{1,3}}')) AS mention FROM norms)"""
