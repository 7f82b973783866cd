"""The engine's queries by name, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluice.conf import PROFILE_MARKERS, PROFILE_SECTIONS, ChunkConf, CrawlConf
from sluice.functions import classify as C
from sluice.functions import text as T
from sluice.functions import urls as U
from sluice.operators import chunks as K
from sluice.operators import crawl, dedup, entities, html, pdf, report, segment
from sluice.operators.shared import settled
from sluice.plans import inputs as I
from sluice.plans.inputs import S, S_IN, sql_collapse, sql_entity, sql_front, sql_strip, sql_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def fill(sql: str, **parts: str) -> str:
    """SQL with {name} replaced, and all other braces as they are."""
    for name, part in parts.items():
        sql = sql.replace("{" + name + "}", part)
    return sql


def _docs(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").withColumn("raw", I.text_column())


X = I.TEXT_SQL
HASHED = f"sha256({sql_collapse('lower(' + sql_front(X) + ')')})"


# --- text primitives --------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {sql_collapse('lower(' + sql_front(X) + ')')} AS norm FROM documents")
def norm_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_for_hash(F.col("raw")).alias("norm"))


@query(f"SELECT doc_id, {HASHED} AS hash FROM documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.content_hash(F.col("raw")).alias("hash"))


def _sql_slug(x: str, n: int) -> str:
    return f"substr(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_{S_IN}-]', '', 'g'), '[{S_IN}-]+', '_', 'g'), '\\A_+|_+\\z', '', 'g'), 1, {n})"


@query(f"SELECT doc_id, {_sql_slug('coalesce(text, chr(32))', 50)} AS slug, {_sql_slug('source || chr(45) || lang || chr(33)', 30)} AS short FROM documents")
def slugify(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.slugify(F.coalesce("text", F.lit(" "))).alias("slug"), T.slugify(F.concat("source", F.lit("-"), "lang", F.lit("!")), 30).alias("short"))


@query(
    f"SELECT doc_id, 'html_' || {_sql_slug('source', 30)} || '_' || CASE WHEN doc_id % 4 = 0 THEN 'root' ELSE {_sql_slug('CASE WHEN doc_id % 4 = 1 THEN lang WHEN doc_id % 4 = 2 THEN lang || chr(95) || source ELSE source || chr(95) || coalesce(text, chr(32)) END', 50)} END || '_' || substr({HASHED}, 1, 8) AS chunk_id FROM documents"
)
def chunk_id(spark, sf_dir):
    titles = F.array("lang", "source", F.coalesce("text", F.lit(" ")))
    return _docs(spark, sf_dir).select("doc_id", T.chunk_id(F.lit("html"), F.col("source"), F.slice(titles, F.lit(1), (F.col("doc_id") % 4).cast("int")), T.content_hash(F.col("raw"))).alias("chunk_id"))


@query(f"SELECT doc_id, md5({sql_front(X)}) AS body_md5, length({sql_front(X)}) AS n FROM documents")
def strip_frontmatter(spark, sf_dir):
    body = T.remove_frontmatter(F.col("raw"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(body).alias("body_md5"), F.length(body).cast("long").alias("n"))


@query(f"SELECT doc_id, len({sql_words(X)})::BIGINT AS n FROM documents")
def word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("raw")).cast("long").alias("n"))


NAME_SQL = "(CASE s_suppkey % 5 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'PROF.' WHEN 2 THEN 'Mrs.  ' WHEN 3 THEN 'Ms ' ELSE '' END || s_name || '''s (Professor)')"


def _names(spark, sf_dir):
    s = I.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 5
    title = F.when(k == 0, "Dr. ").when(k == 1, "PROF.").when(k == 2, "Mrs.  ").when(k == 3, "Ms ").otherwise("")
    return s.select("s_suppkey", F.concat(title, "s_name", F.lit("'s (Professor)")).alias("name"))


@query(f"SELECT s_suppkey, {sql_entity(NAME_SQL)} AS norm FROM supplier")
def norm_entity(spark, sf_dir):
    return _names(spark, sf_dir).select("s_suppkey", T.normalize_entity(F.col("name")).alias("norm"))


@query("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name)::BIGINT AS distance, levenshtein(a.p_name, b.p_name) <= 9 AS near FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edit_distance(spark, sf_dir):
    """Each part's name against the next one's."""
    n = I.table(spark, sf_dir, "part")
    pairs = n.select("p_partkey", F.col("p_name").alias("a")).join(n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    return pairs.select("p_partkey", T.edit_distance(F.col("a"), F.col("b")).cast("long").alias("distance"), (T.edit_distance(F.col("a"), F.col("b"), 9) >= 0).alias("near"))


BARE_SQL = f"regexp_replace({NAME_SQL}, '(?i)\\A(?:dr\\.?|prof\\.?|mr\\.?|ms\\.?|mrs\\.?){S}*', '')"


@query(f"SELECT s_suppkey, CASE WHEN {BARE_SQL} <> {NAME_SQL} THEN {NAME_SQL} || '|' || {sql_strip(BARE_SQL)} ELSE {NAME_SQL} END AS aliases FROM supplier")
def alias_gen(spark, sf_dir):
    return _names(spark, sf_dir).select("s_suppkey", F.array_join(T.aliases(F.col("name")), "|").alias("aliases"))


@query(f"SELECT s_suppkey, 'faculty_' || array_to_string({sql_words('regexp_replace(lower(' + NAME_SQL + '), ' + chr(39) + '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + S_IN + ']' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, '_') AS id FROM supplier")
def entity_slug(spark, sf_dir):
    return _names(spark, sf_dir).select("s_suppkey", T.entity_id(F.col("name")).alias("id"))


# --- URLs and pages ---------------------------------------------------------------------------------------------------

PATH_SQL = "regexp_replace(regexp_extract({u}, '\\A(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*\\z', '')"
NAME_OF = "replace(replace(regexp_replace(" + fill(PATH_SQL, u="url") + ", '\\A/+|/+\\z', '', 'g'), '/', '_'), 'departments_', '')"


@query(f"SELECT page_id, CASE WHEN regexp_replace({fill(PATH_SQL, u='url')}, '\\A/+|/+\\z', '', 'g') = '' THEN 'index.md' WHEN ends_with({NAME_OF}, '.md') THEN {NAME_OF} ELSE {NAME_OF} || '_' || md5(url)[1:6] || '.md' END AS markdown_name, CASE WHEN ends_with(string_split(u, '/')[-1], '.pdf') THEN string_split(u, '/')[-1] ELSE 'document_' || md5(u)[1:8] || '.pdf' END AS pdf_name FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN url || '.pdf' ELSE url END AS u FROM pages)")
def url_filename(spark, sf_dir):
    p = I.table(spark, sf_dir, "pages").withColumn("u", F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(".pdf"))).otherwise(F.col("url")))
    return p.select("page_id", U.markdown_filename(F.col("url")).alias("markdown_name"), U.pdf_filename(F.col("u")).alias("pdf_name"))


def sql_url(u: str) -> str:
    parts = f"regexp_extract({u}, '\\A(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?\\z', {{}})"
    return f"(lower({parts.format(1)}) || '://' || {parts.format(2)} || regexp_replace(regexp_replace({parts.format(3)}, ';[^/]*\\z', ''), '/+\\z', '') || CASE WHEN {parts.format(4)} <> '' THEN '?' || {parts.format(4)} ELSE '' END)"


@query(f"SELECT page_id, {sql_url('url')} AS normalized, {sql_url('url || chr(59) || chr(118)')} AS with_params FROM pages")
def url_normalize(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", U.normalize(F.col("url")).alias("normalized"), U.normalize(F.concat("url", F.lit(";v"))).alias("with_params"))


SITE = CrawlConf(base_url="https://", include=(r"^https://[^/]*\.example\.com/", r"/de/"), exclude=(r"/1\d*(/|$|\?)", r"\.(jpg|html)$"))
VALID_SQL = r"(starts_with({u}, 'https://') AND NOT regexp_matches({u}, '(?i)/1\d*(/|$|\?)') AND NOT regexp_matches({u}, '(?i)\.(jpg|html)$') AND (regexp_matches({u}, '(?i)^https://[^/]*\.example\.com/') OR regexp_matches({u}, '(?i)/de/')))"


@query(f"SELECT page_id, {fill(VALID_SQL, u='url')} AS valid FROM pages")
def url_filter(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", U.is_valid(F.col("url"), SITE.base_url, SITE.include, SITE.exclude).alias("valid"))


PDF_URL_SQL = "(url || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '/Syllabus.pdf' ELSE '' END)"


@query(f"SELECT page_id, ends_with(lower({PDF_URL_SQL}), '.pdf') AS is_pdf, ends_with(lower({PDF_URL_SQL}), '.pdf') AND ({fill(VALID_SQL, u=PDF_URL_SQL)} OR contains(lower({PDF_URL_SQL}), 'syllabus') OR contains(lower({PDF_URL_SQL}), 'regulation')) AS wanted FROM pages")
def pdf_filter(spark, sf_dir):
    k = F.col("page_id") % 4
    p = I.table(spark, sf_dir, "pages").withColumn("u", F.concat("url", F.when(k == 0, ".PDF").when(k == 1, "/Syllabus.pdf").otherwise("")))
    valid = U.is_valid(F.col("u"), SITE.base_url, SITE.include, SITE.exclude)
    return p.select("page_id", U.is_pdf(F.col("u")).alias("is_pdf"), U.wanted_pdf(F.col("u"), valid).alias("wanted"))


LINKS_SQL = f"""
anchors AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
found AS (SELECT DISTINCT page_id, {sql_url("regexp_extract(url, '" + chr(92) + "A[^/]*//[^/?#]*') || href")} AS link FROM anchors)"""


@query(f"WITH {LINKS_SQL} SELECT page_id, link FROM found")
def link_extract(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", F.explode(U.links(F.col("html"), F.col("url"))).alias("link"))


FACULTY_HTML = "replace(html, 'href=\"/', 'href=\"https://example.com/faculty/')"


@query(
    f"""WITH a AS (SELECT page_id, unnest(l) AS anchor, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all({FACULTY_HTML}, '(?is)<a\\s([^>]*?)href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a\\s*>', 0) AS l FROM pages)),
    b AS (SELECT page_id, pos, regexp_extract(anchor, 'href="([^"]*)"', 1) AS url, {sql_strip("regexp_extract(anchor, '>(.*?)</a', 1)")} AS name FROM a)
    SELECT page_id, name, url FROM b WHERE contains(url, '/faculty/') AND length(name) > 3 QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1"""
)
def faculty_links(spark, sf_dir):
    p = I.table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit('href="/'), F.lit('href="https://example.com/faculty/')))
    return crawl.faculty_links(p, "https://example.com", url="page_id").withColumnRenamed("page", "page_id")


def _linked(spark, sf_dir):
    """Pages in chains of seven: each links to the next one, to a PDF, and to itself."""
    p = I.table(spark, sf_dir, "pages").select("page_id")
    n = F.col("page_id")
    url = lambda x: F.concat(F.lit("https://site.example/p/"), x.cast("string"))
    anchor = lambda u: F.concat(F.lit('<a href="'), u, F.lit('">x</a>'))
    after = F.when((n + 1) % 7 != 0, anchor(url(n + 1))).otherwise(F.lit(""))
    return p.select(url(n).alias("url"), F.concat(after, anchor(F.concat(url(n), F.lit("/file.pdf"))), anchor(F.concat(url(n), F.lit("/#top")))).alias("html"))


@query(
    """WITH RECURSIVE roots AS (SELECT page_id FROM pages WHERE page_id % 7 = 0 OR page_id - 1 NOT IN (SELECT page_id FROM pages)),
    reach AS (SELECT page_id AS n, 0 AS depth FROM roots UNION SELECT n + 1, depth + 1 FROM reach JOIN pages ON page_id = n WHERE depth < 3 AND (n + 1) % 7 <> 0),
    first AS (SELECT n, min(depth) AS depth FROM reach GROUP BY n)
    SELECT 'https://site.example/p/' || n AS url, depth::BIGINT AS depth, 'page' AS kind FROM first
    UNION ALL SELECT 'https://site.example/p/' || n || '/file.pdf', depth + 1, 'pdf' FROM first JOIN pages ON page_id = n WHERE depth < 3"""
)
def crawl_bfs(spark, sf_dir):
    """From all pages that no other page links to."""
    pages = _linked(spark, sf_dir)
    graph = crawl.link_graph(pages).filter("url <> link")
    roots = pages.select("url").join(graph.select(F.col("link").alias("url")), "url", "left_anti")
    found = crawl.discover(pages, roots, CrawlConf(base_url="https://site.example", include=("/p/",), max_urls=2**62))
    return found.select("url", F.col("depth").cast("long").alias("depth"), "kind")


PLAIN = "array_to_string(list_transform(regexp_split_to_array({x}, '(?s)<[^>]*>'), lambda y: array_to_string(list_filter(regexp_split_to_array(y, '" + S + "+'), lambda w: w <> ''), ' ')), '')"


@query(
    f"""WITH h AS (SELECT page_id, url, CASE page_id % 3 WHEN 1 THEN replace(html, 'h1>', 'h4>') WHEN 2 THEN '' ELSE html END AS html FROM pages),
    t AS (SELECT page_id, {fill(PLAIN, x="regexp_extract(html, '(?is)<h1(?:" + chr(92) + "s[^>]*)?>(.*?)</h1" + chr(92) + "s*>', 1)")} AS a, {fill(PLAIN, x="regexp_extract(html, '(?is)<title(?:" + chr(92) + "s[^>]*)?>(.*?)</title" + chr(92) + "s*>', 1)")} AS b,
      regexp_replace(string_split(regexp_replace(regexp_extract(url, '\\A[^/]*//[^/?#]*([^?#]*)', 1), '/+\\z', ''), '/')[-1], '[-_]', ' ', 'g') AS c FROM h)
    SELECT page_id, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE upper(c[1]) || lower(c[2:]) END AS title FROM t"""
)
def html_title(spark, sf_dir):
    k = F.col("page_id") % 3
    p = I.table(spark, sf_dir, "pages").withColumn("html", F.when(k == 1, F.replace("html", F.lit("h1>"), F.lit("h4>"))).when(k == 2, "").otherwise(F.col("html")))
    return p.select("page_id", html.html_title(F.col("html"), F.col("url")).alias("title"))


def _sql_clean(x: str) -> str:
    for name in html.NOISE_TAGS:
        x = f"regexp_replace({x}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', '', 'g')"
    return f"regexp_replace({x}, '(?s)<!--.*?-->|<![^>]*>', '', 'g')"


@query(f"SELECT page_id, md5({_sql_clean('html')}) AS clean_md5, length({_sql_clean('html')}) AS n FROM pages")
def html_clean(spark, sf_dir):
    c = html.html_clean(F.col("html"))
    return I.table(spark, sf_dir, "pages").select("page_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("n"))


@query()
def html_to_markdown(spark, sf_dir):
    return html.scrape(I.table(spark, sf_dir, "pages"))


RAW_MD_SQL = "('#' || source || chr(10) || chr(10) || chr(10) || chr(10) || ' ' || chr(10) || chr(9) || chr(10) || replace(coalesce(text, ''), chr(10), '  ' || chr(10) || chr(10) || chr(10) || '##'))"


@query(
    f"""WITH a AS (SELECT doc_id, list_transform(string_split(regexp_replace({RAW_MD_SQL}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '{S}+\\z', '')) AS l FROM documents),
    b AS (SELECT doc_id, array_to_string(list_filter(l, lambda x, i: x <> '' OR (i > 1 AND l[i - 1] <> '')), chr(10)) AS t FROM a)
    SELECT doc_id, {sql_strip("regexp_replace(t, '(?m)^(#+)([^" + S_IN + "#])', '" + chr(92) + "1 " + chr(92) + "2', 'g')")} AS markdown FROM b"""
)
def clean_markdown(spark, sf_dir):
    raw = F.concat(F.lit("#"), "source", F.lit("\n\n\n\n \n\t\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("  \n\n\n##")))
    return I.table(spark, sf_dir, "documents").select("doc_id", html.clean_markdown(raw).alias("markdown"))


PERSON_SQL = "('<html><nav>Lecturer</nav><h1>Dr. <b>' || p_name || '</b></h1><p>' || CASE p_partkey % 4 WHEN 0 THEN 'Associate  Professor' WHEN 1 THEN 'Professor and Head CSE' WHEN 2 THEN 'lecturer' ELSE '' END || '</p>' || chr(10) || '<p>Qualification: ' || p_type || ', PhD </p>' || chr(10) || '<p>AICTE ID:-' || p_partkey || '-' || p_size || '</p></html>')"
PERSON_TEXT = f"array_to_string(regexp_split_to_array({_sql_clean(PERSON_SQL)}, '(?s)<[^>]*>'), '')"


def _sql_take(pattern: str) -> str:
    return sql_strip(f"regexp_extract({PERSON_TEXT}, '{pattern}', 1)")


@query(
    f"""SELECT p_partkey, 'Dr.' || p_name AS name,
    {_sql_take(f"(?i)(Professor{S}*(?:&amp;|&|and)?{S}*Head{S}*[" + chr(92) + "p{L}" + chr(92) + "p{N}_]*" + f"|Associate{S}*Professor|Assistant{S}*Professor|Professor|Lecturer)")} AS designation,
    {_sql_take(f"(?i)Qualification{S}*:?{S}*([^" + chr(92) + "n]+)")} AS qualification, {_sql_take(f"(?i)AICTE{S}*ID{S}*:?-?{S}*(" + chr(92) + "p{Nd}[" + chr(92) + "p{Nd}-]+)")} AS aicte_id FROM part"""
)
def faculty_profile(spark, sf_dir):
    k = F.col("p_partkey") % 4
    page = F.concat(F.lit("<html><nav>Lecturer</nav><h1>Dr. <b>"), "p_name", F.lit("</b></h1><p>"), F.when(k == 0, "Associate  Professor").when(k == 1, "Professor and Head CSE").when(k == 2, "lecturer").otherwise(""), F.lit("</p>\n<p>Qualification: "), "p_type", F.lit(", PhD </p>\n<p>AICTE ID:-"), F.col("p_partkey").cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit("</p></html>"))
    return I.table(spark, sf_dir, "part").select("p_partkey", html.profile(page, F.lit("")).alias("p")).select("p_partkey", "p.name", "p.designation", "p.qualification", "p.aicte_id")


# --- segmentation -----------------------------------------------------------------------------------------------------


def _bodies(spark, sf_dir):
    return I.markdown_docs(spark, sf_dir).select("source_file", T.remove_frontmatter(F.col("raw")).alias("body"))


WITH_LINES = f"WITH {I.MD_SQL}, {I.LINES_SQL}"
WITH_SEGMENTS = f"WITH RECURSIVE {I.MD_SQL}, {I.SEGMENTS_SQL}"


@query(f"{WITH_LINES} SELECT source_file, line_no, level, title FROM f WHERE level > 0")
def heading_detect(spark, sf_dir):
    return segment.lines(_bodies(spark, sf_dir), "source_file", "body").filter("level > 0").select("source_file", F.col("line_no").cast("long").alias("line_no"), F.col("level").cast("long").alias("level"), "title")


@query(f"{WITH_SEGMENTS} SELECT source_file, start_line, array_to_string(hierarchy, ' > ') AS hierarchy FROM h")
def heading_stack(spark, sf_dir):
    return segment.segments(_bodies(spark, sf_dir), "source_file", "body").filter("part = 1").select("source_file", F.col("start_line").cast("long").alias("start_line"), F.array_join("hierarchy", " > ").alias("hierarchy"))


@query(f"{WITH_LINES} SELECT source_file, min(line_no) AS first_line, max(line_no) AS last_line, sum(words)::BIGINT AS words FROM s GROUP BY source_file, seg")
def hard_segments(spark, sf_dir):
    rows = segment.hard_segments(segment.lines(_bodies(spark, sf_dir), "source_file", "body"), "source_file")
    return rows.groupBy("source_file", "seg").agg(F.min("line_no").cast("long").alias("first_line"), F.max("line_no").cast("long").alias("last_line"), F.sum("words").cast("long").alias("words")).drop("seg")


@query(f"{WITH_SEGMENTS} SELECT source_file, start_line, end_line, md5(array_to_string(l, chr(10))) AS text_md5 FROM c WHERE NOT tabular")
def soft_segments(spark, sf_dir):
    out = segment.segments(_bodies(spark, sf_dir), "source_file", "body").filter("not tabular")
    return out.select("source_file", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("text").alias("text_md5"))


@query(f"{WITH_LINES} SELECT source_file, min(line_no) AS first_line, count(*) AS n FROM s WHERE tabular GROUP BY source_file, seg")
def table_runs(spark, sf_dir):
    rows = segment.hard_segments(segment.lines(_bodies(spark, sf_dir), "source_file", "body"), "source_file").filter("tabular")
    return rows.groupBy("source_file", "seg").agg(F.min("line_no").cast("long").alias("first_line"), F.count("*").alias("n")).drop("seg")


@query(f"{WITH_SEGMENTS} SELECT source_file, seq, part, parts, len(rows) AS n, md5(array_to_string(rows, chr(10))) AS text_md5 FROM pieces WHERE tabular")
def table_split(spark, sf_dir):
    out = segment.segments(_bodies(spark, sf_dir), "source_file", "body").filter("tabular")
    return out.select("source_file", *(F.col(c).cast("long").alias(c) for c in ("seq", "part", "parts")), F.size(F.split("text", "\n")).cast("long").alias("n"), F.md5("text").alias("text_md5"))


@query(f"WITH {I.MD_SQL}, l AS (SELECT source_file, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT source_file, string_split(raw, chr(10)) AS x FROM md)) SELECT source_file, line_no, regexp_extract(line, '<!--{S}*page:{S}*(\\p{{Nd}}+){S}*-->', 1)::BIGINT AS page FROM l WHERE regexp_matches(line, '<!--{S}*page:{S}*(\\p{{Nd}}+){S}*-->')")
def page_markers(spark, sf_dir):
    out = I.markdown_docs(spark, sf_dir).select("source_file", F.explode(segment.page_markers(F.col("raw"))).alias("m"))
    return out.select("source_file", F.col("m.line_no").cast("long").alias("line_no"), F.col("m.page").cast("long").alias("page"))


def _stem(x: str) -> str:
    return f"regexp_replace(string_split({x}, '/')[-1], '\\.md$', '')"


TEXT_OF = sql_strip("array_to_string(rows, chr(10))")
CHUNKS_SQL = f"""{WITH_SEGMENTS},
marks AS (SELECT source_file, line_no, regexp_extract(line, '<!--{S}*page:{S}*(\\p{{Nd}}+){S}*-->', 1)::BIGINT AS page FROM (SELECT source_file, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT source_file, string_split(raw, chr(10)) AS x FROM md)) WHERE regexp_matches(line, '<!--{S}*page:{S}*(\\p{{Nd}}+){S}*-->')),
texts AS (SELECT * EXCLUDE (rows), {TEXT_OF} AS text FROM pieces),
counted AS (SELECT *, len({sql_words("text")}) AS word_count, sha256({sql_collapse("lower(text)")}) AS hash FROM texts WHERE text <> ''),
kept AS (SELECT * FROM counted WHERE tabular OR word_count >= 80),
paged AS (
  SELECT k.source_file, k.seq, k.part, min(m.page) FILTER (m.line_no > k.start_line AND m.line_no <= k.end_line) AS lo, max(m.page) FILTER (m.line_no > k.start_line AND m.line_no <= k.end_line) AS hi,
    nullif(arg_max(m.page, m.line_no) FILTER (m.line_no <= k.start_line), 0) AS cur FROM kept k LEFT JOIN marks m USING (source_file) GROUP BY ALL),
chunks AS (
  SELECT CASE WHEN contains(source_file, 'pdfs') THEN 'pdf' ELSE 'html' END AS source_type, k.*, CASE WHEN coalesce(lo, cur) IS NULL THEN NULL ELSE least(lo, cur) || '-' || greatest(hi, cur) END AS pages,
    CASE WHEN contains(source_file, 'pdfs') THEN 'pdf' ELSE 'html' END || '_' || {_sql_slug(_stem("source_file"), 30)} || '_' || CASE WHEN len(hierarchy) = 0 THEN 'root' ELSE {_sql_slug("array_to_string(hierarchy[-2:], '_')", 50)} END || '_' || hash[1:8] || CASE WHEN parts > 1 THEN '_part' || part ELSE '' END AS chunk_id
  FROM kept k JOIN paged USING (source_file, seq, part)),
ranked AS (SELECT *, row_number() OVER w AS rn, first_value(chunk_id) OVER w AS original_id FROM chunks WINDOW w AS (PARTITION BY hash ORDER BY string_split(source_file, '/'), seq, part))"""


def _chunks(spark, sf_dir, conf=ChunkConf(), seen=None):
    return K.build_chunks(I.markdown_docs(spark, sf_dir), conf=conf, seen=seen)


def _split(spark, sf_dir, *columns, seen=None):
    """Distinct chunks and duplicates with these columns, without texts; chunks are made once for both, and no others of their columns."""
    return dedup.split_duplicates(settled(_chunks(spark, sf_dir, seen=seen).select("chunk_id", "source_file", *columns, "hash", "seq", "part")))


@query(f"{CHUNKS_SQL} SELECT chunk_id, source_type, source_file, array_to_string(hierarchy, ' > ') AS hierarchy, pages, word_count, hash, md5(text) AS text_md5 FROM chunks")
def chunk_build(spark, sf_dir):
    pages = F.when(F.col("page_range").isNotNull(), F.concat_ws("-", F.col("page_range").cast("array<string>")))
    return _chunks(spark, sf_dir).select("chunk_id", "source_type", "source_file", F.array_join("section_hierarchy", " > ").alias("hierarchy"), pages.alias("pages"), F.col("word_count").cast("long").alias("word_count"), "hash", F.md5("text").alias("text_md5"))


@query(f"{CHUNKS_SQL} SELECT source_file, seq, part, pages FROM chunks WHERE pages IS NOT NULL")
def page_range(spark, sf_dir):
    out = _chunks(spark, sf_dir).filter("page_range is not null")
    return out.select("source_file", F.col("seq").cast("long").alias("seq"), F.col("part").cast("long").alias("part"), F.concat_ws("-", F.col("page_range").cast("array<string>")).alias("pages"))


@query(f"{CHUNKS_SQL} SELECT chunk_id, hash FROM ranked WHERE rn = 1")
def dedup_first_wins(spark, sf_dir):
    return _split(spark, sf_dir)[0].select("chunk_id", "hash")


@query(f"{CHUNKS_SQL} SELECT chunk_id, original_id, source_file FROM ranked WHERE rn > 1")
def duplicates(spark, sf_dir):
    return _split(spark, sf_dir)[1].select("chunk_id", "original_id", "source_file")


# {t} stands for the text, {f} for the file, {h} for the titles; see fill
TABLE_SQL = "(regexp_matches({t}, '\\|[" + S_IN + "\\-:]+\\|') OR len(list_filter(string_split({t}, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 2)"
PERSON_SQL_RE = "(?is)(?:dr|prof|mr|ms|mrs)\\.?" + S + "*[a-z][a-z]+(?:" + S + "+[a-z]\\.?" + S + "*)*(?:" + S + "+[a-z][a-z]+)+.*(?:professor|head of department|lecturer|hod)"
MARKED_SQL = "(" + " + ".join("contains(lower({t}), '" + m + "')::INT" for m in PROFILE_MARKERS) + " >= 2)"
SECTION_SQL = "(" + " OR ".join("contains(lower({h}), '" + k + "')" for k in PROFILE_SECTIONS) + ")"
PROFILE_SQL = "((" + SECTION_SQL + " AND " + MARKED_SQL + ") OR regexp_matches({t}, '" + PERSON_SQL_RE + "'))"
REGULATION_SQL = "(contains(lower({f}), 'regulation') OR contains(lower({f}), 'curriculum') OR contains(lower({h}), 'regulation') OR regexp_matches({t}, '(?i)r\\p{Nd}{4}|regulation" + S + "*\\p{Nd}+|section" + S + "*\\p{Nd}+\\.\\p{Nd}+|clause" + S + "*\\p{Nd}+'))"
_ROWS = "list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\\A" + S + "+', ''), '" + S + "+\\z', '')), lambda x: x <> '')"
LIST_SQL = "(len(" + _ROWS + ") > 0 AND 2 * len(list_filter(" + _ROWS + ", lambda x: regexp_matches(x, '\\A(?:[-*•]|\\p{Nd}+\\.|[a-zA-Z]\\))" + S + "+'))) > len(" + _ROWS + "))"
CASES_SQL = """
cases AS (SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'Dr. John Mathew' || chr(10) || coalesce(text, '') || ' Associate Professor' WHEN 2 THEN '- ' || replace(coalesce(text, ''), chr(10), chr(10) || '- ') WHEN 3 THEN 'As per Regulation 12: ' || coalesce(text, '')
  WHEN 4 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || coalesce(text, '') WHEN 5 THEN 'Qualification: PhD' || chr(10) || 'Email: a' || chr(10) || coalesce(text, '') WHEN 6 THEN 'hundreds of methods ' || coalesce(text, '') ELSE coalesce(text, '') END AS t,
  CASE WHEN doc_id % 7 = 0 THEN 'Curriculum.md' ELSE 'x.md' END AS f, CASE WHEN doc_id % 2 = 1 THEN 'Home Our Team' ELSE 'Regulations' END AS h FROM documents)"""


def _cases(spark, sf_dir):
    d, t, k = I.table(spark, sf_dir, "documents"), F.coalesce("text", F.lit("")), F.col("doc_id") % 8
    c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    text = F.when(k == 1, c("Dr. John Mathew\n", t, " Associate Professor")).when(k == 2, c("- ", F.replace(t, F.lit("\n"), F.lit("\n- ")))).when(k == 3, c("As per Regulation 12: ", t)).when(k == 4, c("| a | b |\n|---|---|\n", t)).when(k == 5, c("Qualification: PhD\nEmail: a\n", t)).when(k == 6, c("hundreds of methods ", t)).otherwise(t)
    return d.select("doc_id", text.alias("t"), F.when(F.col("doc_id") % 7 == 0, "Curriculum.md").otherwise("x.md").alias("f"), F.when(F.col("doc_id") % 2 == 1, F.array(F.lit("Home"), F.lit("Our Team"))).otherwise(F.array(F.lit("Regulations"))).alias("h"))


def _rule(name: str, sql: str, column) -> None:
    def run(spark, sf_dir):
        return _cases(spark, sf_dir).select("doc_id", column().alias("hit"))

    run.__name__ = name
    query(f"WITH {CASES_SQL} SELECT doc_id, {fill(sql, t='t', f='f', h='h')} AS hit FROM cases")(run)


_rule("classify_table", TABLE_SQL, lambda: C.is_table(F.col("t")))
_rule("classify_profile", PROFILE_SQL, lambda: C.is_profile(F.col("t"), F.col("h")))
_rule("classify_regulation", REGULATION_SQL, lambda: C.is_regulation(F.col("t"), F.col("f"), F.col("h")))
_rule("classify_list", LIST_SQL, lambda: C.is_list(F.col("t")))
CLASS_SQL = "CASE WHEN {t} = '' THEN 'section' WHEN " + TABLE_SQL + " THEN 'table' WHEN " + PROFILE_SQL + " THEN 'profile' WHEN " + REGULATION_SQL + " THEN 'regulation' WHEN " + LIST_SQL + " THEN 'list' ELSE 'section' END"


@query(f"WITH {CASES_SQL} SELECT doc_id, {fill(CLASS_SQL, t='t', f='f', h='h')} AS content_type FROM cases")
def classify(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", C.classify(F.col("t"), F.col("f"), F.col("h")).alias("content_type"))


TYPED_SQL = f"{CHUNKS_SQL}, typed AS (SELECT *, CASE WHEN tabular THEN 'table' ELSE {fill(CLASS_SQL, t='text', f='source_file', h="array_to_string(hierarchy, ' ')")} END AS content_type FROM ranked)"


@query(f"{TYPED_SQL} SELECT content_type, count(*) AS n FROM typed WHERE rn = 1 GROUP BY 1")
def report_by_type(spark, sf_dir):
    return report.by_type(_split(spark, sf_dir, "content_type")[0])


@query(f"{TYPED_SQL} SELECT source_type, count(*) AS n FROM typed WHERE rn = 1 GROUP BY 1")
def report_by_source(spark, sf_dir):
    return report.by_source(_split(spark, sf_dir, "source_type")[0])


@query(f"{CHUNKS_SQL} SELECT (SELECT count(*) FROM ranked WHERE rn = 1) AS total_chunks, (SELECT count(*) FROM ranked WHERE rn > 1) AS duplicates_skipped, (SELECT count(*) FROM counted WHERE NOT tabular AND word_count < 80) AS too_small_skipped, (SELECT count(*) FROM pieces WHERE tabular AND parts > 1 AND part = 1) AS tables_split")
def report_totals(spark, sf_dir):
    seen = Observation()
    return report.totals(*_split(spark, sf_dir, seen=seen), seen.get)


@query(f"{CHUNKS_SQL} SELECT chunk_id, word_count, hash, pages IS NOT NULL AS paged FROM chunks")
def chunk_json_roundtrip(spark, sf_dir):
    rows = K.columns_of_chunk(_chunks(spark, sf_dir))
    text = rows.select(F.to_json(F.struct(*rows.columns)).alias("j"))
    return text.select(F.from_json("j", K.CHUNK).alias("c")).select("c.chunk_id", F.col("c.word_count").cast("long").alias("word_count"), "c.hash", F.col("c.page_range").isNotNull().alias("paged"))


# --- entities ---------------------------------------------------------------------------------------------------------


def _lookup(spark, sf_dir):
    return entities.lookup(I.people(spark, sf_dir))


WITH_PEOPLE = f"WITH {I.PEOPLE_SQL}"


@query(f"{WITH_PEOPLE} SELECT norm, entity_id, is_faculty FROM lookup")
def registry_load(spark, sf_dir):
    return _lookup(spark, sf_dir)


@query(f"{WITH_PEOPLE} SELECT p.p_partkey, l.entity_id FROM part p LEFT JOIN lookup l ON l.norm = {sql_entity('p.p_name')} WHERE p_name IS NOT NULL")
def entity_exact(spark, sf_dir):
    rows = I.table(spark, sf_dir, "part").filter("p_name is not null").select("p_partkey", "p_name")
    return entities.exact(rows, _lookup(spark, sf_dir), "p_name").select("p_partkey", "entity_id")


@query(f"{WITH_PEOPLE} SELECT DISTINCT p_partkey, entity_id FROM norms JOIN lookup ON contains(norms.norm, lookup.norm)")
def entity_contains(spark, sf_dir):
    rows = I.talks(spark, sf_dir).select("p_partkey", T.normalize_entity(F.col("text")).alias("norm_text"))
    return entities.contained(rows, _lookup(spark, sf_dir), "p_partkey", "norm_text")


@query(f"{WITH_PEOPLE} SELECT p_partkey, mention FROM spoken")
def entity_mentions(spark, sf_dir):
    return I.talks(spark, sf_dir).select("p_partkey", F.explode(entities.mentions(T.normalize_entity(F.col("text")))).alias("mention"))


FUZZY_SQL = f"{WITH_PEOPLE}, open AS (SELECT DISTINCT mention FROM spoken ANTI JOIN lookup ON lookup.norm = spoken.mention), near AS (SELECT mention, entity_id FROM open JOIN lookup ON is_faculty AND levenshtein(mention, norm) <= 1 QUALIFY row_number() OVER (PARTITION BY mention ORDER BY levenshtein(mention, norm), norm) = 1)"


@query(f"{FUZZY_SQL} SELECT mention AS norm, entity_id FROM near")
def entity_fuzzy(spark, sf_dir):
    found = _lookup(spark, sf_dir)
    spoken = I.talks(spark, sf_dir).select(F.explode(entities.mentions(T.normalize_entity(F.col("text")))).alias("norm")).distinct()
    return entities.fuzzy(spoken.join(found.select("norm"), "norm", "left_anti"), found)


@query(f"{FUZZY_SQL}, linked AS (SELECT DISTINCT p_partkey, entity_id FROM norms JOIN lookup ON contains(norms.norm, lookup.norm) UNION SELECT p_partkey, entity_id FROM spoken JOIN near USING (mention)) SELECT p_partkey, coalesce(string_agg(entity_id, ',' ORDER BY entity_id), '') AS refs FROM norms LEFT JOIN linked USING (p_partkey) GROUP BY 1")
def entity_refs(spark, sf_dir):
    return entities.entity_refs(I.talks(spark, sf_dir), _lookup(spark, sf_dir), "text").select("p_partkey", F.array_join("entity_refs", ",").alias("refs"))


# --- PDF pages --------------------------------------------------------------------------------------------------------


def _tables(spark, sf_dir):
    """A table of each document: a header of two cells, then its words in rows of three."""
    d = I.table(spark, sf_dir, "documents").withColumn("w", T.words(F.coalesce("text", F.lit(""))))
    rows = F.transform(F.sequence(F.lit(0), F.size("w").cast("int"), F.lit(3)), lambda k: F.slice("w", k + 1, F.lit(3)))
    return d.select("doc_id", "text", F.concat(F.array(F.array(F.lit(" a  b "), F.lit(None).cast("string"))), rows).alias("rows"))


CELLS_SQL = "list_concat([['a b', '']], list_transform(range(0, len(w) + 1, 3), lambda k: list_transform(w[k + 1:k + 3], lambda y: replace(y, '|', chr(92) || '|'))))"
LINES_SQL = f"list_concat([['a b', '']], list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: list_transform({sql_words('x')}, lambda y: replace(y, '|', chr(92) || '|'))))"
TABLE_MD_SQL = f"""WITH d AS (SELECT doc_id, text, {sql_words("coalesce(text, '')")} AS w FROM documents), a AS (SELECT doc_id, {{cells}} AS c FROM d), b AS (SELECT doc_id, c, list_max(list_transform(c, lambda r: len(r))) AS w FROM a),
    m AS (SELECT doc_id, list_transform(c, lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(w - len(r)), lambda z: '')), ' | ') || ' |') AS l, '| ' || array_to_string(list_transform(range(w), lambda z: '---'), ' | ') || ' |' AS rule FROM b)
    SELECT doc_id, array_to_string(list_concat(l[1:1], [rule], l[2:]), chr(10)) AS markdown FROM m"""


@query(fill(TABLE_MD_SQL, cells=CELLS_SQL))
def table_to_markdown(spark, sf_dir):
    return _tables(spark, sf_dir).select("doc_id", pdf.table_to_markdown(F.col("rows")).alias("markdown"))


@query(fill(TABLE_MD_SQL, cells=LINES_SQL))
def table_to_markdown_words(spark, sf_dir):
    """As table_to_markdown, with a row for each line."""
    d = I.table(spark, sf_dir, "documents")
    rows = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), T.words)
    header = F.array(F.array(F.lit(" a  b "), F.lit(None).cast("string")))
    return d.select("doc_id", pdf.table_to_markdown(F.concat(header, rows)).alias("markdown"))


def _pages(text, tables: bool = False):
    """A page for every two lines of a text; with tables, a table of its number and how many lines hold words."""
    l = F.split(text, "\n")  # noqa: E741

    def page(k):
        own = F.slice(l, 2 * k + 1, 2)
        held = F.size(F.filter(own, lambda x: T.collapse(x) != "")).cast("string")
        made = F.array(F.array(F.array(F.lit("page"), F.lit("lines")), F.array((k + 1).cast("string"), held))) if tables else F.array().cast("array<array<array<string>>>")
        return F.struct((k + 1).cast("int").alias("page_num"), F.array_join(own, "\n\n").alias("text"), made.alias("tables"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(l) - 1) / 2).cast("int")), page)


@query(f"SELECT doc_id, len({sql_words('coalesce(text, chr(32))')}) >= 50 AS text_based FROM documents")
def text_based_pdf(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", pdf.is_text_based(_pages(F.coalesce("text", F.lit("")))).alias("text_based"))


@query(
    f"""WITH l AS (SELECT doc_id, source, len({sql_words("coalesce(text, '')")}) >= 50 AS much, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {sql_collapse("x")}) AS l FROM documents),
    p AS (SELECT doc_id, source, much, list_transform(range((len(l) + 1) // 2), lambda k: [(k + 1)::VARCHAR, len(list_filter(l[2 * k + 1:2 * k + 2], lambda x: x <> ''))::VARCHAR, array_to_string(list_transform(list_filter(l[2 * k + 1:2 * k + 2], lambda x: x <> ''), lambda x: chr(10) || x || chr(10)), '')]) AS p FROM l)
    SELECT doc_id, '---' || chr(10) || 'title: "' || source || '"' || chr(10) || 'source_file: "' || source || '.pdf"' || chr(10) || 'source_type: pdf' || chr(10) || '---' || chr(10) || chr(10) || '# ' || source || chr(10) ||
      CASE WHEN doc_id % 3 = 0 AND much THEN array_to_string(list_transform(p, lambda x: chr(10) || '<!-- page: ' || x[1] || ' -->' || chr(10) || chr(10) || '| page | lines |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || x[1] || ' | ' || x[2] || ' |' || chr(10) || x[3]), '')
        WHEN doc_id % 3 = 1 OR doc_id % 3 = 2 AND much THEN array_to_string(list_transform(list_filter(p, lambda x: x[3] <> ''), lambda x: chr(10) || '<!-- page: ' || x[1] || ' -->' || chr(10) || x[3]), '') ELSE '' END AS markdown FROM p"""
)
def pdf_to_markdown(spark, sf_dir):
    """A third of the files have structured pages with tables, a third only plain ones, a third only recognised ones."""
    d, k = I.table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    text = F.coalesce("text", F.lit(""))
    only = lambda n: F.when(k == n, text).otherwise(F.lit(""))
    return d.select("doc_id", pdf.pdf_to_markdown(F.concat("source", F.lit(".pdf")), _pages(only(0), True), _pages(only(1)), _pages(text)).alias("markdown"))


@query("SELECT source_file, row_number() OVER (ORDER BY string_split(source_file, '/')) AS place FROM (SELECT 'data/' || CASE WHEN doc_id % 4 = 0 THEN 'pdfs/' ELSE 'pages/' END || source || '/doc_' || doc_id || '.md' AS source_file FROM documents)")
def scan_sort(spark, sf_dir):
    """Places in order of path parts; ranges of files are numbered apart, then shifted by how many come before."""
    files = I.markdown_docs(spark, sf_dir).select("source_file").withColumn("parts", dedup.path_parts(F.col("source_file")))
    ranged = settled(files.repartitionByRange("parts").sortWithinPartitions("parts").select("source_file", "parts", F.spark_partition_id().alias("p")))
    before = ranged.groupBy("p").agg(F.count("*").alias("n"))
    before = before.alias("a").join(before.alias("b"), F.col("b.p") < F.col("a.p"), "left").groupBy("a.p").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("shift"))
    from pyspark.sql import Window

    own = ranged.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("parts")))
    return own.join(F.broadcast(before), "p").select("source_file", (F.col("k") + F.col("shift")).cast("long").alias("place"))
