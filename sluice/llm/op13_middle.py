"""Fill-in-middle transformation in Spark's own functions: no shuffle, a row in, a row out.

regexp_extract_all makes the array of units (each word with the white space before it, and white space at the end); substrings of
a SHA-256 of seed and id, read by conv, give the two cuts, whether a document is transformed and in which form; slice and
array_join build the three parts, which stand behind their sentinels. As the text of a transformed document holds none of the
sentinels, and none can arise where parts meet (each begins with the only < and ends with the only > of its own), splitting at
them gives the parts back, and the parts the text.

A null text is empty and stays plain; so do texts that hold a sentinel. A null id hashes as an empty one; repeated rows and ids
keep their rows, equal rows have equal results. An empty table gives no rows. Only id and text are read, so other columns can't
clash. A very long text is an array of its units in one task, some 60 bytes a unit besides the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, table

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED = "42"
#: Of 100 documents so many are transformed, and of 100 of these so many begin with the suffix.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(key: Column, seed: str = SEED) -> list[Column]:
    """Four numbers of 32 bits that a row's key fixes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output."""
    rows = keyed_text(docs, key, text).withColumn("units", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0)))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    n = F.size("units")
    rows = rows.withColumns({"h1": h1, "h2": h2, "h3": h3, "h4": h4}).withColumn("n", n.cast("long"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    cuts = [(F.col(h) % (F.col("n") + 1)).cast("int") for h in ("h1", "h2")]
    rows = rows.withColumns({"form": form, "low": F.least(*cuts), "high": F.greatest(*cuts)})
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    parts = {"prefix": part(F.lit(1), F.col("low")), "middle": part(F.col("low") + 1, F.col("high") - F.col("low")), "suffix": part(F.col("high") + 1, F.col("n").cast("int") - F.col("high"))}
    return rows.withColumns(parts).select("doc_id", "text", "n", "form", "prefix", "middle", "suffix").withColumn("output", arranged(F.col("form")))


def arranged(form: Column) -> Column:
    """The output of a row with text, prefix, middle and suffix."""
    p, s, m = (F.concat(F.lit(x), F.col(c)) for x, c in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    return F.when(form == "psm", F.concat(p, s, m)).when(form == "spm", F.concat(s, p, m)).otherwise(F.col("text"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    cut = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    in_order = lambda *at: F.concat(*(F.get(cut, F.lit(i)) for i in at))
    return F.when(form == "psm", in_order(1, 3, 2)).when(form == "spm", in_order(2, 3, 1)).otherwise(output)


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; digests of outputs and of the texts rebuilt from them."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE_SQL = rf"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNITS}') AS u, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM u),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS a, coalesce(array_to_string(u[low + 1:high], ''), '') AS m, coalesce(array_to_string(u[high + 1:n], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || a || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
