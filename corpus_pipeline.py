"""The corpus pipeline: quality rules, near-duplicate removal, substring dedup, packing.

Each stage takes what its predecessor kept, as a table of documents, and all but the last return the same columns, whatever
their names: stages give their own columns names that the input doesn't have. Null and empty texts fail the quality rules. Equal
rows and ties are treated as each stage says; an empty table gives no rows. What a very long text takes in a worker stands in
the operators' modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import op2_packing, op4_substrings, op5_quality, op9_jaccard
from sluice.llm.common import fresh, remove, settled, shared_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return op5_quality.keep_good(docs, op5_quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id; documents without words or id all stay.

    Of a group's rows that share that id the one with the smallest hash of its text stays, and one of equal rows. Groups whose
    smallest ids are equal keep a document each.
    """
    found = op9_jaccard.jaccard_components(docs).filter("n_shingles > 0 and doc_id is not null")
    key, digest, times = fresh(docs, "id", "digest", "times")
    equal = found.groupBy("component", "doc_id", "row").agg(F.count("*").alias("n"))
    least = equal.groupBy("component").agg(F.min(F.struct("doc_id", "row", "n")).alias("x"))
    stay = settled(least.select(F.col("x.doc_id").alias(key), F.col("x.row").alias(digest), F.col("x.n").alias(times)))
    rows = docs.withColumns({key: F.col("doc_id").cast("long"), digest: F.xxhash64(F.coalesce("text", F.lit("")))})
    free = F.col("doc_id").isNull() | ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = rows.filter(~free).join(stay, [key, digest])
    if not stay.filter(F.col(times) > 1).isEmpty():  # equal rows are one
        kept = kept.filter(F.col(times) == 1).unionByName(kept.filter(F.col(times) > 1).dropDuplicates([key, digest]))
    return kept.select(docs.columns).unionByName(rows.filter(free).select(docs.columns))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of 50 words that a document with a smaller id holds too."""
    out = op4_substrings.remove_repeats(docs, op4_substrings.repeated_spans(docs))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens of what is left."""
    import public_tokenizers

    return op2_packing.pack(docs, public_tokenizers.path(op2_packing.TOKENIZER))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", substrings), ("packing", packing)]

#: Neither hashed log-likelihood ratios nor tokens can be had in SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet to the shared folder and read again, and removed after the next."""
    docs, folder = table(spark, sf_dir, "documents"), shared_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if i:
            remove(spark, f"{folder}/{STAGES[i - 1][0]}")
    return docs
