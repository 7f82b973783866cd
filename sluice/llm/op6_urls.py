"""URL filter: longest-prefix rules, and a Bloom filter cascade over the corpus's own hosts for all other URLs.

A list of blocked domains covers each domain and its subdomains. The keys are all domain suffixes of all hosts in the
corpus: its complete key universe. Level 0 of the cascade encodes the listed keys of the universe; each further level
encodes the keys of the other side that the level before took in wrongly, until there is none. So the cascade answers
exactly for every key of the universe, and pages need no join: the filters are sized by the list (about 1.5 bits for
each doubling of universe over list, and 5 more, a listed key) and are broadcast only if they stay below MAX_BYTES;
beyond that the listed keys are joined, which gives the same answer.

Distinct hosts are made by a partial aggregate before the shuffle, so a host that holds a third of the pages moves once a
task. A null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; rows with equal or null
ids stay rows of their own; an empty table or an empty list gives empty filters. Only id and url are read, so other columns
can't clash; a very long url is a row like others. The list may be a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_table, lower_ascii, mix, settled, table

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: The list of blocked domains: what stands before the last two labels of the hosts that it names.
BLOCKED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
MAX_BYTES = 64 << 20


@dataclass
class Level:
    bits: np.ndarray  # bytes
    n_bits: int
    n_hashes: int
    seed: int

    def positions(self, keys: np.ndarray) -> np.ndarray:
        """A row of positions for each hash function."""
        first, step = mix(keys ^ np.uint64(self.seed)), mix(keys + np.uint64(self.seed)) | np.uint64(1)
        return np.stack([(first + np.uint64(i) * step) % np.uint64(self.n_bits) for i in range(self.n_hashes)])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = self.positions(keys)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def key_hash(host: Column) -> Column:
    return F.xxhash64(host)


def suffixes(host: Column) -> Column:
    """The host and each domain above it."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of n keys; tasks make blocks of its bits, so the driver gets the filter's bytes once."""
    n_bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    level = Level(np.zeros(0, dtype=np.uint8), n_bits, max(1, round(n_bits / n * math.log(2))) if n else 1, seed)

    def task(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(level.positions(b.column("key").to_numpy(zero_copy_only=False).view(np.uint64))).view(np.int64))], names=["at"])

    level.bits = bit_table(keys.select("key").mapInArrow(task, "at long"), "at", n_bits)
    return level


def cascade(universe: DataFrame, size_limit: int = MAX_BYTES) -> list[Level] | None:
    """Filters for the keys (key long, listed boolean) of the universe, each once; None if they would exceed size_limit."""
    levels: list[Level] = []
    left = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    listed, n_in, n_out, used = True, left.get(True, 0), left.get(False, 0), 0
    rest = universe
    while n_in:
        rate = min(0.5, max(1e-6, n_in / (math.sqrt(2) * n_out))) if not levels and n_out else 0.5
        used += math.ceil(-n_in * math.log(rate) / math.log(2) ** 2) // 8
        if used > size_limit:
            return None
        levels.append(level := _level(rest.filter(F.col("listed") == listed).select("key"), n_in, rate, 0x51ED2701 + 7919 * len(levels)))
        rest = rest.filter((F.col("listed") == listed) | holds(rest.sparkSession, level)(F.col("key")))
        listed, n_in = not listed, rest.filter(F.col("listed") != listed).count()
    return levels


def holds(spark: SparkSession, level: Level):
    given = spark.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def inside(key: pd.Series) -> pd.Series:
        return pd.Series(given.value.holds(key.to_numpy(dtype=np.int64).view(np.uint64)))

    return inside


def member(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Which keys of the universe are listed: how many levels in a row hold a key, odd or even, decides."""
    depth, alive = np.zeros(len(keys), dtype=np.int64), np.ones(len(keys), dtype=bool)
    for level in levels:
        alive[alive] = level.holds(keys[alive])
        depth += alive
    return depth % 2 == 1


def names_of(spark: SparkSession, blocked: tuple[str, ...] | DataFrame) -> DataFrame:
    """name: each listed domain once; a list may be a table, of which the first column counts."""
    if isinstance(blocked, DataFrame):
        return blocked.select(lower_ascii(F.col(blocked.columns[0])).alias("name")).filter("name is not null").distinct()
    return spark.createDataFrame([(x,) for x in sorted(set(blocked))], "name string")


def blocked_hosts(pages: DataFrame, blocked: tuple[str, ...] | DataFrame, url: str = "url", size_limit: int = MAX_BYTES):
    """A function of a host column: whether the host or a domain above it is in the list."""
    spark = pages.sparkSession
    listed = names_of(spark, blocked).select("name", F.lit(True).alias("listed"))
    hosts = pages.select(split_url(F.col(url))[0].alias("host")).distinct()
    names = hosts.select(F.explode(suffixes(F.col("host"))).alias("name")).distinct().join(listed, "name", "left")
    universe = names.select(key_hash(F.col("name")).alias("key"), F.coalesce("listed", F.lit(False)).alias("listed"))
    universe = settled(universe.groupBy("key").agg(F.max("listed").alias("listed")))
    levels = cascade(universe, size_limit)
    if levels is None:
        return None
    given = spark.sparkContext.broadcast(levels)

    @F.pandas_udf("boolean")
    def inside(keys: pd.Series) -> pd.Series:
        sizes = keys.map(len).to_numpy()
        flat = np.concatenate([np.asarray(k, dtype=np.int64) for k in keys]) if len(keys) else np.empty(0, dtype=np.int64)
        found = np.concatenate([[0], np.cumsum(member(given.value, flat.view(np.uint64)))])
        ends = np.cumsum(sizes)
        return pd.Series(found[ends] > found[ends - sizes])

    return lambda host: inside(F.transform(suffixes(host), key_hash))


def filter_urls(pages: DataFrame, rules=RULES, blocked: tuple[str, ...] | DataFrame = BLOCKED, key: str = "page_id", url: str = "url", size_limit: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row."""
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest comes last and so stands outermost
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    inside = blocked_hosts(pages, blocked, url, size_limit)
    if inside is None:  # the list is too long to broadcast
        listed = names_of(pages.sparkSession, blocked)
        hit = rows.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("name")).join(listed, "name", "left_semi").select("host").distinct().withColumn("hit", F.lit(True))
        rows = rows.join(hit, "host", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    else:
        rows = rows.withColumn("hit", inside(F.col("host")))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return filter_urls(table(spark, sf_dir, "pages"))


def _fits(domain: str, start: str) -> str:
    return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{start}')"


_ORDERED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
ORACLE_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_fits(d, p)} THEN '{d}{p}'" for _, d, p in _ORDERED)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(d, p)} THEN '{k}'" for k, d, p in _ORDERED)}
       WHEN {" OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in BLOCKED)} THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""
