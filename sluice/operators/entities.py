"""Entity registry and linking: exact, by substring, by candidate mention and edit distance.

Names in texts are found by an automaton, which reads a text once however many names it holds, as long as the registry's names have
at most LETTERS letters, which is counted before they are broadcast. For larger registries each name is filed under the rarest of
its stretches of GRAM letters; texts' stretches that are filed at all (which bits tell) are joined with these once, and what meets
is compared. There is no largest registry, and no pass for a part of it.

Mentions meet names only where a stretch of a name recurs at about its place, so nothing is compared with all names; a mention
that is longer than all names can be is left out first, so a word of any length costs nothing. Texts stay where they are: what is
joined are mentions.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sluice.functions.text import normalize_entity
from sluice.operators.shared import settled
from sluice.operators.visited import Visited

#: Letters of all names of an automaton, which takes some 60 bytes a letter in a worker.
LETTERS = 8_000_000
#: Letters of the stretches that names are filed under; shorter names are left to an automaton.
GRAM = 6
#: Resolved mentions that are broadcast (some 100 bytes each); more are joined.
GUESSES = 200_000
#: Titles that normalised names may begin with, and how long they are with their space.
TITLES = r"(?:dr|prof|mr|ms|mrs) "
TITLE_LENGTHS = (0, 3, 4, 5)
ENTITY = "id string, name string, aliases array<string>, type string, url string"
MENTION = r"(?U)(?:dr|prof|mr|ms|mrs)[\s\x1c-\x1f]+[a-z]+(?:[\s\x1c-\x1f]+[a-z]+){1,3}"


def lookup(entities: DataFrame, order: str = "load_seq") -> DataFrame:
    """norm, entity_id, is_faculty: each normalised name and alias once; of entities that share one the last loaded has it.

    Entities without an id don't count, nor does an empty name; an empty alias does.
    """
    rows = entities.filter(F.coalesce("id", F.lit("")) != "")
    names = rows.filter(F.coalesce("name", F.lit("")) != "").select(normalize_entity(F.col("name")).alias("norm"), "id", "type", F.struct(F.col(order).alias("at"), F.lit(0).alias("n")).alias("seq"))
    others = rows.select("id", "type", F.col(order).alias("at"), F.posexplode("aliases").alias("n", "alias"))
    others = others.select(normalize_entity(F.col("alias")).alias("norm"), "id", "type", F.struct("at", (F.col("n") + 1).alias("n")).alias("seq"))
    return names.unionByName(others).groupBy("norm").agg(F.max_by("id", "seq").alias("entity_id"), F.bool_or(F.col("type") == "faculty").alias("is_faculty"))


def exact(rows: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """Adds entity_id of the text's normal form, or null."""
    return rows.withColumn("__norm", normalize_entity(F.col(text))).join(found.select(F.col("norm").alias("__norm"), "entity_id"), "__norm", "left").drop("__norm")


def _stretch(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of k + 1 stretches of a text of so many letters, the last ones longer by one."""
    base, longer = F.floor(length / (k + 1)).cast("int"), (length % (k + 1)).cast("int")
    return base * i + F.greatest(F.lit(0), F.lit(i - (k + 1)) + longer), base + F.when(F.lit(i) >= k + 1 - longer, 1).otherwise(0)


def fuzzy(mentions: DataFrame, found: DataFrame, norm: str = "norm", most: int = 1) -> DataFrame:
    """norm, entity_id for the normal forms within an edit distance of a faculty name; the nearest, then smallest name decides.

    What follows a name's title is cut into most + 1 stretches. So many edits leave one of them as it is, moved by at most as
    many places; a mention's substrings at these places are joined with the stretches of names whose lengths fit. A mention has
    a number of substrings that depends on the distance only, so work grows with its length.
    """
    k, title = most, F.length(F.regexp_extract("name", rf"\A{TITLES}", 0))
    names = found.filter("is_faculty").select(F.col("norm").alias("name"), "entity_id").withColumns({"length": F.length("name"), "title": title})
    cuts = []
    for i in range(k + 1):
        start, size = _stretch(F.col("length") - F.col("title"), i, k)
        cuts.append(F.struct(F.col("length"), F.col("title"), F.lit(i).alias("nth"), F.substr("name", F.col("title") + start + 1, size).alias("stretch")))
    filed = names.select("name", "entity_id", F.explode(F.array(*cuts)).alias("at"))
    longest = names.agg(F.max("length")).first()[0]
    own = mentions.select(F.col(norm).alias("norm")).filter(F.length("norm") <= (-1 if longest is None else longest + k)).distinct()
    own = own.withColumn("length", F.explode(F.sequence(F.greatest(F.length("norm") - k, F.lit(0)), F.length("norm") + k)))
    places = []
    for skip in TITLE_LENGTHS:
        for i in range(k + 1):
            start, size = _stretch(F.greatest(F.col("length") - skip, F.lit(0)), i, k)
            for move in range(-k, k + 1):
                at = start + skip + move
                there = (F.col("length") >= skip) & (at >= 0) & (at + size <= F.length("norm"))
                places.append(F.when(there, F.struct(F.col("length"), F.lit(skip).alias("title"), F.lit(i).alias("nth"), F.substr("norm", at + 1, size).alias("stretch"))))
    own = own.select("norm", F.explode(F.array_distinct(F.array_compact(F.array(*places)))).alias("at"))
    near = own.join(filed, "at").select("norm", "name", "entity_id").distinct().withColumn("distance", F.levenshtein("norm", "name", k)).filter("distance >= 0")
    return near.groupBy("norm").agg(F.min_by("entity_id", F.struct("distance", "name")).alias("entity_id"))


def small_registry(found: DataFrame) -> bool:
    """Whether one automaton takes all names."""
    return (found.agg(F.sum(F.length("norm") + 1)).first()[0] or 0) <= LETTERS


def contained(rows: DataFrame, found: DataFrame, key: str, norm: str) -> DataFrame:
    """key, entity_id: entities one of whose names the normalised text contains anywhere."""
    by_automaton = lambda names: rows.select(key, F.explode(_finder(names)(F.col(norm))).alias("entity_id"))
    if small_registry(found):
        return by_automaton(found)
    short = by_automaton(found.filter(F.length("norm") < GRAM))  # names of five letters: few differ
    return short.unionByName(_by_grams(rows, found.filter(F.length("norm") >= GRAM), key, norm)).distinct()


def _grams(text: str):
    """A number for each stretch of GRAM letters."""
    import numpy as np

    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = np.zeros(max(len(letters) - GRAM + 1, 0), dtype=np.uint64)
    for i in range(GRAM):
        out = (out ^ letters[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out).view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def grams(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: [] if x is None else _grams(x))


def _by_grams(rows: DataFrame, found: DataFrame, key: str, norm: str) -> DataFrame:
    """contained() for names of GRAM letters and more, by joins: the texts that hold a filed stretch are read again once."""
    every = found.select("norm", F.explode(grams(F.col("norm"))).alias("gram"))
    counts = every.groupBy("gram").agg(F.count("*").alias("n"))
    filed = settled(every.join(counts, "gram").groupBy("norm").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")).join(found, "norm").select("norm", "entity_id", "gram"))
    seen = Visited(rows.sparkSession)
    keys = filed.select(F.col("gram").cast("string").alias("url")).distinct()
    seen.add(keys, keys.count())
    held = rows.select(key, F.explode(grams(F.col(norm))).alias("gram")).withColumn("word", F.col("gram").cast("string"))
    near = seen.split(held, "word")[0].select(key, "gram").join(filed, "gram").select(key, F.col("norm").alias("name"), "entity_id").distinct()
    return near.join(rows.select(key, F.col(norm).alias("text")), key).filter(F.contains("text", "name")).select(key, "entity_id")


def _finder(found: DataFrame):
    """A column function: the entities whose names a text contains, and those that its mentions (a second column) are resolved to, sorted."""
    names = [(r["norm"], r["entity_id"]) for r in found.select("norm", "entity_id").toLocalIterator()]
    return _inside(found.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, names)))


def _inside(pairs):
    @F.pandas_udf("array<string>")
    def inside(texts: pd.Series) -> pd.Series:
        find = _automaton(*pairs.value)
        return texts.map(lambda x: [] if x is None else sorted(find(x)))

    return inside


_built: dict[str, object] = {}


def _automaton(key: str, pairs):
    """A function from a text to the entities of the names in it; built once a worker, which keeps one."""
    if (made := _built.get(key)) is None:
        import ahocorasick

        trie, always = ahocorasick.Automaton(), set()
        for name, entity in pairs:
            trie.add_word(name, trie.get(name, frozenset()) | {entity}) if name else always.add(entity)
        trie.make_automaton()

        def made(text):
            return always.union(*(x for _, x in trie.iter(text))) if len(trie) else always

        _built.clear()
        _built[key] = made
    return made


def _resolver(guessed: DataFrame):
    """A column function: the entities of a text's mentions."""
    known = {r["norm"]: r["entity_id"] for r in guessed.toLocalIterator()}
    shared = guessed.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("array<string>")
    def resolved(spoken: pd.Series) -> pd.Series:
        return spoken.map(lambda x: [] if x is None else [shared.value[m] for m in x if m in shared.value])

    return resolved


def mentions(norm: Column) -> Column:
    """What looks like a title and two to four names, in a normalised text."""
    return F.regexp_extract_all(norm, F.lit(MENTION), F.lit(0))


def entity_refs(rows: DataFrame, found: DataFrame, text: str, most: int = 1) -> DataFrame:
    """Adds entity_refs: the sorted ids of entities that the text contains, or of which a mention is so many edits away.

    Rows are read twice, first for their mentions; they move only where the registry is too large for an automaton, or where
    more mentions than GUESSES are resolved, and then only those with mentions.
    """
    none = F.array().cast("array<string>")
    rows, found = rows.drop("entity_refs"), settled(found.select("norm", "entity_id", "is_faculty"))
    norm = normalize_entity(F.col(text))
    said = rows.select(F.explode(mentions(norm)).alias("norm")).distinct().join(found.select("norm"), "norm", "left_anti")
    guessed = settled(fuzzy(said, found, most=most))
    if small_registry(found):
        out = rows.withColumn("__norm", norm)
        out = out.withColumns({"__held": _finder(found)(F.col("__norm")), "__said": mentions(F.col("__norm"))}).drop("__norm")
    else:
        keyed = rows.withColumn("__norm", norm).withColumn("__key", F.sha2("__norm", 256))
        held = contained(keyed.select("__key", "__norm").dropDuplicates(["__key"]), found, "__key", "__norm").groupBy("__key").agg(F.collect_set("entity_id").alias("__held"))
        out = keyed.join(held, "__key", "left").withColumns({"__held": F.coalesce("__held", none), "__said": mentions(F.col("__norm"))}).drop("__norm", "__key")
    n = guessed.count()
    if not n:
        out = out.withColumn("__meant", none)
    elif n <= GUESSES:
        out = out.withColumn("__meant", _resolver(guessed)(F.col("__said")))
    else:
        out = out.withColumn("__key", F.sha2(F.array_join("__said", "\n"), 256))
        speaking = out.select("__key", F.explode("__said").alias("norm")).distinct()
        meant = speaking.join(guessed, "norm").groupBy("__key").agg(F.collect_set("entity_id").alias("__meant"))
        silent = out.filter(F.size("__said") == 0).withColumn("__meant", none)
        out = out.filter(F.size("__said") > 0).join(meant, "__key", "left").select(*silent.columns).unionByName(silent).withColumn("__meant", F.coalesce("__meant", none)).drop("__key")
    return out.withColumn("entity_refs", F.array_sort(F.array_union("__held", "__meant"))).drop("__held", "__said", "__meant")


def faculty_entities(people: DataFrame) -> DataFrame:
    """id, name, aliases, type, url of people (name, url)."""
    from sluice.functions.text import aliases, entity_id

    return people.select(entity_id(F.col("name")).alias("id"), "name", aliases(F.col("name")).alias("aliases"), F.lit("faculty").alias("type"), F.coalesce("url", F.lit("")).alias("url"))


def get_entity(entities: DataFrame, entity: str) -> DataFrame:
    return entities.filter(F.col("id") == entity)


def load_counts(entities: DataFrame, by: str = "source") -> DataFrame:
    """How many entities each file gave."""
    return entities.filter(F.coalesce("id", F.lit("")) != "").groupBy(by).agg(F.count("*").alias("n"))
