"""Text primitives as Column functions.

White space is Unicode's, with U+001C to U+001F; word characters are letters, numbers and the underscore. Java's classes
differ in both, so they are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
FRONT = rf"(?sU)\A---{SPACE}*\n.*?\n---{SPACE}*\n"
#: Titles before names, in the order in which they are normalised.
TITLES = ("dr", "prof", "mr", "ms", "mrs")


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0)).cast("int")


def collapse(c: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.array_join(words(c), " ")


def remove_frontmatter(c: Column) -> Column:
    return F.regexp_replace(c, FRONT, "")


def normalize_for_hash(c: Column) -> Column:
    return collapse(F.lower(remove_frontmatter(c)))


def content_hash(c: Column) -> Column:
    """SHA-256 of the normalised text, in hexadecimal."""
    return F.sha2(normalize_for_hash(c), 256)


def slugify(c: Column, max_length: int = 50) -> Column:
    """Lower-case words joined by underscores; cut last, so it may end in one."""
    kept = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s\x1c-\x1f-]+", "_"), r"\A_+|_+\z", ""), 1, max_length)


def chunk_id(source_type: Column, stem: Column, hierarchy: Column, text_hash: Column) -> Column:
    """Type, file, last two titles and the hash's first eight digits."""
    last = F.when(F.size(hierarchy) > 2, F.slice(hierarchy, F.greatest(F.size(hierarchy) - 1, F.lit(1)), 2)).otherwise(hierarchy)
    section = F.when(F.size(hierarchy) > 0, slugify(F.array_join(last, "_"))).otherwise(F.lit("root"))
    return F.concat_ws("_", source_type, slugify(stem, 30), section, F.substring(text_hash, 1, 8))


def normalize_entity(c: Column) -> Column:
    """The form in which names and texts are compared; null gives the empty text.

    A title is set off wherever its letters stand, even inside words.
    """
    out = F.lower(F.coalesce(c, F.lit("")))
    for t in TITLES:
        out = F.regexp_replace(out, rf"(?U){t}\.?{SPACE}*", f"{t} ")
    return collapse(F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", ""))


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance in code points; -1 beyond most."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def without_title(name: Column) -> Column:
    return F.regexp_replace(name, rf"(?iU)\A(?:dr\.?|prof\.?|mr\.?|ms\.?|mrs\.?){SPACE}*", "")


def aliases(name: Column) -> Column:
    """The name, and if it has a title the name without it."""
    bare = without_title(name)
    return F.when(bare != name, F.array(name, strip(bare))).otherwise(F.array(name))


def entity_id(name: Column, kind: str = "faculty") -> Column:
    return F.concat(F.lit(f"{kind}_"), F.array_join(words(F.regexp_replace(F.lower(name), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", "")), "_"))
