"""Content types of chunks by rules: table, profile, regulation, list, else section."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.conf import PROFILE_MARKERS, PROFILE_SECTIONS
from sluice.functions.text import SPACE, strip


def _count(conditions) -> Column:
    return reduce(lambda a, b: a + b, (c.cast("int") for c in conditions))


def is_table(text: Column) -> Column:
    """A separator or empty cell anywhere, or two lines with two bars each."""
    barred = F.filter(F.split(text, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    return text.rlike(r"(?U)\|[\s\x1c-\x1f\-:]+\|") | (F.size(barred) >= 2)


def names_person(text: Column) -> Column:
    """A title and name, and later a designation; anywhere, in any case, even inside words.

    In two steps: the text before the last designation, then a title and name in it. One pattern for both overflows Java's
    stack on long texts. Initials between the names are a letter, perhaps a full stop, then white space, so no match needs
    to give any of them back, and possessive quantifiers keep Java from recursing over long runs of them.
    """
    before = F.regexp_extract(text, r"(?is)\A(.*)(?:professor|lecturer|hod|head of department)", 1)
    return before.rlike(rf"(?iU)(?:dr|prof|mrs|mr|ms)\.?{SPACE}*[a-z][a-z]++(?:{SPACE}++[a-z]\.?+(?={SPACE}))*+{SPACE}++[a-z][a-z]")


def is_profile(text: Column, hierarchy: Column) -> Column:
    section = F.lower(F.array_join(hierarchy, " "))
    marked = _count(F.lower(text).contains(m) for m in PROFILE_MARKERS) >= 2
    return (reduce(lambda a, b: a | b, (section.contains(k) for k in PROFILE_SECTIONS)) & marked) | names_person(text)


def is_regulation(text: Column, source_file: Column, hierarchy: Column) -> Column:
    path = F.lower(source_file)
    numbered = text.rlike(rf"(?iU)r\d{{4}}|regulation{SPACE}*\d+|section{SPACE}*\d+\.\d+|clause{SPACE}*\d+")
    return path.contains("regulation") | path.contains("curriculum") | F.lower(F.array_join(hierarchy, " ")).contains("regulation") | numbered


def is_list(text: Column) -> Column:
    """More than half of the lines with content begin like items of a list."""
    rows = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    items = F.filter(rows, lambda x: x.rlike(rf"(?U)\A(?:[-*•]|\d+\.|[a-zA-Z]\)){SPACE}+"))
    return (F.size(rows) > 0) & (2 * F.size(items) > F.size(rows))


def classify(text: Column, source_file: Column, hierarchy: Column) -> Column:
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "section")
        .when(is_table(text), "table")
        .when(is_profile(text, hierarchy), "profile")
        .when(is_regulation(text, source_file, hierarchy), "regulation")
        .when(is_list(text), "list")
        .otherwise("section")
    )
