"""URL primitives as Column functions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Scheme, authority, path, query and fragment of RFC 3986, appendix B.
PARTS = r"(?s)\A(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"


def normalize(url: Column) -> Column:
    """Without fragment, parameters of the last segment, and slashes at the end of the path; the query stays."""
    scheme, host, path, query = (F.coalesce(F.regexp_extract(url, PARTS, i), F.lit("")) for i in (1, 2, 3, 4))
    path = F.regexp_replace(F.regexp_replace(path, r";[^/]*\z", ""), r"/+\z", "")
    return F.concat(F.lower(scheme), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _any(url: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (url.rlike(f"(?i){p}") for p in patterns), F.lit(False))


def is_valid(url: Column, base_url: str, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Below the base, none of the excluded and any of the included patterns."""
    return url.startswith(base_url) & ~_any(url, exclude) & _any(url, include)


def is_pdf(url: Column) -> Column:
    return F.lower(url).endswith(".pdf")


def wanted_pdf(url: Column, valid: Column) -> Column:
    return is_pdf(url) & (valid | F.lower(url).contains("syllabus") | F.lower(url).contains("regulation"))


def markdown_filename(url: Column) -> Column:
    """The path with underscores and six digits of the URL's MD5; index.md without a path."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, PARTS, 3), r";[^/]*\z", ""), r"\A/+|/+\z", "")
    name = F.replace(F.replace(path, F.lit("/"), F.lit("_")), F.lit("departments_"), F.lit(""))
    return F.when(path == "", "index.md").when(name.endswith(".md"), name).otherwise(F.concat(name, F.lit("_"), F.substring(F.md5(url), 1, 6), F.lit(".md")))


def pdf_filename(url: Column) -> Column:
    last = F.element_at(F.split(url, "/"), -1)
    return F.when(last.endswith(".pdf"), last).otherwise(F.concat(F.lit("document_"), F.substring(F.md5(url), 1, 8), F.lit(".pdf")))


def hrefs(html: Column) -> Column:
    """The href of each anchor, in order, with character references as they stand."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


@F.pandas_udf(ArrayType(StringType()))
def resolved(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Links against their page's URL; references decoded first. What can't be resolved stays as it is."""
    import html
    from urllib.parse import urljoin

    def join(base, link):
        try:
            return urljoin(base or "", html.unescape(link))
        except ValueError:
            return link

    for links, base in batches:
        yield pd.Series([None if x is None else [join(b, y) for y in x] for x, b in zip(links, base, strict=True)])


def links(html: Column, url: Column) -> Column:
    """The distinct normalised links of a page, sorted."""
    return F.array_sort(F.array_distinct(F.transform(resolved(hrefs(html), url), normalize)))
