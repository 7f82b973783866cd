"""Settings of the chunking engine, handed to the builders; nothing happens on import."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Words of section titles that mark profile sections.
PROFILE_SECTIONS = ("faculty", "the people", "our team", "staff", "professors", "teaching staff")
#: Words of profile texts, of which two must occur.
PROFILE_MARKERS = ("professor", "assistant professor", "associate professor", "head of department", "qualification", "email", "aicte id", "specialization")


@dataclass(frozen=True)
class ChunkConf:
    min_words: int = 80
    soft_words: int = 600
    max_words: int = 700
    table_rows: int = 50
    #: compat counts page markers' lines in the whole file, but chunks' lines without front matter; aligned counts both without.
    page_lines: str = "compat"
    #: Whether the report counts chunks that were too small and tables that were split, instead of giving 0.
    strict_report: bool = False
    #: Files of so many bytes are read in splits and segmented by several tasks.
    large_bytes: int = 64 << 20


#: Fixed values of CrawlConf: excluded patterns, depth, number of URLs, retries, delay and time limit; of ChunkConf: word and row limits.
@dataclass(frozen=True)
class CrawlConf:
    base_url: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = (r"/wp-content/", r"/wp-admin/", r"\.(jpg|jpeg|png|gif|svg|css|js)$")
    max_depth: int = 3
    max_urls: int = 200
    retries: int = 3
    delay_seconds: float = 1.0
    timeout_seconds: float = 30.0
    user_agent: str = "Mozilla/5.0"
    headers: dict = field(default_factory=dict)
    #: How many tasks fetch; a host's delay holds between all of them.
    tasks: int = 4
