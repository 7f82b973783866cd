"""HTML as a stream of tags and texts, robust to unclosed tags; and what of it is never content."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose content isn't markup.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "select", "xmp")
RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end blocks of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never main text, whatever holds them; header only outside the main region.
DROPPED = frozenset("head nav footer aside form menu dialog button label input fieldset datalist audio video map".split()) | frozenset(RAW)
#: Words of class, id or role that mark such parts.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies
    disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related
    search share sharing sidebar skip skiplink social sponsor sponsored subscribe toolbar topbar widget widgets complementary contentinfo""".split()
)
#: Of these, those that name such a part and nothing else, so that they count within a main region too.
SURE = frozenset("ad ads adv advert adverts advertisement adsense breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr menu nav navbar navigation sidebar sponsor sponsored".split())
CONTAINERS = frozenset("article aside div figure footer form header li main nav ol section table td tr ul dl fieldset dialog menu p span".split())


@dataclass(frozen=True)
class Tag:
    name: str
    closing: bool
    marks: frozenset  # words of class, id and role

    @property
    def signature(self) -> str:
        return ".".join([self.name, *sorted(self.marks)])

    @property
    def marked(self) -> bool:
        """Whether a word of its class, id or role says that it isn't main text."""
        return self.name in CONTAINERS and self.name not in ("article", "main") and bool(self.marks & MARKS)

    @property
    def dropped(self) -> bool:
        return self.name in DROPPED or self.marked


def tokens(page: str) -> Iterator[Tag | str]:
    """Tags, and texts with their character references decoded; comments, declarations and raw elements' contents are left out."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        found = None
        while lt >= 0 and (found := MARKUP.match(page, lt)) is None:
            lt = page.find("<", lt + 1)
        if lt < 0:
            yield html.unescape(page[at:])
            return
        if lt > at:
            yield html.unescape(page[at:lt])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        words = frozenset(w for m in ATTRIBUTE.finditer(attributes) for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()) if w) if "=" in attributes and not closing else frozenset()
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = RAW_END[name].search(page, at)
                at = end.end() if end else size
            continue
        yield Tag(name, closing, words)


class Regions:
    """Follows a stream of tags, counting only elements of the same name, so that unclosed ones inside don't matter."""

    def __init__(self):
        self.name, self.depth = "", 0

    def open(self, tag: Tag) -> None:
        self.name, self.depth = tag.name, 1

    def see(self, tag: Tag) -> bool:
        """Whether this tag closes the region."""
        if tag.name == self.name and tag.name not in VOID:
            self.depth += -1 if tag.closing else 1
        return self.depth <= 0 or tag.closing and tag.name in ("body", "html")
