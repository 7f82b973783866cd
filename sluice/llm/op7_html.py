"""HTML extraction by wrappers: for each host a union-free regular expression, inferred by aligning its pages' token streams.

Inference. Every page becomes a stream of tags and texts; adjacent repetitions of one group of tags are folded into a
repeated group. Pages of a host whose streams have one shape are a template: tasks merge their own pages of a template, then
one row a task and template moves. A host's templates are aligned in a tree of partial merges, FAN at a time (longest common
subsequence of their elements): texts that differ become text slots, groups that one side lacks become optional, groups that
repeat in either become repeated. The regular expression has no unions. Slots carry how much text they held, outside parts
that are never content (see html_tokens), each page's lengths as shares of its text, so a long page counts like a short one.

Extraction. Each template is aligned with its host's wrapper, which tells its slots from its fixed texts. Its main region is
the innermost element that holds nearly all text of its slots; the host's is that of most pages, and holds for templates that
have none of their own but have at least half of their slots' text in it, or have no slots. Every page is matched with its
host's wrapper (or, if its template has a region of its own, with that template, whose shape it has), and its main text is
that of the element at the region's place, whatever its name; so a region needs no telling tag or class. Where nothing matches
the region's place, the first element with its signature counts; a page without one uses its article or main element, else the
whole page. Elements that are never content by their name (nav, aside, form, footer, ..) are left out everywhere, and so are
those whose class names an advert, a menu, a sidebar, a cookie notice or readers' comments. Other class words (share, related,
notice, search, ..) may as well belong to the text: they count outside of a region; within one the wrapper decides, and such an
element goes if all its texts are fixed on the host's differing pages. All else within a region stays, however many pages the
host has.

Hosts' regions, and those of templates that differ, are broadcast while their size stays below MAX_BYTES each, and joined to
the pages beyond it; the joins' hot hosts are split by adaptive execution. Only pages of hosts with differing templates have
their shape taken again for the join.

Repeated groups are found up to 12 elements long (fold); longer ones stay as they stand, which makes a wrapper longer, not the
text shorter. Of regions with equally many pages the one with the greatest signature counts. A very long page is held some
hundred times in a task, as tokens and elements.

Null and empty pages have an empty text; a null URL belongs to the empty host; rows with equal or null ids stay rows of their
own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, settled, table
from .html_tokens import BLOCK, DROPPED, MARKS, SURE, VOID, Regions, Tag, tokens
from .op6_urls import split_url

MAX_BYTES = 32 << 20
SHARE = 0.9
#: Streams of a host that one step of the tree merges, and elements that a task holds before it hands its templates on.
FAN, HELD = 16, 500_000
MAIN = ("article", "main")
CONTENT = frozenset("article content entry main post story".split())
#: Texts up to this length stand in a wrapper as they are, longer ones by their beginning and a hash of the whole.
LITERAL = 80
#: Begins the literal of a repeated group's texts, followed by their hash.
LIST = "\0"
#: Bits of the table of an alignment; beyond it the longer side is halved first.
TABLE_BITS = 1 << 28
#: The length of all text of a page, of which each text has its share.
WHOLE = 1_000_000

# An element of a wrapper: ["tag", signature], ["close", name], ["text", literal, length], ["slot", "", length],
# ["rep", [elements]], ["opt", [elements]]; lengths are characters of text that may be content.


def stream(page: str) -> list:
    """The page's elements, folded, with lengths in parts of WHOLE; texts in parts that are never content have length 0."""
    return placed(page)[0]


def tokens_of(page: str | list) -> list:
    """The page's tokens, if it isn't given as these."""
    return page if isinstance(page, list) else list(tokens(page))


def placed(page: str | list) -> tuple[list, list[int]]:
    """stream, and the number of the first token of each of its elements."""
    out: list = []
    at: list[int] = []
    skipped = Regions()
    for k, t in enumerate(tokens_of(page)):
        if isinstance(t, str):
            if words := t.split():
                literal = " ".join(words)
                size = 0 if skipped.depth else len(literal)
                if len(literal) > LITERAL:
                    literal = f"{literal[:LITERAL]} {hashlib.blake2b(literal.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"
                out.append(["text", literal, size])
                at.append(k)
            continue
        if skipped.depth:
            if skipped.see(t):
                skipped.depth = 0
        elif t.dropped and not t.closing and t.name not in VOID:
            skipped.open(t)
        if t.name in BLOCK or t.name in ("a", "span"):
            out.append(["close", t.name] if t.closing else ["tag", t.signature])
            at.append(k)
    total = sum(e[2] for e in out if e[0] == "text")
    for e in out:
        if e[0] == "text":
            e[2] = e[2] * WHOLE // total if total else 0
    return fold(out, at), at


def shape(e: list) -> str:
    """What must agree for two elements to be the same place of a wrapper."""
    if e[0] in ("text", "slot"):
        return "#"
    return f"{e[0]}({' '.join(shape(x) for x in e[1])})" if e[0] in ("rep", "opt") else f"{e[0]}:{e[1]}"


def core(e: list) -> str:
    """The shape of the group within a repeated or optional one."""
    while e[0] in ("rep", "opt") and len(e[1]) == 1:
        e = e[1][0]
    return " ".join(shape(x) for x in e[1]) if e[0] in ("rep", "opt") else shape(e)


def merge(a: list, b: list) -> list:
    """One element for two of one shape: texts that differ become a slot; lengths add up."""
    if a[0] in ("text", "slot"):
        return [a[0], a[1], a[2] + b[2]] if a[0] == b[0] == "text" and a[1] == b[1] else ["slot", "", a[2] + b[2]]
    if a[0] in ("rep", "opt"):
        return [a[0], [merge(x, y) for x, y in zip(a[1], b[1], strict=True)]]
    return a


def joined(a: list, b: list) -> list:
    """One element for two that follow each other in a repeated group: their texts are one text, which other pages may have too."""
    if a[0] in ("text", "slot"):
        if a[0] == b[0] == "text":
            return ["text", LIST + hashlib.blake2b(f"{a[1]}\0{b[1]}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), a[2] + b[2]]
        return ["slot", "", a[2] + b[2]]
    if a[0] in ("rep", "opt"):
        return [a[0], [joined(x, y) for x, y in zip(a[1], b[1], strict=True)]]
    return a


def fold(elements: list, at: list[int] | None = None, longest: int = 12) -> list:
    """Adjacent groups of one shape, each of up to longest elements, become one repeated group; inner groups first. at: numbers
    of the elements, of which a group keeps its first one's."""
    shapes = [shape(e) for e in elements]
    for width in range(1, longest + 1):
        if len(elements) < 2 * width:
            break
        out, out_shapes, kept, i, n = [], [], [], 0, len(elements)
        for k in range(n - width):
            if k < i or shapes[k] != shapes[k + width] or width == 1 and elements[k][0] != "text":
                continue
            same = shapes[k : k + width]
            times = 1
            while shapes[k + times * width : k + (times + 1) * width] == same:
                times += 1
            if times > 1:
                group = elements[k : k + width]
                for j in range(1, times):
                    group = [joined(x, y) for x, y in zip(group, elements[k + j * width : k + (j + 1) * width], strict=True)]
                out += [*elements[i:k], ["rep", group]]
                out_shapes += [*shapes[i:k], f"rep({' '.join(same)})"]
                kept += range(i, k + 1)
                i = k + times * width
        if i:
            elements, shapes = out + elements[i:], out_shapes + shapes[i:]
            if at is not None:
                at[:] = [at[k] for k in [*kept, *range(i, n)]]
    return elements


def grown(a: list, b: list) -> list[int]:
    """Bits after each element of b: bit i is 0 where a[: i + 1] has a longer common subsequence with b so far than a[:i]."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    out = [full]
    for y in b:
        now = out[-1]
        if both := now & places.get(y, 0):
            now = (now + both | now - both) & full
        out.append(now)
    return out


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, the earliest of a first; whole, whatever the lengths."""
    out: list[tuple[int, int]] = []
    at = 0
    while at < min(len(a), len(b)) and a[at] == b[at]:
        out.append((at, at))
        at += 1
    x, y = a[at:], b[at:]
    n, m = len(x), len(y)
    if n * m > TABLE_BITS and m > 1:
        half = m // 2
        head, tail = [0], [0]
        for sums, bits in ((head, _last(x, y[:half])), (tail, _last(x[::-1], y[half:][::-1]))):
            for c in bits:
                sums.append(sums[-1] + (c == "0"))
        cut = max(range(n + 1), key=lambda k: (head[k] + tail[n - k], -k))
        out += [(at + i, at + j) for i, j in matches(x[:cut], y[:half])]
        return out + [(at + cut + i, at + half + j) for i, j in matches(x[cut:], y[half:])]
    rows = grown(x[::-1], y[::-1])
    i, j = n, m  # elements left
    while i and j:
        if x[n - i] == y[m - j]:
            out.append((at + n - i, at + m - j))
            i, j = i - 1, j - 1
        elif rows[j] >> i - 1 & 1:
            i -= 1
        else:
            j -= 1
    return out


def _last(a: list, b: list) -> str:
    """The last of grown(a, b) as digits, the first bit first."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = now = (1 << len(a)) - 1
    for y in b:
        if both := now & places.get(y, 0):
            now = (now + both | now - both) & full
    return f"{now:0{len(a)}b}"[::-1] if a else ""


def align(wrapper: list, page: list) -> list:
    """The wrapper that fits both."""
    n, m = len(wrapper), len(page)
    same = iter(matches([core(e) for e in wrapper], [core(e) for e in page]))
    p, q = next(same, (n, m))
    out: list = []
    i = j = 0

    def optional(e: list) -> None:
        out.append(e if e[0] == "opt" else ["opt", [e]])

    while i < n or j < m:
        if (i, j) == (p, q):
            x, y = wrapper[i], page[j]
            if shape(x) == shape(y):
                out.append(merge(x, y))
            else:  # the same group, repeated or optional on one side
                kinds, groups = set(), []
                for e in (x, y):
                    while e[0] in ("rep", "opt"):
                        kinds.add(e[0])
                        if len(e[1]) > 1 or e[1][0][0] not in ("rep", "opt"):
                            break
                        e = e[1][0]
                    groups.append(e[1] if e[0] in ("rep", "opt") else [e])
                group = [merge(p, q) for p, q in zip(*groups, strict=True)]
                made = ["rep", group] if "rep" in kinds else ["opt", group]
                out.append(["opt", [made]] if kinds == {"rep", "opt"} else made)
            i, j = i + 1, j + 1
            p, q = next(same, (n, m))
        elif i < p:
            optional(wrapper[i])
            i += 1
        else:
            optional(page[j])
            j += 1
    return out


def infer(streams: list[list]) -> list:
    """The wrapper of some pages' whole streams."""
    wrapper: list = []
    for k, s in enumerate(streams):
        wrapper = s if not k else fold(align(wrapper, s))
    return wrapper


def expression(wrapper: list) -> str:
    """The wrapper as text: ( )+ repeated, ( )? optional, #PCDATA a slot."""
    out = []
    for e in wrapper:
        if e[0] in ("rep", "opt"):
            out.append(f"({expression(e[1])}){'+' if e[0] == 'rep' else '?'}")
        else:
            out.append({"tag": f"<{e[1]}>", "close": f"</{e[1]}>", "slot": "#PCDATA", "text": e[1].replace(LIST, "#LIST:")}[e[0]])
    return " ".join(out)


def leaves(elements: list, single: bool = True):
    """The elements within groups, and whether each isn't in a repeated one, which can't be the region."""
    for e in elements:
        if e[0] in ("rep", "opt"):
            yield from leaves(e[1], single and e[0] == "opt")
        else:
            yield e, single


def main_region(wrapper: list) -> tuple[str, int, list[str] | None]:
    """The innermost element that holds SHARE of the text that slots hold, as signature and place in the wrapper, empty and -1
    if none does; and the signatures of all that hold half of it, None without slots."""
    flat = [(e, once, i) for i, x in enumerate(wrapper) for e, once in leaves([x])]
    total = sum(e[2] for e, _, _ in flat if e[0] == "slot")
    if not total:
        return "", -1, None
    opened: list[list] = []  # signature, place, whether it stands in no repeated group, text of slots
    stack: list[list] = []
    for e, once, i in flat:
        if e[0] == "slot":
            for x in stack:
                x[3] += e[2]
        elif e[0] == "tag" and e[1].split(".")[0] in ("article", "main", "section", "div", "td", "body"):
            opened.append([e[1], i, once, 0])
            stack.append(opened[-1])
        elif e[0] == "close" and any(x[0].split(".")[0] == e[1] for x in stack):
            while stack and stack.pop()[0].split(".")[0] != e[1]:
                pass
    fit = [x for x in opened if not MARKS & set(x[0].split(".")[1:])]
    good = [x for x in fit if x[2] and x[3] >= SHARE * total]
    named = [x for x in good if x[0].split(".")[0] in MAIN]
    best = (named or good or [["", -1]])[-1]
    return best[0], best[1], sorted({x[0] for x in fit if 2 * x[3] >= total})


def template_region(wrapper: list, template: list) -> tuple[str, int, int, list[str] | None]:
    """main_region of a template, its slots being also the texts that are slots of its host's wrapper; and its place in that
    wrapper, or -1."""
    same = matches([core(e) for e in wrapper], [core(e) for e in template])
    for i, j in same:
        for (x, _), (y, _) in zip(leaves([wrapper[i]]), leaves([template[j]]), strict=True):
            if y[0] == "text" and x[0] == "slot":
                y[0] = "slot"
    region, place, halves = main_region(template)
    return region, place, {j: i for i, j in same}.get(place, -1), halves


class Wrapper:
    """A host's wrapper and the place of its region, ready to be matched with pages."""

    def __init__(self, elements: list, place: int, pages: int):
        self.cores, self.place = [core(e) for e in elements], place
        self.fixed = {i for i, e in enumerate(elements) if {"text"} == {x[0] for x, _ in leaves([e])} & {"text", "slot"}} if pages > 1 else set()

    def match(self, page: list, at: list[int]) -> tuple[int | None, set[int]]:
        """The numbers of the tokens at which the region begins, if it was met, and that hold fixed texts."""
        same = matches(self.cores, [core(e) for e in page])
        begins, ends = next((j for i, j in same if i == self.place), None), [*at[1:], at[-1] + 1] if at else []
        return None if begins is None else at[begins], {k for i, j in same if i in self.fixed for k in range(at[j], ends[j])}


def name_of(elements: list) -> str:
    """The shape of a whole stream, as a hash."""
    return hashlib.blake2b(" ".join(map(shape, elements)).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def is_fixed(page: list, begins: int, fixed: set[int]) -> bool:
    """Whether the element that a token begins has texts, all of them fixed."""
    inside, some = Regions(), False
    inside.open(page[begins])
    for k in range(begins + 1, len(page)):
        t = page[k]
        if not isinstance(t, str):
            if inside.see(t):
                break
        elif t.strip():
            if k not in fixed:
                return False
            some = True
    return some


def blocks_of(page: str | list, region: str | int | None, fixed: set[int] = frozenset()) -> list[str]:
    """The texts of the blocks of the element that a token begins, or of the first with a signature; of the whole page if region
    is None. fixed: the tokens whose texts the host's wrapper holds fixed; within a region they decide what class words mean."""
    out: list[str] = []
    now: list[str] = []
    inside, skipped = Regions(), Regions()
    found, page = region is None, tokens_of(page)

    def end():
        if text := " ".join("".join(now).split()):
            out.append(text)
        now.clear()

    def goes(k: int, t: Tag) -> bool:
        if t.name in DROPPED or t.name == "header" and not inside.depth:
            return True
        return t.marked and (not inside.depth or bool(t.marks & SURE) or is_fixed(page, k, fixed))

    for k, t in enumerate(page):
        if isinstance(t, str):
            if found and not skipped.depth:
                now.append(t)
            continue
        if not found:
            if not t.closing and (k == region if isinstance(region, int) else t.signature == region):
                found = True
                inside.open(t)
            continue
        if skipped.depth:
            if skipped.see(t):
                skipped.depth = 0
            continue
        if inside.depth and inside.see(t):
            break
        if not t.closing and t.name not in VOID and goes(k, t):
            end()
            skipped.open(t)
        elif t.name in BLOCK:
            end()
        elif t.name == "br":
            now.append(" ")
    end()
    return out


def main_text(page: str | list, region: str, begins: int | None = None, fixed: set[int] = frozenset()) -> str:
    """The page's main text: of the element that the token ``begins`` opens, else of the first with the region's signature."""
    page = tokens_of(page)
    for r in ([] if begins is None else [begins]) + ([region] if region else []):
        if texts := blocks_of(page, r, fixed):
            return "\n\n".join(texts)
    tags = [t for t in page if isinstance(t, Tag) and not t.closing]
    tags = [t for t in tags if t.name in MAIN] or [t for t in tags if t.name in ("div", "section", "td") and t.marks & CONTENT and not t.dropped]
    return "\n\n".join(blocks_of(page, tags[0].signature if tags else None, fixed))


def rows_of(rows: list[tuple], *kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


STREAM = (("host", pa.string()), ("name", pa.string()), ("pages", pa.int64()), ("stream", pa.string()))
STREAMS = "host string, name string, pages long, stream string"


def merged(rows: DataFrame, by: str, same: bool) -> DataFrame:
    """One stream for all rows of a host and by: of one shape, or aligned in the order of their names."""

    def task(batches):
        now, held, pages = None, [], 0
        for b in batches:
            for host, name, n, text, group in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                own = json.loads(text)
                if (host, group) == now:
                    held, pages = ([merge(x, y) for x, y in zip(held, own, strict=True)] if same else fold(align(held, own))), pages + n
                    continue
                if now:
                    yield rows_of([(*now, pages, json.dumps(held))], *STREAM)
                now, held, pages = (host, group), own, n
        if now:
            yield rows_of([(*now, pages, json.dumps(held))], *STREAM)

    dealt = rows.select("host", "name", "pages", "stream", F.col(by).cast("string").alias("by")).repartition("host", "by")
    return settled(dealt.sortWithinPartitions("host", "by", "name").mapInArrow(task, STREAMS))


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, name (of a shape), pages and stream of each template."""

    def task(batches):
        made: dict = {}
        size = 0
        for b in batches:
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                own = stream(page)
                key = host, name_of(own)
                if key in made:
                    n, held = made[key]
                    made[key] = n + 1, [merge(x, y) for x, y in zip(held, own, strict=True)]
                    continue
                made[key], size = (1, own), size + len(own)
                if size >= HELD:
                    yield rows_of([(*k, n, json.dumps(x)) for k, (n, x) in made.items()], *STREAM)
                    made, size = {}, 0
        if made:
            yield rows_of([(*k, n, json.dumps(x)) for k, (n, x) in made.items()], *STREAM)

    rows = pages.select(split_url(F.col(url))[0].alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return merged(rows.mapInArrow(task, STREAMS), "name", True)


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, name, region, place (of the region), wrapper (its regular expression), stream (its elements) and pages: of each
    host, with a null name, and of each template whose region isn't its host's, with a null wrapper."""
    found = templates(pages, url, html)
    now = found
    while True:
        count = now.groupBy("host").agg(F.count("*").alias("n"))
        if (count.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        dealt = now.join(settled(count), "host").withColumn("bucket", F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / FAN)))
        now = merged(dealt, "bucket", False)

    def regions(batches):
        host, wrapper = None, []
        for b in batches:
            out = []
            for h, name, n, text, of_host in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if h != host:
                    host, wrapper = h, json.loads(of_host)
                out.append((h, name, n, *template_region(wrapper, json.loads(text))))
            yield rows_of(out, *STREAM[:3], ("region", pa.string()), ("place", pa.int32()), ("in_host", pa.int32()), ("halves", pa.list_(pa.string())))

    own = found.join(now.select("host", F.col("stream").alias("of_host")), "host").select("host", "name", "pages", "stream", "of_host")
    own = settled(own.mapInArrow(regions, "host string, name string, pages long, region string, place int, in_host int, halves array<string>"))
    votes = own.filter("region <> ''").groupBy("host", "region", "in_host").agg(F.sum("pages").alias("n"))
    # the element of most pages, by name, then the place at which most of them have it
    votes = votes.groupBy("host", "region").agg(F.sum("n").alias("n"), F.max_by("in_host", F.struct("n", "in_host")).alias("place"))
    most = votes.groupBy("host").agg(F.max_by(F.struct("region", "place"), F.struct("n", "region")).alias("most"))

    def written(batches):
        for b in batches:
            yield rows_of([(h, expression(json.loads(x)), x, n) for h, x, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)], ("host", pa.string()), ("wrapper", pa.string()), ("stream", pa.string()), ("pages", pa.int64()))

    hosts = now.select("host", "stream", "pages").mapInArrow(written, "host string, wrapper string, stream string, pages long").join(most, "host", "left")
    hosts = hosts.select("host", F.lit(None).cast("string").alias("name"), F.coalesce("most.region", F.lit("")).alias("region"), F.coalesce("most.place", F.lit(-1)).alias("place"), "wrapper", "stream", "pages")
    follows = (F.col("region") == "") & (F.col("halves").isNull() | F.array_contains("halves", F.col("most.region")))
    others = own.join(most, "host").filter(~follows & ((F.col("region") != F.col("most.region")) | (F.col("in_host") != F.col("most.place"))))
    none = F.lit(None).cast("string")
    return hosts.unionByName(others.select("host", "name", "region", "place", none.alias("wrapper"), none.alias("stream"), "pages"))


def extract(pages: DataFrame, found: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row; found: hosts and templates, and their regions."""
    found = settled(found.select("host", "name", "region", "place", "stream", "pages"))
    regions = found.filter("name is null and region <> ''").select("host", "region", "place", "stream", "pages")
    others = found.filter("name is not null").select("host", "name", F.struct("region", "place").alias("own"))
    size = lambda x: x.agg(F.sum(sum(F.octet_length(F.to_json(F.struct(c))) for c in x.columns) + 100)).first()[0] or 0
    small = lambda x: F.broadcast(x) if size(x) <= MAX_BYTES else x
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("host", split_url(F.col("url"))[0])
    kind = dict(pages.dtypes)[key]
    of_host, given = F.lit(None).cast("struct<region:string,place:int,stream:string,pages:bigint>").alias("of_host"), None
    if size(regions) <= MAX_BYTES:  # by host in each worker, so that a wrapper doesn't travel with each page
        given = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["region"], r["place"], r["stream"], r["pages"]) for r in regions.collect()})
    else:
        rows, of_host = rows.join(regions, "host", "left"), F.when(F.col("region").isNotNull(), F.struct("region", "place", "stream", "pages")).alias("of_host")
    rows = rows.select("page_id", "url", "html", "host", of_host)
    of_page = F.lit(None).cast("struct<region:string,place:int>")
    if not others.isEmpty():

        def named(batches):
            for b in batches:
                names = [name_of(stream(x)) if v else None for x, v in zip(b.column("html").to_pylist(), b.column("varied").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(names, pa.string())], names=[*b.schema.names[:5], "name"])

        varied = others.select("host").distinct().withColumn("varied", F.lit(True))
        rows = rows.join(small(varied), "host", "left").select("page_id", "url", "html", "host", "of_host", "varied")
        rows = rows.mapInArrow(named, f"page_id {kind}, url string, html string, host string, of_host struct<region:string,place:int,stream:string,pages:bigint>, name string")
        rows, of_page = rows.join(small(others), ["host", "name"], "left"), F.col("own")
    rows = rows.select("page_id", "url", "html", "host", "of_host", of_page["region"].alias("own"), of_page["place"].alias("own_place"))

    def text_of(page: str, wrapper: Wrapper | None, region: str, own: str | None, own_place: int | None) -> str:
        if wrapper is None and own is None:
            return main_text(page, "")
        page = tokens_of(page)
        elements, at = placed(page)
        begins, fixed = wrapper.match(elements, at) if wrapper else (None, set())
        if own is not None:  # the template's own region, at its place in each page of the template
            region, begins = own, at[own_place] if own_place >= 0 else None
        return main_text(page, region, begins, fixed)

    def task(batches):
        held: dict = {}
        for b in blocks(batches, "html"):
            texts = []
            for page, host, joined, own, own_place in zip(*(b.column(i).to_pylist() for i in range(2, 7)), strict=True):
                if host not in held:
                    if len(held) > 1000:
                        held.clear()
                    region, place, elements, n = (joined.values() if joined else ("", -1, "", 0)) if given is None else given.value.get(host, ("", -1, "", 0))
                    held[host] = region, Wrapper(json.loads(elements), place, n) if region else None
                region, wrapper = held[host]
                texts.append(text_of(page, wrapper, region, own, own_place))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(task, f"page_id {kind}, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by the wrappers of their hosts."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, wrappers(pages))
