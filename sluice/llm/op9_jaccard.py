"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, and their components.

Sets are of 64-bit hashes of lower-case shingles; two 64-bit sums over a set tell sets apart, so equal sets are one node
from the start, however many copies there are.

1. Candidates. Sets that link share one of their first n - ceil(0.8 n) + 1 shingles in any order that is the same for all.
   Here shingles that many documents share come last, then the order is that of the hashes, so common lines and passages
   make no candidates unless nearly the whole set consists of them. Only shared first shingles go on.
2. A first round compares each set with the smallest and the largest set of each of its blocks (the sets that share a
   first shingle), by sizes and bitmaps and then whole. Verified links join most groups of near copies.
3. Only blocks that still hold several components go on, those with one smallest set together. Their sets are the leaves of a signature tree: nodes hold the
   OR of their sets' bitmaps and the range of their sizes. A dual traversal drops a pair of nodes whose sizes can't link
   or whose common bits bound the overlap below what a link needs; for two sets the bound is the size of one less the
   bits that the other lacks. Pairs of sets that remain, in different components, put sets into groups: a row a set, not a pair.
   Before that, sets leave a block in which no set of another component is near enough in size.
4. The texts of these groups' sets meet in one task a group. There trees with finer bitmaps are traversed again, each pair
   that remains is verified on the whole sets, and sets that are joined already are not compared. So a block gives at most
   one link less than it has sets, however many of its pairs are alike.
5. A block of more than CHUNK sets or WEIGHT shingles is dealt out at random, each part compared as above, ROUNDS times with
   other parts. What is then outside the block's largest component is compared with all sets of the block, part by part.

Every link lies within a block, so no link between different sets is lost but those whose ends are joined already;
components are exact (up to collisions of 64-bit hashes within two sets). What a block costs grows with its sets, but for
step 5, where it grows with its sets times those that nothing joins to its largest component.

Texts are fetched for candidates only; hot shingles are broadcast (at most HOT_KEYS as they are, more as bits of their
residues, where some others come last too, in all sets alike) and, while they are at most
FETCH, the wanted texts' keys and the split blocks' names. Tables on the way are removed when they have been used.
Rows with equal or null ids are documents of their own; a component's id is
the smallest id in it, null if it has none. Null and empty texts have no shingles, link with nothing and keep their own id.
Only id and text are read, so other columns can't clash. A very long text is a block of its own in a worker, which holds
some 30 bytes a byte of it. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import INVERSE, KeySet, Shelf, Words, blocks, keyed_text, mix, settled, table, texts_of
from .graph import components

SHINGLE, PERCENT = 5, 80
#: Documents of a shingle that comes last, and how many such shingles are broadcast as they are.
HOT, HOT_KEYS = 200, 1_000_000
#: Sets of one block that a task compares with one another, and their shingles; rounds over larger blocks; wanted texts whose keys are broadcast.
CHUNK, WEIGHT, ROUNDS, FETCH = 2_000, 10_000_000, 2, 2_000_000
LEAF = 16
COMBINE_BYTES = 16 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text and then value, their texts' numbers, and where each text's begin."""
    words = Words([t.translate(LOWER) for t in texts])
    hashes = words.hashes()
    at, values = words.windows(hashes, shingle)
    docs = words.doc[at]
    short = np.flatnonzero((words.counts() > 0) & (words.counts() < shingle))
    if len(short):
        n, start = words.counts()[short], words.first[short]
        value = n.astype(np.uint64)
        for j in range(shingle - 1):
            value = np.where(j < n, mix(value * np.uint64(INVERSE) + hashes[np.minimum(start + j, len(hashes) - 1)]), value)
        values, docs = np.concatenate([values, value]), np.concatenate([docs, short])
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])])
        values, docs = values[new], docs[new]
    return values, docs, np.searchsorted(docs, np.arange(len(texts) + 1))


def sums(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of each set."""
    total = lambda x: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])[first])
    return total(mix(values)).view(np.int64), total(mix(values ^ np.uint64(INVERSE))).view(np.int64)


def bitmap(values: np.ndarray, times: int = 2) -> bytes:
    """A bit for each shingle, in ``times`` to twice ``times`` as many bits."""
    bits = max(64, 1 << int(times * len(values) - 1).bit_length())
    out = np.zeros(bits, dtype=np.uint8)
    out[(values & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


# --- signature tree ---------------------------------------------------------------------------------------------------


def popcount(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a).sum(axis=-1, dtype=np.int64)


class Node:
    """OR of bitmaps, range of sizes, most collisions of a set's shingles on one bit; two children, or places of sets."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, spare: np.ndarray, places: np.ndarray):
        self.bits = np.bitwise_or.reduce(maps[places], axis=0)
        self.low, self.high, self.spare = int(sizes[places].min()), int(sizes[places].max()), int(spare[places].max())
        self.places, self.children = places, ()
        if len(places) > LEAF:
            half = len(places) // 2
            self.children = (Node(maps, sizes, spare, places[:half]), Node(maps, sizes, spare, places[half:]))


class Tree:
    """A signature tree over sets that were ordered by size and then by the first bits that they have."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, keys: np.ndarray):
        self.maps, self.sizes, self.keys = maps, sizes, keys
        self.spare = sizes - popcount(maps)
        order = np.lexsort((np.argmax(maps != 0, axis=1), maps[:, 0], np.log(sizes) // np.log(1.12)))
        self.root = Node(maps, sizes, self.spare, order) if len(order) else None


class Classes:
    """Classes of the numbers 0, 1, ..: label has that of each; joining two renames the smaller one."""

    def __init__(self, labels):
        _, self.label = np.unique(np.asarray(labels), return_inverse=True)
        order = np.argsort(self.label, kind="stable")
        self.members = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(self.label[order])) + 1)] if len(order) else []

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []


def alike(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all of both have one label."""
    first = label[a[0]]
    return first == label[b[0]] and bool((label[a] == first).all()) and bool((label[b] == first).all())


def may_link(a: Node, b: Node, percent: int) -> bool:
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return False
    overlap = min(a.high, b.high, int(popcount(a.bits & b.bits)) + min(a.spare, b.spare))
    return (100 + percent) * overlap >= percent * (a.low + b.low)


def traverse(x: Tree, y: Tree, percent: int, classes: Classes, apart: np.ndarray, verify) -> list[tuple[int, int]]:
    """Pairs of keys, one of each tree (or two of one), that the bounds don't exclude and verify takes, each joining two classes; pairs alike in apart are left out."""
    out: list[tuple[int, int]] = []
    stack = [(x.root, y.root)] if x.root and y.root else []
    while stack:
        a, b = stack.pop()
        p, q = x.keys[a.places], y.keys[b.places]
        if alike(classes.label, p, q) or alike(apart, p, q) or not may_link(a, b, percent):
            continue
        if a.children and (a is b or len(a.places) >= len(b.places) or not b.children):
            if a is b:
                left, right = a.children
                stack += [(left, right), (left, left), (right, right)]
            else:
                stack += [(c, b) for c in a.children]
        elif b.children:
            stack += [(a, c) for c in b.children]
        else:
            i, j = (g.ravel() for g in np.meshgrid(a.places, b.places, indexing="ij"))
            keep = (classes.label[x.keys[i]] != classes.label[y.keys[j]]) & (apart[x.keys[i]] != apart[y.keys[j]])
            if a is b:
                keep &= i < j
            i, j = i[keep], j[keep]
            n, m = x.sizes[i], y.sizes[j]
            overlap = np.minimum(n - popcount(x.maps[i] & ~y.maps[j]), m - popcount(y.maps[j] & ~x.maps[i]))
            good = (100 + percent) * overlap >= percent * (n + m)
            for k, m in zip(x.keys[i[good]].tolist(), y.keys[j[good]].tolist(), strict=True):
                if classes.label[k] != classes.label[m] and verify(k, m):
                    classes.join(k, m)
                    out.append((k, m))
    return out


def halved(maps: np.ndarray) -> np.ndarray:
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


def block_links(sizes: list, maps: list[bytes], sides: list, classes: Classes, apart: np.ndarray, percent: int, verify=lambda i, j: True) -> list[tuple[int, int]]:
    """Pairs of a block that join classes: all that may link and that verify takes, but those of one class by then.

    Sets of side 0 meet one another, those of side 1 meet those of side 2. Sets meet in trees of one bitmap width.
    """
    by: dict[tuple[int, int], list[int]] = {}
    for i, m in enumerate(maps):
        by.setdefault((len(m), sides[i]), []).append(i)

    def tree(width: int, side: int, fold: bool = False) -> Tree | None:
        own = by.get((width, side))
        if not own:
            return None
        bits = np.frombuffer(b"".join(maps[i] for i in own), dtype=np.uint64).reshape(len(own), -1)
        return Tree(halved(bits) if fold else bits, np.array([sizes[i] for i in own]), np.array(own))

    out: list[tuple[int, int]] = []
    for width, side in sorted(by):
        own, other = tree(width, side), (0, 2, 1)[side]
        meets = [own if side == 0 else tree(width, other) if side == 1 else None, tree(2 * width, other, fold=True)]
        for t in meets:
            if t is not None:
                out += traverse(own, t, percent, classes, apart, verify)
    return out


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have that similarity."""
    if len(s) > len(t):
        s, t = t, s
    if not len(s):
        return False
    at = np.searchsorted(t, s)
    both = int(np.count_nonzero(t[np.minimum(at, len(t) - 1)] == s))
    return both > 0 and 100 * both >= percent * (len(s) + len(t) - both)


# --- stages -----------------------------------------------------------------------------------------------------------


def summaries(rows: DataFrame, shingle: int) -> DataFrame:
    """Of each row: doc_id, row (a hash of its text), n, two sums d1 and d2, bitmap (kind 0). Of shingles that two or more
    sets of one part of a task share: d1 the shingle, n how many (kind 1)."""

    def task(batches):
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        size = 0

        def shared():
            nonlocal seen, held, size
            if held:
                value, count = np.unique(np.concatenate(held), return_counts=True)
                value, count = value[count > 1], count[count > 1]
                blank = lambda t: pa.nulls(len(value), t)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(value), np.int32)), blank(pa.int64()), blank(pa.int64()), pa.array(count.astype(np.int64)), pa.array(value.view(np.int64)), blank(pa.int64()), blank(pa.binary())], names=names)
            seen, held, size = set(), [], 0

        for b in blocks(batches, "text"):
            texts = texts_of(b)
            values, _, first = shingle_sets(texts, shingle)
            d1, d2 = sums(values, first)
            n = np.diff(first)
            maps = [bitmap(values[p:q]) if q > p else None for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), np.int32)), b.column("doc_id"), b.column("row"), pa.array(n.astype(np.int64)), pa.array(d1), pa.array(d2), pa.array(maps, pa.binary())], names=names)
            for i, key in enumerate(zip(d1.tolist(), d2.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    held.append(values[first[i] : first[i + 1]])
            size += sum(map(len, texts))
            if size >= COMBINE_BYTES:
                yield from shared()
        yield from shared()

    schema = "kind int, doc_id long, row long, n long, d1 long, d2 long, bitmap binary"
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(task, schema)


def first_shingles(rows: DataFrame, shingle: int, percent: int, hot: KeySet) -> DataFrame:
    """token, d1: the first shingles of each set, if another set has them too (hot ones always)."""
    spark = rows.sparkSession
    given = spark.sparkContext.broadcast(hot)

    def task(batches):
        seen: set[int] = set()
        for b in blocks(batches, "text"):
            texts = texts_of(b)
            values, docs, first = shingle_sets(texts, shingle)
            d1, _ = sums(values, first)
            if len(seen) > 200_000:
                seen.clear()
            fresh = np.zeros(len(texts), dtype=bool)
            for i, key in enumerate(d1.tolist()):
                if first[i + 1] > first[i] and key not in seen:
                    seen.add(key)
                    fresh[i] = True
            common = given.value.holds(values)
            order = np.lexsort((values, common, docs))
            rank = np.arange(len(values)) - first[docs]
            keep = (rank < prefix_length(np.diff(first), percent)[docs]) & fresh[docs]
            token, last = values[order][keep], common[order][keep]
            own = d1[docs[keep]]
            # hot tokens are shared by definition and need no gathering, so they are dealt by their sets
            yield pa.RecordBatch.from_arrays([pa.array(np.where(last, own, token.view(np.int64))), pa.array(token.view(np.int64)), pa.array(own), pa.array(last)], names=["deal", "token", "d1", "hot"])

    def shared(batches):
        """Rows come sorted by deal; of tokens that aren't hot, only those of two or more sets stay."""
        held = None
        for b in batches:
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            done = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
            if done:
                yield several([x[:done] for x in held])
                held = [x[done:] for x in held]
        if held is not None:
            yield several(held)

    def several(columns):
        _, token, d1, hot = columns
        order = np.lexsort((d1, token))
        token, d1, hot = token[order], d1[order], hot[order].astype(bool)
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (d1[1:] != d1[:-1])
        token, d1, hot = token[new], d1[new], hot[new]
        same = np.zeros(len(token) + 1, dtype=bool)
        same[1:-1] = token[1:] == token[:-1]
        keep = same[1:] | same[:-1] | hot
        return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(d1[keep])], names=["token", "d1"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(task, "deal long, token long, d1 long, hot boolean").repartition(parts, "deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(shared, "token long, d1 long")


def fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, text of the wanted rows, each once."""
    n = wanted.count()
    return rows.join(F.broadcast(wanted) if n <= FETCH else wanted, "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))


def verified(rows: DataFrame, pairs: DataFrame, nodes: DataFrame, shingle: int, percent: int, shelf: Shelf) -> DataFrame:
    """a, b: nodes of those pairs that link, judged on their whole sets."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("row").alias(f"row_{x}"))
    sized = shelf.keep(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b"))
    texts = fetched(rows, sized.select(F.col("row_a").alias("row")).union(sized.select(F.col("row_b").alias("row"))).distinct())
    one = sized.join(texts.withColumnsRenamed({"row": "row_a", "text": "text_a"}), "row_a")
    two = one.join(texts.withColumnsRenamed({"row": "row_b", "text": "text_b"}), "row_b").select("a", "b", "text_a", "text_b")

    def task(batches):
        for b in (y for x in blocks(batches, "text_a") for y in blocks(iter([x]), "text_b")):
            x, _, p = shingle_sets(texts_of(b, "text_a"), shingle)
            y, _, q = shingle_sets(texts_of(b, "text_b"), shingle)
            good = [linked(x[p[i] : p[i + 1]], y[q[i] : q[i + 1]], percent) for i in range(b.num_rows)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    out = shelf.keep(two.mapInArrow(task, "a long, b long"))
    shelf.drop(sized)
    return out


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that sizes and then bitmaps don't exclude; few bytes of each set travel for that."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("bitmap").alias(f"bitmap_{x}"))
    rows = pairs.filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").join(side("a"), "a").join(side("b"), "b")

    def task(batches):
        for batch in batches:
            keep = []
            for n, m, p, q in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bitmap_a", "bitmap_b")), strict=True):
                x, y = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                while len(x) != len(y):
                    x, y = (halved(z[None, :])[0] if len(z) > min(len(x), len(y)) else z for z in (x, y))
                overlap = min(n - int(popcount(x & ~y)), m - int(popcount(y & ~x)))
                keep.append((100 + percent) * overlap >= percent * (n + m))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(task, "a long, b long")


def near_in_size(sizes: np.ndarray, labels: np.ndarray, percent: int) -> np.ndarray:
    """Of sets in order of size, which may link by size with one of another label: with the nearest such one before or after."""
    n = len(sizes)
    new = np.concatenate([[True], labels[1:] != labels[:-1]])
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    before, after = starts[run] - 1, np.append(starts[1:], n)[run]
    down = (before >= 0) & (100 * sizes[np.maximum(before, 0)] >= percent * sizes)
    up = (after < n) & (100 * sizes >= percent * sizes[np.minimum(after, n - 1)])
    return down | up


def closed(batches, keys: int):
    """Rows that come sorted by their first columns, by their values: lists of columns' batches."""
    now, held = None, []
    for b in batches:
        names = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True))
        at = 0
        while at < len(names):
            to = at + 1
            while to < len(names) and names[to] == names[at]:
                to += 1
            if names[at] != now:
                if held:
                    yield now, held
                now, held = names[at], []
            held.append(b.slice(at, to - at))
            at = to
    if held:
        yield now, held


def compared(tasks: DataFrame, named: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, percent: int, shelf: Shelf) -> DataFrame:
    """a, b: links that join the components of the sets of each task (leader, p, q, side, node); named has row, n and component of each node, nodes its bitmap."""
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    column = lambda held, name: [x for b in held for x in b.column(name).to_pylist()]

    def by_sizes(batches):
        """Sets whose size lets them link with one of another component; rows come sorted by task and size."""
        for _, held in closed(batches, 3):
            n, comp = np.array(column(held, "n")), Classes(column(held, "component")).label
            keep = near_in_size(n, comp, percent)
            at = 0
            for b in held if keep.any() else ():
                yield b.filter(pa.array(keep[at : at + b.num_rows]))
                at += b.num_rows

    def by_bitmaps(batches):
        """Sets that may link with one of another component, and a number for those that hang together by that."""
        for name, held in closed(batches, 3):
            node, comp = column(held, "node"), column(held, "component")
            if min(comp) == max(comp):
                continue
            side = column(held, "side")
            classes = Classes(np.arange(len(node)))
            # a set that stands on both sides is one
            for i, j in _twins(node):
                classes.join(i, j)
            found = block_links(column(held, "n"), column(held, "bitmap"), side, classes, Classes(comp).label, percent)
            own = np.unique(np.array(found, dtype=np.int64))
            if len(own):
                group = classes.label[own]
                own = np.flatnonzero(np.isin(classes.label, group))  # with their twins
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x] * len(own), pa.int64()) for x in name), pa.array(classes.label[own].astype(np.int64)), pa.array([side[i] for i in own], pa.int32()), *(pa.array([c[i] for i in own.tolist()], pa.int64()) for c in (node, comp))],
                    names=["leader", "p", "q", "grp", "side", "node", "component"],
                )

    def by_texts(batches):
        for _, held in closed(batches, 4):
            sets = []
            for b in blocks(iter(held), "text"):
                values, _, first = shingle_sets(texts_of(b), shingle)
                sets += [values[p:q].copy() for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            node, side, classes = column(held, "node"), column(held, "side"), Classes(column(held, "component"))
            found = block_links([len(x) for x in sets], [bitmap(x, 8) for x in sets], side, classes, classes.label.copy(), percent, lambda i, j: linked(sets[i], sets[j], percent))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([node[x] for x in side_of], pa.int64()) for side_of in zip(*found, strict=True)], names=["a", "b"])

    sized = tasks.join(named.select("node", "component", "n"), "node").select("leader", "p", "q", "side", "node", "component", "n")
    sized = sized.repartition(parts, "leader", "p", "q").sortWithinPartitions("leader", "p", "q", "n").mapInArrow(by_sizes, "leader long, p long, q long, side int, node long, component long, n long")
    sets = sized.join(nodes.select("node", "bitmap"), "node").select("leader", "p", "q", "side", "node", "component", "n", "bitmap")
    groups = shelf.keep(sets.repartition(parts, "leader", "p", "q").sortWithinPartitions("leader", "p", "q").mapInArrow(by_bitmaps, "leader long, p long, q long, grp long, side int, node long, component long"))
    wanted = groups.join(named.select("node", "row"), "node")
    texts = fetched(rows, wanted.select("row").distinct())
    whole = wanted.join(texts, "row").select("leader", "p", "q", "grp", "side", "node", "component", "text")
    out = shelf.keep(whole.repartition(parts, "leader", "p", "q", "grp").sortWithinPartitions("leader", "p", "q", "grp").mapInArrow(by_texts, "a long, b long"))
    shelf.drop(groups)
    return out


def _twins(node: list) -> list[tuple[int, int]]:
    first: dict = {}
    return [(first[x], i) for i, x in enumerate(node) if first.setdefault(x, i) != i]


def few(df: DataFrame) -> DataFrame:
    """To be broadcast if it has at most FETCH rows."""
    return F.broadcast(df) if df.count() <= FETCH else df


def block_sets(entries: DataFrame, named: DataFrame, shelf: Shelf) -> DataFrame:
    """leader, node: the sets of blocks of several components; blocks with one smallest set are one, so a set travels once for all shingles of a passage."""
    inside = entries.join(named.select("d1", "node", "component"), "d1")
    ends = inside.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("leader")).filter("low < high")
    ends = shelf.keep(ends.select("token", "leader"))
    out = shelf.keep(inside.join(ends, "token").select("leader", "node").distinct())
    shelf.drop(ends)
    return out


def tree_links(entries: DataFrame, nodes: DataFrame, rows: DataFrame, links: DataFrame, shingle: int, percent: int, shelf: Shelf) -> DataFrame:
    """links, and those that signature trees find besides."""

    def with_components(now: DataFrame) -> DataFrame:
        named = nodes.select("d1", "node", "row", "n").join(components(now, shelf), "node", "left")
        return shelf.keep(named.withColumn("component", F.coalesce("component", "node")))

    def several(sets: DataFrame, named: DataFrame) -> DataFrame:
        """leader of the blocks that hold several components still."""
        ends = sets.join(named.select("node", "component"), "node").groupBy("leader").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        return ends.filter("low < high").select("leader")

    named = with_components(links)
    sets = block_sets(entries, named, shelf)
    size = sets.join(nodes.select("node", "n"), "node").groupBy("leader").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / WEIGHT)).cast("long").alias("chunks"))
    large = shelf.keep(size.filter("chunks > 1"))
    if large.isEmpty():
        tasks = sets.select("leader", F.lit(0).cast("long").alias("p"), F.lit(-1).cast("long").alias("q"), F.lit(0).alias("side"), "node")
        return links.unionByName(compared(tasks, named, nodes, rows, shingle, percent, shelf))
    for n in range(ROUNDS):
        part = F.pmod(F.xxhash64("node", "leader", F.lit(n)), F.coalesce("chunks", F.lit(1)))
        tasks = sets.join(few(large), "leader", "left" if n == 0 else "inner").select("leader", part.alias("p"), F.lit(-1).cast("long").alias("q"), F.lit(0).alias("side"), "node")
        links = links.unionByName(compared(tasks, named, nodes, rows, shingle, percent, shelf))
        shelf.drop(named)
        named = with_components(links)
        still = shelf.keep(several(sets.join(few(large), "leader", "left_semi"), named))
        was, large = large, shelf.keep(large.join(few(still), "leader", "left_semi"))
        shelf.drop(was, still)
        if large.isEmpty():
            return links
    return links.unionByName(compared(remaining(sets.join(few(large), "leader"), named, shelf), named, nodes, rows, shingle, percent, shelf))


def remaining(sets: DataFrame, named: DataFrame, shelf: Shelf) -> DataFrame:
    """Tasks that compare what is outside a block's largest component (side 1, parts p) with all its sets (side 2, parts q)."""
    inside = shelf.keep(sets.join(named.select("node", "component"), "node"))
    most = inside.groupBy("leader", "component").agg(F.count("*").alias("n")).groupBy("leader").agg(F.max(F.struct("n", "component"))["component"].alias("most"), F.sum("n").alias("all"))
    most = shelf.keep(most)
    marked = inside.join(few(most), "leader").withColumn("out", F.col("component") != F.col("most"))
    rest = shelf.keep(marked.groupBy("leader").agg(F.greatest(F.ceil(F.count_if("out") * F.max("chunks") / F.count("*")), F.lit(1)).cast("long").alias("outs")))
    marked = marked.join(few(rest), "leader")
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(-1)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = marked.filter("out").select("leader", part("outs").alias("p"), every("chunks").alias("q"), F.lit(1).alias("side"), "node")
    two = marked.select("leader", every("outs").alias("p"), part("chunks").alias("q"), F.lit(2).alias("side"), "node")
    return one.unionByName(two)


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, component (of its set, as a node) and component_id of each row."""
    shelf = Shelf(docs.sparkSession, "jaccard")
    try:
        return settled(_components_of(docs, shingle, percent, key, text, hot, shelf))
    finally:
        shelf.close()


def _components_of(docs: DataFrame, shingle: int, percent: int, key: str, text: str, hot: int, shelf: Shelf) -> DataFrame:
    rows = keyed_text(docs, key, text).withColumn("row", F.xxhash64("text"))
    made = shelf.keep(summaries(rows, shingle))
    sets = shelf.keep(made.filter("kind = 0").select("doc_id", "row", "n", "d1", "d2"))
    nodes = made.filter("kind = 0 and n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    nodes = shelf.keep(nodes)
    twice = nodes.groupBy("d1").agg(F.count("*").alias("times")).filter("times > 1")  # sets that one sum doesn't tell apart
    if twice.isEmpty():
        nodes = nodes.withColumn("node", F.col("d1"))
    else:
        nodes = shelf.keep(nodes.join(twice, "d1", "left").withColumn("node", F.when(F.col("times") > 1, F.xxhash64("d1", "d2")).otherwise(F.col("d1"))).drop("times"))
    many = made.filter("kind = 1").groupBy("d1").agg(F.sum("n").alias("n")).filter(F.col("n") > hot)
    many = shelf.keep(many.select("d1"))
    shelf.drop(made)
    entries = shelf.keep(first_shingles(rows, shingle, percent, KeySet(many, "d1", HOT_KEYS)))

    # aggregates are kept before they are joined: a join of plain shuffles can be split where a key is hot
    ends = shelf.keep(entries.groupBy("token").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).filter("low < high"))
    starred = entries.join(ends, "token").select("d1", F.explode(F.array("low", "high")).alias("other")).filter("d1 <> other")
    starred = starred.select(F.least("d1", "other").alias("x"), F.greatest("d1", "other").alias("y")).distinct()
    name = lambda x, y: nodes.select(F.col("d1").alias(x), F.col("node").alias(y), F.col("n").alias(f"n_{y}"))
    pairs = starred.join(name("x", "a"), "x").join(name("y", "b"), "y").select("a", "b", "n_a", "n_b")
    links = verified(rows, likely(pairs, nodes, percent), nodes, shingle, percent, shelf)
    shelf.drop(ends)

    links = tree_links(entries, nodes, rows, links, shingle, percent, shelf)
    whole = nodes.select("d1", "d2", "node", "least").join(components(links, shelf), "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    found = shelf.keep(whole.join(ids, "component").select("d1", "d2", "component", "component_id"))
    out = sets.join(found, ["d1", "d2"], "left")
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, shingles of five words, similarity 0.8."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
