"""SentencePiece encoding and decoding, and sampled segmentations without replacement.

``encode`` and ``decode`` are the library's. ``sample`` draws k distinct segmentations of each text by Gumbel top-k: all
segmentations get independent Gumbel perturbations of their log probabilities, and the k largest come out in order, found
by a best-first (A*) search that never lists them. A subspace of segmentations (a path through the lattice up to a node,
and arcs excluded there) has an exact total mass from a backward pass, so the maximum of its perturbations is one Gumbel
variable, truncated at its parent's; the search opens the subspace with the largest maximum, draws its best segmentation
by walking the lattice forward, and splits what is left at the nodes of that walk. The next maximum after the k-th is the
threshold kappa; a segmentation's inclusion score is 1 - exp(-exp(log p - kappa)), or 1 if there are no more.

The lattice's arcs are the pieces of the vocabulary that stand in the text, with bytes for characters it lacks. Its log
weights are the model's scores if these are log probabilities, else (a BPE model's scores are merge ranks) minus the log
of the rank, times alpha. No piece crosses the place before a space, so the lattice falls into units. A worker lays out each
distinct unit once, keeps it for later blocks while there are at most KEPT states, and walks all texts of a block at once with
numpy: one step a piece of the longest unit. Searches of a block go in step, a segmentation each. Chances are 32-bit thresholds within a state, whatever its number. A text
without spaces is one unit, which takes some 300 bytes a character while it is laid out.

Random numbers come from the seed, the row's key and its text alone (those of walks from a hash of these, the unit's place and
the step), so retries and other partitionings draw the same. Each row is
handled by itself, in blocks of bounded size, without a shuffle. Null and empty texts have one segmentation, the empty one.
Rows with equal ids and texts draw the same. Only id and text are read, so other columns can't clash. As pieces spell a space
as U+2581, that character in a text comes back as a space. The query returns samples, and their decoded texts' checksums; encode
and decode are functions beside it. A text with fewer than k segmentations gives all it has. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, keyed_text, mix, table

MODEL = "piece_bpe_32k.model"
SAMPLES, ALPHA, SEED = 2, 1.0, 20240229
#: Largest chance.
ALL = (1 << 32) - 1
#: Bytes of text whose units are looked up together; states of units that a worker keeps for later texts.
LAID_OUT, KEPT = 2 << 20, 1_200_000
SPACE = "▁"
UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long, text_crc32 long"


class Lattice:
    """A model's pieces with weights, and their hashes by length."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.vocab_size()
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        scores = {i: m.get_score(i) for i in plain}
        ranked = all(s == int(s) and s <= 0 for s in scores.values())
        weight = {i: (-math.log(2 - s) if ranked else s) * alpha for i, s in scores.items()}
        if any(SPACE in m.id_to_piece(i).lstrip(SPACE) for i in plain):
            raise ValueError("a piece crosses the place before a space")
        self.byte = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(size) if m.is_byte(i)}
        self.byte_weight = min(weight.values(), default=0.0)
        self.unknown = m.unk_id()
        self.bytes_of = [b""] * size
        for i in plain:
            self.bytes_of[i] = m.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        by: dict[int, dict[str, int]] = {}  # by length: beginnings of pieces, and the piece's id, or -1
        for i in plain:
            piece = m.id_to_piece(i)
            for n in range(1, len(piece)):
                by.setdefault(n, {}).setdefault(piece[:n], -1)
            by.setdefault(len(piece), {})[piece] = i
        self.longest = max(by, default=1)
        self.pieces = {}  # by length: sorted hashes, ids, weights
        for n, own in by.items():
            h = np.zeros(len(own), dtype=np.uint64)
            points = code_points("".join(own)).reshape(len(own), n)
            for j in range(n):
                h = mix(h + points[:, j])
            order = np.argsort(h)
            self.pieces[n] = h[order], np.array(list(own.values()))[order], np.array([weight.get(i, 0.0) for i in own.values()])[order]

    def bytes_ids(self, point: int) -> list[int]:
        """The ids of a character that is no piece."""
        return [self.byte.get(b, self.unknown) for b in chr(point).encode()]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


@lru_cache(maxsize=2)
def load(path: str, alpha: float = ALPHA) -> Lattice:
    return Lattice(path, alpha)


class Units(dict):
    """A number for each unit, in the order in which they come; ``fresh`` lists those of new ones.

    The key of a unit with one space before it is what follows that space, which has none itself; see key_of and unit_of.
    """

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        n = self[key] = len(self)
        return n

    def numbers(self, text: str) -> np.ndarray:
        if text[:1] == SPACE and SPACE + SPACE not in text:
            keys = text[1:].split(SPACE)
        else:
            keys = list(map(key_of, UNITS.findall(text)))
        return np.fromiter(map(self.__getitem__, keys), dtype=np.int64, count=len(keys))


def key_of(unit: str) -> str:
    if unit[0] != SPACE:
        return unit + SPACE
    return unit if unit[1:2] == SPACE else unit[1:]


def unit_of(key: str) -> str:
    if SPACE not in key:
        return SPACE + key
    return key if key[0] == SPACE else key[:-1]


class Table:
    """The lattice of all units of some texts: states are the characters of distinct units, in one numbering."""

    def __init__(self, lattice: Lattice, texts: list[str] = ()):
        self.lattice, self.units = lattice, Units()
        self.points = np.empty(0, dtype=np.uint64)
        self.base = self.stop = self.ends = np.empty(0, dtype=np.int64)
        self.piece = self.starts = np.empty(0, dtype=np.int32)
        self.first = np.zeros(1, dtype=np.int64)  # of each state's arcs
        self.cum, self.logs = np.empty(0, dtype=np.uint32), np.empty(0)
        self.words = self.add(texts)

    def add(self, texts: list[str]) -> list[np.ndarray]:
        """The units of each text, laid out if they are new."""
        words = [self.units.numbers(self.lattice.model.normalize(t)) for t in texts]
        if self.units.fresh:
            self.lay_out(list(map(unit_of, self.units.fresh)))
            self.units.fresh.clear()
        return words

    def lay_out(self, units: list[str]) -> None:
        lattice = self.lattice
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        points = code_points("".join(units))
        n = len(points)
        stop = np.cumsum(sizes)  # a unit's end has the number of the next unit's first state; it is never walked from
        room = np.repeat(stop, sizes) - np.arange(n)  # characters from a state to the end of its unit
        starts, lengths, pieces, weights = [], [], [], []
        h, at = np.zeros(n, dtype=np.uint64), np.arange(n)
        single = np.zeros(n, dtype=bool)
        for k in range(1, lattice.longest + 1):
            long = room[at] >= k
            at, h = at[long], h[long]
            h = mix(h + points[at + k - 1])
            hashes, ids, weight = lattice.pieces[k]
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            begun = hashes[place] == h  # what no piece begins with can't grow into one
            at, h, place = at[begun], h[begun], place[begun]
            whole = ids[place] >= 0
            if k == 1:
                single[at[whole]] = True
            starts.append(at[whole].astype(np.int32))
            lengths.append(np.full(int(whole.sum()), k, dtype=np.int32))
            pieces.append(ids[place[whole]].astype(np.int32))
            weights.append(weight[place[whole]])
        odd = np.flatnonzero(~single)
        width = 1 + (points[odd] > 0x7F).astype(np.int64) + (points[odd] > 0x7FF) + (points[odd] > 0xFFFF)
        of_byte = np.array([lattice.byte.get(x, lattice.unknown) for x in range(128)])
        lone = np.where(width == 1, of_byte[np.minimum(points[odd], 127).astype(np.int64)], -1 if lattice.byte else lattice.unknown)
        # longer pieces first, as they are likelier: a walk then looks at few arcs of a state
        starts, lengths, pieces, weights = (x[::-1] for x in (starts, lengths, pieces, weights))
        starts, lengths = np.concatenate([*starts, odd.astype(np.int32)]), np.concatenate([*lengths, np.ones(len(odd), dtype=np.int32)])
        pieces, weights = np.concatenate([*pieces, lone.astype(np.int32)]), np.concatenate([*weights, lattice.byte_weight * width])
        beta = np.zeros(n + 1)  # log mass from a state to the end of its unit; ends stay 0 as each start is read from inside
        order = np.argsort(starts, kind="stable")
        starts, lengths, pieces, weights = starts[order], lengths[order], pieces[order], weights[order]
        order = np.argsort(room[starts].astype(np.uint16) if n and room.max() < 1 << 16 else room[starts], kind="stable") if n else np.empty(0, np.int64)
        ends = starts + lengths
        last = room[starts] == lengths  # arcs to the end of a unit
        depth = room[starts[order]]
        cuts = np.searchsorted(depth, np.arange(1, (int(depth[-1]) if n else 0) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            own = order[a:b]
            s = starts[own]
            value = weights[own] + np.where(last[own], 0.0, beta[ends[own]])
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            top = np.maximum.reduceat(value, head)
            spread = np.repeat(top, np.diff(np.concatenate([head, [len(s)]])))
            beta[s[head]] = top + np.log(np.add.reduceat(np.exp(value - spread), head))
        chance = np.exp(weights + np.where(last, 0.0, beta[ends]) - beta[starts])
        first = np.concatenate([[0], np.cumsum(np.bincount(starts, minlength=n))])
        # sums stay within a state, and chances become whole numbers: what is drawn doesn't depend on what else is laid out
        share = chance / np.add.reduceat(chance, first[:-1])[starts] if n else chance
        logs = np.log(np.maximum(share, 1e-320))
        rank = np.arange(len(starts)) - first[starts]
        for k in range(1, int(rank.max(initial=0)) + 1):
            at = np.flatnonzero(rank == k)
            share[at] += share[at - 1]
        cum = np.minimum(np.rint(share * ALL), ALL).astype(np.uint32)
        cum[first[1:] - 1] = ALL
        at, arcs = len(self.points), len(self.starts)
        self.points = np.concatenate([self.points, points])
        self.base, self.stop = np.concatenate([self.base, stop - sizes + at]), np.concatenate([self.stop, stop + at])
        self.first = np.concatenate([self.first[:-1], first + arcs])
        self.starts, self.ends = np.concatenate([self.starts, starts + np.int32(at)]), np.concatenate([self.ends, ends.astype(np.int64) + at])
        self.piece, self.cum, self.logs = np.concatenate([self.piece, pieces]), np.concatenate([self.cum, cum]), np.concatenate([self.logs, logs])

    def ids(self, arcs: np.ndarray) -> np.ndarray:
        """The pieces' ids along arcs."""
        found = self.piece[arcs]
        if (found >= 0).all():
            return found
        return np.array([y for x, a in zip(found.tolist(), arcs.tolist(), strict=True) for y in ([x] if x >= 0 else self.lattice.bytes_ids(int(self.points[self.starts[a]])))], dtype=np.int64)

    def walk(self, words: np.ndarray, keys: np.ndarray, at: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random paths through units: for each arc the place of its unit and the arc. Units ``at`` some places begin at these
        states instead of their first; keys decide what is drawn in each unit."""
        state, stop, place = self.base[words], self.stop[words], np.arange(len(words))
        state[at] = states
        places, arcs, step = [], [], 0
        alive = state < stop
        while True:
            if not alive.all():
                state, stop, place, keys = state[alive], stop[alive], place[alive], keys[alive]
            if not len(place):
                break
            drawn = (mix(keys + np.uint64(step)) >> np.uint64(32)).astype(np.uint32)
            arc = self.first[state]
            beyond = np.flatnonzero(self.cum[arc] < drawn)
            while len(beyond):
                arc[beyond] += 1
                beyond = beyond[self.cum[arc[beyond]] < drawn[beyond]]
            places.append(place)
            arcs.append(arc)
            state, step = self.ends[arc], step + 1
            alive = state < stop
        if not places:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        places, arcs = np.concatenate(places), np.concatenate(arcs)
        order = np.argsort(places, kind="stable")
        return places[order], arcs[order]

    def state_of(self, arc: int) -> int:
        return int(self.starts[arc])


def truncated(log_mass: np.ndarray, top: float, rng: np.random.Generator) -> np.ndarray:
    """Gumbel variables with these log masses, each at most top."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(log_mass), -np.inf, log_mass - np.log(np.exp(log_mass - top) - np.log(rng.random(len(log_mass)))))


class Search:
    """The best-first search of one text; it opens one subspace a step."""

    def __init__(self, t: Table, words: np.ndarray, k: int, seed: int):
        self.t, self.words, self.k, self.seed = t, words, k, seed
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.out: list[tuple[np.ndarray, float, float]] = []
        # (-maximum, tie, places and arcs up to the node, log probability so far, arcs excluded at the node, its unit's place, its state)
        none = np.empty(0, np.int64)
        self.heap: list[tuple] = [(math.log(-math.log(self.rng.random())), 0, none, none, 0.0, (), 0, None)]
        self.ties = 1

    def opened(self) -> tuple[np.ndarray, int | None]:
        """The units that are to be walked, and the state in which the first begins, if not its first."""
        value, _, self.places, self.arcs, self.log_prob, self.excluded, self.unit, self.state = heapq.heappop(self.heap)
        self.value, self.head = -value, len(self.arcs)
        if self.state is None:
            return self.words, None
        t = self.t
        open_arcs = np.array([x for x in range(t.first[self.state], t.first[self.state + 1]) if x not in self.excluded], dtype=np.int64)
        chance = np.exp(t.logs[open_arcs] - t.logs[open_arcs].max())
        arc = int(open_arcs[min(int(np.searchsorted(np.cumsum(chance), self.rng.random() * chance.sum(), side="right")), len(open_arcs) - 1)])
        self.places, self.arcs = np.append(self.places, self.unit), np.append(self.arcs, arc)
        return self.words[self.unit :], int(t.ends[arc])

    def keys(self) -> np.ndarray:
        """A number for each unit that is to be walked."""
        place = np.arange(self.unit, len(self.words)).astype(np.uint64)
        return mix((place << np.uint64(24) | np.uint64(len(self.out))) ^ np.uint64(self.seed))

    def walked(self, p: np.ndarray, a: np.ndarray) -> None:
        """Takes the segmentation that the walk ended, and splits what is left of the subspace at its nodes."""
        t, head, state = self.t, self.head, self.state
        places, arcs = np.concatenate([self.places, p + self.unit]), np.concatenate([self.arcs, a])
        logs = t.logs[arcs[head:]]
        before = self.log_prob + np.concatenate([[0.0], np.cumsum(logs)])
        self.out.append((arcs, float(before[-1]), self.value))
        if not len(logs):
            return
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(0.0, -np.expm1(logs)))
        rest[logs > -1e-13] = -np.inf
        if state is not None:
            left = [x for x in range(t.first[state], t.first[state + 1]) if x not in self.excluded and x != arcs[head]]
            rest[0] = math.log(max(math.fsum(np.exp(t.logs[left])), 5e-324)) if left else -math.inf
        found = truncated(before[:-1] + rest, self.value, self.rng)
        want = self.k + 1 - len(self.out)  # no more of one path's subspaces can matter
        best = np.argpartition(-found, want - 1)[:want] if len(found) > want else np.arange(len(found))
        for i in best[np.isfinite(found[best])].tolist():
            gone = (*self.excluded, int(arcs[head])) if i == 0 and state is not None else (int(arcs[head + i]),)
            heapq.heappush(self.heap, (-float(found[i]), self.ties, places[: head + i], arcs[: head + i], float(before[i]), gone, int(places[head + i]), t.state_of(int(arcs[head + i]))))
            self.ties += 1


def top_k(t: Table, words: list[np.ndarray], k: int, seeds: list[int]) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
    """For each text (arcs, log probability, perturbed) of the k segmentations with the largest perturbations, and the next one's, or -inf."""
    searches = [Search(t, w, k, s) for w, s in zip(words, seeds, strict=True)]
    for _ in range(k):
        going = [x for x in searches if x.heap]
        opened = [x.opened() for x in going]
        if not going:
            break
        ends = np.cumsum([len(w) for w, _ in opened])
        begins = ends - [len(w) for w, _ in opened]
        inside = [i for i, (_, state) in enumerate(opened) if state is not None]
        p, a = t.walk(np.concatenate([w for w, _ in opened]), np.concatenate([x.keys() for x in going]), begins[inside], np.array([opened[i][1] for i in inside], dtype=np.int64))
        cuts = np.searchsorted(p, np.append(begins, ends[-1])).tolist()
        for x, begin, c, d in zip(going, begins.tolist(), cuts, cuts[1:], strict=False):
            x.walked(p[c:d] - begin, a[c:d])
    return [(x.out, -x.heap[0][0] if x.heap else -math.inf) for x in searches]


def inclusion(log_prob: float, kappa: float) -> float:
    return 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(log_prob - kappa, 700.0)))


def seed_of(seed: int, key, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{key}|".encode() + text.encode(), digest_size=8).digest(), "little")


def decoded(lattice: Lattice, ids: list[int]) -> bytes:
    """The text that pieces stand for, without the space before it."""
    raw = b"".join(map(lattice.bytes_of.__getitem__, ids))
    return raw[1:] if raw.startswith(b" ") else raw


def sample(docs: DataFrame, model_path: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Up to k rows for each row: distinct segmentations by decreasing perturbation; with_ids adds the pieces' ids."""

    def task(batches):
        lattice = load(model_path, alpha)
        t = Table(lattice)
        for b in blocks(batches, "text", LAID_OUT):
            texts = b.column("text").to_pylist()
            if len(t.points) > KEPT:
                t = Table(lattice)
            rows, ids_of = [], b.column("doc_id").to_pylist()
            drawn = top_k(t, t.add(texts), k, [seed_of(seed, doc, content) for doc, content in zip(ids_of, texts, strict=True)])
            for doc, (found, kappa) in zip(ids_of, drawn, strict=True):
                for i, (arcs, log_prob, value) in enumerate(found):
                    ids = t.ids(arcs)
                    rows.append((doc, i + 1, len(ids), log_prob, value, inclusion(log_prob, kappa), zlib.crc32(ids.astype("<u4")), zlib.crc32(decoded(lattice, ids.tolist())), ids if with_ids else None))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], kinds[i]) for i in range(len(names))], names=names)

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return keyed_text(docs, key, text).mapInArrow(task, schema)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the ids that the library gives each text."""

    def task(batches):
        model = load(model_path).model
        for b in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.encode(b.column("text").to_pylist(), num_threads=1), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return keyed_text(docs, key, text).mapInArrow(task, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the text of each row's ids; null ids are none."""

    def task(batches):
        lattice = load(model_path)
        for b in batches:
            texts = [decoded(lattice, x or []).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(task, "doc_id long, text string")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of each document, and the checksum of the text that they decode to."""
    import public_tokenizers

    return sample(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
