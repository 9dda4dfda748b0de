"""Sampled segmentations of whole texts by a SentencePiece vocabulary, and decoding.

All ways to cut a text into pieces form a lattice.  A cut has weight exp(sum of alpha * score - cost over its pieces).
The operator draws k distinct cuts without replacement by the Gumbel top-k trick: give every cut's log probability
Gumbel noise and take the k largest.  The cuts are never listed.  A best-first (A-star) search splits the set of cuts
top-down: the largest noisy value of a set is known exactly from its total probability, so the first cut is an ordinary
sample, and the rest of the set falls apart into one set per word of "same before this word, other at this word", each
with a Gumbel maximum truncated at the value already taken; the best of them is split next.

Pieces have blanks at their front only, so the lattice of a text is a chain of the lattices of its words (a word is what
starts at a blank that follows a non-blank), and each distinct word's lattice is built once for a slice of texts.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = "▁"
_SLICE = 125_000  # characters handled at once


@dataclass(frozen=True)
class Sampling:
    samples: int = 2  # distinct cuts per text; fewer if the text has fewer
    alpha: float = 2e-4  # weight of a piece's score
    cost: float = 3.0  # nats that each piece costs, so that long pieces are likelier
    seed: int = 0


class Vocabulary:
    """Piece bytes (blanks as 0x20), scores and, once it is asked for, a byte trie of the pieces."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.pieces = [b""] * size  # control pieces decode to nothing
        scores = np.zeros(size)
        self.byte_ids = np.full(256, sp.unk_id(), np.int32)
        self.ordinary = []
        for i in range(size):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[1:-1], 16)
                self.pieces[i], self.byte_ids[value] = bytes([value]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                scores[i] = sp.get_score(i)
                self.pieces[i] = sp.id_to_piece(i).replace(BLANK, " ").encode()
                self.ordinary.append(i)
        # pieces that merging never makes have a score far below all others; they count as the least of the others
        self.scores = np.maximum(scores, scores[scores > -1e8].min())
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.begins = np.cumsum(self.lengths) - self.lengths

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(next node by row and byte, row of each node that has children, piece that ends at each node), -1 for none."""
        nodes: dict[bytes, int] = {b"": 0}
        for i in self.ordinary:
            for n in range(1, len(self.pieces[i]) + 1):
                nodes.setdefault(self.pieces[i][:n], len(nodes))
        row = {n: r for r, n in enumerate(sorted({nodes[x[:-1]] for x in nodes if x}))}  # the root is the first
        step = np.full((len(row), 256), -1, np.int32)
        rows = np.array([row.get(n, -1) for n in range(len(nodes))], np.int32)
        for x, n in nodes.items():
            if x:
                step[row[nodes[x[:-1]]], x[-1]] = n
        end = np.full(len(nodes), -1, np.int32)
        end[[nodes[self.pieces[i]] for i in self.ordinary]] = self.ordinary
        return step, rows, end

    @staticmethod
    def shared(spark: SparkSession, model_file: str):
        """The model file as a broadcast; a worker keeps its value, and so the tables made from it, from task to task."""
        with open(model_file, "rb") as f:
            return spark.sparkContext.broadcast({"model": f.read()})

    @classmethod
    def of(cls, kept: dict) -> Vocabulary:
        return kept.get("vocabulary") or kept.setdefault("vocabulary", cls(kept["model"]))

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of ids: blanks for blank marks, bytes joined, the added first blank dropped."""
        n = self.lengths[ids]
        at = np.repeat(self.begins[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.bytes[at].tobytes()[1:].decode("utf-8", "replace")


def normalised(text: str | None) -> bytes:
    """What is cut up: a blank and the text's bytes, blank marks in it as blanks; nothing for an empty text."""
    return b" " + text.replace(BLANK, " ").encode("utf-8", "replace") if text else b""


def split_words(line: bytes) -> list[bytes]:
    """The line's words with the blanks before them; their concatenation is the line."""
    parts = line.split(b" ")  # parts[0] is empty, as the line starts with a blank
    if b"" not in parts[1:]:
        return [b" " + p for p in parts[1:]]
    out, blanks = [], 0
    for p in parts[1:]:
        blanks += 1
        if p:
            out.append(b" " * blanks + p)
            blanks = 0
    if blanks:
        out.append(b" " * blanks)
    return out


class Lattice:
    """The lattices of distinct words, laid out one after the other over their joined bytes.

    Edges are sorted by the byte they start at, long ones first.  ``log_p`` is an edge's log probability given its
    start, ``upto`` the probability of it and the edges before it from there, ``first`` the first edge of each byte.
    """

    def __init__(self, words: list[bytes], vocab: Vocabulary, how: Sampling):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(sizes) - sizes
        self.stop = self.start + sizes
        data = np.frombuffer(b"".join(words), np.uint8)
        stop = np.repeat(self.stop, sizes)
        spots = np.flatnonzero((data & 0xC0) != 0x80)  # starts of characters
        spots = spots.astype(np.int32) if len(data) < 1 << 31 else spots
        at, here, node_row = spots, spots.copy(), np.zeros(len(spots), np.int32)
        found = []
        step, row, end = vocab.trie
        step = step.ravel()
        while len(at):  # all starts walk down the trie together
            node = step.take(node_row * 256 + data.take(here))
            live = np.flatnonzero(node >= 0)
            at, here, node = at.take(live), here.take(live) + 1, node.take(live)
            piece = end.take(node)
            hit = np.flatnonzero(piece >= 0)
            found.append((at.take(hit), here.take(hit), piece.take(hit)))
            node_row = row.take(node)
            go = np.flatnonzero((node_row >= 0) & (here < stop.take(at)))
            at, here, node_row = at.take(go), here.take(go), node_row.take(go)
        found.reverse()  # long pieces first: they are the likely ones
        a, b, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        del found, at, here, node_row
        # a character without a piece of its own goes byte by byte
        size = np.diff(np.append(spots, len(data)))
        after = np.zeros(len(data) + 1, np.int64)
        after[spots] = spots + size
        whole = np.zeros(len(data) + 1, bool)
        whole[a[b == after[a]]] = True
        lone, n = spots[~whole[spots]], size[~whole[spots]]
        single = np.repeat(lone - np.cumsum(n) + n, n) + np.arange(n.sum())
        weight = np.concatenate([vocab.scores[piece] * how.alpha - how.cost,
                                 np.full(len(single), vocab.scores.min() * how.alpha - how.cost)])
        a, b = np.concatenate([a, single]), np.concatenate([b, single + 1])
        piece = np.concatenate([piece, vocab.byte_ids[data[single]]])
        order = np.argsort(a, kind="stable")
        a, self.b, self.piece, weight = a.take(order), b.take(order), piece.take(order).astype(np.int32), weight.take(order)
        self.many = np.bincount(a, minlength=len(data))  # edges per byte
        self.first = np.cumsum(self.many) - self.many
        # total weight from each byte to its word's end, all words together, from the ends backwards
        beta, x = np.zeros(len(data) + 1), np.empty(len(a))
        left = stop[a] - a if len(a) else a
        most = int(left.max(initial=0))
        order = np.argsort(left.astype(np.uint16) if most < 1 << 16 else left, kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(left, minlength=most + 1)))
        # what follows an edge: the byte it ends at, or past a word's end the last place of beta, which stays zero
        then = np.where(self.b == stop.take(a), len(data), self.b) if len(a) else a
        head = np.append(True, a[1:] != a[:-1])
        for d in range(1, most + 1):
            e = order[cuts[d]:cuts[d + 1]]
            if len(e):
                value = weight.take(e) + beta.take(then.take(e))
                heads = np.flatnonzero(head.take(e))
                top = np.maximum.reduceat(value, heads)
                n = np.diff(np.append(heads, len(e)))
                beta[a.take(e.take(heads))] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), heads))
                x[e] = value
        self.log_p = x - beta.take(a)
        total = np.cumsum(np.exp(self.log_p))
        self.upto = total - np.append(0.0, total).take(self.first.take(a))

    def sample(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One cut of each word: (pieces of all words in order, number of pieces and log probability of each word)."""
        begin = self.start.take(word)
        at, who = begin, np.arange(len(word))
        stop, key = self.stop.take(word), seed
        log_p, count = np.zeros(len(word)), np.zeros(len(word), np.int64)
        steps = []
        while len(who):
            e, many = self.first.take(at), self.many.take(at)
            open_ = np.flatnonzero(many > 1)
            u = _uniform(key.take(open_) + (at.take(open_) - begin.take(who.take(open_))).astype(np.uint64))
            edge = e.take(open_)
            final = edge + many.take(open_) - 1
            while len(open_):  # on to the edge that u falls to
                on = np.flatnonzero((u >= self.upto.take(edge)) & (edge < final))
                open_, u, final, edge = open_.take(on), u.take(on), final.take(on), edge.take(on) + 1
                e[open_] = edge
            steps.append((who, self.piece.take(e)))
            log_p[who] += self.log_p.take(e)
            count[who] += 1
            at = self.b.take(e)
            go = np.flatnonzero(at < stop)
            at, who, stop, key = at.take(go), who.take(go), stop.take(go), key.take(go)
        place = np.cumsum(count) - count
        pieces = np.empty(int(count.sum()), np.int32)
        for s, (w, piece) in enumerate(steps):
            pieces[place[w] + s] = piece
        return pieces, count, log_p

    def path(self, word: int, pieces: np.ndarray) -> list[int]:
        """The edges of a cut of one word."""
        at, out = int(self.start[word]), []
        for p in pieces.tolist():
            e = int(self.first[at])
            while self.piece[e] != p:
                e += 1
            out.append(e)
            at = int(self.b[e])
        return out

    def other(self, word: int, taken: list[list[int]], draw: Iterator[float]) -> list[int] | None:
        """The edges of a cut of one word drawn among those not in ``taken``; None if there is no other."""
        at, stop, out, inside = int(self.start[word]), int(self.stop[word]), [], taken
        while at < stop:
            edges = range(int(self.first[at]), int(self.first[at] + self.many[at]))
            step = len(out)
            mass = []
            for e in edges:
                used = sum(math.exp(sum(self.log_p[x] for x in t[step:])) for t in inside if t[step] == e)
                p = math.exp(self.log_p[e])
                mass.append(p - used if used < p * (1 - 1e-12) else 0.0)
            whole = sum(mass)
            if whole <= 0:
                return None
            u, pick = next(draw) * whole, None
            for e, m in zip(edges, mass, strict=True):
                if m > 0:
                    pick, u = e, u - m
                    if u < 0:
                        break
            out.append(pick)
            inside = [t for t in inside if t[step] == pick]
            at = int(self.b[pick])
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64-bit keys."""
    return (_mix(x) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54


def _gumbel_below(phi: float, most: float, u: float) -> float:
    """A Gumbel value at location phi, given that it is below ``most``."""
    return phi - math.log(math.exp(min(phi - most, 700.0)) - math.log(u))


def _stream(key: np.uint64) -> Iterator[float]:
    """Numbers in (0, 1) from one key."""
    at = key ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    while True:
        with np.errstate(over="ignore"):
            block = _uniform(_mix(np.array([at])) + np.arange(16, dtype=np.uint64))
            at = at + np.uint64(0x632BE59BD9B4E019)
        yield from block.tolist()


@dataclass
class Cut:
    """One sampled segmentation: ids, its log probability, its noisy value, how surely a sample of this size has it."""

    ids: np.ndarray
    log_p: float
    gumbel: float
    inclusion: float = 1.0


class _Text:
    """The search over the cuts of one text; words are numbers of lattices.

    What a taken cut leaves is one set: all cuts that part from it at word ``first`` or later, less those taken since.
    """

    def __init__(self, lattice: Lattice, word: np.ndarray, key: int):
        self.lattice, self.word = lattice, word
        self.key = np.uint64(key)
        self.draw = map(float, _stream(self.key))
        self.heap: list[tuple] = []  # (-largest value, cut, first, chances of parting per word, taken per word)
        self.cuts: list[tuple] = []  # (pieces, counts, log_p per word, value)

    def add(self, pieces, counts, log_p, value: float, first: int) -> None:
        self.cuts.append((pieces, counts, log_p, value))
        before = np.cumsum(log_p) - log_p
        part = np.exp(before[first:] - before[first]) * -np.expm1(log_p[first:]) if first < len(log_p) else np.empty(0)
        if part.sum() > 0:
            self.push(len(self.cuts) - 1, first, part, {}, float(before[first]), value)

    def push(self, cut: int, first: int, part: np.ndarray, taken: dict, base: float, most: float) -> None:
        """``part`` has each word's chance that a cut parts there, given that it agrees up to ``first``."""
        whole = float(part.sum())
        if whole > 0:
            value = _gumbel_below(base + math.log(whole), most, next(self.draw))
            heapq.heappush(self.heap, (-value, cut, first, part, taken, base))

    def branch(self) -> tuple[int, int, list[int], float] | None:
        """Takes the best value left: (cut it parts from, word where it parts, its edges there, value)."""
        while self.heap:
            minus, cut, first, part, taken, base = heapq.heappop(self.heap)
            pieces, counts, log_p, _ = self.cuts[cut]
            rising = np.cumsum(part)
            at = min(int(np.searchsorted(rising, next(self.draw) * rising[-1], "right")), len(part) - 1)
            spot, word = first + at, int(self.word[first + at])
            gone = taken.get(spot)
            if gone is None:
                begin = int(counts[:spot].sum())
                gone = [self.lattice.path(word, pieces[begin:begin + int(counts[spot])])]
            edges = self.lattice.other(word, gone, self.draw)
            part = part.copy()
            if edges is None:  # the chance was a rounding error
                part[at] = 0.0
                self.push(cut, first, part, taken, base, -minus)
                continue
            gone = [*gone, edges]
            chance = math.exp(float(log_p[first:spot].sum()))
            rest = 1.0 - sum(math.exp(sum(float(self.lattice.log_p[e]) for e in g)) for g in gone)
            part[at] = chance * rest if rest > 1e-12 else 0.0
            self.push(cut, first, part, {**taken, spot: gone}, base, -minus)
            return cut, spot, edges, -minus
        return None

    def results(self) -> list[Cut]:
        kappa = -self.heap[0][0] if self.heap else -math.inf
        out = []
        for pieces, _, log_p, value in self.cuts:
            total = float(log_p.sum())
            inclusion = -math.expm1(-math.exp(min(total - kappa, 700.0))) if kappa > -math.inf else 1.0
            out.append(Cut(pieces, total, value, inclusion))
        return out


def _seeds(texts: list[_Text], firsts: list[int], number: int) -> np.ndarray:
    """A key per word of each text from its first fresh word on, for the draws of cut ``number``."""
    sizes = np.array([len(t.word) - f for t, f in zip(texts, firsts, strict=True)], np.int64)
    with np.errstate(over="ignore"):
        base = _mix(np.array([t.key for t in texts], np.uint64) + np.uint64(number + 1))
        spot = np.arange(sizes.sum()) + np.repeat(np.array(firsts, np.int64) - np.cumsum(sizes) + sizes, sizes)
        return _mix(np.repeat(base, sizes) + spot.astype(np.uint64))


def sample_cuts(texts: list[str | None], keys: list[int], vocab: Vocabulary, how: Sampling) -> list[list[Cut]]:
    """The sampled cuts of each text, best noisy value first; an empty text has one cut of no pieces."""
    place: dict[bytes, int] = defaultdict(count().__next__)  # numbers in order of appearance; a single blank before a word is left out
    rows = []
    for t in texts:
        line = normalised(t)
        words = line.split(b" ")[1:]
        if b"" in words:
            words = split_words(line)
            words = [w[1:] if w.count(b" ") == 1 and len(w) > 1 else w for w in words]
        rows.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
    lattice = Lattice([w if w.startswith(b" ") else b" " + w for w in place], vocab, how)
    del place
    found = [_Text(lattice, w, k) for w, k in zip(rows, keys, strict=True)]
    waiting = [(t, None, 0) for t in found]  # (text, branch, first fresh word)
    for number in range(how.samples):
        if not waiting:
            break
        fresh = np.concatenate([t.word[first:] for t, _, first in waiting])
        seeds = _seeds([t for t, _, _ in waiting], [first for _, _, first in waiting], number)
        pieces, counts, log_p = lattice.sample(fresh, seeds)
        piece_end = np.append(0, np.cumsum(counts))
        at, later = 0, []
        for t, branch, first in waiting:
            n = len(t.word) - first
            mine = pieces[piece_end[at]:piece_end[at + n]], counts[at:at + n], log_p[at:at + n]
            at += n
            if branch is None:
                t.add(*mine, -math.log(-math.log(next(t.draw))), 0)
            else:
                cut, spot, edges, value = branch
                old_pieces, old_counts, old_log_p, _ = t.cuts[cut]
                own = sum(float(lattice.log_p[e]) for e in edges)
                head = int(old_counts[:spot].sum())
                t.add(np.concatenate([old_pieces[:head], lattice.piece[edges], mine[0]]),
                      np.concatenate([old_counts[:spot], [len(edges)], mine[1]]),
                      np.concatenate([old_log_p[:spot], [own], mine[2]]), value, first)
            if number + 1 < how.samples and (branch := t.branch()):
                later.append((t, branch, branch[1] + 1))
        waiting = later
    return [t.results() for t in found]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", how: Sampling | None = None,
           keep: tuple[str, ...] = (), check: bool = False) -> DataFrame:
    """(id_col, sample, ids, log_prob, gumbel, inclusion, *keep): ``how.samples`` distinct cuts of each whole text, best first.

    sample counts from 1; log_prob is the cut's log probability in the lattice, gumbel its noisy value, inclusion the
    probability that a cut of this log_prob is above the next noisy value, which makes 1 / inclusion an unbiased weight.
    With ``check``, a column decodes tells whether the ids decode to the text (blank marks in it as blanks).  Cuts of a
    word whose joint chance is below 1e-12 are not told from none.
    Draws depend on the row's id and text alone, so a repeated row gives the same cuts.  NULL and empty texts give one
    sample without ids; a NULL id is a key like any other.
    """
    how = how or Sampling()
    shared = Vocabulary.shared(docs.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.of(shared.value)
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and (not some or size < _SLICE):
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1] or "")
                ids = batch.column(0).slice(at, len(some))
                keys = [xxhash.xxh64_intdigest(str(i).encode(), how.seed) for i in ids.to_pylist()]
                cuts = sample_cuts(some, keys, vocab, how)
                flat = [c for cs in cuts for c in cs]
                owner = [n for n, cs in enumerate(cuts) for _ in cs]
                offsets = np.cumsum([0] + [len(c.ids) for c in flat]).astype(np.int32)
                values = np.concatenate([c.ids for c in flat]) if flat else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(owner, pa.int64())),
                    pa.array([r + 1 for cs in cuts for r in range(len(cs))], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
                    *(pa.array([getattr(c, k) for c in flat], pa.float64()) for k in ("log_p", "gumbel", "inclusion")),
                    *(batch.column(2 + n).slice(at, len(some)).take(pa.array(owner, pa.int64())) for n in range(len(keep))),
                    *([pa.array([vocab.decode(c.ids) == normalised(some[n])[1:].decode() for c, n in zip(flat, owner, strict=True)], pa.bool_())] if check else [])],
                    names=["id", "sample", "ids", "log_prob", "gumbel", "inclusion", *keep, *(["decodes"] if check else [])])
                at += len(some)

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    schema = f"id {kept.schema['id'].dataType.simpleString()}, sample int, ids array<int>, log_prob double, gumbel double, inclusion double"
    schema += "".join(f", `{c}` {kept.schema[c].dataType.simpleString()}" for c in keep) + (", decodes boolean" if check else "")
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """All columns of ``encoded`` (needs ids) and ``text``: the ids' text; NULL and empty ids give the empty text."""
    shared = Vocabulary.shared(encoded.sparkSession, model_file)
    names = [c for c in encoded.columns if c != "text"]
    encoded = encoded.select(*names)
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.of(shared.value)
        for batch in batches:
            for n in range(0, batch.num_rows, 256):
                part = batch.slice(n, 256)
                texts = [vocab.decode(x.values.to_numpy()) if x.is_valid and len(x.values) else "" for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return encoded.mapInArrow(run, encoded.select("*", F.lit("").alias("text")).schema)
