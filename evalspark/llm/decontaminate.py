"""Benchmark passages in documents: CGK embedding of item-sized windows, bit-sampling LSH, exact edit verification.

Texts are compared as sequences of words (A-Z lower-cased, ASCII punctuation dropped).  An item of n words is found in a
document if some run of the document's words is within floor((1 - similarity) * n) word edits of it.

The CGK walk (Chakraborty, Goldenberg, Koucky, 2016) copies the word under a pointer and moves the pointer by a random
bit that depends on the step and the word, so near sequences soon walk in step and differ in few places.  Sampling the
same places of the walk from windows and items gives bucket keys; every pair that shares a bucket in any repetition is
verified by a dynamic program over the whole item.

Before the walk, an exact bound leaves out windows that cannot match: a run within k word edits of an item of n words
shares at least n - 2 - 3k word triples with it.  Where that is 0, every window goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# ASCII letters in lower case, digits and other letters' bytes stay; the rest separates words
_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_SLICE = 4_000_000  # bytes of text that one task of ``clean`` looks at together; longer texts are looked at alone
LEAST_WORDS = 3  # shorter items are no evidence and never match


@dataclass(frozen=True)
class Lsh:
    similarity: float = 0.8  # 1 - edits / words of the item
    repetitions: int = 24  # independent walks, one bucket table each
    sampled: int = 2  # places of the walk that make a key
    seed: int = 7


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Items:
    """One block of items with their bucket tables; bounded by the block, built on the driver and sent to tasks."""

    def __init__(self, rows: list[tuple], lsh: Lsh):
        self.lsh = lsh
        split = [(i, words(t)) for i, t in rows]
        split = [(i, w) for i, w in split if len(w) >= LEAST_WORDS]
        self.ids = [i for i, _ in split]
        self.code = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.base = len(self.code) + 1
        self.rows = [np.array([self.code[w] for w in ws], np.int64) for _, ws in split]
        self.sizes = np.array([len(r) for r in self.rows], np.int64)
        self.budget = np.floor((1 - lsh.similarity) * self.sizes + 1e-9).astype(np.int64)
        self.reach = int((self.sizes + self.budget).max()) if split else 0
        # items are grouped by length, so that the walk's sampled places lie within the item
        self.classes = np.floor(np.log(self.sizes) / np.log(1.5)).astype(int) if split else np.empty(0, int)
        rng = np.random.default_rng(lsh.seed)
        self.bits = rng.integers(0, 2, (lsh.repetitions, 2 * max(1, self.reach), 257), dtype=np.int8)
        self.plans = {}
        for c in np.unique(self.classes):
            mine = np.flatnonzero(self.classes == c)
            steps = 2 * int(self.sizes[mine].min())
            places = [np.sort(rng.choice(steps, min(lsh.sampled, steps), replace=False)) for _ in range(lsh.repetitions)]
            flat = np.concatenate([np.append(self.rows[k], 0) for k in mine])
            ends = np.cumsum(self.sizes[mine] + 1) - 1  # the 0 after each item stands for "no word"
            starts = ends - self.sizes[mine]
            tables = []
            for r in range(lsh.repetitions):
                keys = self.walk(flat, starts, ends, r, places[r])
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], mine[order]))
            known = np.unique(np.concatenate([self.triples(self.rows[k]) for k in mine]))
            reach = int((self.sizes + self.budget)[mine].max())
            needed = int((self.sizes - 2 - 3 * self.budget)[mine].min())
            self.plans[int(c)] = (known, reach, needed, places, tables)

    def triples(self, codes: np.ndarray) -> np.ndarray:
        """A number per word triple, 0 where a word is in no item."""
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        return np.where((a > 0) & (b > 0) & (c > 0), (a * self.base + b) * self.base + c, 0)

    def walk(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, r: int, places: np.ndarray) -> np.ndarray:
        """Keys of walk ``r`` from each start: the words under the pointer at the sampled steps."""
        at, key = starts.copy(), np.zeros(len(starts), np.int64)
        step, sampled = self.bits[r], set(places.tolist())
        for t in range(max(sampled) + 1):
            word = codes[np.minimum(at, ends)]  # at the end stands 0
            if t in sampled:
                key = key * np.int64(1_000_003) + word
            at += step[t][word % 257]
        return key

    def candidates(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, window starts) that share a bucket; ``ends`` has the end of the document that each position is in."""
        t = self.triples(codes)
        at_hit = np.flatnonzero(t)
        for known, reach, needed, places, tables in self.plans.values():
            if needed > 0:
                hit = np.zeros(len(codes) + 1, np.int64)
                hit[at_hit[np.isin(t[at_hit], known)] + 1] = 1
                seen = np.cumsum(hit)
                first = np.flatnonzero(seen[np.minimum(np.arange(len(codes)) + reach, ends)] - seen[:-1] >= needed)
            else:  # a match may share no triple
                first = np.arange(len(codes))
            found = []
            for at in range(0, len(first), 1 << 18):
                starts = first[at:at + (1 << 18)]
                for r, (keys, owner) in enumerate(tables):
                    mine = self.walk(codes, starts, ends[starts], r, places[r])
                    lo, hi = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
                    n = hi - lo
                    take = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                    found.append(np.unique(owner[take] * len(codes) + np.repeat(starts, n)))
            pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
            item = pairs // max(1, len(codes))
            for k in np.unique(item):
                yield int(k), pairs[item == k] % len(codes)

    def verify(self, codes: np.ndarray, ends: np.ndarray, item: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start the fewest edits between the item and a run that opens there, and the run's end."""
        row, k = self.rows[item], int(self.budget[item])
        n, width = len(row), len(row) + k
        steps = np.arange(width + 1)
        spots = np.minimum(starts[:, None] + steps[None, :-1], ends[starts][:, None])  # 0 is in no item
        text = codes[spots]
        cost = np.broadcast_to(steps, (len(starts), width + 1))
        for i in range(n):  # one row of the edit table at a time, for all starts at once
            new = np.empty(cost.shape, np.int64)
            new[:, 0] = i + 1
            new[:, 1:] = np.minimum(cost[:, 1:] + 1, cost[:, :-1] + (text != row[i]))
            cost = np.minimum.accumulate(new - steps, axis=1) + steps
        cost = np.where(steps[None, :] <= (ends[starts] - starts)[:, None], cost, n + width)  # no run passes the text's end
        best = cost.argmin(axis=1)
        return cost[np.arange(len(starts)), best], starts + best

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item, edits, start, end) of each item's best run in each text, the first of equal ones."""
        split = [words(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        get = self.code.get
        codes = np.zeros(int(sizes.sum() + len(sizes)), np.int64)  # a 0 ends each text
        begins = np.cumsum(sizes + 1) - sizes - 1
        for w, b in zip(split, begins.tolist(), strict=True):
            codes[b:b + len(w)] = [get(x, 0) for x in w]
        owner = np.repeat(np.arange(len(split)), sizes + 1)
        ends = (begins + sizes)[owner]
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item, starts in self.candidates(codes, ends):
            for at in range(0, len(starts), 2_048):  # the table of a slice stays small
                some = starts[at:at + 2_048]
                edits, stops = self.verify(codes, ends, item, some)
                for j in np.flatnonzero(edits <= self.budget[item]):
                    doc = int(owner[some[j]])
                    one = (int(edits[j]), int(some[j] - begins[doc]), int(stops[j] - begins[doc]))
                    if (doc, item) not in out or one < out[doc, item]:
                        out[doc, item] = one
        return sorted((doc, item, *one) for (doc, item), one in out.items())


def blocks(benchmark: DataFrame, lsh: Lsh, rows: int = 20_000) -> Iterator[Items]:
    """Item blocks of at most ``rows`` items, so that what tasks hold does not grow with the benchmark."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    parts = -(-items.count() // rows)
    for part in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield Items([(r.item_id, r.text) for r in mine.collect()], lsh)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", lsh: Lsh | None = None) -> DataFrame:
    """(id_col, item_id, edits, similarity, start_word, end_word): one row per row of ``docs`` and item found in it.

    The best run counts; of equal ones the first.  NULL and empty texts hold nothing, NULL, empty and shorter than
    three-word items are never found.  A repeated document gives its rows again, a repeated item one each.  The
    benchmark is a query set: it is held against all documents block by block.
    """
    lsh = lsh or Lsh()
    kept = docs.select(F.col(id_col).alias("id"), "text")
    id_type = kept.schema["id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"id {id_type}, item_id {item_type}, edits int, similarity double, start_word int, end_word int"
    result = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, lsh):
        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = items.matches(batch.column(1).to_pylist())
                at, item, edits, start, end = zip(*rows, strict=True) if rows else [()] * 5
                sizes = items.sizes[list(item)] if item else np.empty(0)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array([items.ids[k] for k in item], batch_item),
                    pa.array(edits, pa.int32()), pa.array(1 - np.array(edits) / sizes if item else [], pa.float64()),
                    pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=names)

        names = ["id", "item_id", "edits", "similarity", "start_word", "end_word"]
        batch_item = to_arrow_type(benchmark.schema["item_id"].dataType)
        result = result.union(kept.mapInArrow(run, schema))
    return result.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, lsh: Lsh | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept.

    Decided row by row, so equal or missing ids do not matter.  Texts are looked at in slices of a few megabytes.
    """
    lsh = lsh or Lsh()
    at = docs.columns.index("text")
    for items in blocks(benchmark, lsh):
        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = np.cumsum(pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False))
                cuts = (np.flatnonzero(np.diff(sizes // _SLICE)) + 1).tolist()
                for first, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                    part = batch.slice(first, stop - first)
                    keep = np.ones(part.num_rows, bool)
                    keep[[m[0] for m in items.matches(part.column(at).to_pylist())]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
