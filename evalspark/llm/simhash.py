"""SimHash fingerprints and their near pairs by a binary trie that is joined with itself."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, free_name, stored

BITS = 64
SEED = 42
WIDE = 4  # blocks of 64 bits where texts are compared by the share of bits
_CHUNK = 1 << 18  # shingles whose bits are counted at once


def shingles(text: str | None, words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's words joined by blanks, and where each run of ``words`` words begins and ends in them.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words is one shingle, of none has none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([np.zeros(min(1, len(parts)), np.int64), ends[:-1] + 1])
    width = min(words, len(parts))
    return line, starts[:len(parts) - width + 1], ends[max(0, width - 1):]


def fingerprint(text: str | None, words: int = 3, wide: int = 1, distinct: bool = False) -> int:
    """Bit i is 1 if more than half of the shingles' hashes have it; a text without words gives 0.

    The first 64 bits come from XXH64; each of ``wide`` - 1 further blocks of 64 bits from multiples of it, hashed again.
    Repeated shingles count each time, or once if ``distinct``.
    """
    line, starts, ends = shingles(text, words)
    if not len(starts):
        return 0
    if distinct:
        last = {line[a:b]: k for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))}
        keep = np.fromiter(last.values(), np.int64, len(last))
        starts, ends = starts[keep], ends[keep]
    digest, count = xxhash.xxh64_intdigest, np.zeros(BITS * wide, np.int64)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)
        for block in range(wide):
            if block:
                hashes = _again(hashes)
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            count[block * BITS:(block + 1) * BITS] += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(starts)).tobytes(), "big")


def _again(x: np.ndarray) -> np.ndarray:
    """splitmix64 of each value."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp): one row per row of ``docs``; fp holds the 64 bits as a signed long.  NULL text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, fp long"
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def trie_pairs(left: np.ndarray, right: np.ndarray, budget: int, depth: int = 0, levels: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) in two sorted arrays whose first ``levels`` bits differ in at most ``budget``.

    Both tries are walked together, level by level.  A pair of nodes is two slices and the bits in which their
    prefixes differ; a pair over the budget is dropped with all that hangs below it.
    """
    lo_a, hi_a = np.array([0]), np.array([len(left)])
    lo_b, hi_b, used = np.array([0]), np.array([len(right)]), np.array([0])
    if depth:
        used = np.array([(int(left[0] ^ right[0]) >> (BITS - depth)).bit_count()])
    found = []
    for level in range(depth, levels + 1):
        small = (hi_a - lo_a) * (hi_b - lo_b) <= 16 if level < levels else np.ones(len(used), bool)
        if small.any():  # few enough to compare one by one
            n_b = (hi_b - lo_b)[small]
            sizes = (hi_a - lo_a)[small] * n_b
            pair = np.repeat(np.arange(len(sizes)), sizes)
            inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            i, j = lo_a[small][pair] + inner // n_b[pair], lo_b[small][pair] + inner % n_b[pair]
            near = np.bitwise_count((left[i] ^ right[j]) >> np.uint64(BITS - levels)) <= budget
            found.append((i[near], j[near]))
        lo_a, hi_a, lo_b, hi_b, used = (x[~small] for x in (lo_a, hi_a, lo_b, hi_b, used))
        if not len(used):
            break
        mid_a, mid_b = _split(left, lo_a, hi_a, level), _split(right, lo_b, hi_b, level)
        zero_a, one_a, zero_b, one_b = (lo_a, mid_a), (mid_a, hi_a), (lo_b, mid_b), (mid_b, hi_b)
        rows = []
        for a, b, cost in ((zero_a, zero_b, 0), (one_a, one_b, 0), (zero_a, one_b, 1), (one_a, zero_b, 1)):
            keep = (a[1] > a[0]) & (b[1] > b[0]) & (used + cost <= budget)
            rows.append([x[keep] for x in (*a, *b, used + cost)])
        lo_a, hi_a, lo_b, hi_b, used = (np.concatenate(x) for x in zip(*rows, strict=True))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """Where each slice, sorted and equal above the bit of ``level``, gets its first value with that bit."""
    bit = 1 << (BITS - 1 - level)
    above = np.uint64((1 << BITS) - 2 * bit)
    return np.clip(np.searchsorted(values, (values[lo] & above) | np.uint64(bit)), lo, hi)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest position each of ``n`` positions reaches over the links (i, j)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _prefix(fp: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits; a shift by 64 would be a shift by 0."""
    return F.when(F.lit(depth) == 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", fp, (F.lit(BITS) - depth).cast("int")))


def near_links(fps: DataFrame, budget: int = 2, node_rows: int = 8_000, step: int = 2) -> DataFrame:
    """(a, b): links, not all of them short, that connect whatever fingerprints of ``fps`` (fp, distinct) lie within ``budget`` bits.

    The top of the trie is walked by Spark: a table of node pairs starts at (root, root), every round replaces each
    pair that holds over ``node_rows`` fingerprints by the pairs of its children ``step`` levels down, adds the bits in
    which they differ and drops pairs over the budget.  Pairs that are small enough go to one task each, where the walk
    ends in numpy.  No task gets more than ``node_rows`` fingerprints, however they are spread, as they are distinct.
    Of the links that a task finds it keeps a spanning forest, so a dense cluster gives as many links as members.
    """
    fps = cut(fps.select("fp"))
    total = fps.count()
    spark = fps.sparkSession
    pairs = spark.createDataFrame([(0, 0, 0, total, total)], "u long, v long, used int, n_u long, n_v long")
    leaves, depth = [], 0
    while True:
        small = (F.col("n_u") + F.when(F.col("u") == F.col("v"), 0).otherwise(F.col("n_v")) <= node_rows) | F.lit(depth >= BITS)
        done, rest = pairs.filter(small), pairs.filter(~small)
        leaves.append(done.select(F.lit(depth).alias("depth"), "u", "v"))
        if rest.isEmpty():
            break
        depth = min(BITS, depth + step)
        node = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(BITS - depth))
        nodes = fps.groupBy(node.alias("node")).agg(F.count("*").alias("n")).withColumn(
            "up", F.call_function("shiftrightunsigned", F.col("node"), F.lit(step)))
        under_u = nodes.select(F.col("up").alias("u"), F.col("node").alias("cu"), F.col("n").alias("c_u"))
        under_v = nodes.select(F.col("up").alias("v"), F.col("node").alias("cv"), F.col("n").alias("c_v"))
        pairs = cut(
            rest.join(under_u, "u").join(under_v, "v")
            .withColumn("used", F.col("used") + F.bit_count(F.col("cu").bitwiseXOR(F.col("cv")).bitwiseAND(F.lit((1 << step) - 1))))
            .filter((F.col("used") <= budget) & ((F.col("u") != F.col("v")) | (F.col("cu") <= F.col("cv"))))
            .select(F.col("cu").alias("u"), F.col("cv").alias("v"), "used", F.col("c_u").alias("n_u"), F.col("c_v").alias("n_v")))
    members = None
    for leaf in leaves:
        at = leaf.select("depth").first()
        if at is None:
            continue
        placed = fps.withColumn("node", _prefix(F.col("fp"), at.depth))
        for side in ("u", "v"):
            wanted = leaf.filter("u <> v") if side == "v" else leaf
            part = placed.join(wanted.withColumn("node", F.col(side)), "node").select("depth", "u", "v", F.lit(side).alias("side"), "fp")
            members = part if members is None else members.union(part)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        u, v, depth = (int(group[c].iloc[0]) for c in ("u", "v", "depth"))
        sides = [np.sort(group.fp[(group.side == s).to_numpy()].to_numpy(np.int64).view(np.uint64)) for s in ("u", "v")]
        if u == v:
            i, j = trie_pairs(sides[0], sides[0], budget, depth)
            i, j, every = i[i < j], j[i < j], sides[0]
        else:
            i, j = trie_pairs(sides[0], sides[1], budget, depth)
            every = np.concatenate(sides)
            j = j + len(sides[0])
        root = _forest(i, j, len(every))
        linked = np.flatnonzero(root != np.arange(len(every)))
        signed = every.view(np.int64)
        return pd.DataFrame({"a": signed[root[linked]], "b": signed[linked]})

    if members is None:
        return spark.createDataFrame([], "a long, b long")
    return members.groupBy("depth", "u", "v").applyInPandas(walk, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """(id_col, fp, component_id): one row per row of ``docs``.

    component_id is the smallest id reachable over fingerprints that differ in at most ``budget`` bits, the row's own
    included.  Rows without words have fingerprint 0.  NULL ids are kept and never the smallest; a group of NULL ids
    alone gets NULL.  Equal fingerprints meet in a count before any pair is looked at, so copies cost no pairs.
    """
    marked = cut(fingerprints(docs, id_col, text_col, words))
    classes = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(near_links(classes, budget)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")


def _closest_forest(i: np.ndarray, j: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the links (i, j) that make up a spanning forest of least total distance (Boruvka's rounds)."""
    root, kept = np.arange(n), []
    key = far.astype(np.int64) * (len(i) + 1) + np.arange(len(i))  # no two links tie
    while True:
        a, b = root[i], root[j]
        live = np.flatnonzero(a != b)
        if not len(live):
            return np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, a[live], key[live])
        np.minimum.at(least, b[live], key[live])
        best = np.unique(least[least < np.iinfo(np.int64).max] % (len(i) + 1))
        kept.append(best)
        root = _forest(a[best], b[best], n)[root]


def _closest_each(i: np.ndarray, j: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the links that are among the ``most`` closest of either end."""
    node, link = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((far[link], node))
    node, link = node[order], link[order]
    first = np.searchsorted(node, node)
    return np.unique(link[np.arange(len(node)) - first < most])


def _jaccard(a: str | None, b: str | None, words: int) -> float:
    sets = []
    for text in (a, b):
        line, starts, ends = shingles(text, words)
        sets.append({line[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)})
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def _features(text: str | None, words: int) -> tuple[int, int, bytes, bytes]:
    """(SimHash value, number, digest, sketch) of the text's set of shingles.

    The sketch counts the shingles by the last bits of their hashes, in a power of two of cells; 255 stands for 255 and more.
    """
    line, starts, ends = shingles(text, words)
    parts = sorted({line[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)})
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts], dtype=np.uint64)
    cells = 1 << min(12, max(6, len(parts).bit_length()))
    counts = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    sketch = np.minimum(counts, 255).astype(np.uint8).tobytes()
    return fingerprint(text, words, WIDE, True), len(parts), xxhash.xxh3_128_digest(b"\n".join(parts)), sketch


def _may_match(n_a: int, n_b: int, a: bytes, b: bytes, similarity: float) -> bool:
    """False only if the sketches rule out a Jaccard similarity of ``similarity``: shared shingles share their cell."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if x.max() == 255 or y.max() == 255:
        return True
    cells = min(len(x), len(y))
    shared = np.minimum(x.reshape(-1, cells).sum(axis=0, dtype=np.int64), y.reshape(-1, cells).sum(axis=0, dtype=np.int64)).sum()
    return shared >= similarity * (n_a + n_b - shared) - 1e-9


def tables_for(prefix: int, levels: int, budget: int, similarity: float, spread: float, recall: float) -> int:
    """Fewest bit orders in which a pair at ``similarity`` is found with a chance of ``recall``.

    Each bit of the pair differs with the chance arccos(cosine) / pi.  An order finds a pair that agrees in the first
    ``prefix`` of its bits and differs in at most ``budget`` of the first ``levels``.
    """
    bits = WIDE * BITS
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    far = range(int(spread * bits) + 1)
    chance = np.array([math.comb(bits, d) * differ ** d * (1 - differ) ** (bits - d) for d in far])
    met = np.array([sum(math.comb(levels - prefix, e) * math.comb(bits - levels, d - e) for e in range(min(budget, d) + 1))
                    / math.comb(bits, d) for d in far])
    if chance.sum() <= recall:
        raise ValueError("spread is too small for the recall")
    tables = 1
    while (chance * (1 - (1 - met) ** tables)).sum() < recall:
        tables += 1
    return tables


def copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, prefix: int = 8, budget: int = 2, spread: float = 0.28,
           recall: float = 0.99, bucket_rows: int = 4_000, seed: int = 11) -> DataFrame:
    """(row, root, least): the group of each row of ``docs`` (row, doc_id, text), row being a unique long.

    Two texts belong together if the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``similarity``.  At 0.8 two SimHash values of such sets differ in 15 % of their bits on average, too many for one
    trie walk, so 256-bit values are read in seeded bit orders.  In each order, values that agree in ``prefix`` bits
    (more in large tables) share a bucket, whose trie is walked with ``budget`` errors over about log2 of the values'
    number more bits; candidates differ in at most ``spread`` of all 256 bits (at 0.8 the mean and over 4 deviations).
    The number of orders grows with the levels, so that a pair at 0.8 is found with a chance of ``recall``.  Buckets of
    more than ``bucket_rows`` values are dealt out by pairs of blocks.

    Every candidate is verified on the whole texts unless other verified links join its ends or an exact bound rules it
    out: a closest spanning forest of each task first, then what lies between different groups, closest first.
    Texts of equal shingle sets are one class from the start, so copies of a text cost no pairs.  root names the group,
    least is its row to keep: the smallest doc_id (NULL last), then the smallest row.
    """
    bits = [f"f{k}" for k in range(WIDE)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes, digests, sketches = zip(*(_features(t.as_py(), words) for t in batch.column(2)), strict=True) if batch.num_rows else [()] * 4
            blocks = [np.array([(v >> (BITS * k)) & ((1 << BITS) - 1) for v in values], np.uint64).view(np.int64) for k in range(WIDE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, blocks), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(sketches, pa.binary())], names=["row", "doc_id", *bits, "size", "digest", "sketch"])

    kept = docs.select("row", "doc_id", "text")
    id_type = kept.schema["doc_id"].dataType.simpleString()
    marked = cut(kept.mapInArrow(
        read, f"row long, doc_id {id_type}, " + ", ".join(f"{b} long" for b in bits) + ", size long, digest binary, sketch binary"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    # the class is named by the row that stands for it, and so is the text that is compared
    classes = cut(marked.groupBy("digest").agg(F.min(order).alias("first"), *[F.first(c).alias(c) for c in (*bits, "size", "sketch")]))
    values = classes.select(F.col("first.row").alias("node"), *bits, "size")
    log_n = int(np.ceil(np.log2(max(2, classes.count()))))
    prefix = min(BITS // 2, max(prefix, log_n - 10))
    levels = min(BITS, prefix + max(8, log_n - prefix + 4))
    orders = [np.random.default_rng([seed, t]).permutation(WIDE * BITS)[:BITS]
              for t in range(tables_for(prefix, levels, budget, similarity, spread, recall))]

    def keys(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        blocks = np.stack([batch.column(1 + k).to_numpy().view(np.uint64) for k in range(WIDE)], axis=1)
        spelled = np.unpackbits(blocks.astype(">u8").view(np.uint8).reshape(-1, WIDE * 8), axis=1)
        for t, bit in enumerate(orders):
            key = np.ascontiguousarray(np.packbits(spelled[:, bit], axis=1)).view(">u8").ravel().astype(np.uint64)
            yield t, key, (key >> np.uint64(BITS - prefix)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, _, bucket in keys(batch):
                name, n = np.unique(bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int32)), pa.array(name), pa.array(n)], names=["t", "bucket", "n"])

    large = values.mapInArrow(count, "t int, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > bucket_rows)
    parts = {(r.t, r.bucket): -(-r.n // bucket_rows) for r in large.collect()}  # at most one for each bucket_rows rows of an order

    def reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = _again(batch.column(0).to_numpy().view(np.uint64))
            for t, key, bucket in keys(batch):
                n = np.array([parts.get((t, x), 1) for x in bucket.tolist()], np.int64)
                at = np.repeat(np.arange(len(n)), n)  # a row meets every block of its bucket
                mine = (block % n.astype(np.uint64)).astype(np.int64)[at]
                other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                out = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(np.full(len(at), t, np.int32)), pa.array(bucket[at]), pa.array(np.minimum(mine, other)),
                     pa.array(np.maximum(mine, other)), pa.array(mine), pa.array(key[at].view(np.int64))],
                    names=["node", *bits, "size", "t", "bucket", "u", "v", "block", "key"])

    def candidates(group: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of (i, j, far): numbers of rows of the group, sorted by key, and the bits in which they differ."""
        key, size, *blocks = (group[c].to_numpy().view(np.uint64) if c != "size" else group[c].to_numpy() for c in ("key", "size", *bits))
        label = group["label"].to_numpy() if "label" in group else np.arange(len(group))
        inside = group.u.iloc[0] == group.v.iloc[0]
        left = np.flatnonzero((group.block == group.u).to_numpy())
        right = left if inside else np.flatnonzero((group.block == group.v).to_numpy())
        for at in range(0, len(left) if len(right) else 0, 512):  # a dense cluster is worked off in slices
            i, j = trie_pairs(key[left[at:at + 512]], key[right], budget, 0, levels)
            i, j = left[i + at], right[j]
            live = (label[i] != label[j]) & ((i < j) | (not inside))
            i, j = i[live], j[live]
            # a similarity of so much is out of reach for sets whose sizes differ more
            live = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
            i, j = i[live], j[live]
            far = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int16) for x in blocks)
            near = far <= spread * WIDE * BITS
            yield i[near], j[near], far[near]

    def joined(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2 + (np.empty(0, np.int16),), *found, strict=True))

    def by_key(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[np.argsort(group.key.to_numpy().view(np.uint64), kind="stable")]

    def ends(group: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        node = group["node"].to_numpy()
        return {"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])}

    def first_walk(group: pd.DataFrame) -> pd.DataFrame:
        """Links of a closest spanning forest (kind 0) and the other candidates (1), or the task's name (2) if they are many."""
        group = by_key(group)
        forest, rest, n = [], [], 0
        for i, j, far in candidates(group):
            best = _closest_forest(i, j, far, len(group))
            forest.append((i[best], j[best], far[best]))
            n += len(i)
            rest = [*rest, (i, j, far)] if n <= 8 * len(group) else []
        i, j, far = joined(forest)
        best = _closest_forest(i, j, far, len(group))
        out = [pd.DataFrame({"kind": 0} | ends(group, i[best], j[best]))]
        if n > 8 * len(group):
            out.append(pd.DataFrame({"kind": 2, **{c: group[c].iloc[:1].to_numpy() for c in ("t", "bucket", "u", "v")}}))
        elif n:
            i, j, _ = joined(rest)
            out.append(pd.DataFrame({"kind": 1} | ends(group, i, j)))
        return pd.concat(out).reindex(columns=["kind", "a", "b", "t", "bucket", "u", "v"]).astype("Int64")

    def next_walk(most: int | None):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = by_key(group)
            found = []
            for i, j, far in candidates(group):
                best = _closest_each(i, j, far, most) if most else np.arange(len(i))
                found.append((i[best], j[best], far[best]))
            i, j, far = joined(found)
            best = _closest_each(i, j, far, most) if most else np.arange(len(i))
            return pd.DataFrame(ends(group, i[best], j[best]))
        return run

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [_jaccard(x.as_py(), y.as_py(), words) >= similarity for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = [_may_match(*row, similarity) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(may, pa.bool_()))

    texts = kept.select("row", "text")
    sketches = classes.select(F.col("first.row").alias("node"), "size", "sketch")

    def both(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        name, *rest = of.columns
        for side in ("a", "b"):
            pairs = pairs.join(of.select(F.col(name).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in rest]), side)
        return pairs.select("a", "b", *columns)

    def verified(links: DataFrame) -> DataFrame:
        likely = cut(both(links.select("a", "b").distinct(), sketches, "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(prune, "a long, b long"))
        return cut(both(likely, texts, "text_a", "text_b").mapInArrow(verify, "a long, b long"))

    dealt = values.mapInArrow(
        reorder, "node long, " + ", ".join(f"{b} long" for b in bits) + ", size long, t int, bucket long, u long, v long, block long, key long")
    task = ["t", "bucket", "u", "v"]
    found = cut(dealt.groupBy(*task).applyInPandas(first_walk, "kind long, a long, b long, t int, bucket long, u long, v long"))
    links = verified(found.filter("kind = 0"))
    roots = components(links)

    def between(pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are in different groups so far."""
        labels = roots.withColumnRenamed("node", "of")
        for side in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("of").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
        return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    more = verified(between(found.filter("kind = 1").select("a", "b").distinct()))
    links = links.union(more)
    roots = components(links)
    crowded = found.filter("kind = 2").select(*task)  # a row for each task
    for most in () if crowded.isEmpty() else (8, None):
        labelled = dealt.join(F.broadcast(crowded), task, "left_semi").join(roots, "node", "left")
        labelled = labelled.withColumn("label", F.coalesce("root", "node")).drop("root")
        links = links.union(verified(labelled.groupBy(*task).applyInPandas(next_walk(most), "a long, b long")))
        roots = components(links)
    rooted = classes.join(roots, F.col("first.row") == F.col("node"), "left").select("digest", "first", F.coalesce("root", "first.row").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("first")).select("root", F.col("first.row").alias("least"))
    named = rooted.select("digest", "root").join(best, "root")
    return marked.select("row", "digest").join(named, "digest").select("row", "root", "least")


def without_copies(docs: DataFrame, **how) -> DataFrame:
    """``docs`` (needs doc_id, text) with one row of each group of ``copies``; columns and other rows are kept.

    NULL and empty texts have no words and are copies of each other.
    """
    numbered = docs.withColumn("row", F.monotonically_increasing_id()) if "row" not in docs.columns else docs.withColumnRenamed(
        "row", "_own_row").withColumn("row", F.monotonically_increasing_id())
    keep = copies(numbered, **how).filter("row = least").select("row")
    out = numbered.join(keep, "row", "left_semi").drop("row")
    return out.withColumnRenamed("_own_row", "row").select(*docs.columns) if "row" in docs.columns else out.select(*docs.columns)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """``docs`` with one row of each group of ``near_groups``: the one with the smallest id (NULL last), of equal ids any one.

    Groups are those of fingerprints of ``words``-word shingles that differ in at most ``budget`` bits; nothing else is compared.
    All columns stay.  NULL and empty texts and those without words are one group.  The rows are numbered in a written table, so that a
    number means the same row whenever it is read.
    """
    number = free_name(docs, "row")
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    own = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(number).alias("row"))
    groups = near_groups(numbered.select(own.alias("key"), F.col(f"`{text_col}`").alias("text")), "key", "text", words, budget)
    kept = groups.filter(F.col("key") == F.col("component_id")).select(F.col("component_id.row").alias(number))
    return numbered.join(kept, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
