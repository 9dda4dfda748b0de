"""Token ids of whole texts in word-aligned binary files, and reading them back.

A 64-bit word holds a selector in its top four bits and 60 bits of values: the selector says how many values of how many
bits.  Values of more than 60 bits go to a list of escapes, which a word of selector 0 points into.  A payload is cut
into blocks of ``BLOCK`` ids that can be decoded on their own, all at once or from any block on:

    magic "S8B1", then little-endian u32: ids, blocks, words, escapes; u32 first word of each block and the end;
    u64 words; u64 escapes

A file is a Parquet file of chunks in ascending order of the documents: shard, chunk, ids before it in the shard,
number of ids, the documents' ids and lengths, and the payload.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BLOCK = 4_096
CHUNK = 1 << 19  # ids after which a chunk ends; a document is never cut
CACHE = 1_500_000  # words whose ids a worker remembers, some 160 bytes each
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])  # by selector; 0 is an escape, 1 a run of zeros
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if len(ids) and int(ids.max()) < 1 << 16:
        return _BITS[ids]
    if not len(ids) or int(ids.max()) < 1 << 53:
        return np.frexp(ids.astype(np.float64))[1].astype(np.int8)
    high = np.frexp((ids >> np.uint64(32)).astype(np.float64))[1]
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, high + 32, low).astype(np.int8)


def pack(ids: np.ndarray) -> bytes:
    """The payload of an array of unsigned values of up to 64 bits."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    need = _widths(ids)
    best = np.zeros(n, np.int8)  # the selector that takes most values from each place on
    over = n - np.cumsum(np.bincount(need, minlength=65))  # values of more bits than each width
    for s in range(15, 0, -1):
        c = int(COUNTS[s])
        if not over[WIDTHS[s]]:
            best[:] = s
        elif (1 - over[WIDTHS[s]] / n) ** c > 1e-5:  # else so many hardly ever fit; another selector serves
            bad = np.zeros(n + 121, np.int32)
            np.cumsum(need > WIDTHS[s], out=bad[1:n + 1])
            bad[n + 1:] = bad[n]
            best[bad[c:c + n] == bad[:n]] = s
    # all blocks are walked together; a word ends at its block's end, whatever its selector could hold
    at, who, steps = np.arange(blocks) * BLOCK, np.arange(blocks), []
    ends = np.minimum(at + BLOCK, n)
    while len(at):
        steps.append((who, at))
        at = np.minimum(at + COUNTS[best[at]], ends[who])
        go = at < ends[who]
        at, who = at[go], who[go]
    owner = np.concatenate([w for w, _ in steps]) if steps else np.empty(0, np.int64)
    marks = np.zeros(n, bool)
    for _, a in steps:
        marks[a] = True
    begin = np.flatnonzero(marks)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=blocks))]).astype("<u4")
    selector = best[begin]
    taken = np.diff(np.append(begin, n))
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector[selector > 1]):
        shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
        full = np.flatnonzero((selector == s) & (taken == COUNTS[s]))
        first, packed = begin[full], words[full]
        for k in range(COUNTS[s]):
            packed |= ids[first + k] << shifts[k]
        words[full] = packed
        for w in np.flatnonzero((selector == s) & (taken < COUNTS[s])).tolist():  # at most one a block
            values = ids[begin[w]:begin[w] + taken[w]]
            words[w] |= np.bitwise_or.reduce(values << shifts[:len(values)])
    escaped = np.flatnonzero(selector == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    head = np.array([n, blocks, len(words), len(escaped)], "<u4")
    return b"".join([b"S8B1", head.tobytes(), offsets.tobytes(), words.astype("<u8").tobytes(), ids[begin[escaped]].astype("<u8").tobytes()])


def unpack(payload: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The values of a payload, or of its blocks from ``first_block`` to before ``last_block``."""
    if payload[:4] != b"S8B1":
        raise ValueError("not a payload of packed ids")
    n, blocks, n_words, n_escapes = (int(x) for x in np.frombuffer(payload, "<u4", 4, 4))
    offsets = np.frombuffer(payload, "<u4", blocks + 1, 20).astype(np.int64)
    at = 20 + 4 * (blocks + 1)
    words = np.frombuffer(payload, "<u8", n_words, at)
    escapes = np.frombuffer(payload, "<u8", n_escapes, at + 8 * n_words)
    last_block = blocks if last_block is None else last_block
    words = words[offsets[first_block]:offsets[last_block]]
    selector = (words >> np.uint64(60)).astype(np.int64)
    # the last word of a block holds what is left of it
    held = COUNTS[selector]
    sizes = np.minimum(np.full(blocks, BLOCK), n - np.arange(blocks) * BLOCK)[first_block:last_block]
    last = offsets[first_block + 1:last_block + 1] - offsets[first_block] - 1
    before = np.cumsum(held) - held
    first = offsets[first_block:last_block] - offsets[first_block]
    if len(last):
        held[last] = sizes - (before[last] - before[first])
    place = np.cumsum(held) - held
    out = np.zeros(int(held.sum()), np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == 0:
            out[place[mine]] = escapes[words[mine].astype(np.int64)]
        elif s > 1:
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
            full, part = mine[held[mine] == COUNTS[s]], mine[held[mine] < COUNTS[s]]
            at, packed = place[full], words[full]
            for k in range(COUNTS[s]):
                out[at + k] = (packed >> shifts[k]) & mask
            for w in part.tolist():  # at most one a block
                out[place[w]:place[w] + held[w]] = (words[w] >> shifts[:held[w]]) & mask
    return out


# --- encoding -------------------------------------------------------------------

def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: visible Latin-1 as it is, the rest from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class Unsafe(Exception):
    """A word at which a text must not be cut."""


# runs that a byte-level vocabulary's pattern keeps together, next to each other in any order
_RUNS = re.compile(r"[^\W\d_]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n")


class Words(dict):
    """Ids of a blank and a word, by word; those not known are worked out when they are looked up.

    What was looked up since the table was last half full is kept, so that frequent words stay.
    """

    def __init__(self, work):
        super().__init__()
        self.work, self.old = work, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.pop(word, None)
        if ids is None:
            ids = self.work(word)
        if len(self) >= CACHE // 2:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Ids of texts by a byte-level vocabulary, equal to encoding each whole text.

    Such a vocabulary never joins a word to a blank after it, so a text may be cut before each single blank between
    visible characters, and a word's ids be looked up.  Words of letters, ASCII digits, ASCII marks but the apostrophe and
    single line ends are cut into such runs, which go to the vocabulary's model directly, other words through the whole
    encoder; a text with other white space at a cut is encoded whole.
    """

    def __init__(self, tokenizer: str):
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        self.bytes = {i: i.to_bytes(4, "little") for i in self.tokenizer.get_vocab().values()}
        self.words, self.marks = Words(self.word), {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a run that the vocabulary's pattern keeps together."""
        known = self.bytes
        if text[0] == " " and text.isascii() and text[1:].isalpha():
            spelled = self.letters[32] + text[1:]
        else:
            spelled = text.encode().decode("latin-1").translate(self.letters)
        return b"".join([known[t.id] for t in self.model.tokenize(spelled)])

    def mark(self, text: str) -> bytes:
        """Ids of a run that many words have after their first."""
        ids = self.marks.get(text)
        if ids is None:
            if len(self.marks) >= CACHE // 16:
                self.marks.clear()
            ids = self.marks[text] = self.piece(text)
        return ids

    def word(self, word: str) -> bytes:
        """Ids of a blank and ``word``."""
        if word.isalpha():
            return self.piece(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            raise Unsafe
        runs = _RUNS.findall(word)
        if sum(map(len, runs)) < len(word) or "\n\n" in word or not all(r.isalpha() or r.isascii() for r in runs):
            return self.whole(" " + word)
        first = self.words[runs[0]] if runs[0].isalpha() else self.mark(" " + runs[0])
        return first + b"".join(map(self.mark, islice(runs, 1, None)))

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian u32."""
        if any(s in text for s in self.special):
            return self.whole(text)
        first, cut, rest = text.partition(" ")
        if not cut or not first or first[0].isspace() or first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.words.__getitem__, rest.split(" ")))
        except Unsafe:
            return self.whole(text)


def write(docs: DataFrame, tokenizer_file: str, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each whole text and writes the ids, ``end_id`` after each text, in ascending order of the documents.

    A shard is a range of ids, so shards in order are the documents in order; NULL ids come first, rows of one id are
    ordered by their text.  NULL and empty texts have no ids but the end id.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        # a worker keeps the value of a broadcast, and so the encoder and the words it knows, from task to task
        tools = docs.sparkSession.sparkContext.broadcast({"tokenizer": f.read()})
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_tools, shard = tools.value, TaskContext.get().partitionId()
        encoder = kept_tools.get("encoder") or kept_tools.setdefault("encoder", Encoder(kept_tools["tokenizer"]))
        chunk, before, size, rows, data = 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), "<u4")
            n = [len(d) // 4 for d in data]
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([rows], pa.list_(id_type)), pa.array([n], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary())], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append(key)
                data.append(encoder.encode(text.as_py()) + tail)
                size += len(data[-1]) // 4
                if size >= CHUNK:
                    yield flush()
                    chunk, before, size, rows, data = chunk + 1, before + size, 0, [], []
        if rows:
            yield flush()

    names = ["shard", "chunk", "before", "n_ids", "doc_ids", "lengths", "payload"]
    kind = kept.schema["id"].dataType.simpleString()
    ordered = kept.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, f"shard int, chunk int, before long, n_ids long, doc_ids array<{kind}>, lengths array<long>, payload binary").write.parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(first, doc_ids, lengths, payload): the chunks of a file, each with the number of ids before it."""
    chunks = spark.read.parquet(path)
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row per shard, so the running sum is over as many rows as the file has parts
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    # broadcast: a row per part of the file, and the payloads stay where they are read
    return chunks.join(F.broadcast(base), "shard").select((F.col("base") + F.col("before")).alias("first"), "doc_ids", "lengths", "payload")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Documents, their lengths and ends, all their ids, and the number of ids before, of each chunk of ``_placed``."""
    for batch in batches:
        for k in range(batch.num_rows):
            lengths = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
            yield batch.column(1)[k].values, lengths, np.cumsum(lengths), unpack(batch.column(3)[k].as_py()), batch.column(0)[k].as_py()


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, ids): each document of a file, the ids of all documents before it, its ids; unordered rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, lengths, ends, ids, first in _chunks(batches):
            at = 0
            while at < len(lengths):  # rows of about one chunk's ids at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK)))
                lo, hi = int(ends[at] - lengths[at]), int(ends[to - 1])
                offsets = np.append(ends[at:to] - lengths[at:to], hi) - lo
                yield pa.RecordBatch.from_arrays([
                    docs.slice(at, to - at), pa.array(first + ends[at:to] - lengths[at:to], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[lo:hi].astype(np.int64)))], names=["id", "start", "ids"])
                at = to

    placed = _placed(spark, path)
    kind = placed.schema["doc_ids"].dataType.elementType.simpleString()
    return placed.mapInArrow(run, f"id {kind}, start long, ids array<long>").withColumnRenamed("id", id_col)


def checksums(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of the documents of a file; the sum runs over the ids as little-endian u32.

    The ids are summed where they are read back; as rows of ``read`` they would pass through the JVM once more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, lengths, ends, ids, first in _chunks(batches):
            data, starts = memoryview(ids.astype("<u4").tobytes()), ends - lengths
            sums = [zlib.crc32(data[lo:hi]) for lo, hi in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                docs, pa.array(first + starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["id", "start", "n_tokens", "ids_crc32"])

    placed = _placed(spark, path)
    kind = placed.schema["doc_ids"].dataType.elementType.simpleString()
    return placed.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
