"""Bytes covered by long strings that occur more than once in a corpus, by prefix-free parsing.

The trigger of a string is the least of the rolling hashes (over eight bytes) in its first third.  It depends on the string alone, so
it is the same wherever the same bytes stand, every string has one, and the triggers of a text cut it into phrases.  The strings of
``length`` bytes that share one trigger are one unit: a slice of the corpus order of suffixes.  Units are told apart by two
names, of the suffix from the trigger on as deep as all strings with that trigger reach (``core``) and of the unit's whole
bytes (``full``), as only ties in that order matter:

- a core that occurs once: none of the unit's strings occurs elsewhere, and the unit is done;
- a core with one full name, more than once: all of them do;
- a core with several full names: the unit lies at the border of a repeat.  Only there the strings are named one by one.

Text thus costs one row per phrase, about two per third of ``length``, not one per byte; text with a period costs
one row per period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

TRIGGER_BYTES = 8
ROWS = 1 << 16  # rows after which units or strings are handed on
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = 24  # low bits of a hash that give way to its place in the text
_PLACES = np.uint64((1 << _PLACE) - 1)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table; the shuffle files of the plan that was written go at once.

    Steps here shuffle several times the input.  Spark's own way is to delete such files once the driver has collected the plan as
    garbage, so a fast run would hold those of many steps.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return stored(df, name)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def window(length: int) -> int:
    """How many places of a string its trigger is chosen from: a power of two, about a third of its bytes."""
    places = min(length // 3, length - TRIGGER_BYTES + 1)
    return 1 << places.bit_length() - 1 if places > 0 else 1


def rolling(data: bytes) -> np.ndarray:
    """Hashes of all eight-byte windows."""
    n = len(data) - TRIGGER_BYTES + 1
    value = np.empty(n, np.uint64)
    for k in range(min(TRIGGER_BYTES, n)):
        value[k::TRIGGER_BYTES] = np.frombuffer(data, "<u8", len(range(k, n, TRIGGER_BYTES)), k)
    with np.errstate(over="ignore"):
        mixed = (value ^ (value >> np.uint64(29))) * _ODD
        return (mixed ^ (mixed >> np.uint64(32))) * _ODD


def triggers(data: bytes, length: int) -> np.ndarray:
    """For each string of ``length`` bytes of a text, the place of its trigger: the first of the least hashes in its window.

    Forty bits of a hash are compared, whatever the text's length; in all but huge texts a hash and its place share one number.
    """
    strings, places = len(data) - length + 1, window(length)
    if places == 1:
        return np.arange(max(strings, 0))
    least = rolling(data)[:strings + places - 1]
    step = 1
    if len(least) <= 1 << _PLACE:
        least &= ~_PLACES
        least |= np.arange(len(least), dtype=np.uint64)
        while step < places:
            least = np.minimum(least[step:], least[:-step])
            step *= 2
        return (least & _PLACES).view(np.int64)
    least, at = least >> np.uint64(_PLACE), np.arange(len(least))
    while step < places:
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        step *= 2
    return at


def units(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, begin of core, end of core) of the units of one text: strings that follow each other and have one trigger."""
    if len(data) < length:
        return (np.empty(0, np.int64),) * 4
    fire = triggers(data, length)
    first = np.flatnonzero(np.diff(fire, prepend=-1))
    last = np.append(first[1:], len(fire)) - 1
    return first, last, fire[first], fire[first] + length - window(length) + 1


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _parsed(texts: DataFrame, length: int) -> DataFrame:
    """(core, full, k1, k2, first, last): a row per unit of each text."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cores, fulls, found = [], [], []  # found: keys, first and last starts of each text

        def flush() -> pa.RecordBatch:
            sizes = [len(f[2]) for f in found]
            rows = pa.RecordBatch.from_arrays([
                _signed(cores), _signed(fulls), *(pa.array(np.repeat(np.array([f[k] for f in found], np.int64), sizes)) for k in (0, 1)),
                *(pa.array(np.concatenate([f[k] for f in found]), pa.int32()) for k in (2, 3))], names=names)
            cores.clear(), fulls.clear(), found.clear()
            return rows

        for batch in batches:
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = as_bytes(text.as_py())
                first, last, begin, end = units(data, length)
                if len(first):
                    cores += [digest(data[a:b], 1) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                    fulls += [digest(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
                    found.append((k1, k2, first, last))
                    if len(cores) >= ROWS:
                        yield flush()
        if found:
            yield flush()

    names = ["core", "full", "k1", "k2", "first", "last"]
    return texts.select("k1", "k2", "text").mapInArrow(run, "core long, full long, k1 long, k2 long, first int, last int")


def _text_key(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def repeated(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, spans): for each text with a repeated string, (start, end) of runs of starts, end exclusive, unsorted.

    ``texts`` has (k1, k2, id, text), a row per document.
    """
    parsed = _written(_parsed(texts, length), "parse")
    cores = parsed.groupBy("core").agg(
        F.count("*").alias("n"), F.min("full").alias("low"), F.max("full").alias("high")).filter("n > 1")
    cores = cores.select("core", (F.col("low") == F.col("high")).alias("same"))
    met = parsed.join(cores, "core")
    # copies of a text give equal rows: counted here, one row from now on
    met = _written(met.groupBy("core", "full", "k1", "k2", "first", "last").agg(F.count("*").alias("n"), F.first("same").alias("same")), "units")
    sure = met.filter("same").select("k1", "k2", "first", "last")
    mixed = met.filter("not same")
    names = mixed.groupBy("core", "full").agg(F.sum("n").alias("total"), F.min(F.struct("k1", "k2", "first")).alias("one"))
    mixed = mixed.join(names, ["core", "full"])
    again = mixed.filter("total > 1").select("k1", "k2", "first", "last")
    # the strings of a full name are listed once, with weight 2 if it occurs again
    listed = mixed.filter((F.col("total") == 1) | (F.struct("k1", "k2", "first") == F.col("one"))).select(
        "k1", "k2", F.struct("core", "first", "last", F.when(F.col("total") > 1, 2).otherwise(1).alias("weight")).alias("unit"))
    listed = listed.groupBy("k1", "k2").agg(F.collect_list("unit").alias("units"))
    speaker = texts.groupBy("k1", "k2").agg(F.min("id").alias("speaker"))  # of equal texts one lists the strings

    digest = xxhash.xxh3_64_intdigest

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, found = [], []  # found: core, keys, weight, first and last start of each unit

        def flush() -> pa.RecordBatch:
            core, k1, k2, weight, first, last = (np.array(x, np.int64) for x in zip(*found, strict=True))
            sizes = last + 1 - first
            at = np.arange(len(strings)) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
            core, k1, k2, weight = (np.repeat(x, sizes) for x in (core, k1, k2, weight))
            rows = pa.RecordBatch.from_arrays([
                pa.array(core), _signed(strings), pa.array(k1), pa.array(k2), pa.array(at, pa.int32()), pa.array(weight, pa.int32())],
                names=["core", "string", "k1", "k2", "at", "weight"])
            strings.clear(), found.clear()
            return rows

        for batch in batches:
            for k1, k2, text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = as_bytes(text.as_py())
                for u in listed.as_py():
                    strings += [digest(data[p:p + length]) for p in range(u["first"], u["last"] + 1)]
                    found.append((u["core"], k1, k2, u["weight"], u["first"], u["last"]))
                    if len(strings) >= ROWS:
                        yield flush()
        if found:
            yield flush()

    told = listed.join(speaker, ["k1", "k2"]).join(texts, ["k1", "k2"]).filter(F.col("id").eqNullSafe(F.col("speaker")))
    # rows may repeat with their ids; a start lies in one unit, so a text told once lists no string twice
    told = told.select("k1", "k2", "text", "units").dropDuplicates(["k1", "k2"])
    strings = _written(told.mapInArrow(spell, "core long, string long, k1 long, k2 long, at int, weight int"), "strings")
    twice = strings.groupBy("core", "string").agg(F.sum("weight").alias("n")).filter("n > 1").select("core", "string")
    single = strings.join(twice, ["core", "string"]).select("k1", "k2", F.col("at").alias("first"), F.col("at").alias("last"))
    spans = sure.union(again).union(single)
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.struct(F.col("first").alias("start"), (F.col("last") + 1).alias("end"))).alias("spans"))


def _removed(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, from runs of starts."""
    runs: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"] - 1 + length) for s in spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(a, b) for a, b in runs]


def without_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, removed, kept): for each row its UTF-8 length, the removed (start, end) byte runs, and what is left.

    A byte goes if it lies in a string of ``length`` bytes that starts at another place too, in the same or any other
    row; strings are judged on the input.  NULL text counts as empty, and texts below ``length`` bytes stay whole.
    Repeated rows are copies of each other like any equal texts, so all of their bytes go.  NULL ids are kept.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = texts.select(*_text_key(F.col("text")), "id", "text")
    found = _written(repeated(texts, length), "spans")
    joined = texts.join(found, ["k1", "k2"], "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for n in range(batch.num_rows):
                data = as_bytes(batch.column(1)[n].as_py())
                runs = _removed(batch.column(2)[n].as_py() or [], length)
                edges = [0, *(x for r in runs for x in r), len(data)]
                sizes.append(len(data))
                removed.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])

    kind = joined.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
