"""Periodic runs of words, found by multi-scale minimizers.

At the scale of k words, windows of k / 2 neighbouring k-word grams each name their least gram by hash.  In a run whose
period q is over k / 2 and at most k, two windows at distance q hold the same grams, so the least ones lie q apart; and as
a gram of q words or more is found in a run at multiples of q only, they follow each other among the equal minimizers.  Such pairs
seed an extension word by word.  Periods too short for the first scale come from direct scans, one lag after the other.
Grams are compared by 64-bit hashes and extended by the words themselves, so a run that is returned is one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 4  # periods that a run holds at least
SHORTEST = 6  # words that a run holds at least
LAGS = 8  # periods that are scanned directly; a power of two, the first scale has twice as many words
_SLICE = 4_000_000  # characters of text that one task looks at together; longer texts are looked at alone

_words = re.compile(WORD).findall
_RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _doubled(grams: np.ndarray, half: int) -> np.ndarray:
    """Hashes of grams twice as long; those that would pass the end are zero."""
    out = np.zeros_like(grams)
    if len(grams) > half:
        out[:-half] = _mixed(grams[:-half] * np.uint64(0x9E3779B97F4A7C15) + _mixed(grams[half:] + np.uint64(half)))
    return out


def _minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the leftmost least gram of each window; ``window`` is a power of two."""
    least, at, step = grams, np.arange(len(grams)), 1
    while step < window and len(least) > step:
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        step *= 2
    return at[np.flatnonzero(np.diff(at, prepend=-1))] if len(at) else at


def _reach(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch around ``at`` whose words equal those ``lag`` later: its start, and its end plus ``lag``."""
    low, step = at, 64
    while low > 0:
        first = max(0, low - step)
        differ = np.flatnonzero(words[first:low] != words[first + lag:low + lag])
        if len(differ):
            low = first + int(differ[-1]) + 1
            break
        low, step = first, 2 * step
    high, step, last = at, 64, len(words) - lag
    while high < last:
        end = min(last, high + step)
        differ = np.flatnonzero(words[high:end] != words[high + lag:end + lag])
        if len(differ):
            high += int(differ[0])
            break
        high, step = end, 2 * step
    return low, high + lag


def _least_length(period: int) -> int:
    return max(SHORTEST, REPEATS * period)


def _direct(words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs with periods up to LAGS: (start, end, period)."""
    for lag in range(1, min(LAGS, len(words) - 1) + 1):
        same = np.zeros(len(words) - lag + 2, np.int8)
        same[1:-1] = words[:-lag] == words[lag:]
        turns = np.flatnonzero(np.diff(same))
        starts, ends = turns[::2], turns[1::2] + lag
        for n in np.flatnonzero(ends - starts >= _least_length(lag)):
            yield int(starts[n]), int(ends[n]), lag


def _seeded(words: np.ndarray, grams: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """Runs with periods over size / 2 and up to size: (start, end, period)."""
    at = _minimizers(grams, size // 2)
    at = at[np.argsort(grams[at], kind="stable")]
    lags = np.diff(at)
    pairs = np.flatnonzero((grams[at[1:]] == grams[at[:-1]]) & (lags > size // 2) & (lags <= size))
    done: dict[int, int] = {}
    for start, lag in sorted(zip(at[pairs].tolist(), lags[pairs].tolist())):
        if start + lag < done.get(lag, 0) or words[start] != words[start + lag]:
            continue
        low, high = _reach(words, start, lag)
        done[lag] = high
        if high - low >= _least_length(lag):
            yield low, high, lag


def find_runs(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text of word numbers (0 or more), by start, then period.

    A run is a stretch with smallest period q of at least max(SHORTEST, REPEATS * q) words that no neighbour extends.
    All texts are looked at together, parted by numbers that no other place has, so no run crosses from one to the next.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    words = np.full(int(sizes.sum()) + len(texts), -1, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    for n, text in enumerate(texts):
        words[starts[n]:starts[n] + len(text)] = text
        words[starts[n] + len(text)] = -1 - n
    owners = np.arange(len(texts))
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]

    def note(runs: Iterator[tuple[int, int, int]]) -> None:
        for low, high, period in runs:
            k = int(np.searchsorted(starts, low, "right")) - 1
            span = (low - int(starts[k]), high - int(starts[k]))
            known = found[owners[k]]
            known[span] = min(known.get(span, period), period)  # multiples of a run's period reach as far

    note(_direct(words))
    grams = _mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    size = 1
    while len(words):
        grams = _doubled(grams, size)
        size *= 2
        if size <= LAGS:
            continue
        long = sizes > 2 * size  # a period over size / 2 takes more words than that
        if not long.all():
            keep = np.repeat(long, sizes + 1)
            words, grams, sizes, owners = words[keep], grams[keep], sizes[long], owners[long]
            starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        if len(words):
            note(_seeded(words, grams, size))
    return [sorted((a, b - a, q) for (a, b), q in spans.items()) for spans in found]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by blanks, without those that some run holds after its first period."""
    if not runs:
        return " ".join(words)
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
    return " ".join([words[i] for i in kept])


def with_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """All columns of ``docs``, the runs of each whole text, and the text with each run cut to its first period.

    ``runs_col`` is an array of (start, length, period) in word numbers from 0, by start, then period; ``collapsed_col`` has
    the words that are left, joined by one blank.  NULL and empty texts and those of white space alone have no runs and an
    empty text.  Each row stands for itself: repeated rows and NULL ids give a row each.  Columns of ``docs`` that have
    the names of the added ones are replaced.  Memory grows with the longest text.
    """
    names = [c for c in docs.columns if c.lower() not in (runs_col.lower(), collapsed_col.lower()) or c == text_col]
    docs = docs.select(*[docs[f"`{c}`"] for c in names])
    at = names.index(text_col)
    added = {runs_col: _RUNS, collapsed_col: StringType()}
    kept = [n for n, c in enumerate(names) if c not in added]  # the text itself may be what is replaced

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            first, column = 0, batch.column(at)
            while first < batch.num_rows:
                texts, size = [], 0
                while first + len(texts) < batch.num_rows and (not texts or size < _SLICE):
                    texts.append(_words(column[first + len(texts)].as_py() or ""))
                    size += sum(map(len, texts[-1]))
                numbers: dict[str, int] = defaultdict(count().__next__)
                runs = find_runs([[numbers[w] for w in words] for words in texts])
                part = batch.slice(first, len(texts))
                as_rows = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in kept], pa.array(as_rows, kind),
                     pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.string())],
                    names=[*[names[n] for n in kept], *added])
                first += len(texts)

    fields = [docs.schema.fields[n] for n in kept] + [StructField(c, t) for c, t in added.items()]
    return docs.mapInArrow(run, StructType(fields))
