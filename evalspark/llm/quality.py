"""Quality scores from trusted good texts and unlabelled web texts."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame

from . import pu

_LETTERS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 128)
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SPACE = b" \t\n\r\x0b\x0c"
_STOPS = b".,;:?'\""
_SHARES = (0.0, 0.002, 0.005, 0.01, 0.02, 0.035, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95)
_COUNTS = (0, 1, 3, 6, 12, 25, 50, 100, 200, 400, 800, 1600, 3200, 6400)
_LENGTHS = (0, 2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 9, 11, 14)


def shape(text: str) -> set:
    """What the whole text looks like, as named bins: shares of kinds of characters, repetition, lengths.

    A measure sets the bin it lies in and every bin below, so that a linear model learns a step function of it.
    """
    data = text.encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    parts = data.split()
    n = len(parts)
    lines = [x for x in data.split(b"\n") if x.strip()]
    left = lambda kinds: len(data.translate(None, kinds))
    letters, upper, digits, space = (size - left(k) for k in (_LETTERS, _UPPER, _DIGITS, _SPACE))
    stops = size - left(_STOPS)
    measures = {
        b"letters": (letters / size, _SHARES),
        b"upper": (upper / max(1, letters), _SHARES),
        b"digits": (digits / size, _SHARES),
        b"space": (space / size, _SHARES),
        b"stops": (stops / size, _SHARES),
        b"signs": (max(0, size - letters - digits - space - stops) / size, _SHARES),
        b"alone": (sum(p.isalpha() or p[-1:] in b".,;:?!" or p[-1] >= 128 for p in parts) / max(1, n), _SHARES),
        b"distinct": (len(set(parts)) / max(1, n), _SHARES),
        b"again": (sum(map(bytes.__eq__, parts, parts[1:])) / max(1, n), _SHARES),
        b"same lines": (1 - len(set(lines)) / max(1, len(lines)), _SHARES),
        b"words": (n, _COUNTS),
        b"lines": (len(lines), _COUNTS),
        b"word length": (len(data) / max(1, n), _LENGTHS),
        b"line length": (n / max(1, len(lines)), _COUNTS),
    }
    return {b"%s>%d" % (name, i) for name, (x, edges) in measures.items() for i in range(bisect_right(edges, x))}


def train(docs: DataFrame, labels: DataFrame, learn: Column, how: pu.Training | None = None) -> pu.Model:
    """A model of ``labels.quality`` = 1; see ``pu.train``."""
    return pu.train(docs, labels, "quality", learn, shape, how or pu.Training(evidence=0.0))


def score(docs: DataFrame, model: pu.Model, out: str = "score") -> DataFrame:
    """``docs`` (needs text) with ``out``: the estimated probability that the text is good.

    NULL text counts as empty; an empty text has a shape of its own (no words, no lines) and is scored by it.
    """
    return pu.scored(docs, model, shape, out)
