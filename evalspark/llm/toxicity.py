"""Toxicity scores from confirmed toxic texts and unlabelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pu

# ASCII letters in lower case and all other letters' bytes stay; digits, signs and white space separate words
_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

STEMS = (5, 6)  # bytes


def words(text: str) -> set:
    """The distinct words of the whole text, and the openings of long ones, as one stem has many endings."""
    found = set(text.encode("utf-8", "surrogatepass").translate(_KEEP).split())
    openings = {w[:n] + b"*" for n in STEMS for w in found if len(w) > n}
    return found | openings


def train(docs: DataFrame, labels: DataFrame, learn: Column, how: pu.Training | None = None) -> pu.Model:
    """A model of ``labels.toxic`` = 1; see ``pu.train``."""
    return pu.train(docs, labels, "toxic", learn, words, how or pu.Training())


def score(docs: DataFrame, model: pu.Model, out: str = "score") -> DataFrame:
    """``docs`` (needs text) with ``out``: the estimated probability that the text is toxic.

    NULL and empty texts have no words and get the score of the bias alone.
    """
    return pu.scored(docs, model, words, out)


def rejected(score_col: Column, threshold: float = 0.7) -> Column:
    return F.coalesce(score_col >= threshold, F.lit(False))
