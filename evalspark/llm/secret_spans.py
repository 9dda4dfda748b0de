"""Secrets by patterns and by character Markov models, in DataFrame functions only.

The models are tables of character-pair log probabilities over ASCII.  Models of random strings (one per alphabet) and
of ordinary identifiers are trained from labelled samples; a candidate token is a secret if its log-likelihood under the
best random model exceeds that under the best ordinary one by a margin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
          r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]{14,}"  # what starts at an AKIA reaches to the end of its run, so shorter matches hide no longer ones
HEX = "[0-9a-f]{16,}"  # runs are taken whole, so the least length may stand in the pattern
KINDS = ("assign", "access", "hex", "markov")
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
ASSIGN_LENGTH = 12
ASCII = 128


@dataclass(frozen=True)
class Markov:
    """Log probabilities of one character after another, ASCII x ASCII per model, and the margin in nats."""

    random: tuple[tuple[float, ...], ...]
    ordinary: tuple[tuple[float, ...], ...]
    margin: float = 12.0


def _running(steps: Column) -> Column:
    """Running sums of an array of ints by doubling strides, n log n work for n entries."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(steps) + F.lit(1))).cast("int"))
    return F.aggregate(rounds, steps, lambda acc, k: F.transform(acc, lambda x, i: x + F.when(
        i >= F.pow(F.lit(2), k).cast("int"), F.get(acc, i - F.pow(F.lit(2), k).cast("int"))).otherwise(0)))


def _matches(docs: DataFrame, name: str, pattern: str, group: int = 0, least: int = 0) -> DataFrame:
    """``docs`` with array column ``name``: (start, kind, end) of the leftmost non-overlapping matches of column _text.

    Offsets come from the lengths of the matches and of what lies between them.
    """
    kind = KINDS.index(name)
    hit = F.col("_text").rlike(pattern)
    empty = F.array().cast("array<string>")
    docs = docs.withColumn("_hits", F.when(hit, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(empty))
    docs = docs.withColumn("_sizes", F.when(F.size("_hits") > 0, F.transform(
        F.arrays_zip(F.split("_text", pattern, -1).alias("gap"), F.col("_hits").alias("hit")),
        lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))).otherwise(F.array().cast("array<int>")))
    docs = docs.withColumn("_ends", _running(F.col("_sizes")))
    values = F.regexp_extract_all("_text", F.lit(pattern), F.lit(group)) if group else F.col("_hits")
    docs = docs.withColumn("_values", F.when(F.size("_hits") > 0, values).otherwise(empty))
    spans = F.transform("_hits", lambda h, i: F.struct(
        (F.get("_ends", i) - F.length(h)).alias("start"), F.lit(kind).alias("kind"), F.get("_ends", i).alias("end"),
        F.get("_values", i).alias("value")))
    docs = docs.withColumn(name, F.filter(spans, lambda x: F.length(x["value"]) >= least))
    return docs.drop("_hits", "_sizes", "_ends", "_values")


def pairs(samples: DataFrame) -> DataFrame:
    """(label, at, n): how often each pair of ASCII characters, at = 128 * first + second, occurs under a label."""
    spread = samples.filter(F.length("value") > 1).select(
        "label", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.col("value").substr(i, F.lit(2)))).alias("pair"))
    coded = spread.select("label", (F.ascii(F.substring("pair", 1, 1)) * ASCII + F.ascii(F.substring("pair", 2, 1))).alias("at"))
    return coded.filter((F.col("at") >= 0) & (F.col("at") < ASCII * ASCII)).groupBy("label", "at").agg(F.count("*").alias("n"))


def train(samples: DataFrame, margin: float = 12.0, prior: float = 0.05) -> Markov:
    """Models from samples (value, label): one per label; a label that opens with ``random`` is a random alphabet's.

    ``prior`` is what each pair counts before any is seen.  At most labels x 16,384 counts reach the driver.
    """
    tables: dict[str, list[float]] = {}
    for r in pairs(samples).collect():
        tables.setdefault(r.label, [0.0] * (ASCII * ASCII))[r.at] = float(r.n)
    models = {}
    for label, counts in tables.items():
        logs = []
        for a in range(ASCII):
            row = counts[a * ASCII:(a + 1) * ASCII]
            whole = math.log(sum(row) + prior * ASCII)
            logs += [math.log(n + prior) - whole for n in row]
        models[label] = tuple(logs)
    split = lambda yes: tuple(models[k] for k in sorted(models) if k.startswith("random") == yes)
    return Markov(split(True), split(False), margin)


def generated_samples(spark, rows: int = 2_000) -> DataFrame:
    """(value, label): ``rows`` strings per label: random in three alphabets, ordinary numbers, runs of one character."""
    ids = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id")), 256)
    base64 = F.base64(F.unhex(digest))
    number = F.lpad(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(10 ** 18)).cast("string"), 18, "0")
    dated = F.concat_ws("-", number.substr(1, 4), number.substr(5, 2), number.substr(7, 2), number.substr(9, 6))
    return ids.select(F.explode(F.array(
        F.struct(base64.alias("value"), F.lit("random base64").alias("label")),
        F.struct(digest.alias("value"), F.lit("random hex").alias("label")),
        F.struct(F.upper(F.translate(base64, "+/=", "XYZ")).alias("value"), F.lit("random upper").alias("label")),
        F.struct(number.alias("value"), F.lit("ordinary number").alias("label")),
        F.struct(dated.alias("value"), F.lit("ordinary number").alias("label")),
        F.struct(F.repeat(F.char(33 + F.col("id") % 94), F.lit(32)).alias("value"), F.lit("ordinary run").alias("label")))).alias("s")).select("s.*")


def ordinary_samples(docs: DataFrame) -> DataFrame:
    """(value, label): every candidate token of every text that has no digit and no AKIA, as an ordinary identifier."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("value"))
    return found.filter(~F.col("value").rlike("[0-9]|AKIA")).withColumn("label", F.lit("ordinary word"))


def excess(value: Column, model: Markov) -> Column:
    """Log-likelihood of the string under its best random model less that under its best ordinary one, in nats."""
    tables = [*model.random, *model.ordinary]
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    # folded to one constant while planning; an array of 16,384 literals is as many expressions
    arrays = [F.split(F.lit(" ".join(map(repr, t))), " ").cast("array<double>") for t in tables]
    zero = F.struct(F.lit(-1).alias("last"), *[F.lit(0.0).alias(f"s{i}") for i in range(len(tables))])

    def step(acc, code):
        at = acc["last"] * ASCII + code
        return F.struct(code.alias("last"), *[
            (acc[f"s{i}"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(a, at))).alias(f"s{i}") for i, a in enumerate(arrays)])

    best = lambda sums: F.greatest(*sums) if len(sums) > 1 else sums[0]
    n = len(model.random)
    return F.aggregate(codes, zero, step, lambda acc: best([acc[f"s{i}"] for i in range(n)]) - best(
        [acc[f"s{i}"] for i in range(n, len(tables))]))


def scan(docs: DataFrame, model: Markov | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``secrets``: array of (start, kind, end, value), by start, then kind (index in KINDS).

    start and end are code points, end exclusive.  The base patterns' spans are always there; a candidate token that
    touches none of them is added when its excess is over the model's margin (none without a model, or with one that
    lacks either side).  NULL text counts as empty and has no spans.
    """
    names = docs.columns
    docs = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    for name, pattern, group, least in (
            ("assign", ASSIGN, 2, ASSIGN_LENGTH), ("access", ACCESS, 0, 0), ("hex", HEX, 0, 0), ("markov", CANDIDATE, 0, 0)):
        docs = _matches(docs.withColumnRenamed(name, "_own_" + name) if name in names else docs, name, pattern, group, least)
    docs = docs.withColumn("_base", F.concat("assign", "access", "hex"))
    added = F.lit(None) if model is None or not model.random or not model.ordinary else F.filter("markov", lambda m: ~F.exists(
        "_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])) & (excess(m["value"], model) > model.margin))
    every = F.col("_base") if model is None or not model.random or not model.ordinary else F.concat("_base", added)
    docs = docs.withColumn("_every", F.array_sort(every))
    own = [F.col("_own_" + c if c in KINDS else c).alias(c) for c in names if c != "secrets"]
    return docs.select(*own, F.col("_every").alias("secrets"))


def redact(docs: DataFrame, model: Markov | None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans in text replaced by ``mark``; every row stays."""
    found = scan(docs, model)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate("secrets", empty, lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["start"] < F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    found = found.withColumn("_runs", merged)
    pieces = F.transform("_runs", lambda r, i: F.concat(F.col("text").substr(
        F.coalesce(F.get("_runs", i - 1)["end"], F.lit(0)) + 1, r["start"] - F.coalesce(F.get("_runs", i - 1)["end"], F.lit(0))), F.lit(mark)))
    tail = F.col("text").substr(F.element_at("_runs", -1)["end"] + 1, F.length("text"))
    text = F.when(F.size("_runs") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
