"""URL verdicts by host rules and, beyond them, by character language models; DataFrame functions only.

URLs that a rule accepts or rejects train two Markov models of variable order: each character is predicted by the longest context
that was seen before it, blended with the next shorter ones by how many different characters follow each (Witten-Bell).  A URL
without a rule is judged by the log-likelihood difference per character, against a threshold calibrated on labelled URLs that
were kept out of a second pair of models.  Counts, probabilities and scores stay tables; only totals, means and deviations
reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MODELS = ("a_all", "r_all", "a_fit", "r_fit")  # accepted and rejected, over all labelled URLs and without those held out
_OPEN, _CLOSE = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_UNIT = 1_000_000  # differences are summed in millionths of a nat, so sums do not depend on their order


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths below one."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Models:
    """``order`` characters of context at most; ``alphabet`` characters are equally likely before any is seen.

    URLs whose md5 ends in one of ``held_out`` calibrate the threshold.
    """

    order: int = 4
    alphabet: int = 256
    held_out: str = "012"


def _rest(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), url.substr(F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to /, ?, # or the end, in lower case (A-Z); empty without one and for NULL."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def spelling(url: Column) -> Column:
    """What the models read: the URL after ``://``, its host in lower case; the whole of a URL without; empty for NULL."""
    tail = F.regexp_extract(_rest(url), r"(?s)^[^/?#]*(.*)\z", 1)
    return F.coalesce(F.concat(host_of(url), tail), url, F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...], result) -> Column:
    """``result(rule)`` of the longest rule that fits host and path; NULL where none does."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, result(rule)) if out is None else out.when(fits, result(rule))
    return F.lit(None).cast("string") if out is None else out


def _grams(texts: DataFrame, how: Models, *columns: str) -> DataFrame:
    """(columns, gram): each character of ``text`` and the end, with the ``order`` characters before it."""
    padded = F.concat(F.lit(_OPEN * how.order), "text", F.lit(_CLOSE))
    grams = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{how.order + 1}}}))."), F.lit(1))
    return texts.select(*columns, F.explode(grams).alias("gram"))


def _counts(texts: DataFrame, how: Models) -> DataFrame:
    """(size, s, needed, n_m, all_m, kinds_m): per string of up to order + 1 characters and model m, how often it was seen, how
    often its context was, and how many different characters followed that; needed marks parts of grams to be scored."""
    label, fit = F.col("label"), ~F.col("held")
    seen = {"a_all": label == 1, "r_all": label == 0, "a_fit": (label == 1) & fit, "r_fit": (label == 0) & fit}
    whole = _grams(texts, how, "label", "held").groupBy("gram").agg(
        *[F.count_if(F.coalesce(test, F.lit(False))).alias(f"n_{m}") for m, test in seen.items()],
        F.count_if(F.col("label").isNull() | F.col("held")).alias("uses"))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(how.order + 1))).alias("size")
    parts = whole.select("*", sizes).withColumn("s", F.expr("right(gram, size)"))
    parts = parts.groupBy("size", "s").agg(
        *[F.sum(f"n_{m}").alias(f"n_{m}") for m in MODELS], F.sum("uses").alias("uses"))
    context = Window.partitionBy("size", F.expr("left(s, size - 1)"))
    return cut(parts.select("*", *[F.sum(f"n_{m}").over(context).alias(f"all_{m}") for m in MODELS],
                            *[F.count_if(F.col(f"n_{m}") > 0).over(context).alias(f"kinds_{m}") for m in MODELS]).filter("uses > 0"))


def _differences(counts: DataFrame, how: Models) -> DataFrame:
    """(gram, uses, d_all, d_fit): accepted less rejected log probability of a gram's last character, in millionths of a nat."""
    below = None
    for size in range(1, how.order + 2):
        level = counts.filter(F.col("size") == size)
        if below is None:
            level = level.withColumns({f"p_{m}": F.lit(1.0 / how.alphabet) for m in MODELS})
        else:
            level = level.withColumn("shorter", F.expr(f"right(s, {size - 1})")).join(below, "shorter")
        blended = {m: F.when(F.col(f"all_{m}") > 0, (F.col(f"n_{m}") + F.col(f"kinds_{m}") * F.col(f"p_{m}")) / (
            F.col(f"all_{m}") + F.col(f"kinds_{m}"))).otherwise(F.col(f"p_{m}")) for m in MODELS}
        below = level.select(F.col("s").alias("shorter"), "uses", *[p.alias(f"p_{m}") for m, p in blended.items()])
        last, below = below, below.drop("uses")
    gap = lambda kind: F.round((F.log(f"p_a_{kind}") - F.log(f"p_r_{kind}")) * _UNIT).cast("long")
    return cut(last.select(F.col("shorter").alias("gram"), "uses", gap("all").alias("d_all"), gap("fit").alias("d_fit")))


def _looked_up(rows: DataFrame, values: DataFrame, key: str, share: int = 4096) -> DataFrame:
    """``rows`` joined with ``values``, one row per key with its number of ``uses``; every row has its value.

    Keys of at least one in ``share`` uses, so at most ``share`` keys, are broadcast; no other key is hot, and those are shuffled.
    """
    total = values.agg(F.sum("uses")).first()[0] or 0
    often = F.col("uses") * share >= total
    hot = F.broadcast(values.filter(often).drop("uses"))
    rest = values.filter(~often).drop("uses")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def scores(texts: DataFrame, how: Models) -> DataFrame:
    """(key, label, held, score): for texts (key, text, label, held) without a label or held out.

    The score is the log-likelihood difference in nats per character, the end counted as one.
    """
    differences = _differences(_counts(texts, how), how)
    wanted = texts.filter("label IS NULL OR held")
    rows = _looked_up(_grams(wanted, how, "key", "label", "held"), differences, "gram")
    sums = rows.groupBy("key", "label", "held").agg(
        F.sum(F.when(F.col("held"), F.col("d_fit")).otherwise(F.col("d_all"))).alias("sum"), F.count("*").alias("n"))
    return sums.select("key", "label", "held", (F.col("sum") / F.col("n") / _UNIT).alias("score"))


def calibrated(scored: DataFrame) -> float:
    """The score that is as many deviations below the mean of held-out accepted URLs as above that of rejected ones.

    0 where a side is missing or accepted URLs do not score higher on average; the middle of the means where no score deviates.
    """
    held = scored.filter("held").groupBy("label").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"))
    sides = {r.label: r for r in held.collect()}
    if set(sides) != {0, 1} or sides[1].mean <= sides[0].mean:
        return 0.0
    low, high = sides[0], sides[1]
    spread = low.deviation + high.deviation
    return (high.mean * low.deviation + low.mean * high.deviation) / spread if spread > 0 else (low.mean + high.mean) / 2


def judged(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url", how: Models | None = None) -> DataFrame:
    """All columns of ``pages`` and host, path, rule, verdict (allow or block) and score (NULL where a rule decides).

    Each different URL counts once in the models; repeated rows get equal verdicts.  NULL URLs and those without ``://`` have empty
    host and path and are judged as spelled (NULL as the empty text).  Without labelled URLs of a side its model knows
    nothing but the alphabet.  Columns of ``pages`` that have the names of the added ones are replaced.
    """
    how = how or Models()
    added = ("host", "path", "rule", "verdict", "score")
    names = [c for c in pages.columns if c.lower() not in added or c == url_col]
    kept = [c for c in names if c.lower() not in added]
    url = F.col(f"`{url_col}`")
    # the columns that stay travel as one, so no name of theirs meets one used here
    rows = pages.select(F.struct(F.lit(0).alias("host"), *[F.col(f"`{c}`") for c in kept]).alias("_row"), F.struct(
        host_of(url).alias("host"), path_of(url).alias("path"), spelling(url).alias("text")).alias("_url"))
    by_rule = lambda result: rule_for(F.col("_url.host"), F.col("_url.path"), rules, result)
    rows = rows.withColumns({"_rule": by_rule(lambda r: F.lit(r.name)), "_verdict": by_rule(lambda r: F.lit(r.verdict))})
    parts = [F.col("_url.host").alias("host"), F.col("_url.path").alias("path"), F.col("_rule").alias("rule")]

    label = F.when(F.col("_verdict") == "allow", 1).when(F.col("_verdict") == "block", 0)
    texts = rows.select(F.col("_url.text").alias("text"), label.alias("label")).groupBy("text", "label").agg(F.count("*").alias("uses"))
    key = F.md5("text")
    held = F.col("label").isNotNull() & F.right(key, F.lit(1)).isin(*how.held_out)
    texts = cut(texts.withColumns({"key": key, "held": held}))

    scored = cut(scores(texts, how))
    least = calibrated(scored)
    verdicts = scored.filter("label IS NULL").join(texts.filter("label IS NULL").select("key", "uses"), "key").select(
        F.col("key").alias("_key"), "uses", F.when(F.col("score") >= least, "allow").otherwise("block").alias("verdict"), "score")
    parts = [F.col(f"_row.`{c}`").alias(c) for c in kept] + parts
    decided = rows.filter("_rule IS NOT NULL").select(*parts, F.col("_verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    open_ = rows.filter("_rule IS NULL").withColumn("_key", F.md5("_url.text"))
    looked = _looked_up(open_, cut(verdicts), "_key").select(*parts, "verdict", "score")
    return decided.unionByName(looked)
