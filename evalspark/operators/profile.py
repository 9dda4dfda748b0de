"""Profiling of questions, their SQL and its results (family D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import sqltext as sql
from ..functions.results import result_structure
from ..functions.text import contains_any, let, words
from .heavy import most_frequent
from .ranking import exact_quantiles

# fixed values: first words that type a question
QUESTION_STARTERS = ("what", "how", "when", "where", "which", "who", "why", "is", "are", "can", "do", "does")

# fixed values: intents in order of precedence with their phrases
INTENTS = {
    "Count/Quantity": ("how many", "count", "number of", "total number", "total amount"),
    "Existence": ("is there", "are there", "has", "have", "did", "does", "do"),
    "Time/When": ("when", "what time", "what date", "how long", "how often"),
    "Value/Measure": (
        "how much", "what is the value", "what was the", "average", "mean", "median", "maximum", "minimum"),
    "Comparison": (
        "more than", "less than", "greater than", "higher than", "lower than", "compared to", "versus"),
    "List/Enumeration": ("what are", "list", "show me", "display", "give me all"),
    "Latest/Recent": ("latest", "most recent", "last", "newest"),
    "First/Earliest": ("first", "earliest", "oldest", "initial"),
}
# fixed values: intents by first word when no phrase matches
FIRST_WORD_INTENTS = {
    "what": "Information", "who": "Person", "where": "Location", "why": "Reason", "how": "Method/Process",
}

# fixed values: lower bounds of the complexity levels
COMPLEXITY_LEVELS = {"Simple": None, "Moderate": 5, "Complex": 10, "Very Complex": 15}

MEAN_COMPONENTS = (
    "select_count", "from_count", "where_count", "join_count", "group_by_count", "order_by_count", "limit_count",
    "distinct_count", "subquery_count",
)


def has_sql(query: str = "true_query") -> Column:
    """The group most profiles split by."""
    return F.when(F.col(query).isNotNull(), "With SQL").otherwise("Without SQL")


def null_share(df: DataFrame, query: str = "true_query") -> DataFrame:
    """Rows with and without a query, and their percent."""
    nulls, total = F.count_if(F.col(query).isNull()), F.count("*")
    return df.agg(
        nulls.alias("null_count"), F.count(query).alias("non_null_count"),
        F.try_divide(nulls * 100, total).alias("null_percent"),
        F.try_divide(F.count(query) * 100, total).alias("non_null_percent"),
    )


def question_type(question: Column) -> Column:
    first = F.get(words(F.lower(question)), F.lit(0))
    return let(first, lambda w: F.when(w.isin(*QUESTION_STARTERS), w).otherwise("other"))


def question_features(df: DataFrame, question: str = "question") -> DataFrame:
    """Length, word count and type of each question."""
    text = F.col(question)
    return df.withColumns({
        "question_length": F.length(text),
        "question_word_count": F.size(words(text)),
        "question_type": question_type(text),
    })


def length_histogram(df: DataFrame, by: list[str], value: str = "question_length", width: int = 10) -> DataFrame:
    """D3: rows per group and bin of the given width."""
    start = (F.floor(F.col(value) / width) * width).cast("bigint")
    return df.groupBy(*by, start.alias("bin_start")).agg(F.count("*").alias("n"))


def five_numbers(df: DataFrame, by: list[str], value: str = "question_word_count") -> DataFrame:
    """Minimum, quartiles, maximum and mean per group, of a value of small domain such as a word count."""
    return df.groupBy(*by).agg(
        F.min(value).cast("double").alias("minimum"),
        *[F.percentile(value, share).alias(name) for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
        F.max(value).cast("double").alias("maximum"), F.avg(value).alias("mean"),
    )


def word_frequency(df: DataFrame, by: list[str], text: str, stop_words: list[str], k: int = 15) -> DataFrame:
    """The ``k`` most frequent words per group, ties by word.

    Lower-cases, drops everything but letters, digits, underscores and blanks, then stop words.  Counts are exact, but only of
    words that may be among the first; summaries of bounded size tell which.
    """
    clean = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]", "")
    return most_frequent(df.select(*by, words(clean).alias("_words")), list(by), "_words", k, list(stop_words))


def default_stop_words(spark) -> list[str]:
    """An English stop-word list that ships with Spark."""
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("english"))


def type_percent(df: DataFrame, by: list[str], kind: str = "question_type") -> DataFrame:
    """Percent of each type within its group."""
    counts = df.groupBy(*by, kind).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*by))
    return counts.withColumn("percentage", F.col("_n") * 100 / total).drop("_n")


def sql_components(df: DataFrame, query: str = "true_query") -> DataFrame:
    """Counted parts, weighted complexity and its level."""
    counts = sql.component_counts(F.col(query))
    return (
        df.withColumns(counts)
        .withColumn("query_complexity", sql.complexity_score())
        .withColumns({"complexity_level": complexity_level(F.col("query_complexity"))})
    )


def complexity_level(score: Column) -> Column:
    """Level by lower bound; a score on the bound belongs to the higher level."""
    level = F.lit(None).cast("string")
    for name, bound in COMPLEXITY_LEVELS.items():
        level = F.lit(name) if bound is None else F.when(score >= bound, name).otherwise(level)
    return F.when(score.isNotNull(), level)


def complexity_level_counts(df: DataFrame) -> DataFrame:
    """Rows per level, with the rank that orders the levels."""
    rank = F.array_position(F.array(*map(F.lit, COMPLEXITY_LEVELS)), F.col("complexity_level"))
    return (
        df.groupBy("complexity_level").agg(F.count("*").alias("n"))
        .withColumn("level_rank", rank).orderBy("level_rank")
    )


def describe(df: DataFrame, value: str, by: list[str] = (), wide: bool = False) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum.

    A score has few distinct values, so its quartiles ride along in one pass;
    ``wide`` is for values of any variety, whose quartiles come from counts of their digits.
    """
    by, shares = list(by), {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    names = ["count", "mean", "std", "min", *shares, "max"]
    moments = [
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ]
    if not wide:
        cuts = [F.percentile(value, share).alias(name) for name, share in shares.items()]
        return df.groupBy(*by).agg(*moments, *cuts).select(*by, *names)
    key = by or ["_all"]
    data = df if by else df.withColumn("_all", F.lit(1))
    cuts = exact_quantiles(data, key, value, list(shares.values()))
    cuts = cuts.select(*key, *[F.col("quantiles")[i].alias(name) for i, name in enumerate(shares)])
    return data.groupBy(*key).agg(*moments).join(cuts, key, "left").select(*by, *names)


def component_means(df: DataFrame, components: tuple[str, ...] = MEAN_COMPONENTS) -> DataFrame:
    """Mean of each count, in long form."""
    wide = df.agg(*[F.avg(c).alias(c) for c in components])
    return wide.unpivot([], list(components), "component", "average")


def question_intent(question: Column) -> Column:
    """First intent with a phrase in the question, else by its first word."""
    by_word = F.create_map(*[F.lit(x) for pair in FIRST_WORD_INTENTS.items() for x in pair])

    def intent_of(text: Column) -> Column:
        out = F.when(text.isNull(), "Unknown")
        for intent, phrases in INTENTS.items():
            out = out.when(contains_any(text, phrases), intent)
        return out.otherwise(F.coalesce(F.try_element_at(by_word, F.get(words(text), F.lit(0))), F.lit("General Query")))

    return let(F.lower(question), intent_of)


def intent_counts(df: DataFrame, question: str = "question") -> DataFrame:
    """Rows per intent."""
    return df.groupBy(question_intent(F.col(question)).alias("intent")).agg(F.count("*").alias("n"))


def with_result_structure(df: DataFrame, results: str = "results", prefix: str = "result_") -> DataFrame:
    """Shape of each JSON result."""
    return df.withColumns({
        name if name.startswith(prefix) else prefix + name: col
        for name, col in result_structure(F.col(results)).items()
    })


def result_type_counts(df: DataFrame, results: str = "results") -> DataFrame:
    """Rows per result type."""
    kind = result_structure(F.col(results))["result_type"].alias("result_type")
    return df.select(kind).groupBy("result_type").agg(F.count("*").alias("n"))


def shuffled(df: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """Rows in an order that only the seed decides."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), F.col(key))
