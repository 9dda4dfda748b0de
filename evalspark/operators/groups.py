"""Connected components of a table of links, and splits that keep them whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, strip
from ..session import work_path

BIG = 200  # a component with more than one in so many rows is placed by its size, so at most that many are
SLOTS = 10_000


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large_star(links: DataFrame) -> DataFrame:
    """Greater neighbours of each node are linked to its least neighbour (or itself)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Lesser neighbours of each node, and the node, are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, b): the least node that each node reaches; nodes that are no node's neighbour are left out.

    Large and small stars take turns until nothing moves, which takes a number of rounds that grows with the square of the
    logarithm of the nodes.  Links never grow in number, a node's neighbours are only reduced to their minimum and never listed,
    and every round is written down.
    """
    links = _kept(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        links = _kept(_small_star(_large_star(links)), "links")
        state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            break
        before = state
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def question_key(question: Column) -> Column:
    """A question without case, punctuation and spacing."""
    letters = F.regexp_replace(F.lower(question), rf"[^\p{{L}}\p{{N}}{BLANKS}]", "")
    return strip(F.regexp_replace(letters, rf"[{BLANKS}]+", " "))


def sql_form(query: Column) -> Column:
    """A query without case, spacing and the values of its literals."""
    bare = F.regexp_replace(F.lower(query), "'[^']*'", "?")
    bare = F.regexp_replace(bare, r"(?<![a-z0-9_.])[0-9]+(?:\.[0-9]+)?", "?")
    return strip(F.regexp_replace(bare, rf"[{BLANKS}]+", " "))


def with_component(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` and ``component``: rows that share a key, or are joined by others that do, have one.

    The n-th key of a row meets the n-th keys of others; NULL and empty keys meet none.  A row without keys is a component of its own.
    """
    nodes = [F.when(k != "", F.concat(F.lit(f"{i}:"), F.md5(k))) for i, k in enumerate(keys)]
    own = F.concat(F.lit("row:"), F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    keyed = df.withColumn("_nodes", F.array_compact(F.array(*nodes))).withColumn("_node", F.coalesce(F.get("_nodes", F.lit(0)), own))
    pairs = keyed.where(F.size("_nodes") > 1).select(F.col("_node").alias("a"), F.explode(F.slice("_nodes", 2, len(keys))).alias("b"))
    roots = _kept(components(pairs), "roots").withColumnRenamed("node", "_of")
    return keyed.join(roots, F.col("_node") == F.col("_of"), "left").withColumn("component", F.coalesce("root", "_node")).drop("_nodes", "_node", "_of", "root")


def split_components(df: DataFrame, share: float = 0.1, seed: int = 42, component: str = "component") -> DataFrame:
    """``df`` and ``part``: ``train`` or ``validation`` by whole components, with ``share`` of the rows in validation.

    Components with more than 1 in 200 rows (so 200 at most) are placed one after the other, the largest first, where they fit.  The
    others fall into 10,000 slots by a hash with the seed, and the first slots fill up what is missing.  So the share is met to half a
    percent and a slot, unless large components leave too little to choose from.  Sizes of large components and slots
    reach the driver.
    """
    slot = F.pmod(F.xxhash64(F.col(component), F.lit(seed)), F.lit(SLOTS))
    sizes = _kept(df.groupBy(F.col(component).alias("_component")).agg(F.count("*").alias("_n")).withColumn("_slot", F.pmod(
        F.xxhash64("_component", F.lit(seed)), F.lit(SLOTS))), "sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    missing, chosen = share * total, []
    large = sizes.where(F.col("_n") * BIG > total)
    for row in sorted(large.collect(), key=lambda r: (-r["_n"], r["_slot"], r["_component"])):
        if row["_n"] <= missing:
            chosen.append(row["_component"])
            missing -= row["_n"]
    slots = {r["_slot"]: r["n"] for r in sizes.where(F.col("_n") * BIG <= total).groupBy("_slot").agg(F.sum("_n").alias("n")).collect()}
    end, filled, best = 0, 0, abs(missing)
    for at in sorted(slots):
        filled += slots[at]
        if abs(missing - filled) < best:
            end, best = at + 1, abs(missing - filled)
    big = [r["_component"] for r in large.select("_component").collect()]
    inside = F.when(F.col(component).isin(big), F.col(component).isin(chosen)).otherwise(slot < end) if big else slot < end
    return df.withColumn("part", F.when(inside, "validation").otherwise("train"))
