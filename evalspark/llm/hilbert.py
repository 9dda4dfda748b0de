"""Approximate nearest neighbours by inner product over several shifted Hilbert orderings.

Each ordering projects the vectors to a few seeded random directions, shifts them, and sorts them along a Hilbert curve
with a range partitioning.  A query is compared exactly with all vectors within a window of ranks around its own place,
and the windows of all orderings are merged.  Equal vectors are one class, so a vector that a third of the rows share is
one point of the curves; its ids come back at the end.

Vectors are dealt to bands of norms, powers of two around the median, each with its own curves: one long vector does not
squeeze the others into a few cells.  A query searches every band; bands of at most one chunk are searched as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Curves:
    orderings: int = 16
    axes: int = 10  # directions of an ordering
    bits: int = 6  # of a coordinate; axes x bits is at most 62
    window: float = 0.04  # share of a band's points that a query looks at to either side of its place
    chunk: int = 1_024  # points that meet queries in one task
    queries: int = 4_096  # most queries that meet a chunk in one task, on average
    seed: int = 5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer cells (points x axes), each coordinate of ``bits`` bits (Skilling, 2004)."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level
        p = q - 1
        for k in range(n):
            flip = (x[k] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
        q >>= 1
    for k in range(1, n):  # Gray code
        x[k] ^= x[k - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | ((x[k] >> b) & 1)
    return key


def ordering_keys(points: np.ndarray, number: int, how: Curves) -> np.ndarray:
    """Keys of unit vectors in one ordering: seeded orthogonal directions, spread evenly over the axis, shifted."""
    rng = np.random.default_rng([how.seed, number])
    dims = points.shape[1]
    axes = np.linalg.qr(rng.standard_normal((dims, dims)))[0][:, :min(how.axes, dims)]
    z = (points @ axes) * math.sqrt(dims)
    even = 1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))  # nearly uniform for scattered vectors
    cells = ((even + rng.random(axes.shape[1])) / 2 * (1 << how.bits)).astype(np.int64)
    return hilbert_keys(np.clip(cells, 0, (1 << how.bits) - 1), how.bits)


def lifted(vectors: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors of one more dimension whose distance falls as the inner product with a query grows."""
    norms = np.linalg.norm(vectors, axis=1)
    if query:
        return np.column_stack([vectors / norms[:, None], np.zeros(len(vectors))])
    return np.column_stack([vectors / longest, np.sqrt(np.maximum(0.0, 1 - (norms / longest) ** 2))])


def usable(vector: Column) -> Column:
    """Neither NULL, empty nor zero, and without NULL, NaN or infinite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, how: Curves | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): up to ``k`` nearest rows found for each row that ``is_query`` (over id_col) names.

    score is the inner product in double precision; ties go to the smaller id; a row is no neighbour of itself.  Rows
    without an id, with unusable vectors or with another number of components than most rows take no part.  Repeated
    rows count once.  A query without any other usable row has no rows in the result.
    """
    how = how or Curves()
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = f"query_id long, rank int, {id_col} long, score double"
    if usual is None:
        return spark.createDataFrame([], empty)
    rows = rows.filter(F.size("v") == usual.n).distinct()
    rows = rows.withColumnRenamed("id", id_col).withColumn("asks", F.coalesce(is_query, F.lit(False))).withColumnRenamed(id_col, "id")
    # a class of equal vectors keeps its k + 1 smallest ids: more cannot be in anybody's result
    order = Window.partitionBy("v").orderBy("id")
    firsts = rows.select("id", "v").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    classes = cut(firsts.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                  .join(rows.groupBy("v").agg(F.max("asks").alias("asks")), "v")
                  .select(F.element_at("ids", 1).alias("rep"), "v", "ids", "asks"))
    if classes.filter("asks").isEmpty():
        return spark.createDataFrame([], empty)
    norms = classes.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    middle = F.lit(norms.agg(F.percentile_approx("norm", 0.5)).first()[0])
    norms = norms.withColumn("band", F.floor(F.log2(F.col("norm") / middle) + 0.5).cast("int"))
    # a row per power of two
    bands = {r.band: (r.n, r.longest) for r in norms.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    curves = {b: how.orderings if n > how.chunk else 1 for b, (n, _) in bands.items()}
    reach = {b: max(1, math.ceil(how.window * n / how.chunk)) for b, (n, _) in bands.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            ask = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            own = batch.column(3).to_numpy()

            def rows(mine: np.ndarray, query: bool, band: int, c: int, keys: np.ndarray, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                n = len(keys)
                return pa.RecordBatch.from_arrays([
                    *batch.select([0, 1]).filter(pa.array(mine)).columns, pa.array(np.full(n, query)), pa.array(np.full(n, band, np.int32)),
                    pa.array(np.full(n, c, np.int32)), pa.array(keys)], names=["rep", "v", "query", "band", "curve", "key"])

            for band in np.unique(own).tolist():
                unit = lifted(v[own == band], bands[band][1], False)
                for c in range(curves[band]):
                    yield rows(own == band, False, band, c, ordering_keys(unit, c, how))
            if ask.any():
                unit = lifted(v[ask], 1.0, True)
                for c in range(max(curves.values())):
                    keys = ordering_keys(unit, c, how)
                    for band in bands:
                        if c < curves[band]:
                            yield rows(ask, True, band, c, keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the partition and the number of points before the row in its ordering and partition."""
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column(3).to_numpy().astype(np.int64) * how.orderings + batch.column(4).to_numpy()
            point = (~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)).astype(np.int64)
            before = np.cumsum(point) - point
            first = np.maximum.accumulate(np.where(np.append(True, name[1:] != name[:-1]), np.arange(len(name)), 0))
            before = before - before[first] + np.where((first == 0) & (name[0] == last), n, 0)
            last, n = name[-1], before[-1] + point[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(name), part, np.int32)), pa.array(before)], names=[*batch.schema.names, "part", "inner"])

    shape = "rep long, v array<double>, query boolean, band int, curve int, key long"
    line = ["band", "curve"]
    keyed = norms.select("rep", "v", "asks", "band").mapInArrow(place, shape)
    along = keyed.repartitionByRange(*line, "key", "rep").sortWithinPartitions(*line, "key", "rep", "query")
    along = cut(along.mapInArrow(number, shape + ", part int, inner long"))
    parts = along.groupBy(*line, "part").agg(F.count_if(~F.col("query")).alias("n"))  # a row per ordering and partition
    before = F.sum("n").over(Window.partitionBy(*line).orderBy("part")) - F.col("n")
    ranked = along.join(parts.select(*line, "part", before.alias("before")), [*line, "part"])
    ranked = ranked.withColumn("chunk", ((F.col("before") + F.col("inner")) / how.chunk).cast("long"))
    wide = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in reach.items() for x in pair]), F.col("band").cast("long"))
    last = F.element_at(F.create_map(*[F.lit(x).cast("long") for b, (n, _) in bands.items() for x in (b, (n - 1) // how.chunk)]), F.col("band").cast("long"))
    around = F.explode(F.sequence(F.greatest(F.lit(0), F.least("chunk", last) - wide), F.least(F.col("chunk") + wide, last))).alias("chunk")
    # queries may crowd about few points of another band, so each chunk is copied for as many blocks as its queries need
    loads = cut(ranked.filter("query").select(*line, around).groupBy(*line, "chunk").agg(
        F.ceil(F.count("*") / how.queries).cast("int").alias("blocks")))
    candidates = ranked.filter(~F.col("query")).join(loads, [*line, "chunk"]).select(
        F.col("band").alias("of"), F.col("curve").alias("on"), F.col("chunk").alias("at"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("for"), F.col("rep").alias("near"), F.col("v").alias("w"))
    asking = ranked.filter("query").select(*line, around, "rep", "v").join(loads, [*line, "chunk"]).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "rep": [], "score": []}).astype({"query": "int64", "rep": "int64"})
        right = right.sort_values("near")
        found, ids = np.stack(right.w.to_numpy()), right.near.to_numpy()
        out = []
        asks, names = np.stack(left.v.to_numpy()), left.rep.to_numpy()
        for at in range(0, len(asks), 1_024):
            score = asks[at:at + 1_024] @ found.T
            if score.shape[1] > k + 1:
                least = np.partition(score, score.shape[1] - k - 1, axis=1)[:, -k - 1]
                q, c = np.nonzero(score >= least[:, None])
            else:
                q, c = (x.ravel() for x in np.indices(score.shape))
            out.append(pd.DataFrame({"query": names[at:at + 1_024][q], "rep": ids[c], "score": score[q, c]}))
        return pd.concat(out)

    pairs = asking.groupBy(*line, "chunk", "block").cogroup(candidates.groupBy("of", "on", "at", "for")).applyInPandas(
        rerank, "query long, rep long, score double")
    merged = pairs.groupBy("query", "rep").agg(F.max("score").alias("score"))  # rounding may differ between windows
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = merged.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
    named = top.join(classes.select(F.col("rep").alias("near"), "ids"), F.col("rep") == F.col("near"))
    lists = named.groupBy("query").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(
        (-F.col("score")).alias("far"), i.alias("id"))))).alias("found"))
    lists = lists.select(F.col("query").alias("rep"), F.slice(F.array_sort("found"), 1, k + 1).alias("found"))
    members = rows.filter("asks").select("id", "v").join(classes.select("rep", "v"), "v").select("id", "rep")
    own = members.join(lists, "rep").select(
        "id", F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k).alias("found"))
    return own.select(F.col("id").alias("query_id"), F.posexplode("found").alias("at", "near")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("near.id").alias(id_col), (-F.col("near.far")).alias("score"))
