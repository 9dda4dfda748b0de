"""Nearest neighbours against brute force, and the pipeline stage by stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalspark.llm import decontaminate, hilbert, queries, simhash
from evalspark.llm.common import components, table


def exact(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    for q in queries:
        score = x @ x[list(ids).index(q)]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        yield q, [(int(ids[j]), score[j]) for j in order]


def test_hilbert_keys_step_to_neighbours():
    side = np.arange(8)
    cells = np.stack([g.ravel() for g in np.meshgrid(side, side, side)], axis=1)
    keys = hilbert.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest_of_small_tables_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).round(2).tolist()) for i in range(60)] + [(60 + i, [1.0] * 6) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(hilbert.nearest(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, want in exact(rows, range(0, 110, 20), 20):
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want])


def test_recall_of_curves(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    how = hilbert.Curves(chunk=32)  # windows of 4 % of the points, as in a large table
    got = {}
    for r in hilbert.nearest(df, F.col("vec_id") % 20 == 0, how=how).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = dict(exact(rows, [i for i, _ in rows if i % 20 == 0], 20))
    assert np.mean([len(got[q] & {i for i, _ in w}) / 20 for q, w in want.items()]) >= 0.9


@pytest.mark.parametrize("norms", ["outlier", "heavy"])
def test_recall_with_uneven_norms(spark, norms):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "outlier":
        x[7] *= 100
    else:
        x *= 1 + rng.pareto(1.5, 4_000)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in hilbert.nearest(df, F.col("vec_id") % 20 == 0, how=hilbert.Curves(chunk=32)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = dict(exact(rows, range(0, 4_000, 20), 20))
    assert np.mean([len(got[q] & {i for i, _ in w}) / 20 for q, w in want.items()]) >= 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, []), (None, [9.0, 9.0]), (8, [1.0, 2.0, 3.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = sorted(tuple(r) for r in hilbert.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert hilbert.nearest(df.limit(0), F.lit(True)).count() == 0
    assert hilbert.nearest(df, F.lit(False)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_are_found_and_others_stay(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    docs, group = [], []
    for g in range(40):
        base = [word() for _ in range(300)]
        for c in range(3):
            text = list(base)
            for at in rng.choice(300, c * 3, replace=False):
                text[at] = word()
            docs.append((len(docs), " ".join(text)))
            group.append(g)
    got = simhash.without_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = set()
    for g in range(40):
        members = [i for i, x in enumerate(group) if x == g]
        root = {i: i for i in members}
        for i in members:
            for j in members:
                if i < j and simhash._jaccard(docs[i][1], docs[j][1], 5) >= 0.8:
                    root = {m: min(root[i], root[j]) if root[m] in (root[i], root[j]) else root[m] for m in members}
        want |= set(root.values())
    kept = {r.doc_id for r in got}
    assert want <= kept and len(kept - want) <= 0.05 * (len(docs) - len(want))  # a link at 0.8 may be missed


def kept_by_brute_force(texts):
    sets = []
    for text in texts:
        line, starts, ends = simhash.shingles(text, 5)
        sets.append({line[x:y] for x, y in zip(starts, ends, strict=True)})
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {i for i, r in enumerate(root) if r == i}


def test_near_copies_within_one_template(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    shared, texts = [word() for _ in range(53)], []
    for _ in range(800):
        own = shared + [word() for _ in range(7)]  # 0.78 to all others
        texts.append(" ".join(own))
    for n in range(80):
        text = texts[n].split()
        for at in (6 + n % 40, 59):  # 0.81 to one of them
            text[at] = word()
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.without_copies(docs, bucket_rows=100).collect()}
    want = kept_by_brute_force(texts)
    assert len(want) < 810 and got == want


def some_words(rng, n):
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]


def test_texts_of_equal_simhash_are_not_copies(spark):
    texts, rng = [], np.random.default_rng(5)
    for _ in range(12):
        line = " ".join(some_words(rng, 11)) + " "
        texts += [line * 40 + " ".join(some_words(rng, 50)) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.without_copies(docs).collect()} == kept_by_brute_force(texts) == set(range(24))


def test_copies_with_repeated_lines(spark):
    texts, rng = [], np.random.default_rng(6)
    for _ in range(12):
        text = some_words(rng, 300)
        texts += [" ".join(text), " ".join(text[:290] + text[290:] * 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.without_copies(docs).collect()} == kept_by_brute_force(texts) == set(range(0, 24, 2))


@pytest.mark.parametrize("log_n", [10, 14, 17, 20, 24])
def test_orders_suffice_for_the_recall(log_n):
    prefix = max(8, log_n - 10)
    levels = prefix + max(8, log_n - prefix + 4)
    tables = simhash.tables_for(prefix, levels, 2, 0.8, 0.28, 0.99)
    spots = np.array([np.random.default_rng([11, t]).permutation(256)[:levels] for t in range(tables)])
    rng, found = np.random.default_rng(log_n), 0
    for _ in range(2_000):
        differs = rng.random(256) < np.arccos(2 * 0.8 / 1.8) / np.pi
        read = differs[spots]
        found += differs.sum() <= 0.28 * 256 and bool((~read[:, :prefix].any(axis=1) & (read.sum(axis=1) <= 2)).any())
    assert found / 2_000 >= 0.98


def one_of_each_by_brute_force(docs):
    """The least id of each component of fingerprints that differ in at most two bits."""
    prints = [simhash.fingerprint(text, 3) for _, text in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc_id, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc_id)
    return {min(ids) for ids in groups.values()}


def test_one_of_each_group(spark):
    line = "these words make up a text that is long enough for many shingles of three words each and so on".split()
    texts = [" ".join(line * 8), " ".join(line * 8 + ["more"]), " ".join(line * 8), "something else altogether that is not near", None, "", " "]
    rows = [(i if i != 2 else None, t, i, "x") for i, t in enumerate(texts)] + [(3, texts[3], 9, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, key string").repartition(3)
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    want = one_of_each_by_brute_force([(10**6 if r[0] is None else r[0], r[1]) for r in rows])
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_stages_take_effect(spark, tmp_path):
    tables = "/root/testdata/sf0.001"
    docs = before = table(spark, tables, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{len(kept)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(kept)}")
        kept.append(docs)
        if len(kept) < len(corpus_pipeline.STAGES):
            assert docs.columns == before.columns, name
    toxic, copies, leaks, secrets, ids = kept
    assert before.count() > toxic.count() > copies.count() >= leaks.count() == secrets.count()
    texts = [r.text for r in copies.collect()]
    assert len(set(texts)) == len(texts)
    assert {r.doc_id for r in copies.collect()} == one_of_each_by_brute_force([(r.doc_id, r.text) for r in toxic.collect()])
    assert decontaminate.contaminated(leaks, table(spark, tables, "benchmark")).isEmpty()
    assert secrets.filter(F.col("text").rlike("token = \"[0-9a-f]{12}")).isEmpty()
    assert secrets.filter(F.col("n_chars") != F.length("text")).isEmpty()
    assert ids.select("doc_id").distinct().count() == secrets.count()


def test_stages_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, row int, secrets string, ids string"
    rows = [(None, None, None, None, None, 1, 1, "a", "b"), (1, "", "en", None, 0, 1, 1, None, None), (2, "one text that is here twice", "en", "s", 27, 1, 1, "a", "b"),
            (2, "one text that is here twice", "en", "s", 27, 1, 1, "a", "b"), (3, "word " * 30_000, "en", "s", 150_000, 1, 1, "a", "b")]
    for docs, left in ((spark.createDataFrame(rows, schema), 3), (spark.createDataFrame([], schema), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
                docs = out.checkpoint() if spark.sparkContext.getCheckpointDir() else out
        assert docs.count() == left


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
