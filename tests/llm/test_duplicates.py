"""Near-duplicate operators against brute force."""

import random

import numpy as np
import pytest
from helpers import docs_of, near_sets, smallest
from pyspark.sql import functions as F

from folioflow.llm import hnsw, minhash
from folioflow.llm.components import components, forest


def word_set(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def family(rng, n, length, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width, block_rows", [(2, 2000), (5, 7)])
def test_near_duplicates(spark, width, block_rows, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0 if width == 5 else 10**6)
    rng = random.Random(width)
    texts = [*family(rng, 60, 100, 14), *family(rng, 40, 60, 6), *family(rng, 3, 3000, 200), None, "", " \n", "one", "One", "one two", "two  ONE", "é", "É"]
    texts += texts[:20] + [texts[0].upper()] * 15
    rows = list(enumerate(texts, 10))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_of(spark, rows).repartition(4), width, 80).collect()}
    sets = {i: word_set(t, width) for i, t in rows}
    want = smallest(sets, near_sets(sets, 80))
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in sets.items())


def test_rows_without_or_with_the_same_id(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "x y z"), (None, None)]
    got = minhash.near_duplicates(docs_of(spark, rows), 2, 80).collect()
    assert sorted(repr((r.doc_id, r.component_id, r.kept)) for r in got) == sorted(map(repr, [(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True), (None, None, True)]))
    assert minhash.near_duplicates(docs_of(spark, []), 2, 80).count() == 0
    # another text under the same id is a node of its own
    got = minhash.near_duplicates(docs_of(spark, [(5, "a b c"), (3, "p q r"), (5, "P Q R"), (7, "A B C")]), 2, 80).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False)]


def test_distinct_documents(spark):
    rows = [(None, "a b c"), (4, "a b c", "fr"), (4, "a b c", "de"), (4, "A b c"), (9, "a b c"), (2, "x y z"), (None, None), (None, None), (6, ""), (6, ""), (8, None), (1, "only one"), (1, "another text"), (0, "Another text")]
    docs = docs_of(spark, rows * 2)
    got = minhash.distinct_documents(docs, 2, 80)
    assert got.columns == docs.columns
    kept = sorted(map(repr, ((r.doc_id, (r.text or "").lower() if r.doc_id == 4 else r.text) for r in got.collect())))
    want = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (2, "x y z"), *[(None, None)] * 4, *[(6, "")] * 4, *[(8, None)] * 2, (1, "only one"), (0, "Another text")]
    assert kept == sorted(map(repr, want))
    again = minhash.distinct_documents(docs.repartition(7), 2, 80)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))
    assert minhash.distinct_documents(docs_of(spark, []), 2, 80).count() == 0


def test_heavy_groups_are_joined_alike(spark, monkeypatch):
    from folioflow.llm.common import joined_to_groups

    rows = spark.createDataFrame([(i % 3 if i < 4000 else i, i) for i in range(5000)], "k long, v long")
    groups = rows.groupBy("k").count().withColumn("x", F.col("k") * 2).where("k <> 4500")
    for how, n in (("inner", 4999), ("left", 5000)):
        got = joined_to_groups(rows, groups, ["k"], "count", how)
        assert got.count() == n and got.where("x <> 2 * k").count() == 0 and "Broadcast" in got._jdf.queryExecution().toString()


def test_sketches_estimate_high_similarity():
    rng = np.random.default_rng(0)
    for share in (0.7, 0.8, 0.9, 0.99):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (int(2000 * share), int(1000 * (1 - share)), int(1000 * (1 - share))))
        x, y = (minhash.odd_sketch(minhash.samples(np.concatenate([common, z]))) for z in (a, b))
        bits = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert abs(minhash.estimate(bits) - share) < 0.1
        assert share < 0.8 or bits <= minhash.farthest(0.8)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == smallest({x for e in links for x in e}, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = np.array([3, 5, 8]), np.array([5, 1, 9])
    assert forest(a, b, 10).tolist() == [0, 1, 2, 1, 4, 1, 6, 7, 8, 8]


VECTORS = "vec_id long, embedding array<float>, label int, score double, links long"


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_near_vectors(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_GROWTH", 0)
    monkeypatch.setattr(hnsw, "BLOCK_SHARDS", 2)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    points = [*rng.normal(size=(150, 16)), *(b + rng.normal(size=16) * 0.28 for b in base for _ in range(6)), *(base[0] + rng.normal(size=16) * 0.05 for _ in range(80))]
    points = [np.float32(p).tolist() for p in points]
    points += points[:10] + [(np.float32(2) * np.float32(points[3])).tolist()]
    rows = [(i, p, i % 2, 0.0, 1) for i, p in enumerate(points)]
    odd = [None, [0.0] * 16, [], [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, points[0][:8]]
    rows += [(1000 + i, v, 0, 0.0, 1) for i, v in enumerate(odd)] + [(2000, points[0], None, 0.0, 1), (None, points[0], 0, 0.0, 1)]
    got = {r.vec_id: r for r in hnsw.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), 0.93, shard_rows).collect()}
    x = np.array(points, float)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = (unit @ unit.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2)
    np.fill_diagonal(near, False)
    want = smallest(range(len(x)), [tuple(map(int, e)) for e in np.argwhere(near) if e[0] < e[1]])
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert {i: got[i].component_id for i in range(len(x))} == want and all(got[i].kept == (want[i] == i) for i in want)
    for i in [*range(1000, 1000 + len(odd)), 2000, None]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert hnsw.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    x[500:1000] = x[0] + rng.normal(size=(500, 24)) * 0.15
    graph = hnsw.Layers((x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32))
    search = hnsw.Searcher(graph, x, np.ones(1500, np.int64), 0.93)
    search.audit(x)
    total, one = search.links(x, np.arange(1500))
    i, j = hnsw._exact(*hnsw._all(graph.unit, graph.unit, 0.9299), x, x, 0.93)
    true = np.bincount(i[i != j], minlength=1500)
    assert (total <= true).all() and total.sum() >= 0.99 * true.sum() and ((one >= 0) == (total > 0)).all()
    assert len(set(search.label[500:1000].tolist()) | {search.label[0]}) == 1


def test_vectors_whose_id_or_scale_is_odd(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (1, [0.0, 1.0, 0.001], 1), (3, [0.0, 1.0, 0.0], 1), (0, [-0.0, 2.0, 0.0], 0)]
    got = hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted([(1, 1, 1, True), (1, 1, 0, False), (2, 1, 1, False), (1, 1, 1, True), (3, 1, 1, False), (0, 1, 0, True)])
    big = [(1, [1e300, 1e299], "a"), (2, [2e300, 2e299], "a"), (3, [1e-300, 0.0], "a"), (4, [1.0, 1e-9], "a"), (5, [1.0, 0.41], "a"), (6, [5.0], "a"), (7, [0.1], "a")]
    got = hnsw.near_vectors(spark.createDataFrame(big, "vec_id long, embedding array<double>, label string")).collect()
    unit = {i: np.array(v) / max(v) for i, v, _ in big}
    near = {(i, j) for i in unit for j in unit if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93 * np.sqrt((unit[i] @ unit[i]) * (unit[j] @ unit[j]))}
    assert {r.vec_id: r.n_links for r in got} == {i: sum(a == i for a, _ in near) for i in unit} and (1, 2) in near and (6, 7) in near and (3, 5) not in near


def test_a_dense_cluster_is_folded(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=16) + rng.normal(size=(2000, 16)) * 0.02
    rows = [(i, np.float32(p).tolist(), 0) for i, p in enumerate(points)]
    got = hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(1999, 0)}
