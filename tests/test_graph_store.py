"""Merges that rewrite what they touch, atomic versions, tenants."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators.graph import label_propagation, undirected
from folioflow.operators.graph_store import GraphStore, Tenants
from folioflow.operators.projections import Projections
from folioflow.sources import keyed


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return keyed.KeyedTable(spark, str(tmp_path / "t"), "k long, a string, `b.c` array<int>", ["k"], buckets=32)


def some(spark, ids, a):
    return spark.range(ids.start, ids.stop).select(F.col("id").alias("k"), F.lit(a).alias("a"), F.array(F.lit(1)).alias("b.c"), F.lit(5).alias("at"))


def test_a_merge_rewrites_what_it_touches(spark, table):
    assert rows(table.read()) == []
    table.merge(some(spark, range(0, 4000), "old"))
    first = table.version()
    table.merge(some(spark, range(7, 8), "new"))
    second = table.version()
    assert len(first.folders) == 32 and sum(first.folders[b] != second.folders[b] for b in first.folders) == 1
    assert 0 < table.rewritten(2) < sum(second.bytes.values()) / 16 and table.rewritten(1) == sum(first.bytes.values())
    assert {r.k for r in table.read().where("a = 'new'").collect()} == {7} and table.read().count() == 4000
    assert table.read(1).where("a = 'new'").count() == 0
    table.delete(some(spark, range(100, 140), ""))
    assert table.read().count() == 3960 and table.vacuum(orphan_seconds=0) > 0
    assert table.read().count() == 3960 and table.versions() == [3]


def test_which_row_of_a_key_stays(spark, table):
    make = lambda *r: spark.createDataFrame(r, "k long, a string, `b.c` array<int>, at int")
    table.merge(make((1, "x", [1], 1), (1, "y", None, 3), (1, "z", [2], 2), (None, "n", [], 1), (None, "m", [], 2)), "at")
    assert rows(table.read()) == [(1, "y", None), (None, "m", [])]
    table.merge(make((1, "w", None, 9), (2, "v", None, 2), (2, "u", None, 1)), "at", "first")
    assert rows(table.read()) == [(1, "y", None), (2, "u", None), (None, "m", [])]
    table.merge(make((1, "w", None, 0), (None, "o", None, 0)), "at")
    assert rows(table.read()) == [(1, "w", None), (2, "u", None), (None, "o", None)]
    table.merge(make().limit(0))
    assert table.read().count() == 3


def test_a_lost_race_changes_nothing(spark, table, monkeypatch):
    table.merge(some(spark, range(0, 10), "a"))
    stale = table.version()
    table.merge(some(spark, range(0, 10), "b"))
    monkeypatch.setattr(table, "version", lambda number=None: stale)
    with pytest.raises(keyed.LostRace):
        table.merge(some(spark, range(0, 10), "c"))
    monkeypatch.undo()
    assert table.read().where("a <> 'b'").count() == 0 and table.versions() == [1, 2]


def test_a_graph_is_cleared(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path), buckets=4)
    store.add_entities(spark.createDataFrame([("a", "t", "d", "c"), ("b", "t", "d", "c"), (None, "t", "d", "c")], "name string, type string, description string, chunk_id string"))
    store.add_relations(spark.createDataFrame([("a", "b", "r", "d", 1, "c"), ("a", "x", "r", "d", 1, "c")], "source string, target string, type string, description string, strength int, chunk_id string"))
    claims = [("a", "b", None, None, None, None), ("a", "x", None, None, None, None), ("x", "a", "t", "s", "d", "c")]
    store.add_claims(spark.createDataFrame(claims, "subject string, object string, type string, status string, description string, chunk_id string"))
    assert store.entities.read().count() == 2 and store.relations.read().count() == 1
    assert [tuple(r)[:2] + tuple(r)[3:6] for r in store.claims.read().collect()] == [("a_CLAIM_", "a", "GENERAL", "UNKNOWN", "")]
    assert rows(store.claim_edges.read()) == [("a_CLAIM_", "a", "HAS_CLAIM"), ("a_CLAIM_", "b", "REFERS_TO")]
    store.clear()
    assert all(x.read().count() == 0 for x in (store.entities, store.relations, store.claims, store.claim_edges))


def test_tenants(spark, tmp_path):
    tenants = Tenants(spark, str(tmp_path), buckets=2)
    tenants.create_root()
    tenants.create_organisation("o1")
    tenants.create_user("u1", "a@b", "o1")
    tenants.create_user("u2", "c@d")
    with pytest.raises(ValueError, match="no organisation"):
        tenants.create_user("u3", "e@f", "o2")
    assert tenants.exists("user", "u1") and tenants.subgraph_of("u1") == "u1" and tenants.subgraph_of("u3") is None
    tenants.delete("organisation", "o1")
    assert not tenants.exists("user", "u1") and not tenants.exists("subgraph", "u1") and tenants.exists("user", "u2") and tenants.exists("subgraph", "u2")
    tenants.delete("root", "Root")
    assert tenants.table.read().count() == 0


def test_projections(spark, tmp_path):
    held = Projections(spark, "projections_test", str(tmp_path))
    edges = spark.createDataFrame([(1, 2, 1), (2, 1, 2), (2, 3, 1), (4, 4, 9), (5, 6, 1)], "source long, target long, strength int")
    assert not held.exists("g") and not held.drop("g") and held.names() == []
    held.create("g", edges, 8)
    with pytest.raises(ValueError, match="there is"):
        held.create("g", edges, 8)
    assert held.exists("g") and held.names() == ["g"] and tuple(held.stats("g").first()) == (5, 3, 5.0, 2)
    # labels are shuffled, edges are not: of the two exchanges of a round one is below the join and one of votes above it
    labels = held.edges("g").select(F.col("b").alias("node")).distinct().withColumn("community", F.col("node"))
    plan = held.round("g", labels)._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :]
    left = join[: join.index("Bucketed: true")]
    assert "Exchange" not in left, plan
    assert {r.node: r.community for r in held.label_propagation("g", 2).collect()} == {r.node: r.community for r in label_propagation(undirected(edges), 2).collect()}
    assert held.drop("g") and not held.exists("g") and list(tmp_path.iterdir()) == []
    held.create("empty", edges.limit(0), 2)
    assert tuple(held.stats("empty").first()) == (0, 0, 0.0, 0) and held.drop("empty")
