"""A graph that grows by imports: entities, relations and claims as keyed tables, each merged by its own rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.graph import placed_claims, resolved
from folioflow.sources.keyed import KeyedTable

ENTITIES = "name string, type string, description string, chunk_id string"
RELATIONS = "source string, target string, type string, description string, strength int, chunk_id string"
CLAIMS = "id string, subject string, object string, type string, status string, description string, chunk_id string"
CLAIM_EDGES = "claim string, vertex string, type string"
TENANTS = "kind string, id string, parent string, label string"


class GraphStore:
    """one_per: "pair" keeps one relation of two entities, the last that was imported; "type" one of each type, the first."""

    def __init__(self, spark: SparkSession, folder: str, one_per: str = "pair", buckets: int = 64):
        if one_per not in ("pair", "type"):
            raise ValueError(f"one relation per {one_per}")
        self.one_per = one_per
        self.entities = KeyedTable(spark, f"{folder}/entities", ENTITIES, ["name"], buckets)
        self.relations = KeyedTable(spark, f"{folder}/relations", RELATIONS, ["source", "target"] + ["type"] * (one_per == "type"), buckets)
        self.claims = KeyedTable(spark, f"{folder}/claims", CLAIMS, ["id"], buckets)
        self.claim_edges = KeyedTable(spark, f"{folder}/claim_edges", CLAIM_EDGES, ["claim", "vertex", "type"], buckets)

    def add_entities(self, entities: DataFrame, order: str | None = None) -> int:
        """The last import of a name wins. Names must not be null."""
        return self.entities.merge(entities.where("name is not null"), order)

    def add_relations(self, relations: DataFrame, order: str | None = None) -> int:
        """Those whose two ends are entities by now."""
        return self.relations.merge(resolved(relations, self.entities.read(), "name"), order, "last" if self.one_per == "pair" else "first")

    def add_claims(self, claims: DataFrame, order: str | None = None) -> int:
        """Claims (subject, object, type, status, description, chunk_id) whose subject is an entity, with an edge from it and, where
        that is an entity too, to the object. A claim is told by subject, type and chunk; the first import of it stays, and
        edges to other objects are added."""
        part = lambda c, other: F.coalesce(F.col(c), F.lit(other))
        named = claims.withColumn("id", F.concat_ws("_", "subject", part("type", "CLAIM"), part("chunk_id", "")))
        filled = named.withColumns({"type": part("type", "GENERAL"), "status": part("status", "UNKNOWN"), "description": part("description", "")})
        ends = self.entities.read()
        kept = filled.join(ends.select(F.col("name").alias("subject")), "subject", "left_semi")
        self.claims.merge(kept, order, "first")
        # every import of a claim adds its edges, also those whose row gives way to an earlier one
        each = kept.select(F.xxhash64("id", "subject", "object").alias("updated"), "id", "subject", "object").distinct()
        edges = each.select(F.col("id").alias("claim"), F.explode(F.array(F.struct(F.col("subject").alias("vertex"), F.lit("HAS_CLAIM").alias("type")), F.struct(F.col("object").alias("vertex"), F.lit("REFERS_TO").alias("type")))).alias("e")).select("claim", "e.*")
        return self.claim_edges.merge(edges.join(ends.select(F.col("name").alias("vertex")), "vertex", "left_semi"), None, "first")

    def clear(self) -> None:
        for table in (self.claim_edges, self.claims, self.relations, self.entities):
            table.delete(table.read())


class Tenants:
    """A tree of root, organisations, users and subgraphs: (kind, id, parent, label)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8):
        self.spark, self.table = spark, KeyedTable(spark, f"{folder}/tenants", TENANTS, ["kind", "id"], buckets)

    def _add(self, kind: str, id: str, parent: str | None, label: str | None) -> int:
        return self.table.merge(self.spark.createDataFrame([(kind, id, parent, label)], TENANTS), keep="first")

    def create_root(self, label: str = "Root") -> int:
        return self._add("root", label, None, label)

    def create_organisation(self, id: str, root: str = "Root") -> int:
        return self._add("organisation", id, root, None)

    def create_user(self, id: str, email: str, organisation: str | None = None, root: str = "Root") -> int:
        """Below an organisation, which must be there, or the root."""
        if organisation is not None and not self.exists("organisation", organisation):
            raise ValueError(f"no organisation {organisation}")
        self._add("user", id, organisation or root, email)
        return self._add("subgraph", id, id, None)

    def exists(self, kind: str, id: str) -> bool:
        return not self.table.read().where((F.col("kind") == kind) & (F.col("id") == id)).isEmpty()

    def subgraph_of(self, user: str) -> str | None:
        found = self.table.read().where((F.col("kind") == "subgraph") & (F.col("parent") == user)).first()
        return found.id if found else None

    def delete(self, kind: str, id: str) -> int:
        """With all that stands below: users of an organisation, subgraphs of users."""
        tree = self.table.read()
        gone = tree.where((F.col("kind") == kind) & (F.col("id") == id)).select("kind", "id")
        below = {"root": ["organisation", "user", "subgraph"], "organisation": ["user", "subgraph"], "user": ["subgraph"], "subgraph": []}[kind]
        every, last = gone, gone
        for level in below:
            # a root has users of its own, too, so all that has gone so far may be a parent
            last = tree.where(F.col("kind") == level).join(every.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi").select("kind", "id")
            every = every.unionByName(last)
        return self.table.delete(every)
