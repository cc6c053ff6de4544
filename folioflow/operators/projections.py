"""Named projections of graphs: undirected edges as tables of the catalogue, bucketed by one end.

Rounds over a projection join its edges with something that each node has. Edges are stored both ways, in buckets by the end that is
joined, so a round scans them as they lie and shuffles only what the nodes have, and sums that were begun within the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.graph import undirected
from folioflow.plans.lineage import cut, scratch


class Projections:
    """Names live in a database of the catalogue; files in `folder`, a new shared one if it is not given."""

    def __init__(self, spark: SparkSession, database: str = "projections", folder: str | None = None):
        self.spark, self.database, self.folder = spark, database, folder
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")

    def _table(self, name: str) -> str:
        if not name.isidentifier():
            raise ValueError(f"{name} is no name")
        return f"{self.database}.{name}"

    def create(self, name: str, edges: DataFrame, buckets: int = 64) -> None:
        """edges: source, target, strength. Equal pairs become one edge either way; loops go. Raises if the name is taken."""
        if self.exists(name):
            raise ValueError(f"there is a projection {name}")
        pairs = cut(undirected(edges))
        both = pairs.select("a", "b", "weight").union(pairs.select("b", "a", "weight"))
        path = f"{self.folder}/{name}" if self.folder else scratch(self.spark, f"projection-{name}")
        # one file a bucket, so each is read by one task as it lies
        both.repartition(buckets, "b").write.option("path", path).bucketBy(buckets, "b").sortBy("b").saveAsTable(self._table(name))

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._table(name))

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database))

    def edges(self, name: str) -> DataFrame:
        """(a, b, weight), both ways."""
        return self.spark.table(self._table(name))

    def stats(self, name: str) -> DataFrame:
        """(nodes, edges, weight, largest): of one row; largest: the most neighbours that a node has."""
        by_node = self.edges(name).groupBy("b").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
        return by_node.agg(F.count("*").alias("nodes"), F.coalesce((F.sum("n") / 2).cast("long"), F.lit(0)).alias("edges"), F.coalesce(F.sum("w") / 2, F.lit(0.0)).alias("weight"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))

    def drop(self, name: str) -> bool:
        """With its files; False if there was none."""
        if not self.exists(name):
            return False
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self._table(name)}").where("col_name = 'Location'").first()
        self.spark.sql(f"DROP TABLE {self._table(name)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(described.data_type)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return True

    def round(self, name: str, labels: DataFrame) -> DataFrame:
        """(node, community): each node takes the heaviest label around it, ties to the smallest. labels: node, community."""
        # labels are read as nodes of the other end: only they are shuffled to meet the edges
        near = self.edges(name).hint("merge").join(labels.withColumnRenamed("node", "b"), "b")
        votes = near.groupBy("a", "community").agg(F.sum("weight").alias("w"))
        return votes.groupBy(F.col("a").alias("node")).agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("community"))

    def label_propagation(self, name: str, rounds: int = 5) -> DataFrame:
        labels = self.edges(name).select(F.col("b").alias("node")).distinct().withColumn("community", F.col("node"))
        for _ in range(rounds):
            labels = cut(self.round(name, labels))
        return labels
