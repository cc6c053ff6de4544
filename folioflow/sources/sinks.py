"""Where results go: JSON, CSV, run manifests, graphs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "run string, output string, chunks long, seconds double"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_run(spark: SparkSession, path: str, run: str, output: str, chunks: int, seconds: float) -> None:
    """Writes a run to the manifest, in a folder of its own: a run that comes again, from any writer, replaces itself."""
    row = spark.createDataFrame([(output, chunks, seconds)], "output string, chunks long, seconds double").withColumn("run", F.lit(run))
    row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], RUNS)
    return spark.read.schema(RUNS).parquet(path).select("run", "output", "chunks", "seconds")


def flagged(documents: DataFrame, done: DataFrame, key: str, flag: str) -> DataFrame:
    """Documents with a flag set where their key is among those done."""
    marks = done.select(key).distinct().withColumn("_done", F.lit(True))
    return documents.join(marks, key, "left").withColumn(flag, F.coalesce("_done", F.col(flag), F.lit(False))).drop("_done")


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices and edges as tables of a folder, edges apart by their type."""
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def graph_rows(entities: DataFrame, relations: DataFrame, document: str) -> DataFrame:
    """(kind, id, document, chunk_id, name, target, type, description): entities and relationships as rows of one store, each with
    the chunk that it was found in. entities: chunk_id, name, type, description; relations: chunk_id, source, target, type,
    description; id: a hash of what identifies a row, so that writing again changes nothing."""
    told = lambda *c: F.sha2(F.concat_ws("\x1f", *c), 256).alias("id")
    a = entities.select(F.lit("entity").alias("kind"), told(F.lit(document), "chunk_id", "name"), F.lit(document).alias("document"), "chunk_id", "name", F.lit(None).cast("string").alias("target"), "type", "description")
    b = relations.select(F.lit("relationship").alias("kind"), told(F.lit(document), "chunk_id", "source", "target", "type"), F.lit(document).alias("document"), "chunk_id", F.col("source").alias("name"), "target", "type", "description")
    return a.unionByName(b)


def write_reports(sections: DataFrame, report: str, order: str, title: str, text: str, path: str) -> None:
    """Markdown reports, a folder for each: a heading for each section, then its text, in order."""
    part = F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.coalesce(text, F.lit("")), F.lit("\n"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, part.alias("p")))), lambda x: x["p"]), "\n")
    whole = sections.groupBy(report).agg(F.concat(F.lit("# "), F.first(report), F.lit("\n\n"), joined).alias("value"))
    whole.write.mode("overwrite").partitionBy(report).text(path)
