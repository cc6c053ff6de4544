"""Cutting lineage in iterative operators, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one stands in where that is unset and Spark runs on one machine."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folioflow-"))
        given = context.getCheckpointDir()
    return given.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/folioflow/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, where a checkpoint computes twice, and planned by its real size."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_folder = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes what cut() wrote for these tables, which nothing may read any more, and has Spark let go of the shuffles that
    nothing refers to. Other tables are left alone."""
    for df in tables:
        path = getattr(df, "_cut_folder", None)
        if path:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            del df._cut_folder
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def renamed_once(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder, unless the target is there already: of several writers one wins. False for the others."""
    jvm = spark._jvm
    new, options = jvm.org.apache.hadoop.fs.Path(target), getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never = spark.sparkContext._gateway.new_array(options, 1)
    never[0] = options.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(jvm.org.apache.hadoop.fs.Path(source), new, never)
        return True
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
