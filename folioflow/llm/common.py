"""Shared helpers of the training-data operators: tables, the shared folder, Arrow batches of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that a task turns into words at once; longer single texts are taken alone.
CHARS_AT_ONCE = 1 << 20
#: Words from this length on are not kept in caches.
LONG_WORD = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the third of the rows that no model may learn from; false for a null identifier."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def carried(docs: DataFrame) -> Column:
    """All columns of docs as one struct named row, to travel along whatever their names are."""
    return F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("row")


def with_row(ddl: str, docs: DataFrame, carry: bool) -> T.StructType:
    """The schema in ddl, with the struct of carried() at the end if carry is set."""
    schema = T.StructType.fromDDL(ddl)
    return schema.add("row", T.StructType(docs.schema.fields)) if carry else schema


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch: its column text, or with carried() documents that field of row."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def given(docs: DataFrame, carry: bool, *more: Column | str) -> DataFrame:
    """What a scoring function reads: doc_id, more, and text or, to carry the document along, row."""
    return docs.select("doc_id", *more, carried(docs) if carry else "text")


def first_share(docs: DataFrame, share: float | Column) -> DataFrame:
    """The rows whose doc_id has a hash in the lowest share (0 to 1) of all hashes: a repeatable sample without a shuffle."""
    return docs.where(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= share)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new temporary one where that is unset and Spark runs on one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/folioflow/{what}-{uuid.uuid4().hex}"


#: Rows and bytes of the Arrow batches of whole texts that written() and collected() compute from. The bytes are what bounds
#: the memory that the JVM and Python hold outside of heaps, however long the texts are; a longer single text is taken alone.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes of a row group of a table made by written(): what a task that writes or reads it holds at once.
ROW_GROUP_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs run inside send so many rows and about so many bytes to Python at once; the session's own settings come back
    afterwards."""
    arrow = "spark.sql.execution.arrow"
    wanted = {f"{arrow}.maxRecordsPerBatch": rows, f"{arrow}.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, what: str, *partition_by: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    path = new_path(df.sparkSession, what)
    with small_batches(df.sparkSession):
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy(*partition_by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def collected(df: DataFrame) -> pa.Table:
    """A bounded result at the driver; texts that pass through Python on the way go in small batches."""
    with small_batches(df.sparkSession):
        return df.toArrow()


def renamed_once(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder unless the target is there; of several writers one gets it. False: it was there."""
    jvm = spark._jvm
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.NONE
    path = jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(source), path, how)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written(), once nothing reads them any more."""
    for table in tables:
        removed(table.sparkSession, table.written_to)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Groups with more than this share of all rows are heavy; there are at most 1 / HEAVY of them, so they can be broadcast.
HEAVY = 1e-4


def joined_to_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows, each with the other columns of the group that has its keys; how: inner or left. size: the column of groups that
    counts the rows of a group. Heavy groups are broadcast, so no task of the shuffled join of the others gets more than a
    sliver. groups is read up to four times: give a written table."""
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    limit = max(1000, HEAVY * (total or 0))
    if (most or 0) <= limit:
        return rows.join(groups, keys, how)
    heavy, light = F.broadcast(groups.where(F.col(size) > limit)), groups.where(F.col(size) <= limit)
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys, how))


def text_groups(texts: pa.ChunkedArray | pa.Array, limit: int = CHARS_AT_ONCE) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) in groups of about limit characters; null is the empty text."""
    start, group, size = 0, [], 0
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        if group and size + len(text) > limit:
            yield start, group
            start, group, size = i, [], 0
        group.append(text)
        size += len(text)
    if group:
        yield start, group


_HELD: dict[str, dict] = {}


def let_go(group: str) -> None:
    """Frees what other groups of operators hold in this Python worker; for operators that hold nothing themselves, too."""
    if group not in _HELD:
        _HELD.clear()
        _HELD[group] = {}


def held(group: str, key: str, make):
    """What a Python worker keeps between tasks, made once for each key. Workers outlive a job, so what belongs to another
    group of operators is let go first."""
    let_go(group)
    kept = _HELD[group]
    if key not in kept:
        if len(kept) > 1:
            kept.clear()
        kept[key] = make()
    return kept[key]


class WordCache(dict):
    """word -> value in two generations: when the young one is full it becomes the old one, so memory is bounded.

    Subclasses give compute(word) and may fill many misses at once with fill(words).
    """

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit, self.old = limit, {}

    def compute(self, word):
        raise NotImplementedError

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(word) < LONG_WORD:
            self[word] = value
        return value

    def rotate(self) -> None:
        """To be called between groups of texts."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
