"""Token counts kept as delta-maintained rollups.

A batch is a table of events (doc_id, source, lang, text, action): insert and delete a document, or, with `revise`, count
a document again under a new tokenizer version, which takes back its counts under the old one. Each event becomes signed
rows (source, lang, version, documents, tokens), which a batch sums up before anything is stored. Totals are the sums of
all batches. A batch is committed by renaming its finished folder to its identifier, which fails when that is there: a
batch that comes again, or is retried after a crash, changes nothing. fold() sums up the batches so far, so that totals read
the fold and what came after it; the folders of folded batches stay as the marks of their commits.

Null source and lang are groups of their own; null and empty texts count as documents without tokens. A delete counts the
text it carries, so it must be the text that was inserted. Other columns are not read. Empty batches are committed and
add nothing; groups whose documents and tokens are both 0 are not in the totals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.bpe import text_coder
from folioflow.llm.common import renamed_once, small_batches, text_groups
from folioflow.llm.tokenize import word_tokens

DELTAS = "source string, lang string, version string, documents long, tokens long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def _count(versions: dict[str, Callable[[], Callable[[list[str]], list[int]]]]):
    names = list(versions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {name: make() for name, make in versions.items()}
        # sums by group within the task: at most as many rows leave it as there are groups
        sums: dict[tuple, list[int]] = {}
        for batch in batches:
            sources, langs, actions, olds, news = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for first, texts in text_groups(batch.column(2)):
                rows = range(first, first + len(texts))
                for name in names:
                    signs = [(news[i] == name and actions[i] in (INSERT, REVISE)) - (olds[i] == name and actions[i] in (DELETE, REVISE)) for i in rows]
                    used = [k for k, sign in enumerate(signs) if sign]
                    for k, n in zip(used, counters[name]([texts[k] for k in used]), strict=True):
                        total = sums.setdefault((sources[first + k], langs[first + k], name), [0, 0])
                        total[0] += signs[k]
                        total[1] += signs[k] * n
        columns = list(zip(*((*key, *total) for key, total in sums.items()), strict=True)) or [()] * 5
        kinds = [pa.string()] * 3 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in DELTAS.split(", ")])

    return run


def deltas(events: DataFrame, versions: dict[str, Callable[[], Callable[[list[str]], list[int]]]]) -> DataFrame:
    """Signed sums of a batch by source, lang and tokenizer version.

    events: source, lang, text, action, old_version (for delete and revise), new_version (for insert and revise).
    versions: by name, a function that makes, once for each task, a counter of the tokens of texts.
    """
    rows = events.select("source", "lang", "text", "action", "old_version", "new_version").mapInArrow(_count(versions), DELTAS)
    return rows.groupBy("source", "lang", "version").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollup:
    """The committed batches in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def committed(self) -> list[str]:
        return sorted(s.getPath().getName()[6:] for s in self.fs.listStatus(self._path()) if s.getPath().getName().startswith("batch="))

    def commit(self, batch: str, delta: Callable[[], DataFrame]) -> bool:
        """Stores the batch unless it is there; delta is only computed if need be. False: it was there already."""
        done = self._path(f"batch={batch}")
        if self.fs.exists(done):
            return False
        waiting = f"_waiting-{uuid.uuid4().hex}"
        with small_batches(self.spark):
            delta().write.parquet(f"{self.folder}/{waiting}")
        if not renamed_once(self.spark, f"{self.folder}/{waiting}", f"{self.folder}/batch={batch}"):
            self.fs.delete(self._path(waiting), True)
            return False
        return True

    def _folds(self) -> list[int]:
        return sorted(int(s.getPath().getName()[5:]) for s in self.fs.listStatus(self._path()) if s.getPath().getName().startswith("fold="))

    def _parts(self) -> tuple[list[str], list[str]]:
        """(batches that are committed, folders whose sums are the totals)."""
        names, folds = self.committed(), self._folds()
        if not folds:
            return names, [f"batch={n}" for n in names]
        done = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/fold={folds[-1]}/batches").collect()}
        return names, [f"fold={folds[-1]}/deltas", *(f"batch={n}" for n in names if n not in done)]

    def _summed(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(DELTAS).parquet(*(f"{self.folder}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], DELTAS)
        return rows.groupBy("source", "lang", "version").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def fold(self) -> bool:
        """Sums up what is committed so far. False: another writer has folded meanwhile, and nothing changed."""
        folds = self._folds()
        names, folders = self._parts()
        waiting, done = f"_waiting-{uuid.uuid4().hex}", f"fold={max(folds, default=0) + 1}"
        self._summed(folders).write.parquet(f"{self.folder}/{waiting}/deltas")
        self.spark.createDataFrame([(n,) for n in names], "batch string").write.parquet(f"{self.folder}/{waiting}/batches")
        if not renamed_once(self.spark, f"{self.folder}/{waiting}", f"{self.folder}/{done}"):
            self.fs.delete(self._path(waiting), True)
            return False
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens) over all committed batches."""
        return self._summed(self._parts()[1]).where("documents <> 0 or tokens <> 0")


def word_counter(path: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Counts by a file of the tokenizers library."""
    return lambda: lambda texts: [len(data) // 4 for data in word_tokens(path).encode(texts)]


def byte_counter(path: str, pattern: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Counts by byte-level BPE over a file of ranks."""
    return lambda: lambda texts: [len(text_coder(path, pattern).encode(text)) for text in texts]
