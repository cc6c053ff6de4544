"""Tables with a key that are changed by merges: copy on write by buckets of keys, and an atomic pointer to the newest version.

Rows lie in buckets by a hash of their key. A merge reads and rewrites the buckets that its changes touch, and no other; then the
new version, which names a folder for each bucket, is renamed into place, which fails if another writer has taken its number. Readers
see one version or the other. What failed merges have written is named by no version, and vacuum() deletes it.

Changes of one key are folded before they are shuffled, so a key may hold any share of them. A row with a null in its key is a
row of its own key, since nulls are equal here.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.plans.lineage import renamed_once

POINTER = "bucket int, folder string, bytes long"


class LostRace(RuntimeError):
    """Another writer has made this version; read the table and merge again."""


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[int, str]
    bytes: dict[int, int]


class KeyedTable:
    """schema: DDL of all columns; keys: some of them. buckets can't be changed later: take as many as the table will have
    times 256 MB."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder.rstrip("/"), schema, keys, buckets
        self.columns = spark.createDataFrame([], schema).columns
        self.fs = self._path("data").getFileSystem(spark._jsc.hadoopConfiguration())
        for sub in ("data", "versions"):
            self.fs.mkdirs(self._path(sub))

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self.fs.listStatus(self._path("versions")))
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def version(self, number: int | None = None) -> Version:
        """By default the newest; version 0 is the empty table."""
        number = max(self.versions(), default=0) if number is None else number
        rows = self.spark.read.schema(POINTER).parquet(f"{self.folder}/versions/v{number}").collect() if number else []
        return Version(number, {r.bucket: r.folder for r in rows}, {r.bucket: r.bytes for r in rows})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/{f}" for f in folders))

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(list(self.version(number).folders.values()))

    def merge(self, changes: DataFrame, order: str | None = None, keep: str = "last") -> int:
        """Puts changes in; returns the new version. keep: of rows with one key the last stay (changes replace what is there, among
        changes the highest order wins) or the first (what is there stays, among changes the lowest order wins). Rows of one order
        are told apart by a hash. order: a column of changes, which need not be one of the table's."""
        if keep not in ("first", "last"):
            raise ValueError(f"keep {keep}")
        own = F.struct(*(F.col(f"`{c}`") for c in self.columns))
        rank = F.struct((F.col(order) if order else F.lit(0)).alias("order"), F.xxhash64(own).alias("hash"))
        pick = F.max_by if keep == "last" else F.min_by
        folded = changes.groupBy(*(F.col(f"`{k}`") for k in self.keys)).agg(pick(own, rank).alias("row")).select("row.*")
        return self._replaced(folded, lambda old, new: (old.join(new, self._same(old, new), "left_anti").unionByName(new) if keep == "last" else old.unionByName(new.join(old, self._same(new, old), "left_anti"))))

    def delete(self, gone: DataFrame) -> int:
        """Takes out the rows that have one of these keys; returns the new version."""
        return self._replaced(gone.select(*self.keys).distinct(), lambda old, new: old.join(new, self._same(old, new), "left_anti"))

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        out = F.lit(True)
        for k in self.keys:
            out = out & a[k].eqNullSafe(b[k])
        return out

    def _replaced(self, changes: DataFrame, put) -> int:
        """Writes the buckets that changes touch, as put(their old rows, changes) has them, and commits."""
        base, folder = self.version(), uuid.uuid4().hex
        waiting = f"{self.folder}/data/_{folder}"
        changes.write.parquet(waiting)  # computed once: what they touch, and what they are
        held = self.spark.read.schema(changes.schema).parquet(waiting)
        touched = sorted(r[0] for r in held.select(self._bucket()).distinct().collect())
        old = self._rows([base.folders[b] for b in touched if b in base.folders])
        rows = put(old, held).select(*(F.col(f"`{c}`") for c in self.columns)).withColumn("_bucket", self._bucket())
        # a task for each bucket; buckets are bounded by their number
        rows.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/data/{folder}")
        folders = {b: f for b, f in base.folders.items() if b not in touched}
        sizes = {b: base.bytes[b] for b in folders}
        for status in self.fs.listStatus(self._path("data", folder)):
            name = status.getPath().getName()
            if name.startswith("_bucket="):
                bucket = int(name.split("=")[1])
                folders[bucket], sizes[bucket] = f"{folder}/{name}", self.fs.getContentSummary(status.getPath()).getLength()
        self.fs.delete(self._path("data", f"_{folder}"), True)
        return self._commit(Version(base.number + 1, folders, sizes))

    def _commit(self, new: Version) -> int:
        waiting, done = f"{self.folder}/versions/_{uuid.uuid4().hex}", f"{self.folder}/versions/v{new.number}"
        rows = [(b, f, new.bytes[b]) for b, f in sorted(new.folders.items())]
        self.spark.createDataFrame(rows, POINTER).coalesce(1).write.parquet(waiting)
        if not renamed_once(self.spark, waiting, done):
            self.fs.delete(self._path("versions", waiting.rsplit("/", 1)[1]), True)
            raise LostRace(f"version {new.number} was made by another writer")
        return new.number

    def rewritten(self, number: int) -> int:
        """Bytes that a version does not share with the one before it."""
        before, now = self.version(number - 1), self.version(number)
        return sum(n for b, n in now.bytes.items() if before.folders.get(b) != now.folders[b])

    def vacuum(self, keep_versions: int = 1, orphan_seconds: float = 24 * 3600) -> int:
        """Deletes older versions and buckets that no kept version names; young folders stay, as merges under way write them.
        Returns how many folders went."""
        numbers, gone = self.versions(), 0
        used = {f for n in numbers[-keep_versions:] for f in self.version(n).folders.values()}
        for run in self.fs.listStatus(self._path("data")):
            name = run.getPath().getName()
            if not any(f.startswith(f"{name}/") for f in used):
                if run.getModificationTime() / 1000 <= time.time() - orphan_seconds:
                    gone += self.fs.delete(run.getPath(), True)
                continue
            for bucket in self.fs.listStatus(run.getPath()):
                if bucket.isDirectory() and f"{name}/{bucket.getPath().getName()}" not in used:
                    gone += self.fs.delete(bucket.getPath(), True)
        for n in numbers[:-keep_versions]:
            self.fs.delete(self._path("versions", f"v{n}"), True)
        return gone
