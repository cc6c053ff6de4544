"""Shards of a growing table, kept in order by size-tiered compaction, with DataFrame and SQL operations only.

append() writes each arrival once, as small immutable Parquet shards; append_each() writes many arrivals in one job and
commits them one by one. compact() looks at the shards of the current version: their tier is the logarithm of their size to
the base FANOUT, and FANOUT or more shards of one tier are merged, oldest first, into shards of about the target size; shards
of the target size are left alone. Every change ends with a new manifest: the list of shards that make up the version and the
version's schema, written whole under a name of its own and then renamed to `v<number>`, which fails if another writer has
taken that number. Readers take the newest manifest and never see half a change; versions stay readable until vacuum()
removes shards that no kept version names. The rename is exclusive on HDFS and local disks; on an object store the folder
needs a file system that renames without overwriting.

Sizes and names of shards are all that reaches the driver: a row for each shard, so 100 TB wants target_bytes of 1 GB or
more, which makes 100,000. Merging reads and writes shards without a shuffle; a shard is never split by a key, so a hot
source or key cannot make a large task.

Rows are taken as they are: null columns, repeated rows and extra columns under any names are kept. The schema of a version
is the union by name of all arrivals, where names that differ by case only are one column, named as it came first; columns that an arrival lacks are null in its rows; a column that comes again with
another type is refused. An empty arrival adds its columns and no rows; reading a table that has only such arrivals gives no
rows, reading one without any commit is an error.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import renamed_once

#: Shards of a tier that make a merge due, size that merging aims at, and runs that one job merges.
FANOUT, TARGET_BYTES, RUNS_AT_ONCE = 4, 64 << 20, 256
#: The row without a shard holds the schema of the version as JSON.
MANIFEST = "shard string, arrival string, tier int, bytes long, rows long, schema string"
#: Age in seconds from which a folder of shards that no version names counts as left behind by a failed write.
ORPHAN_SECONDS = 24 * 3600


@dataclass(frozen=True)
class Shard:
    shard: str
    arrival: str
    tier: int
    bytes: int
    rows: int


def tier_of(size: int, fanout: int = FANOUT) -> int:
    return int(math.log(max(size, 1), fanout))


def free_name(wanted: str, names: list[str]) -> str:
    """wanted, with as many underscores behind it as keep it apart from the names, whatever their case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def united(one: T.StructType, two: T.StructType) -> T.StructType:
    """The columns of both, by name whatever its case, under the name that came first; all may be null. Raises ValueError if a
    column has two types, or one side two columns whose names differ by case only, which could not be read again."""
    fields: dict[str, T.StructField] = {}
    for side in (one, two):
        names = [f.name.lower() for f in side]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"more than one column is named {', '.join(twice)}")
        for f in side:
            known = fields.setdefault(f.name.lower(), T.StructField(f.name, f.dataType))
            if known.dataType.simpleString().lower() != f.dataType.simpleString().lower():
                raise ValueError(f"column {f.name} is {known.dataType.simpleString()} and cannot become {f.dataType.simpleString()}")
    return T.StructType(list(fields.values()))


def named_as(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows with its columns named as in the schema, which differs by case only."""
    names = {f.name.lower(): f.name for f in schema}
    return rows.toDF(*(names.get(c.lower(), c) for c in rows.columns))


class ShardedTable:
    """A folder with shards/ and manifests/."""

    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.folder, self.target, self.fanout = spark, folder, target_bytes, fanout
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        for sub in ("shards", "manifests"):
            self.fs.mkdirs(self._path(sub))

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self.fs.listStatus(self._path("manifests")))
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def _manifest(self, version: int) -> tuple[list[Shard], T.StructType]:
        if not version:
            return [], T.StructType()
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/v{version}").collect()
        schema = next(r.schema for r in rows if r.shard is None)
        shards = (Shard(r.shard, r.arrival, r.tier, r.bytes, r.rows) for r in rows if r.shard is not None)
        return sorted(shards, key=lambda s: (s.arrival, s.shard)), T.StructType.fromJson(json.loads(schema))

    def manifest(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, by default the newest; none before the first commit."""
        return self._manifest(version if version is not None else max(self.versions(), default=0))[0]

    def _commit(self, base: int, shards: list[Shard], schema: T.StructType) -> int:
        """Makes these the shards of version base + 1; raises if that version has been made meanwhile."""
        waiting, done = f"manifests/_{uuid.uuid4().hex}", f"manifests/v{base + 1}"
        rows = json.dumps([*map(asdict, shards), {"schema": schema.json()}])
        told = self.spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<{MANIFEST.replace(' ', ':').replace(',:', ',')}>>")))
        told.write.parquet(f"{self.folder}/{waiting}")
        if not renamed_once(self.spark, f"{self.folder}/{waiting}", f"{self.folder}/{done}"):
            self.fs.delete(self._path(waiting), True)
            raise RuntimeError(f"version {base + 1} was committed by another writer")
        return base + 1

    def _files(self, folder: str) -> dict[str, int]:
        """Sizes of the shards in shards/<folder>, by their path from shards/ on."""
        found, files = {}, self.fs.listFiles(self._path("shards", folder), True)
        while files.hasNext():
            status = files.next()
            name = status.getPath().toString().split("/shards/", 1)[1]
            if name.endswith(".parquet"):
                found[name] = status.getLen()
        return found

    def _shards_in(self, folder: str, schema: T.StructType, arrival: str | None) -> list[Shard]:
        """What was just written to shards/<folder>; shards without rows are left out. arrival: None if it is the name of each
        subfolder."""
        sizes = self._files(folder)
        if not sizes:
            return []
        path = F.input_file_name().alias("path")
        counts = self._rows(list(sizes), schema).select(path).groupBy("path").count().collect()
        out = []
        for c in counts:
            # paths that Spark tells are escaped once more than those of the file system
            name = c.path.split("/shards/", 1)[1]
            name = name if name in sizes else unquote(name)
            of = arrival if arrival is not None else unquote(name.split("/")[1].split("=", 1)[1])
            out.append(Shard(name, of, tier_of(sizes[name], self.fanout), sizes[name], c["count"]))
        return sorted(out, key=lambda s: (s.arrival, s.shard))

    def append(self, rows: DataFrame, arrival: str) -> int:
        """Adds one arrival as it is partitioned; returns the new version."""
        base = max(self.versions(), default=0)
        shards, schema = self._manifest(base)
        schema, folder = united(schema, rows.schema), uuid.uuid4().hex
        rows = named_as(rows, schema)
        rows.write.parquet(f"{self.folder}/shards/{folder}")
        return self._commit(base, shards + self._shards_in(folder, rows.schema, arrival), schema)

    def append_each(self, rows: DataFrame, arrival: Column) -> int:
        """Adds many arrivals, written in one job and committed one after the other in the order of their names; returns the
        newest version. arrival: a column that names them."""
        base = max(self.versions(), default=0)
        shards, schema = self._manifest(base)
        schema, folder, key = united(schema, rows.schema), uuid.uuid4().hex, free_name("_arrival", rows.columns)
        rows = named_as(rows.withColumn(key, arrival.cast("string")), schema)
        rows.write.partitionBy(key).parquet(f"{self.folder}/shards/{folder}")
        new = self._shards_in(folder, schema, None)
        for name in sorted({s.arrival for s in new}) or [None]:
            shards = shards + [s for s in new if s.arrival == name]
            base = self._commit(base, shards, schema)
        return base

    def due(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of shards to merge: FANOUT or more of one tier, cut where a run reaches the target size."""
        by_tier: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target / 2:
                by_tier.setdefault(s.tier, []).append(s)
        runs = []
        for _, some in sorted(by_tier.items()):
            run: list[Shard] = []
            for s in some:
                run.append(s)
                if sum(x.bytes for x in run) >= self.target:
                    runs.append(run)
                    run = []
            if len(run) >= self.fanout:
                runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self) -> int:
        """Merges what is due, tier after tier, until nothing is; returns the version it ends with."""
        base = max(self.versions(), default=0)
        shards, schema = self._manifest(base)
        while runs := self.due(shards):
            for at in range(0, len(runs), RUNS_AT_ONCE):
                some = runs[at : at + RUNS_AT_ONCE]
                gone = {s.shard for run in some for s in run}
                shards = [s for s in shards if s.shard not in gone] + self._merged(some, schema)
            base = self._commit(base, shards, schema)
        return base

    def _rows(self, names: list[str], schema: T.StructType) -> DataFrame:
        """The rows of these shards under the schema; columns that a shard lacks are null."""
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/shards/{n}" for n in names))

    def _merged(self, runs: list[list[Shard]], schema: T.StructType) -> list[Shard]:
        """The shards that the runs become, in one job: a task for each target size of a run, without a shuffle."""
        parts = [max(1, round(sum(s.bytes for s in run) / self.target)) for run in runs]
        merged = [self._rows([s.shard for s in run], schema).coalesce(n) for run, n in zip(runs, parts, strict=True)]
        rows = merged[0]
        for more in merged[1:]:
            rows = rows.union(more)
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/shards/{folder}")
        oldest = [run[0].arrival for run, n in zip(runs, parts, strict=True) for _ in range(n)]  # by number of the file
        return [replace(s, arrival=oldest[min(int(s.shard.split("/part-", 1)[1][:5]), len(oldest) - 1)]) for s in self._shards_in(folder, schema, "")]

    def read(self, version: int | None = None, shard_column: str | None = None) -> DataFrame:
        """The rows of a version; shard_column: the name of a column to add that tells where each one lies."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            raise ValueError("nothing has been committed")
        shards, schema = self._manifest(version)
        if shard_column is not None and free_name(shard_column, schema.names) != shard_column:
            raise ValueError(f"the table has a column {shard_column}")
        rows = self._rows([s.shard for s in shards], schema) if shards else self.spark.createDataFrame([], schema)
        return rows.withColumn(shard_column, F.regexp_extract(F.input_file_name(), "/shards/(.*)$", 1)) if shard_column else rows

    def vacuum(self, keep_versions: int = 1, orphan_seconds: float = ORPHAN_SECONDS) -> int:
        """Deletes shards that only older versions name, folders that no version names and that are older than
        orphan_seconds, and then the older manifests, so that a vacuum that breaks off can be run again; returns how many shards
        and folders went."""
        versions = self.versions()
        named = {s.shard for v in versions[-keep_versions:] for s in self.manifest(v)}
        old = {s.shard for v in versions[:-keep_versions] for s in self.manifest(v)} - named
        for shard in old:
            self.fs.delete(self._path("shards", shard), False)
        used, gone = {s.split("/", 1)[0] for s in named}, len(old)
        for status in self.fs.listStatus(self._path("shards")):
            if status.getPath().getName() not in used and status.getModificationTime() / 1000 < time.time() - orphan_seconds:
                gone += self.fs.delete(status.getPath(), True)
        for v in versions[:-keep_versions]:
            self.fs.delete(self._path("manifests", f"v{v}"), True)
        return gone
