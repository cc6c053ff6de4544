"""Rows for an outside store in batches, each once, by the commit protocol of Spark's data sources.

A task stages its batches under the name of its attempt; when all tasks are done the job is published: the names of the attempts that
count become visible at once. What lost, failed or repeated attempts have staged is never published, and is discarded. A job has
a name; one that has been published is not stored again, so the whole write can be repeated after any failure.

Batches have a number of rows at most, halved as long as they have too many bytes; a row alone may have more. The first batch that
the store refuses fails its attempt, which Spark tries again.
"""

from __future__ import annotations

import json
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from folioflow.operators.metadata import BATCH_BYTES
from folioflow.sources.workbooks import opened

BATCH_ROWS = 50


class Store(ABC):
    """What an outside store has to offer; it is sent to all tasks, so connections are made in its methods."""

    @abstractmethod
    def stage(self, job: str, attempt: str, batch: int, rows: list[dict]) -> None:
        """Stores a batch so that nobody sees it yet; raises if it can't."""

    @abstractmethod
    def publish(self, job: str, attempts: list[str]) -> None:
        """Makes all that these attempts have staged visible at once; a job that is published already stays as it is."""

    @abstractmethod
    def published(self, job: str) -> bool: ...

    @abstractmethod
    def discard(self, job: str) -> None:
        """Deletes what is staged of a job and not published."""


class FolderStore(Store):
    """A folder that tasks reach by pyarrow: JSON lines in staged/<job>/<attempt>, and jobs/<job>.json with the attempts that count."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _at(self, *parts: str) -> tuple[fs.FileSystem, str]:
        return opened("/".join((self.folder, *parts)))

    def stage(self, job: str, attempt: str, batch: int, rows: list[dict]) -> None:
        store, folder = self._at("staged", job, attempt)
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{batch:08d}.jsonl") as out:
            out.write("".join(json.dumps(r, default=str, ensure_ascii=False) + "\n" for r in rows).encode())

    def publish(self, job: str, attempts: list[str]) -> None:
        if self.published(job):
            return
        store, done = self._at("jobs", f"{job}.json")
        store.create_dir(done.rsplit("/", 1)[0])
        waiting = f"{done}.{uuid.uuid4().hex}"
        with store.open_output_stream(waiting) as out:
            out.write(json.dumps(sorted(attempts)).encode())
        store.move(waiting, done)

    def published(self, job: str) -> bool:
        store, done = self._at("jobs", f"{job}.json")
        return store.get_file_info(done).type == fs.FileType.File

    def attempts(self, job: str) -> list[str]:
        store, done = self._at("jobs", f"{job}.json")
        if store.get_file_info(done).type != fs.FileType.File:
            return []
        with store.open_input_stream(done) as f:
            return json.loads(f.read())

    def discard(self, job: str) -> None:
        kept = set(self.attempts(job))
        store, folder = self._at("staged", job)
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name not in kept:
                store.delete_dir(info.path)

    def visible(self) -> list[str]:
        """Folders of the attempts that count, of all jobs."""
        store, jobs = self._at("jobs")
        names = [i.base_name[:-5] for i in store.get_file_info(fs.FileSelector(jobs, allow_not_found=True)) if i.base_name.endswith(".json")]
        return [f"{self.folder}/staged/{job}/{a}" for job in sorted(names) for a in self.attempts(job)]


def halved(rows: list, size: Callable[[list], int], most: int) -> Iterator[list]:
    """Runs of rows of at most that size, by halving; one row alone may be larger."""
    if len(rows) > 1 and size(rows) > most:
        middle = len(rows) // 2
        yield from halved(rows[:middle], size, most)
        yield from halved(rows[middle:], size, most)
    elif rows:
        yield rows


def _bytes(rows: list[dict]) -> int:
    return sum(len(json.dumps(r, default=str, ensure_ascii=False).encode()) for r in rows)


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    batches: int
    rows: int


class OutboxWriter(DataSourceArrowWriter):
    def __init__(self, store: Store, job: str, rows: int, most_bytes: int):
        self.store, self.job, self.rows, self.most_bytes = store, job, rows, most_bytes
        self.repeated = store.published(job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        attempt, batches, n, held = uuid.uuid4().hex, 0, 0, []

        def send(rows: list[dict]) -> int:
            some = list(halved(rows, _bytes, self.most_bytes))
            for i, batch in enumerate(some):
                self.store.stage(self.job, attempt, batches + i, batch)
            return len(some)

        for batch in iterator:
            if self.repeated:
                continue
            held += batch.to_pylist()
            n += len(batch)
            while len(held) >= self.rows:
                batches += send(held[: self.rows])
                del held[: self.rows]
        if held:
            batches += send(held)
        return Staged(attempt, batches, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if not self.repeated:
            self.store.publish(self.job, [m.attempt for m in messages if m is not None and m.batches])
        self.store.discard(self.job)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.store.discard(self.job)


def stored(df: DataFrame, store: Store, job: str, rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> None:
    """Stores the rows of df under the name of a job: all of them, each once, or none."""

    class Outbox(DataSource):
        @classmethod
        def name(cls) -> str:
            return "outbox"

        def writer(self, schema, overwrite: bool) -> OutboxWriter:
            return OutboxWriter(store, job, rows, most_bytes)

    df.sparkSession.dataSource.register(Outbox)
    df.write.format("outbox").mode("append").save()
