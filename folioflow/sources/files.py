"""Files of any kind: listings, and texts by a reader for each kind that never stops the others."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.metadata import parser_for
from folioflow.sources import csv, office

LISTED = "path string, name string, is_folder boolean, size long, modified timestamp"
PARTS = "file string, kind string, position int, part string, text string, error string"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, is_folder, size, modified): what lies in one folder, without placeholder files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    rows = [(s.getPath().toString(), s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in found if s.getPath().getName() != ".folder"]
    listed = spark.createDataFrame(rows, "path string, name string, is_folder boolean, size long, modified long")
    return listed.withColumn("modified", F.timestamp_millis("modified")).orderBy(F.desc("is_folder"), "name")


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _delimited(file: str, content: bytes, encoding: str, sep: str) -> Iterator[tuple]:
    for row, cells, error in csv.rows_of(file, content.decode(encoding, "replace"), sep):
        yield row, None, ", ".join(c or "" for c in cells) if cells else None, error


def _zipped(parse: Callable[[zipfile.ZipFile], Iterator[tuple]], shape: Callable[[tuple], tuple]):
    def read(file: str, content: bytes, encoding: str, sep: str) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i, row in enumerate(parse(z)):
                yield i, *shape(row), None

    return read


def _plain(file: str, content: bytes, encoding: str, sep: str) -> Iterator[tuple]:
    text = _squeezed(content.decode(encoding, "replace"))
    yield 0, None, text or None, None if text else "empty file"


def _json(file: str, content: bytes, encoding: str, sep: str) -> Iterator[tuple]:
    value = json.loads(content.decode(encoding, "replace"))
    for i, item in enumerate(value if isinstance(value, list) else [value]):
        yield i, None, item["text"] if isinstance(item, dict) and isinstance(item.get("text"), str) else json.dumps(item, ensure_ascii=False), None


READERS = {
    "excel": _zipped(office._workbook, lambda r: (f"{r[0]}!{r[1] + 1}:{r[2] + 1}", r[3])),
    "docx": _zipped(office._document, lambda r: (r[1], r[2])),
    "pptx": _zipped(office._slides, lambda r: (str(r[0]), r[2])),
    "csv": _delimited,
    "json": _json,
}


def texts(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(file, kind, position, part, text, error): cells, paragraphs, slides, rows, chunks or whole texts of files, by the reader for
    their kind. pdf: a function from the bytes of a file to the texts of its pages; what it or any other reader fails on is read
    as text if it holds no NUL bytes, as shown by kind text_fallback, and an error otherwise. Blank files give an error; Spark
    passes over files of no bytes, whose size listing() tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                encoding = "utf-8" if content.startswith(b"PK") else csv.encoding_of(content, True)
                sep = csv.delimiter_of(content.decode(encoding, "replace")) if kind == "csv" else ","
                try:
                    if kind == "pdf":
                        if pdf is None:
                            raise ValueError("no reader for PDF is given")
                        rows = [(i, str(i + 1), _squeezed(t), None) for i, t in enumerate(pdf(content))]
                    else:
                        rows = list(READERS.get(kind, _plain)(file, content, encoding, sep))
                except Exception as error:  # a reader's failure belongs to its file
                    told = f"{type(error).__name__}: {error}"
                    if b"\0" in content:
                        rows = [(None, None, None, told)]
                    else:
                        kind, rows = "text_fallback", [(p, w, t, e or told) for p, w, t, e in _plain(file, content, encoding, sep)]
                columns = list(zip(*((file, kind, *r) for r in rows), strict=True))
                if columns:
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PARTS.split(", ")])

    files = spark.read.format("binaryFile").load(path)
    known = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), parser_for(F.col("path")).alias("kind"), "content")
    return known.mapInArrow(run, PARTS)


def json_chunks(spark: SparkSession, path: str, schema: str, limit: int = 0) -> DataFrame:
    """Chunks of JSON files that hold arrays, in the order of path and place; limit: how many in all, 0 for all."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    if not limit:
        return rows
    # a file is read by one task, in its order
    placed = rows.select(F.struct("*").alias("row"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"))
    return placed.orderBy("path", "at").limit(limit).select("row.*")
