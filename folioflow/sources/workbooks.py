"""Workbooks as a data source of Spark's: `spark.read.format("workbook")`, with a partition for each sheet.

When a read is planned only the lists of sheets are taken out of the archives; a task opens one sheet, and unzips nothing but that
and, if its cells refer to them, the shared strings. Sheets and columns that are not asked for are left out before: by the options
sheets and columns, and, where spark.sql.python.filterPushdown.enabled is set, by conditions on the column sheet, too.

Paths are opened by pyarrow (local, HDFS, S3 and others); office.workbook_cells() reads whole files from any store that Spark knows,
and is the better one for many small files. A file, or a sheet, that can't be read gives a row that says so, behind what could be
read of the sheet.

format("workbook") also writes: each task one workbook with one sheet, in a folder of its attempt, which the commit moves into place
as a whole; what failed or lost tasks wrote is deleted.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from folioflow.sources import office

NAMES = ["file", "sheet", "row", "col", "value", "error"]
KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
#: Cells that a task hands over at once.
BATCH_CELLS = 10_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match("[a-z][a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def workbook_files(path: str) -> list[str]:
    """Files under a path: itself, those in a folder, or those that a pattern in its last part fits; hidden ones are left out."""
    store, place = opened(path)
    head = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [path]
    folder, pattern = (place, "*") if info.type == fs.FileType.Directory else posixpath.split(place)
    inside = store.get_file_info(fs.FileSelector(folder, recursive=info.type == fs.FileType.Directory, allow_not_found=True))
    return sorted(head + i.path for i in inside if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, pattern) and not i.base_name.startswith((".", "_", "~$")))


@dataclass
class Sheet(InputPartition):
    """A sheet to be read; error: why its file can't be."""

    file: str
    sheet: str | None
    place: str | None
    error: str | None = None


def _listed(file: str) -> list[Sheet]:
    try:
        store, place = opened(file)
        with store.open_input_file(place) as f, zipfile.ZipFile(f) as z:
            return [Sheet(file, name, part) for name, part in office.sheets(z)]
    except Exception as error:  # whatever is wrong with a file, the others are read
        return [Sheet(file, None, None, f"{type(error).__name__}: {error}")]


class SheetReader(DataSourceReader):
    def __init__(self, path: str, sheets: set[str] | None, columns: set[int] | None):
        self.path, self.sheets, self.columns = path, sheets, columns

    def partitions(self) -> list[Sheet]:
        with ThreadPoolExecutor(16) as pool:
            found = [s for some in pool.map(_listed, workbook_files(self.path)) for s in some]
        return [s for s in found if s.error or self.sheets is None or s.sheet in self.sheets]

    def read(self, partition: Sheet | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files: Spark reads one partition that is none
            return
        name, held, error = posixpath.basename(partition.file), [], partition.error
        if error is None:
            try:
                store, place = opened(partition.file)
                with store.open_input_file(place) as f, zipfile.ZipFile(f) as z:
                    for row, col, value in office.sheet_cells(z, partition.place, office.SharedStrings(z), self.columns):
                        held.append((name, partition.sheet, row, col, value, None))
                        if len(held) == BATCH_CELLS:
                            yield _batch(held)
                            held = []
            except Exception as e:  # a damaged sheet stops no other
                error = f"{type(e).__name__}: {e}"
        if error is not None:
            held.append((name, partition.sheet, None, None, None, error))
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)


class PushedSheetReader(SheetReader):
    """Takes conditions on the sheet over; Spark evaluates the others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("sheet",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sheets = wanted if self.sheets is None else self.sheets & wanted
            else:
                yield f


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: Characters that XML can't hold.
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


@dataclass
class Moved(WriterCommitMessage):
    file: str
    rows: int


class SheetWriter(DataSourceArrowWriter):
    """A workbook of one sheet for each task. Commit renames files, which on an object store is a copy of each."""

    def __init__(self, path: str, sheet: str, columns: list[str]):
        self.path, self.sheet, self.columns, self.job = path.rstrip("/"), sheet, columns, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = opened(self.path)
        name, n = f"part-{uuid.uuid4().hex}.xlsx", 0
        store.create_dir(f"{folder}/_{self.job}")
        with store.open_output_stream(f"{folder}/_{self.job}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for part, text in _PARTS.items():
                z.writestr(part, text)
            z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name={quoteattr(self.sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
            with z.open("xl/worksheets/sheet1.xml", "w") as out:
                out.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                out.write(self._row(self.columns))
                for batch in iterator:
                    n += len(batch)
                    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        out.write(self._row(row))
                out.write(b"</sheetData></worksheet>")
        return Moved(name, n)

    @staticmethod
    def _row(values) -> bytes:
        def cell(v) -> str:
            if v is None:
                return "<c/>"
            if isinstance(v, int | float) and not isinstance(v, bool):
                return f"<c><v>{v!r}</v></c>"
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_UNFIT.sub("", str(v)))}</t></is></c>'

        return ("<row>" + "".join(map(cell, values)) + "</row>").encode()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = opened(self.path)
        for m in filter(None, messages):
            if m.rows:
                store.move(f"{folder}/_{self.job}/{m.file}", f"{folder}/{m.file}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = opened(self.path)
        if store.get_file_info(f"{folder}/_{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/_{self.job}")


class Workbooks(DataSource):
    """Options: path; for reading sheets (names, by line breaks), columns (numbers from 0, by commas), pushdown; for writing sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return office.CELLS

    def reader(self, schema) -> DataSourceReader:
        sheets, columns = self.options.get("sheets"), self.options.get("columns")
        kind = PushedSheetReader if self.options.get("pushdown") == "true" else SheetReader
        return kind(self.options["path"], set(sheets.split("\n")) if sheets is not None else None, {int(c) for c in columns.split(",")} if columns else None)

    def writer(self, schema, overwrite: bool) -> SheetWriter:
        if overwrite:
            raise ValueError("workbooks are only added: use mode append")
        return SheetWriter(self.options["path"], self.options.get("sheet", "Sheet1"), schema.names)


def cells(spark: SparkSession, path: str, sheets: list[str] | None = None, columns: list[int] | None = None) -> DataFrame:
    """Filled cells (file, sheet, row, col, value, error) of workbooks, of some sheets and columns only if they are given."""
    spark.dataSource.register(Workbooks)
    reader = spark.read.format("workbook").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if sheets is not None:
        reader = reader.option("sheets", "\n".join(sheets))
    if columns is not None:
        reader = reader.option("columns", ",".join(map(str, columns)))
    return reader.load(path)


def write(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """Adds a workbook for each partition that has rows, its first row the names of the columns."""
    df.sparkSession.dataSource.register(Workbooks)
    df.write.format("workbook").mode("append").option("sheet", sheet).save(path)
