"""Workbooks, documents and slides: zip archives of XML, read file by file in parallel with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = "file string, sheet string, row int, col int, value string, error string"
PARAGRAPHS = "file string, position int, style string, text string, in_table boolean, error string"
SLIDES = "file string, slide int, position int, text string, is_title boolean, error string"
TABLES = "file string, table int, row int, col int, value string, before string, error string"
SLIDE_TABLES = "file string, slide int, table int, row int, col int, value string, layout string, error string"
PROPERTIES = "file string, name string, value string, error string"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part of the archive) of each sheet, in order."""
    target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    found = [(s.get("name"), target[s.get(f"{_R}id")]) for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    return [(name, place.lstrip("/") if place.startswith("/") else posixpath.join("xl", place)) for name, place in found]


class SharedStrings:
    """The strings that the cells of all sheets refer to, read when the first cell does."""

    def __init__(self, z: zipfile.ZipFile):
        self.z, self.strings = z, None

    def __getitem__(self, i: int) -> str:
        if self.strings is None:
            self.strings = []
            if "xl/sharedStrings.xml" in self.z.namelist():
                for _, item in ET.iterparse(self.z.open("xl/sharedStrings.xml")):
                    if item.tag == f"{_S}si":
                        self.strings.append("".join(t.text or "" for t in item.iter(f"{_S}t")))
                        item.clear()
        return self.strings[i]


def sheet_cells(z: zipfile.ZipFile, place: str, shared: SharedStrings, columns: set[int] | None = None) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the filled cells of a sheet, of some columns only if they are given. Rows and cells that don't say
    where they stand come one behind the other."""
    row = column = -1
    for event, node in ET.iterparse(z.open(place), events=("start", "end")):
        if event == "start" and node.tag == f"{_S}row":
            row, column = int(node.get("r")) - 1 if node.get("r") else row + 1, -1
        elif event == "end" and node.tag == f"{_S}row":
            node.clear()
        elif event == "end" and node.tag == f"{_S}c":
            if node.get("r"):
                row, column = int(re.search(r"\d+", node.get("r"))[0]) - 1, column_number(node.get("r"))
            else:
                column += 1
            if columns is not None and column not in columns:
                continue
            kind, value = node.get("t"), node.find(f"{_S}v")
            text = "".join(t.text or "" for t in node.iter(f"{_S}t")) if kind == "inlineStr" else value.text if value is not None else None
            if kind == "s" and text is not None:
                text = shared[int(text)]
            if text:
                yield row, column, text


def _workbook(z: zipfile.ZipFile) -> Iterator[tuple]:
    shared = SharedStrings(z)
    for name, place in sheets(z):
        for cell in sheet_cells(z, place, shared):
            yield name, *cell


def _document(z: zipfile.ZipFile) -> Iterator[tuple]:
    body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    in_table = {p for table in body.iter(f"{_W}tbl") for p in table.iter(f"{_W}p")}
    for i, p in enumerate(body.iter(f"{_W}p")):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        text = "".join(t.text or "" for t in p.iter(f"{_W}t"))
        if text.strip():
            yield i, style.get(f"{_W}val") if style is not None else None, text, p in in_table


def _document_tables(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Cells of the tables that stand in the body, with the last text before each table."""
    before, n = None, 0
    for child in ET.fromstring(z.read("word/document.xml")).find(f"{_W}body"):
        if child.tag == f"{_W}p":
            before = "".join(t.text or "" for t in child.iter(f"{_W}t")).strip() or before
        elif child.tag == f"{_W}tbl":
            for r, row in enumerate(child.findall(f"{_W}tr")):
                for c, cell in enumerate(row.findall(f"{_W}tc")):
                    text = "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in cell.iter(f"{_W}p"))
                    yield n, r, c, text.strip() or None, before
            n += 1


def _properties(z: zipfile.ZipFile) -> Iterator[tuple]:
    """What the file says of itself: title, creator, dates and counts."""
    for part in ("docProps/core.xml", "docProps/app.xml"):
        if part in z.namelist():
            for child in ET.fromstring(z.read(part)):
                if (child.text or "").strip():
                    yield child.tag.rsplit("}", 1)[-1], child.text.strip()


def _layouts(z: zipfile.ZipFile, slide: str) -> str | None:
    """The name of the layout that a slide uses."""
    links = posixpath.join(posixpath.dirname(slide), "_rels", posixpath.basename(slide) + ".rels")
    if links not in z.namelist():
        return None
    for link in ET.fromstring(z.read(links)):
        if link.get("Type", "").endswith("/slideLayout"):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(slide), link.get("Target")))
            return ET.fromstring(z.read(name)).find(f"{_P}cSld").get("name") if name in z.namelist() else None
    return None


def _slide_tables(z: zipfile.ZipFile) -> Iterator[tuple]:
    for number, name in _slide_names(z):
        layout = _layouts(z, name)
        for t, table in enumerate(ET.fromstring(z.read(name)).iter(f"{_A}tbl")):
            for r, row in enumerate(table.findall(f"{_A}tr")):
                for c, cell in enumerate(row.findall(f"{_A}tc")):
                    text = "\n".join("".join(x.text or "" for x in p.iter(f"{_A}t")) for p in cell.iter(f"{_A}p"))
                    yield number, t, r, c, text.strip() or None, layout


def _slide_names(z: zipfile.ZipFile) -> list[tuple[int, str]]:
    names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
    return sorted((int(re.search(r"(\d+)\.xml", n)[1]), n) for n in names)


def _slides(z: zipfile.ZipFile) -> Iterator[tuple]:
    for number, name in _slide_names(z):
        for i, shape in enumerate(ET.fromstring(z.read(name)).iter(f"{_P}sp")):
            kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
            text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p"))
            if text.strip():
                yield number, i, text, kind is not None and kind.get("type") in ("title", "ctrTitle")


def _read(parse, ddl: str):
    names = [x.split()[0] for x in ddl.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = path.rsplit("/", 1)[-1]
                try:  # a file that can't be read gives one row that says so
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(file, *r, None) for r in parse(z)]
                except Exception as error:  # whatever is wrong with a file, the others are read
                    rows = [(file, *[None] * (len(names) - 2), f"{type(error).__name__}: {error}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _files(spark: SparkSession, path: str, parse, ddl: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read(parse, ddl), ddl)


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Filled cells of workbooks; rows and columns from 0."""
    return _files(spark, path, _workbook, CELLS)


def document_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, _document, PARAGRAPHS)


def slide_texts(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, _slides, SLIDES)


def document_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, table, row, col, value, before): cells of tables in documents, with the text that stands before the table."""
    return _files(spark, path, _document_tables, TABLES)


def slide_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, slide, table, row, col, value, layout): cells of tables on slides, with the name of the slide's layout."""
    return _files(spark, path, _slide_tables, SLIDE_TABLES)


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, value): what workbooks, documents and slides say of themselves."""
    return _files(spark, path, _properties, PROPERTIES)


def table_texts(cells: DataFrame) -> DataFrame:
    """(file, table, before, text): a table as lines of cells parted by bars. cells: of document_tables()."""
    by_row = cells.where("error is null").groupBy("file", "table", "before", "row").agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("v")))).alias("c"))
    line = F.array_join(F.transform("c", lambda x: x["v"]), " | ")
    lines = F.sort_array(F.collect_list(F.struct("row", line.alias("l"))))
    return by_row.groupBy("file", "table", "before").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("text"))


def document_sections(paragraphs: DataFrame, default: str = "Introduction") -> DataFrame:
    """(file, section, heading, text): paragraphs under the last heading; a heading has a heading style, or is short and in
    capitals or ends with a colon."""
    heading = F.coalesce(F.col("style").rlike("(?i)^heading"), F.lit(False)) | ((F.length("text") < 100) & ((F.upper("text") == F.col("text")) & F.col("text").rlike("[A-Z]") | F.col("text").endswith(":")))
    rows = paragraphs.where("error is null and not in_table").withColumn("_h", F.when(heading, F.col("text")))
    order = W.partitionBy("file").orderBy("position")
    rows = rows.withColumn("heading", F.coalesce(F.last("_h", ignorenulls=True).over(order), F.lit(default))).withColumn("section", F.count("_h").over(order))
    grouped = rows.where("_h is null").groupBy("file", "section", "heading")
    return grouped.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("text"))


def slide_summaries(slides: DataFrame) -> DataFrame:
    """(file, slide, title, text): a slide's texts in order under its title."""
    return slides.where("error is null").groupBy("file", "slide").agg(
        F.max(F.when(F.col("is_title"), F.col("text"))).alias("title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
