"""Delimited files of any size, read by many tasks at once, quoted line breaks and all.

Spark deals a file's lines out in pieces, and where a piece begins one can't know whether a quote is open. So each piece is first
followed for both cases: its effect is a function of two states. A scan over the effects of all pieces before tells in which state
each one begins: the last piece whose effect is the same for both, and the number of pieces since that swap the two. Then every
piece is parsed apart. Rows that go across pieces come back in fragments, which are put together by the piece that they began in.

Only lines with a quote go into the first pass; if no quote is open between two pieces, there are no fragments to look for. What
the tasks need to know of all pieces is a hash, a bit and a line number each: 17 bytes for each piece of spark.sql.files.maxPartitionBytes.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS = "path string, row long, cells array<string>"
FRAGMENTS = "path string, start long, opens boolean, row long, text string"
_BREAK = re.compile("\r\n|\r|\n")
_END_OF_LINE = re.compile("[\r\n]")


@dataclass
class Followed:
    """What became of a text: inside, whether it ends in quotes; began, where the row starts that is open at its end (None: it is
    the one that was open at its start); ended, where the row ends that was open at its start (None: nowhere); comments, ranges."""

    inside: bool
    began: int | None
    ended: int | None
    comments: list[tuple[int, int]]


class Quotes:
    """Follows quotes as the csv module reads them: a quote opens at the start of a cell only, two in a row are one, and what
    follows a closed quote belongs to the cell. A row that begins with # is a comment up to the end of its line."""

    def __init__(self, sep: str):
        self.sep = sep
        self.opening = re.compile(f'[{re.escape(sep)}\r\n]"|[\r\n]#')
        self.closing = re.compile('[^"]*+(?:""[^"]*+)*+"')

    def follow(self, text: str, inside: bool) -> Followed:
        at, began, ended, comments = 0, None if inside else 0, None, []
        if not inside and text.startswith('"'):
            at = 1
            inside = True
        elif not inside and text.startswith("#"):
            at = self._comment(text, 0, comments)
        while True:
            if inside:
                close = self.closing.match(text, at)
                if not close:
                    return Followed(True, began, ended, comments)
                at = close.end()
            found = self.opening.search(text, at)
            last = found.start() + 1 if found else len(text)
            if ended is None and (first := _BREAK.search(text, at, last)):
                # the search may end between \r and \n only where a text ends
                ended = first.end()
            began = max(text.rfind("\n", at, last), text.rfind("\r", at, last)) + 1 or began
            if not found:
                return Followed(False, began, ended, comments)
            inside = text[found.end() - 1] == '"'
            at = found.end() if inside else self._comment(text, found.end() - 1, comments)

    @staticmethod
    def _comment(text: str, start: int, comments: list[tuple[int, int]]) -> int:
        end = _END_OF_LINE.search(text, start)
        comments.append((start, end.start() if end else len(text)))
        return comments[-1][1]

    def effect(self, text: str, states: tuple[bool, bool]) -> tuple[bool, bool]:
        """The states after the text, for each of two before it."""
        first = self.follow(text, states[0]).inside
        return first, first if states[0] == states[1] else self.follow(text, states[1]).inside


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text with a blank in place of each range, so that line breaks before and behind it stay two."""
    at, kept = 0, []
    for start, end in ranges:
        kept += [text[at:start], " "]
        at = end
    return "".join([*kept, text[at:]])


def breaks(text: str) -> int:
    return text.count("\n") + text.count("\r") - text.count("\r\n")


def rows_in(text: str, sep: str) -> Iterator[tuple[int, list[str]]]:
    """(line breaks before it, cells) of each row of a text without comments, however large its cells; blank rows are left out."""
    csv.field_size_limit(sys.maxsize)
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
    while True:
        at = reader.line_num
        try:
            row = next(reader)
        except StopIteration:
            return
        if len(row) > 1 or row and (not row[0] or row[0].strip()):
            yield at, row


def split_rows(text: str, sep: str) -> Iterator[tuple[int, list[str]]]:
    """As rows_in(), of a text with comments."""
    return rows_in(without(text, Quotes(sep).follow(text, False).comments), sep)


# pieces of files ---------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, start, line): lines with their line feeds, in order within each piece of a file that begins at start."""
    file = spark.read.option("lineSep", "\n").text(paths)
    line = F.concat(F.col("value").cast("binary"), F.lit(b"\n"))
    return file.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), line.alias("line"))


def _key(path: Column, start: Column) -> Column:
    return F.xxhash64(path, start)


def _text(raw: bytes, encoding: str, first: bool) -> str:
    return (raw.removeprefix(b"\xef\xbb\xbf") if first else raw).decode(encoding.removesuffix("-sig"), "replace")


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, str, int, bytes]]:
    """(key, path, start, lines) of the runs of one piece. Lines stand one behind the other in Arrow's buffer."""
    keys, lines = batch["key"].to_numpy(), batch["line"].cast(pa.large_binary())
    ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1].tolist()
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        yield int(keys[begin]), batch["path"][begin].as_py(), batch["start"][begin].as_py(), lines.buffers()[2][ends[begin] : ends[end]].to_pybytes()


def _effects(sep: str, encoding: str):
    """Each piece's states at its end, begun outside and inside of quotes."""
    quotes = Quotes(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states, piece = None, (False, True), None

        def told() -> Iterator[pa.RecordBatch]:
            if piece is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*piece, *states)], ["path", "start", "outside", "inside"])

        for batch in batches:
            for key, path, start, raw in _segments(batch):
                if key != now:
                    yield from told()
                    now, states, piece = key, (False, True), (path, start)
                states = quotes.effect(_text(raw, encoding, False), states)
        yield from told()

    return run


@dataclass
class Pieces:
    """What tasks know of all pieces: by their keys, in order, whether they begin in quotes and the line breaks before them; and
    whether any piece ends in quotes."""

    keys: np.ndarray
    inside: np.ndarray
    line: np.ndarray
    crossed: bool

    def of(self, key: int) -> tuple[bool, int]:
        at = int(np.searchsorted(self.keys, key))
        return bool(self.inside[at]), int(self.line[at])


def pieces(lines: DataFrame, sep: str, encoding: str) -> Pieces:
    text = F.col("line").cast("string")
    quoted = lines.where(F.contains(text, F.lit('"'))).select("path", "start", "line", _key(F.col("path"), F.col("start")).alias("key"))
    effects = quoted.mapInArrow(_effects(sep, encoding), "path string, start long, outside boolean, inside boolean")
    # a lone carriage return is a line break too; the one before a line feed is not
    alone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\r"), F.lit(""))) - F.endswith(text, F.lit("\r\n")).cast("int")
    counted = lines.groupBy("path", "start").agg(F.sum(1 + alone).alias("n"))
    known = counted.join(effects, ["path", "start"], "left").select("path", "start", "n", F.coalesce("outside", F.lit(False)).alias("outside"), F.coalesce("inside", F.lit(True)).alias("inside"))
    swaps = (F.col("outside") & ~F.col("inside")).cast("int")
    order = W.partitionBy("path").orderBy("start")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    told = known.withColumn("swapped", F.sum(swaps).over(order)).withColumn("fixed", F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("state"), "swapped")))
    last = F.last("fixed", ignorenulls=True).over(before)
    since = F.coalesce(F.lag("swapped").over(order), F.lit(0)) - F.coalesce(last["swapped"], F.lit(0))
    begins = F.coalesce(last["state"], F.lit(False)) != (since % 2 == 1)
    ends = F.when(begins, F.col("inside")).otherwise(F.col("outside"))
    found = told.select(_key(F.col("path"), F.col("start")).alias("key"), begins.alias("begins"), ends.alias("ends"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("line")).toArrow()
    keys = found["key"].to_numpy()
    by = np.argsort(keys)
    if len(np.unique(keys)) < len(keys):
        raise RuntimeError("two pieces have one hash; read the files in two groups")
    return Pieces(keys[by], np.asarray(found["begins"])[by].astype(bool), found["line"].to_numpy()[by], any(found["ends"].to_pylist()))


class _Reader:
    """Reads a piece part by part: rows that lie in it whole, and fragments of those that don't."""

    def __init__(self, quotes: Quotes, path: str, start: int, inside: bool, line: int):
        self.quotes, self.path, self.start, self.inside, self.line = quotes, path, start, inside, line
        self.leading, self.head, self.pending = inside, [], []

    def read(self, text: str) -> str:
        """Takes a part; returns the text of the rows that end in it, without comments."""
        found = self.quotes.follow(text, self.inside)
        self.inside, at = found.inside, 0
        if self.leading:  # still in the row that was open where the piece began
            if found.ended is None:
                self.head.append(text)
                self.line += breaks(text)
                return ""
            at, self.leading = found.ended, False
            self.head.append(text[:at])
            self.line += breaks(text[:at])
        if found.inside and found.began is None:
            self.pending.append(text[at:])
            return ""
        end = found.began if found.inside else len(text)
        whole = without(text[:end], found.comments)[at:]  # comments lie behind the first row's end
        whole = "".join([*self.pending, whole])
        self.pending = [text[end:]] if found.inside else []
        return whole

    def fragments(self) -> Iterator[tuple[str, int, bool, int, str]]:
        if self.head:
            yield self.path, self.start, False, self.line, "".join(self.head)
        if self.pending:
            yield self.path, self.start, True, self.line, "".join(self.pending)


def _parsed(sep: str, encoding: str, known: Pieces, wanted: str):
    """wanted: rows or fragments."""
    quotes = Quotes(sep)

    def rows(reader: _Reader, whole: str) -> Iterator[pa.RecordBatch]:
        found = list(rows_in(whole, sep)) if wanted == "rows" else []
        if found:
            lines, cells = zip(*found, strict=True)
            columns = [pa.array([reader.path] * len(found)), pa.array([reader.line + n for n in lines], pa.int64()), pa.array(cells, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "row", "cells"])
        reader.line += breaks(whole)

    def ended(reader: _Reader | None) -> Iterator[pa.RecordBatch]:
        if reader is not None and wanted == "fragments" and (found := list(reader.fragments())):
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["path", "start", "opens", "row", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        for batch in batches:
            for key, path, start, raw in _segments(batch):
                first = key != now
                if first:
                    yield from ended(reader)
                    now, reader = key, _Reader(quotes, path, start, *known.of(key))
                yield from rows(reader, reader.read(_text(raw, encoding, first and start == 0)))
        yield from ended(reader)

    return run


def _joined(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(path, line + n, cells) for path, line, text in zip(*(batch[c].to_pylist() for c in ("path", "row", "text")), strict=True) for n, cells in split_rows(text, sep)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.list_(pa.string())), strict=True)], ["path", "row", "cells"])

    return run


def scanned(spark: SparkSession, paths: str | list[str], sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """(path, row, cells): all rows of delimited files of one form, each file read by as many tasks as it has pieces; row: the line
    breaks before it in its file. Cells are as the csv module gives them. encoding: one that leaves ASCII as it is. Blank rows and
    comments are left out. Of a quote that is never closed the last line break of the file is not told from none."""
    # texts of this encoding have line feeds, quotes and separators in no other characters
    if any(c.encode(encoding.removesuffix("-sig")) != c.encode("ascii") for c in ("\n", '"', sep)):
        raise ValueError(f"{encoding} does not leave ASCII as it is")
    lines = _lines(spark, [paths] if isinstance(paths, str) else paths)
    known = pieces(lines, sep, encoding)
    keyed = lines.select("path", "start", "line", _key(F.col("path"), F.col("start")).alias("key"))
    whole = keyed.mapInArrow(_parsed(sep, encoding, known, "rows"), ROWS)
    if not known.crossed:
        return whole
    fragments = keyed.mapInArrow(_parsed(sep, encoding, known, "fragments"), FRAGMENTS)
    order = W.partitionBy("path").orderBy("start", "opens")
    named = fragments.withColumn("of", F.sum(F.col("opens").cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("start", "opens", "text")))
    put = named.groupBy("path", "of").agg(F.min("row").alias("row"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(put.select("path", "row", "text").mapInArrow(_joined(sep), ROWS))
