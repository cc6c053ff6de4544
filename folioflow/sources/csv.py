"""CSV files whose encoding, delimiter and header have to be found out."""

from __future__ import annotations

import codecs
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.values import number
from folioflow.operators.profile import value_classes
from folioflow.operators.tables import header_names, header_rows, header_scores
from folioflow.sources.quoted import Quotes, scanned, split_rows

DELIMITERS = (",", ";", "\t", "|")
#: Bytes, or characters, that the delimiter is judged by, and of large files the encoding.
HEAD_BYTES = 10_000
#: Files of more bytes are read by several tasks.
SPLIT_BYTES = 64 << 20
ROWS = "file string, row int, cells array<string>, error string"


def delimiter(head: Column) -> Column:
    """The candidate that occurs most in the first lines; ties go to the earlier candidate, none gives a comma."""
    counts = F.array(*(F.struct((F.length(head) - F.length(F.replace(head, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)))
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


#: Encodings of one byte a character that are told apart by what they make of the bytes from 128 on; the first of equals.
#: The first one is believed unless another is better by more than this, some three letters.
FIRST_GUESS = 9
SINGLE_BYTE = ("cp1252", "cp850", "mac_roman", "cp1251")


def encoding_of(data: bytes, whole: bool) -> str:
    """The encoding of a file, from all its bytes (whole) or its first ones: a byte order mark; UTF-16 by where zero bytes stand;
    UTF-8 if the bytes are valid, but for a character that is cut at their end; else the single-byte encoding in which the bytes
    from 128 on stand most like letters among letters. Latin-1 is the name of cp1252 where no byte tells them apart."""
    for mark, code in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return code
    even, odd = data[::2].count(0), data[1::2].count(0)
    if len(data) >= 4 and max(even, odd) * 5 >= len(data) // 2 and min(even, odd) * 20 <= max(even, odd):
        return "utf-16-le" if odd > even else "utf-16-be"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data, final=whole)
        return "utf-8"
    except UnicodeDecodeError as error:
        if whole and error.start >= len(data) - 3 and error.reason == "unexpected end of data":
            return "utf-8"  # a file that was cut
    # how often each byte from 128 on stands between which bytes
    raw = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.int64)
    at = np.flatnonzero(raw >= 128)
    threes, times = np.unique(raw[at - 1] << 16 | raw[at] << 8 | raw[at + 1], return_counts=True)
    scores = {code: sum(n * _likely(code, x >> 16, x >> 8 & 255, x & 255) for x, n in zip(threes.tolist(), times.tolist(), strict=True)) for code in SINGLE_BYTE}
    scores["cp1252"] += FIRST_GUESS
    best = max(SINGLE_BYTE, key=lambda c: scores[c])
    return "latin-1" if best == "cp1252" and not any(128 <= b < 160 for b in set(data)) else best


@lru_cache(1 << 16)
def _likely(code: str, before: int, byte: int, after: int) -> int:
    """How well a character fits between its neighbours: letters in words, of the case and script of the word, and marks outside."""
    a, c, b = (bytes([x]).decode(code, "replace") for x in (before, byte, after))
    if c == "\ufffd" or unicodedata.category(c) in ("Cc", "Cn", "Co"):
        return -8
    inside = a.isalpha() + b.isalpha()
    if not c.isalpha():
        return (1, 0, -3)[inside] if unicodedata.category(c)[0] in "PS" and not unicodedata.name(c, "").startswith("BOX") else -2
    if inside and any(x.isalpha() and x.isascii() and ord(c) >= 0x370 for x in (a, b)):
        return -3  # another script
    if ord(c) < 0x250 and (crowd := sum(x.isalpha() and not x.isascii() for x in (a, b))):
        return -crowd  # letters with accents stand alone
    if c.isupper() and a.islower():
        return -3
    return 1 + inside if c.islower() or not (a.isalpha() and b.islower() and a.islower()) else 0


def consistent_delimiter(text: str) -> str | None:
    """The candidate that cuts most rows of a text into one number of cells, two or more; of equals the one with more cells, then the
    earlier one. Quotes are read. None if no candidate cuts a row."""
    best: tuple = (0, 0)
    found = None
    for sep in DELIMITERS:
        widths = Counter(len(cells) for _, cells in islice(split_rows(text, sep), 100))
        many = {w: n for w, n in widths.items() if w > 1}
        if many:
            width = max(many, key=lambda w: (many[w], w))
            if (score := (many[width] / sum(widths.values()), width)) > best:
                best, found = score, sep
    return found


def delimiter_of(text: str) -> str:
    """The consistent one, else as delimiter()."""
    if found := consistent_delimiter(text[:HEAD_BYTES].rsplit("\n", 1)[0] if len(text) > HEAD_BYTES else text):
        return found
    head = "\n".join([x for x in text[:HEAD_BYTES].split("\n") if not x.startswith("#")][:5])
    best = max(DELIMITERS, key=head.count)  # the first of those that occur most
    return best if head.count(best) else ","


def decoded(files: DataFrame) -> DataFrame:
    """(path, length, encoding, text) of files (path, length, content), each by its own encoding, told from all its bytes; bytes that
    it can't read become replacement characters, so no file stops the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [c or b"" for c in batch.column(2).to_pylist()]
            codes = [encoding_of(c, True) for c in data]
            texts = [c.decode(e, "replace") for c, e in zip(data, codes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(texts, pa.string())], ["path", "length", "encoding", "text"])

    return files.select("path", F.col("length").cast("long").alias("length"), "content").mapInArrow(run, "path string, length long, encoding string, text string")


def sniffed(spark: SparkSession, path: str, lines: int = 5) -> DataFrame:
    """(path, length, encoding, delimiter, by_count) of each file: the delimiter by consistent rows, and by count in its first lines,
    of which one alone is the third way of telling it."""
    files = spark.read.format("binaryFile").load(path)
    text = F.substring("text", 1, HEAD_BYTES)
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.startswith(x, F.lit("#")))
    consistent = F.pandas_udf(lambda texts: texts.map(delimiter_of), "string")
    return decoded(files).select("path", "length", "encoding", consistent(text).alias("delimiter"), delimiter(F.array_join(F.slice(kept, 1, lines), "\n")).alias("by_count"))


def read(spark: SparkSession, path: str, sep: str = ",", header: bool = True, encoding_: str = "UTF-8") -> DataFrame:
    """Rows of large files of one form, as strings: comments and malformed lines go, empty cells are null."""
    return spark.read.csv(path, sep=sep, header=header, comment="#", mode="DROPMALFORMED", encoding=encoding_, nullValue="", multiLine=False)


def rows_of(file: str, text: str, sep: str) -> Iterator[tuple[int | None, list[str | None] | None, str | None]]:
    """(row, cells, error): strictly, every row has the width of the first. Shorter rows are padded with nulls, longer ones are left
    out and named as errors, and a file without rows gives one error. row: the line breaks before it. Line breaks are those of the
    csv module; blank rows and comments are left out where no quote is open."""
    width, n = None, 0
    for line, cells in split_rows(text, sep):
        width = width or len(cells)
        if len(cells) > width:
            yield line, None, f"{len(cells)} cells where {width} are expected"
            continue
        n += 1
        yield line, [c.strip() or None for c in cells] + [None] * (width - len(cells)), None
    if not n:
        yield None, None, "no rows"


def form_of(head: bytes, whole: bool) -> tuple[str, str, int] | None:
    """(delimiter, encoding, cells of the first row) from a file's first bytes; None if they hold no whole row."""
    code = encoding_of(head, whole)
    text = head.decode(code, "replace")
    sep = delimiter_of(text)
    quotes, at = Quotes(sep), 0
    while at < len(text):
        found = quotes.follow(text[at:], False)
        end = at + found.ended if found.ended is not None else len(text) if whole else None
        if end is None:
            return None
        for _, cells in split_rows(text[at:end], sep):
            return sep, code, len(cells)
        at = end
    return (sep, code, 0) if whole else None


def _heads(spark: SparkSession, files: list[tuple[str, int]]) -> list[tuple[str, str, int]]:
    """form_of() of large files, of which the driver reads the first bytes, more only where a first row is longer."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()

    def form(file: tuple[str, int]) -> tuple[str, str, int]:
        path, length, size = jvm.org.apache.hadoop.fs.Path(file[0]), file[1], HEAD_BYTES
        while True:
            stream = path.getFileSystem(hadoop).open(path)
            try:
                found = form_of(bytes(stream.readNBytes(min(size, length))), size >= length)
            finally:
                stream.close()
            if found:
                return found
            size *= 8

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(form, files))


def parsed(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, row, cells, error): all rows of delimited files, each file by its own encoding and delimiter; row: the line breaks
    before it in the file. A file that can't be read gives a row that says so. Files of more than split_bytes are read by many
    tasks each, unless their encoding is UTF-16 or UTF-32."""
    files = spark.read.format("binaryFile").load(path)
    large = [(r.path, r.length) for r in files.where(F.col("length") > split_bytes).select("path", "length").collect()]
    forms = defaultdict(list)
    for (name, _), form in zip(large, _heads(spark, large), strict=True):
        if not form[1].startswith(("utf-16", "utf-32")):
            forms[form].append(name)
    apart = [name for names in forms.values() for name in names]
    small = files.where((F.col("length") <= split_bytes) | ~F.col("path").isin(apart)) if apart else files
    out = parsed_texts(decoded(small).select(F.element_at(F.split("path", "/"), -1).alias("file"), "text"))
    for (sep, code, width), names in forms.items():
        wide = F.size("cells") > width
        blank = r"^[\s\x1C-\x1F\x85\p{Z}]+|[\s\x1C-\x1F\x85\p{Z}]+$"
        cells = F.transform("cells", lambda x: F.nullif(F.regexp_replace(x, blank, ""), F.lit("")))  # noqa: B023
        padded = F.concat(cells, F.array_repeat(F.lit(None).cast("string"), F.greatest(F.lit(width) - F.size("cells"), F.lit(0))))
        error = F.concat(F.size("cells").cast("string"), F.lit(f" cells where {width} are expected"))
        rows = scanned(spark, names, sep, code)
        name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
        out = out.unionByName(rows.select(name.alias("file"), F.col("row").cast("int").alias("row"), F.when(~wide, padded).alias("cells"), F.when(wide, error).alias("error")))
    return out


def parsed_texts(texts: DataFrame) -> DataFrame:
    """As parsed(), of (file, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(f, *r) for f, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows_of(f, t or "", delimiter_of(t or ""))]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "row", "cells", "error"])

    return texts.select("file", "text").mapInArrow(run, ROWS)


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Long cells (file, sheet, row, col, value) of delimited files, for table discovery."""
    return long_cells(parsed(spark, path))


def long_cells(rows: DataFrame) -> DataFrame:
    good = rows.where("error is null")
    return good.select("file", F.lit("Sheet1").alias("sheet"), "row", F.posexplode("cells").alias("col", "value"))


def header_lines(rows: DataFrame, lines: int = 30) -> DataFrame:
    """(file, header): the line of each file that looks most like a header, of its first rows. rows: of parsed()."""
    order = W.partitionBy("file").orderBy("row")
    numbered = rows.where("error is null").withColumn("_n", (F.row_number().over(order) - 1).cast("int")).where(F.col("_n") < lines)
    long = numbered.select("file", F.col("_n").alias("row"), F.posexplode("cells").alias("col", "value"))
    best = header_rows(header_scores(long, ["file"], lines), ["file"])
    return best.join(numbered.select("file", F.col("_n").alias("header"), F.col("row").alias("line")), ["file", "header"]).select("file", F.col("line").alias("header"))


def profiled(rows: DataFrame) -> DataFrame:
    """(file, col, name, class, rows, filled, low, high, mean, std): every column of each file below its header line. rows: of
    parsed()."""
    heads, long = header_lines(rows), long_cells(rows).drop("sheet")
    names = header_names(long, heads, ["file"])
    data = long.join(heads, "file").where("row > header").join(names, ["file", "col"]).withColumn("name", F.coalesce("name", F.concat(F.lit("column_"), (F.col("col") + 1).cast("string"))))
    value = number(F.col("value"))
    facts = data.groupBy("file", "col", "name").agg(F.count("*").alias("rows"), F.count("value").alias("filled"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    kinds = value_classes(data, ["file", "col"], "name").select("file", "col", "class")
    return facts.join(kinds, ["file", "col"], "left").select("file", "col", "name", "class", "rows", "filled", "low", "high", "mean", "std")
