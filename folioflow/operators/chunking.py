"""Chunks of texts and of rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.functions.text import n_words, sentences

_BREAK = re.compile(r"[.!?]\s")
_NOTHING = object()


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def folded(df: DataFrame, keys: list[str], order: str, values: list[str], fold: Callable[..., list[tuple]], ddl: str) -> DataFrame:
    """(keys and what ddl says): fold(columns of values, in order) for each group of keys. Groups come sorted and stream past, so
    a task holds one group at a time, whatever lies in its partition; ties in the order go by the values' hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = _NOTHING, [[] for _ in values]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            found = list(zip(*columns[: len(keys)], strict=True))
            starts = [i for i, k in enumerate(found) if i == 0 or k != found[i - 1]]
            out = []
            for a, b in zip(starts, [*starts[1:], len(found)], strict=True):
                if found[a] != key:
                    if key is not _NOTHING:
                        out += [(*key, *r) for r in fold(*held)]
                    key, held = found[a], [[] for _ in values]
                for h, c in zip(held, columns[len(keys) :], strict=True):
                    h += c[a:b]
            yield _batch(out, kinds, names)
        if key is not _NOTHING:
            yield _batch([(*key, *r) for r in fold(*held)], kinds, names)

    told = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(ddl).fields)
    kinds, names = [to_arrow_type(f.dataType) for f in told], told.names
    rows = df.repartition(*keys).sortWithinPartitions(*keys, order, F.xxhash64(*values))
    return rows.select(*keys, *values).mapInArrow(run, told)


def character_spans(text: str, size: int = 600, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, end) of overlapping chunks. A chunk ends behind the last sentence end near its full size, or at it; the last
    one ends with the text and nothing is given twice as a chunk of its own."""
    spans, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            low, high = max(end - 100, start + size // 2), min(end + 100, n)
            ends = [m.end() for m in _BREAK.finditer(text, low, high)]
            before = [e for e in ends if e <= end + 2]
            if ends:
                end = before[-1] if before else ends[0]
        spans.append((start, end))
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return spans


def character_chunks(df: DataFrame, key: str, text: str, size: int = 600, overlap: int = 200) -> DataFrame:
    """(key, n, start, end, chunk, chunk_id): the state of one chunk decides the next, so texts are walked in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (a, b) in enumerate(character_spans(t or "", size, overlap)):
                    rows.append((k, i, a, b, t[a:b], hashlib.sha256(f"{k}:{a}".encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [batch.schema.names[0], "n", "start", "end", "chunk", "chunk_id"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n int, start int, end int, chunk string, chunk_id string")


def sentence_chunks(df: DataFrame, key: str, text: str, per_chunk: int = 5) -> DataFrame:
    """(key, n, chunk, words, characters, tokens): runs of sentences, without a shuffle."""
    all_ = df.select(key, sentences(F.col(text)).alias("s"))
    starts = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.floor((F.size("s") - 1) / per_chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
    parts = all_.select(key, "s", F.explode(starts).alias("n"))
    chunk = F.array_join(F.slice("s", F.col("n") * per_chunk + 1, per_chunk), " ")
    out = parts.select(key, "n", chunk.alias("chunk"))
    return out.select("*", n_words(F.col("chunk")).alias("words"), F.length("chunk").alias("characters"), (n_words(F.col("chunk")) + 10).alias("tokens"))


def row_batches(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Each row with its batch and its place in it, counted within groups."""
    n = F.row_number().over(W.partitionBy(group).orderBy(order)) - 1
    return df.withColumn("_n", n).withColumn("batch", F.floor(F.col("_n") / size).cast("int")).withColumn("place", (F.col("_n") % size + 1).cast("int")).drop("_n")


def packed_rows(df: DataFrame, group: str, order: str, text: str, header: int, max_rows: int = 150, max_characters: int = 3000) -> DataFrame:
    """(group, chunk, row_start, row_end, characters): rows in order until a chunk is full; a row is never split. The fill
    starts again with each chunk, which no window can say, so sorted groups stream through tasks that keep one chunk open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk, start, at, used = _NOTHING, 0, 0, 0, header
        out: list[tuple] = []
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = (n or 0) + 2
                if k != key:
                    if key is not _NOTHING:
                        out.append((key, chunk, start + 1, at, used))
                    key, chunk, start, at, used = k, 0, 0, 0, header
                elif at - start >= max_rows or used + size > max_characters:
                    out.append((key, chunk, start + 1, at, used))
                    chunk, start, used = chunk + 1, at, header
                at, used = at + 1, used + size
            yield _batch(out, kinds, names)
            out = []
        if key is not _NOTHING:
            yield _batch([(key, chunk, start + 1, at, used)], kinds, names)

    kinds, names = [_arrow(df, group), *[pa.int32()] * 4], [group, "chunk", "row_start", "row_end", "characters"]
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.length(text).alias("n")).repartition("g").sortWithinPartitions("g", "o")
    return rows.select("g", "n").mapInArrow(run, f"{group} {df.schema[group].dataType.simpleString()}, chunk int, row_start int, row_end int, characters int")


def row_text(headers: list[str], columns: list[str], place: Column) -> Column:
    """One row of a chunk as text."""
    return F.concat(F.lit("Row "), place.cast("string"), F.lit(": "), F.concat_ws(", ", *(F.concat(F.lit(f"{h}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for h, c in zip(headers, columns, strict=True))))


def chunk_text(headers: list[str], line: Column) -> Column:
    """A chunk of rows as text: a line of headers, then a line for each row; line: arrays of row_text()."""
    return F.concat(F.lit(f"Headers: {', '.join(headers)}\n"), F.array_join(line, "\n"))


def column_groups(df: DataFrame, columns: list[str], groups: int) -> DataFrame:
    """(column, volume, part): columns dealt round to groups, those with most text first."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    volume = long.groupBy("column").agg(F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("volume"))
    return volume.withColumn("part", ((F.row_number().over(W.orderBy(F.desc("volume"), "column")) - 1) % groups).cast("int"))  # a row for each column


def chunk_plan(pages: Column, sentences_: Column) -> Column:
    """(mode, target, size): fine for short documents, coarse for long; a chunk has two to eight sentences."""
    mode = F.when(pages <= 5, "fine").when(pages <= 20, "moderate").otherwise("coarse")
    target = F.when(pages <= 5, pages * 4).when(pages <= 20, pages * 3).otherwise(pages * 2)
    size = F.greatest(F.lit(2), F.least(F.lit(8), F.floor(sentences_ / F.greatest(F.lit(1), target)))).cast("int")
    return F.struct(mode.alias("mode"), target.cast("int").alias("target"), size.alias("size"))


def reading_seconds(words: Column) -> Column:
    return words / 200 * 60


def semantic_breaks(changes: np.ndarray, ceiling: float = 0.5, deviations: float = 0.8) -> float:
    """The change from which a sentence starts a new chunk."""
    return min(ceiling, float(changes.mean() + deviations * changes.std())) if len(changes) else ceiling


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    length = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / length if length else 0.0


def semantic_spans(sentences_: list[str], vectors: np.ndarray, most: int = 8, least: int = 2, near: float = 0.5, overlap: int = 1) -> list[tuple[int, int]]:
    """(first, last) of the chunks of a document's sentences.

    Documents of at most `most` sentences are cut in thirds if they have over three; thirds under ten characters go. Longer
    ones are walked: a full chunk ends and the next repeats its last `overlap` sentences; a chunk of `least` or more ends where
    the subject changes more than usual and the sentence is not near the chunk's mean, taking that sentence in as well if
    its text breaks off at a mark, and before captions of tables and figures and short lines that end with a colon.
    Neighbours of which one has under ten words are joined if their means are alike.
    """
    n = len(sentences_)
    counts = [len(s.split()) for s in sentences_]
    if n <= most:
        size = max(least, n // 3)
        parts = [(a, min(a + size, n) - 1) for a in range(0, n, size)] if n > 3 else []
        parts = [(a, b) for a, b in parts if len(" ".join(sentences_[a : b + 1]).strip()) >= 10]
        return parts if len(parts) > 1 else [(0, n - 1)] if n else []
    norms = np.linalg.norm(vectors, axis=1)
    both = norms[1:] * norms[:-1]
    change = 1 - np.divide((vectors[1:] * vectors[:-1]).sum(axis=1), both, out=np.zeros(n - 1), where=both > 0)
    limit = semantic_breaks(change)
    spans, start, open_ = [], 0, 1  # open_: sentences of the open chunk
    for i in range(1, n):
        text, before = sentences_[i].strip(), sentences_[i - 1].strip()
        if open_ >= most:
            spans.append((start, i - 1))
            start = max(0, i - overlap)
            open_ = i - start + 1
            continue
        if open_ >= least:
            mean = vectors[start:i].mean(axis=0)
            turned = change[i - 1] > limit and norms[i] > 0 and mean.any() and _cosine(vectors[i], mean) < near
            caption = text.startswith(("Table ", "Figure ")) or (counts[i] <= 8 and text.endswith(":") and not before.endswith(":"))
            if turned or caption:
                unfinished = turned and i < n - 1 and before.endswith((",", ";", ":", "(", "-"))
                spans.append((start, i if unfinished else i - 1))
                start, open_ = i, 1
                continue
        open_ += 1
    spans.append((start, n - 1))
    joined = spans[:1]
    for a, b in spans[1:]:
        c, d = joined[-1]
        short = min(sum(counts[c : d + 1]), sum(counts[a : b + 1])) < 10
        if short and _cosine(vectors[c : d + 1].mean(axis=0), vectors[a : b + 1].mean(axis=0)) > 0.7:
            joined[-1] = (c, b)
        else:
            joined.append((a, b))
    return joined


def semantic_chunks(df: DataFrame, key: str | list[str], order: str, sentence: str, embedding: str, most: int = 8, least: int = 2, near: float = 0.5, overlap: int = 1) -> DataFrame:
    """(key, chunk, first, last, words): chunks of a document's sentences by semantic_spans(); first and last: their order."""

    def fold(orders: list[int], texts: list[str], vectors: list) -> list[tuple]:
        texts = [t or "" for t in texts]
        spans = semantic_spans(texts, np.array(vectors, float).reshape(len(texts), -1), most, least, near, overlap)
        return [(n, orders[a], orders[b], sum(len(t.split()) for t in texts[a : b + 1])) for n, (a, b) in enumerate(spans)]

    keys = [key] if isinstance(key, str) else key
    rows = df.select(*keys, F.col(order).cast("long").alias("_o"), F.col(sentence).alias("_s"), F.col(embedding).alias("_v"))
    return folded(rows, keys, "_o", ["_o", "_s", "_v"], fold, "chunk int, first long, last long, words long")


def limited_spans(texts: list[str], vectors: np.ndarray, near: float = 0.25, characters: int = 700) -> list[tuple[int, int]]:
    """(first, last): a chunk ends after three or more sentences before one that is not near the last, or when it has the
    characters; sentences under ten characters count with the one before. The last sentence is kept."""
    spans, start, used, units = [], 0, 0, 0
    for i, text in enumerate(texts):
        if not (len(text) < 10 and units):
            units, used = units + 1, used + len(text)
        if i + 1 == len(texts) or (_cosine(vectors[i], vectors[i + 1]) < near and units >= 3) or used >= characters:
            spans.append((start, i))
            start, used, units = i + 1, 0, 0
    return spans


def limited_chunks(df: DataFrame, key: str, order: str, heading: str, sentence: str, embedding: str, near: float = 0.25, characters: int = 700, least: int = 50) -> DataFrame:
    """(key, chunk, heading, first, last, characters): limited_spans() within each run of one heading; chunks that follow each
    other under one heading become one, and a short last chunk joins the one before."""

    def fold(orders: list[int], heads: list[str], texts: list[str], vectors: list) -> list[tuple]:
        vectors, texts = np.array(vectors, float).reshape(len(texts), -1), [t or "" for t in texts]
        out: list[list] = []
        starts = [i for i in range(len(texts)) if i == 0 or heads[i] != heads[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(texts)], strict=True):
            for c, d in limited_spans(texts[a:b], vectors[a:b], near, characters):
                size = sum(map(len, texts[a + c : a + d + 1])) + d - c
                if out and out[-1][0] == heads[a]:
                    out[-1][2], out[-1][3] = orders[a + d], out[-1][3] + 1 + size
                else:
                    out.append([heads[a], orders[a + c], orders[a + d], size])
        if len(out) > 1 and out[-1][3] < least:
            *_, last, size = out.pop()
            out[-1][2], out[-1][3] = last, out[-1][3] + 1 + size
        return [(n, *r) for n, r in enumerate(out)]

    rows = df.select(key, F.col(order).cast("long").alias("_o"), F.col(heading).alias("_h"), F.col(sentence).alias("_s"), F.col(embedding).alias("_v"))
    return folded(rows, [key], "_o", ["_o", "_h", "_s", "_v"], fold, "chunk int, heading string, first long, last long, characters int")


def hybrid_chunks(sentences_: DataFrame, headers: DataFrame, key: str, order: str, sentence: str, embedding: str, most: int = 8) -> DataFrame:
    """(key, section, chunk, first, last, words): semantic chunks that never cross a header; sentences before the first
    header are section 0. headers: key, order (that of the first sentence below)."""
    marks = headers.select(key, F.col(order).cast("long").alias(order), F.lit(1).alias("_h"))
    both = sentences_.select(key, F.col(order).cast("long").alias(order), sentence, embedding, F.lit(0).alias("_h")).unionByName(marks, allowMissingColumns=True)
    # a header stands before the sentence with its number
    section = F.sum("_h").over(W.partitionBy(key).orderBy(order, F.desc("_h")).rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = both.withColumn("section", section).where("_h = 0")
    return semantic_chunks(rows, [key, "section"], order, sentence, embedding, most)


def placed_headers(headers: DataFrame, sentences_: DataFrame, key: str, position: str, order: str) -> DataFrame:
    """headers, whose position is a line, with the place of the sentence that they stand before in the column order, from 0: lines
    up to the last header are taken to hold equally many sentences. A header of a text without sentences is left out."""
    counts = sentences_.groupBy(key).agg(F.count("*").alias("_n"))
    lines = headers.groupBy(key).agg((F.max(position) + 1).alias("_lines"))
    place = F.least(F.floor(F.col(position) * F.col("_n") / F.col("_lines")), F.col("_n") - 1)
    return headers.join(counts, key).join(lines, key).withColumn(order, place).drop("_n", "_lines")


def budgeted_chunks(df: DataFrame, group: str, order: str, columns: list[str], rows: int = 100, tokens: int = 2000) -> DataFrame:
    """(group, batch, half, part, rows, columns, tokens): batches of rows; a batch with more tokens than allowed is halved by rows
    again and again until each piece is small enough or one row; where one row is still too large, its columns are dealt to
    parts by turns, those with most text first. half: the place of the piece in its batch; each part has its estimate."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    placed = row_batches(df.select(group, order, *text), group, order, rows)
    size = sum((F.length(c) for c in columns), F.lit(0))
    pieces = placed.select(group, "batch", "place", *columns, F.lit(0).alias("half"), F.lit(rows).alias("_span"), size.alias("_size"))
    # a piece covers places half * span + 1 to (half + 1) * span; as often as a batch of rows can be halved
    for _ in range(max(0, (rows - 1).bit_length())):
        each = W.partitionBy(group, "batch", "half", "_span")
        large = (F.floor(F.sum("_size").over(each) / 3.5) > tokens) & (F.count("*").over(each) > 1)
        span = F.when(large, F.ceil(F.col("_span") / 2).cast("int")).otherwise(F.col("_span"))
        within = F.col("place") - 1 - F.col("half")
        pieces = pieces.withColumn("_new", span).withColumn("half", F.when(large, F.col("half") + F.floor(within / F.col("_new")).cast("int") * F.col("_new")).otherwise(F.col("half"))).withColumn("_span", F.col("_new")).drop("_new")
    long = pieces.unpivot([group, "batch", "half"], columns, "column", "value")
    volume = long.groupBy(group, "batch", "half", "column").agg(F.sum(F.length("value")).alias("characters"), F.count("*").alias("n"))
    each = W.partitionBy(group, "batch", "half")
    parts = F.least(F.lit(len(columns)), F.ceil(F.floor(F.sum("characters").over(each) / 3.5) / tokens)).cast("int")
    dealt = volume.withColumn("parts", F.greatest(F.lit(1), parts)).withColumn("part", ((F.row_number().over(each.orderBy(F.desc("characters"), "column")) - 1) % F.col("parts")).cast("int"))
    return dealt.groupBy(group, "batch", "half", "part").agg(F.max("n").alias("rows"), F.array_sort(F.collect_list("column")).alias("columns"), F.floor(F.sum("characters") / 3.5).alias("tokens"))


def section_paths(headers: DataFrame, key: str, position: str, level: str, text: str, depth: int = 6) -> DataFrame:
    """headers with path, the array of the titles above and their own: for each level the last title since a higher one."""
    order = W.partitionBy(key).orderBy(position)
    out = headers
    for d in range(1, depth + 1):
        # a title of level d stays until one of a smaller or the same level
        seen = F.last(F.when(F.col(level) == d, F.struct(F.col(position).alias("p"), F.col(text).alias("t"))), ignorenulls=True).over(order)
        higher = F.max(F.when(F.col(level) < d, F.col(position))).over(order)
        out = out.withColumn(f"_{d}", F.when((F.col(level) >= d) & (higher.isNull() | (seen["p"] > higher)), seen["t"]))
    path = F.array_compact(F.array(*(F.col(f"_{d}") for d in range(1, depth + 1))))
    return out.withColumn("path", path).withColumn("full_path", F.array_join(path, " > ")).drop(*(f"_{d}" for d in range(1, depth + 1)))


# The patterns of titles; a line is a title if it matches one of them.
TITLES = [
    r"(?i)^(\s*)(Environmental|Social|Governance)(\s+Impact|\s+Factors|\s+Metrics)?(\s*)$",
    r"(?i)^(\s*)(GRI|SASB)(\s+\d+\.?\d*)?(\s*:)?\s+([A-Za-z\s]+)$",
    r"(?i)^(\s*)(Carbon|Climate|Emissions|Diversity|Inclusion|Board|Ethics|Human Rights)(\s+[A-Za-z\s]+)?$",
    r"^\s*(\d+(\.\d+)?)\s+([A-Z][a-z]+(\s+[A-Za-z]+){0,5})\s*$",
    r"(?i)^(\s*)(Governance|Strategy|Risk Management|Metrics and Targets)(\s+of Climate-Related (Risks|Opportunities))?(\s*)$",
    r"(?i)^(\s*)(Executive Summary|Letter from (the |our )?(CEO|Chairman)|Financial (Highlights|Summary))(\s*)$",
    r"(?i)^(\s*)(Waste Management|Energy Efficiency|Water Usage|Biodiversity|Supply Chain|Community Relations)(\s+[A-Za-z\s]+)?$",
    r"(?i)^(\s*)(SDG|Sustainable Development Goal)s?(\s+\d+)?(\s*:)?\s*([A-Za-z\s]+)?$",
    r"(?i)^(\s*)(Abstract|Introduction|Background|Methodology|Methods|Results|Discussion|Conclusion)(\s*)$",
    r"^\s*(\d+(\.\d+)?\.?\s+)(.+)$",
    r"(?i)^(\s*)(References|Bibliography|Works Cited|Literature)(\s*)$",
    r"^([A-Z][A-Za-z\s]{2,40})$",
    r"(?i)^(\s*)(Introducción|Metodología|Conclusión|Referencias|Resultados|Discusión)(\s*)$",
    r"(?i)^(\s*)(\d+\.)(\s+)([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(\s+[A-Za-záéíóúñ]+){0,5})(\s*)$",
]
#: Texts of more lines than the first without a title are cut each so many lines.
LONG_TEXT, SECTION_LINES = 50, 300


def is_title(line: Column) -> Column:
    """Of a trimmed line."""
    return line.rlike("(?u)" + "|".join(f"({p})" for p in TITLES))  # so that letters with accents have no case either


def header_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, text, level): the trimmed lines of a text that are titles, level 2 if they hold a number like 1.2. A long
    text without any is cut into sections of SECTION_LINES lines, but for a break at its start. Without a shuffle."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("position"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("text")))
    titles = F.filter(lines, lambda x: is_title(x["text"]))
    titles = F.transform(titles, lambda x: F.struct(x["position"].alias("position"), x["text"].alias("text"), F.when(x["text"].rlike(r"\d+\.\d+"), 2).otherwise(1).alias("level")))
    n = F.size(F.split(text, "\n"))
    breaks = F.transform(F.sequence(F.lit(1), F.floor((n - 1) / SECTION_LINES).cast("int")), lambda i: F.struct((i * SECTION_LINES).alias("position"), F.concat(F.lit("Section "), i.cast("string")).alias("text"), F.lit(1).alias("level")))
    cut = F.when((F.size(titles) == 0) & (n > LONG_TEXT) & (n > SECTION_LINES), breaks).otherwise(titles)
    return df.select(key, F.inline(cut))
