"""Text search by positions: postings in delta-coded blocks, for phrases and prefixes.

Documents are dealt by a hash of their key into buckets of some BUCKET_CHARS characters. Of each bucket one task makes the postings
of all its terms, a row for each block of up to BLOCK documents of a term: the deltas of keys and of positions as bytes of seven bits.
The first and last key of a block stand beside it, so a block that holds none of the documents in question is skipped unread. A
frequent term has many blocks, of many buckets, so no term makes a large row or task.

A phrase meets in its buckets: those in which one of its terms is missing fall out in the join; in the others the rarest term
tells which documents count. Words are runs of letters, digits and underscores, lower-cased; positions count words. Null texts and
null keys are not indexed; rows that repeat a key are documents of their own, whose counts are added up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_CHARS, BLOCK = 4 << 20, 128
#: A text has fewer words than two to the power of this.
FAR = 40
POSTINGS = "term string, bucket int, first long, last long, documents int, occurrences long, data binary"
_WORD = re.compile(r"\w+")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes of seven bits, the lowest first; the highest bit says that more follow."""
    return _packed(numbers)[0].tobytes()


def _packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, and where those of each number end."""
    n = numbers.astype(np.uint64)
    width = np.maximum(1, -(-np.frexp(n.astype(np.float64))[1] // 7))
    width += (n >> (7 * width).astype(np.uint64) > 0) & (width < 10)  # a double may round down
    ends = np.cumsum(width)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - width, width)
    bits = (np.repeat(n, width) >> (7 * place).astype(np.uint64)) & np.uint64(127)
    return (bits + np.where(place < np.repeat(width, width) - 1, 128, 0).astype(np.uint64)).astype(np.uint8), ends


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(raw)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts) if len(raw) else np.zeros(0, np.uint64)


def blocks(keys: np.ndarray, counts: np.ndarray, positions: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Blocks of so many keys each, all packed together: keys in order within a block, how many positions each has, and these one
    behind the other."""
    ends = np.cumsum(counts)
    first = np.cumsum(sizes) - sizes  # the first key of each block
    steps = np.diff(positions, prepend=0)
    steps[ends - counts] = positions[ends - counts]
    apart = np.diff(keys, prepend=0)
    apart[first] = 0
    occurrences = np.add.reduceat(counts, first) if len(sizes) else counts
    # a block is its number of keys, their distances, the counts and the steps
    begin = np.cumsum(1 + 2 * sizes + occurrences) - (1 + 2 * sizes + occurrences)
    numbers = np.zeros(len(sizes) + 2 * len(keys) + len(positions), np.int64)
    numbers[begin] = sizes
    at = np.repeat(begin + 1 - first, sizes) + np.arange(len(keys))
    numbers[at] = apart
    numbers[at + np.repeat(sizes, sizes)] = counts
    numbers[np.repeat(begin + 1 + 2 * sizes - (np.cumsum(occurrences) - occurrences), occurrences) + np.arange(len(positions))] = steps
    data, to = _packed(numbers)
    offsets = np.concatenate([[0], to[np.append(begin[1:], len(numbers)) - 1]] if len(sizes) else [[0]]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def block(keys: np.ndarray, counts: np.ndarray, positions: np.ndarray) -> bytes:
    """One block."""
    return blocks(keys, counts, positions, np.array([len(keys)]))[0].as_py()


def opened(data: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) of each occurrence in a block."""
    numbers = unpacked(data).astype(np.int64)
    n = int(numbers[0])
    keys, counts, steps = first + np.cumsum(numbers[1 : n + 1]), numbers[n + 1 : 2 * n + 1], numbers[2 * n + 1 :]
    total = np.cumsum(steps)
    starts = np.cumsum(counts) - counts
    return np.repeat(keys, counts), total - np.repeat(total[starts] - steps[starts], counts)


class _Numbered(dict):
    """Words by the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _build(table: pa.Table) -> pa.Table:
    at, terms, docs, places = _Numbered(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = np.argsort(table["key"].to_numpy(), kind="stable")
    keys = table["key"].to_numpy()[order]
    for i, text in enumerate(table["text"].take(pa.array(order)).to_pylist()):
        words = _WORD.findall(text.lower())
        terms.append(np.fromiter(map(at.__getitem__, words), np.int64, len(words)))
        docs.append(np.full(len(words), i))
        places.append(np.arange(len(words)))
    term, doc, place = (np.concatenate(x) for x in (terms, docs, places))
    # rows that repeat a key are told apart by far positions
    place += (np.arange(len(keys)) - np.searchsorted(keys, keys))[doc] << FAR
    by = np.argsort(term, kind="stable")  # documents and places are in order already
    term, doc, place = term[by], doc[by], place[by]
    # a block ends with its term, or after BLOCK documents of it
    begins = np.concatenate([[True], np.diff(term) != 0])[: len(term)]
    fresh = np.flatnonzero(begins | np.concatenate([[True], np.diff(doc) != 0])[: len(term)])
    # of each term's documents: how many came before
    nth = np.arange(len(fresh)) - np.maximum.accumulate(np.where(begins[fresh], np.arange(len(fresh)), 0))
    cuts = np.flatnonzero(nth % BLOCK == 0)
    sizes, counts, own = np.diff(np.append(cuts, len(fresh))), np.diff(np.append(fresh, len(term))), keys[doc[fresh]]
    names = pa.array(list(at), pa.string()).take(pa.array(term[fresh[cuts]]))
    bucket = np.full(len(cuts), table["bucket"][0].as_py())
    occurrences = np.diff(np.append(fresh[cuts], len(term)))
    columns = [names, bucket, own[cuts], own[cuts + sizes - 1], sizes, occurrences, blocks(own, counts, place, sizes)]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in POSTINGS.split(", ")])


def postings(df: DataFrame, key: str, text: str, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """Blocks of the words of a text column; key: a column of whole numbers. Write it sorted by term, for scans that skip."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    buckets = -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // bucket_chars) or 1
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(_build, POSTINGS)


def phrase(index: DataFrame, words: str) -> DataFrame:
    """(key, n): documents that hold the words one behind the other, and how often."""
    wanted = _WORD.findall(words.lower())
    if not wanted:
        raise ValueError("a phrase has words")
    terms = sorted(set(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blocks in batch.column(0).to_pylist():
                by: dict[str, list[dict]] = {t: [b for b in blocks if b["term"] == t] for t in terms}
                order = sorted(terms, key=lambda t: sum(b["documents"] for b in by[t]))
                # where the phrase may begin, as documents and positions, by the rarest term first
                keys = begins = None
                for t in order:
                    for offset in (i for i, w in enumerate(wanted) if w == t):
                        some = by[t] if keys is None else [b for b in by[t] if len(keys) and np.searchsorted(keys, b["first"]) < np.searchsorted(keys, b["last"], "right")]
                        found = [opened(b["data"], b["first"]) for b in some] or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                        k, p = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]) - offset
                        k, p = k[p >= 0], p[p >= 0]
                        if keys is None:
                            keys, begins = k, p
                        else:
                            mine, other = (np.rec.fromarrays([a, b], names="k,p") for a, b in ((keys, begins), (k, p)))
                            same = np.isin(mine, other)
                            keys, begins = keys[same], begins[same]
                        by_key = np.argsort(keys, kind="stable")
                        keys, begins = keys[by_key], begins[by_key]
                if len(keys):
                    k, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], ["key", "n"])

    blocks = F.collect_list(F.struct("term", "first", "last", "documents", "data")).alias("blocks")
    met = index.where(F.col("term").isin(*terms)).groupBy("bucket").agg(blocks, F.count_distinct("term").alias("kinds"))
    return met.where(F.col("kinds") == len(terms)).select("blocks").mapInArrow(run, "key long, n long")


def prefix(index: DataFrame, start: str) -> DataFrame:
    """(key, n): documents with words that begin so, and how many they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, n = np.unique(opened(data, first)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], ["key", "n"])

    hits = index.where(F.startswith("term", F.lit(start.lower()))).select("first", "data").mapInArrow(run, "key long, n long")
    return hits.groupBy("key").agg(F.sum("n").alias("n"))
