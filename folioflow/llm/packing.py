"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its pieces by best fit, largest first, and emits the bins that are nearly full. The underfull bins
go on as items of the next level, whose nodes merge many partitions, and so on until one node holds all that is left or
a level no longer saves bins. A node gets about NODE_ITEMS items, whatever the size of the input.

A bin travels as one row: its fill and its members as a packed array of MEMBER records, so no level joins back.

Null text is empty text; every document ends with the end id, so none is without a piece. A null doc_id stays null and
repeated doc_ids are packed each for itself. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import text_groups, written
from folioflow.llm.tokenize import CHARS, word_tokens

MEMBER = np.dtype([("doc_id", "<i8"), ("null", "?"), ("piece", "<i8"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BINS = "fill int, members binary"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Items that one node packs, and the share of a bin from which it counts as nearly full.
NODE_ITEMS, NEARLY_FULL = 200_000, 0.995


def best_fit(fills: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of item positions: largest item first, each into the open bin that it leaves least room in."""
    order = np.argsort(-fills, kind="stable")
    room_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room left
    rooms, bins = 0, []  # rooms: bit r is set if a bin has room r
    for item in order.tolist():
        size = int(fills[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = room_bins[room].pop()
            if not room_bins[room]:
                rooms ^= 1 << room
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        if left := room - size:
            room_bins[left].append(at)
            rooms |= 1 << left
    return bins


def packed(fills: list[int], members: list[bytes], capacity: int) -> pa.RecordBatch:
    """The bins that best fit makes of these items."""
    bins = best_fit(np.array(fills, np.int64), capacity)
    return pa.RecordBatch.from_arrays(
        [pa.array([sum(fills[i] for i in b) for b in bins], pa.int32()), pa.array([b"".join([members[i] for i in b]) for b in bins], pa.binary())],
        ["fill", "members"],
    )


def _pieces(path: str, capacity: int, end_id: int, words_kept: int, node_items: int):
    """Tokenises a partition's documents, cuts the long ones and packs node_items pieces at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = word_tokens(path, words_kept), np.array([end_id], "<u4").tobytes()
        fills: list[int] = []
        members: list[bytes] = []
        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_groups(batch.column(1), CHARS):
                for i, data in enumerate(tokens.encode(texts), first):
                    data += end
                    doc_id = ids[i].as_py()
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        fills.append(len(part) // 4)
                        members.append(np.array([(doc_id or 0, doc_id is None, piece, at // 4, len(part) // 4, zlib.crc32(part))], MEMBER).tobytes())
            if len(fills) >= node_items:
                yield packed(fills, members, capacity)
                fills, members = [], []
        if fills:
            yield packed(fills, members, capacity)

    return run


def _merge(capacity: int):
    """Packs the underfull bins of a node again; sorted first, so a lost task makes the same bins again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((f, m) for b in batches for f, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if rows:
            yield packed([f for f, _ in rows], [m for _, m in rows], capacity)

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each bin with their places."""
    for batch in batches:
        parts = [np.frombuffer(m, MEMBER) for m in batch.column(1).to_pylist()]
        if not parts:
            continue
        each = np.concatenate(parts)
        counts = np.array([len(p) for p in parts])
        ends = np.cumsum(each["length"], dtype=np.int64)
        starts = ends - each["length"]
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        offset = starts - np.repeat(starts[firsts], counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(each["doc_id"].copy(), pa.int64(), mask=each["null"].copy()), pa.array(each["piece"].astype(np.int32)), pa.array(each["start"].astype(np.int64)),
                pa.array(each["length"].astype(np.int64)), pa.array(each["crc"].astype(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), counts)), pa.array(offset),
            ],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, node_items: int = NODE_ITEMS, nearly_full: float = NEARLY_FULL, words_kept: int = 700_000) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. path: a tokenizers file;
    words_kept: how many words a task keeps the ids of, which takes about 400 bytes each."""
    text = docs.select("doc_id", "text")
    bins = written(text.mapInArrow(_pieces(path, capacity, end_id, words_kept, node_items), BINS), "bins")
    least = int(np.ceil(nearly_full * capacity))
    done = []
    while True:
        done.append(bins.where(F.col("fill") >= least))
        rest = bins.where(F.col("fill") < least)
        size = rest.count()
        if size <= 1:
            done.append(rest)
            break
        nodes = -(-size // node_items)
        # hashed by the members, so that a node gets the same bins whenever it runs again
        merged = written(rest.repartition(nodes, F.xxhash64("members")).mapInArrow(_merge(capacity), BINS), "bins")
        saved = size - merged.count()
        bins = merged
        if nodes == 1 or saved < 0.001 * size:
            done.append(merged.where(F.col("fill") < least))
            done.append(merged.where(F.col("fill") >= least))
            break
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    numbered = every.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.mapInArrow(_opened, PIECES)
