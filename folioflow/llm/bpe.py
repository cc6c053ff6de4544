"""Byte-level BPE over a table of ranks, by a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte spans. Each mergeable rank has a bucket of list positions; a three-level bitmap over
the ranks finds the lowest rank that has any by three find-first-set steps. A popped position is stale when its pair has
changed since; it is then skipped. Every merge pushes two positions at most, so a pre-token of n bytes takes O(n log n)
steps however long it is.

Null text is empty text and encodes to no ids. Texts are encoded whole; the ids of repeated words are kept in a cache, which
is emptied between texts when it is full. Null doc_ids stay; each repeated row gets a row; empty tables give none; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioflow.llm.common import WordCache, held, text_groups

CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBPE:
    """Encodes bytes by ranks: id = rank of the merged bytes.

    buckets: positions by rank, as heaps; low, mid and a number top: bitmaps of the ranks that have any, of the words of low
    that have a bit set, and of the words of mid. All are empty between calls.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.n_ranks = max(ranks.values(), default=0) + 1
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.low = [0] * (self.n_ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.buckets: list[list[int]] = [[] for _ in range(self.n_ranks)]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        get, n = self.ranks.get, len(piece)
        if (whole := get(piece)) is not None:
            return [whole]
        low, mid, buckets, top = self.low, self.mid, self.buckets, 0
        ends = list(range(1, n + 1))  # where the span that starts here ends; spans are linked by their ends
        before = list(range(-1, n - 1))
        pair = [get(piece[i : i + 2], -1) for i in range(n)]  # rank of the span here with the next one; -1: none
        pair[-1] = -1
        fresh = [(rank, i) for i, rank in enumerate(pair) if rank >= 0]
        while True:
            for rank, i in fresh:
                bucket = buckets[rank]
                if bucket:
                    heappush(bucket, i)
                else:
                    bucket.append(i)
                    at = rank >> 6
                    if not low[at]:
                        mid[at >> 6] |= 1 << (at & 63)
                        top |= 1 << (at >> 6)
                    low[at] |= 1 << (rank & 63)
            if not top:
                break
            # find first set, three times
            j = (top & -top).bit_length() - 1
            word = mid[j]
            at = (j << 6) + (word & -word).bit_length() - 1
            word = low[at]
            rank = (at << 6) + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                low[at] = word = word & (word - 1)
                if not word:
                    mid[j] = word = mid[j] & (mid[j] - 1)
                    if not word:
                        top &= top - 1
            fresh = []
            if pair[i] != rank:
                continue  # stale
            gone = ends[i]
            end = ends[i] = ends[gone]
            pair[gone] = pair[i] = -1
            if end < n:
                before[end] = i
                pair[i] = rank = get(piece[i : ends[end]], -1)
                if rank >= 0:
                    fresh.append((rank, i))
            left = before[i]
            if left >= 0:
                pair[left] = rank = get(piece[left:end], -1)
                if rank >= 0:
                    fresh.append((rank, left))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : ends[i]]])
            i = ends[i]
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class TextCoder(WordCache):
    """Ids of texts. Key: a stretch of text that the pattern never matches across the ends of."""

    def __init__(self, path: str, pattern: str, limit: int = 900_000):
        super().__init__(limit)
        self.bpe = ByteBPE(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.odd = regex.compile(r" \s| $")

    def compute(self, stretch: str) -> tuple[int, ...]:
        found = self.pattern.findall(stretch)
        if len(found) == 1:
            return tuple(self.bpe.encode(stretch.encode()))
        ids: list[int] = []
        for piece in found:
            known = self.get(piece) or self.old.get(piece)
            if known is None:
                known = tuple(self.bpe.encode(piece.encode()))
                if len(piece) < 64:
                    self[piece] = known
            ids += known
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """The ids of one text. A single space before other than white space always begins a match, so texts split there."""
        self.rotate()
        if self.odd.search(text):
            return [i for piece in self.pattern.findall(text) for i in self._of(piece)]
        first, *rest = text.split(" ")
        ids = list(self._of(first))
        ids.extend(chain.from_iterable(map(self.__getitem__, [" " + r for r in rest])))
        return ids

    def _of(self, stretch: str) -> tuple[int, ...]:
        return self[stretch]

    def decode(self, ids) -> bytes:
        return self.bpe.decode(ids)


def text_coder(path: str, pattern: str) -> TextCoder:
    """One per Python worker and file."""
    return held("tokens", f"{path} {pattern}", lambda: TextCoder(path, pattern))


def _code(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(path, pattern)
        names = [str(i) for i in range(coder.bpe.n_ranks)]
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for _, texts in text_groups(batch.column(1)):
                for text in texts:
                    ids = coder.encode(text)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def code_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, sha256 of its ids and of the bytes they decode to. One pass, no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_code(path, pattern), CODED)
