"""Quality rules on repetition within a document, by a suffix array over its words.

Per document: a suffix array by prefix doubling and the longest common prefixes (LCP) of neighbours in it. The LCP intervals
of min_repeat words or more are its maximal repeated passages. The union of their spans is what they cover, and the longest
interval is the longest repeat. A document is rejected if more than max_covered of its words are covered, or if its longest
repeat has more than max_longest words. Before that come plain rules: too few words, or too many in repeated windows.

Words are [^\\x20\\x09-\\x0D]+. Null or empty text: no words, which the plain rules reject. Long texts are taken whole.
Null doc_ids stay; each repeated row gets a row; empty tables give none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm.common import LONG_WORD, WordCache, held, text_groups

RULED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "longest_repeat long, covered_words long, n_repeats long, kept boolean"
)
WINDOW = 5
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Limits:
    """min_words and max_repeat_percent are of the plain rules; the others of the suffix array."""

    min_words: int = 10
    max_repeat_percent: int = 20
    min_repeat: int = 8
    max_covered: float = 0.2
    max_longest: int = 60


class WordNumbers(WordCache):
    """word -> a number of its own, as long as it is kept: long words until the next group of texts."""

    def __init__(self):
        super().__init__()
        self.next, self.long = 0, {}

    def compute(self, word: bytes) -> int:
        if word in self.long:
            return self.long[word]
        self.next += 1
        if len(word) >= LONG_WORD:
            self.long[word] = self.next
        return self.next

    def rotate(self) -> None:
        super().rotate()
        self.long = {}


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before; the first has 0)."""
    n = len(words)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, width = new, 2 * width
        if rank[order[-1]] == n - 1 or width >= n:
            break
        levels.append(rank)
    # level k has equal ranks where 2**k words agree; walk down to the exact length
    a, b = order[1:].copy(), order[:-1].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a + common < n) & (b + common < n)
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        # near the end of the text a rank also tells where it ends, so a full match must fit
        same = inside & (levels[k][x] == levels[k][y]) & (a + common + (1 << k) <= n) & (b + common + (1 << k) <= n)
        common += np.where(same, 1 << k, 0)
    return order, np.concatenate([[0], common])


def lcp_intervals(common: np.ndarray, min_repeat: int) -> list[tuple[int, int, int]]:
    """(length, left, right): suffixes left to right - 1 of the order share a passage of that many words, min_repeat or more,
    and neither another suffix does nor do they share a longer one. Those within another come before it."""
    found, stack = [], []  # stack of (length, left end)
    # outside runs of neighbours that share min_repeat words no interval is open
    for i in np.flatnonzero((common >= min_repeat) | (np.concatenate([[0], common[:-1]]) >= min_repeat)).tolist() + [len(common)]:
        length, left = int(common[i]) if i < len(common) else 0, i - 1
        while stack and stack[-1][0] > length:
            top, left = stack.pop()
            found.append((top, left, i))
        if length >= min_repeat and (not stack or stack[-1][0] < length):
            stack.append((length, left))
    return found


def repeats(words: np.ndarray, min_repeat: int) -> tuple[int, np.ndarray, int]:
    """(longest repeat of any length, mask of the words that passages of min_repeat words or more cover, how many passages)."""
    order, common = suffix_array(words)
    intervals, n = lcp_intervals(common, min_repeat), len(words)
    # a suffix is covered by the innermost interval that it lies in, whose length is the larger of its two common prefixes
    reach = np.maximum(common, np.append(common[1:], 0)) if n else common
    inside = np.zeros(n + 1, np.int64)
    for _, left, right in intervals:
        inside[left] += 1
        inside[right] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, order[inside], 1)
    np.add.at(edge, order[inside] + reach[inside], -1)
    return int(common.max(initial=0)), np.cumsum(edge[:-1]) > 0, len(intervals)


def _windows(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of many texts' words in one array: per text, words in windows that occur twice or more in it, and any such."""
    n = len(flat)
    which = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.arange(n) + WINDOW <= np.repeat(starts + counts, counts))
    repeated = np.zeros(n + 1, np.int64)
    if len(at):
        with np.errstate(over="ignore"):
            key = which[at].astype(np.uint64)
            for j in range(WINDOW):
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + flat[at + j].astype(np.uint64)
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        a, b = at[order[same]], at[order[same + 1]]
        true = which[a] == which[b]
        for j in range(WINDOW):
            true &= flat[a + j] == flat[b + j]
        if not true.all():  # two windows with one key: sort the windows themselves
            rows = np.column_stack([which[at], *(flat[at + j] for j in range(WINDOW))])
            _, back, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            twice = at[times[back.ravel()] > 1]
        else:
            twice = np.unique(np.concatenate([a, b]))
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(repeated[:-1]) > 0)])
    return inside[starts + counts] - inside[starts], inside


def _rule(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = held("quality", "words", WordNumbers)
        for batch in batches:
            out = []
            for _, texts in text_groups(batch.column(1)):
                numbers.rotate()
                words = [t.encode().split() for t in texts]
                counts = np.array([len(w) for w in words])
                starts = np.cumsum(counts) - counts
                flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
                in_windows, _ = _windows(flat, starts, counts)
                for text, first, n, repeat in zip(texts, starts.tolist(), counts.tolist(), in_windows.tolist(), strict=True):
                    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
                    longest, mask, passages = repeats(flat[first : first + n], limits.min_repeat)
                    covered = int(mask.sum())
                    failed = n < limits.min_words or 100 * repeat > limits.max_repeat_percent * n
                    kept = not failed and covered <= limits.max_covered * n and longest <= limits.max_longest
                    out.append((n, len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, longest, covered, passages, kept))
            names = [x.split()[0] for x in RULED.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return run


def repetition_rules(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Per document: word and symbol counts, repeated lines and windows, longest repeat, covered words and repeated
    passages, kept. One pass."""
    return docs.select("doc_id", "text").mapInArrow(_rule(limits or Limits()), RULED)
