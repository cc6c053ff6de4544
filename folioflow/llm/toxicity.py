"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found through a block-max inverted index.

Terms are the lower-case words (runs of letters) of a bounded sample of labelled rows: SAMPLE_ROWS of each class, smallest
hashes of doc_id. All of them are indexed. A term weighs its inverse document frequency, counted over all documents, times
the log of how much more often one class of the sample has it than the other, so the cosine is that of TF-IDF vectors in
which words that tell nothing about the class count little. Postings of rare terms stand by term and are added up for all
examples; those of terms in COMMON of the examples or more stand in blocks of examples, with each term's largest weight in
each block. A query adds these block maxima to the largest sum of its rare terms in a block, an upper bound for the block,
and skips the blocks that cannot reach the k-th best of what its rare terms add up to, so the neighbours are exact. A block is
scored for QUERIES_AT_ONCE queries at a time, all those that do not skip it, by one product of matrices.

Neighbours vote with their similarity, weighted so that classes count as they occur. Leave-one-out votes of the examples
give an isotonic calibration from vote to probability. Texts without any term of the sample get the rate of such examples.

Null and empty texts have no terms. Whole texts are scored. Without any label of both classes every score is 0. A null
doc_id is never held out. Each repeated row gets a row; conflicting labels of one doc_id count as toxic; examples of one
class and equal text are one, under the smallest doc_id; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import collected, first_share, given, held_out, let_go, text_groups, text_of, with_row, written

SAMPLE_ROWS, NEIGHBOURS, BLOCK, THRESHOLD = 3000, 15, 64, 0.7
#: Queries that go through the blocks together, and characters of texts whose terms are looked up together.
QUERIES_AT_ONCE, CHARS_AT_ONCE = 64, 1 << 18
#: Share of the examples from which on a term's postings are kept in blocks.
COMMON = 0.1
#: Documents of each class that a term's log-ratio is smoothed by; terms that both classes have equally often count a little too.
SMOOTHING, LEAST_ASSOCIATION = 5.0, 0.001
#: Weight of the base rate in a vote, as that of one example with similarity 1: faint likenesses alone decide nothing.
PRIOR = 1.0
SCORED = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"
_WORD = re.compile(r"[^\W\d_]+")
#: Latin-1 with a space for all that is no letter.
_LETTERS = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order, repeated ones too."""
    return _WORD.findall((text or "").lower())


def hashes(terms) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def term_counts(text: str | None) -> Counter:
    """How often each term occurs in the text: Counter(terms_of(text)), by a table of characters where one of 256 holds them."""
    try:
        return Counter((text or "").lower().encode("latin-1").translate(_LETTERS).decode("latin-1").split())
    except UnicodeEncodeError:
        return Counter(terms_of(text))


def numbers(terms, known: np.ndarray) -> np.ndarray:
    """The places of the terms in known, the hashes of known terms in order; -1 for other terms."""
    if not len(terms) or not len(known):
        return np.full(len(terms), -1, np.int64)
    found = hashes(terms)
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return np.where(known[at] == found, at, -1)


def counted_each(texts: list[str], known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, counts) of the known terms in each text, by number; a term of several texts is looked up once."""
    each = [term_counts(text) for text in texts]
    terms = set().union(*each)
    number = dict(zip(terms, numbers(terms, known).tolist(), strict=True))
    for counts in each:
        at = np.fromiter(map(number.__getitem__, counts), np.int64, len(counts))
        hit = np.flatnonzero(at >= 0)
        hit = hit[np.argsort(at[hit])]
        yield at[hit], np.fromiter(counts.values(), np.int64, len(counts))[hit]


@dataclass(frozen=True)
class Example:
    doc_id: int
    toxic: int
    terms: np.ndarray
    weights: np.ndarray


class BlockMaxIndex:
    """Exact top-k by inner product over examples of unit length."""

    def __init__(self, examples: list[Example], n_terms: int, block: int = BLOCK):
        times = np.zeros(n_terms, np.int64)
        for e in examples:
            times[e.terms] += 1
        common = np.flatnonzero(times >= max(2, COMMON * len(examples)))
        self.row = np.full(n_terms, -1, np.int32)
        self.row[common] = np.arange(len(common))

        def alike(e: Example) -> tuple[int, int, int, int]:
            weightiest = int(np.where(self.row[e.terms] < 0, 0, e.weights).argmax())
            return int(self.row[e.terms[weightiest]]), int(e.terms[e.weights.argmax()]), e.doc_id, e.toxic

        # examples that share their weightiest common term, so mostly the language, stand together, so that block maxima differ
        examples = sorted(examples, key=alike)
        self.block, self.n_blocks = block, -(-len(examples) // block)
        self.ids = np.array([e.doc_id for e in examples], np.int64)
        self.toxic = np.array([e.toxic for e in examples], np.int64)
        self.common = np.zeros((self.n_blocks, len(common), block))
        self.first = np.concatenate([[0], np.cumsum(np.where(self.row < 0, times, 0))])
        self.at, self.weights = np.zeros(self.first[-1], np.min_scalar_type(len(examples))), np.zeros(self.first[-1])
        ends = self.first[:-1].copy()
        for i, e in enumerate(examples):
            rows = self.row[e.terms]
            rare = e.terms[rows < 0]
            self.at[ends[rare]], self.weights[ends[rare]] = i, e.weights[rows < 0]
            ends[rare] += 1
            self.common[i // block, rows[rows >= 0], i % block] = e.weights[rows >= 0]
        self.maxima = self.common.max(axis=2).T.copy()

    def rare_sums(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What rare terms of a query add up to for each example, by block."""
        first = self.first[terms]
        sizes = self.first[terms + 1] - first
        # positions of all postings of the terms, one after the other
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        at += np.arange(len(at))
        products = self.weights.take(at)
        products *= np.repeat(weights, sizes)
        return np.bincount(self.at.take(at), products, self.n_blocks * self.block).reshape(self.n_blocks, self.block)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> list[tuple[float, int]]:
        """nearest_each for one query."""
        return self.nearest_each([(terms, weights)], k, [without])[0]

    def nearest_each(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int | None] | None = None) -> list[list[tuple[float, int]]]:
        """For each query (terms, weights), (similarity, position) of the k most similar examples, ties to the smaller doc_id;
        only those that share a term. without: for each query a doc_id to leave out, if not None."""
        left_out = without or [None] * len(queries)
        found = []
        for start in range(0, len(queries), QUERIES_AT_ONCE):
            found += self._nearest_each(queries[start : start + QUERIES_AT_ONCE], k, left_out[start : start + QUERIES_AT_ONCE])
        return found

    def _nearest_each(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int | None]) -> list[list[tuple[float, int]]]:
        scores = np.empty((len(queries), self.n_blocks, self.block))
        common = np.zeros((len(queries), self.maxima.shape[0]))
        for i, (terms, weights) in enumerate(queries):
            rows = self.row[terms]
            rare = rows < 0
            scores[i] = self.rare_sums(terms[rare], weights[rare])
            common[i, rows[~rare]] = weights[~rare]
        best = scores.max(axis=2)
        bounds = best + common @ self.maxima
        # what the rare terms alone add up to is a lower bound of the k-th best, with room for those left out
        wanted = [k + (int(np.count_nonzero(self.ids == w)) if w is not None else 0) for w in without]
        floors = np.array([kth_largest(s, b, n) for s, b, n in zip(scores, best, wanted, strict=True)])
        scored = (bounds > 0) & (bounds >= floors[:, None] - 1e-12)
        for b in np.flatnonzero(scored.any(axis=0)).tolist():
            those = np.flatnonzero(scored[:, b])
            scores[those, b] += common[those] @ self.common[b]
        return [self._best(scores[i], np.flatnonzero(scored[i]), k, wanted[i], w) for i, w in enumerate(without)]

    def _best(self, scores: np.ndarray, blocks: np.ndarray, k: int, wanted: int, without: int | None) -> list[tuple[float, int]]:
        """The k best of the scored blocks of a query."""
        if not len(blocks):
            return []
        sums = scores[blocks]
        floor = kth_largest(sums, sums.max(axis=1), wanted)
        block, place = np.nonzero((sums > 0) & (sums >= floor - 1e-12))
        at = blocks[block] * self.block + place
        best = sorted((-round(s, 12), int(self.ids[i]), i) for s, i in zip(sums[block, place].tolist(), at.tolist(), strict=True) if without is None or self.ids[i] != without)
        return [(-s, i) for s, _, i in best[:k]]


def kth_largest(sums: np.ndarray, best: np.ndarray, k: int) -> float:
    """The k-th largest of sums, a row for each block; 0 if there are fewer. best: the largest of each row, as their k-th
    largest leaves few sums to look at."""
    if len(best) >= k:
        sums = sums[sums >= np.partition(best, len(best) - k)[len(best) - k]]
    return max(0.0, float(np.partition(sums, sums.size - k, axis=None)[sums.size - k])) if sums.size >= k else 0.0


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower ends of steps, values) of the best non-decreasing fit, each step smoothed by a weight of half a row each way."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []  # start, sum, weight
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if steps and steps[-1][0] == a:
            steps[-1][1] += b * c
            steps[-1][2] += c
        else:
            steps.append([a, b * c, c])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, s, c2 = steps.pop()
            steps[-1][1] += s
            steps[-1][2] += c2
    half = 0.5 * float(w.mean()) if len(w) else 0.5
    return np.array([s[0] for s in steps]), np.maximum.accumulate([(s[1] + half) / (s[2] + 2 * half) for s in steps])


@dataclass(frozen=True)
class Model:
    known: np.ndarray
    term_weights: np.ndarray
    index: BlockMaxIndex | None
    class_weights: tuple[float, float]
    steps: np.ndarray
    values: np.ndarray
    without_terms: float
    base_rate: float
    neighbours: int

    def near_each(self, texts: list[str], without: list[int | None] | None = None) -> list[list[tuple[float, int]]]:
        """The neighbours of each text; none without known terms. without: for each text a doc_id to leave out, if not None."""
        found: list[list[tuple[float, int]]] = [[] for _ in texts]
        if self.index:
            vectors = {i: unit_vector(terms, counts, self.term_weights) for i, (terms, counts) in enumerate(counted_each(texts, self.known)) if len(terms)}
            near = self.index.nearest_each(list(vectors.values()), self.neighbours, [without[i] for i in vectors] if without else None)
            for i, those in zip(vectors, near, strict=True):
                found[i] = those
        return found

    def vote(self, near: list[tuple[float, int]]) -> float:
        weighed = [(s * self.class_weights[self.index.toxic[i]], self.index.toxic[i]) for s, i in near]
        return (sum(w for w, toxic in weighed if toxic) + PRIOR * self.base_rate) / (sum(w for w, _ in weighed) + PRIOR)

    def calibrated(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.without_terms
        return float(self.values[max(0, np.searchsorted(self.steps, self.vote(near), "right") - 1)])


def unit_vector(terms: np.ndarray, counts: np.ndarray, term_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights = (1 + np.log(counts)) * term_weights[terms]
    return terms, weights / np.sqrt((weights**2).sum())


def _frame(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    parts = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, columns.values(), strict=True)], list(columns))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples of each class by the hash of a term."""
    for batch in batches:
        found: tuple[list, list] = ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)])
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[toxic].append(hashes(set(terms_of(text))))
        for toxic in (0, 1):
            terms, n = np.unique(np.concatenate(found[toxic]), return_counts=True)
            none = pa.array(np.zeros(len(n), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), none if toxic else pa.array(n), pa.array(n) if toxic else none], ["term", "clean", "toxic"])


def _count_documents(sent: Broadcast):
    """Documents that hold each term; term -1 counts all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("toxicity")
        known = sent.value
        times = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for _, texts in text_groups(batch.column(0), CHARS_AT_ONCE):
                times[-1] += len(texts)
                spread = Counter(chain.from_iterable(map(term_counts, texts)))
                at = numbers(spread, known)
                np.add.at(times, at[at >= 0], np.fromiter(spread.values(), np.int64, len(spread))[at >= 0])
        at = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at < len(known), at, -1).astype(np.int32)), pa.array(times[at])], ["term", "n"])

    return run


def _example_terms(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, marks = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, texts in text_groups(batch.column(2), CHARS_AT_ONCE):
                for i, (terms, counts) in enumerate(counted_each(texts, sent.value), start):
                    rows.append((ids[i], marks[i], terms, counts))
            yield _frame(rows, {"doc_id": pa.int64(), "toxic": pa.int32(), "terms": pa.list_(pa.int32()), "counts": pa.list_(pa.int32())})

    return run


def _leave_one_out(sent: Broadcast):
    """The vote of each example's neighbours but itself; none without neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            rows, ids, marks = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, texts in text_groups(batch.column(2), CHARS_AT_ONCE):
                for i, near in enumerate(model.near_each(texts, ids[start : start + len(texts)]), start):
                    if near:
                        rows.append((model.vote(near), marks[i]))
            yield _frame(rows, {"vote": pa.float64(), "toxic": pa.int32()})

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, neighbours: int = NEIGHBOURS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1). Learns labels only from rows that are not held out. The sample,
    its terms and their counts pass the driver: all bounded by sample_rows."""
    spark = docs.sparkSession
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), None, (1.0, 1.0), np.zeros(0), np.zeros(0), 0.0, 0.0, neighbours)
    if len(totals) < 2:
        return nothing
    # of some three times as many rows as are wanted, those with the smallest hashes
    picked = [first_share(known.where(F.col("toxic") == c), 3 * sample_rows / totals[c]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for c in (0, 1)]
    # at most 2 * sample_rows identifiers, so they go to every task and no other text is shuffled
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    # exact copies would make their rare words look telling
    rows = written(rows.groupBy("toxic", "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic", "text"), "examples")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return nothing
    n0, n1, rate = sizes[0], sizes[1], totals[1] / (totals[0] + totals[1])
    by_term = rows.select("toxic", "text").mapInArrow(_count_terms, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").cast("double").alias("a"), F.sum("toxic").cast("double").alias("b"))
    terms = collected(by_term)
    known = terms["term"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, a, b = known[order], terms["a"].to_numpy()[order] + SMOOTHING, terms["b"].to_numpy()[order] + SMOOTHING
    association = np.maximum(np.abs(np.log(b / (n1 + 2 * SMOOTHING) * (n0 + 2 * SMOOTHING) / a)), LEAST_ASSOCIATION)
    sent = spark.sparkContext.broadcast(known)
    spread = collected(docs.select("text").mapInArrow(_count_documents(sent), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")))
    times = np.zeros(len(known) + 1)  # the last one counts all documents
    times[spread["term"].to_numpy()] = spread["n"].to_numpy()
    term_weights = (np.log((1 + times[-1]) / (1 + times[:-1])) + 1) * association
    found = collected(rows.mapInArrow(_example_terms(sent), "doc_id long, toxic int, terms array<int>, counts array<int>")).sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    sent.destroy()
    weights = (totals[0] / n0, totals[1] / n1)
    examples, bare = [], []
    for doc_id, toxic, held_terms, counts in zip(*(found[c] for c in ("doc_id", "toxic", "terms", "counts")), strict=True):
        if len(held_terms):
            examples.append(Example(doc_id.as_py(), toxic.as_py(), *unit_vector(held_terms.values.to_numpy(), counts.values.to_numpy(), term_weights)))
        else:
            bare.append(toxic.as_py())
    without = sum(weights[1] for t in bare if t) / max(1e-9, sum(weights[t] for t in bare)) if bare else rate
    if not examples:
        return Model(known, term_weights, None, weights, np.zeros(0), np.zeros(0), without, rate, neighbours)
    model = Model(known, term_weights, BlockMaxIndex(examples, len(known)), weights, np.zeros(0), np.zeros(0), without, rate, neighbours)
    judge = spark.sparkContext.broadcast(model)
    votes = collected(rows.mapInArrow(_leave_one_out(judge), "vote double, toxic int")).sort_by([("vote", "ascending"), ("toxic", "ascending")])
    judge.destroy()
    marks = votes["toxic"].to_numpy()
    steps, values = isotonic(votes["vote"].to_numpy(), marks.astype(float), np.where(marks == 1, weights[1], weights[0])) if len(votes) else (np.zeros(1), np.full(1, without))
    return replace(model, steps=steps, values=values)


def _score(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("toxicity")
        model = sent.value
        for batch in batches:
            scores, evidence = [], []
            for _, texts in text_groups(text_of(batch), CHARS_AT_ONCE):
                for near in model.near_each(texts):
                    scores.append(model.calibrated(near))
                    evidence.append([{"doc_id": int(model.index.ids[i]), "similarity": s, "toxic": int(model.index.toxic[i])} for s, i in near[:3]])
            row = {"row": batch.column("row")} if "row" in batch.schema.names else {}
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(evidence, kind), *row.values()],
                ["doc_id", "held_out", "score", "predicted", "evidence", *row],
            )

    return run


def score(docs: DataFrame, model: Model, carry: bool = False) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence (up to three nearest examples); with carry also row, the
    document. One pass, no shuffle."""
    return given(docs, carry, held_out().alias("held_out")).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), with_row(SCORED, docs, carry))
