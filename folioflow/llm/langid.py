"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts: how often each byte followed each context of up to ORDER bytes,
over the UTF-8 bytes of lower-cased texts, across words and with digits and marks. A text begins after ORDER line feeds.
The statistics are frozen after training. The code length of a byte is found as in PPM with escape method C: in the
longest known context, either the byte's share, or the share of an escape and on with the next shorter context, at last 8
bits. A text's code length is the sum over all its bytes; the language of the shortest one is predicted. score is its
posterior probability under equal priors.

With frozen statistics the bits of a byte depend on the ORDER bytes before it only, so for each context and byte that any
language has seen the bits of all languages stand ready in one row; other bytes fall back order by order.

Trained on a bounded sample: at most SAMPLE_ROWS labelled texts of each language, TOTAL_ROWS in all, those whose doc_ids
have the smallest hashes. Texts are learned and scored whole, whatever their length.

Null text, or text without letters (of Unicode's categories L; superscripts and circled digits are none): `und` with score 0, and so is everything if there is nothing to learn from. A null
doc_id is never held out and never learned from. Ties go to the first language in order. Each repeated row gets a row;
empty tables give none; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.llm.common import collected, first_share, given, held_out, let_go, text_groups, text_of, with_row

ORDER, SAMPLE_ROWS, TOTAL_ROWS = 4, 1500, 60_000
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
UNKNOWN = "und"
#: Bytes that are costed at once.
BYTES = 1 << 17
#: Letters, and a few numbers such as superscripts, fractions and circled digits.
_LIKE_LETTER = re.compile(r"[^\W\d_]")
_BEFORE = b"\n" * ORDER
_U8 = np.uint64(8)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LIKE_LETTER.finditer(text))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(for each byte of the texts in turn, it and the ORDER bytes before it as one number; bytes of each text)."""
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    stream = np.frombuffer(b"".join(_BEFORE + c for c in coded), np.uint8).astype(np.uint64)
    whole = stream.copy()
    for i in range(1, ORDER + 1):
        whole[i:] |= stream[:-i] << np.uint64(8 * i)
    real = np.arange(int(sizes.sum())) + np.repeat(ORDER * np.arange(1, len(texts) + 1), sizes)
    return whole[real], sizes


@dataclass(frozen=True)
class ContextTrees:
    """By order: known contexts with the bits of an escape, and contexts followed by a byte with the bits of that byte from
    this order down; a column for each language."""

    langs: tuple[str, ...]
    contexts: tuple[np.ndarray, ...]
    escapes: tuple[np.ndarray, ...]
    symbols: tuple[np.ndarray, ...]
    bits: tuple[np.ndarray, ...]

    @staticmethod
    def trained(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> ContextTrees:
        """counts: by language, grams() and how often each occurs."""
        langs = tuple(sorted(counts))
        trees = ContextTrees(langs, (), (), (), ())
        for order in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            keys = [counts[lang][0] & mask for lang in langs]
            symbols = np.unique(np.concatenate([np.empty(0, np.uint64), *keys]))
            contexts, at = np.unique(symbols >> _U8, return_inverse=True)
            escapes = np.zeros((len(contexts), len(langs)))
            bits = trees.costs(symbols, order - 1)
            for i, lang in enumerate(langs):
                n = np.bincount(np.searchsorted(symbols, keys[i]), counts[lang][1], len(symbols))
                total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, n > 0, len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escapes[:, i] = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                    bits[:, i] = np.where(n > 0, np.log2((total + kinds)[at] / n), escapes[at, i] + bits[:, i])
            trees = ContextTrees(langs, (*trees.contexts, contexts), (*trees.escapes, escapes), (*trees.symbols, symbols), (*trees.bits, bits))
        return trees

    def costs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each key (a row) in each language (a column), from contexts of that order down."""
        if order < 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        keys = keys & np.uint64((1 << 8 * (order + 1)) - 1)
        at = np.minimum(np.searchsorted(self.symbols[order], keys), len(self.symbols[order]) - 1)
        out = self.bits[order][at]
        new = np.flatnonzero(self.symbols[order][at] != keys)
        if len(new):
            context = keys[new] >> _U8
            at = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
            escape = self.escapes[order][at]
            escape[self.contexts[order][at] != context] = 0
            out[new] = escape + self.costs(keys[new], order - 1)
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text (a row) in each language (a column)."""
        keys, sizes = grams(texts)
        which = np.repeat(np.arange(len(texts)), sizes)
        total = np.zeros((len(texts), len(self.langs)))
        for at in range(0, len(keys), BYTES):
            bits, of = self.costs(keys[at : at + BYTES]), which[at : at + BYTES]
            for i in range(len(self.langs)):
                total[:, i] += np.bincount(of, bits[:, i], len(texts))
        return total


def _predict(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("languages")
        trees = sent.value
        for batch in batches:
            langs, scores = [], []
            for _, texts in text_groups(text_of(batch)):
                if not trees.langs:
                    langs += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                bits = trees.code_lengths(texts)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                some = [has_letter(t) for t in texts]
                langs += [trees.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some, strict=True)]
                scores += np.where(some, share, 0.0).tolist()
            row = {"row": batch.column("row")} if "row" in batch.schema.names else {}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *row.values()],
                ["doc_id", "held_out", "lang_pred", "score", *row],
            )

    return run


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go("languages")
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, texts in text_groups(batch.column(1)):
            keys, sizes = grams(texts)
            which = np.repeat(np.array(langs[first : first + len(texts)]), sizes)
            for lang in sorted(set(which.tolist())):
                found, n = np.unique(keys[which == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, total_rows: int = TOTAL_ROWS) -> ContextTrees:
    """Context trees of the languages in docs (doc_id, text, lang) that are not held out. Counts of the sample's contexts
    pass the driver, bounded by the sample."""
    labelled = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    totals = labelled.groupBy("lang").count()
    each = F.least(F.lit(sample_rows), F.ceil(F.lit(total_rows) / F.count("*").over(W.partitionBy())))  # a row for each language
    shares = F.broadcast(totals.select("lang", each.alias("_most"), (3 * each / F.col("count")).alias("_share")))
    # of some three times as many rows as are wanted, those with the smallest hashes; ranked without the texts
    near = first_share(labelled.select("doc_id", "lang").join(shares, "lang"), F.col("_share"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("_most")).select("doc_id", "lang").distinct()
    rows = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    counts = collected(rows.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    by = {}
    for lang in pc.unique(counts["lang"]).to_pylist():
        own = counts.filter(pc.equal(counts["lang"], lang))
        by[lang] = (own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy())
    return ContextTrees.trained(by)


def identify(docs: DataFrame, trees: ContextTrees, carry: bool = False) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; with carry also row, the document. One pass, no shuffle."""
    return given(docs, carry, held_out().alias("held_out")).mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(trees)), with_row(PREDICTED, docs, carry))
