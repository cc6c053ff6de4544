"""Positional postings against a plain loop."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import postings


def test_numbers_are_packed_and_unpacked():
    rng = np.random.default_rng(1)
    numbers = np.concatenate([[0, 1, 127, 128, 16383, 16384, 2**31, 2**49 - 1, 2**49, 2**53 + 1, 2**56, 2**62, 2**63 - 1], rng.integers(0, 2**40, 500)])
    assert (postings.unpacked(postings.packed(numbers)).astype(np.int64) == numbers).all()
    assert len(postings.packed(np.array([127]))) == 1 and len(postings.packed(np.array([128]))) == 2 and len(postings.unpacked(b"")) == 0


def by_loop(texts, words):
    out = Counter()
    for key, text in texts:
        if key is not None and text is not None:
            w = re.findall(r"\w+", text.lower())
            out[key] += sum(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))
    return +out


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(8)
    return [(draw.randrange(-50, 4000), " ".join(draw.choices(["a", "b", "the", "Über", "x_1"], [9, 5, 9, 2, 1], k=draw.randint(0, 60)))) for _ in range(900)] + [(None, "a b"), (5, None), (6, ""), (7, "a b a b a b"), (7, "b a"), (2**62, "the über"), (-(2**62), "über a")]


@pytest.mark.parametrize("chars", [1 << 20, 3000])
def test_phrases_and_prefixes_like_a_loop(spark, texts, chars):
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("term", F.lit("x"))
    index = postings.postings(frame, "doc_id", "text", chars).persist()
    assert index.agg(F.max("documents")).first()[0] <= postings.BLOCK and (index.select("bucket").distinct().count() == 1) == (chars == 1 << 20)
    for words in (["a"], ["a", "b"], ["the", "über"], ["a", "b", "a", "b"], ["x_1", "the", "a"], ["a", "a", "a"], ["nothing", "a"]):
        got = {r.key: r.n for r in postings.phrase(index, " ".join(words)).collect()}
        assert got == by_loop(texts, words), words
    want = Counter()
    for key, text in texts:
        if key is not None and text:
            want[key] += sum(w.startswith("ü") for w in re.findall(r"\w+", text.lower()))
    assert {r.key: r.n for r in postings.prefix(index, "Ü").collect()} == +want
    with pytest.raises(ValueError, match="words"):
        postings.phrase(index, " ,")
    index.unpersist()


def test_postings_of_nothing(spark):
    index = postings.postings(spark.createDataFrame([(1, "")], "doc_id long, text string"), "doc_id", "text")
    assert index.count() == 0 and postings.phrase(index, "a").count() == 0


def test_blocks_packed_together_are_those_packed_alone():
    rng = np.random.default_rng(7)
    sizes = np.array([1, 128, 3, 1, 40])
    counts = rng.integers(1, 5, sizes.sum())
    keys = np.concatenate([np.sort(rng.choice(10**9, n, replace=False)) for n in sizes])
    positions = np.concatenate([np.sort(rng.choice(10**6, n, replace=False)) for n in counts])
    found = postings.blocks(keys, counts, positions, sizes).to_pylist()
    ends, places = np.cumsum(sizes), np.concatenate([[0], np.cumsum(counts)])
    for data, a, b in zip(found, ends - sizes, ends, strict=True):
        own = slice(places[a], places[b])
        assert data == postings.block(keys[a:b], counts[a:b], positions[own])
        k, p = postings.opened(data, int(keys[a]))
        assert k.tolist() == np.repeat(keys[a:b], counts[a:b]).tolist() and p.tolist() == positions[own].tolist()
    assert postings.blocks(*(np.zeros(0, np.int64),) * 4).to_pylist() == []
