"""Packing, sorted token shards, byte-level BPE and counts against the libraries."""

import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF
from helpers import docs_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioflow.llm import bpe, counts, packing, queries, sstable
from folioflow.llm.common import new_path, table
from folioflow.llm.tokenize import default_word_file, word_tokens

WORDS, RANKS = default_word_file(), public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(WORDS)
TEXTS = [
    None, "", " ", "Hello, hello WORLD.  it's   fine\n\nnow", "Héllo Ñandú! ½ 12,3", "a\x1cb\x85c d", "x <|endoftext|> y", "ΣΑΣ, İstanbul. ß ǅ", "中文 字。", "y" * 9000, "z " * 5000,
    "  two  spaces ", " \t x\n y ", "aaaa" * 700, "!!!???...   ", "don't DON'T stop's", "µ. ª, º! é, ﬁ. ", "Hello, hello WORLD.  it's   fine\n\nnow",
]
ROWS = [*((i * 3, t) for i, t in enumerate(TEXTS)), (None, "no id"), (6, "repeated id"), (6, "repeated id"), (-5, "negative")]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("text", TEXTS)
def test_word_tokens_are_the_library_s(text):
    assert np.frombuffer(word_tokens(WORDS).encode([text or ""])[0], "<u4").tolist() == ids_of(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aAbB zé.É,'s!0½\n\tßΣ中<|́"), max_size=40))
def test_any_text(text):
    assert np.frombuffer(word_tokens(WORDS).encode([text])[0], "<u4").tolist() == ids_of(text)
    coder = bpe.text_coder(RANKS, public_tokenizers.PATTERN)
    assert coder.encode(text) == TIKTOKEN.encode_ordinary(text) and coder.decode(coder.encode(text)) == text.encode()


TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_caches_of_any_size_give_the_same():
    small, texts = type(word_tokens(WORDS))(WORDS, limit=2), [t or "" for t in TEXTS]
    for _ in range(3):
        assert small.encode(texts) == word_tokens(WORDS).encode(texts)
    coder = bpe.TextCoder(RANKS, public_tokenizers.PATTERN, limit=2)
    for _ in range(2):
        assert [coder.encode(t) for t in texts] == [TIKTOKEN.encode_ordinary(t) for t in texts]


def test_the_cache_of_ids_is_bounded():
    for text in ("a{}  b{} ", "a{} b{}"):
        coder = bpe.TextCoder(RANKS, public_tokenizers.PATTERN, limit=10)
        for i in range(300):
            coder.encode(text.format(i, i))
        assert len(coder) <= 20 and len(coder.old) <= 20


def test_byte_bpe_of_documents(spark):
    got = bpe.code_documents(docs_of(spark, ROWS), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for d, t in ROWS:
        ids = TIKTOKEN.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.code_documents(docs_of(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_best_fit_of_items():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 500)
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sizes[b].sum() <= 100 for b in bins)
    assert len(bins) <= 1.03 * -(-sizes.sum() // 100)


@pytest.mark.parametrize("node_items", [3, 200_000])
def test_packing(spark, node_items):
    got = packing.pack_documents(docs_of(spark, ROWS).repartition(5), WORDS, 64, 0, node_items).collect()
    pieces = []
    for d, t in ROWS:
        ids = [*ids_of(t), 0]
        pieces += [(d, i, at, len(ids[at : at + 64]), crc(ids[at : at + 64])) for i, at in enumerate(range(0, len(ids), 64))]
    assert sorted(map(repr, pieces)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = [0, *(o + n for o, n in sorted(b))]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 64
    assert packing.pack_documents(docs_of(spark, []), WORDS).count() == 0


def test_packing_merges_what_partitions_leave(spark):
    rows = [(i, "word " * 19) for i in range(40)]
    got = packing.pack_documents(docs_of(spark, rows).repartition(20), WORDS, 60, 0)
    assert got.select("sequence_id").distinct().count() == 14  # three of twenty tokens in each


def test_shards_of_documents(spark):
    folder, shards = sstable.write_shards(docs_of(spark, ROWS), WORDS, end_id=1, shard_bytes=200)
    got = sstable.read_shards(spark, folder).collect()
    assert shards.count() > 1
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert [r.doc_id for r in got] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d or 0))
    assert sorted(repr((d, len(ids_of(t)) + 1, crc([*ids_of(t), 1]))) for d, t in ROWS) == sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    found = [(r.doc_id, r.ids) for r in sstable.lookup(spark, folder, [6, -5, 7]).collect()]
    assert [sorted(ids for d, ids in found if d == k) for k in (6, -5, 7)] == [sorted([*ids_of(t), 1] for d, t in ROWS if d == 6), [[*ids_of("negative"), 1]], []]


def test_no_documents_make_no_shards(spark):
    folder, shards = sstable.write_shards(docs_of(spark, []), WORDS)
    assert shards.count() == 0 and sstable.read_shards(spark, folder).count() == 0


def test_shard_file():
    out = io.BytesIO()
    writer = sstable.ShardWriter(out, block_bytes=64)
    keys = sorted([*range(-50, 50), 7, 7, 2**62, -(2**63)])
    for k in keys:
        writer.add(sstable.key_of(k), np.array([k % 1000] * 5, "<u4").tobytes())
    with pytest.raises(ValueError):
        writer.add(sstable.key_of(0), b"")
    size = writer.close()
    reader = sstable.ShardReader(out, size)
    assert [sstable.id_of(k) for k, _ in reader] == keys and len(reader.index) > 5
    assert len(reader.get(7)) == 3 and len(reader.get(2**62)) == 1 and reader.get(51) == []
    assert sum(reader.may_hold(sstable.key_of(k)) for k in range(1000, 2000)) < 60


def test_counts_come_once(spark):
    versions = {"w": counts.word_counter(WORDS), "b": counts.byte_counter(RANKS, public_tokenizers.PATTERN)}
    rows = [("s", "en", "one two"), ("s", "en", None), (None, "de", "drei vier"), ("t", None, "x" * 3000)]

    def events(some, action, old, new):
        return spark.createDataFrame([(*r, action, old, new) for r in some], "source string, lang string, text string, action string, old_version string, new_version string")

    rollup = counts.Rollup(spark, new_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    steps = [("1", rows, "insert", None, "w"), ("2", rows[:1], "delete", "w", None), ("3", rows[2:3], "revise", "w", "b"), ("4", [], "insert", None, "w")]
    for name, some, *how in [*steps, *steps]:
        rollup.commit(name, lambda some=some, how=how: counts.deltas(events(some, *how), versions))
    assert rollup.fold() and not rollup.commit("2", lambda: None) and rollup.fold()
    rollup.commit("5", lambda: counts.deltas(events(rows[:1], "insert", None, "w"), versions))
    rollup.commit("6", lambda: counts.deltas(events(rows[:1], "delete", "w", None), versions))
    assert len(rollup._parts()[1]) == 3
    got = {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert rollup.committed() == ["1", "2", "3", "4", "5", "6"]
    assert got == {("s", "en", "w"): (1, 0), (None, "de", "b"): (1, len(TIKTOKEN.encode_ordinary("drei vier"))), ("t", None, "w"): (1, len(ids_of("x" * 3000)))}


def test_op9_against_brute_force(spark):
    want = {}
    for r in table(spark, SF, "documents").collect():
        if r.source != queries.WITHDRAWN:
            version = queries.BYTES if r.lang == queries.RETOKENIZED else queries.WORDS
            n = len(TIKTOKEN.encode_ordinary(r.text or "") if version == queries.BYTES else ids_of(r.text))
            documents, tokens = want.get((r.source, r.lang, version), (0, 0))
            want[r.source, r.lang, version] = documents + 1, tokens + n
    assert {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in queries.op9_token_counts(spark, SF).collect()} == want


def test_op5_against_the_library(spark):
    start, want = 0, []
    for r in sorted(table(spark, SF, "documents").collect(), key=lambda r: r.doc_id):
        ids = [*ids_of(r.text), 1]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, queries.op5_sorted_token_shards(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want
