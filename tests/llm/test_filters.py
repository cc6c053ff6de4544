"""Toxicity, language, repetition, compaction and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from helpers import docs_of
from pyspark.sql import functions as F

from folioflow.llm import compaction, langid, quality, queries, toxicity
from folioflow.llm.common import held_out, new_path, table


def brute_trees(texts):
    """By context, how often each byte followed it."""
    times = defaultdict(Counter)
    for text in texts:
        s = b"\n" * langid.ORDER + text.lower().encode()
        for i in range(langid.ORDER, len(s)):
            for o in range(langid.ORDER + 1):
                times[s[i - o : i]][s[i]] += 1
    return times


def brute_code_length(text, times):
    s, bits = b"\n" * langid.ORDER + text.lower().encode(), 0.0
    for i in range(langid.ORDER, len(s)):
        for o in range(langid.ORDER, -1, -1):
            if c := times.get(s[i - o : i]):
                total = sum(c.values()) + len(c)
                if s[i] in c:
                    bits += math.log2(total / c[s[i]])
                    break
                bits += math.log2(total / len(c))
        else:
            bits += 8
    return bits


def test_code_lengths(monkeypatch):
    monkeypatch.setattr(langid, "BYTES", 7)
    own = {"en": ["the then the", "a", "The 12."], "de": ["der die der", ""], "xx": ["é"]}
    counts = {}
    for lang, texts in own.items():
        keys, n = np.unique(langid.grams(texts)[0], return_counts=True)
        counts[lang] = (keys, n)
    trees = langid.ContextTrees.trained(counts)
    texts = ["the", "there  the\n12", "", "d", "éa", "qqqqqqq", "a"]
    want = [[brute_code_length(t, brute_trees(own[lang])) for lang in trees.langs] for t in texts]
    assert np.allclose(trees.code_lengths(texts), want)


def test_op8_against_a_brute_force_coder(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    by = defaultdict(list)
    for r in docs.values():
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None:
            by[r.lang].append(r.text or "")
    trees = {lang: brute_trees(texts) for lang, texts in sorted(by.items())}
    got = queries.op8_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        text = docs[r.doc_id].text or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id % 5 == 0 and len(text) < 3000:
            bits = {lang: brute_code_length(text, t) for lang, t in trees.items()}
            best = min(bits, key=bits.get)
            want = (best, 1 / sum(2.0 ** max(bits[best] - b, -1000) for b in bits.values())) if any(map(str.isalpha, text)) else ("und", 0.0)
            assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-6


def test_a_language_of_long_texts_is_learned(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(LANGS[lang].split(), k=20 if lang == "en" else 9000)), lang) for i in range(40) for lang in [("en", "de")[i % 2]]]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()}
    assert got == {i: lang for i, _, lang in rows}
    assert langid.train(docs, sample_rows=2, total_rows=2).langs == ("de", "en")


LANGS = {"en": "the of and to in that it is was for", "de": "der die und in den von zu das mit sich", "fr": "le de un et la les des en que est"}


def language_rows(rng, n=300):
    return [(i, " ".join(rng.choices(LANGS[lang].split(), k=30)).capitalize() + ".", lang) for i in range(n) for lang in [rng.choice(sorted(LANGS))]]


def test_languages(spark):
    rows = language_rows(random.Random(0))
    odd = [(900, None, "en"), (901, "", "en"), (902, "123 !?", "en"), (903, "the " * 40_000, None), (None, "und der die", "de"), (905, "x" * 30_000, "en"), (5, rows[5][1], "en")]
    docs = docs_of(spark, rows + odd)
    got = langid.identify(docs, langid.train(docs), carry=True).join(docs.groupBy("doc_id").count(), "doc_id", "left").collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth and r.doc_id != 5)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"] and by[None].lang_pred == "de" and by[900].score == 0
    assert by[3].row.text == rows[3][1]
    nothing = docs_of(spark, [])
    assert langid.identify(nothing, langid.train(nothing)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(nothing)).collect()} == {"und"}


def test_language_accuracy_on_held_out_rows(spark):
    got = queries.op8_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


def toxic_rows(rng, n=600):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vile", "rotten,", "Wretched", "wretchedness"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows(random.Random(1))
    odd = [(9000, None), (9001, ""), (9002, "vile " * 30_000), (None, "rotten vile wretched"), (7, rows[7][1])]
    docs = docs_of(spark, rows + odd)
    known = spark.createDataFrame([*labels, (0, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    got = toxicity.score(docs, model, carry=True).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    right = [by[i].predicted == toxic for i, _, toxic in labels if by[i].held_out]
    assert len(right) > 100 and sum(right) >= 0.99 * len(right)
    assert [by[i].predicted for i in (9000, 9001, 9002, None)] == [0, 0, 1, 1] and len(by[9002].evidence) == 3
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, known.limit(0))).collect()} == {0.0}
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def test_toxicity_indexes_all_terms(spark):
    rows, labels = toxic_rows(random.Random(3), 120)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    learned = [text for i, text in rows if not got[i].held_out]
    terms = sorted({t for text in learned for t in toxicity.terms_of(text)})
    assert model.known.tolist() == sorted(toxicity.hashes(terms).tolist())
    scores = [[got[i].score for i, _, toxic in labels if got[i].held_out and toxic == c] for c in (0, 1)]
    assert np.mean(scores[1]) > np.mean(scores[0]) + 0.5


def test_few_labels_are_enough_to_tell_apart(spark):
    rows = [(i, f"{'vile' if i % 2 else 'kind'} word{i % 7} other{i % 5}") for i in range(120)]
    labels = [(i, 1, i % 2) for i in range(40)]
    docs = docs_of(spark, rows)
    got = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in got)


def test_op2_against_brute_force(spark):
    """Cosines over all words of whole texts, votes and calibration, document by document."""
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    marks = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.toxic is not None}
    words = {i: Counter(re.findall(r"[^\W\d_]+", t.lower())) for i, t in texts.items()}
    firsts = {}
    for i in sorted(marks):
        firsts.setdefault((marks[i], texts[i]), i)
    sample = sorted(i for i in firsts.values() if words[i])
    n = [sum(1 for i in firsts.values() if marks[i] == c) for c in (0, 1)]
    counts = [Counter(t for i in sample if marks[i] == c for t in words[i]) for c in (0, 1)]
    spread, s = Counter(t for w in words.values() for t in w), toxicity.SMOOTHING
    weight = {
        t: (math.log((1 + len(texts)) / (1 + spread[t])) + 1) * max(abs(math.log((counts[1][t] + s) / (n[1] + 2 * s) * (n[0] + 2 * s) / (counts[0][t] + s))), toxicity.LEAST_ASSOCIATION)
        for t in counts[0].keys() | counts[1].keys()
    }

    def vector(c):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in c.items() if t in weight}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    vectors = {i: vector(words[i]) for i in texts}
    total = [sum(1 for m in marks.values() if m == c) for c in (0, 1)]
    rate, share = total[1] / sum(total), [total[c] / n[c] for c in (0, 1)]

    def near(v, without=None):
        sims = ((round(sum(x * vectors[j].get(t, 0.0) for t, x in v.items()), 12), j) for j in sample if j != without)
        return sorted((-x, j) for x, j in sims if x > 0)[: toxicity.NEIGHBOURS]

    def vote(found):
        w = [(-x * share[marks[j]], marks[j]) for x, j in found]
        return (sum(x for x, m in w if m) + toxicity.PRIOR * rate) / (sum(x for x, _ in w) + toxicity.PRIOR)

    left = sorted((vote(f), marks[i]) for i in sample if (f := near(vectors[i], i)))
    steps, values = toxicity.isotonic(np.array([x for x, _ in left]), np.array([float(m) for _, m in left]), np.array([share[m] for _, m in left]))
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, SF).collect()}
    assert sorted(got) == sorted(texts)
    for i, r in got.items():
        found = near(vectors[i])
        assert [(e.doc_id, e.toxic) for e in r.evidence] == [(j, marks[j]) for _, j in found[:3]]
        assert np.allclose([e.similarity for e in r.evidence], [-x for x, _ in found[:3]])
        at = vote(found) if found else 0.0
        if found and min(abs(steps - at)) > 1e-9:
            assert abs(r.score - values[max(0, np.searchsorted(steps, at, "right") - 1)]) < 1e-9 and r.predicted == int(r.score >= 0.7)


def test_held_out_labels_are_not_learned(spark):
    rows, labels = toxic_rows(random.Random(2), 200)
    docs = docs_of(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = known.withColumn("toxic", F.when(held_out(), 1 - known.toxic).otherwise(known.toxic))
    scores = [sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, x)).select("doc_id", "score").collect())) for x in (known, flipped)]
    assert scores[0] == scores[1]


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    idf = rng.uniform(1, 5, 40)
    examples = []
    for i in range(500):
        counts = {int(t): int(rng.integers(1, 4)) for t in rng.integers(0, 40, rng.integers(1, 7))}
        terms = np.array(sorted(counts))
        examples.append(toxicity.Example(i, i % 2, *toxicity.unit_vector(terms, np.array([counts[t] for t in terms.tolist()]), idf)))
    index = toxicity.BlockMaxIndex(examples, 40, block=16)
    dense = np.zeros((500, 40))
    for e in examples:
        dense[e.doc_id, e.terms] = e.weights
    for e in examples[:60]:
        scores = dense @ dense[e.doc_id]
        scores[e.doc_id] = -1
        want = sorted(((-round(float(s), 12), i) for i, s in enumerate(scores) if s > 0))[:10]
        assert [(-s, int(index.ids[x])) for s, x in index.nearest(e.terms, e.weights, 10, without=e.doc_id)] == want


class Read(list):
    """A list that counts how often its items are read."""

    reads = 0

    def __getitem__(self, i):
        self.reads += 1
        return super().__getitem__(i)


def test_queries_go_through_blocks_together():
    rng = np.random.default_rng(5)
    idf = rng.uniform(1, 5, 60)
    examples = []
    for i in range(400):
        terms = np.unique(np.where(rng.random(6) < 0.5, rng.integers(0, 8, 6), rng.integers(0, 60, 6)))
        examples.append(toxicity.Example(i // 2, i % 2, *toxicity.unit_vector(terms, rng.integers(1, 4, len(terms)), idf)))
    index = toxicity.BlockMaxIndex(examples, 60, block=16)
    assert 0 < index.maxima.shape[0] < 60
    dense = np.zeros((400, 60))
    for i, e in enumerate(examples):
        dense[i, e.terms] = e.weights
    queries = [(e.terms, e.weights) for e in examples[:150]]
    without = [e.doc_id if i % 3 else None for i, e in enumerate(examples[:150])]
    index.common = Read(index.common)
    got = index.nearest_each(queries, 10, without)
    rounds = -(-len(queries) // toxicity.QUERIES_AT_ONCE)
    assert 0 < index.common.reads <= rounds * index.n_blocks
    for (terms, weights), left, found in zip(queries, without, got, strict=True):
        scores = dense[:, terms] @ weights
        want = sorted((-round(float(s), 12), e.doc_id) for s, e in zip(scores, examples, strict=True) if s > 0 and e.doc_id != left)[:10]
        assert [(-s, int(index.ids[i])) for s, i in found] == want
        assert found == index.nearest(terms, weights, 10, left)
    assert index.nearest_each([], 10) == []


def test_terms_of_several_texts_are_looked_up_once(monkeypatch):
    looked_up, hashes = [], toxicity.hashes
    known = np.sort(hashes(["kind", "vile", "wort"]))
    monkeypatch.setattr(toxicity, "hashes", lambda terms: looked_up.extend(terms) or hashes(terms))
    got = [dict(zip(known[at].tolist(), n.tolist(), strict=True)) for at, n in toxicity.counted_each(["Vile, vile kind", "", "vile other", "other 12"], known)]
    vile, kind = hashes(["vile", "kind"]).tolist()
    assert got == [{vile: 2, kind: 1}, {}, {vile: 1}, {}]
    assert sorted(looked_up) == ["kind", "other", "vile"]


def test_term_counts_are_those_of_the_terms():
    marks = "".join(map(chr, range(256)))
    texts = [None, "", "a_b A.b 1a2 x\u00b2y \u00bd", "na\u00efve\u00a0STRASSE stra\u00dfe\x85\u00aa\u00b5", marks, " ".join(marks), "\u0130stanbul \u039f\u0394\u039f\u03a3 \u039f\u03a3.", "\u201cvile\u201d \u2014 don\u2019t", "\u4f60\u597d\uff0c\u4e16\u754c \U0001f600x"]
    for text in texts:
        assert toxicity.term_counts(text) == Counter(toxicity.terms_of(text))


def test_isotonic_fit_rises():
    rng = np.random.default_rng(0)
    x = rng.random(400)
    steps, values = toxicity.isotonic(x, (rng.random(400) < x).astype(float), np.ones(400))
    assert (np.diff(steps) > 0).all() and (np.diff(values) >= 0).all() and 0 < values[0] < values[-1] < 1


def brute_repeats(words, least):
    n, longest, covered = len(words), 0, set()
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                covered |= set(range(i, i + k)) | set(range(j, j + k))
    return longest, covered


def brute_intervals(words, least):
    """(length, starts) of passages that no longer one with the same starts holds."""
    starts, found = defaultdict(set), {}
    for k in range(least, len(words)):
        for i in range(len(words) - k + 1):
            starts[tuple(words[i : i + k])].add(i)
    for passage, at in starts.items():
        if len(at) > 1:
            found[tuple(sorted(at))] = max(len(passage), found.get(tuple(sorted(at)), 0))
    return {(k, at) for at, k in found.items()}


def test_repeats():
    rng = random.Random(0)
    for _ in range(200):
        words = np.array([rng.randrange(rng.choice([1, 2, 4, 30])) for _ in range(rng.randrange(50))])
        least = rng.randrange(1, 6)
        longest, mask, passages = quality.repeats(words, least)
        assert (longest, set(np.flatnonzero(mask).tolist())) == brute_repeats(words.tolist(), least)
        order, common = quality.suffix_array(words)
        intervals = quality.lcp_intervals(common, least)
        found = {(length, tuple(sorted(order[left:right].tolist()))) for length, left, right in intervals}
        assert len(found) == passages == len(intervals) and found == brute_intervals(words.tolist(), least)


def brute_base(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeat = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat), len(words) < 10 or 100 * len(repeat) > 20 * len(words)


def test_repetition_rules(spark):
    rng = random.Random(1)
    clean = " ".join(f"w{i}" for i in range(400))
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [None, "", "a b", clean, clean + "\n" + clean, f"{clean} {passage} {clean.upper()} {passage} {' '.join(f'z{i}' for i in range(200))}", "x\n\nx\n \nx # $", "é ñ b\x1cc " * 3, "ab " * 20_000]
    texts += ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(12)) for _ in range(40)]
    got = {r.doc_id: r for r in quality.repetition_rules(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t)
        assert tuple(got[i])[1:7] == base, t
        if base[0] < 2000:
            longest, covered = brute_repeats((t or "").encode().split(), 8)
            assert tuple(got[i])[7:9] == (longest, len(covered)), t
            assert got[i].kept == (not base[5] and len(covered) <= 0.2 * base[0] and longest <= 60), t
    assert got[3].kept and not got[4].kept and got[5].longest_repeat >= 70 and not got[5].base_failed and not got[5].kept
    assert quality.repetition_rules(docs_of(spark, [])).count() == 0


def test_long_words_repeat(spark):
    word = "http://" + "u" * 300
    clean = " ".join(f"w{i}" for i in range(400))
    passage = " ".join(f"{word}{i} p{i}" for i in range(35))
    texts = [" ".join([word] * 20), " ".join(f"{word}{i}" for i in range(20)), ("語" * 86 + " ") * 12, f"{clean} {passage} {clean.upper()} {passage}", " ".join([word] * 20)]
    got = {r.doc_id: r for r in quality.repetition_rules(docs_of(spark, list(enumerate(texts))).coalesce(1)).collect()}
    for i, t in enumerate(texts):
        words = t.split()
        longest, covered = brute_repeats(words, 8)
        assert tuple(got[i])[1:9] == (*brute_base(t), longest, len(covered)), t
    assert got[0].n_repeat_words == 20 and not got[0].kept and got[1].kept and got[3].longest_repeat == 70


@pytest.mark.parametrize("text", ["²", "½ ½", "①", "123 _ !", "\u0301"])
def test_what_is_no_letter(text):
    assert not langid.has_letter(text)


@pytest.mark.parametrize("text", ["①a", "ª", "ǅ", "中", "½ é"])
def test_what_is_a_letter(text):
    assert langid.has_letter(text)


def test_compaction(spark):
    shards = compaction.ShardedTable(spark, new_path(spark, "shards"), target_bytes=20_000, fanout=3)
    rows = [(i, None if i % 7 == 0 else "text " * (i % 50), None if i % 5 == 0 else "en") for i in range(400)] + [(3, "again"), (3, "again")]
    docs = docs_of(spark, rows).repartition(6)
    assert shards.versions() == []
    shards.append_each(docs.where("doc_id < 300"), docs.doc_id % 4)
    shards.append(docs.where("doc_id >= 300"), "late")
    shards.append(docs.limit(0), "empty")
    before = len(shards.manifest())
    old = shards.versions()[-1]
    key = lambda df: sorted(map(repr, map(tuple, df.select(*docs.columns).collect())))
    shards.compact()
    assert len(shards.manifest()) < before / 3 and key(shards.read()) == key(docs) == key(shards.read(old))
    assert sum(s.rows for s in shards.manifest()) == docs.count()
    with pytest.raises(RuntimeError):
        shards._commit(old, [], docs.schema)
    assert shards.versions()[:6] == [1, 2, 3, 4, 5, 6]  # four arrivals, one late, one empty
    shards.vacuum()
    assert len(shards.versions()) == 1 and key(shards.read(shard_column="shard")) == key(docs)
    assert {r.shard for r in shards.read(shard_column="shard").collect()} == {s.shard for s in shards.manifest()}
    assert shards.compact() == shards.versions()[-1]
    with pytest.raises(ValueError):
        shards.read(shard_column="Score")


def test_compaction_keeps_all_columns(spark):
    shards = compaction.ShardedTable(spark, new_path(spark, "shards"), fanout=2)
    with pytest.raises(ValueError):
        shards.read()
    odd = "doc_id long, text string, _arrival string, _metadata int, shard string, `a.b` string"
    shards.append(spark.createDataFrame([(1, "a", "mine", 7, "s", "dot")], odd), "one")
    shards.append(spark.createDataFrame([(2, "b")], "doc_id long, text string"), "two")
    shards.append_each(spark.createDataFrame([(3, "x/ y", "theirs")], "doc_id long, text string, _arrival string"), F.lit("day = 1/2"))
    with pytest.raises(ValueError):
        shards.append(spark.createDataFrame([("4",)], "doc_id string"), "other type")
    assert {s.arrival for s in shards.manifest()} == {"one", "two", "day = 1/2"}
    want = [(1, "a", "mine", 7, "s", "dot"), (2, "b", *[None] * 4), (3, "x/ y", "theirs", *[None] * 3)]
    for step in (lambda: None, shards.compact, shards.vacuum):
        step()
        assert sorted(map(tuple, shards.read().collect())) == want and "a.b" in shards.read().columns
    assert len(shards.manifest()) == 1


def test_compaction_of_names_that_differ_by_case(spark):
    shards = compaction.ShardedTable(spark, new_path(spark, "shards"), fanout=2)
    shards.append(spark.createDataFrame([(1, "a")], "doc_id long, Text string"), "1")
    shards.append(spark.createDataFrame([(2, "b")], "doc_id long, text string"), "2")
    shards.append_each(spark.createDataFrame([(3, "c"), (4, "d")], "DOC_ID long, tEXT string"), F.concat(F.lit("3"), F.col("text")))
    read = shards.read()
    assert read.columns == ["doc_id", "Text"] and {tuple(r) for r in read.collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}
    with pytest.raises(ValueError, match="cannot become"):
        shards.append(spark.createDataFrame([(2, 3)], "doc_id long, TEXT long"), "4")
    with pytest.raises(ValueError, match="more than one"):
        shards.append(spark.createDataFrame([(2, "b", "c")], "doc_id long, text string, TEXT string"), "4")
    shards.compact()
    assert shards.read().count() == 4


def test_compaction_of_nothing(spark):
    shards = compaction.ShardedTable(spark, new_path(spark, "shards"))
    shards.append(docs_of(spark, []), "empty")
    shards.append_each(docs_of(spark, []), F.lit("none"))
    assert shards.compact() == 2 and shards.read().count() == 0 and shards.read().columns == docs_of(spark, []).columns
    left = spark.createDataFrame([(1,)], "x int")
    left.write.parquet(f"{shards.folder}/shards/failed")
    assert shards.vacuum() == 0 and shards.vacuum(orphan_seconds=-5) == 3  # the failed write and two folders without rows


def test_op6_has_every_row(spark):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = sorted(map(tuple, duck.sql(queries.OP6_SQL).fetchall()))
    assert sorted(map(tuple, queries.op6_compacted_shards(spark, SF).collect())) == want


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "test")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] > counts[3] > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "packing"]
    assert corpus_pipeline.run(spark, SF).count() == counts[4]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_rows(random.Random(8), 150)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, None), (None, rows[1][1]), (900, ""), (901, "12 34"), (2, rows[2][1]), (2, rows[2][1]), (902, rows[2][1].upper()), (903, "abc de " * 30_000)]
    schema = "doc_id long, text string, lang string, lang_pred string, `a.b` int, row string, score double, held_out boolean, kept boolean, _doc_id long, gone boolean"
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, "x", 1, "r", 0.5, True, False, 3, True) for i, t in rows + odd], schema)
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        found = sorted(map(repr, ((r.doc_id, r.text) for r in got.collect())))
        if name == "language":
            assert found == sorted(map(repr, (r for r in rows + odd if r not in [(None, None), (900, ""), (901, "12 34")])))
            assert {r.lang for r in got.collect()} == {"en"}
        if name == "near_duplicates":
            assert found == sorted(map(repr, [*rows, *(r for r in odd if r[0] not in (2, 902))]))
        if name == "toxicity":
            assert 120 <= len(found) <= len(rows) + len(odd) - 20
    packed = corpus_pipeline.packed(spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in rows + odd})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
