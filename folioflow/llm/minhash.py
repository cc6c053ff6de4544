"""Near-duplicate documents by odd sketches of MinHash samples.

1. One pass over the texts: per document its set of word shingles (64-bit hashes), SAMPLES MinHash values, keys of BANDS
   bands of them, and an odd sketch: a bitmap of SKETCH_BITS parities of the hashed samples. The XOR of two sketches has
   about as many set bits as samples differ (twice), so its population count estimates high similarities closely.
2. Documents of equal sets are one class, with a number of its own; only classes go on.
3. Classes that share a band key are candidates. Each bucket is first held against its smallest member only; pairs whose
   sketches are too far apart are dropped (FIVE_SIGMA below the threshold); of the rest the best of each document is
   confirmed on full sets, then those that still join different components.
4. Buckets that still hold several components make up families, which are cut into blocks of bounded size; within a block
   and between two, pairs of different components whose sketches are close are confirmed on full sets, and a spanning
   forest of the links leaves the task. So no candidate pair that could change a component is skipped, groups of near
   copies mostly cost one comparison for each document, and pairs are never listed.

The bands miss a pair at the threshold with probability (1 - 0.8**6)**48 < 5e-7. Band keys, classes and families that hold
more than a ten-thousandth of all rows are joined by broadcast, so none of them makes a hot task.

Null or empty text, or text without words: an empty set, linked with nothing, its own component, kept. Fewer words than
a shingle has: the whole sequence is the one shingle. A null doc_id: component null, kept, linked with nothing. Rows that
repeat a doc_id each get a row, by their own text: one with another text is another node, and its links are its own. Empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import WordCache, carried, dropped, held, joined_to_groups, text_groups, written
from folioflow.llm.components import components, forest

BANDS, BAND_ROWS, SKETCH_BITS = 48, 6, 1024
SAMPLES = BANDS * BAND_ROWS
#: Documents and shingles of a block, of which two are held against each other at a time.
BLOCK_ROWS, BLOCK_KEYS = 500, 500_000
#: Class identifiers up to this number are sent to all executors (24 bytes each with what finds their text); beyond it the
#: joins shuffle.
BROADCAST_IDS = 1_000_000
SIGNED = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sketch array<long>"
_U64 = np.uint64


class WordHashes(WordCache):
    def __init__(self):
        super().__init__(50_000)

    def compute(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


def _word_hashes() -> WordHashes:
    return held("minhash", "words", WordHashes)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    hashes = _word_hashes()
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, _U64)
    h = np.fromiter(map(hashes.__getitem__, words), _U64, len(words))
    n = min(width, len(words))
    with np.errstate(over="ignore"):
        key = h[: len(h) - n + 1] + _U64(n)
        for i in range(1, n):
            key = _mixed(key) + h[i : len(h) - n + 1 + i]
        return np.unique(_mixed(key))


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20240229)
    draw = lambda: rng.integers(0, 1 << 32, (SAMPLES, 1), np.uint32)
    return draw() | np.uint32(1), draw(), draw() | np.uint32(1), draw(), rng.integers(0, 1 << 63, (BANDS, BAND_ROWS)).astype(_U64) | _U64(1)


def samples(keys: np.ndarray) -> np.ndarray:
    a, b, *_ = _constants()
    x = ((keys >> _U64(32)) ^ keys).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[None, at : at + 1024] * a + b).min(axis=1), out=least)
    return least


def band_keys(sample: np.ndarray) -> np.ndarray:
    weights = _constants()[4]
    with np.errstate(over="ignore"):
        return _mixed((sample.reshape(BANDS, BAND_ROWS).astype(_U64) * weights).sum(axis=1, dtype=_U64) + np.arange(BANDS, dtype=_U64)).view(np.int64)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    _, _, c, d, _ = _constants()
    at = ((sample[:, None] * c + d) >> np.uint32(32 - (SKETCH_BITS.bit_length() - 1)))[:, 0]
    odd = np.bincount(at, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def farthest(threshold: float, sigmas: float = 5.0) -> int:
    """Set bits in the XOR of two sketches that a pair at the threshold stays below, but for sigmas deviations."""
    differ = SAMPLES * (1 - threshold) + sigmas * sqrt(SAMPLES * threshold * (1 - threshold) + SAMPLES * (1 - threshold) / 8)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ))) + 1


def estimate(bits: int) -> float:
    """Similarity of two sets whose sketches differ in so many bits."""
    share = min(2 * bits / SKETCH_BITS, 0.999999)
    return 1 - log(1 - share) / (2 * log(1 - 2 / SKETCH_BITS)) / SAMPLES


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for _, texts in text_groups(batch.column(2)):
                _word_hashes().rotate()
                for text in texts:
                    keys = shingles(text, width)
                    sizes.append(len(keys))
                    if len(keys):
                        sample = samples(keys)
                        digests.append(xxhash.xxh3_128_digest(keys.tobytes()))
                        bands.append(band_keys(sample))
                        sketches.append(odd_sketch(sample))
                    else:
                        digests.append(None)
                        bands.append(None)
                        sketches.append(None)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = (pa.array(c, k) for c, k in zip((sizes, digests, bands, sketches), kinds, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "n_shingles", "digest", "bands", "sketch"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_groups(batch.column(1)):
                _word_hashes().rotate()
                found = [shingles(t, width).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(found, pa.list_(pa.int64()))], ["id", "keys"])

    return run


def bits_apart(a: Column | str, b: Column | str) -> Column:
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("b"), F.col("keys").alias("kb"))
    two = sets.select(F.col("id").alias("a"), F.col("keys").alias("ka"))
    common = F.size(F.array_intersect("ka", "kb")).cast("long")
    both = pairs.join(one, "b").join(two, "a").select("a", "b", common.alias("common"), (F.size("ka") + F.size("kb") - common).alias("all"))
    return both.where(100 * F.col("common") >= percent * F.col("all")).select("a", "b")


def _between(percent: int, limit: int):
    """Links between components within a block, or between two blocks; as a spanning forest in place of all pairs."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, group, block = (table[c].to_numpy() for c in ("id", "c", "block"))
        sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(_U64).reshape(len(ids), -1)
        lists = table["keys"].combine_chunks()
        sizes = np.asarray(lists.value_lengths())
        tokens = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        two = block.min() != block.max()
        at_a, at_b = [], []
        present = np.zeros(int(tokens.max(initial=0)) + 1, np.int32)
        for i in range(len(ids)):
            able = group != group[i]
            able[: i + 1] = False
            if two:
                able &= block != block[i]
            near = np.flatnonzero(able)
            near = near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1) <= limit]
            if not len(near):
                continue
            own = tokens[starts[i] : starts[i] + sizes[i]]
            present[own] = 1
            common = np.array([present[tokens[starts[j] : starts[j] + sizes[j]]].sum() for j in near.tolist()])
            present[own] = 0
            good = near[100 * common >= percent * (sizes[i] + sizes[near] - common)]
            at_a.append(np.full(len(good), i))
            at_b.append(good)
        label = forest(np.concatenate(at_a), np.concatenate(at_b), len(ids)) if at_a else np.arange(len(ids))
        moved = label != np.arange(len(ids))
        return pa.table({"a": ids[moved], "b": ids[label[moved]]})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, digest (of its set) and text_hash.
    Linked: 100 * intersection >= percent * union of the sets."""
    hashed = F.xxhash64("text").alias("text_hash")
    signed = written(docs.select("doc_id", hashed, "text").mapInArrow(_sign(width), SIGNED), "signed")
    full = signed.where("doc_id is not null and digest is not null")
    # a document of each class stands for it; bands and sketch follow from the set
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("weight"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes.select("digest", "first.*", "weight", "bands", "sketch", F.monotonically_increasing_id().alias("id")), "classes")
    keyed = classes.select("id", F.explode("bands").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1"), "shared")
    buckets = written(joined_to_groups(keyed, shared, ["key"], "n").select("key", "id", "hub"), "buckets")
    dropped(shared)
    ids = written(buckets.select("id").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    wanted = F.broadcast(ids) if few else ids
    firsts = classes.join(wanted, "id", "left_semi")
    sketches = written(firsts.select("id", "sketch"), "sketches")
    # rows that repeat a doc_id and its text would bring a text more than once
    at = firsts.select("id", F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
    at = F.broadcast(at) if few else at
    texts = docs.select(F.col("doc_id").alias("_doc_id"), F.xxhash64("text").alias("_text_hash"), "text").join(at, ["_doc_id", "_text_hash"]).groupBy("id").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(_sets(width), "id long, keys array<long>"), "sets")
    limit = farthest(percent / 100)

    def near(pairs: DataFrame) -> DataFrame:
        a, b = sketches.toDF("a", "sa"), sketches.toDF("b", "sb")
        return pairs.join(a, "a").join(b, "b").select("a", "b", bits_apart("sa", "sb").alias("bits")).where(F.col("bits") <= limit)

    stars = written(near(buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()), "stars")
    best = stars.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a")).select("a", "b")
    links = written(_confirmed(best, sets, percent), "links")
    named = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        """Those of different components."""
        a, b = named.toDF("a", "ca"), named.toDF("b", "cb")
        return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    rest = apart(stars.select("a", "b")).join(best, ["a", "b"], "left_anti")
    more = written(_confirmed(rest, sets, percent), "links")
    if not more.isEmpty():
        links = written(links.union(more), "links")
        named = components(links)
    # buckets that hold several components: whole families of such buckets, between components, in blocks
    held = buckets.select("key", "id", "hub").join(named.toDF("id", "c"), "id", "left").select("key", "id", "hub", F.coalesce("c", "id").alias("c"))
    mixed = held.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
    mixed = written(mixed, "mixed")
    if not mixed.isEmpty():
        held = written(joined_to_groups(held, mixed, ["key"], "n").select("id", "c", "hub").distinct(), "held")
        families = components(held.select(F.col("id").alias("a"), F.col("hub").alias("b")))
        members = held.select("id", "c").distinct().join(families.toDF("id", "family"), "id").join(sketches, "id").join(sets, "id")
        members = written(members, "members")
        sizes = members.groupBy("family").agg(F.count("*").alias("rows"), F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.size("keys")) / BLOCK_KEYS)).cast("int").alias("n"))
        sizes = written(sizes, "sizes")
        dealt = joined_to_groups(members, sizes, ["family"], "rows").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
        others = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.least(i, "block").alias("i"), F.greatest(i, "block").alias("j")))
        paired = dealt.select("family", "block", "id", "c", "sketch", "keys", F.explode(others).alias("pair")).select("family", "pair.i", "pair.j", "block", "id", "c", "sketch", "keys")
        more = written(paired.groupBy("family", "i", "j").applyInArrow(_between(percent, limit), "a long, b long"), "links")
        if not more.isEmpty():
            named = components(written(links.union(more), "links"))
        dropped(held, families, members, sizes)
    dropped(buckets, ids, sketches, sets, stars, mixed)
    # a component is named by its smallest doc_id
    placed = written(classes.select("digest", "id", "doc_id", "weight").join(named.toDF("id", "component"), "id", "left").select("digest", "doc_id", "weight", F.coalesce("component", "id").alias("component")), "placed")
    least = written(placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    ends = written(joined_to_groups(placed, least, ["component"], "n").select("digest", "component_id", "weight"), "ends")
    dropped(placed, least, classes)
    own = ["doc_id", "n_shingles", "digest", "text_hash"]
    # sets that are empty have no digest and need no join, which would gather them in one task
    found = joined_to_groups(full.select(*own), ends, ["digest"], "weight").select(*own, "component_id")
    out = found.unionByName(signed.where("doc_id is null or digest is null").select(*own, F.col("doc_id").alias("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept, "digest", "text_hash")


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: one document of each group stays, the one with the smallest doc_id. Of rows that repeat a
    doc_id and its set one stays too: that with the smallest text hash, among equal texts that whose other columns come first
    as JSON. Rows without a doc_id or without words all stay. Texts are shuffled once, by doc_id and text hash."""
    marks = near_duplicates(docs, width, percent).where("doc_id is not null and digest is not null")
    each = written(marks.groupBy("doc_id", "digest", "text_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "marks")
    stay = each.where("kept").groupBy("doc_id", "digest").agg(F.min("text_hash").alias("stays"))
    gone = F.col("stays").isNull() | (F.col("stays") != F.col("text_hash"))
    verdicts = each.join(stay, ["doc_id", "digest"], "left").select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), gone.alias("gone"), "n")
    verdicts = written(verdicts.where("gone or n > 1"), "verdicts")
    dropped(each)
    keys = ["_doc_id", "_text_hash"]
    rows = docs.select(F.col("doc_id").alias("_doc_id"), F.xxhash64("text").alias("_text_hash"), carried(docs))
    told = joined_to_groups(rows, verdicts, keys, "n", "left")
    out = told.where("gone is null").select("row")
    if not verdicts.where("not gone").isEmpty():
        out = out.unionByName(told.where("not gone").groupBy(*keys).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return out.select("row.*")
