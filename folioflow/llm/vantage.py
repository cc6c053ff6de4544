"""Hard negatives by vantage-point trees over norm-augmented vectors.

Vectors x become integers and get one component more, the root of M - |x|^2 with M the largest squared length; a query gets a
zero there. Then |q - x|^2 = |q|^2 + M - 2 q.x: higher scores are nearer, and a window of scores is an annulus around the query.

A tree over a bounded sample deals all rows into shards: at each vantage point rows within a radius go one way, the others the
other. Of every shard the least and largest distance of its rows to the vantage points above it are known, and so, for a query,
bounds on the distance of all its rows. Queries visit first the shard that begins nearest to the inner edge of their annulus; the
worst of the k rows found there narrows the annulus, and only shards that reach into it are visited in the second wave. Within a
shard a tree of the same kind has small leaves, which each query opens nearest first from the inner edge outwards, until k rows
of the wanted kind are known and no unopened leaf begins nearer than the worst of them. The results are exact.

A shard of more rows than fit (many equal vectors, or more shards than vantage points may be) is dealt into parts by hash, which
a query visits all. Queries of a shard stream past it in blocks; a task holds one shard.

Rows with a null vec_id, label or vector or any null or non-finite component take no part, nor do vectors whose squared length,
in integers, is over 2**58, as their scores would not fit a long. Vectors of different length are not compared; empty vectors
score 0 with each other. Rows are told apart by place, so a repeated row is another row, and a repeated anchor asks again. Ties go
to the smaller vec_id. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, joined_to_groups, written

#: Rows of a shard, and bytes of its vectors at most.
SHARD_ROWS, SHARD_BYTES = 16_384, 64 << 20
#: Shards that the sampled tree tells apart, bytes of its vantage points, sampled rows for each shard.
MOST_LEAVES, TREE_BYTES, SAMPLED = 1024, 8 << 20, 8
#: Lengths of vectors that get a tree of their own, the most frequent ones; rows of others are dealt by hash alone.
MOST_SIZES = 64
#: Rows of a leaf within a shard; queries of a block on average; queries, times rows of a leaf, that are scored at once.
LEAF_ROWS, BLOCK_ROWS, CELLS = 128, 65_536, 1 << 21
LARGEST = float(1 << 58)
ASKED = "size int, leaf int, request long, anchor_id long, label string, vector array<long>, windows array<struct<w:int,low:long,high:long>>"
FOUND = "request long, w int, vec_id long, row long, score long"
NO_LIMIT = (1 << 62) - 1


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """a b' for int64 matrices, exactly: by doubles if no sum can leave their integers. most: largest squared length."""
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


@dataclass
class Space:
    """Distances of the augmented vectors. most: the largest squared length, M."""

    most: float

    @property
    def slack(self) -> float:
        return 1e-6 * np.sqrt(self.most) + 1e-9

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of rows from rows."""
        a_norm, b_norm = (a.astype(np.float64) ** 2).sum(axis=1), (b.astype(np.float64) ** 2).sum(axis=1)
        aside = np.sqrt(np.maximum(self.most - a_norm, 0))[:, None] * np.sqrt(np.maximum(self.most - b_norm, 0))
        return np.sqrt(np.maximum(2 * self.most - 2 * (products(a, b, self.most) + aside), 0))

    def radius(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of rows with that score from queries with that squared length."""
        return np.sqrt(np.maximum(norm + self.most - 2.0 * score, 0))


class Tree:
    """A vantage-point tree; rows need not be those that it was built from."""

    def __init__(self, space: Space, rows: np.ndarray, leaves: int = 1 << 30, leaf_rows: int = 1):
        self.space = space
        self.vantage, self.cut, self.child, above = [], [], [], []
        todo, count = [(np.arange(len(rows)), -1, 0, ())], 1
        self.paths: list[tuple[int, ...]] = []  # of each leaf, the vantage points above it
        while todo:
            at, parent, side, path = todo.pop(0)
            node = None
            if len(at) > leaf_rows and count < leaves:
                # the row farthest from another row sees the others at the most different distances
                far = at[space.between(rows[at], rows[at[:1]])[:, 0].argmax()]
                seen = space.between(rows[at], rows[far : far + 1])[:, 0]
                cut = float(np.partition(seen, (len(at) - 1) // 2)[(len(at) - 1) // 2])
                if not (seen > cut).any() and (seen < cut).any():
                    cut = float(seen[seen < cut].max())
                if (seen > cut).any():
                    node = len(self.vantage)
                    self.vantage.append(rows[far])
                    self.cut.append(cut)
                    self.child.append([0, 0])
                    count += 1
                    todo += [(at[seen <= cut], node, 0, (*path, node)), (at[seen > cut], node, 1, (*path, node))]
            name = node if node is not None else -1 - len(self.paths)
            if node is None:
                self.paths.append(path)
            if parent >= 0:
                self.child[parent][side] = name
        self.vantage = np.array(self.vantage, np.int64).reshape(len(self.cut), rows.shape[1])
        self.depth = max(map(len, self.paths))
        self.above = np.full((len(self.paths), self.depth), -1)
        for leaf, path in enumerate(self.paths):
            self.above[leaf, : len(path)] = path

    def leaf(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distances to the vantage points above it, NaN where there are fewer) of each row."""
        node, out = np.zeros(len(rows), int) if len(self.cut) else np.full(len(rows), -1), np.full((len(rows), self.depth), np.nan)
        child, cut = np.array(self.child, int).reshape(-1, 2), np.array(self.cut)
        for level in range(self.depth):
            for v in np.unique(node[node >= 0]):
                at = np.flatnonzero(node == v)
                out[at, level] = seen = self.space.between(rows[at], self.vantage[v : v + 1])[:, 0]
                node[at] = child[v, (seen > cut[v]).astype(int)]
        return -1 - node, out

    def reach(self, queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries x leaves, the distances that rows of a leaf have at least and at most. least, most: of its rows to the
        vantage points above it; NaN where there are fewer."""
        norm = (queries.astype(np.float64) ** 2).sum(axis=1)
        low, high = np.zeros((len(queries), len(self.paths))), np.full((len(queries), len(self.paths)), np.inf)
        if not len(self.cut):
            return low, high
        seen = self.space.radius(norm[:, None], products(queries, self.vantage, self.space.most).astype(np.float64))
        for level in range(self.depth):
            to = np.where((self.above[:, level] >= 0)[None, :], seen[:, self.above[:, level]], np.nan)
            low = np.fmax(low, np.fmax(to - most[:, level], least[:, level] - to))
            high = np.fmin(high, to + most[:, level])
        return low - self.space.slack, high + self.space.slack


class Shard:
    """The rows of one part of a shard, in leaves; walkers open them nearest first."""

    def __init__(self, space: Space, vectors: np.ndarray, vec_ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        order = np.lexsort([rows, vec_ids])  # positions are ranks among ties
        vectors, self.vec_ids, self.rows = vectors[order], vec_ids[order], rows[order]
        codes, names = pd.factorize(labels[order])
        self.space, self.codes, self.names = space, codes, {n: i for i, n in enumerate(names)}
        self.tree = Tree(space, vectors, leaf_rows=LEAF_ROWS)
        leaf, seen = self.tree.leaf(vectors)
        by = np.argsort(leaf, kind="stable")
        ends = np.cumsum(np.bincount(leaf, minlength=len(self.tree.paths)))
        self.members = np.split(by, ends[:-1])
        empty = np.full((1, self.tree.depth), np.nan)
        self.least = np.concatenate([seen[m].min(axis=0, keepdims=True) if len(m) else empty for m in self.members])
        self.most = np.concatenate([seen[m].max(axis=0, keepdims=True) if len(m) else empty for m in self.members])
        self.vectors = [vectors[m] for m in self.members]

    def find(self, queries: np.ndarray, labels: list[str], own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(walker, position, score) of the first k rows of each walker: those of its label (same) or of another, with a score
        from low to high, not the row own itself."""
        n, space = len(queries), self.space
        norm = (queries.astype(np.float64) ** 2).sum(axis=1)
        code = np.array([self.names.get(x, -1) for x in labels])
        near, far = self.tree.reach(queries, self.least, self.most)
        inner, outer = space.radius(norm, high), space.radius(norm, low)
        begins = np.maximum(near, inner[:, None])
        begins[(near > outer[:, None] + space.slack) | (far < inner[:, None] - space.slack) | np.array([not len(m) for m in self.members])] = np.inf
        turn = np.argsort(begins, axis=1, kind="stable")
        begins = np.take_along_axis(begins, turn, 1)
        best = np.full((n, k), -NO_LIMIT - 1)
        place = np.full((n, k), len(self.vec_ids))
        worst = np.full(n, np.inf)
        for step in range(turn.shape[1]):
            live = np.flatnonzero((begins[:, step] < np.inf) & (begins[:, step] <= worst))
            if not len(live):
                break
            live = live[np.argsort(turn[live, step], kind="stable")]
            starts = np.flatnonzero(np.concatenate([[True], np.diff(turn[live, step]) != 0]))
            for group in np.split(live, starts[1:]):
                leaf = turn[group[0], step]
                members, vectors = self.members[leaf], self.vectors[leaf]
                size = max(1, CELLS // len(members))
                for some in (group[a : a + size] for a in range(0, len(group), size)):
                    score = products(queries[some], vectors, space.most)
                    kind = (self.codes[members][None, :] == code[some][:, None]) == same
                    good = kind & (score >= low[some][:, None]) & (score <= high[some][:, None]) & (self.rows[members][None, :] != own[some][:, None])
                    hit = np.flatnonzero((good & (score >= best[some, -1][:, None])).any(axis=1))
                    if not len(hit):
                        continue
                    some = some[hit]
                    scores = np.concatenate([best[some], np.where(good[hit], score[hit], -NO_LIMIT - 1)], axis=1)
                    places = np.concatenate([place[some], np.broadcast_to(members, (len(some), len(members)))], axis=1)
                    first = np.argsort(places, axis=1, kind="stable")
                    first = np.take_along_axis(first, np.argsort(-np.take_along_axis(scores, first, 1), axis=1, kind="stable")[:, :k], 1)
                    best[some], place[some] = np.take_along_axis(scores, first, 1), np.take_along_axis(places, first, 1)
                    full = some[best[some, -1] >= -NO_LIMIT]
                    worst[full] = space.radius(norm[full], best[full, -1]) + space.slack
        walker, rank = np.nonzero(best >= -NO_LIMIT)
        return walker, place[walker, rank], best[walker, rank]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.array(column.flatten().to_numpy(zero_copy_only=False), np.int64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


BLOB = "struct<vec_ids:binary,rows:binary,labels:array<string>,vectors:binary,width:int>"


def _blob(table: pa.Table) -> pa.Table:
    """A part of a shard as one row."""
    vectors = _matrix(table["vector"].combine_chunks())
    blob = {"vec_ids": table["vec_id"].to_numpy().astype(np.int64).tobytes(), "rows": table["row"].to_numpy().astype(np.int64).tobytes(), "labels": table["label"].to_pylist(), "vectors": vectors.tobytes(), "width": vectors.shape[1]}
    kind = pa.struct([("vec_ids", pa.binary()), ("rows", pa.binary()), ("labels", pa.list_(pa.string())), ("vectors", pa.binary()), ("width", pa.int32())])
    return table.slice(0, 1).select(["size", "leaf", "part"]).append_column("blob", pa.array([blob], kind))


@dataclass
class Dealer:
    """Which shards there are, and which of them a query has to visit. bounds: by length of vector, least and most of reach()."""

    space: Space
    trees: dict[int, Tree]
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] | None = None

    def deal(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds to rows their leaf and their distances to the vantage points above it."""
        for batch in batches:
            sizes, vectors = batch["size"].to_numpy(), batch["vector"]
            leaf, seen = np.zeros(len(batch), np.int32), [None] * len(batch)
            for size in np.unique(sizes):
                if size in self.trees:
                    at = np.flatnonzero(sizes == size)
                    found, far = self.trees[size].leaf(_matrix(vectors.take(pa.array(at))))
                    leaf[at] = found
                    for i, x in zip(at, far.tolist(), strict=True):
                        seen[i] = x
            columns = [batch.column(c) for c in ("row", "vec_id", "label", "vector", "size")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(leaf), pa.array(seen, pa.list_(pa.float64()))], ["row", "vec_id", "label", "vector", "size", "leaf", "seen"])

    def visits(self, second: bool):
        """Requests (request, anchor_id, label, vector, size, windows), each once for every leaf that it visits in that wave."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, vectors, windows = batch["size"].to_numpy(), batch["vector"], batch["windows"].to_pylist()
                rows, leaves, which = [], [], []
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    if size not in self.trees:
                        if not second:
                            rows, leaves, which = rows + at.tolist(), leaves + [0] * len(at), which + [windows[i] for i in at]
                        continue
                    queries = _matrix(vectors.take(pa.array(at)))
                    norm = (queries.astype(np.float64) ** 2).sum(axis=1)
                    low, high = self.trees[size].reach(queries, *self.bounds[size])
                    there = ~np.isnan(self.bounds[size][0]).all(axis=1) | (len(self.trees[size].paths) == 1)
                    chosen: dict[tuple[int, int], list[dict]] = {}
                    for j, i in enumerate(at.tolist()):
                        for w in windows[i]:
                            inner, outer = self.space.radius(norm[j], np.array([w["high"], w["low"]], float))
                            begins = np.where(there & (high[j] >= inner - self.space.slack), np.maximum(low[j], inner), np.inf)
                            first = int(np.lexsort([np.abs(low[j] + high[j] - 2 * inner), begins])[0])
                            if not second:
                                visit = [first] if begins[first] < np.inf else []
                            else:
                                visit = [x for x in np.flatnonzero(begins <= outer + self.space.slack).tolist() if x != first]
                            for leaf in visit:
                                chosen.setdefault((i, leaf), []).append(w)
                    for (i, leaf), ws in chosen.items():
                        rows.append(i)
                        leaves.append(leaf)
                        which.append(ws)
                if rows:
                    taken = batch.take(pa.array(rows))
                    kind = pa.list_(pa.struct([("w", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))
                    names = ["size", "leaf", "request", "anchor_id", "label", "vector", "windows"]
                    yield pa.RecordBatch.from_arrays([taken["size"], pa.array(leaves, pa.int32()), *(taken[c] for c in names[2:6]), pa.array(which, kind)], names)

        return run


def _search(space: Space, k: int, same: bool):
    """Rows come sorted: for each part of a shard and block first the blob, then the requests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            starts = np.flatnonzero(np.asarray(batch["blob"].is_valid())).tolist()
            for begin, end in zip([-1, *starts], [*starts, len(batch)], strict=True):
                if begin >= 0:
                    b = batch["blob"][begin].as_py()
                    vec_ids = np.frombuffer(b["vec_ids"], np.int64)
                    vectors = np.frombuffer(b["vectors"], np.int64).reshape(len(vec_ids), b["width"])
                    shard = Shard(space, vectors, vec_ids, np.frombuffer(b["rows"], np.int64), np.array(b["labels"], object))
                some = batch.slice(begin + 1, end - begin - 1)
                if not len(some):
                    continue
                windows = some["windows"].to_pylist()
                of = np.repeat(np.arange(len(some)), [len(w) for w in windows])
                flat = [x for w in windows for x in w]
                w, low, high = (np.array([x[c] for x in flat], np.int64) for c in ("w", "low", "high"))
                request, labels, queries = some["request"].to_numpy(), some["label"].to_pylist(), _matrix(some["vector"])
                walker, place, score = shard.find(queries[of], [labels[i] for i in of], request[of], low, high, k, same)
                found = [request[of[walker]], w[walker].astype(np.int32), shard.vec_ids[place], shard.rows[place], score]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["request", "w", "vec_id", "row", "score"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each request and window, with their rank."""
    order = W.partitionBy("request", "w").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """All rows in shards. shards: size, leaf, part, blob. made: the tables to be dropped once results are written."""

    def __init__(self, dealer: Dealer, shards: DataFrame, blocks: int):
        self.dealer, self.shards, self.blocks = dealer, shards, blocks
        self.places = written(shards.select("size", "leaf", "part"), "places")
        self.made = [shards, self.places]

    def first(self, requests: DataFrame, k: int, same: bool) -> DataFrame:
        """(request, w, vec_id, row, score, rank): the first k rows of each window (w, low, high) of each request (request,
        anchor_id, label, vector, size, windows). requests is read twice: give a written table."""
        begun = written(self._wave(requests, k, same, False), "found")
        self.made.append(begun)
        # the k-th score that is known narrows the window
        known = _first(begun, k).where(F.col("rank") == k).groupBy("request").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("known"))
        narrowed = F.transform("windows", lambda x: F.struct(x["w"].alias("w"), F.greatest(x["low"], F.try_element_at("known", x["w"])).alias("low"), x["high"].alias("high")))
        further = requests.join(known, "request", "left").withColumn("windows", F.when(F.col("known").isNull(), F.col("windows")).otherwise(narrowed)).drop("known")
        return _first(begun.unionByName(self._wave(further, k, same, True)), k)

    def _wave(self, requests: DataFrame, k: int, same: bool, second: bool) -> DataFrame:
        keys = ["size", "leaf", "part", "block"]
        visits = requests.select("request", "anchor_id", "label", "vector", "size", "windows").mapInArrow(self.dealer.visits(second), ASKED)
        # only parts that have rows are asked
        asked = written(visits.join(self.places, ["size", "leaf"]).withColumn("block", F.pmod(F.xxhash64("request"), F.lit(self.blocks)).cast("int")), "asked")
        self.made.append(asked)
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in asked.schema.fields if f.name not in keys]
        blobs = self.shards.join(asked.select(*keys).distinct(), ["size", "leaf", "part"]).select(*keys, *blank, "blob")
        met = blobs.unionByName(asked.withColumn("blob", F.lit(None).cast(BLOB))).repartition(*keys).sortWithinPartitions(*keys, F.col("request").asc_nulls_first())
        return met.select("request", "label", "vector", "windows", "blob").mapInArrow(_search(self.dealer.space, k, same), FOUND)


def indexed(rows: DataFrame, blocks: int, shard_rows: int = SHARD_ROWS) -> Index:
    """rows: row, vec_id, label, vector, size, norm; read several times: give a written table."""
    each = F.least(F.lit(shard_rows), F.greatest(F.lit(256), F.floor(F.lit(SHARD_BYTES / 8) / F.greatest("size", F.lit(1)))))
    space = Space(float(rows.agg(F.max("norm")).first()[0] or 0))
    large = rows.groupBy("size").agg(F.count("*").alias("n")).withColumn("each", each).where("n > each and size > 0").orderBy(F.desc("n"), "size").limit(MOST_SIZES).collect()
    trees = {}
    for size, n, most in large:
        leaves = int(min(-(-n // most), MOST_LEAVES, max(1, TREE_BYTES // (8 * size))))
        sample = rows.where(F.col("size") == size).orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLED * leaves).select("vector").toPandas()["vector"]
        trees[size] = Tree(space, np.array(sample.tolist(), np.int64), leaves)
    dealer = Dealer(space, trees)
    dealt = written(rows.select("row", "vec_id", "label", "vector", "size").mapInArrow(dealer.deal, "row long, vec_id long, label string, vector array<long>, size int, leaf int, seen array<double>"), "dealt")
    counted = dealt.groupBy("size", "leaf").agg(F.count("*").alias("n"))
    parts = written(counted.select("size", "leaf", "n", F.ceil(F.col("n") / each).cast("int").alias("parts")), "parts")
    # bounds of the leaves of trees: as many rows as leaves, times their depth
    level = dealt.where("seen is not null").select("size", "leaf", F.posexplode("seen").alias("level", "far")).where("not isnan(far)")
    sides = level.groupBy("size", "leaf", "level").agg(F.min("far").alias("least"), F.max("far").alias("most")).toPandas()
    dealer.bounds = {}
    for size, tree in trees.items():
        least, most = np.full(tree.above.shape, np.nan), np.full(tree.above.shape, np.nan)
        own = sides[sides["size"] == size]
        least[own["leaf"], own["level"]], most[own["leaf"], own["level"]] = own["least"], own["most"]
        dealer.bounds[size] = (least, most)
    split = joined_to_groups(dealt, parts, ["size", "leaf"], "n").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    shards = split.select("row", "vec_id", "label", "vector", "size", "leaf", "part").groupBy("size", "leaf", "part").applyInArrow(_blob, f"size int, leaf int, part int, blob {BLOB}")
    shards = written(shards, "shards")
    dropped(dealt, parts)
    return Index(dealer, shards, blocks)


def _percent(score: Column, percent: int, up: int) -> Column:
    """score * percent / 100, rounded down (up: 0) or up (up: 99), without leaving longs."""
    rest = F.pmod(score, F.lit(100).cast("long"))
    return percent * ((score - rest).cast("decimal(20,0)") / 100).cast("long") + F.floor((percent * rest + up) / 100)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per anchor and positive, the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label; anchor: which rows ask. Components become floor(scale * x). Positives are the first other
    rows of the anchor's label by inner product; negatives those of other labels whose score is low to high percent of the
    positive's."""
    value = F.col("embedding").cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate(value, F.lit(0.0), lambda total, x: total + F.pow(F.abs(x) * scale + 1, F.lit(2.0)))
    sound = F.coalesce(sound & (length < LARGEST) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.when(sound, F.transform(value, lambda x: F.floor(x * scale).cast("long"))).alias("vector"), anchor.alias("asks")).where("vector is not null")
    norm = F.aggregate("vector", F.lit(0).cast("long"), lambda total, x: total + x * x)
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "label", "vector", F.size("vector").alias("size"), norm.alias("norm"), F.coalesce("asks", F.lit(False)).alias("asks")), "rows")
    asking = rows.where("asks").select(F.col("row").alias("request"), F.col("vec_id").alias("anchor_id"), "label", "vector", "size")
    index = indexed(rows, -(-asking.count() // BLOCK_ROWS) or 1, shard_rows)
    window = lambda w, a, b: F.struct(w.cast("int").alias("w"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    whole = asking.withColumn("windows", F.array(window(F.lit(0), F.lit(-NO_LIMIT), F.lit(NO_LIMIT))))
    near = index.first(whole, positives, True).select("request", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = written(near, "positives")
    score = F.col("positive_score")
    asked = near.select("request", window(F.col("w"), _percent(score, low, 99), _percent(score, high, 0)).alias("x")).where("x.low <= x.high").groupBy("request").agg(F.sort_array(F.collect_list("x")).alias("windows"))
    asked = written(asking.join(asked, "request"), "asking")
    found = index.first(asked, negatives, False).join(near, ["request", "w"]).join(asking.select("request", "anchor_id"), "request")
    out = written(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    dropped(rows, near, asked, *index.made)
    return out
