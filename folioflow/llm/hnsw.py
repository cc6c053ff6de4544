"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Equal vectors of a label are one class, with a number of its own; classes are dealt by hash into shards within each label and
length, and every shard gets a graph. Shards grow with the square root of their label, within bounds of rows and bytes. Every
class queries every shard of its label, in blocks that stream past the graph: greedy descent through the upper layers, a beam
search on the lowest, then a flood along the graph from each vector found within a margin of the threshold, so that groups of
any size are followed to their ends. Before a block is searched its beam is audited: sampled queries are held against the whole
shard, and so are probes that lie at the threshold from sampled vectors; as long as links are missed, beam and margin are
widened, in the end to the whole shard without the graph. Cosines of what is found are computed in double precision, and only
those at the threshold or above link.

A block returns, for each class, how many vectors of the shard it links with and one of them, and a spanning forest of the
shard's own links in place of all pairs; both are folded after every few queries. Components join the forests.

Vectors that are null, empty, zero, or hold null or non-finite components, and those whose label or identifier is null,
link with nothing: no links, their own component, kept. Vectors of different length never link. Each repeated row gets a
row and links with its copies; rows that repeat a vec_id with another vector or label are nodes of their own. Components are
named by their smallest vec_id. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, joined_to_groups, written
from folioflow.llm.components import components, forest

#: Classes of a shard: at least, at most, and bytes of its single-precision vectors at most.
SHARD_ROWS, SHARD_MOST, SHARD_BYTES = 8192, 65536, 64 << 20
#: Classes of a shard for each square root of the classes of its label.
SHARD_GROWTH = 32
#: Blocks of queries hold so many shards' worth; a graph is sent once for each block.
BLOCK_SHARDS = 8
NEIGHBOURS, BUILD_BEAM, BEAM, MARGIN, AUDITS, PROBES = 16, 48, 64, 0.1, 256, 128
#: Share of the audited links and of the probes that must be found.
RECALL, PROBE_RECALL = 1.0, 0.99
#: Queries that walk at once when a graph is built, and queries times vectors of a shard when it is searched.
WALKERS, CELLS = 1024, 1 << 22
FOUND = "id long, links long, to long"


class Layers:
    """A small-world graph over unit vectors, built in batches that grow with it."""

    def __init__(self, unit: np.ndarray, seed: int = 0, m: int = NEIGHBOURS, beam: int = BUILD_BEAM):
        self.unit, self.m, n = unit, m, len(unit)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 6)
        order = rng.permutation(n)
        level[order[:1]] = level.max(initial=0)
        self.entry = int(order[0]) if n else -1
        top = int(level.max(initial=0))
        # links[l][i]: neighbours of i on layer l, -1 where there are fewer; the lowest layer holds twice as many
        self.links = [np.full((n, 2 * m if layer == 0 else m), -1, np.int32) for layer in range(top + 1)]
        done = 1
        while done < n:
            batch = order[done : done + max(1, min(done, WALKERS))]
            self._insert(batch, level[batch], beam)
            done += len(batch)

    def dump(self) -> tuple[int, list[int], bytes]:
        """(entry, neighbours by layer, all links): what load() needs besides the vectors."""
        return self.entry, [layer.shape[1] for layer in self.links], b"".join(layer.tobytes() for layer in self.links)

    @classmethod
    def load(cls, unit: np.ndarray, entry: int, widths: list[int], data: bytes) -> Layers:
        self = cls.__new__(cls)
        self.unit, self.entry, self.m = unit, entry, widths[-1]
        flat, ends = np.frombuffer(data, np.int32), np.cumsum(widths) * len(unit)
        self.links = [flat[end - width * len(unit) : end].reshape(len(unit), width) for width, end in zip(widths, ends.tolist(), strict=True)]
        return self

    def _insert(self, batch: np.ndarray, level: np.ndarray, beam: int) -> None:
        start = np.full(len(batch), self.entry, np.int64)
        for layer in range(len(self.links) - 1, -1, -1):
            ids, sims = self.beam(self.unit[batch], start, layer, beam if (level >= layer).any() else 1)
            start = ids[:, 0]
            at = np.flatnonzero(level >= layer)
            if len(at):
                self._link(batch[at], ids[at], sims[at], layer)

    def _link(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        # those of the batch may be each other's neighbours too
        own = self.unit[nodes] @ self.unit[nodes].T
        np.fill_diagonal(own, -2)
        k = min(self.m, len(nodes))
        near = np.argpartition(-own, k - 1, axis=1)[:, :k]
        ids = np.concatenate([ids, nodes[near]], axis=1)
        sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], axis=1)
        ids[sims <= -2] = -1
        order = np.argsort(-sims, axis=1, kind="stable")
        chosen = self._spread(np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), self.m)
        links = self.links[layer]
        links[nodes, : self.m] = chosen
        # links back; nodes whose list overflows choose again among all
        source = np.repeat(nodes, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        firsts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, int)
        counts = np.diff(np.append(firsts, len(target)))
        width = int(counts.max(initial=0))
        if not width:
            return
        to = target[firsts]
        extra = np.full((len(to), width), -1, np.int64)
        extra[np.repeat(np.arange(len(to)), counts), np.arange(len(target)) - np.repeat(firsts, counts)] = source
        every = np.concatenate([links[to].astype(np.int64), extra], axis=1)
        for a in range(0, len(to), WALKERS):
            some, node = every[a : a + WALKERS], to[a : a + WALKERS]
            sims = np.einsum("amd,ad->am", self.unit[some], self.unit[node])
            sims[some < 0] = -2
            order = np.argsort(-sims, axis=1, kind="stable")
            links[node] = self._spread(np.take_along_axis(some, order, 1), np.take_along_axis(sims, order, 1), links.shape[1])

    def _spread(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Of neighbours in order of similarity, those nearer to the node than to any chosen before; then the nearest."""
        rows, width = ids.shape
        vectors = self.unit[ids]
        chosen = np.full((rows, keep), -1, np.int64)
        count = np.zeros(rows, int)
        closest = np.full((rows, width), -2.0, np.float32)  # to any chosen one
        taken = np.zeros((rows, width), bool)
        for second in (False, True):
            for j in range(width):
                good = (ids[:, j] >= 0) & (count < keep) & ~taken[:, j]
                if not second:
                    good &= closest[:, j] < sims[:, j]
                    good |= (count == 0) & (ids[:, j] >= 0)
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                fresh = ~(chosen[at] == ids[at, j][:, None]).any(axis=1)
                at = at[fresh]
                chosen[at, count[at]] = ids[at, j]
                count[at] += 1
                taken[at, j] = True
                if not second and len(at):
                    closest[at] = np.maximum(closest[at], np.einsum("amd,ad->am", vectors[at], vectors[at, j]))
        return chosen

    def beam(self, queries: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities), most similar first, -1 where fewer were met; one node of each beam is opened a step."""
        n, links = len(queries), self.links[layer]
        seen = np.zeros((n, len(self.unit)), bool)
        rows = np.arange(n)
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -2.0, np.float32)
        opened = np.ones((n, width), bool)
        ids[:, 0], sims[:, 0], opened[:, 0] = start, np.einsum("ad,ad->a", self.unit[start], queries), False
        seen[rows, start] = True
        live = rows
        while True:
            closed = opened[live]
            first = closed.argmin(axis=1)
            on = ~closed[np.arange(len(live)), first]
            live, first = live[on], first[on]
            if not len(live):
                return ids, sims
            node = ids[live, first]
            opened[live, first] = True
            near = links[node].astype(np.int64)
            new = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(near >= 0, near, node[:, None])] = True
            value = np.einsum("amd,ad->am", self.unit[near], queries[live])
            value[~new] = -2
            all_sims = np.concatenate([sims[live], value], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, near, -1)], axis=1), order, 1)
            sims[live] = np.take_along_axis(all_sims, order, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], ~new], axis=1), order, 1)

    def within(self, queries: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of at least that similarity, as far as beam and flood meet them."""
        start = np.full(len(queries), self.entry, np.int64)
        for layer in range(len(self.links) - 1, 0, -1):
            start = self.beam(queries, start, layer, 1)[0][:, 0]
        ids, sims = self.beam(queries, start, 0, width)
        seen = np.zeros((len(queries), len(self.unit)), bool)
        row, col = np.nonzero((ids >= 0) & (sims >= least))
        edge = (row, ids[row, col])
        seen[edge] = True
        while len(edge[0]):
            fresh: list[tuple[np.ndarray, np.ndarray]] = []
            for a in range(0, len(edge[0]), 1 << 15):
                q = edge[0][a : a + (1 << 15)]
                near = self.links[0][edge[1][a : a + (1 << 15)]].astype(np.int64)
                q, near = np.repeat(q, near.shape[1]), near.ravel()
                new = (near >= 0) & ~seen[q, near]
                key = np.unique(q[new] * len(self.unit) + near[new])
                q, near = key // len(self.unit), key % len(self.unit)
                good = np.einsum("ad,ad->a", self.unit[near], queries[q]) >= least
                q, near = q[good], near[good]
                seen[q, near] = True
                fresh.append((q, near))
            edge = tuple(np.concatenate(x) for x in zip(*fresh, strict=True))
        return np.nonzero(seen)


def _exact(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose cosine in double precision reaches the threshold; a, b: float64."""
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    keep = [np.zeros(0, bool)]
    for at in range(0, len(i), 1 << 15):
        x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        keep.append(np.einsum("ad,ad->a", a[x], b[y]) / (norm_a[x] * norm_b[y]) >= threshold)
    keep = np.concatenate(keep)
    return i[keep], j[keep]


def _all(queries: np.ndarray, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(queries @ unit.T >= least)


def _unit(raw: np.ndarray) -> np.ndarray:
    return (raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))).astype(np.float32)


def _scaled(raw: np.ndarray) -> np.ndarray:
    """As float64, each row over a power of two near its largest component: exact, and squares stay finite."""
    raw = raw.astype(np.float64)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, initial=0, keepdims=True))[1])


class Searcher:
    """Links of queries with the vectors of one shard, folded into counts and a forest."""

    SLACK = 1e-5  # of single precision

    def __init__(self, graph: Layers, raw: np.ndarray, weight: np.ndarray, threshold: float):
        self.graph, self.raw, self.weight, self.threshold = graph, raw, weight, threshold
        self.label = np.arange(len(raw))
        self.width, self.margin = BEAM, MARGIN

    def audit(self, queries: np.ndarray, seed: int = 0) -> None:
        """Widens beam and margin until sampled queries miss no link and probes at the threshold are found."""
        unit, n, threshold = self.graph.unit, len(self.raw), self.threshold
        rng = np.random.default_rng(seed)
        sampled = queries[np.sort(rng.permutation(len(queries))[:AUDITS])]
        whole = _exact(*_all(_unit(sampled), unit, threshold - self.SLACK), sampled, self.raw, threshold)
        nodes = np.sort(rng.permutation(n)[:PROBES])
        aside = rng.normal(size=(len(nodes), unit.shape[1]))
        aside -= (aside * unit[nodes]).sum(axis=1, keepdims=True) * unit[nodes]
        length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
        probes = (threshold * unit[nodes] + np.sqrt(1 - min(1.0, threshold) ** 2) * aside / np.maximum(length, 1e-9)).astype(np.float32)
        while self.width < n:
            found = _exact(*self.graph.within(_unit(sampled), threshold - self.margin, self.width), sampled, self.raw, threshold)
            i, j = self.graph.within(probes, threshold - self.margin, self.width)
            if len(found[0]) >= RECALL * len(whole[0]) and (nodes[i] == j).sum() >= PROBE_RECALL * len(nodes):
                return
            self.width, self.margin = 2 * self.width, self.margin + 0.03

    def links(self, queries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(linked weight, position of one linked vector or -1) of each query. own: its position in the shard or -1, which it
        does not link with."""
        total, one = np.zeros(len(queries), np.int64), np.full(len(queries), -1, np.int64)
        step = max(16, min(WALKERS, CELLS // max(1, len(self.raw))))
        for at in range(0, len(queries), step):
            some, unit = queries[at : at + step], _unit(queries[at : at + step])
            pairs = self.graph.within(unit, self.threshold - self.margin, self.width) if self.width < len(self.raw) else _all(unit, self.graph.unit, self.threshold - self.SLACK)
            i, j = _exact(*pairs, some, self.raw, self.threshold)
            other = own[at : at + step][i] != j
            i, j = i[other], j[other]
            total[at : at + step] = np.bincount(i, self.weight[j], len(some))
            firsts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else i
            one[at + i[firsts]] = j[firsts]
            self._join(np.repeat(j[firsts], np.diff(np.append(firsts, len(i)))), j)
        return total, one

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        new = np.unique(np.minimum(a, b)[a != b] * len(self.label) + np.maximum(a, b)[a != b])
        if len(new):
            self.label = forest(new // len(self.label), new % len(self.label), len(self.label))[self.label]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


GRAPH = "struct<ids:binary,weights:binary,vectors:binary,kind:string,entry:int,widths:array<int>,links:binary>"


def _build(table: pa.Table) -> pa.Table:
    """The graph of a shard as one row. Rows are put in order of id, so that a task that runs again builds the same."""
    table = table.sort_by("id")
    raw = _matrix(table["embedding"])
    entry, widths, links = Layers(_unit(_scaled(raw))).dump()
    ids, weights = (table[c].to_numpy().astype(np.int64).tobytes() for c in ("id", "weight"))
    graph = {"ids": ids, "weights": weights, "vectors": raw.tobytes(), "kind": raw.dtype.str, "entry": entry, "widths": widths, "links": links}
    kind = pa.struct([("ids", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary()), ("kind", pa.string()), ("entry", pa.int32()), ("widths", pa.list_(pa.int32())), ("links", pa.binary())])
    first = table.slice(0, 1).select(["label", "size", "shard", "blocks"])
    return first.append_column("graph", pa.array([graph], kind))


def _search(threshold: float):
    """Rows come sorted: for each shard and block first the graph, then the queries."""

    def said(ids: np.ndarray, links: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(to)], ["id", "links", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = ids = None
        audited = False

        def forest_rows() -> Iterator[pa.RecordBatch]:
            if search is not None:
                moved = np.flatnonzero(search.label != np.arange(len(ids)))
                yield said(ids[moved], np.zeros(len(moved), np.int64), ids[search.label[moved]])

        for batch in batches:
            starts = np.flatnonzero(np.asarray(batch["graph"].is_valid())).tolist()
            for begin, end in zip([-1, *starts], [*starts, len(batch)], strict=True):
                if begin >= 0:
                    yield from forest_rows()
                    g = batch["graph"][begin].as_py()
                    ids, weight = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["weights"], np.int64)
                    raw = _scaled(np.frombuffer(g["vectors"], g["kind"]).reshape(len(ids), -1))
                    search, audited = Searcher(Layers.load(_unit(raw), g["entry"], g["widths"], g["links"]), raw, weight, threshold), False
                some = batch.slice(begin + 1, end - begin - 1)
                if not len(some):
                    continue
                queries, own = _scaled(_matrix(some["embedding"])), some["id"].to_numpy()
                if not audited:
                    search.audit(queries)
                    audited = True
                at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                total, one = search.links(queries, np.where(ids[at] == own, at, -1))
                met = one >= 0
                yield said(own[met], total[met], ids[one[met]])
        yield from forest_rows()

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept. vectors: vec_id, embedding, label."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    value = F.col("embedding").cast(f"array<{kind}>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    sound = F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), value.alias("embedding"), sound.alias("sound"))
    # -0.0 and 0.0 are the same component
    rows = rows.withColumn("embedding", F.when(F.col("sound"), F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))))
    keys = ["label", "size", "one", "two"]
    keyed = written(rows.select("*", F.size("embedding").alias("size"), F.xxhash64("embedding").alias("one"), F.xxhash64(F.reverse("embedding"), F.lit(1)).alias("two")), "vectors")
    classes = keyed.where("sound").groupBy(*keys).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    classes = written(classes.select("*", F.monotonically_increasing_id().alias("id")), "classes")
    # how many shards and blocks of queries each label and length has
    most = F.least(F.lit(SHARD_MOST), F.greatest(F.lit(1024), F.floor(F.lit(SHARD_BYTES / 4) / F.col("size"))))
    each = F.least(most, F.greatest(F.lit(shard_rows), F.ceil(SHARD_GROWTH * F.sqrt("rows"))))
    sizes = classes.groupBy("label", "size").agg(F.count("*").alias("rows")).withColumn("each", each)
    sizes = sizes.select("label", "size", "rows", F.ceil(F.col("rows") / F.col("each")).cast("int").alias("shards"), F.ceil(F.col("rows") / (BLOCK_SHARDS * F.col("each"))).cast("int").alias("blocks"))
    sizes = written(sizes, "sizes")
    dealt = joined_to_groups(classes.select("label", "size", "id", "weight", "embedding"), sizes, ["label", "size"], "rows")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int"))
    graphs = dealt.select("label", "size", "shard", "blocks", "id", "weight", "embedding").groupBy("label", "size", "shard").applyInArrow(_build, f"label string, size int, shard int, blocks int, graph {GRAPH}")
    graphs = written(graphs, "graphs")
    # each graph meets each block of queries of its label
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    by = ["label", "size", "shard", "block"]
    first = graphs.select("label", "size", "shard", every("blocks").alias("block"), F.lit(None).cast("long").alias("id"), F.lit(None).cast(f"array<{kind}>").alias("embedding"), "graph")
    queries = dealt.select("label", "size", every("shards").alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int").alias("block"), "id", "embedding", F.lit(None).cast(GRAPH).alias("graph"))
    pairs = sizes.agg(F.sum(F.col("shards") * F.col("blocks"))).first()[0] or 1
    met = first.unionByName(queries).repartition(min(pairs, 20_000), *by).sortWithinPartitions(*by, F.col("id").asc_nulls_first())
    found = written(met.select("id", "embedding", "graph").mapInArrow(_search(threshold), FOUND), "found")
    dropped(graphs)
    named = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    whole = classes.select("id", *keys, "vec_id", "weight").join(counted, "id", "left").join(named.toDF("id", "component"), "id", "left")
    whole = written(whole.select(*keys, "vec_id", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component")), "whole")
    # a component is named by its smallest vec_id
    least = written(whole.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n")), "least")
    whole = written(joined_to_groups(whole.drop("vec_id"), least, ["component"], "n").select(*keys, "weight", "links", "component_id"), "whole")
    dropped(classes, sizes, found, least)
    placed = joined_to_groups(keyed.where("sound").select("vec_id", *keys), whole, keys, "weight").select("vec_id", F.col("links").cast("long").alias("n_links"), "component_id")
    # unsound vectors need no join, which would gather them in one task
    out = placed.unionByName(keyed.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
