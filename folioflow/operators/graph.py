"""Entity graphs as tables of vertices and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.values import normal_name, same_plain
from folioflow.operators.chunking import folded
from folioflow.plans.lineage import cut, released

#: Names of at most so many words meet by two of them; letters that the pieces have at most by which names that hold others are found.
FEW_WORDS, LONGEST_PIECE = 8, 32


def parsed_tuples(responses: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Entities (key, position, name, type, description) and relationships (key, position, source, target, description,
    strength) from lines such as ("entity"|name|type|description). Lines with too few parts go; a strength that is no
    whole number is 1; of entities that repeat a name under one key the last stays."""
    lines = responses.select(key, F.posexplode(F.split(text, "\n")).alias("position", "line"))
    parts = lines.withColumn("p", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\(|\)$", ""), r"\|"), lambda x: F.trim(F.regexp_replace(x, '^"|"$', ""))))
    entities = parts.where((F.col("p")[0] == "entity") & (F.size("p") >= 3)).select(key, "position", F.col("p")[1].alias("name"), F.col("p")[2].alias("type"), F.coalesce(F.get("p", F.lit(3)), F.lit("")).alias("description"))
    last = entities.withColumn("_n", F.row_number().over(W.partitionBy(key, "name").orderBy(F.desc("position")))).where("_n = 1").drop("_n")
    strength = F.coalesce(F.get("p", F.lit(4)).try_cast("int"), F.lit(1))
    relations = parts.where((F.col("p")[0] == "relationship") & (F.size("p") >= 4)).select(key, "position", F.col("p")[1].alias("source"), F.col("p")[2].alias("target"), F.col("p")[3].alias("description"), strength.alias("strength"))
    return last, relations


def parsed_records(responses: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """As parsed_tuples(), of records that a line with a semicolon parts: four parts or more, all descriptions of a name in order
    of place as an array, and relationships (key, position, source, target, description, type), all of type connects_to."""
    records = responses.select(key, F.posexplode(F.split(F.trim(text), "\n;\n")).alias("position", "record"))
    bare = F.regexp_replace(F.regexp_replace("record", r"^\s+|\s+$", ""), r'^[()"]+|[()"]+$', "")
    parts = records.withColumn("p", F.split(bare, r"\|")).where(F.size("p") >= 4)
    at = lambda i: F.trim(F.col("p")[i])
    kind = F.lower(F.regexp_replace(F.col("p")[0], '^"+|"+$', ""))
    rows = parts.select(key, "position", kind.alias("_kind"), at(1).alias("one"), at(2).alias("two"), at(3).alias("description")).where("one <> '' and two <> ''")
    found = rows.where("_kind = 'entity'").withColumn("description", F.regexp_replace("description", r"^\)+|\)+$", ""))
    place = F.struct("position", "description")
    entities = found.groupBy(key, F.col("one").alias("name")).agg(F.min_by("two", "position").alias("type"), F.transform(F.sort_array(F.collect_list(place)), lambda x: x["description"]).alias("descriptions"))
    relations = rows.where("_kind = 'relationship'").select(key, "position", F.col("one").alias("source"), F.col("two").alias("target"), "description", F.lit("connects_to").alias("type"))
    return entities, relations


def parsed_listing(responses: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Entities (key, position, name, type, description) from lines `Name [Type]: text` below ENTITIES: and relationships (key,
    position, source, target, type, description) from lines `A [type] B: text` below RELATIONSHIPS:. Answers that lack a part give
    nothing; a missing description is empty."""
    whole = responses.where(F.contains(text, F.lit("ENTITIES:")) & F.contains(text, F.lit("RELATIONSHIPS:")))
    parts = F.split(text, "RELATIONSHIPS:")

    def lines(part: Column) -> DataFrame:
        return whole.select(key, F.posexplode(F.split(part, "\n")).alias("position", "line")).withColumn("line", F.trim("line"))

    entity, relation = r"^([^\[\]:]*)\[([^\]:]*)\][^:]*:(.*)$", r"^([^\[]*)\[([^\]]*)\]([^:\]]*)(?::(.*))?$"
    group = lambda pattern, i: F.trim(F.regexp_extract("line", pattern, i))
    found = lines(F.replace(parts[0], F.lit("ENTITIES:"), F.lit(""))).where(F.col("line").rlike(entity))
    entities = found.select(key, "position", group(entity, 1).alias("name"), group(entity, 2).alias("type"), group(entity, 3).alias("description"))
    found = lines(parts[1]).where(F.col("line").rlike(relation))
    return entities, found.select(key, "position", group(relation, 1).alias("source"), group(relation, 3).alias("target"), group(relation, 2).alias("type"), group(relation, 4).alias("description"))


def merged_entities(mentions: DataFrame, name: str, kind: str, description: str, chunk: str, order: str) -> DataFrame:
    """(name, type, summary, chunks): the first type wins; the first three distinct descriptions in order; chunks as a set."""
    firsts = mentions.groupBy(F.col(name).alias("name"), F.col(description).alias("d")).agg(F.min(order).alias("at"))
    ranked = firsts.where("d is not null").withColumn("_n", F.row_number().over(W.partitionBy("name").orderBy("at", "d"))).where("_n <= 3")
    summary = ranked.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "d"))), lambda x: x["d"]), " ").alias("summary"))
    merged = mentions.groupBy(F.col(name).alias("name")).agg(F.min_by(kind, order).alias("type"), F.count_distinct(chunk).alias("chunks"))
    return merged.join(summary, "name", "left")


def merged_relations(relations: DataFrame, chunk: str | None = None) -> DataFrame:
    """Strengths summed over equal (source, target, description); chunk: a column whose distinct values are listed in order."""
    lists = [F.sort_array(F.collect_set(chunk)).alias("chunks")] if chunk else []
    return relations.groupBy("source", "target", "description").agg(F.sum("strength").alias("strength"), F.count("*").alias("mentions"), *lists)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows by key, the latest by order wins."""
    rows = old.unionByName(new)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def resolved(edges: DataFrame, vertices: DataFrame, name: str) -> DataFrame:
    """Edges whose both ends are vertices."""
    ends = vertices.select(F.col(name).alias("_name")).distinct()
    return edges.join(ends, edges["source"] == ends["_name"], "left_semi").join(ends.toDF("_name"), F.col("target") == F.col("_name"), "left_semi")


def placed_claims(claims: DataFrame, vertices: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(claims whose subject is a vertex, their edges to vertices). claims: id, subject, object and more columns, the last
    wins where an id repeats (by order of updated); edges (claim, vertex, type): HAS_CLAIM from the subject, REFERS_TO the object
    where that is a vertex too."""
    ends = vertices.select(F.col(name).alias("_name")).distinct()
    last = claims.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("updated")))).where("_n = 1").drop("_n")
    kept = last.join(ends, last["subject"] == ends["_name"], "left_semi")
    edges = kept.select(F.col("id").alias("claim"), F.explode(F.array(F.struct(F.col("subject").alias("vertex"), F.lit("HAS_CLAIM").alias("type")), F.struct(F.col("object").alias("vertex"), F.lit("REFERS_TO").alias("type")))).alias("e")).select("claim", "e.*")
    return kept, edges.join(ends, F.col("vertex") == F.col("_name"), "left_semi")


def entities_named(vertices: DataFrame, name: str, value: str) -> DataFrame:
    return vertices.where(F.col(name) == value)


def entities_like(vertices: DataFrame, kind: str, part: str) -> DataFrame:
    """Those whose type holds the text."""
    return vertices.where(F.contains(kind, F.lit(part)))


def claims_of(claims: DataFrame, edges: DataFrame, vertex: str) -> DataFrame:
    """Claims with an edge to the vertex, with the types of these edges."""
    mine = edges.where(F.col("vertex") == vertex).groupBy(F.col("claim").alias("id")).agg(F.sort_array(F.collect_set("type")).alias("edges"))
    return claims.join(mine, "id")


def directed_paths(edges: DataFrame, vertices: DataFrame, start_type: str, end_type: str, hops: int = 3) -> DataFrame:
    """(names, types): directed walks of 1 to hops edges, none used twice, from vertices whose type holds one text to those whose
    type holds another. edges: source, target, type; vertices: name, type. Names and edge types along the way as arrays."""
    steps = edges.select("source", "target", F.col("type").alias("_type"), F.xxhash64("source", "target", "type").alias("_edge"))
    starts = entities_like(vertices, "type", start_type).select(F.col("name").alias("_at"), F.array("name").alias("names"))
    walk = starts.withColumn("types", F.array().cast("array<string>")).withColumn("_used", F.array().cast("array<long>"))
    ends = entities_like(vertices, "type", end_type).select(F.col("name").alias("_at")).distinct()
    found = None
    for _ in range(hops):
        step = walk.join(steps, F.col("_at") == F.col("source")).where(~F.array_contains("_used", F.col("_edge")))
        walk = step.select(F.col("target").alias("_at"), F.array_append("names", F.col("target")).alias("names"), F.array_append("types", F.col("_type")).alias("types"), F.array_append("_used", F.col("_edge")).alias("_used"))
        some = walk.join(ends, "_at", "left_semi").select("names", "types")
        found = some if found is None else found.unionByName(some)
    return found


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight): one edge for each pair that is joined either way, loops out."""
    pairs = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "strength")
    return pairs.groupBy("a", "b").agg(F.sum("strength").alias("weight"))


def paths_from(edges: DataFrame, start: list, hops: int) -> DataFrame:
    """(start, node, length, paths): undirected walks of up to hops edges that use no edge twice, counted by their end."""
    numbered = edges.select(F.xxhash64("source", "target").alias("edge"), "source", "target")
    both = numbered.select("edge", F.col("source").alias("from"), F.col("target").alias("to")).union(numbered.where("source <> target").select("edge", "target", "source"))
    spark = edges.sparkSession
    walk = spark.createDataFrame([(s, s) for s in start], both.schema.fields[1].dataType.simpleString().join(("start ", ", node ")) + both.schema.fields[1].dataType.simpleString()).withColumn("used", F.array().cast("array<long>"))
    found = None
    for length in range(1, hops + 1):
        step = walk.join(both, walk["node"] == both["from"]).where(~F.array_contains("used", F.col("edge")))
        walk = step.select("start", F.col("to").alias("node"), F.array_append("used", F.col("edge")).alias("used"))
        some = walk.groupBy("start", "node").agg(F.count("*").alias("paths")).withColumn("length", F.lit(length))
        found = some if found is None else found.unionByName(some)
    return found


def similar_names(names: DataFrame, name: str, kind: str) -> DataFrame:
    """(type, a, b) pairs of one type whose names match by same_name().

    Names of n and m words can match by words and edits only if o = ceil(5 (n + m) / 13) of them are shared, over five eighths of
    all, so they share two of the n - o + 2 and m - o + 2 rarest words of each; of names with over FEW_WORDS words one of the
    rarest. Otherwise one name holds the other and is less than twice as long, so it holds the rarest piece of that one, of the
    largest power of two of letters up to LONGEST_PIECE that fits it. Candidates meet by these, which are rare, and are held
    against each other where they meet; no pair of all is formed and none is missed.
    """
    base = names.select(F.col(kind).alias("type"), F.col(name).alias("n")).distinct().where("n is not null")
    base = cut(base.withColumn("plain", normal_name(F.col("n"))).withColumn("len", F.length("plain")))
    by_word = _sharing_words(base).where((4 * F.least("la", "lb") >= 3 * F.greatest("la", "lb")) & same_plain(F.col("pa"), F.col("pb")))
    held = _holding(base).where("a <> b and contains(pb, pa)")
    pairs = by_word.select("type", "a", "b").union(held.select("type", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs.distinct()


def _sharing_words(base: DataFrame) -> DataFrame:
    """(type, a, b, pa, pb, la, lb): names that share enough of their rarest words, a before b; a pair may come more than once."""
    words = base.select("*", F.explode(F.array_distinct(F.split("plain", " "))).alias("word"))
    spread = words.groupBy("type", "word").agg(F.count("*").alias("times"))
    listed = words.join(spread, ["type", "word"]).groupBy("type", "n", "plain", "len").agg(F.sort_array(F.collect_list(F.struct("times", "word"))).alias("words"))
    listed = listed.withColumn("words", F.transform("words", lambda x: x["word"])).withColumn("of", F.size("words"))
    few = listed.where(F.col("of") <= FEW_WORDS)
    # for each number of words that a partner may have, one or two of the rarest words as a key
    partner = F.sequence(F.ceil(F.col("of") * 5 / 8).cast("int"), F.least(F.lit(FEW_WORDS), F.floor(F.col("of") * 8 / 5).cast("int")))
    few = few.select("*", F.explode(partner).alias("m")).withColumn("o", F.ceil((F.col("of") + F.col("m")) * 5 / 13).cast("int")).where("o <= of and o <= m")
    first = F.slice("words", 1, F.col("of") - F.col("o") + F.least("o", F.lit(2)))
    two = F.flatten(F.transform(first, lambda x, i: F.transform(F.slice(first, i + 2, FEW_WORDS), lambda y: F.xxhash64(x, y))))
    # hashes of two words depend on their order, which is the same for all names of a type
    keys = F.when(F.col("o") == 1, F.transform(first, lambda x: F.xxhash64(x))).otherwise(two)
    few = few.select("type", "n", "plain", "len", "of", F.explode(keys).alias("key"), F.least("of", "m").alias("low"), F.greatest("of", "m").alias("high"))
    many = listed.where(F.col("of") >= F.ceil(F.lit((FEW_WORDS + 1) * 5 / 8)))
    many = many.select("type", "n", "plain", "len", "of", F.explode(F.slice("words", 1, F.col("of") - F.ceil(F.col("of") * 5 / 8).cast("int") + 1)).alias("key"))
    named = lambda df, to: df.withColumnsRenamed({"n": to, "plain": f"p{to}", "len": f"l{to}", "of": f"of_{to}"})
    short = named(few, "a").join(named(few, "b"), ["type", "key", "low", "high"]).where("a < b and least(of_a, of_b) = low and greatest(of_a, of_b) = high")
    long_ = named(many, "a").join(named(many, "b"), ["type", "key"]).where((F.col("a") < F.col("b")) & (F.greatest("of_a", "of_b") > FEW_WORDS))
    columns = ["type", "a", "b", "pa", "pb", "la", "lb"]
    return short.select(*columns).union(long_.select(*columns))


def _holding(base: DataFrame) -> DataFrame:
    """(type, a, b, pa, pb): names a and those that hold their rarest piece and are less than twice as long."""
    size = F.lit(1)
    for power in range(1, LONGEST_PIECE.bit_length()):
        size = F.when(F.col("len") >= 1 << power, 1 << power).otherwise(size)
    sized = base.where("len > 0").withColumn("piece", size)
    pieces = lambda df: df.select("*", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("len") - F.col("width") + 1), lambda i: F.xxhash64(F.substring("plain", i, F.col("width")))))).alias("key"))
    # a name that is held has over half of the letters, so its pieces are as long or half as long
    sizes = F.array_distinct(F.array("piece", F.greatest(F.lit(1), F.floor(F.col("piece") / 2).cast("int"))))
    index = pieces(sized.select("type", "n", "plain", "len", "piece", F.explode(sizes).alias("width")))
    times = index.groupBy("type", "width", "key").agg(F.count("*").alias("times"))
    rarest = index.where("width = piece").join(times, ["type", "width", "key"]).groupBy("type", "n", "plain", "len", "width").agg(F.min_by("key", F.struct("times", "key")).alias("key"))
    a = rarest.select("type", "width", "key", F.col("n").alias("a"), F.col("plain").alias("pa"), F.col("len").alias("la"))
    b = index.select("type", "width", "key", F.col("n").alias("b"), F.col("plain").alias("pb"), F.col("len").alias("lb"))
    return a.join(b, ["type", "width", "key"]).where("la <= lb and lb < 2 * la")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each node takes the heaviest label around it, ties to the smallest; edges: a, b, weight."""
    both = cut(edges.select("a", "b", "weight").union(edges.select("b", "a", "weight")))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, both["b"] == labels["node"]).groupBy("a", "community").agg(F.sum("weight").alias("w"))
        labels = cut(votes.groupBy(F.col("a").alias("node")).agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("community")))
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity): of a partition of an undirected weighted graph."""
    total = edges.agg((2 * F.sum("weight")).alias("m2"))
    a, b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    inside = edges.join(a, "a").join(b, "b").where("ca = cb").agg(F.coalesce(2 * F.sum("weight"), F.lit(0)).alias("inside"))
    degree = edges.select("a", "weight").union(edges.select("b", "weight")).toDF("node", "weight").groupBy("node").agg(F.sum("weight").alias("d"))
    squares = degree.join(labels, "node").groupBy("community").agg(F.sum("d").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("squares"))
    one = total.join(F.broadcast(inside)).join(F.broadcast(squares))  # each is one row
    return one.select((F.col("inside") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def local_moves(edges: DataFrame, rounds: int = 6, start: DataFrame | None = None) -> DataFrame:
    """(node, community) by greedy moves that raise modularity: in each round half of the nodes, by a hash that changes,
    move to the neighbouring community of the largest gain, so that two neighbours seldom swap places. Edges: a, b, weight;
    an edge from a node to itself counts twice for its degree. start: (node, community) to begin with; each node alone if not given."""
    both = cut(edges.select("a", "b", "weight").union(edges.where("a <> b").select("b", "a", "weight")))
    degree = cut(both.groupBy(F.col("a").alias("node")).agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("weight")).otherwise(F.col("weight"))).cast("double").alias("d")))
    m2 = degree.agg(F.sum("d")).first()[0] or 1.0
    nodes = degree.withColumn("community", F.col("node")) if start is None else cut(degree.join(start, "node").select("node", "d", "community"))
    for i in range(rounds):
        sums = nodes.groupBy("community").agg(F.sum("d").alias("total"))
        votes = both.where("a <> b").join(nodes.select(F.col("node").alias("b"), "community"), "b").select(F.col("a").alias("n"), "community", F.col("weight").cast("double").alias("w"))
        # a node's own community is always one to choose from, tied to it or not
        near = votes.union(nodes.select("node", "community", F.lit(0.0))).groupBy("n", "community").agg(F.sum("w").alias("w"))
        gain = near.join(nodes.select(F.col("node").alias("n"), F.col("community").alias("own"), "d"), "n").join(sums, "community")
        rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("d")).otherwise(0.0)
        gain = gain.withColumn("gain", F.col("w") - F.col("d") * rest / m2)
        best = gain.groupBy("n", "own", "d").agg(F.max_by("community", F.struct(F.round("gain", 9), F.when(F.col("community") == F.col("own"), 1).otherwise(0), -F.col("community"))).alias("best"))
        moved = F.when(F.pmod(F.xxhash64("n", F.lit(i)), F.lit(2)) == 0, F.col("best")).otherwise(F.col("own"))
        before, nodes = nodes, cut(best.select(F.col("n").alias("node"), "d", moved.alias("community")))
        released(before)
    if rounds:
        released(both, degree)
    return nodes.select("node", "community")


def louvain(edges: DataFrame, levels: int = 3, rounds: int = 6) -> DataFrame:
    """(node, community): local moves, then the communities as nodes whose edges are their summed edges, and so on until a level
    merges nothing. A community is named by its smallest node."""
    whole, held = edges, None
    for _ in range(levels):
        found = local_moves(edges, rounds)
        names = found.groupBy("community").agg(F.min("node").alias("name"))
        found = cut(found.join(names, "community").select("node", F.col("name").alias("community")))
        before, held = held, found if held is None else cut(held.join(found.toDF("community", "upper"), "community").select("node", F.col("upper").alias("community")))
        if before is not None:
            released(before)
        if found.where("node <> community").isEmpty():
            break
        a, b = found.toDF("a", "ca"), found.toDF("b", "cb")
        ends = edges.join(a, "a").join(b, "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "weight")
        before, edges = edges, cut(ends.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
        if before is not whole:
            released(before)
    return held


def refined(edges: DataFrame, labels: DataFrame, rounds: int = 6) -> DataFrame:
    """(node, part): each community cut into parts that are connected, the refinement of Leiden. All nodes begin alone; in each round
    half of those that are still alone, by a hash that changes, join the part next to them that raises modularity most. Only parts of
    their own community count, and only nodes and parts that are well tied to the rest of it. Whoever has been joined stays, so no
    part ever falls apart. A part is named by the node that it began with."""
    ends = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    both = edges.select("a", "b", "weight").union(edges.where("a <> b").select("b", "a", "weight"))
    degree = both.groupBy(F.col("a").alias("node")).agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("weight")).otherwise(F.col("weight"))).cast("double").alias("d"))
    nodes = cut(degree.join(labels, "node"))
    m2 = nodes.agg(F.sum("d")).first()[0] or 1.0
    inside = cut(both.where("a <> b").join(ends[0], "a").join(ends[1], "b").where("ca = cb").select("a", "b", F.col("weight").cast("double").alias("weight")))
    whole = nodes.groupBy("community").agg(F.sum("d").alias("whole"))
    tied = inside.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("w"))
    # nodes that are tied to the rest of their community as well as chance has it
    fit = cut(nodes.join(whole, "community").join(tied, "node").where(F.col("w") >= F.col("d") * (F.col("whole") - F.col("d")) / m2).select("node", "d"))
    parts = nodes.select("node", "community", "d", F.col("node").alias("part"))
    for i in range(rounds):
        draw = lambda c: F.pmod(F.xxhash64(c, F.lit(i), F.lit("refined")), F.lit(2)) == 0  # noqa: E731, B023
        sums = parts.groupBy("community", "part").agg(F.sum("d").alias("total"), F.count("*").alias("size"))
        place = cut(parts.select("node", "part"))
        ties = inside.join(place.toDF("b", "pb"), "b").groupBy("a", "pb").agg(F.sum("weight").alias("weight"))
        between = cut(ties.join(place.toDF("a", "pa"), "a").where("pa <> pb"))
        out = between.groupBy(F.col("pa").alias("part")).agg(F.sum("weight").alias("out"))
        open_ = sums.join(whole, "community").join(out, "part").where(F.col("out") >= F.col("total") * (F.col("whole") - F.col("total")) / m2)
        open_ = open_.where((F.col("size") > 1) | ~draw("part")).select(F.col("part").alias("pb"), "total")
        alone = sums.where((F.col("size") == 1) & draw("part")).select(F.col("part").alias("a"))
        near = between.join(alone, "a").groupBy("a", "pb").agg(F.sum("weight").alias("w")).join(open_, "pb").join(fit.withColumnRenamed("node", "a"), "a")
        gain = F.round(F.col("w") - F.col("d") * F.col("total") / m2, 9)
        best = near.where(gain > 0).groupBy("a").agg(F.max_by("pb", F.struct(gain.alias("g"), (-F.col("pb")).alias("n"))).alias("to"))
        before, parts = parts, cut(parts.join(best.withColumnRenamed("a", "node"), "node", "left").select("node", "community", "d", F.coalesce("to", "part").alias("part")))
        released(before, between, place)
    if rounds:
        released(nodes, inside, fit)
    return parts.select("node", "part")


def leiden(edges: DataFrame, levels: int = 3, rounds: int = 6, start: DataFrame | None = None) -> DataFrame:
    """(node, community): as louvain(), but the nodes of the next level are the refined parts of the communities, which begin it
    in the communities that they come from, so parts can part again. In the end a community that is not connected is cut into
    its connected groups, which raises modularity. Nodes are numbers; a community is named by its smallest node."""
    whole, held = edges, None  # held: node, and the part that it is in by now
    for _ in range(levels):
        found = cut(local_moves(edges, rounds, start))
        parts = refined(edges, found, rounds)
        names = parts.groupBy("part").agg(F.min("node").alias("name"))
        parts = cut(parts.join(names, "part").select("node", F.col("name").alias("part")))
        held = parts if held is None else cut(held.join(parts.toDF("part", "upper"), "part").select("node", F.col("upper").alias("part")))
        start = cut(parts.join(found, "node").select(F.col("part").alias("node"), "community").distinct())
        if parts.where("node <> part").isEmpty():
            break
        a, b = parts.toDF("a", "pa"), parts.toDF("b", "pb")
        ends = edges.join(a, "a").join(b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "weight")
        before, edges = edges, cut(ends.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
        if before is not whole:
            released(before)
    labels = cut(held.join(start.toDF("part", "community"), "part").select("node", "community"))
    inside = whole.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").where("ca = cb").select("a", "b")
    return linked_groups(inside.union(labels.select(F.col("node").alias("a"), F.col("node").alias("b")))).withColumnRenamed("group", "community")


def reported_communities(labels: DataFrame, least: int = 2) -> DataFrame:
    """(community, size) of at least that many members, largest first."""
    return labels.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least).orderBy(F.desc("size"), "community")


def community_summary(labels: DataFrame, vertices: DataFrame, node: str, kind: str, least: int = 2, top: int = 10) -> DataFrame:
    """(community, size, members, types): the largest communities with their first members and the types of these."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least).orderBy(F.desc("size"), "community").limit(top)
    named = labels.join(F.broadcast(sizes), "community").join(vertices.select(F.col(node).alias("node"), F.col(kind).alias("type")), "node")
    ranked = named.withColumn("_n", F.row_number().over(W.partitionBy("community").orderBy("node"))).where(F.col("_n") <= top)
    by_type = ranked.groupBy("community", "size", "type").agg(F.count("*").alias("n"), F.collect_list(F.struct("_n", "node")).alias("m"))
    return by_type.groupBy("community", "size").agg(
        F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("m"))), lambda x: x["node"].cast("string")), ",").alias("members"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.col("type").cast("string"), F.col("n").cast("string")))), ",").alias("types"),
    )


def linked_groups(edges: DataFrame) -> DataFrame:
    """(node, group): connected components of edges (a, b), named by their smallest node. Each round takes the smallest group
    around and then that group's own, so long chains shorten by half; hubs are only ever aggregated."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    groups = cut(both.select(F.col("a").alias("node")).distinct().withColumn("group", F.col("node")))
    while True:
        near = both.join(groups, both["b"] == groups["node"]).groupBy("a").agg(F.min("group").alias("near"))
        least = groups.join(near, groups["node"] == near["a"]).select("node", "group", F.least("group", "near").alias("least"))
        # what a whole group sees is its new name, and that group's name in turn
        sent = to = cut(least.groupBy("group").agg(F.min("least").alias("to")))
        onward = to.select(F.col("group").alias("to"), F.col("to").alias("onward"))
        to = to.join(onward, "to", "left").select("group", F.coalesce("onward", "to").alias("to"))
        moved = cut(groups.join(to, "group").select("node", F.col("to").alias("group"), (F.col("to") != F.col("group")).alias("moved")))
        last = moved.where("moved").isEmpty()
        released(groups, sent, *([both] if last else []))
        groups = moved.select("node", "group")
        groups._cut_folder = moved._cut_folder
        if last:
            return groups


def name_clusters(names: DataFrame, pairs: DataFrame, name: str, kind: str) -> DataFrame:
    """(type, name, canonical): longest names first take the names that match them and that none has taken; pairs is what
    similar_names() found, so only names that match some other are walked, one connected group of them after the other."""

    def walk(a: list[str], b: list[str]) -> list[tuple]:
        near: dict[str, set[str]] = {}
        for x, y in zip(a, b, strict=True):
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
        taken: dict[str, str] = {}
        for n in sorted(near, key=lambda n: (-len(n), n)):
            if n not in taken:
                taken[n] = n
                for other in near[n]:
                    taken.setdefault(other, n)
        return sorted(taken.items())

    ends = cut(pairs.select(F.col("type").cast("string").alias("type"), "a", "b"))
    tag = lambda c: F.to_json(F.struct("type", F.col(c).alias("n")))
    groups = linked_groups(ends.select(tag("a").alias("a"), tag("b").alias("b"))).select(F.col("node").alias("_a"), F.col("group"))
    placed = ends.withColumn("_a", tag("a")).join(groups, "_a").select("type", "group", "a", "b")
    found = folded(placed, ["type", "group"], "a", ["a", "b"], walk, "name string, canonical string").select("type", "name", "canonical")
    every = names.select(F.col(kind).cast("string").alias("type"), F.col(name).alias("name")).distinct()
    return every.join(found, ["type", "name"], "left").withColumn("canonical", F.coalesce("canonical", "name"))


def store_insights(labels: DataFrame, insights: DataFrame, path: str) -> None:
    """Writes (community, members, title, text) of every community that an insight tells of, community 0 too. insights: community,
    title, text; an insight without a title takes its first line."""
    members = labels.groupBy("community").agg(F.count("*").alias("members"))
    told = insights.withColumn("title", F.coalesce("title", F.split("text", "\n")[0]))
    told.where("community is not null").join(members, "community", "left").select("community", "members", "title", "text").write.mode("overwrite").parquet(path)


def without_organisations(graph: dict[str, DataFrame], organisations: DataFrame) -> dict[str, DataFrame]:
    """Tables by name without all that belongs to the organisations (id): users and vertices by organisation_id, edges by both of
    their ends. graph: organisations, users, vertices (name, organisation_id), edges (source, target)."""
    gone = organisations.select(F.col("id").alias("organisation_id")).distinct()
    kept = {k: graph[k].join(gone, "organisation_id", "left_anti") for k in ("users", "vertices")}
    ends = graph["vertices"].join(gone, "organisation_id", "left_semi").select(F.col("name").alias("_name")).distinct()
    edges = graph["edges"]
    for end in ("source", "target"):
        edges = edges.join(ends, edges[end] == ends["_name"], "left_anti")
    left = graph["organisations"].join(gone, F.col("id") == F.col("organisation_id"), "left_anti")
    return {"organisations": left, **kept, "edges": edges}


def asked_in_sql(graph: dict[str, DataFrame], text: str, args: dict | None = None) -> DataFrame:
    """Rows of a SQL text over the tables by name, with named parameters; the tables' views are gone again afterwards."""
    spark = next(iter(graph.values())).sparkSession
    for name, df in graph.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text, args=args or {})
    finally:
        for name in graph:
            spark.catalog.dropTempView(name)
