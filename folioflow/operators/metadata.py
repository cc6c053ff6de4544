"""Documents, chunks and files: the joins and filters that tie them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.values import basename, extension


def chunk_counts(chunks: DataFrame, documents: DataFrame, key: str, created: str, title: str) -> DataFrame:
    """(key, chunks, last_created, title) for documents that have chunks; a missing title is Unknown."""
    counts = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.max(created).alias("last_created"))
    return counts.join(documents.select(key, F.col(title).alias("title")), key, "left").withColumn("title", F.coalesce("title", F.lit("Unknown")))


def documents_with_counts(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Every document with its number of chunks, 0 if it has none."""
    counts = chunks.groupBy(key).agg(F.count("*").alias("chunks"))
    return documents.join(counts, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def listed_files(files: DataFrame, documents: DataFrame, path: str, document_path: str) -> DataFrame:
    """Stored files with the document of the same name, the last if several; other paths don't match."""
    docs = documents.withColumn("_base", basename(F.col(document_path))).withColumn("_n", F.row_number().over(W.partitionBy("_base").orderBy(F.desc("id")))).where("_n = 1").drop("_n")
    joined = files.withColumn("_base", basename(F.col(path))).join(docs, "_base", "left")
    return joined.where(F.col(document_path).isNull() | (F.col(document_path) == F.col(path))).drop("_base")


def search_names(df: DataFrame, name: str, text: str, cap: int = 10) -> DataFrame:
    """Names that hold a text: equal ones first, then those that start with it, then others."""
    low = F.lower(name)
    rank = F.when(low == text.lower(), 0).when(F.startswith(low, F.lit(text.lower())), 1).otherwise(2)
    rest = [c for c in df.columns if c != name]  # equal names in a fixed order
    return df.where(F.contains(low, F.lit(text.lower()))).withColumn("rank", rank).orderBy("rank", name, *rest).limit(cap)


def found_files(files: DataFrame, name: str, folder: str, here: str, text: str, enough: int = 5, cap: int = 10) -> DataFrame:
    """Files of a folder whose names hold a text, ranked as by search_names(); if they are fewer than enough, those of the folders
    below too. Of equal names the one nearest to the folder stays."""
    inside = files.where((F.col(folder) == here) | F.startswith(folder, F.lit(here.rstrip("/") + "/")))
    depth = F.size(F.split(folder, "/"))
    hits = inside.where(F.contains(F.lower(name), F.lit(text.lower()))).withColumn("_here", F.col(folder) == here)
    few = hits.agg((F.count_if("_here") < enough).alias("_few"))
    hits = hits.join(F.broadcast(few)).where("_here or _few").drop("_few")  # one row
    nearest = hits.withColumn("_n", F.row_number().over(W.partitionBy(name).orderBy(depth, folder))).where("_n = 1").drop("_n", "_here")
    return search_names(nearest, name, text, cap)


def in_folder(files: DataFrame, folder: str, text: str = "", kind: str = "all", processed: bool | None = None, chunked: bool | None = None) -> DataFrame:
    """What a folder shows: names that hold a text, of one kind (all, folder, pdf, excel, word, csv); files can be asked to be
    processed or chunked, or not to be, which folders pass. Placeholder files are hidden. files: name, folder, is_folder,
    processed, chunked."""
    kinds = {"pdf": [".pdf"], "excel": [".xlsx", ".xls"], "word": [".docx", ".doc"], "csv": [".csv"]}
    shown = files.where((F.col("folder") == folder) & (F.col("name") != ".folder") & F.contains(F.lower("name"), F.lit(text.lower())))
    if kind != "all":
        shown = shown.where(F.col("is_folder")) if kind == "folder" else shown.where(~F.col("is_folder") & extension(F.col("name")).isin(*kinds[kind]))
    for flag, wanted in (("processed", processed), ("chunked", chunked)):
        if wanted is not None:
            shown = shown.where(F.col("is_folder") | (F.coalesce(F.col(flag), F.lit(False)) == wanted))
    return shown


def file_totals(files: DataFrame, quota: int) -> DataFrame:
    """(files, folders, processed, chunked, bytes, share): of a file table; share: of the quota in bytes."""
    file = ~F.col("is_folder")
    size = F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0))
    return files.agg(
        F.count_if(file).alias("files"), F.count_if(F.col("is_folder")).alias("folders"), F.count_if(file & F.col("processed")).alias("processed"),
        F.count_if(file & F.col("chunked")).alias("chunked"), size.alias("bytes"), (size / F.lit(quota)).alias("share"),
    )


# What a chunk of each kind of source tells of its place.
PLACES = {
    "pdf": ["start_char", "end_char"], "text": ["start_char", "end_char"], "text_fallback": ["start_char", "end_char"],
    "excel": ["sheet_name", "row_start", "row_end"], "csv": ["row_start", "row_end", "delimiter"], "docx": ["section_heading"],
}


def standard_chunks(chunks: DataFrame, kind: str) -> DataFrame:
    """(chunk_id, text, source_filename, source_type, metadata): text without NUL characters; metadata holds the places that the
    kind of source has, as text, without nulls; a missing chunk_id is a hash of file and text. chunks: chunk_id, text,
    source_filename, kind and any of the places."""
    known = sorted({p for ps in PLACES.values() for p in ps} & set(chunks.columns))
    entry = lambda p: F.struct(F.lit(p).alias("key"), F.col(p).cast("string").alias("value"))
    wanted = lambda p: F.col(kind).isin(*(k for k, ps in PLACES.items() if p in ps))
    entries = F.array_compact(F.array(*(F.when(wanted(p) & F.col(p).isNotNull(), entry(p)) for p in known))) if known else F.array().cast("array<struct<key:string,value:string>>")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\x00"), F.lit(""))
    own = F.coalesce("chunk_id", F.sha2(F.concat_ws("\x00", "source_filename", "text"), 256))
    return chunks.select(own.alias("chunk_id"), text.alias("text"), "source_filename", F.col(kind).alias("source_type"), F.map_from_entries(entries).alias("metadata"))


#: Bytes of a batch that a store takes at once, and of all that a request may hold.
BATCH_BYTES, REQUEST_BYTES = 8 << 20, 200 << 20


def storage_errors(chunks: DataFrame, document: str, text: str, embedding: str) -> DataFrame:
    """(document, error): why the chunks of a document can't be stored, the first reason of: no document, a missing text, a
    missing vector or one with a missing number, vectors of different length, over REQUEST_BYTES in all."""
    vector = F.col(embedding)
    bad = vector.isNull() | (F.size(vector) == 0) | F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    facts = chunks.groupBy(document).agg(
        F.count_if(F.col(text).isNull()).alias("_texts"), F.count_if(bad).alias("_vectors"), F.min(F.size(vector)).alias("_least"), F.max(F.size(vector)).alias("_most"),
        F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 8 * F.coalesce(F.size(vector), F.lit(0))).alias("_bytes"),
    )
    error = (
        F.when(F.col(document).isNull(), "no document").when(F.col("_texts") > 0, "missing text").when(F.col("_vectors") > 0, "missing or unsound vector")
        .when(F.col("_least") != F.col("_most"), "vectors of different length").when(F.col("_bytes") > REQUEST_BYTES, "too large")
    )
    return facts.select(document, error.alias("error")).where("error is not null")


def of_type(df: DataFrame, path: str, extensions: list[str]) -> DataFrame:
    return df.where(extension(F.col(path)).isin(*extensions))


def parser_for(path: Column) -> Column:
    """Which reader a file goes to."""
    e = extension(path)
    kinds = {"excel": [".xlsx", ".xls"], "csv": [".csv"], "docx": [".docx", ".doc"], "pptx": [".pptx"], "pdf": [".pdf"], "json": [".json"], "xml": [".xml"]}
    out = F.lit("text")
    for kind, ends in kinds.items():
        out = F.when(e.isin(*ends), kind).otherwise(out)
    return out


def folders_first(df: DataFrame, is_folder: str, key: str, descending: bool = False) -> DataFrame:
    return df.orderBy(F.desc(is_folder), F.desc(key) if descending else F.asc(key))


def page(df: DataFrame, order: list[str], number: int, size: int, text: str = "") -> DataFrame:
    """One page of rows in a total order, of those that hold a text in any column if one is given."""
    if text:
        hits = [F.contains(F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit(text.lower())) for c in df.columns]
        df = df.where(F.greatest(*hits) if len(hits) > 1 else hits[0])
    return df.orderBy(*order).offset(number * size).limit(size)


def nearest_before(rows: DataFrame, marks: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """rows with the value of the last mark at or before their position: one sort of both together, no range join."""
    both = rows.select(key, position, F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(marks.schema[value].dataType).alias("_value"))
    both = both.unionByName(marks.select(key, position, F.lit(0).alias("_kind"), F.col(value).alias("_value")), allowMissingColumns=True)
    last = F.last("_value", ignorenulls=True).over(W.partitionBy(key).orderBy(position, "_kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn(value, last).where("_kind = 1").select("_row.*", value)


def not_overlapping(boxes: DataFrame, others: DataFrame, page_key: str, cell: float = 64.0) -> DataFrame:
    """Boxes (x0, y0, x1, y1) that overlap no other box on their page. Boxes are held against those that lie in the same cells of
    a grid only; cell: its size, about that of a usual box."""

    def gridded(df: DataFrame) -> DataFrame:
        steps = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
        return df.select("*", steps("x0", "x1").alias("_x")).select("*", steps("y0", "y1").alias("_y"))

    key = F.struct(*boxes.columns)
    a, b = gridded(boxes.withColumn("_box", key)).alias("a"), gridded(others).alias("b")
    meets = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (page_key, "_x", "_y")] + [F.col("a.x0") < F.col("b.x1"), F.col("a.x1") > F.col("b.x0"), F.col("a.y0") < F.col("b.y1"), F.col("a.y1") > F.col("b.y0")]
    hit = a.join(b, meets, "left_semi").select("_box").distinct()
    return boxes.withColumn("_box", key).join(hit, "_box", "left_anti").drop("_box")


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Parents with an ordered array of their children, empty if they have none."""
    grouped = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("items"))
    return parents.join(grouped, key, "left").withColumn("items", F.coalesce("items", F.array().cast(grouped.schema["items"].dataType)))


def visible_rows(df: DataFrame, organisation: str, members: DataFrame, user: Column, roles: list[str] | None = None) -> DataFrame:
    """Rows of the organisations that a user belongs to, in one of the roles if given."""
    mine = members.where(members["user_id"] == user)
    mine = mine.where(F.col("role").isin(*roles)) if roles else mine
    return df.join(mine.select(F.col("organisation_id").alias(organisation)), organisation, "left_semi")


def key_terms(df: DataFrame, text: str, top: int, least: int = 3, most: int = 15) -> DataFrame:
    """(term, n): the most frequent words of letters, ties to the earlier in the alphabet."""
    found = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{{least},{most}}}"), F.lit(0))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def keywords(df: DataFrame, text: str, stop_words: list[str]) -> DataFrame:
    """(term, n): words of over two letters that are no stop words."""
    found = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))).alias("term"))
    return found.where(F.col("term").rlike("^[a-z]+$") & (F.length("term") > 2) & ~F.col("term").isin(*stop_words)).groupBy("term").agg(F.count("*").alias("n"))


def chunk_errors(chunk_id: Column, text: Column, section: Column, kind: Column, score: Column, level: Column) -> Column:
    """What is wrong with a chunk, as an array of messages."""
    need = [F.when(c.isNull(), f"missing {n}") for c, n in ((chunk_id, "id"), (text, "text"), (section, "section"), (kind, "type"))]
    return F.array_compact(F.array(*need, F.when(~score.between(0, 1), "score outside 0 to 1"), F.when(level.isNull(), "level is no integer")))


def run_summary(runs: DataFrame, failed: Column, count: str) -> DataFrame:
    """(total, succeeded, failed, entities) of a table of runs."""
    return runs.agg(F.count("*").alias("total"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.sum(F.when(~failed, F.col(count))).alias("entities"))
