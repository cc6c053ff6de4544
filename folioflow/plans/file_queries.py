"""Queries over files that they write first, and over tables of files, rows, chunks and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.functions import values as vl
from folioflow.operators import chunking, graph_store, metadata, pages, postings, profile, sentences, spans, vectors
from folioflow.plans.lineage import cut, scratch
from folioflow.plans.queries import _files, _FILES, query
from folioflow.sources import csv, files, outbox, quoted, sinks, workbooks

# files -------------------------------------------------------------------------------------------------------------


def _written_csv(t):
    """Suppliers as semicolon-separated files, with quotes where a name holds one."""
    s = t("supplier").select("s_suppkey", F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, "; Ltd").otherwise("")).alias("s_name"), F.when(F.col("s_nationkey") != 3, F.col("s_nationkey")).alias("s_nationkey"))
    folder = scratch(s.sparkSession, "csv")
    s.repartition(2).write.csv(folder, sep=";", header=True)
    return s.sparkSession, folder


@query("""SELECT s_suppkey::VARCHAR AS key, s_name || CASE WHEN s_suppkey % 2 = 0 THEN '; Ltd' ELSE '' END AS name, CASE WHEN s_nationkey <> 3 THEN s_nationkey::VARCHAR END AS nation FROM supplier""")
def parsed_csv(t):
    rows = csv.parsed(*_written_csv(t))
    return rows.where("error is null and cells[0] <> 's_suppkey'").select(F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"), F.col("cells")[2].alias("nation"))


@query("""SELECT 's_suppkey' AS name, count(*) AS rows, count(*) AS filled, min(s_suppkey)::DOUBLE AS low, max(s_suppkey)::DOUBLE AS high FROM supplier
UNION ALL SELECT 's_name', count(*), count(*), NULL, NULL FROM supplier UNION ALL SELECT 's_nationkey', count(*), count(CASE WHEN s_nationkey <> 3 THEN 1 END), min(CASE WHEN s_nationkey <> 3 THEN s_nationkey END), max(CASE WHEN s_nationkey <> 3 THEN s_nationkey END) FROM supplier""")
def profiled_csv(t):
    found = csv.profiled(csv.parsed(*_written_csv(t)))
    return found.groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.min("low").alias("low"), F.max("high").alias("high"))


# other encodings can't be written by Spark; a test has them
_FORMS = [("utf-8", "UTF-8", ";"), ("latin-1", "ISO-8859-1", ","), ("utf-8", "UTF-8", "\t"), ("utf-16-le", "UTF-16LE", "|"), ("latin-1", "ISO-8859-1", "|")]


@query("""SELECT f.encoding, f.delimiter, count(*) AS rows, md5(string_agg(s_suppkey || ' Société Ñandú, über', '|' ORDER BY s_suppkey || ' ')) AS hash
FROM supplier CROSS JOIN (VALUES ('utf-8', ';'), ('latin-1', ','), ('utf-8', chr(9)), ('utf-16-le', '|'), ('latin-1', '|')) f(encoding, delimiter) GROUP BY 1, 2""")
def detected_forms(t):
    """Files of every encoding and delimiter; what is told of each, and the texts that it gives."""
    s, found = t("supplier"), None
    for _, java, sep in _FORMS:
        folder = scratch(s.sparkSession, "forms")
        s.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(" Société Ñandú, über")), "s_nationkey", "s_suppkey").repartition(2).write.csv(folder, sep=sep, encoding=java)
        told = csv.sniffed(s.sparkSession, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "encoding", "delimiter")
        rows = csv.parsed(s.sparkSession, folder).where("error is null").join(told, "file")
        some = rows.groupBy("encoding", "delimiter").agg(F.count("*").alias("rows"), F.md5(F.array_join(F.sort_array(F.collect_list(F.col("cells")[0])), "|")).alias("hash"))
        found = some if found is None else found.unionByName(some)
    return found


@query("""SELECT doc_id::VARCHAR AS doc_id, md5(coalesce(text, '')) AS hash, coalesce(lang, '') AS lang FROM documents""")
def scanned_csv(t):
    """Whole documents as quoted cells with their line breaks and quotes, in files that several tasks read each."""
    d = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    folder = scratch(d.sparkSession, "csv")
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    d.select(F.concat_ws(",", F.col("doc_id").cast("string"), quote("text"), quote("lang"))).write.text(folder)
    cells = F.col("cells")
    return quoted.scanned(d.sparkSession, folder).select(cells[0].alias("doc_id"), F.md5(cells[1]).alias("hash"), cells[2].alias("lang"))


@query("""SELECT col, count(*) AS filled, md5(string_agg(value, '|' ORDER BY value)) AS hash FROM (
SELECT 0 AS col, s_suppkey::VARCHAR AS value FROM supplier UNION ALL SELECT 2, CASE WHEN s_nationkey <> 3 THEN s_nationkey::VARCHAR END FROM supplier) WHERE value IS NOT NULL GROUP BY col""")
def workbook_columns(t):
    """Two of three columns of one of two sheets, from workbooks that tasks have written."""
    s = t("supplier").select("s_suppkey", F.concat(F.lit("<&> "), F.col("s_name")).alias("s_name"), F.when(F.col("s_nationkey") != 3, F.col("s_nationkey")).alias("s_nationkey"))
    folder = scratch(s.sparkSession, "workbooks").removeprefix("file:")
    workbooks.write(s, folder, "Suppliers")
    workbooks.write(s.select("s_name"), folder, "Names")
    found = workbooks.cells(s.sparkSession, folder, sheets=["Suppliers"], columns=[0, 2]).where("error is null and row > 0")
    return found.groupBy("col").agg(F.count("*").alias("filled"), F.md5(F.array_join(F.sort_array(F.collect_list("value")), "|")).alias("hash"))


@query("""SELECT 'text' AS kind, count(*) AS n, sum(len(trim(regexp_replace(text, '\\s+', ' ', 'g'))))::BIGINT AS characters FROM benchmark
UNION ALL SELECT 'json', count(*), sum(len(text))::BIGINT FROM benchmark UNION ALL SELECT 'csv', count(*), sum(len(n_nationkey || ', ' || n_name))::BIGINT FROM nation""")
def dispatched_texts(t):
    spark, folder = t("nation").sparkSession, scratch(t("nation").sparkSession, "texts")
    b = t("benchmark")
    b.repartition(b.count(), "item_id").select(F.regexp_replace("text", "\n", " ").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/txt")
    b.agg(F.to_json(F.collect_list(F.struct("item_id", "text"))).alias("value")).write.text(f"{folder}/json")
    t("nation").select("n_nationkey", "n_name").coalesce(1).write.csv(f"{folder}/csv")
    whole = [files.texts(spark, f"{folder}/{kind}").where("error is null") for kind in ("txt", "csv")]
    # a folder of Spark's text files has one name for all of them, so the JSON file is read under its own kind
    found = whole[0].unionByName(whole[1]).unionByName(files.json_chunks(spark, f"{folder}/json", "item_id long, text string").select(F.lit("f").alias("file"), F.lit("json").alias("kind"), F.lit(0).alias("position"), F.lit(None).cast("string").alias("part"), "text", F.lit(None).cast("string").alias("error")))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


@query("SELECT item_id, text FROM benchmark")
def json_chunks(t):
    b = t("benchmark")
    folder = scratch(b.sparkSession, "json")
    b.agg(F.to_json(F.collect_list(F.struct("item_id", "text"))).alias("value")).write.text(folder)
    return files.json_chunks(b.sparkSession, folder, "item_id long, text string")


# tables of files ---------------------------------------------------------------------------------------------------

_TREE = f"SELECT id, string_split(path, '/')[-1] AS name, 'org/' || string_split(path, '/')[2] AS folder, id % 9 = 0 AS is_folder, id % 2 = 0 AS processed, id % 3 = 0 AS chunked, id * 10 AS size FROM ({_FILES})"


def _tree(t):
    f = _files(t)
    p = F.col("path")
    return f.select("id", vl.basename(p).alias("name"), vl.parent(p).alias("folder"), (F.col("id") % 9 == 0).alias("is_folder"), (F.col("id") % 2 == 0).alias("processed"), (F.col("id") % 3 == 0).alias("chunked"), (F.col("id") * 10).alias("size"))


@query(f"""SELECT id, name FROM ({_TREE}) WHERE folder = 'org/src1' AND contains(lower(name), 'e') AND NOT is_folder AND (name LIKE '%.xlsx' OR name LIKE '%.xls') AND NOT coalesce(chunked, FALSE)""")
def files_in_folder(t):
    return metadata.in_folder(_tree(t), "org/src1", "e", "excel", chunked=False).select("id", "name")


@query(f"""WITH h AS (SELECT * FROM ({_TREE}) WHERE (folder = 'org' OR starts_with(folder, 'org/')) AND contains(lower(name), 'en_1')), n AS (SELECT * FROM h WHERE folder = 'org' OR (SELECT count(*) FROM h WHERE folder = 'org') < 5)
SELECT name, min(folder) AS folder FROM n GROUP BY 1 ORDER BY CASE WHEN lower(name) = 'en_1' THEN 0 WHEN starts_with(lower(name), 'en_1') THEN 1 ELSE 2 END, name LIMIT 10""")
def found_files(t):
    return metadata.found_files(_tree(t).select("name", "folder").distinct(), "name", "folder", "org", "en_1").select("name", "folder")


@query(f"""SELECT count(*) FILTER (NOT is_folder) AS files, count(*) FILTER (is_folder) AS folders, count(*) FILTER (NOT is_folder AND processed) AS processed, count(*) FILTER (NOT is_folder AND chunked) AS chunked,
sum(CASE WHEN NOT is_folder THEN size END)::BIGINT AS bytes, round(sum(CASE WHEN NOT is_folder THEN size END) / 1e9, 6) AS share FROM ({_TREE})""")
def file_totals(t):
    return metadata.file_totals(_tree(t), 10**9).withColumn("share", F.round("share", 6))


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), '1') OR contains(n_nationkey::VARCHAR, '1') ORDER BY n_name, n_nationkey LIMIT 3 OFFSET 3")
def table_search(t):
    return metadata.page(t("nation").select("n_nationkey", "n_name"), ["n_name", "n_nationkey"], 1, 3, "1")


# rows and chunks ---------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 OR s_nationkey <> 3")
def empty_rows(t):
    s = t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise(" ").alias("a"), F.when(F.col("s_nationkey") != 3, F.col("s_nationkey")).alias("b"))
    return profile.without_empty_rows(s, ["a", "b"]).select("s_suppkey")


_WIDTHS = "SELECT o_custkey, max(o_orderkey % 5 + 1)::INT AS w FROM orders GROUP BY 1"


@query(f"""SELECT o_orderkey, (SELECT string_agg('v', '|') FROM range(o_orderkey % 5 + 1)) || repeat('|-', w - (o_orderkey % 5 + 1)::INT) AS cells,
array_to_string((['a', 'b', 'c'] || ['column_4', 'column_5'])[1:w], '|') AS header FROM orders JOIN ({_WIDTHS}) USING (o_custkey)""")
def aligned_rows(t):
    o = t("orders").select("o_custkey", "o_orderkey", F.array_repeat(F.lit("v"), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("cells"))
    heads = o.select("o_custkey").distinct().withColumn("header", F.array(*map(F.lit, "abc")))
    rows, heads = profile.aligned_rows(o, "o_custkey", "cells", heads, "header")
    shown = F.array_join(F.transform("cells", lambda x: F.coalesce(x, F.lit("-"))), "|")
    return rows.join(heads, "o_custkey").select("o_orderkey", shown.alias("cells"), F.array_join("header", "|").alias("header"))


@query("""SELECT 'col_' || i AS "column", CASE i WHEN 0 THEN 'number' WHEN 1 THEN 'number' WHEN 2 THEN 'string' WHEN 3 THEN 'boolean' ELSE 'unknown' END AS kind FROM range(5) r(i)""")
def first_row_kinds(t):
    row = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", (F.col("o_orderkey") > 0).alias("flag"), "o_orderdate")
    return profile.first_row_kinds(row, "o_orderkey")


@query("""SELECT doc_id::VARCHAR AS chunk_id, md5(text) AS hash, source AS source_filename, kind AS source_type, CASE kind WHEN 'pdf' THEN 'start_char=' || doc_id WHEN 'csv' THEN 'row_start=' || doc_id % 7 ELSE '' END AS metadata
FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' ELSE 'other' END AS kind FROM documents)""")
def standard_chunks(t):
    d = t("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("\x00"), "text").alias("text"), F.col("source").alias("source_filename"), F.element_at(F.array(*map(F.lit, ("pdf", "csv", "other"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"), F.col("doc_id").alias("start_char"), (F.col("doc_id") % 7).alias("row_start"), F.lit(None).cast("int").alias("end_char"))
    found = metadata.standard_chunks(d, "kind")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.select("chunk_id", F.md5("text").alias("hash"), "source_filename", "source_type", shown.alias("metadata"))


@query("""SELECT label, CASE WHEN label = 2 THEN 'missing text' WHEN label = 3 THEN 'missing or unsound vector' ELSE 'vectors of different length' END AS error FROM (SELECT DISTINCT label FROM embeddings) WHERE label IN (2, 3, 4)""")
def storage_errors(t):
    first = F.row_number().over(vectors.W.partitionBy("label").orderBy("vec_id")) == 1
    v = t("embeddings").withColumn("first", first).withColumn("text", F.when(~((F.col("label") == 2) & F.col("first")), "x"))
    odd = F.when(F.col("first") & (F.col("label") == 3), F.transform("embedding", lambda x: F.lit(None).cast("float"))).when(F.col("first") & (F.col("label") == 4), F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    return metadata.storage_errors(v.withColumn("embedding", odd), "label", "text", "embedding")


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def stored_in_batches(t):
    """Two jobs of one store, one of them repeated, read from what has been published."""
    c = t("customer").select("c_custkey", "c_name", "c_acctbal")
    store = outbox.FolderStore(scratch(c.sparkSession, "outbox").removeprefix("file:"))
    for job, part in (("even", 0), ("odd", 1), ("even", 0)):
        outbox.stored(c.where(F.col("c_custkey") % 2 == part), store, job)
    read = c.sparkSession.read.schema("c_custkey long, c_name string, c_acctbal double").json(store.visible())
    return read.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("""SELECT 'entity' AS kind, c_custkey::VARCHAR AS chunk_id, 'c' || c_custkey AS name, NULL::VARCHAR AS target FROM customer UNION ALL SELECT 'relationship', c_custkey::VARCHAR, 'c' || c_custkey, 'n' || c_nationkey FROM customer""")
def graph_rows(t):
    c = t("customer").select(F.col("c_custkey").cast("string").alias("chunk_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target"), F.lit("in").alias("type"), F.lit("d").alias("description"))
    rows = sinks.graph_rows(c.select("chunk_id", "name", "type", "description"), c.select("chunk_id", F.col("name").alias("source"), "target", "type", "description"), "doc")
    return rows.select("kind", "chunk_id", "name", "target")


# text search -------------------------------------------------------------------------------------------------------

_W = "SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents"


@query(f"""SELECT doc_id, 'of the' AS phrase, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))::BIGINT AS n FROM ({_W}) WHERE n > 0
UNION ALL SELECT doc_id, 'the the the', len(list_filter(range(1, len(w) - 1), lambda i: w[i] = 'the' AND w[i + 1] = 'the' AND w[i + 2] = 'the'))::BIGINT AS n FROM ({_W}) WHERE n > 0
UNION ALL SELECT doc_id, 'und die*', len(list_filter(w, lambda x: starts_with(x, 'unge')))::BIGINT AS n FROM ({_W}) WHERE n > 0""")
def phrase_search(t):
    d = t("documents")
    index = cut(cut(postings.postings(d, "doc_id", "text")).sort("term"))  # a sort looks at its rows twice
    found = [("of the", postings.phrase(index, "of the")), ("the the the", postings.phrase(index, "The, the the!")), ("und die*", postings.prefix(index, "Unge"))]
    told = [f.select(F.col("key").alias("doc_id"), F.lit(name).alias("phrase"), "n") for name, f in found]
    return told[0].union(told[1]).union(told[2])


# graphs that grow ---------------------------------------------------------------------------------------------------

_ENTITY = "SELECT o_custkey::VARCHAR AS name, arg_max(o_orderstatus, o_orderkey) AS type, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = {0} GROUP BY 1"
_RELATED = "SELECT o.o_custkey::VARCHAR AS source, (o.o_custkey * 7 % 2000)::VARCHAR AS target, o_orderstatus AS type, o_orderpriority AS description, o_orderkey AS k, o_orderkey % 2 AS batch FROM orders o"
_BOTH = "source IN (SELECT o_custkey::VARCHAR FROM orders) AND target IN (SELECT o_custkey::VARCHAR FROM orders)"


def _store(t, one_per):
    """Customers as entities, imported twice."""
    o = t("orders")
    store = graph_store.GraphStore(o.sparkSession, scratch(o.sparkSession, "graph"), one_per, buckets=16)
    rows = o.select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("description"), F.lit("c").alias("chunk_id"), "o_orderkey")
    store.add_entities(rows.where("o_orderkey % 3 <> 1"), "o_orderkey")
    store.add_entities(rows.where("o_orderkey % 3 = 1"), "o_orderkey")
    return store


def _related(t):
    key = F.col("o_custkey")
    return t("orders").select(key.cast("string").alias("source"), (key * 7 % 2000).cast("string").alias("target"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("description"), F.lit(1).alias("strength"), F.lit("c").alias("chunk_id"), "o_orderkey")


@query(f"""SELECT name, type FROM ({_ENTITY.format(1)}) UNION ALL SELECT o_custkey::VARCHAR, arg_max(o_orderstatus, o_orderkey) FROM orders WHERE o_orderkey % 3 <> 1 AND o_custkey::VARCHAR NOT IN (SELECT name FROM ({_ENTITY.format(1)})) GROUP BY 1""")
def upserted_entities(t):
    return _store(t, "pair").entities.read().select("name", "type")


@query(f"""WITH r AS (SELECT * FROM ({_RELATED}) WHERE {_BOTH}) SELECT source, target, arg_max(type, (batch, k)) AS type, arg_max(description, (batch, k)) AS description FROM r GROUP BY 1, 2""")
def upserted_pairs(t):
    """One relation of two entities: the last."""
    store, r = _store(t, "pair"), _related(t)
    for batch in (0, 1):
        store.add_relations(r.where(F.col("o_orderkey") % 2 == batch), "o_orderkey")
    return store.relations.read().select("source", "target", "type", "description")


@query(f"""WITH r AS (SELECT * FROM ({_RELATED}) WHERE {_BOTH}) SELECT source, target, type, arg_min(description, (batch, k)) AS description FROM r GROUP BY 1, 2, 3""")
def upserted_types(t):
    """One relation of two entities and a type: the first."""
    store, r = _store(t, "type"), _related(t)
    for batch in (0, 1):
        store.add_relations(r.where(F.col("o_orderkey") % 2 == batch), "o_orderkey")
    return store.relations.read().select("source", "target", "type", "description")


@query(f"""WITH c AS (SELECT source AS subject, target AS object, type, description, k, batch, source || '_' || type || '_c' || k % 3 AS id FROM ({_RELATED}) WHERE source IN (SELECT o_custkey::VARCHAR FROM orders)),
e AS (SELECT DISTINCT id, object FROM c WHERE object IN (SELECT o_custkey::VARCHAR FROM orders))
SELECT id, arg_min(description, (batch, k)) AS description, (SELECT count(*) FROM e WHERE e.id = c.id) + 1 AS edges FROM c GROUP BY id""")
def upserted_claims(t):
    store, r = _store(t, "pair"), _related(t)
    claims = r.select(F.col("source").alias("subject"), F.col("target").alias("object"), "type", F.lit("open").alias("status"), "description", F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")).alias("chunk_id"), "o_orderkey")
    for batch in (0, 1):
        store.add_claims(claims.where(F.col("o_orderkey") % 2 == batch), "o_orderkey")
    edges = store.claim_edges.read().groupBy(F.col("claim").alias("id")).agg(F.count("*").alias("edges"))
    return store.claims.read().select("id", "description").join(edges, "id")


# expressions -------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, printf('%.1f%%', l_discount * 100) AS percent, printf('%.2f', CAST(l_quantity AS DOUBLE)) AS fixed FROM lineitem""")
def number_formats(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", vl.percentage(F.col("l_discount")).alias("percent"), vl.fixed(F.col("l_quantity")).alias("fixed"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, epoch_us(ts) // 1000 AS ms FROM events""")
def event_times(t):
    return t("events").select("event_id", vl.iso_time(F.col("ts")).alias("iso"), vl.epoch_milliseconds(F.col("ts")).alias("ms"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'projection' WHEN 2 THEN 'projection' ELSE 'other' END AS kind FROM part""")
def header_kinds(t):
    k = F.col("p_partkey")
    header = F.when(k % 4 == 0, (1990 + k % 40).cast("string")).when(k % 4 == 1, F.concat(F.lit("Sales forecast "), k.cast("string"))).when(k % 4 == 2, "PROYECCIÓN 2030").otherwise("Brand")
    return t("part").select("p_partkey", vl.header_kind(header).alias("kind"))


_MENDED = r"""array_to_string(list_transform(string_split(regexp_replace(text, '(?i)(página|page|seite|p\.|pg\.)\s*\d+\s*(de|of|von|sur|/)\s*\d+|\b\d+\s*(?:of|de|von|sur|/)\s*\d+\b', '', 'g'), ' '),
lambda w: CASE WHEN regexp_matches(w, '[\x{C2}-\x{F4}][\x{80}-\x{BF}]') AND NOT regexp_matches(w, '[^\x{00}-\x{FF}]') THEN coalesce(TRY(decode(from_hex(array_to_string(list_transform(string_split(w, ''), lambda c: printf('%02X', unicode(c))), '')))), w) ELSE w END), ' ')"""


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace({_MENDED}, 'Â', ''), '[^ -~\x{{A0}}-\x{{17F}}]', ' ', 'g'), '\s+', ' ', 'g'), '([\p{{L}}\p{{N}}_])-\s+([\p{{L}}\p{{N}}_])', '\1-\2', 'g'))) AS hash FROM documents""")
def clean_text(t):
    return t("documents").select("doc_id", F.md5(tx.clean_text(F.col("text"))).alias("hash"))


@query(r"""SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g'), '\s+([.,;:!?])', '\1', 'g'), '\s+', ' ', 'g'))) AS extracted, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\p{C}', '', 'g'), '\s+', ' ', 'g'))) AS scanned FROM conversations""")
def clean_pages(t):
    c = F.col("text")
    return t("conversations").select("conv_id", "turn", F.md5(tx.clean_extracted(c)).alias("extracted"), F.md5(tx.clean_scanned(c)).alias("scanned"))


@query()  # RE2 has no look-behind; a test has cases
def fine_sentences(t):
    return t("documents").select("doc_id", F.size(tx.fine_sentences(F.col("text"))).alias("n"), F.size(tx.sentences_in(F.col("text"), F.col("lang"))).alias("n_by_language"))


_TOKENS = r"""WITH t AS (SELECT doc_id, lang, unnest(tok) AS token, unnest(range(1, len(tok) + 1)) AS i, len(tok) AS k FROM
(SELECT doc_id, lang, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS tok FROM documents)),
p AS (SELECT *, CASE WHEN regexp_matches(body, '^[0-9][0-9.,]*$') THEN '##number##' ELSE lower(body) END AS type, body[1] <> lower(body[1]) AS upper FROM
(SELECT *, regexp_extract(token, '^[^\p{L}\p{N}]*(.*?)([.?!]*)[^\p{L}\p{N}.?!]*$', 1) AS body, regexp_extract(token, '^[^\p{L}\p{N}]*(.*?)([.?!]*)[^\p{L}\p{N}.?!]*$', 2) AS marks FROM t)),
w AS (SELECT * FROM p WHERE type <> ''),
total AS (SELECT lang, count(*)::DOUBLE AS tokens, count(*) FILTER (marks = '.')::DOUBLE AS points FROM w GROUP BY lang),
c AS (SELECT w.lang, type, count(*)::DOUBLE AS n, count(*) FILTER (marks = '.')::DOUBLE AS k, any_value(tokens) AS tokens, any_value(points) AS points FROM w JOIN total ON w.lang IS NOT DISTINCT FROM total.lang GROUP BY 1, 2),
l AS (SELECT *, len(replace(type, '.', '')) AS letters, CASE WHEN n > k THEN n - k ELSE 0 END AS bare FROM c WHERE k > 0 AND points < tokens AND regexp_matches(type, '\p{L}')),
short AS (SELECT lang, type, 2 * (k * ln(0.99) + bare * ln(0.01) - k * ln(points / tokens) - bare * ln(1 - points / tokens)) * exp(-letters) * (len(type) - letters + 1) * pow(letters::DOUBLE, -bare) AS score FROM l),
abbreviation AS (SELECT * FROM short WHERE score >= 0.3),
pair AS (SELECT a.lang, a.type, a.marks, b.type AS next FROM p AS a JOIN p AS b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.type <> '' AND b.type <> '' AND regexp_matches(a.token, '[.?!][^\p{L}\p{N}.?!,;:]*$')),
loose AS (SELECT pair.*, marks = '.' AND (x.type IS NOT NULL OR regexp_matches(pair.type, '^\p{L}$') OR pair.type = '##number##') AS loose FROM pair LEFT JOIN abbreviation AS x ON pair.lang IS NOT DISTINCT FROM x.lang AND pair.type = x.type)
"""


@query(_TOKENS + """SELECT lang AS language, type, round(score, 6) AS score FROM abbreviation""")
def learned_abbreviations(t):
    model = sentences.learned(t("documents"))
    return model.where("kind = 'abbreviation'").select("language", F.col("a").alias("type"), F.round("score", 6).alias("score"))


@query(_TOKENS + """, ends AS (SELECT lang, count(*)::DOUBLE AS a FROM loose WHERE NOT loose GROUP BY lang), begun AS (SELECT lang, next AS type, count(*)::DOUBLE AS ab FROM loose WHERE NOT loose AND next <> '##number##' GROUP BY 1, 2),
f AS (SELECT c.lang, c.type, a, n AS b, ab, tokens AS t FROM begun JOIN c ON begun.lang IS NOT DISTINCT FROM c.lang AND begun.type = c.type JOIN ends ON ends.lang IS NOT DISTINCT FROM c.lang WHERE ab * tokens > n * a),
g AS (SELECT lang, type, 2 * (ab * ln(ab / a) + CASE WHEN a > ab THEN (a - ab) * ln(1 - ab / a) ELSE 0 END + CASE WHEN b > ab THEN (b - ab) * ln((b - ab) / (t - a)) ELSE 0 END + CASE WHEN t - a > b - ab THEN (t - a - b + ab) * ln(1 - (b - ab) / (t - a)) ELSE 0 END
- ab * ln(b / t) - (a - ab) * ln(1 - b / t) - (b - ab) * ln(b / t) - (t - a - b + ab) * ln(1 - b / t)) AS score FROM f)
SELECT lang AS language, type, round(score, 4) AS score FROM g WHERE score >= 30""")
def sentence_starters(t):
    model = sentences.learned(t("documents"))
    return model.where("kind = 'starter'").select("language", F.col("a").alias("type"), F.round("score", 4).alias("score"))


@query()  # a test has the boundaries of texts with abbreviations that no list has
def learned_sentences(t):
    d = t("documents")
    found = sentences.split(d.select("doc_id", "lang", "text"), sentences.learned(d))
    return found.select("doc_id", "lang", F.size("sentences").alias("n"), F.md5(F.array_join("sentences", "\n")).alias("hash"))


# pages -------------------------------------------------------------------------------------------------------------

_SPANS = "SELECT l_orderkey AS document, 'f' || l_linenumber % 2 AS font, len(l_shipmode) AS n, CAST(l_quantity AS DOUBLE) AS size FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)"


@query(f"""SELECT document, round(sum(n * size) / sum(n), 6) AS mean_size, (SELECT arg_min(font, (-k, font)) FROM (SELECT font, sum(n) AS k FROM ({_SPANS}) i WHERE i.document = o.document GROUP BY 1)) AS font FROM ({_SPANS}) o GROUP BY 1""")
def font_statistics(t):
    s = t("lineitem").select(F.col("l_orderkey").alias("document"), F.concat(F.lit("f"), (F.col("l_linenumber") % 2).cast("string")).alias("font"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.col("l_quantity").cast("double").alias("size"))
    return spans.font_statistics(s, ["document"]).withColumn("mean_size", F.round("mean_size", 6))


@query("""WITH l AS (SELECT o_custkey AS document, o_orderkey AS line, o_orderstatus || o_orderkey AS text, CASE WHEN o_orderstatus = 'P' THEN 20.0 ELSE 10.0 END AS size FROM orders),
m AS (SELECT document, sum(len(text) * size) / sum(len(text)) AS m FROM l GROUP BY 1), h AS (SELECT l.*, size >= 1.15 * m AS heading FROM l JOIN m USING (document)),
n AS (SELECT *, sum(CASE WHEN heading AND NOT coalesce(before, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY document ORDER BY line) AS section FROM (SELECT *, lag(heading) OVER (PARTITION BY document ORDER BY line) AS before FROM h))
SELECT document, section::BIGINT AS section, coalesce(string_agg(CASE WHEN heading THEN text END, ' ' ORDER BY line), '') AS title, coalesce(string_agg(CASE WHEN NOT heading THEN text END, ' ' ORDER BY line), '') AS text FROM n GROUP BY 1, 2""")
def span_sections(t):
    o = t("orders").select(F.col("o_custkey").alias("document"), F.lit(1).alias("page"), F.col("o_orderkey").alias("line"), F.lit(0).alias("position"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("text"), F.lit("f").alias("font"), F.when(F.col("o_orderstatus") == "P", 20.0).otherwise(10.0).alias("size"), F.lit(False).alias("bold"))
    return spans.merged_paragraphs(o).select("document", "section", "title", "text")


@query("""WITH e AS (SELECT conv_id, turn, text FROM conversations), h AS (SELECT conv_id, turn, 'T' || turn AS title FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 3 = 0))
SELECT e.conv_id, e.turn, h.title, 'text' AS type, round(len(list_filter(regexp_split_to_array(e.text, '\\s+'), lambda x: x <> '')) / 200 * 60, 6) AS seconds FROM e ASOF LEFT JOIN h ON e.conv_id = h.conv_id AND e.turn >= h.turn""")
def enriched_chunks(t):
    c = t("conversations").select("conv_id", "turn", "text")
    heads = c.where("turn % 3 = 0").select("conv_id", "turn", F.concat(F.lit("T"), F.col("turn").cast("string")).alias("title")).distinct()
    return pages.enriched(c, heads, "conv_id", "turn", "text").select("conv_id", "turn", "title", "type", F.round("seconds", 6).alias("seconds"))


@query()  # as semantic_chunks
def limited_chunks(t):
    rows = t("conversations").withColumn("embedding", vectors.hashed_embedding(F.col("text"), 32))
    return chunking.limited_chunks(rows, "conv_id", "turn", "role", "text", "embedding")
