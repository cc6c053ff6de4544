"""Queries over the test tables, one for each operator that they can show, with SQL to hold against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.functions import values as vl
from folioflow.operators import charts, chunking, graph, languages, metadata, pages, profile, projections, tables, vectors
from folioflow.plans.lineage import cut
from folioflow.sources import csv, markup, sinks
from folioflow.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query (a function of a table reader) under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(name: str, places: int = 4):
    return F.round(name, places).alias(name)


# charts ------------------------------------------------------------------------------------------------------------


@query("""SELECT p_brand AS category, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 20""")
def bar_top20(t):
    sold = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return charts.bars(sold, "p_brand", "l_extendedprice").select("category", _r("value", 2))


@query("""SELECT CASE WHEN (SELECT min(day(o_orderdate)) <> max(day(o_orderdate)) OR min(month(o_orderdate)) = max(month(o_orderdate)) FROM orders)
THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m') END AS label, o_totalprice AS value FROM orders
WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL""")
def line_series(t):
    return charts.line(t("orders"), "o_orderdate", "o_totalprice").select("label", "value")


_SHARE_SUMS = "SELECT p_type AS category, sum(p_retailprice) AS s FROM part WHERE p_type IS NOT NULL GROUP BY 1"


@query(f"""WITH g AS ({_SHARE_SUMS}), r AS (SELECT *, sum(s) OVER () AS total, row_number() OVER (ORDER BY s DESC, category) AS n FROM g)
SELECT category, round(100 * s / total, 4) AS value FROM r WHERE n <= 8 AND total > 0
UNION ALL SELECT 'Other', round(100 - sum(CASE WHEN n <= 8 THEN 100 * s / total ELSE 0 END), 4) FROM r HAVING count(*) > 8 AND max(total) > 0""")
def donut_share(t):
    return charts.shares(t("part"), "p_type", "p_retailprice").select("category", _r("value"))


@query(f"""WITH g AS ({_SHARE_SUMS}), r AS (SELECT *, sum(s) OVER () AS total, row_number() OVER (ORDER BY s DESC, category) AS n FROM g)
SELECT category, round(s, 2) AS value, round(100 * s / total, 2) AS share FROM r WHERE n <= 8""")
def pie_top8(t):
    return charts.pie(t("part"), "p_type", "p_retailprice").select("category", _r("value", 2), "share")


@query("""WITH g AS (SELECT c_mktsegment AS category, sum(c_acctbal) AS value FROM customer GROUP BY 1),
s AS (SELECT *, CASE WHEN max(value) OVER () = min(value) OVER () THEN 0.5 ELSE (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) END AS scaled FROM g)
SELECT category, round(value, 2) AS value, round(scaled, 4) AS scaled, CASE WHEN scaled <= .1 THEN 1 WHEN scaled <= .3 THEN 2 WHEN scaled <= .5 THEN 3 WHEN scaled <= .7 THEN 4 ELSE 5 END AS band FROM s""")
def heatmap_cards(t):
    return charts.heat_cards(t("customer"), "c_mktsegment", "c_acctbal").select("category", _r("value", 2), _r("scaled"), "band")


@query("SELECT o_orderkey AS row, o_orderpriority AS name, o_totalprice AS value FROM orders ORDER BY 1 LIMIT 20")
def bar_series_first20(t):
    return charts.series(t("orders"), "o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT p_partkey AS row, p_brand AS name, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, 10 AS z FROM part ORDER BY 1 LIMIT 50")
def scatter_first50(t):
    return charts.scatter(t("part"), "p_partkey", "p_brand", "p_size", "p_retailprice")


@query("""WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)
SELECT CASE WHEN a = b THEN a - greatest(abs(b) * .01, 1) WHEN (b - a) / b < .005 THEN a - (b - a) ELSE 0 END AS low,
round(CASE WHEN a = b THEN b + greatest(abs(b) * .01, 1) WHEN (b - a) / b < .005 THEN b + (b - a) ELSE b * 1.05 END, 4) AS high FROM e""")
def axis_domain(t):
    return charts.axis_domain(t("orders"), "o_totalprice").select("low", _r("high"))


@query("""WITH l AS (SELECT event_type AS "group", arg_max(value, ts) AS last FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT "group", step, round(last * pow(1.05, step), 4) AS value FROM l, (SELECT unnest([1, 2, 3, 4, 5]) AS step)""")
def projection_steps(t):
    return charts.projected(t("events"), "event_type", "ts", "value", 5, 5).select("group", "step", _r("value"))


@query("SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS scenario FROM orders")
def scenario_column(t):
    return charts.scenario(t("orders"), "o_totalprice", 10).select("o_orderkey", _r("scenario"))


@query("""SELECT event_type AS "group", CASE WHEN count(value) = 0 THEN 'allNull' WHEN min(CASE WHEN value <> 0 THEN 0 ELSE 1 END) = 1 THEN 'allZero' ELSE 'mixed' END AS status FROM events GROUP BY 1""")
def series_status(t):
    return charts.series_status(t("events"), "event_type", "value")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def first_row_per_key(t):
    return charts.first_of_each(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("""WITH u AS (UNPIVOT (SELECT CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) ON p_size, p_retailprice INTO NAME metric VALUE value),
e AS (SELECT metric, min(value) AS low, max(value) AS high FROM u GROUP BY 1)
SELECT metric, value, CAST(CASE WHEN high = low THEN 1 ELSE least(5, CAST(floor((value - low) / (high - low) * 5) AS INT) + 1) END AS INT) AS band FROM u JOIN e USING (metric)""")
def metric_bands(t):
    return charts.quantile_bands(t("part").select(F.col("p_size").cast("double"), "p_retailprice"), ["p_size", "p_retailprice"])


@query("SELECT strftime(o_orderdate, '%Y-%m') AS label, month(o_orderdate) AS m, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def month_sort(t):
    by = t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("label"), F.month("o_orderdate").alias("m"))
    return by.agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy("m", "label")


# profiles and cleaning ---------------------------------------------------------------------------------------------


@query("""WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME "column" VALUE value)
SELECT "column", count(value) AS non_null, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std FROM u GROUP BY 1""")
def column_stats(t):
    found = profile.column_statistics(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return found.select("column", "non_null", "min", "max", _r("mean"), _r("median"), _r("std"))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, .25) AS a, quantile_cont(o_totalprice, .75) AS b FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN o_totalprice END AS o_totalprice FROM orders, q""")
def iqr_outliers(t):
    return profile.without_outliers(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])


@query("""WITH u AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer)
SELECT "column", count(value) / count(*) AS filled, count(DISTINCT value) / count(value) AS "unique" FROM u GROUP BY 1""")
def column_ratios(t):
    return profile.column_ratios(t("customer"), ["c_mktsegment", "c_nationkey"])


@query("""SELECT * FROM (VALUES ('o_orderkey', 'numeric'), ('o_orderstatus', 'categorical'), ('o_totalprice', 'numeric'), ('o_orderdate', 'date'), ('o_orderpriority', 'categorical')) AS v("column", "class")""")
def classified_columns(t):
    return profile.classified_columns(t("orders"), ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])


@query("""SELECT * FROM (VALUES ('l_quantity', 'long'), ('l_discount', 'double'), ('l_returnflag', 'string')) AS v("column", kind)""")
def numeric_kinds(t):
    return profile.numeric_kinds(t("lineitem"), ["l_quantity", "l_discount", "l_returnflag"])


_YEARS = "SELECT o_orderpriority, year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2"


@query(f"""SELECT o_orderpriority, CAST(y AS VARCHAR) AS "Year", round(s, 2) AS "Value" FROM ({_YEARS}) WHERE s IS NOT NULL""")
def melt_years(t):
    wide = t("orders").withColumn("y", F.year("o_orderdate").cast("string")).groupBy("o_orderpriority").pivot("y").agg(F.sum("o_totalprice"))
    return profile.melted_years(wide, "o_orderpriority").select("o_orderpriority", "Year", _r("Value", 2))


@query("SELECT n_name FROM nation WHERE lower(trim(n_name)) NOT IN ('total', 'sum', 'subtotal', 'sub total', 'grand total')")
def summary_row_filter(t):
    return profile.without_summary_rows(t("nation"), "n_name").select("n_name")


@query("""SELECT DISTINCT c_nationkey AS key, c_mktsegment AS name, 'customer' AS source_sheet FROM customer
UNION SELECT DISTINCT s_nationkey, s_name, 'supplier' FROM supplier""")
def merged_sheets(t):
    sheets = {"customer": t("customer").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("name")), "supplier": t("supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"))}
    return profile.merged_sheets(sheets)["customer_supplier"]


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def duplicate_rows(t):
    return t("orders").select("o_orderstatus", "o_orderpriority").dropDuplicates()


@query("""SELECT c_custkey, CASE WHEN c_acctbal <> 0 THEN c_acctbal END AS balance FROM customer""")
def nan_to_null(t):
    return t("customer").select("c_custkey", vl.nan_to_null(F.when(F.col("c_acctbal") == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))).alias("balance"))


@query("""SELECT event_id, CAST(regexp_extract(regexp_replace(props, '[^0-9.-]', '', 'g'), '^-?([0-9]+[.]?[0-9]*|[.][0-9]+)', 0) AS DOUBLE) AS value FROM events""")
def leading_numbers(t):
    return t("events").select("event_id", vl.leading_number(F.col("props")).alias("value"))


# joins and metadata ------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey AS key, count(*) AS chunks, max(l_shipdate) AS last_created, coalesce(min(o_orderpriority), 'Unknown') AS title
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def chunked_files(t):
    chunks = t("lineitem").select(F.col("l_orderkey").alias("key"), "l_shipdate")
    return metadata.chunk_counts(chunks, t("orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority"), "key", "l_shipdate", "o_orderpriority")


@query("SELECT c_custkey AS key, count(o_orderkey) AS chunks FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def graph_files(t):
    return metadata.documents_with_counts(t("customer").select(F.col("c_custkey").alias("key")), t("orders").select(F.col("o_custkey").alias("key")), "key")


_FILES = "SELECT doc_id AS id, 'org/' || source || '/' || lang || '_' || doc_id % 100 || '.' || CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'CSV' ELSE 'docx' END AS path FROM documents"


def _files(t):
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "xlsx", "CSV", "docx"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t("documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("org/"), "source", F.lit("/"), "lang", F.lit("_"), (F.col("doc_id") % 100).cast("string"), F.lit("."), kind).alias("path"))


@query(f"""WITH f AS ({_FILES}), d AS (SELECT id, path AS document_path, string_split(path, '/')[-1] AS b FROM f WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY string_split(path, '/')[-1] ORDER BY id DESC) = 1)
SELECT f.path, d.id, d.document_path FROM f LEFT JOIN d ON string_split(f.path, '/')[-1] = d.b WHERE d.document_path IS NULL OR d.document_path = f.path""")
def list_tree(t):
    files = _files(t)
    return metadata.listed_files(files.select("path"), files.where("id % 2 = 0").select("id", F.col("path").alias("document_path")), "path", "document_path")


@query(f"""SELECT path, string_split(path, '/')[-1] AS base, lower('.' || string_split(path, '.')[-1]) AS ext, 'org/' || string_split(path, '/')[2] AS parent,
CASE lower(string_split(path, '.')[-1]) WHEN 'pdf' THEN 'pdf' WHEN 'xlsx' THEN 'excel' WHEN 'csv' THEN 'csv' ELSE 'docx' END AS parser FROM ({_FILES})""")
def path_parts(t):
    p = F.col("path")
    return _files(t).select("path", vl.basename(p).alias("base"), vl.extension(p).alias("ext"), vl.parent(p).alias("parent"), metadata.parser_for(p).alias("parser"))


@query(f"SELECT id, path FROM ({_FILES}) WHERE lower(string_split(path, '.')[-1]) IN ('xlsx', 'xls', 'csv')")
def files_of_type(t):
    return metadata.of_type(_files(t), "path", [".xlsx", ".xls", ".csv"])


@query("""SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'ring' THEN 0 WHEN lower(p_name) LIKE 'ring%' THEN 1 ELSE 2 END AS rank FROM part
WHERE lower(p_name) LIKE '%ring%' ORDER BY 3, 2, 1 LIMIT 10""")
def search_ranking(t):
    return metadata.search_names(t("part").select("p_partkey", "p_name"), "p_name", "ring")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name, n_nationkey LIMIT 5 OFFSET 10")
def table_page(t):
    return metadata.page(t("nation").select("n_nationkey", "n_name"), ["n_name", "n_nationkey"], 2, 5)


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filter_by_ids(t):
    keys = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").join(keys, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def unlinked_entities(t):
    return t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT e.event_id, h.event_id AS header FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1) h
ON e.user_id = h.user_id AND e.ts >= h.ts WHERE e.event_type <> 'view'""")
def nearest_header(t):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    marks = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.min("event_id").alias("header"))
    return metadata.nearest_before(e.where("event_type <> 'view'"), marks, "user_id", "ts", "header").select("event_id", "header")


_BOXES = "SELECT p_partkey AS id, p_size AS page, p_partkey % 97 AS x0, p_partkey % 97 + 3 AS x1, p_partkey % 89 AS y0, p_partkey % 89 + 3 AS y1 FROM part"


@query(f"""SELECT a.id FROM ({_BOXES}) a WHERE a.id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM ({_BOXES}) b WHERE b.id % 2 = 1 AND a.page = b.page AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0)""")
def boxes_apart(t):
    k = F.col("p_partkey")
    boxes = t("part").select(k.alias("id"), F.col("p_size").alias("page"), (k % 97).alias("x0"), (k % 97 + 3).alias("x1"), (k % 89).alias("y0"), (k % 89 + 3).alias("y1"))
    return metadata.not_overlapping(boxes.where("id % 2 = 0"), boxes.where("id % 2 = 1"), "page").select("id")


@query("""SELECT n_nationkey, coalesce(count(s_suppkey), 0) AS n, coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey), '') AS items FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1""")
def nested_children(t):
    found = metadata.nested(t("nation").select("n_nationkey"), t("supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", "s_suppkey", ["s_acctbal"])
    return found.select("n_nationkey", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x["s_suppkey"].cast("string")), ",").alias("items"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def row_level_security(t):
    members = t("nation").select(F.col("n_nationkey").alias("organisation_id"), F.col("n_regionkey").alias("user_id"), F.lit("editor").alias("role"))
    return metadata.visible_rows(t("customer"), "c_nationkey", members, F.lit(2), ["editor", "admin"]).select("c_custkey")


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'F') AS failed, sum(CASE WHEN o_orderstatus <> 'F' THEN o_custkey END)::BIGINT AS entities FROM orders""")
def run_summary(t):
    return metadata.run_summary(t("orders"), F.col("o_orderstatus") == "F", "o_custkey")


@query("""WITH c AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS s, value / 50 AS score FROM events)
SELECT event_id, CASE WHEN s IS NULL THEN 'missing section' END AS e1, CASE WHEN NOT score BETWEEN 0 AND 1 THEN 'score outside 0 to 1' END AS e2 FROM c""")
def chunk_errors(t):
    section = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    errors = metadata.chunk_errors(F.col("event_id"), F.col("event_type"), section, F.col("event_type"), F.col("value") / 50, F.lit(1))
    has = lambda x: F.when(F.array_contains("e", x), x)
    return t("events").select("event_id", errors.alias("e")).select("event_id", has("missing section").alias("e1"), has("score outside 0 to 1").alias("e2"))


@query("SELECT r_regionkey AS key FROM region UNION SELECT n_regionkey FROM nation")
def union_distinct(t):
    return t("region").select(F.col("r_regionkey").alias("key")).union(t("nation").select("n_regionkey")).distinct()


@query("SELECT p_partkey % 100 AS key, p_size AS size FROM part EXCEPT SELECT s_suppkey % 100, s_nationkey FROM supplier")
def set_difference(t):
    return t("part").select((F.col("p_partkey") % 100).alias("key"), F.col("p_size").alias("size")).subtract(t("supplier").select(F.col("s_suppkey") % 100, "s_nationkey"))


@query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(t):
    return t("customer").select(F.col("c_nationkey").alias("key")).intersect(t("supplier").select("s_nationkey"))


@query("SELECT lang, source, doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def ordered_limit(t):
    return t("documents").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("lang", "source", "doc_id")


# text --------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\\s.,!?;:''"()-]', '', 'g'), '\\s+', ' ', 'g'))) AS clean FROM documents""")
def plain_text(t):
    return t("documents").select("doc_id", F.md5(tx.plain_characters(F.col("text"))).alias("clean"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS hash FROM s""")
def sentence_split(t):
    return t("documents").select("doc_id", tx.sentences(F.col("text"), tx.AROUND).alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("hash"))


# the real list, and words that these texts hold
_TOPIC = {**tx.RELEVANCE_KEYWORDS, "en": ["the", "of", "with it"], "de": ["und", "der", "und", "mit mit"]}
_LISTED = [k.lower() for group in _TOPIC.values() for k in group]
_HITS = " + ".join(f"len(list_filter(w, lambda x: x = '{k}'))" if " " not in k else f"(len(l) - len(replace(l, '{k}', ''))) // {len(k)}" for k in _LISTED)
_SCORED = f"""least(1, ({_HITS}) / (ln(n + 1) + 1) * 0.3)"""
_WORDS = """lower({0}) AS l, regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+') AS w, len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')) AS n"""


@query(f"""SELECT doc_id, CASE WHEN n > 0 THEN round({_SCORED}, 6) ELSE 0 END AS score FROM (SELECT doc_id, {_WORDS.format("text")} FROM documents)""")
def topic_relevance(t):
    return tx.with_relevance(t("documents").select("doc_id", "text"), "text", "score", _TOPIC).select("doc_id", F.round("score", 6).alias("score"))


_SCANNED = [k.lower() for group in tx.SCANNED_KEYWORDS.values() for k in group]
_SCANNED_HITS = " + ".join(f"len(list_filter(w, lambda x: x = '{k}'))" if k.isalpha() else f"(len(l) - len(replace(l, '{k}', ''))) // {len(k)}" for k in _SCANNED)
_SCANNED_ROWS = "SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' GHG, Anti-Bribery work' WHEN 1 THEN ' human rights; a board' WHEN 2 THEN ' boards and workers' ELSE '' END AS text FROM documents"


@query(f"""SELECT doc_id, CASE WHEN n > 0 THEN round(least(1, ({_SCANNED_HITS}) / (ln(n + 1) + 1) * 0.3), 6) ELSE 0 END AS score FROM (SELECT doc_id, {_WORDS.format("text")} FROM ({_SCANNED_ROWS}))""")
def scanned_relevance(t):
    k = F.col("doc_id") % 4
    more = F.when(k == 0, " GHG, Anti-Bribery work").when(k == 1, " human rights; a board").when(k == 2, " boards and workers").otherwise("")
    rows = t("documents").select("doc_id", F.concat("text", more).alias("text"))
    return tx.with_relevance(rows, "text", "score", tx.SCANNED_KEYWORDS).select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 3 = 0), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, turn, least(floor(turn * n / (max(turn) OVER (PARTITION BY conv_id) + 1)), n - 1)::BIGINT AS place FROM h JOIN n USING (conv_id)""")
def placed_headers(t):
    c = t("conversations")
    return chunking.placed_headers(c.where("turn % 3 = 0").select("conv_id", "turn").distinct(), c, "conv_id", "turn", "place")


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
c AS (SELECT doc_id, n::INT AS chunk, array_to_string(s[n * 5 + 1:n * 5 + 5], ' ') AS text FROM (SELECT *, unnest(range(0, CAST(ceil(len(s) / 5.0) AS BIGINT))) AS n FROM s))
SELECT doc_id, chunk, len(text)::INT AS characters, CASE WHEN n > 0 THEN round({_SCORED}, 6) ELSE 0 END AS score FROM (SELECT doc_id, chunk, text, {_WORDS.format("text")} FROM c)""")
def chunk_relevance(t):
    chunks = chunking.sentence_chunks(t("documents"), "doc_id", "text", 5)
    scored = tx.with_relevance(chunks, "chunk", "score", _TOPIC)
    return scored.select("doc_id", F.col("n").alias("chunk"), "characters", F.round("score", 6).alias("score"))


@query("""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,15}')) AS term FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def metadata_keywords(t):
    return metadata.key_terms(t("documents"), "text", 20)


@query(f"""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM conversations) WHERE regexp_full_match(term, '[a-z]+') AND len(term) > 2 AND term NOT IN ({", ".join(f"'{w}'" for w in tx.STOP_WORDS)}) GROUP BY 1""")
def stop_worded_keywords(t):
    return metadata.keywords(t("conversations"), "text", tx.STOP_WORDS)


@query("SELECT doc_id, sha256(text) AS hash, CAST(floor(len(text) / 3.5) AS BIGINT) AS tokens FROM documents")
def content_hash(t):
    return t("documents").select("doc_id", tx.content_hash(F.col("text")).alias("hash"), tx.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS similarity
FROM (SELECT n_nationkey, n_regionkey, list_distinct(string_split(lower(n_name), '')) AS x FROM nation) a JOIN (SELECT n_nationkey, n_regionkey, list_distinct(string_split(lower(n_name), '')) AS y FROM nation) b
ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def character_similarity(t):
    n = t("nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a"), F.col("n_name").alias("na")), n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.col("n_name").alias("nb"))
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", F.round(tx.character_similarity(F.col("na"), F.col("nb")), 6).alias("similarity"))


@query("""SELECT item_id, mode, target, size FROM (SELECT item_id, pages, s, CASE WHEN pages <= 5 THEN 'fine' WHEN pages <= 20 THEN 'moderate' ELSE 'coarse' END AS mode,
CASE WHEN pages <= 5 THEN pages * 4 WHEN pages <= 20 THEN pages * 3 ELSE pages * 2 END::INT AS target, greatest(2, least(8, floor(s / greatest(1, CASE WHEN pages <= 5 THEN pages * 4 WHEN pages <= 20 THEN pages * 3 ELSE pages * 2 END))))::INT AS size
FROM (SELECT p_partkey AS item_id, p_size AS pages, p_partkey % 300 AS s FROM part))""")
def adaptive_plan(t):
    plan = chunking.chunk_plan(F.col("p_size"), F.col("p_partkey") % 300)
    return t("part").select(F.col("p_partkey").alias("item_id"), plan.alias("p")).select("item_id", "p.mode", "p.target", "p.size")


def _chunk_end(start: str) -> str:
    """SQL for the end of the chunk of a text t of length l that starts there."""
    low, high = f"greatest({start} + 500, {start} + 300)", f"least({start} + 700, l)"
    found = f"list_transform(list_filter(range(1, len(substr(t, {low} + 1, {high} - ({low})))), lambda p: substr(t, {low} + 1, {high} - ({low}))[p] IN ('.', '!', '?') AND regexp_matches(substr(t, {low} + 1, {high} - ({low}))[p + 1], '\\s')), lambda p: {low} + p + 1)"
    return f"CASE WHEN {start} + 600 >= l THEN l ELSE coalesce(list_max(list_filter({found}, lambda e: e <= {start} + 602)), list_min({found}), {start} + 600) END"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, len(text) AS l FROM documents WHERE len(text) > 0), c AS (SELECT doc_id, t, l, 0 AS n, 0::BIGINT AS a, {_chunk_end("0")} AS b FROM d
UNION ALL SELECT doc_id, t, l, n + 1, s, {_chunk_end("s")} FROM (SELECT *, greatest(b - 200, a + 1) AS s FROM c WHERE b < l))
SELECT doc_id, n::INT AS n, a::INT AS "start", b::INT AS "end", md5(substr(t, a + 1, b - a)) AS hash FROM c""")
def character_chunks(t):
    return chunking.character_chunks(t("documents"), "doc_id", "text").select("doc_id", "n", "start", "end", F.md5("chunk").alias("hash"))


@query("""WITH RECURSIVE r AS (SELECT o_custkey AS c, o_orderkey, length(o_orderpriority) + 2 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT c, i, n, 0 AS chunk, 20 + n AS used, 1 AS held FROM r WHERE i = 1 UNION ALL
SELECT r.c, r.i, r.n, CASE WHEN held >= 4 OR used + r.n > 60 THEN chunk + 1 ELSE chunk END, CASE WHEN held >= 4 OR used + r.n > 60 THEN 20 + r.n ELSE used + r.n END, CASE WHEN held >= 4 OR used + r.n > 60 THEN 1 ELSE held + 1 END FROM f JOIN r ON r.c = f.c AND r.i = f.i + 1)
SELECT c AS o_custkey, chunk, min(i)::INT AS row_start, max(i)::INT AS row_end, max(used)::INT AS characters FROM f GROUP BY 1, 2""")
def packed_rows(t):
    return chunking.packed_rows(t("orders"), "o_custkey", "o_orderkey", "o_orderpriority", 20, 4, 60)


@query("""SELECT l_orderkey, l_linenumber, CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 3 AS INT) AS batch, CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) % 3 + 1 AS INT) AS place FROM lineitem""")
def row_batches(t):
    return chunking.row_batches(t("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 3)


@query("""SELECT s_nationkey, 'Headers: Name, Nation' || chr(10) || string_agg('Row ' || n || ': Name: ' || s_name || ', Nation: ' || s_nationkey, chr(10) ORDER BY n) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) GROUP BY 1""")
def row_texts(t):
    rows = chunking.row_batches(t("supplier").select("s_nationkey", "s_suppkey", "s_name"), "s_nationkey", "s_suppkey", 1_000_000_000)
    line = chunking.row_text(["Name", "Nation"], ["s_name", "s_nationkey"], F.col("place"))
    lines = rows.groupBy("s_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    return lines.select("s_nationkey", chunking.chunk_text(["Name", "Nation"], F.col("lines")).alias("text"))


@query("""WITH v AS (SELECT 'p_name' AS "column", sum(len(p_name)) AS volume FROM part UNION ALL SELECT 'p_brand', sum(len(p_brand)) FROM part UNION ALL SELECT 'p_type', sum(len(p_type)) FROM part)
SELECT "column", volume::BIGINT AS volume, CAST((row_number() OVER (ORDER BY volume DESC, "column") - 1) % 2 AS INT) AS part FROM v""")
def column_groups(t):
    return chunking.column_groups(t("part"), ["p_name", "p_brand", "p_type"], 2)


_HEADS = "SELECT conv_id, turn, 1 + (turn * 7 + conv_id) % 3 AS level, 's' || turn AS title FROM conversations"


@query(f"""WITH h AS (SELECT DISTINCT * FROM ({_HEADS})), l AS (SELECT a.conv_id, a.turn, a.level, a.title,
(SELECT max(b.turn) FROM h b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND b.level = 1) AS t1,
(SELECT max(b.turn) FROM h b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND b.level = 2) AS t2 FROM h a)
SELECT conv_id, turn, concat_ws(' > ', CASE WHEN t1 IS NOT NULL THEN 's' || t1 END, CASE WHEN level >= 2 AND t2 IS NOT NULL AND (t1 IS NULL OR t2 > t1) THEN 's' || t2 END, CASE WHEN level = 3 THEN title END) AS full_path FROM l""")
def section_paths(t):
    heads = t("conversations").select("conv_id", "turn", (1 + (F.col("turn") * 7 + F.col("conv_id")) % 3).alias("level"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("title")).distinct()
    return chunking.section_paths(heads, "conv_id", "turn", "level", "title", 3).select("conv_id", "turn", "full_path")


_TITLE = " OR ".join(f"regexp_matches(text, '{p}')" for p in chunking.TITLES)


@query(f"""WITH l AS (SELECT doc_id, i - 1 AS position, regexp_replace(x[i], '^\\s+|\\s+$', '', 'g') AS text, len(x) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
h AS (SELECT * FROM l WHERE {_TITLE})
SELECT doc_id, position::INT AS position, text, CASE WHEN regexp_matches(text, '\\d+\\.\\d+') THEN 2 ELSE 1 END AS level FROM h
UNION ALL SELECT doc_id, position::INT, 'Section ' || position // 300, 1 FROM l WHERE doc_id NOT IN (SELECT doc_id FROM h) AND n > 50 AND position > 0 AND position % 300 = 0""")
def header_lines(t):
    return chunking.header_lines(t("documents"), "doc_id", "text")


@query("""SELECT doc_id, CASE WHEN len(trim(text)) < 10 THEN 'en' WHEN len(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 30 THEN CASE WHEN len(regexp_replace(text, '[^áéíóúüñÁÉÍÓÚÜÑ¿¡]', '', 'g')) >= 3 THEN 'es' ELSE 'en' END END AS lang FROM documents""")
def language_by_marks(t):
    return t("documents").select("doc_id", tx.language_by_marks(F.col("text")).alias("lang"))


_SCORES = ", ".join(
    "round(" + " + ".join([*(f"len(list_filter(w, lambda x: x = '{w}')) * {v!r}" for w, v in words.items()), *([f"len(regexp_replace(l, '[^{languages.LETTERS[code]}]', '', 'g')) / 2"] if code in languages.LETTERS else [])]) + f", 6) AS s{i}"
    for i, (code, words) in enumerate(languages.weights().items())
)
_MARKED = """CASE WHEN len(trim(text)) < 10 THEN 'en' WHEN len(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 30 THEN CASE WHEN len(regexp_replace(text, '[^áéíóúüñÁÉÍÓÚÜÑ¿¡]', '', 'g')) >= 3 THEN 'es' ELSE 'en' END END"""


@query(f"""WITH r AS (SELECT doc_id, text, lower(text) AS l, regexp_extract_all(lower(text), '[\\p{{L}}]+') AS w FROM documents), s AS (SELECT doc_id, text, l, {_SCORES} FROM r),
b AS (SELECT *, greatest({", ".join(f"s{i}" for i in range(len(languages.WORDS)))}) AS top FROM s)
SELECT doc_id, coalesce({_MARKED}, CASE WHEN top = 0 THEN CASE WHEN len(regexp_replace(l, '[^áéíóúñ¿¡]', '', 'g')) >= 3 THEN 'es' ELSE 'en' END WHEN s0 = top THEN 'en' WHEN s1 = top THEN 'es' WHEN s2 = top THEN 'fr' WHEN s3 = top THEN 'de' WHEN s4 = top THEN 'pt' ELSE 'es' END) AS language FROM b""")
def languages_by_words(t):
    return languages.with_language(t("documents").select("doc_id", "text"), "text").select("doc_id", "language")


@query("""SELECT o_orderkey, CASE WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.1fk', v / 1e3) ELSE printf('%.1f', v) END AS short FROM (SELECT o_orderkey, floor(o_totalprice / 100) * 100 AS v FROM orders)""")
def short_numbers(t):
    return t("orders").select("o_orderkey", vl.short_number(F.floor(F.col("o_totalprice") / 100) * 100.0).alias("short"))


# vectors -----------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT q.vec_id AS query, v.vec_id AS match, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query, match, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, match)::INT AS rank FROM s QUALIFY rank <= 10""")
def cosine_top10(t):
    v = t("embeddings")
    return vectors.top_k(v, v.where("vec_id % 100 = 0"), "vec_id", "vec_id", "embedding", 10).select("query", "match", _r("score", 6), "rank")


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings")
def vector_length(t):
    v = t("embeddings").withColumn("u", vectors.normalised("embedding"))
    return v.select("vec_id", F.round(vectors.norm("embedding") * vectors.norm("u"), 6).alias("length"))


@query("""SELECT label, vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], b::DOUBLE[]), 6) AS change FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL""")
def adjacent_change(t):
    return vectors.adjacent(t("embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", _r("change", 6))


@query("""SELECT label, i::INT AS position, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2""")
def centroids(t):
    return vectors.centroids(t("embeddings"), "label", "embedding").select("label", "position", _r("mean", 6))


@query()  # CRC-32 is not in the SQL; a test computes it
def hashed_embeddings(t):
    return t("conversations").select("conv_id", "turn", vectors.hashed_embedding(F.col("text"), 32).alias("embedding"))


@query()  # means of vectors that depend on where the last chunk ended; a test holds it against a plain loop
def semantic_chunks(t):
    rows = t("conversations").withColumn("embedding", vectors.hashed_embedding(F.col("text"), 32))
    return chunking.semantic_chunks(rows, "conv_id", "turn", "text", "embedding")


# graph -------------------------------------------------------------------------------------------------------------

_EDGES = "SELECT l_suppkey AS source, l_partkey + 1000000 AS target, l_returnflag AS description, CAST(l_quantity AS BIGINT) AS strength, l_orderkey AS chunk FROM lineitem"


def _edges(t):
    return t("lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 1000000).alias("target"), F.col("l_returnflag").alias("description"), F.col("l_quantity").cast("long").alias("strength"), F.col("l_orderkey").alias("chunk"))


@query(f"SELECT source, target, description, sum(strength)::BIGINT AS strength, count(*) AS mentions, string_agg(DISTINCT chunk::VARCHAR, ',' ORDER BY chunk::VARCHAR) AS chunks FROM ({_EDGES}) GROUP BY 1, 2, 3")
def merged_relations(t):
    found = graph.merged_relations(_edges(t), "chunk")
    return found.withColumn("chunks", F.array_join(F.array_sort(F.col("chunks").cast("array<string>")), ","))


@query(f"SELECT least(source, target) AS a, greatest(source, target) AS b, sum(strength)::BIGINT AS weight FROM ({_EDGES}) WHERE source <> target GROUP BY 1, 2")
def graph_projection(t):
    return graph.undirected(_edges(t))


@query("""WITH m AS (SELECT l_partkey AS name, l_returnflag AS type, 'q' || CAST(l_quantity AS INT) AS d, l_orderkey, l_orderkey * 10 + l_linenumber AS spot FROM lineitem),
f AS (SELECT name, d, row_number() OVER (PARTITION BY name ORDER BY min(spot), d) AS n FROM m GROUP BY 1, 2 QUALIFY n <= 3)
SELECT m.name, arg_min(type, spot) AS type, count(DISTINCT l_orderkey) AS chunks, (SELECT string_agg(d, ' ' ORDER BY n) FROM f WHERE f.name = m.name) AS summary FROM m GROUP BY 1""")
def merged_entities(t):
    rows = t("lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rows = rows.withColumn("d", F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")))
    return graph.merged_entities(rows, "l_partkey", "l_returnflag", "d", "l_orderkey", "at").select("name", "type", "chunks", "summary")


@query("""SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1""")
def upsert_latest(t):
    o = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return graph.upserted(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query(f"SELECT source, target, strength FROM ({_EDGES}) WHERE source IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND target IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 UNION SELECT p_partkey + 1000000 FROM part WHERE p_size > 25)")
def resolved_edges(t):
    names = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("name")).union(t("part").where("p_size > 25").select(F.col("p_partkey") + 1000000))
    return graph.resolved(_edges(t), names, "name").select("source", "target", "strength")


_SUPPLIED = "SELECT DISTINCT l_partkey AS source, l_suppkey + 1000000000000 AS target FROM lineitem"


def _supplied(t):
    """Which part comes from which supplier."""
    return t("lineitem").select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 1000000000000).alias("target")).distinct()


@query(f"""WITH RECURSIVE e AS ({_SUPPLIED}), b AS (SELECT source || '-' || target AS id, source AS f, target AS g FROM e UNION ALL SELECT source || '-' || target, target, source FROM e),
w AS (SELECT 3::BIGINT AS start, 3::BIGINT AS node, [] :: VARCHAR[] AS used, 0 AS length UNION ALL SELECT w.start, b.g, list_append(w.used, b.id), w.length + 1 FROM w JOIN b ON w.node = b.f WHERE w.length < 3 AND NOT list_contains(w.used, b.id))
SELECT start, node, length, count(*) AS paths FROM w WHERE length > 0 GROUP BY 1, 2, 3""")
def hop_paths(t):
    return graph.paths_from(_supplied(t), [3], 3)


_NAMES = "SELECT DISTINCT p_brand AS type, p_name || CASE p_partkey % 4 WHEN 0 THEN 's' WHEN 1 THEN ' ' || p_size WHEN 2 THEN ' Ltd' ELSE '' END AS n FROM part"


def _names(t):
    """Names of parts and variants of them."""
    k = F.col("p_partkey") % 4
    variant = F.concat("p_name", F.when(k == 0, "s").when(k == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(k == 2, " Ltd").otherwise(""))
    return t("part").select(F.col("p_brand").alias("type"), variant.alias("n")).distinct()


@query(f"""WITH n AS ({_NAMES}), x AS (SELECT a.type, a.n AS a, b.n AS b, lower(a.n) AS la, lower(b.n) AS lb FROM n a JOIN n b ON a.type = b.type AND a.n < b.n)
SELECT type, a, b FROM x WHERE la = lb OR ((contains(la, lb) OR contains(lb, la)) AND least(len(la), len(lb)) / greatest(len(la), len(lb)) > .5)
OR 0.6 * (1 - levenshtein(la, lb) / greatest(len(la), len(lb))) + 0.4 * len(list_intersect(string_split(la, ' '), string_split(lb, ' '))) / len(list_distinct(list_concat(string_split(la, ' '), string_split(lb, ' ')))) >= 0.85""")
def similar_names(t):
    return graph.similar_names(_names(t), "n", "type")


def _propagated(rounds: int) -> str:
    steps = [f"e AS MATERIALIZED (SELECT a, b, weight FROM u UNION ALL SELECT b, a, weight FROM u), l0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS community FROM e)"]
    for i in range(rounds):
        steps.append(f"v{i} AS MATERIALIZED (SELECT a, community, sum(weight) AS w FROM e JOIN l{i} ON b = node GROUP BY 1, 2), l{i + 1} AS MATERIALIZED (SELECT a AS node, arg_min(community, (-w, community)) AS community FROM v{i} GROUP BY 1)")
    return f"WITH u AS MATERIALIZED (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(strength)::BIGINT AS weight FROM ({_EDGES}) WHERE source <> target GROUP BY 1, 2), {', '.join(steps)} SELECT node, community FROM l{rounds}"


@query(_propagated(3))
def label_propagation(t):
    return graph.label_propagation(graph.undirected(_edges(t)), 3)


def _projected(t):
    edges = _edges(t)
    held, name = projections.Projections(edges.sparkSession), f"p{uuid.uuid4().hex}"
    held.create(name, edges, 16)
    return held, name


@query(_propagated(3))
def projected_propagation(t):
    """Over a named projection, dropped again afterwards."""
    held, name = _projected(t)
    labels = held.label_propagation(name, 3)
    held.drop(name)
    return labels


@query(f"""WITH u AS (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(strength) AS weight FROM ({_EDGES}) WHERE source <> target GROUP BY 1, 2), n AS (SELECT a AS node FROM u UNION ALL SELECT b FROM u)
SELECT (SELECT count(DISTINCT node) FROM n) AS nodes, (SELECT count(*) FROM u) AS edges, (SELECT sum(weight)::DOUBLE FROM u) AS weight, (SELECT max(k) FROM (SELECT count(*) AS k FROM n GROUP BY node)) AS largest""")
def projection_stats(t):
    held, name = _projected(t)
    stats = cut(held.stats(name))
    held.drop(name)
    return stats


_REGIONS = f"SELECT source % 5 AS x, a, b, weight FROM (SELECT least(source, target) AS a, greatest(source, target) AS b, min(source) AS source, sum(strength) AS weight FROM ({_EDGES}) WHERE source <> target GROUP BY 1, 2)"


@query(f"""WITH e AS ({_REGIONS}), m AS (SELECT 2 * sum(weight) AS m2 FROM e), d AS (SELECT node % 5 AS c, sum(weight) AS d FROM (SELECT a AS node, weight FROM e UNION ALL SELECT b, weight FROM e) GROUP BY 1)
SELECT round((SELECT 2 * sum(weight) FROM e WHERE a % 5 = b % 5) / m2 - (SELECT sum(d * d) FROM d) / (m2 * m2), 6) AS modularity FROM m""")
def modularity(t):
    edges = graph.undirected(_edges(t)).withColumn("weight", F.col("weight").cast("double"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return graph.modularity(edges, nodes.withColumn("community", F.col("node") % 5)).select(_r("modularity", 6))


@query()  # moves depend on Spark's hash; a test holds its modularity against brute force
def local_moves(t):
    return graph.local_moves(graph.undirected(_supplied(t).withColumn("strength", F.lit(1))), 4)


@query()  # as local_moves
def louvain(t):
    return graph.louvain(graph.undirected(_supplied(t).withColumn("strength", F.lit(1))), 2, 4)


@query()  # as local_moves
def leiden(t):
    return graph.leiden(graph.undirected(_supplied(t).withColumn("strength", F.lit(1))), 2, 4)


@query("""WITH l AS (SELECT c_custkey AS node, c_nationkey AS community, c_mktsegment AS type FROM customer), s AS (SELECT community, count(*) AS size FROM l GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10),
r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY node) AS n FROM l JOIN s USING (community) QUALIFY n <= 10)
SELECT community, size, string_agg(node::VARCHAR, ',' ORDER BY n) AS members, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT q.type || ':' || count(*) AS x FROM r q WHERE q.community = r.community GROUP BY q.type)) AS types FROM r GROUP BY 1, 2""")
def community_summary(t):
    labels = t("customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community"))
    return graph.community_summary(labels, t("customer"), "c_custkey", "c_mktsegment")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(x, '^[A-Z_]') THEN x ELSE 'REL_' || x END AS type FROM (SELECT p_partkey, regexp_replace(upper(p_size || ' ' || p_brand), '[^A-Z0-9_]', '_', 'g') AS x FROM part)""")
def relation_types(t):
    return t("part").select("p_partkey", vl.relation_type(F.concat_ws(" ", F.col("p_size").cast("string"), "p_brand")).alias("type"))


@query("""SELECT conv_id, turn, 'entity' AS kind, 'N' || turn AS name, role AS target, 'x' AS description, NULL AS strength FROM conversations
UNION ALL SELECT conv_id, turn, 'relationship', 'a', 'b' || turn % 3, 'owns', CASE WHEN turn % 2 = 0 THEN turn + 2 ELSE 1 END FROM conversations""")
def parsed_tuples(t):
    strength = F.when(F.col("turn") % 2 == 0, (F.col("turn") + 2).cast("string")).otherwise("some")
    text = F.concat(F.lit('("entity"|N'), F.col("turn").cast("string"), F.lit("|"), "role", F.lit('|x)\n("entity"|short)\n("relationship"|a|b'), (F.col("turn") % 3).cast("string"), F.lit("|owns|"), strength, F.lit(")"))
    rows = t("conversations").select(F.struct("conv_id", "turn").alias("key"), text.alias("text"))
    entities, relations = graph.parsed_tuples(rows, "key", "text")
    a = entities.select("key.*", F.lit("entity").alias("kind"), "name", F.col("type").alias("target"), "description", F.lit(None).cast("int").alias("strength"))
    return a.unionByName(relations.select("key.*", F.lit("relationship").alias("kind"), F.col("source").alias("name"), "target", "description", "strength"))


@query("""SELECT conv_id, turn, 'entity' AS kind, 'N' || turn % 2 AS name, role AS target, 'first' || CASE WHEN turn % 2 = 0 THEN '+second' ELSE '' END AS description FROM conversations
UNION ALL SELECT conv_id, turn, 'relationship', 'a', 'b', 'owns' FROM conversations""")
def parsed_records(t):
    again = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('\n;\n("entity"|N0|'), "role", F.lit("|second)"))).otherwise("")
    text = F.concat(F.lit('("entity"|N'), (F.col("turn") % 2).cast("string"), F.lit("|"), "role", F.lit("|first)"), again, F.lit('\n;\n("entity"|few|parts)\n;\n("relationship"|a|b|owns|9)'))
    entities, relations = graph.parsed_records(t("conversations").select(F.struct("conv_id", "turn").alias("key"), text.alias("text")), "key", "text")
    a = entities.select("key.*", F.lit("entity").alias("kind"), "name", F.col("type").alias("target"), F.array_join("descriptions", "+").alias("description"))
    return a.unionByName(relations.select("key.*", F.lit("relationship").alias("kind"), F.col("source").alias("name"), "target", "description"))


@query("""SELECT n_nationkey, 'entity' AS kind, n_name AS name, 'Nation' AS type, 'in ' || n_regionkey AS description FROM nation
UNION ALL SELECT n_nationkey, 'relationship', n_name, 'part of', 'R' || n_regionkey || '|' || CASE WHEN n_nationkey % 2 = 0 THEN 'always' ELSE '' END FROM nation""")
def parsed_listing(t):
    more = F.when(F.col("n_nationkey") % 2 == 0, ": always").otherwise("")
    text = F.concat(F.lit("ENTITIES:\n"), "n_name", F.lit(" [Nation]: in "), F.col("n_regionkey").cast("string"), F.lit("\nno type: x\n\nRELATIONSHIPS:\n"), "n_name", F.lit(" [part of] R"), F.col("n_regionkey").cast("string"), more)
    entities, relations = graph.parsed_listing(t("nation").select("n_nationkey", text.alias("text")), "n_nationkey", "text")
    a = entities.select("n_nationkey", F.lit("entity").alias("kind"), "name", "type", "description")
    return a.unionByName(relations.select("n_nationkey", F.lit("relationship").alias("kind"), F.col("source").alias("name"), "type", F.concat_ws("|", "target", "description").alias("description")))


_CLAIMS = "SELECT o_orderkey AS id, o_custkey AS subject, o_custkey + o_orderkey % 3 AS object FROM orders"


@query(f"""SELECT id AS claim, subject AS vertex, 'HAS_CLAIM' AS type FROM ({_CLAIMS}) WHERE subject IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT id, object, 'REFERS_TO' FROM ({_CLAIMS}) WHERE subject IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND object IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def claim_edges(t):
    claims = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("object"), F.col("o_orderdate").alias("updated"))
    return graph.placed_claims(claims, t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("name")), "name")[1]


_TYPED = """SELECT DISTINCT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'in' AS type FROM nation UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey, 'from' FROM supplier
UNION SELECT 'r' || n_regionkey, 'n' || min(n_nationkey), 'first' FROM nation GROUP BY n_regionkey"""


@query(f"""WITH RECURSIVE e AS ({_TYPED}), w AS (SELECT 's' || s_suppkey AS spot, ['s' || s_suppkey] AS names, [] :: VARCHAR[] AS types, [] :: VARCHAR[] AS used FROM supplier
UNION ALL SELECT target, list_append(names, target), list_append(types, type), list_append(used, source || target || type) FROM w JOIN e ON spot = source WHERE len(types) < 4 AND NOT list_contains(used, source || target || type))
SELECT array_to_string(names, '>') AS names, array_to_string(types, '>') AS types FROM w WHERE len(types) > 0 AND spot[1] = 'n'""")
def directed_paths(t):
    n, s, text = t("nation"), t("supplier"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = n.select(text("n", "n_nationkey").alias("source"), text("r", "n_regionkey").alias("target"), F.lit("in").alias("type"))
    edges = up.union(s.select(text("s", "s_suppkey"), text("n", "s_nationkey"), F.lit("from"))).union(n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n")).select(text("r", "n_regionkey"), text("n", "n"), F.lit("first"))).distinct()
    names = edges.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    kind = F.when(F.col("name").startswith("s"), "Local supplier").when(F.col("name").startswith("n"), "Member nation").otherwise("Region")
    found = graph.directed_paths(edges, names.withColumn("type", kind), "supplier", "nation", 4)
    return found.select(F.array_join("names", ">").alias("names"), F.array_join("types", ">").alias("types"))


@query("""SELECT p_partkey FROM part WHERE contains(p_type, 'CONO') UNION ALL SELECT p_partkey FROM part WHERE p_name = 'red widget'""")
def entity_lookups(t):
    parts = t("part").select("p_partkey", "p_name", "p_type")
    return graph.entities_like(parts, "p_type", "CONO").union(graph.entities_named(parts, "p_name", "red widget")).select("p_partkey")


@query("""SELECT n_name, count(*) AS suppliers FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal > 100 GROUP BY 1""")
def asked_in_sql(t):
    tables_ = {"vertices": t("nation"), "edges": t("supplier")}
    return graph.asked_in_sql(tables_, "SELECT n_name, count(*) AS suppliers FROM vertices JOIN edges ON n_nationkey = s_nationkey WHERE s_acctbal > :least GROUP BY 1", {"least": 100})


@query("""SELECT c_nationkey AS community, count(*) AS size FROM customer GROUP BY 1 HAVING count(*) >= 2""")
def reported_communities(t):
    return graph.reported_communities(t("customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community")))


@query("""SELECT 'organisations' AS part, count(*) AS n FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'users', count(*) FROM nation WHERE n_regionkey <> 1 UNION ALL
SELECT 'vertices', count(*) FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'edges', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 1 AND (s_suppkey % 25) NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def without_organisation(t):
    n = t("nation").select(F.col("n_nationkey").alias("name"), F.col("n_regionkey").alias("organisation_id"))
    held = {"organisations": t("region").select(F.col("r_regionkey").alias("id")), "users": n, "vertices": n, "edges": t("supplier").select(F.col("s_nationkey").alias("source"), (F.col("s_suppkey") % 25).alias("target"))}
    left = graph.without_organisations(held, held["organisations"].where("id = 1"))
    counts = [left[k].agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k in ("organisations", "users", "vertices", "edges")]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


# tables in sheets --------------------------------------------------------------------------------------------------

_CELLS = """SELECT 'f' || doc_id % 7 AS file, lang AS sheet, row, c::INT AS col,
CASE WHEN (doc_id * 7 + c * 3) % 4 > 0 THEN CASE WHEN c = 0 OR doc_id % 11 = 0 THEN source ELSE CAST(n_chars + c AS VARCHAR) END END AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id % 7, lang ORDER BY doc_id)::INT - 1 AS row FROM documents), (SELECT unnest([0, 1, 2, 3]) AS c)"""


def _cells(t):
    d = t("documents").withColumn("file", F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")))
    d = d.withColumn("row", (F.row_number().over(W.partitionBy("file", "lang").orderBy("doc_id")) - 1).cast("int")).select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("col"))
    value = F.when((F.col("col") == 0) | (F.col("doc_id") % 11 == 0), F.col("source")).otherwise((F.col("n_chars") + F.col("col")).cast("string"))
    return d.select("file", F.col("lang").alias("sheet"), "row", "col", F.when((F.col("doc_id") * 7 + F.col("col") * 3) % 4 > 0, value).alias("value"))


_ISLANDS = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT * FROM ({_CELLS}) WHERE value IS NOT NULL AND value <> ''), w AS (SELECT file, sheet, row, col, row AS r0, col AS c0 FROM c
UNION SELECT c.file, c.sheet, c.row, c.col, w.r0, w.c0 FROM w JOIN c ON c.file = w.file AND c.sheet = w.sheet AND ((c.row = w.row AND abs(c.col - w.col) = 1) OR (c.col = w.col AND abs(c.row - w.row) = 1))),
m AS (SELECT file, sheet, row, col, min((r0, c0)) AS root FROM w GROUP BY 1, 2, 3, 4), i AS (SELECT file, sheet, row, col, (dense_rank() OVER (PARTITION BY file, sheet ORDER BY root) - 1)::INT AS block FROM m)"""


@query(f"{_ISLANDS} SELECT * FROM i")
def sheet_blocks(t):
    return tables.blocks(_cells(t)).select("file", "sheet", "row", "col", "block")


_A = "chr(65 + {0})"  # these sheets have four columns


@query(f"""{_ISLANDS}, b AS (SELECT file, sheet, block, min(row) AS r0, max(row) + 1 AS r1, min(col) AS c0, max(col) + 1 AS c1, count(*) AS n FROM i GROUP BY 1, 2, 3)
SELECT file, sheet, block, r0, r1, c0, c1, n / ((r1 - r0) * (c1 - c0)) AS density, {_A.format("c0")} || (r0 + 1) || ':' || {_A.format("c1 - 1")} || r1 AS range FROM b WHERE r1 - r0 >= 2 AND c1 - c0 >= 2 AND n / ((r1 - r0) * (c1 - c0)) >= .25""")
def block_ranges(t):
    return tables.block_bounds(tables.blocks(_cells(t)))


_SCORE = """WITH c AS ({cells}), f AS (SELECT file, sheet, row, count(*) AS cells, count(value) AS filled, count(*) FILTER (regexp_matches(value, '^-?[0-9,]*\\.?[0-9]+%?$')) AS numbers,
max(CASE WHEN regexp_matches(lower(value), 'id|name|date|value|total|sum|category|type|status') THEN 1 ELSE 0 END) AS hint, count(*) FILTER (regexp_matches(value, '^[A-Za-z_][A-Za-z0-9_]*$') AND len(value) < 25) AS names FROM c WHERE row < 20 GROUP BY 1, 2, 3),
g AS (SELECT *, filled - numbers AS texts, lead(filled) OVER w AS nf, lead(numbers) OVER w AS nn FROM f WINDOW w AS (PARTITION BY file, sheet ORDER BY row)),
s AS (SELECT *, filled / cells AS ful, texts / nullif(filled, 0) AS txt, nn / nullif(nf, 0) AS nx FROM g)
SELECT file, sheet, row, round(CASE WHEN filled = 0 THEN -100 ELSE CASE WHEN ful > .7 THEN ful * 1.5 WHEN ful < .4 AND cells > 3 THEN CASE WHEN texts > 0 THEN -1 ELSE -3 END ELSE 0 END
+ CASE WHEN txt > .8 THEN txt * 5 WHEN txt > .6 THEN txt * 3 WHEN txt < .3 AND cells > 3 THEN -4 ELSE 0 END + CASE WHEN 1 - txt > .8 THEN -5 ELSE 0 END
+ CASE WHEN coalesce(nf, 0) = 0 THEN 0 WHEN txt > .7 AND nx > .6 THEN 3 WHEN 1 - txt > .7 AND 1 - nx > .6 THEN -2 ELSE 0 END + greatest(0, 1 - row * .4) + hint + names / cells * 3 END, 6) AS score FROM s"""


@query(_SCORE.format(cells=_CELLS))
def header_scores(t):
    return tables.header_scores(_cells(t), ["file", "sheet"]).select("file", "sheet", "row", _r("score", 6))


@query(f"""WITH s AS ({_SCORE.format(cells=_CELLS)}), r AS (SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY score DESC, row) AS n FROM s QUALIFY n <= 2),
t AS (SELECT file, sheet, max(row) FILTER (n = 1) AS a, max(row) FILTER (n = 2) AS b, max(score) AS best, min(score) AS second, count(*) AS k FROM r GROUP BY 1, 2)
SELECT file, sheet, CASE WHEN k = 2 AND best > -5 AND CASE WHEN best > 0 THEN (best - second) / best < .1 ELSE best - second < 1 END THEN least(a, b) ELSE a END AS header FROM t""")
def header_rows(t):
    scores = tables.header_scores(_cells(t), ["file", "sheet"]).withColumn("score", F.round("score", 6))
    return tables.header_rows(scores, ["file", "sheet"])


@query(f"""WITH c AS ({_CELLS}) SELECT file, sheet, col, coalesce(max(CASE WHEN row = 1 THEN nullif(trim(value), '') END), max(CASE WHEN row = 0 THEN nullif(trim(value), '') END)) AS name FROM c WHERE row IN (0, 1) GROUP BY 1, 2, 3""")
def header_names(t):
    cells = _cells(t)
    heads = cells.select("file", "sheet").distinct().withColumn("header", F.lit(1))
    return tables.header_names(cells, heads, ["file", "sheet"])


@query(f"""WITH u AS (SELECT DISTINCT file, sheet, col FROM ({_CELLS}) WHERE value IS NOT NULL AND (col <> 2 OR file < 'f3')), i AS (SELECT *, col - row_number() OVER (PARTITION BY file, sheet ORDER BY col) AS g FROM u)
SELECT file, sheet, min(col) AS c0, max(col) + 1 AS c1 FROM i GROUP BY file, sheet, g""")
def column_islands(t):
    return tables.column_islands(_cells(t).withColumn("value", F.when((F.col("col") != 2) | (F.col("file") < "f3"), F.col("value"))), ["file", "sheet"]).select("file", "sheet", "c0", "c1")


@query("""WITH p AS (SELECT p_partkey AS k, (p_partkey * 37 % 2000)::INT AS c FROM part)
SELECT k, CASE WHEN c < 26 THEN chr(65 + c) WHEN c < 702 THEN chr(64 + c // 26) || chr(65 + c % 26) ELSE chr(65 + (c - 702) // 676) || chr(65 + (c - 702) // 26 % 26) || chr(65 + c % 26) END AS letters FROM p""")
def range_letters(t):
    c = (F.col("p_partkey") * 37 % 2000).cast("int")
    return t("part").select(F.col("p_partkey").alias("k"), vl.column_letters(c).alias("letters"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total_rows, (SELECT count(*) FROM orders) > 1000 AS is_truncated FROM orders ORDER BY o_orderkey LIMIT 1000")
def payload_truncation(t):
    return tables.first_rows(t("orders").select("o_orderkey"), ["o_orderkey"])


# sources -----------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN greatest(a, b, c, d) = 0 THEN ',' WHEN a >= greatest(b, c, d) THEN ',' WHEN b >= greatest(c, d) THEN ';' WHEN c >= d THEN chr(9) ELSE '|' END AS delimiter
FROM (SELECT doc_id, len(text) - len(replace(text, ',', '')) AS a, len(text) - len(replace(text, ';', '')) AS b, len(text) - len(replace(text, chr(9), '')) AS c, len(text) - len(replace(text, '|', '')) AS d FROM documents)""")
def delimiter_sniff(t):
    return t("documents").select("doc_id", csv.delimiter(F.col("text")).alias("delimiter"))


def _xml(t):
    items = F.array_join(F.transform(F.sequence(F.lit(1), F.col("item_id") % 4 + 1), lambda i: F.concat(F.lit("<li>x"), i.cast("string"), F.lit("</li>"))), "")
    text = F.regexp_replace("text", "[<>&]", "")
    whole = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><doc id="1"><title>T'), F.col("item_id").cast("string"), F.lit("</title><a>"), text, F.lit("</a>"), items, F.lit("<tr><td>p</td><td>q</td></tr></doc>"))
    return t("benchmark").select("item_id", whole.alias("xml"))


@query("""SELECT item_id, (item_id % 4 + 7)::INT AS elements, 1 AS attributes, 'doc' AS root FROM benchmark""")
def element_counts(t):
    return _xml(t).select("item_id", markup.element_counts(F.col("xml")).alias("c")).select("item_id", "c.*")


@query("""SELECT item_id, 'doc' AS root, 'UTF-8' AS encoding, 'T' || item_id AS title, NULL::VARCHAR AS author, (SELECT string_agg('x' || i, ',' ORDER BY i) FROM range(1, item_id % 4 + 2) r(i)) AS lists, 1 AS rows, 'p,q' AS cells FROM benchmark""")
def xml_metadata(t):
    x = F.col("xml")
    found = _xml(t).select("item_id", markup.metadata(x).alias("m"), F.array_join(markup.lists(x), ",").alias("lists"), markup.table_rows(x).alias("t"))
    return found.select("item_id", "m.*", "lists", "t.rows", F.array_join("t.cells", ",").alias("cells"))


@query("""SELECT item_id, '{"doc": {"@attributes": {"id": "1"}, "a": [' || to_json(trim(regexp_replace(text, '[<>&]', '', 'g'), E' \\n\\t\\r')) || ', "2"]}}' AS json, NULL::VARCHAR AS error FROM benchmark""")
def nested_maps(t):
    xml = F.concat(F.lit('<doc id="1"><a>'), F.regexp_replace("text", "[<>&]", ""), F.lit("</a><a>2</a></doc>"))
    return markup.nested_maps(t("benchmark").withColumn("xml", xml), "item_id", "xml")


@query()  # a chain of steps that the queries above show one by one; a test has its rows
def described_tables(t):
    return tables.described_tables(_cells(t))


@query("""WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE s END AS day FROM d""")
def date_column(t):
    shown = F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return profile.dates(t("orders").select("o_orderkey", shown.alias("day")), "day").withColumn("day", F.col("day").cast("string"))


@query()  # greedy in order of length: what one name takes decides for the next; a test holds it against a plain loop
def name_clusters(t):
    return graph.name_clusters(_names(t), graph.similar_names(_names(t), "n", "type"), "n", "type")


@query()  # learned components
def latent_vectors(t):
    return vectors.latent_vectors(t("documents"), "doc_id", "text")


@query()  # random projections; a test measures what they miss
def approximate_pairs(t):
    return vectors.approximate_pairs(t("embeddings").withColumn("embedding", vectors.normalised("embedding")), "vec_id", "embedding", 1.2, 1.0)


@query()  # learned lists; a test measures recall against cosine_top10
def probed_top10(t):
    v = t("embeddings")
    rows, centres = vectors.inverted_file(v, "vec_id", "embedding")
    found = vectors.probed_top_k(rows, centres, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, max(1, 2 * len(centres) // 3))
    return found.select("query", "match", _r("score", 6), "rank")


@query("""WITH w AS (SELECT term, item_id, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark) GROUP BY 1, 2), d AS (SELECT term, count(*) AS documents FROM w GROUP BY 1)
SELECT item_id, round(sum((1 + ln(n)) * ln((1 + (SELECT count(*) FROM benchmark)) / documents)), 6) AS score FROM w JOIN d USING (term) WHERE term IN ('the', 'of', 'with', 'from') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def text_search(t):
    return vectors.search(vectors.search_index(t("benchmark"), "item_id", "text"), "item_id", ["the", "of", "with", "from"]).select("item_id", _r("score", 6))


@query()  # as semantic_chunks
def hybrid_chunks(t):
    rows = t("conversations").withColumn("embedding", vectors.hashed_embedding(F.col("text"), 32))
    return chunking.hybrid_chunks(rows, rows.where("turn % 4 = 2"), "conv_id", "turn", "text", "embedding")


@query("""WITH RECURSIVE r AS (SELECT s_nationkey, (row_number() OVER w - 1) // 4 AS batch, (row_number() OVER w - 1) % 4 AS i, s_name, s_nationkey::VARCHAR AS k FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
t AS (SELECT s_nationkey, batch, i, sum(len(s_name) + len(k)) OVER (PARTITION BY s_nationkey, batch) AS n4, sum(len(s_name) + len(k)) OVER (PARTITION BY s_nationkey, batch, i // 2) AS n2, count(*) OVER (PARTITION BY s_nationkey, batch) AS c4, count(*) OVER (PARTITION BY s_nationkey, batch, i // 2) AS c2, s_name, k FROM r),
h AS (SELECT *, CASE WHEN floor(n4 / 3.5) <= 12 OR c4 = 1 THEN 0 WHEN floor(n2 / 3.5) <= 12 OR c2 = 1 THEN i // 2 * 2 ELSE i END AS half FROM t),
v AS (SELECT s_nationkey, batch, half, 's_name' AS c, sum(len(s_name)) AS n, count(*) AS m FROM h GROUP BY 1, 2, 3 UNION ALL SELECT s_nationkey, batch, half, 's_key', sum(len(k)), count(*) FROM h GROUP BY 1, 2, 3),
p AS (SELECT *, greatest(1, least(2, ceil(floor(sum(n) OVER w / 3.5) / 12))) AS parts, row_number() OVER (PARTITION BY s_nationkey, batch, half ORDER BY n DESC, c) - 1 AS j FROM v WINDOW w AS (PARTITION BY s_nationkey, batch, half))
SELECT s_nationkey AS "group", batch::INT AS batch, half::INT AS half, CAST(j % parts AS INT) AS part, max(m)::BIGINT AS rows, string_agg(c, ',' ORDER BY c) AS columns, floor(sum(n) / 3.5)::BIGINT AS tokens FROM p GROUP BY 1, 2, 3, 4""")
def budgeted_chunks(t):
    s = t("supplier").select(F.col("s_nationkey").alias("group"), "s_suppkey", "s_name", F.col("s_nationkey").alias("s_key"))
    found = chunking.budgeted_chunks(s, "group", "s_suppkey", ["s_name", "s_key"], 4, 12)
    return found.withColumn("columns", F.array_join("columns", ","))


# pages -------------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey AS doc, arg_min(m, (-n, m)) AS method FROM (SELECT l_orderkey, l_returnflag AS m, sum(len(l_linestatus || l_linenumber)) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def best_extractor(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("doc"), "l_returnflag", F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("text"))
    return pages.best_extractor(rows, "doc", "l_returnflag", "text")


@query("""SELECT conv_id, avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0 END) < .5 AS scanned FROM conversations WHERE turn < 5 GROUP BY 1""")
def scanned_documents(t):
    return pages.scanned(t("conversations").withColumn("text", F.when(F.col("role") == "user", "x").otherwise(" ")), "conv_id", "turn", "text")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR (l_quantity * 2 > 80 AND l_linenumber >= 3 AND l_suppkey % 4 >= 2 AND l_partkey % 3 > 0)""")
def usable_tables(t):
    flavor = F.when(F.col("l_returnflag") == "R", "lattice").otherwise("stream")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", flavor.alias("flavor"), (F.col("l_quantity") * 2).alias("accuracy"), F.col("l_linenumber").alias("n_rows"), (F.col("l_suppkey") % 4).alias("n_columns"), (F.col("l_partkey") % 3).alias("n_filled"))
    return pages.usable_tables(rows).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_returnflag, string_agg(l_linestatus || l_linenumber, ' ' ORDER BY l_linenumber, l_linestatus) AS text, round(avg(l_quantity), 4) AS confidence FROM lineitem GROUP BY 1, 2""")
def recognised_blocks(t):
    rows = t("lineitem").withColumn("word", F.concat("l_linestatus", F.col("l_linenumber").cast("string")))
    return pages.recognised_blocks(rows, ["l_orderkey"], "l_returnflag", "l_linenumber", "word", "l_quantity").select("l_orderkey", "l_returnflag", "text", _r("confidence"))


@query("""SELECT conv_id, turn FROM conversations WHERE len(text) >= 50 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 10 AND len(regexp_replace(text, '[^\\p{L}]', '', 'g')) / len(text) > .5""")
def recognised_chunks(t):
    return pages.recognised_chunks(t("conversations"), "conv_id", "turn", "text").select("conv_id", "turn")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > .1 AND l_tax > .3 THEN 'high' WHEN l_discount > .05 OR l_tax > .15 THEN 'medium' ELSE 'low' END AS value FROM lineitem""")
def image_values(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", pages.image_value(F.col("l_discount"), F.col("l_tax")).alias("value"))


@query("""WITH n AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n)
SELECT user_id, run::BIGINT AS run, event_type, string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id) AS text FROM r GROUP BY 1, 2, 3""")
def section_runs(t):
    rows = t("events").withColumn("text", F.col("event_id").cast("string"))
    return pages.section_runs(rows, "user_id", "event_id", "event_type", "text")


@query("""SELECT k, one, two FROM (SELECT c_nationkey AS k, count(*)::BIGINT AS one FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, count(*)::BIGINT AS two FROM supplier GROUP BY 1) USING (k) WHERE one IS DISTINCT FROM two""")
def compared_extractions(t):
    a, b = t("customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("v")), t("supplier").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("v"))
    return pages.compared_samples(a, b, "k", "v")


@query("""SELECT user_id, string_agg(event_type || event_id, chr(10) ORDER BY n) AS answers FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type || event_id) AS n FROM events WHERE value > 50) WHERE n <= 5 GROUP BY 1""")
def ranked_answers(t):
    return pages.ranked_answers(t("events").withColumn("answer", F.concat("event_type", F.col("event_id").cast("string"))), "user_id", "value", "answer")


@query("""SELECT conv_id * 1000 + turn AS k, upper(role) AS response, NULL::VARCHAR AS error FROM conversations""")
def asked_model(t):
    rows = t("conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    return pages.asked(rows, "k", F.col("role"), lambda: lambda prompts: [p.upper() for p in prompts])


@query("""SELECT c_custkey, coalesce(c_custkey IN (SELECT o_custkey FROM orders), FALSE) AS chunked FROM customer""")
def chunked_flags(t):
    customers = t("customer").select("c_custkey", F.lit(False).alias("chunked"))
    return sinks.flagged(customers, t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "chunked")


@query("""SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey <> 7 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)""")
def deleted_by_document(t):
    """Edges that stay when the entities of one document, and one source, are taken out."""
    gone = t("part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    return t("lineitem").where("l_suppkey <> 7").join(gone, "l_partkey", "left_anti").select("l_orderkey", "l_partkey")


@query("""SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey LIMIT 100""")
def null_last_sort(t):
    when = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate"))
    return t("orders").orderBy(when.desc_nulls_last(), "o_orderkey").limit(100).select("o_orderkey")


@query("""SELECT n_nationkey, n_name FROM nation ORDER BY n_regionkey = 0 DESC, n_name DESC, n_nationkey LIMIT 12""")
def folders_first(t):
    rows = t("nation").withColumn("is_folder", F.col("n_regionkey") == 0)
    return metadata.folders_first(rows, "is_folder", "n_name", True).limit(12).select("n_nationkey", "n_name")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def json_values(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT label, string_agg(name || '=' || n, ',' ORDER BY name) AS payload FROM (SELECT o_orderpriority AS label, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def reshaped_payload(t):
    counts = t("orders").groupBy(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n"))
    pair = F.sort_array(F.collect_list(F.concat_ws("=", "name", F.col("n").cast("string"))))
    return counts.groupBy("label").agg(F.array_join(pair, ",").alias("payload"))


# extensions: event windows -----------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    return ev.windowed(t("events"), "ts", "event_type", "value", "1 hour").select("start", "event_type", "n", _r("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(t):
    return ev.sessions(t("events"), "ts", "user_id", "30 minutes")
