"""One query for each numbered operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, compaction, counts, hnsw, langid, minhash, packing, quality, reputation, spelling, sstable, toxicity, vantage
from folioflow.llm.common import new_path, table
from folioflow.llm.tokenize import default_word_file


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_word_file(), capacity=2048, end_id=0)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_sorted_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = sstable.write_shards(table(spark, sf_dir, "documents"), default_word_file(), end_id=1)
    return sstable.read_shards(spark, folder)


def op6_compacted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends the documents as eight arrivals, each a version of its own, compacts them, and reads every row back from the
    newest manifest."""
    shards = compaction.ShardedTable(spark, new_path(spark, "shards"))
    shards.append_each(table(spark, sf_dir, "documents"), F.concat(F.lit("day"), F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("string")))
    shards.compact()
    shards.vacuum()
    return shards.read().select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("n_read"), F.md5("text").alias("text_md5"))


OP6_SQL = """
SELECT doc_id, lang, source, n_chars, CAST(length(text) AS BIGINT) AS n_read, md5(text) AS text_md5 FROM documents
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.code_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


WORDS, BYTES = "word_bpe_49k", "byte_bpe_50k"
WITHDRAWN, RETOKENIZED = "src7", "es"


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, withdraws a source, counts a language anew under another tokenizer, and has batches come twice."""
    docs = table(spark, sf_dir, "documents")
    versions = {WORDS: counts.word_counter(default_word_file()), BYTES: counts.byte_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)}

    def events(rows: DataFrame, action: str, old: str | None, new: str | None) -> DataFrame:
        return rows.select("source", "lang", "text", F.lit(action).alias("action"), F.lit(old).cast("string").alias("old_version"), F.lit(new).cast("string").alias("new_version"))

    gone = F.coalesce(F.col("source") == WITHDRAWN, F.lit(False))
    batches = {
        "1-load": events(docs, counts.INSERT, None, WORDS),
        "2-withdraw": events(docs.where(gone), counts.DELETE, WORDS, None),
        "3-retokenize": events(docs.where(~gone & (F.col("lang") == RETOKENIZED)), counts.REVISE, WORDS, BYTES),
    }
    rollup = counts.Rollup(spark, new_path(spark, "rollup"))
    for name in (*batches, "2-withdraw", "1-load"):
        rollup.commit(name, lambda: counts.deltas(batches[name], versions))  # noqa: B023
    return rollup.totals()


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


#: Near words here are equal without a letter at the same place, or one is the other without a letter.
OP11_SQL = """
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS remainders FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END) AS c
  FROM (SELECT unnest(range(256))::BIGINT AS i))),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, w, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc || ':' || w, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
    lambda s, b: xor(s >> 8, remainders[(xor(s, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)
  UNION ALL SELECT word, n, -1, word FROM words),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM less AS a JOIN less AS b ON a.rest = b.rest AND a.word <> b.word
  WHERE a.i = b.i OR a.i = -1 OR b.i = -1),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min({'m': -near_n, 'w': near}) AS b FROM near GROUP BY word),
told AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * w.n THEN b.w END AS form, CASE WHEN -b.m >= 10 * w.n THEN -b.m END AS form_n
  FROM words AS w LEFT JOIN best USING (word)),
paths AS (
  SELECT word, word AS root, form AS onward FROM told
  UNION ALL SELECT p.word, t.word, t.form FROM paths AS p JOIN told AS t ON t.word = p.onward)
SELECT word, form, root, n, n_near, form_n FROM told JOIN (SELECT word, root FROM paths WHERE onward IS NULL) USING (word)
"""


def op12_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the toxic label that has its identifier."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("bad"))
    return reputation.judged(table(spark, sf_dir, "pages"), outcomes).drop("bound")


OP12_SQL = """
WITH read AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM read),
labelled AS (SELECT doc_id AS page_id, sum(toxic) AS bad, count(*) AS pages FROM labels WHERE toxic IN (0, 1) GROUP BY doc_id),
hosts AS (
  SELECT host, coalesce(sum(bad), 0)::DOUBLE AS bad, coalesce(sum(pages), 0)::DOUBLE AS pages,
    string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS names
  FROM parts LEFT JOIN labelled USING (page_id) GROUP BY host),
named AS (
  SELECT host, bad, pages, CASE WHEN regexp_matches(array_to_string(names, '.'), '^[0-9.]+$') THEN '' ELSE names[-1] END AS suffix,
    CASE WHEN regexp_matches(array_to_string(names, '.'), '^[0-9.]+$') THEN array_to_string(names, '.') ELSE array_to_string(names[-2:], '.') END AS domain FROM hosts),
by_suffix AS (
  SELECT suffix, sum(bad) AS bad, sum(pages) AS pages, coalesce((SELECT sum(bad) / nullif(sum(pages), 0) FROM named), 0) AS m FROM named GROUP BY suffix),
rho1 AS (SELECT sum((bad - pages * m) ** 2 - pages * m * (1 - m)) / nullif(sum(pages * (pages - 1) * m * (1 - m)), 0) AS rho FROM by_suffix),
post1 AS (SELECT suffix, m, bad, pages, CASE WHEN rho > 0 THEN least(10000, greatest(1, 1 / rho - 1)) ELSE 10000 END AS s FROM by_suffix, rho1),
by_domain AS (
  SELECT domain, suffix, d.bad, d.pages, (p.m * s + p.bad) / (s + p.pages) AS m
  FROM (SELECT domain, suffix, sum(bad) AS bad, sum(pages) AS pages FROM named GROUP BY ALL) AS d JOIN post1 AS p USING (suffix)),
rho2 AS (SELECT sum((bad - pages * m) ** 2 - pages * m * (1 - m)) / nullif(sum(pages * (pages - 1) * m * (1 - m)), 0) AS rho FROM by_domain),
post2 AS (SELECT domain, suffix, m, bad, pages, CASE WHEN rho > 0 THEN least(10000, greatest(1, 1 / rho - 1)) ELSE 10000 END AS s FROM by_domain, rho2),
by_host AS (
  SELECT host, n.bad, n.pages, (p.m * s + p.bad) / (s + p.pages) AS m FROM named AS n JOIN post2 AS p USING (domain, suffix)),
rho3 AS (SELECT sum((bad - pages * m) ** 2 - pages * m * (1 - m)) / nullif(sum(pages * (pages - 1) * m * (1 - m)), 0) AS rho FROM by_host),
post3 AS (
  SELECT host, pages, s, (m * s + bad) / (s + pages) AS mean
  FROM (SELECT *, CASE WHEN rho > 0 THEN least(10000, greatest(1, 1 / rho - 1)) ELSE 10000 END AS s FROM by_host, rho3)),
bounds AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (s + pages + 1)) AS bound FROM post3),
rules(rule, of_host, start, says) AS (VALUES ('org/', 'org', '/', 'allow'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block'),
  ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block')),
fitting AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(says, length(rule)) AS says FROM (SELECT DISTINCT host, path FROM parts) AS p
  JOIN rules ON (host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, start) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN bound > 0.2 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts JOIN bounds USING (host) LEFT JOIN fitting USING (host, path)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    relabelled = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return vantage.hard_negatives(relabelled, anchor=vec_id % 100 == 0)


OP13_SQL = """
WITH sound AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, coalesce(list_inner_product(a.v, b.v), 0)::BIGINT AS score
  FROM sound AS a JOIN sound AS b ON len(a.v) = len(b.v) AND a.r <> b.r WHERE a.vec_id % 100 = 0),
positive AS (SELECT a, anchor_id, b AS p, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY a, p ORDER BY score DESC, vec_id, s.b))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive AS p JOIN scored AS s USING (a) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY a, p ORDER BY score DESC, vec_id, s.b) <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_sorted_token_shards": op5_sorted_token_shards,
        "op6_compacted_shards": op6_compacted_shards,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_language_id": op8_language_id,
        "op9_token_counts": op9_token_counts,
        "op10_repetition_rules": op10_repetition_rules,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_host_reputation": op12_host_reputation,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_compacted_shards": OP6_SQL, "op11_spelling_variants": OP11_SQL, "op12_host_reputation": OP12_SQL, "op13_hard_negatives": OP13_SQL}
