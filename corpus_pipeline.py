"""A corpus pipeline of four stages: language, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents, extra ones with any names too. Where whole documents pass through Python the stage is a table of its own, computed
in small batches. Labels, where a stage learns, come from sf_dir; everything else comes from docs.
Texts are taken whole, however long; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import langid, minhash, packing, toxicity
from folioflow.llm.common import removed, table, written
from folioflow.llm.tokenize import default_word_file

#: Below this posterior probability a text is not clearly in any language.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language is clear, and sets lang to what was found. Null and empty texts and texts
    without a letter go; if no row has a lang to learn from, all go. Repeated rows are judged alike; null doc_ids and null
    langs are kept where the text is clear; a tie between two languages goes to the first in order, at a score of a half."""
    found = langid.identify(docs, langid.train(docs), carry=True)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return written(kept.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*"), "language")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted toxic. Null and empty texts get the rate of examples without words, which is
    clean unless most such examples are toxic; without labels of both classes all stay. Repeated rows are judged alike."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return written(toxicity.score(docs, model, carry=True).where("predicted = 0").select("row.*"), "clean")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest doc_id: five words, 0.8 or more. Rows
    that repeat a doc_id and its words become one; those without a doc_id or without words all stay."""
    return minhash.distinct_documents(docs, width=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence of at most 2048 tokens. Null and empty texts are a piece of
    one end id; repeated rows and null doc_ids are packed each for itself."""
    return packing.pack_documents(docs, default_word_file(), capacity=2048, end_id=0, words_kept=100_000)


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("packing", packed)]
#: No stage of these can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table is deleted once the next one is written."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        docs = result if "written_to" in vars(result) else written(result, f"stage-{name}")
        if old:
            removed(spark, old)
        old = docs.written_to
    return docs
