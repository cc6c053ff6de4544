"""Pages of documents: which extraction to trust, what to keep, how chunks find their section."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.text import n_words
from folioflow.operators.chunking import reading_seconds
from folioflow.operators.metadata import nearest_before


def best_extractor(pages: DataFrame, document: str, method: str, text: str, by: str = "characters") -> DataFrame:
    """(document, method): the extraction with most characters or most pages; ties to the smaller name."""
    each = pages.groupBy(document, method).agg(F.sum(F.length(text)).alias("characters"), F.count("*").alias("pages"))
    return each.groupBy(document).agg(F.min_by(method, F.struct(-F.col(by), F.col(method))).alias("method"))


def scanned(pages: DataFrame, document: str, number: str, text: str, first: int = 5) -> DataFrame:
    """(document, scanned): less than half of the first pages hold text."""
    has = F.avg(F.when(F.coalesce(F.trim(text), F.lit("")) != "", 1.0).otherwise(0.0))
    return pages.where(F.col(number) < first).groupBy(document).agg((has < 0.5).alias("scanned"))


def usable_tables(found: DataFrame, accuracy: float = 80, rows: int = 3, columns: int = 2) -> DataFrame:
    """Lattice tables, and stream tables that are accurate and large enough and hold something."""
    stream = (F.col("accuracy") > accuracy) & (F.col("n_rows") >= rows) & (F.col("n_columns") >= columns) & (F.col("n_filled") > 0)
    return found.where((F.col("flavor") == "lattice") | stream)


def recognised_blocks(words: DataFrame, key: list[str], block: str, order: str, text: str, confidence: str) -> DataFrame:
    """(key, block, text, confidence): recognised words by block in their order, with their mean confidence."""
    return words.where(F.trim(text) != "").groupBy(*key, block).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("text"), F.avg(confidence).alias("confidence")
    )


def recognised_chunks(pages: DataFrame, document: str, number: str, text: str, characters: int = 50, words: int = 10, letters: float = 0.5) -> DataFrame:
    """Pages whose recognised text is long enough and mostly letters."""
    share = F.length(F.regexp_replace(text, r"(?U)[^\p{L}]", "")) / F.length(text)
    return pages.where((F.length(text) >= characters) & (n_words(F.col(text)) >= words) & (share > letters)).select(document, number, text)


def image_value(edges: Column, density: Column) -> Column:
    """How much an image is likely to tell."""
    return F.when((edges > 0.1) & (density > 0.3), "high").when((edges > 0.05) | (density > 0.15), "medium").otherwise("low")


def enriched(chunks: DataFrame, headers: DataFrame, document: str, position: str, text: str) -> DataFrame:
    """Chunks with the title before them, a type and the seconds that reading takes."""
    placed = nearest_before(chunks, headers, document, position, "title")
    return placed.withColumn("type", F.lit("text")).withColumn("seconds", reading_seconds(n_words(F.col(text))))


def section_runs(paragraphs: DataFrame, document: str, position: str, section: str, text: str) -> DataFrame:
    """(document, run, section, text): neighbouring paragraphs of one section as one chunk."""
    order = W.partitionBy(document).orderBy(position)
    new = F.when(F.lag(section).over(order).eqNullSafe(F.col(section)), 0).otherwise(1)
    runs = paragraphs.withColumn("_new", new).withColumn("run", F.sum("_new").over(order))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(position, text))), lambda x: x[text]), "\n")
    return runs.groupBy(document, "run", section).agg(joined.alias("text"))


def compared_samples(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """(key, one, two): pages on which two extractions disagree, also where one has none."""
    a, b = one.groupBy(key).agg(F.sum(value).alias("one")), two.groupBy(key).agg(F.sum(value).alias("two"))
    return a.join(b, key, "full").where(~F.col("one").eqNullSafe(F.col("two")))


def asked(rows: DataFrame, key: str, prompt: Column, client: Callable[[], Callable[[list[str]], list[str]]], batch: int = 10) -> DataFrame:
    """(key, response, error): answers of an outside model. client makes, once for each task, a function from prompts to
    answers; a batch that fails gives rows that say so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = client()
        for records in batches:
            texts, found, errors = records.column(1).to_pylist(), [], []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                try:
                    found += answer(some)
                    errors += [None] * len(some)
                except Exception as error:  # whatever the client raises belongs to its rows
                    found += [None] * len(some)
                    errors += [f"{type(error).__name__}: {error}"] * len(some)
            yield pa.RecordBatch.from_arrays([records.column(0), pa.array(found, pa.string()), pa.array(errors, pa.string())], [key, "response", "error"])

    return rows.select(key, prompt.alias("_prompt")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, response string, error string")


def ranked_answers(answers: DataFrame, question: str, score: str, answer: str, least: float = 50, top: int = 5) -> DataFrame:
    """(question, answers): the best answers that are good enough, best first."""
    n = F.row_number().over(W.partitionBy(question).orderBy(F.desc(score), answer))
    best = answers.where(F.col(score) > least).withColumn("_n", n).where(F.col("_n") <= top)
    return best.groupBy(question).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", answer))), lambda x: x[answer]), "\n").alias("answers"))
