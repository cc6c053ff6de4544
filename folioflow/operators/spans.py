"""Structure of pages from spans of text with their fonts: (document, page, line, position, text, font, size, bold)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A line is a heading if it is so much larger than the body, or bold and no smaller, and not longer than this.
LARGER, MOST_CHARACTERS = 1.15, 120


def font_statistics(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean_size, font): size by characters, and the font that most characters are in, ties to the smaller name."""
    length = F.length("text")
    by = spans.groupBy(*keys, "font").agg(F.sum(length).alias("n"), F.sum(length * F.col("size")).alias("s"))
    return by.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mean_size"), F.min_by("font", F.struct(-F.col("n"), F.col("font"))).alias("font"))


def lines(spans: DataFrame) -> DataFrame:
    """(document, page, line, text, size, bold): spans of a line in order; its size by characters; bold if all of it is."""
    by = spans.where(F.trim("text") != "").groupBy("document", "page", "line")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ")
    return by.agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"), (F.sum(F.length("text") * F.col("size")) / F.sum(F.length("text"))).alias("size"), F.min("bold").alias("bold"))


def headed_lines(spans: DataFrame) -> DataFrame:
    """lines() with heading and level: the larger sizes of a document's headings are the higher levels, from 1."""
    body = font_statistics(spans, ["document"]).select("document", "mean_size")
    rows = lines(spans).join(body, "document")
    large, strong = F.col("size") >= LARGER * F.col("mean_size"), F.col("bold") & (F.col("size") >= F.col("mean_size"))
    rows = rows.withColumn("heading", (large | strong) & (F.length("text") <= MOST_CHARACTERS) & F.col("text").rlike(r"\p{L}"))
    sizes = rows.where("heading").select("document", F.round("size", 1).alias("_s")).distinct()
    levels = sizes.withColumn("level", F.row_number().over(W.partitionBy("document").orderBy(F.desc("_s"))))
    return rows.withColumn("_s", F.when(F.col("heading"), F.round("size", 1))).join(levels, ["document", "_s"], "left").drop("_s", "mean_size")


def merged_paragraphs(spans: DataFrame) -> DataFrame:
    """(document, section, title, level, first_page, last_page, text): the lines below each heading as one text; lines before the
    first heading are section 0, and neighbouring headings of one level are one title."""
    order = W.partitionBy("document").orderBy("page", "line")
    rows = headed_lines(spans)
    first = F.col("heading") & ~(F.coalesce(F.lag("heading").over(order), F.lit(False)) & F.lag("level").over(order).eqNullSafe(F.col("level")))
    rows = rows.withColumn("_new", first.cast("int")).withColumn("section", F.sum("_new").over(order))
    joined = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("page", "line", "text")))), lambda x: x["text"]), " ")
    return rows.groupBy("document", "section").agg(joined(F.col("heading")).alias("title"), F.max("level").alias("level"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), joined(~F.col("heading")).alias("text"))
