"""Spelling variants by anagram hashing.

The key of a word is the sum of the fifth powers of its code points, modulo a prime: anagrams have one key, and a letter added,
removed or exchanged changes it by the value of that letter, or by the difference of two. So a word offers its key, and its key
less each of its letters: two words differ by an exchange if the keys that each has without one letter are equal, and by an
addition or removal if the key of one is that of the other without a letter. Of what is left when the letter is out, the first
or the last half stands unchanged in both words, since one change falls into one half only; halves are part of what is joined,
so that anagrams in masses don't all meet. What meets is verified letter by letter.

Rules, on words and how often they occur: words that differ by exactly one code point inserted, deleted or replaced are near. The
form of a word is its near word that occurs most (ties: the smallest in code-point order), if that occurs `ratio` times as often
or more. Roots follow forms to the last; each step multiplies the occurrences, so there are no rings.

Everything is built-in expressions and joins. Words of a text are counted within their task before the shuffle, however often one
occurs. Null and empty texts have no words; a null doc_id counts as the empty string where a slip is drawn; repeated rows count
again; empty tables give no rows; words of any length are taken whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, joined_to_groups, written
from folioflow.llm.reputation import CAPITALS, SMALL

#: Code points of words; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP = 7, 2, 10, 31
#: Keys are sums modulo this prime, 2**61 - 1: no word is long enough to overflow.
PRIME = (1 << 61) - 1


def runs(docs: DataFrame, least: int, slip: int) -> DataFrame:
    """(word): the lower-cased runs of letters of all texts. One in `slip` loses a letter, by a hash of document and run."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least},}})"), 1)).alias("run"))
    run = F.translate("run", CAPITALS, SMALL)
    if not slip:
        return found.select(run.alias("word"))
    hashed = found.select(run.alias("word"), F.crc32(F.concat("doc", F.lit(":"), run)).alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return hashed.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): words of at least that length that occur at least that often."""
    return runs(docs, least_length, slip).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def offers(words: DataFrame) -> DataFrame:
    """(word, n, letter, half, meet): what a word can be joined by: without each of its letters, and whole (letter is empty);
    each with the first half (half 0) and the last half (1) of what is left."""
    letters = F.array_distinct(F.split("word", ""))
    key = F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda total, x: (total + value(x)) % PRIME)
    each = words.select("word", "n", F.length("word").alias("length"), key.alias("key"), F.explode(F.concat(F.array(F.lit("")), letters)).alias("letter"))
    rest = F.when(F.col("letter") == "", F.col("key")).otherwise((F.col("key") - value(F.col("letter")) + PRIME) % PRIME)
    left = F.col("length") - F.when(F.col("letter") == "", 0).otherwise(1)
    first = F.floor(left / 2).cast("int")
    halves = F.array(F.xxhash64(rest, left, F.substring("word", F.lit(1), first), F.lit(0)), F.xxhash64(rest, left, F.substring("word", -(left - first), left - first), F.lit(1)))
    return each.select("word", "n", "letter", first.alias("first"), F.posexplode(halves).alias("half", "meet"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of near words both ways, once. words: word, n, each word once."""
    all_offers = offers(words)
    a, b = all_offers.alias("a"), all_offers.alias("b")
    # anagrams share a letter that is out; a pair whose first halves are equal is met there
    meets = (F.col("a.meet") == F.col("b.meet")) & (F.col("a.half") == F.col("b.half")) & (F.col("a.letter") < F.col("b.letter"))
    once = (F.col("a.half") == 0) | (F.substring("a.word", F.lit(1), F.col("a.first")) != F.substring("b.word", F.lit(1), F.col("b.first")))
    pairs = a.join(b, meets & once & (F.levenshtein("a.word", "b.word", 1) == 1))
    both = F.explode(F.array(*(F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{x}.n").alias("n"), F.col(f"{y}.word").alias("near"), F.col(f"{y}.n").alias("near_n")) for x, y in ("ab", "ba"))))
    return pairs.select(both.alias("pair")).select("pair.*")


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n. words: word, n, each word once; read twice: give a written table."""
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form")))
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    kept = F.col("best.m") * -1 >= ratio * F.col("n")
    told = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("best.form")).alias("form"), F.when(kept, -F.col("best.m")).alias("form_n")
    )
    told = written(told, "forms")
    roots = _roots(told.where("form is not null").select("word", F.col("form").alias("root")))
    named = told.where("form is not null").join(roots, "word").unionByName(told.where("form is null").withColumn("root", F.col("word")))
    return named.select("word", "form", "root", "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root): where the steps end. Each round doubles the length of the steps, which are less than 64 as counts are longs."""
    steps = written(steps, "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        sizes = written(steps.groupBy("root").agg(F.count("*").alias("size")).join(onward, "root"), "onward")
        if sizes.isEmpty():
            dropped(sizes)
            return steps
        further = written(joined_to_groups(steps, sizes, ["root"], "size", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
        dropped(steps, sizes)
        steps = further


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, slip: int = SLIP) -> DataFrame:
    """Per word of the texts of docs (doc_id, text): word, form, root, n, n_near, form_n. slip: one run in so many, by a hash of
    document and run, loses a letter, which plants variants to be found; 0 for none."""
    words = written(vocabulary(docs, least_length, least_count, slip), "words")
    return grouped(words, ratio)
