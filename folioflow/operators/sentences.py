"""Sentences by what a corpus itself shows of its abbreviations, without labels (Kiss and Strunk, 2006).

Tokens are parted by white space; a token is a body between marks, its type the lower-cased body. By language, counts of distinct
tokens and of pairs around an end mark tell, with likelihood ratios of binomials,

- abbreviations: types that nearly always have a point; short ones and those with points inside sooner, and the later the more
  often they stand without one;
- starters: types that follow a sure end of a sentence more often than chance has it;
- collocations: an abbreviation, initial or number with a point, and a type that follows it more often than chance has it;
- capitals: how the types that follow abbreviations, initials and numbers are written elsewhere.

A point ends a sentence unless it belongs to an abbreviation, an initial or a number whose follower doesn't look like a start. Counts
are taken over all texts, by token before anything else, so a frequent word or a large language is summed up within its tasks.

Null and empty texts have no sentences; a null language is a language of its own; repeated rows count again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.plans.lineage import cut

#: Least log-likelihood of an abbreviation (after its factors), of a starter and of a collocation.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: Entries of each kind and language that are sent to all tasks, those with the highest scores.
MOST_ENTRIES = 20_000
NUMBER = "##number##"
SPACE = "[ \\t\\n\\r\\f\\x0B]"
MODEL = "language string, kind string, a string, b string, score double"
_TOKEN = r"^[^\p{L}\p{N}]*(.*?)([.?!]*)[^\p{L}\p{N}.?!]*$"
_IS_NUMBER = r"^[0-9][0-9.,]*$"


def _parts(token: Column) -> dict[str, Column]:
    body = F.regexp_extract(token, _TOKEN, 1)
    kind = F.when(body.rlike(_IS_NUMBER), NUMBER).otherwise(F.lower(body))
    first = F.substring(body, 1, 1)
    return {"type": kind, "marks": F.regexp_extract(token, _TOKEN, 2), "upper": first != F.lower(first), "lower": first != F.upper(first)}


def _ratio(n: Column, k: Column, p: Column) -> Column:
    """k * log p + (n - k) * log(1 - p), where 0 * log 0 is 0."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)


def _together(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """How much likelier it is that b depends on a than that it doesn't: twice the logarithm."""
    return 2 * (_ratio(a, ab, ab / a) + _ratio(n - a, b - ab, (b - ab) / (n - a)) - _ratio(a, ab, b / n) - _ratio(n - a, b - ab, b / n))


def learned(docs: DataFrame, language: str = "lang", text: str = "text") -> DataFrame:
    """(language, kind, a, b, score): abbreviations and starters (a), collocations (a, b), and for capitals the type a with the
    score 1 if it is seen in small letters, plus 2 if with a capital within sentences."""
    tokens = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"{SPACE}+"), lambda t: t != "")
    split = docs.select(F.col(language).cast("string").alias("language"), tokens.alias("tokens"))
    by_token = split.select("language", F.explode("tokens").alias("token")).groupBy("language", "token").agg(F.count("*").alias("n"))
    types = cut(by_token.select("language", "n", *(c.alias(name) for name, c in _parts(F.col("token")).items())).where("type <> ''"))
    closed = r"[.?!][^\p{L}\p{N}.?!,;:]*$"
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(1))), lambda i: F.struct(F.get("tokens", i - 1).alias("first"), F.get("tokens", i).alias("second"))), lambda p: p["first"].rlike(closed) & p["second"].isNotNull())
    by_pair = split.select("language", F.explode(pairs).alias("pair")).groupBy("language", "pair.first", "pair.second").agg(F.count("*").alias("n"))
    one, two = _parts(F.col("first")), _parts(F.col("second"))
    around = cut(by_pair.select("language", "n", one["type"].alias("type"), one["marks"].alias("marks"), two["type"].alias("next"), two["upper"].alias("upper")).where("type <> '' and next <> ''"))

    total = types.groupBy("language").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("marks") == ".", F.col("n")).otherwise(0)).alias("points"))
    same = F.col("l").eqNullSafe(F.col("language"))
    counts = types.groupBy("language", "type").agg(F.sum(F.when(F.col("marks") == ".", F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("n"), F.max("lower").alias("small"), F.sum(F.when(F.col("upper"), F.col("n")).otherwise(0)).alias("capital"))
    counts = cut(counts.join(F.broadcast(total.withColumnRenamed("language", "l")), same).drop("l"))
    # abbreviations
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    gain = 2 * (_ratio(F.col("n"), F.col("k"), F.lit(0.99)) - _ratio(F.col("n"), F.col("k"), F.col("points") / F.col("tokens")))
    score = gain * F.exp(-letters) * (F.length("type") - letters + 1) * F.pow(letters.cast("double"), -(F.col("n") - F.col("k")))
    short = cut(counts.where(F.col("type").rlike(r"\p{L}") & (F.col("k") > 0) & (F.col("points") < F.col("tokens"))).select("language", "type", score.alias("score")).where(F.col("score") >= ABBREVIATION))

    def joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        """On language and type; null languages are equal."""
        r = right.withColumnsRenamed({"language": "l", "type": "t"})
        return left.join(r, F.col("type").eqNullSafe(F.col("t")) & F.col("language").eqNullSafe(F.col("l")), how).drop("l", "t")

    marked = joined(around, short.select("language", "type", F.lit(True).alias("short")), "left").withColumn("short", F.col("short").isNotNull() & (F.col("marks") == "."))
    initial = F.col("type").rlike(r"^\p{L}$")
    loose = F.col("short") | ((initial | (F.col("type") == NUMBER)) & (F.col("marks") == "."))
    marked = cut(marked.withColumn("loose", loose))
    # starters, after ends that are sure
    sure = marked.where("not loose")
    ends = sure.groupBy(F.col("language").alias("l")).agg(F.sum("n").alias("ends"))
    after = sure.groupBy("language", F.col("next").alias("type")).agg(F.sum("n").alias("begun"), F.sum(F.when(F.col("upper"), F.col("n")).otherwise(0)).alias("begun_capital"))
    begun = cut(joined(after.where(F.col("type") != NUMBER), counts).join(F.broadcast(ends), same).drop("l"))
    starters = begun.where("begun * tokens > n * ends").select("language", "type", _together(F.col("ends"), F.col("n"), F.col("begun"), F.col("tokens")).alias("score")).where(F.col("score") >= STARTER)
    # collocations
    pairs = marked.where("loose").groupBy("language", "type", "next").agg(F.sum("n").alias("ab"))
    pairs = joined(pairs, counts.select("language", "type", F.col("k").alias("na"), "tokens"))
    pairs = joined(pairs.withColumnsRenamed({"type": "a", "next": "type"}), counts.select("language", "type", F.col("n").alias("nb")))
    bound = pairs.where("ab > 1 and ab * tokens > na * nb").select("language", "a", "type", _together(F.col("na"), F.col("nb"), F.col("ab"), F.col("tokens")).alias("score")).where(F.col("score") >= COLLOCATION)
    # how followers are written elsewhere
    followers = marked.where("loose").select("language", F.col("next").alias("type")).distinct()
    seen = joined(joined(followers, counts.select("language", "type", "small", "capital")), begun.select("language", "type", "begun_capital"), "left")
    written = F.when(F.col("small"), 1.0).otherwise(0.0) + F.when(F.col("capital") > F.coalesce("begun_capital", F.lit(0)), 2.0).otherwise(0.0)
    none = F.lit(None).cast("string")
    kinds = [
        short.select("language", F.lit("abbreviation").alias("kind"), F.col("type").alias("a"), none.alias("b"), "score"),
        starters.select("language", F.lit("starter").alias("kind"), F.col("type").alias("a"), none.alias("b"), "score"),
        bound.select("language", F.lit("collocation").alias("kind"), "a", F.col("type").alias("b"), "score"),
        seen.select("language", F.lit("capitals").alias("kind"), F.col("type").alias("a"), none.alias("b"), written.alias("score")),
    ]
    return kinds[0].union(kinds[1]).union(kinds[2]).union(kinds[3])


@dataclass
class Learned:
    """What one language's model says of a point."""

    abbreviations: set[str] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    capitals: dict[str, int] = field(default_factory=dict)

    _token = re.compile(r"[\W_]*(.*?)([.?!]*)((?:(?![.?!])[\W_])*)", re.DOTALL)
    _closed = re.compile(r"[.?!](?:(?![.?!,;:])[\W_])*$")
    _number = re.compile("[0-9][0-9.,]*")
    _run = re.compile(r"[^ \t\n\r\f\x0B]+")

    def _parts(self, token: str) -> tuple[str, str, str]:
        body, marks, _ = self._token.fullmatch(token).groups()
        return NUMBER if self._number.fullmatch(body) else body.lower(), marks, body[:1]

    def starts(self, kind: str, first: str) -> bool | None:
        """Whether a token looks like the start of a sentence; None: can't be told."""
        seen = self.capitals.get(kind)
        if seen is not None and first != first.lower() and seen & 1 and not seen & 2:
            return True
        if first != first.upper():
            return False
        return True if kind in self.starters and first != first.lower() else None

    def ends(self, token: str, following: str) -> bool:
        """Whether a sentence ends between two tokens."""
        if not self._closed.search(token):
            return False
        kind, marks, _ = self._parts(token)
        after, _, first = self._parts(following)
        if not after:  # marks alone belong to what stands before them
            return False
        if marks != ".":  # question and exclamation marks, dots in a row
            return "?" in marks or "!" in marks or self.starts(after, first) is not False
        initial = len(kind) == 1 and kind.isalpha()
        if (kind in self.abbreviations or initial or kind == NUMBER) and (kind, after) in self.collocations:
            return False
        if kind in self.abbreviations and not initial:
            return self.starts(after, first) is True
        if initial or kind == NUMBER:
            found = self.starts(after, first)
            # initials stand before names, which are never written small
            return found if found is not None else not (initial and first != first.lower() and not self.capitals.get(after, 0) & 1)
        return True

    def split(self, text: str) -> list[str]:
        out, begun, before = [], 0, None
        for run in self._run.finditer(text):
            if before is not None and self.ends(before[0], run[0]):
                out.append(text[begun : before.end()].strip())
                begun = run.start()
            before = run
        return [*out, text[begun:].strip()] if before is not None else out


def split(docs: DataFrame, model: DataFrame, language: str = "lang", text: str = "text", to: str = "sentences") -> DataFrame:
    """docs with an array of the sentences of each text. model: of learned(); of each kind and language the MOST_ENTRIES entries with
    the highest scores are sent to the tasks. Languages that the model doesn't know have no abbreviations."""
    order = W.partitionBy("language", "kind").orderBy(F.desc("score"), "a", "b")
    known: dict[str | None, Learned] = {}
    for r in model.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MOST_ENTRIES).drop("_n").collect():
        m = known.setdefault(r.language, Learned())
        if r.kind == "abbreviation":
            m.abbreviations.add(r.a)
        elif r.kind == "starter":
            m.starters.add(r.a)
        elif r.kind == "collocation":
            m.collocations.add((r.a, r.b))
        else:
            m.capitals[r.a] = int(r.score)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    schema = docs.select(F.struct("*").alias("row")).schema.add(to, T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, none = batch.column(0), Learned()
            found = [sent.value.get(lang, none).split(t or "") for lang, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([row, pa.array(found, pa.list_(pa.string()))], ["row", to])

    out = docs.select(F.struct("*").alias("row"), F.col(language).cast("string"), F.col(text)).toDF("row", "language", "text").mapInArrow(run, schema)
    return out.select("row.*", to)
