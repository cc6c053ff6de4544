"""The language of texts by their function words and own letters, without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import language_by_marks

#: Function words of each language; a word that n languages have counts 1 / n for each of them.
WORDS = {
    "en": "the of and to in is that it for was on with be as by at are this from or not which have an they his her you were but",
    "es": "de la que el en y los se del las por un para con no una su al lo como más pero sus le ya este sí porque esta es son",
    "fr": "de la le et les des en un du une que est pour qui dans au par sur pas plus ne se ce il elle sont avec aux cette nous vous",
    "de": "der die und in den von zu das mit sich auf des für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou são também",
    "it": "di e il la che in un a per del è una i le con si da non sono dei della nel alla più anche come gli lo ha al",
    "ca": "de la i que el en a un per amb els les no una es del al més com és va són seva seu aquest també però",
    "ro": "de și în a la că o nu cu pe se din un pentru mai este care sunt ce sau fi dar o ale lui prin",
}
#: Letters that belong to a language; each counts like half a word.
LETTERS = {"es": "ñ¿¡", "fr": "œêëîç", "de": "ßäöü", "pt": "ãõ", "it": "òì", "ca": "·", "ro": "șțăâ"}
# Languages that are taken for Spanish; others that are not supported are taken for English.
AS_SPANISH = ("ca", "eu", "gl", "it", "ro", "la")
SUPPORTED = ("en", "es", "fr", "de", "pt")


def weights() -> dict[str, dict[str, float]]:
    listed = {code: set(text.split()) for code, text in WORDS.items()}
    return {code: {w: 1 / sum(w in other for other in listed.values()) for w in sorted(words)} for code, words in listed.items()}


def with_language(df: DataFrame, text: str, to: str = "language") -> DataFrame:
    """df with the language of a text. Short texts and those of few letters are told by language_by_marks(); in others the language whose
    words and letters count most wins, of equals the earlier one in WORDS; texts without any are told by Spanish marks. Catalan,
    Italian, Romanian and the like become Spanish, as the next that is supported. Null texts are English, as short ones."""
    tables = weights()
    every = sorted({w for words in tables.values() for w in words})
    value = F.coalesce(F.col(text), F.lit(""))
    read = df.withColumn("_low", F.lower(value)).withColumn("_words", F.filter(F.split("_low", r"[^\p{L}]+"), lambda w: w.isin(*every)))
    scores = []
    for i, (code, words) in enumerate(tables.items()):
        table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
        hits = F.aggregate("_words", F.lit(0.0), lambda n, w: n + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))  # noqa: B023
        marks = F.length(F.regexp_replace("_low", f"[^{LETTERS[code]}]", "")) / 2 if code in LETTERS else F.lit(0.0)
        name = code if code in SUPPORTED else "es" if code in AS_SPANISH else "en"
        scores.append(F.struct(F.round(hits + marks, 6).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    spanish = F.when(F.length(F.regexp_replace("_low", "[^áéíóúñ¿¡]", "")) >= 3, "es").otherwise("en")
    told = read.withColumn("_best", best)
    return told.withColumn(to, F.coalesce(language_by_marks(value), F.when(F.col("_best.score") > 0, F.col("_best.name")).otherwise(spanish))).drop("_low", "_words", "_best")
