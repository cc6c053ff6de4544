"""Sentence ends that are learned without labels, against text whose true sentences are known."""

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import languages, sentences

#: Short forms that no list of the package has.
SHORT = {"en": ["abt", "vsl", "q.t", "hdq"], "de": ["bspw", "zzgl", "k.w", "abt"]}
NAMES = ["Anker", "Bonn", "Calder", "Doria", "Ewing", "Farrow"]
STARTS = ["The", "However", "They", "Then"]
WORDS = [a + b for a in ("ver", "lon", "mir", "tas", "gel", "pon", "sur", "kri") for b in ("dan", "lem", "tor", "vis", "nep", "ula", "osk")]


def made(rng, language, n):
    """Texts as lists of sentences."""
    texts = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(3, 9)):
            words = rng.choices(WORDS, k=rng.randint(4, 11))
            for _ in range(rng.randint(0, 2)):
                at = rng.randint(1, len(words) - 1)
                words[at:at] = rng.choice([[rng.choice(SHORT[language]) + ".", rng.choice(NAMES)], [rng.choice("JKM") + ".", rng.choice(NAMES)], [rng.choice(SHORT[language]) + ".", rng.choice(WORDS)], [str(rng.randint(1, 99)), "%"]])
            text.append(" ".join([rng.choice(STARTS), *words]) + rng.choice(["."] * 8 + ["?", "!", '."']))
        texts.append(text)
    return texts


def ends(parts):
    out, at = set(), 0
    for p in parts:
        at += len("".join(p.split()))
        out.add(at)
    return out


@pytest.mark.parametrize("language", ["en", "de"])
def test_unseen_abbreviations_beat_short_lists(spark, language):
    rng = random.Random(language)
    train, held = made(rng, language, 400), made(rng, language, 100)
    frame = lambda texts: spark.createDataFrame([(i, language, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    model = sentences.learned(frame(train))
    assert {r.a for r in model.where("kind = 'abbreviation'").collect()} >= set(SHORT[language])
    assert {r.a for r in model.where("kind = 'starter'").collect()} >= {s.lower() for s in STARTS}
    both = sentences.split(frame(held), model).withColumn("listed", tx.sentences_in(F.col("text"), F.col("lang"))).orderBy("doc_id").collect()
    wrong = {c: sum(len(ends(r[c]) ^ ends(t)) for r, t in zip(both, held, strict=True)) for c in ("sentences", "listed")}
    total = sum(map(len, held))
    assert wrong["sentences"] <= 0.02 * total and wrong["listed"] > 0.3 * total


def test_odd_rows_of_the_splitter(spark):
    rows = [(1, None, "One two. Three."), (2, "en", None), (3, "en", ""), (4, "en", " . ... ?! "), (5, "xx", "A b.C d. E"), (6, "en", "Who? me! Yes."), (7, "en", "x" * 200_000 + ". Next")]
    docs = spark.createDataFrame([(*r, [r[0]]) for r in rows], "doc_id long, lang string, text string, `a.b` array<long>")
    model = sentences.learned(docs)
    got = {r.doc_id: r.sentences for r in sentences.split(docs, model).collect()}
    assert got[1] == ["One two.", "Three."] and got[2] == got[3] == [] and got[4] == [". ... ?!"] and got[5] == ["A b.C d. E"] and got[6] == ["Who?", "me!", "Yes."] and len(got[7]) == 2
    empty = docs.where("false")
    assert sentences.learned(empty).count() == 0 and sentences.split(empty, model).count() == 0


def test_languages_by_words(spark):
    cases = {
        "Das ist ein Bericht über die Ziele der Firma und ihre Umsetzung": "de", "Le rapport est pour les membres qui sont dans la société": "fr", "The report is for the members that are in this company": "en",
        "El informe es para los miembros que están en esta sociedad": "es", "O relatório não é para os membros que são da empresa, mas também": "pt", "Il rapporto è per gli azionisti che sono della società": "es",
        "Raport pentru membrii care sunt în societate și nu din țară": "es", "Xyzzy plugh frobnicate quuxly zorkmid grue lanterna": "en", "áé óú ñandúes brrr grrr krrr hrrr mrrr drrr prrr": "es", "short": "en", "": "en",
    }
    got = languages.with_language(spark.createDataFrame([(t, 1) for t in cases] + [(None, 1)], "text string, _words int").drop("_words"), "text").collect()
    assert {r.text: r.language for r in got} == cases | {None: "en"}


def test_languages_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) >= 100")
    found = languages.with_language(docs, "text").select((F.col("language") == F.col("lang")).cast("int").alias("right"))
    assert found.agg(F.avg("right")).first()[0] > 0.97
