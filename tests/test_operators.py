"""Small exact cases."""

import io
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.functions import values as vl
from folioflow.operators import charts, chunking, graph, metadata, profile, tables, vectors
from folioflow.sources import csv, markup, office
from folioflow.streaming import events as ev


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("cell, number, lead", [("$1,234.50*", 1234.5, 1234.5), ("1.2.3", None, 1.2), ("-", None, None), ("", None, None), ("N/A", None, None), ("5d", None, 5.0), ("NaN", None, None), ("FAC001", None, 1.0)])
def test_numbers_in_cells(spark, cell, number, lead):
    assert one(spark, vl.number(F.lit(cell))) == number
    assert one(spark, vl.leading_number(F.lit(cell))) == lead


@pytest.mark.parametrize("bounds, name", [((0, 3, 0, 3), "A1:C3"), ((4, 20, 1, 26), "B5:Z20"), ((0, 10, 26, 29), "AA1:AC10"), ((0, 1, 702, 703), "AAA1:AAA1")])
def test_range_names(spark, bounds, name):
    assert one(spark, vl.a1_range(*map(F.lit, bounds))) == name


def test_accents_count_as_letters(spark):
    assert relevance(spark, "ética inclusión") == pytest.approx(min(1, 2 / (1.0986122886681098 + 1) * 0.3))
    assert one(spark, vl.normal_name(F.lit("Año-Ñandú,  S.A."))) == "añoñandú sa"


def test_relevance_counts_a_doubly_listed_word_twice(spark):
    assert relevance(spark, "social") == pytest.approx(2 / (0.6931471805599453 + 1) * 0.3)
    assert relevance(spark, "") == 0


def test_cleaning(spark):
    assert one(spark, tx.clean_text(F.lit("Page 5 of 60  a\tb \n c- d"))) == "a b c-d"
    assert one(spark, tx.clean_extracted(F.lit("sus- tainable ."))) == "sustainable."
    assert one(spark, tx.plain_characters(F.lit("Test #1: Remove @$%^&* x!"))) == "Test 1: Remove x!"
    assert one(spark, tx.sentences(F.lit("One. Two! three? Four."))) == ["One.", "Two! three?", "Four."]


def test_sentences_keep_digits_and_lose_spaces(spark):
    assert one(spark, tx.sentences(F.lit("099 units. 1 box.  Next 1. \u00a0"))) == ["099 units. 1 box.", "Next 1."]
    assert one(spark, tx.sentences(F.lit("\t0 a!\n\fB 1\n"), tx.AROUND)) == ["0 a!", "B 1"]
    assert one(spark, tx.fine_sentences(F.lit("0th of all\n1234\n1st of 11\n2 dogs 22"))) == ["0th of all", "1st of 11", "2 dogs 22"]
    assert one(spark, tx.sentences_in(F.lit(" 00 a. 1 b 1. 2 "), F.lit("en"))) == ["00 a.", "1 b 1.", "2"]


def test_chunks_keep_digits_at_the_ends_of_sentences(spark):
    df = spark.createDataFrame([(1, "0 of a. B 1. "), (2, "\u00a0")], "k long, t string")
    assert [(r.k, r.n, r.chunk, r.characters) for r in chunking.sentence_chunks(df, "k", "t", 2).collect()] == [(1, 0, "0 of a. B 1.", 12)]


def test_fine_sentences_of_long_parts_end_soon(spark):
    import time

    # many labels and end marks in one line: each pattern is tried where it can match, not up to 200 characters back from everywhere
    line = ", ".join(f"Label{i}: value {i}" for i in range(2000)) + ". " + "word " * 300_000 + "end. A: b, c. D"
    df = spark.createDataFrame([(line,)], "t string").select(tx.fine_sentences(F.col("t")).alias("s"))
    df.limit(0).collect()
    began = time.perf_counter()
    assert df.first().s[-1] == "b, c." and time.perf_counter() - began < 15


@pytest.mark.parametrize("a, b, same", [("IBM", "IBM Corporation", False), ("Acme Energy", "acme  energy", True), ("Acme Energy", "Acme Energy Co", True), ("Acme", "Zeta", False)])
def test_names(spark, a, b, same):
    assert one(spark, vl.same_name(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize("n", [0, 1, 500, 600, 601, 5000])
def test_character_chunks_cover_the_text(n):
    for text in ("x" * n, ("Some words here. " * (n // 17 + 1))[:n]):
        spans = chunking.character_spans(text)
        assert (spans == []) == (n == 0)
        if spans:
            assert spans[0][0] == 0 and spans[-1][1] == n
            assert all(a < d <= b and b < e for (a, b), (d, e) in zip(spans, spans[1:], strict=False))


def test_shares_have_other_and_need_a_total(spark):
    df = spark.createDataFrame([(f"c{i}", float(10 - i)) for i in range(10)] + [(None, 5.0)], "k string, v double")
    got = {r.category: r.value for r in charts.shares(df, "k", "v").collect()}
    assert len(got) == 9 and sum(got.values()) == pytest.approx(100)
    assert charts.shares(spark.createDataFrame([("a", 1.0), ("b", -1.0)], "k string, v double"), "k", "v").count() == 0


def test_bars_break_ties_by_category(spark):
    df = spark.createDataFrame([("b", "1"), ("a", "$1"), ("c", "bad"), (None, "9")], "k string, v string")
    assert [tuple(r) for r in charts.bars(df, "k", "v").collect()] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]


def test_outliers_need_more_than_ten_values(spark):
    ten = spark.createDataFrame([(float(i),) for i in range(9)] + [(1000.0,)], "v double")
    eleven = spark.createDataFrame([(float(i),) for i in range(10)] + [(1000.0,)], "v double")
    assert profile.without_outliers(ten, ["v"]).where("v = 1000").count() == 1
    assert profile.without_outliers(eleven, ["v"]).where("v is null").count() == 1


def test_column_classes(spark):
    df = spark.createDataFrame([("FAC001", "1,000", "2020-01-01", "2020", "True", None)] * 3, "code string, amount string, day string, year string, flag string, none string")
    got = {r["column"]: r["class"] for r in profile.classified_columns(df, df.columns).collect()}
    assert got == {"code": "categorical", "amount": "numeric", "day": "date", "year": "year", "flag": "categorical"}


def test_names_of_columns():
    assert profile.distinct_names(["a", None, "a", " ", "a"]) == ["a", "Unnamed", "a_1", "Unnamed_1", "a_2"]
    assert profile.standard_name(" Net-Zero (t) ") == "net_zero_t"


def test_empty_columns_go(spark):
    assert profile.without_empty_columns(spark.createDataFrame([(1, None)], "a int, b int")).columns == ["a"]


GRID = [["Report"], [], ["No.", "Metric", "2020", "2021", "2022"], ["1", "Carbon", "10", "9", "8"], ["2", "Water", "5", "4", "3"], ["3", "Waste", "2", "2", "1"], [], ["x"], ["Category", "Value", "Change"], ["A", "1", "2"], ["B", "3", "4"]]


def cells(spark):
    rows = [("f", "s", r, c, v) for r, row in enumerate(GRID) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "file string, sheet string, row int, col int, value string")


def test_tables_in_a_sheet(spark):
    labelled = tables.blocks(cells(spark))
    found = tables.block_bounds(labelled).orderBy("r0").collect()
    assert [r.range for r in found] == ["A3:E6", "A8:C11"]
    block = labelled.where("block = 1").select("file", "sheet", (F.col("row") - 2).alias("row"), "col", "value")
    assert tables.header_rows(tables.header_scores(block, ["file"]), ["file"]).first().header == 0


def test_section_paths(spark):
    heads = [("d", 0, 1, "Executive Summary"), ("d", 1, 3, "Detailed Analysis"), ("d", 2, 1, "Conclusion"), ("d", 3, 2, "Next")]
    got = chunking.section_paths(spark.createDataFrame(heads, "k string, p int, l int, t string"), "k", "p", "l", "t").orderBy("p").collect()
    assert got[1].full_path == "Executive Summary > Detailed Analysis" and got[2].path == ["Conclusion"] and got[3].path == ["Conclusion", "Next"]


def test_nearest_mark_before(spark):
    rows = spark.createDataFrame([("d", 0, "a"), ("d", 5, "b"), ("d", 9, "c")], "k string, p int, v string")
    marks = spark.createDataFrame([("d", 5, "M"), ("d", 8, "N")], "k string, p int, m string")
    assert [(r.v, r.m) for r in metadata.nearest_before(rows, marks, "k", "p", "m").orderBy("p").collect()] == [("a", None), ("b", "M"), ("c", "N")]


def test_tuples(spark):
    text = '("entity"|A|org|first)\n("entity"|A|org|second)\n("entity"|B)\n("relationship"|A|B|owns|7)\n("relationship"|A|B|owns|x)\nafter'
    entities, relations = graph.parsed_tuples(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    assert [(r.name, r.description) for r in entities.collect()] == [("A", "second")]
    assert [r.strength for r in relations.orderBy("position").collect()] == [7, 1]


def cliques(spark):
    pairs = [(a, b) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(4, 5)]
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, weight double")


def test_communities_of_two_cliques(spark):
    edges = cliques(spark)
    for labels in (graph.label_propagation(edges, 6), graph.local_moves(edges, 10)):
        alone = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node"))
        assert graph.modularity(edges, labels).first()[0] > graph.modularity(edges, alone).first()[0]


def test_paths_use_an_edge_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "source long, target long")
    got = {(r.node, r.length): r.paths for r in graph.paths_from(edges, [1], 3).collect()}
    assert got == {(2, 1): 1, (3, 1): 1, (3, 2): 1, (2, 2): 1, (1, 3): 2}


def test_edges_need_both_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "x")], "source string, target string")
    assert graph.resolved(edges, spark.createDataFrame([("a",), ("b",)], "name string"), "name").count() == 1


def test_zero_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "i int, v array<double>")
    assert [r.u for r in df.select(vectors.normalised("v").alias("u")).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_packed_rows_never_split(spark):
    df = spark.createDataFrame([("g", i, "x" * n) for i, n in enumerate([10, 10, 200, 10])], "g string, o int, t string")
    got = chunking.packed_rows(df, "g", "o", "t", header=5, max_rows=2, max_characters=60).orderBy("chunk").collect()
    assert [(r.row_start, r.row_end) for r in got] == [(1, 2), (3, 3), (4, 4)]


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\nName;Value\nA;1\nB;2\n")
    (tmp_path / "b.csv").write_bytes("Año,Valor\nÑ,1\n".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, r.delimiter) for r in csv.sniffed(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ("utf-8", ";"), "b.csv": ("latin-1", ",")}
    assert [tuple(r) for r in csv.read(spark, str(tmp_path / "a.csv"), ";").orderBy("Name").collect()] == [("A", "1"), ("B", "2")]
    assert csv.cells(spark, str(tmp_path / "a.csv")).where("value is not null").count() == 6


def archive(path, parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    path.write_bytes(data.getvalue())


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    archive(tmp_path / "w.xlsx", {
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>Metric</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB2"><v>3.5</v></c><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    })
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    got = office.workbook_cells(spark, str(tmp_path)).collect()
    assert {(r.sheet, r.row, r.col, r.value) for r in got if r.error is None} == {("One", 0, 0, "Metric"), ("One", 1, 27, "3.5"), ("One", 2, 1, "x")}
    assert [r.file for r in got if r.error] == ["bad.xlsx"]


def test_document_and_slides(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    archive(tmp_path / "d.docx", {"word/document.xml": f"<w:document {w}><w:body>{p('before')}{p('Scope', 'Heading1')}{p('first')}{p('second')}</w:body></w:document>"})
    got = office.document_sections(office.document_paragraphs(spark, str(tmp_path / "d.docx"))).orderBy("section").collect()
    assert [(r.heading, r.text) for r in got] == [("Introduction", "before"), ("Scope", "first\nsecond")]
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    shape = lambda t, k="": f"<p:sp><p:nvSpPr><p:nvPr>{k}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    archive(tmp_path / "s.pptx", {"ppt/slides/slide1.xml": f"<p:sld {ns}>{shape('Title', '<p:ph type=\"title\"/>')}{shape('Body')}</p:sld>"})
    assert [tuple(r)[1:] for r in office.slide_summaries(office.slide_texts(spark, str(tmp_path / "s.pptx"))).collect()] == [(1, "Title", "Title\nBody")]


def test_markup(spark):
    df = spark.createDataFrame([(1, '<a k="v"><b>1</b><b>2</b></a>'), (2, "<a>")], "i int, x string")
    got = {r.i: r for r in markup.nested_maps(df, "i", "x").collect()}
    assert got[1].json == '{"a": {"@attributes": {"k": "v"}, "b": ["1", "2"]}}' and got[2].error


def test_streamed_upserts_keep_the_latest(spark, tmp_path):
    schema, source, out = "k long, v long", str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        spark.createDataFrame([(1, i), (i + 2, i)], schema).coalesce(1).write.mode("append").parquet(source)
        ev.upsert_into(ev.read_events(spark, source, schema), out, str(tmp_path / "c"), ["k"], "v").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{out}/v1").collect())) == [(1, 1), (2, 0), (3, 1)]


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10) AS ts, 'a' AS kind, 1.0 AS value FROM range(20)")
    rows.write.parquet(str(tmp_path / "e"))
    stream = ev.windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e")), "ts", "kind", "value", "1 hour")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, ev.windowed(rows, "ts", "kind", "value", "1 hour").collect()))


def test_described_tables(spark):
    got = {(r.block, r.name): r for r in tables.described_tables(cells(spark)).collect()}
    first = {n: r for (b, n), r in got.items() if b == 1}
    assert set(first) == {"No.", "Metric", "2020", "2021", "2022"} and {r.range for r in first.values()} == {"A3:E6"}
    assert first["2020"]["class"] == "year" and first["Metric"]["class"] == "categorical" and (first["2020"].low, first["2020"].high) == (2.0, 10.0)


def test_dates_need_most_values_to_look_like_dates(spark):
    day = spark.createDataFrame([("2020-01-31",), ("31/12/2020",), ("x",), (None,)], "d string")
    assert sorted(str(r.d) for r in profile.dates(day.where("d is null or d <> 'x'"), "d").collect()) == ["2020-01-31", "2020-12-31", "None"]
    assert profile.dates(spark.createDataFrame([("2020-01",)] * 3, "d string"), "d").schema["d"].dataType.simpleString() == "string"


def test_clusters_keep_the_longest_name(spark):
    names = spark.createDataFrame([("Acme Energy", "org"), ("Acme Energy Co", "org"), ("Zeta", "org"), ("Acme Energy", "place")], "n string, t string")
    pairs = graph.similar_names(names, "n", "t")
    got = {(r.type, r.name): r.canonical for r in graph.name_clusters(names, pairs, "n", "t").collect()}
    assert got == {("org", "Acme Energy"): "Acme Energy Co", ("org", "Acme Energy Co"): "Acme Energy Co", ("org", "Zeta"): "Zeta", ("place", "Acme Energy"): "Acme Energy"}


def test_clusters_of_many_variants(spark):
    names = sorted({f"{x} {y}{z}" for x in ("red", "old", "cold", "blue") for y in ("bolt", "ring", "gear") for z in ["", "s", " Ltd", *(f" {i}" for i in range(50))]})
    df = spark.createDataFrame([("t", n) for n in names], "t string, n string")
    a, b = df.select(F.col("n").alias("a")), df.select(F.col("n").alias("b"))
    near: dict[str, set] = {n: set() for n in names}
    for r in a.crossJoin(b).where("a <> b").where(vl.same_name(F.col("a"), F.col("b"))).collect():
        near[r.a].add(r.b)
    taken: dict[str, str] = {}
    for n in sorted(names, key=lambda n: (-len(n), n)):
        if n not in taken:
            taken |= {m: n for m in [n, *near[n]] if m not in taken}
    assert {r.name: r.canonical for r in graph.name_clusters(df, graph.similar_names(df, "n", "t"), "n", "t").collect()} == taken


def relevance(spark, text):
    return tx.with_relevance(spark.createDataFrame([(text,)], "text string"), "text").first().relevance


def test_misread_text_is_mended(spark):
    assert one(spark, tx.clean_text(F.lit("energÃ­a niÃ±o Ã© café PÁGINA 3 de 10 x 4/12 y​ Â z"))) == "energía niño é café x y z"


TITLES = ["Environmental Impact", "gri 305: Emissions", "SASB Standard", "Climate", "board members", "2.1 Scope of work", "Strategy of climate-related risks", "Letter from our CEO", "Supply chain", "SDG 13: Climate", "SDGs", "methods", "3. anything, here", "12 apples", "Works Cited", "A short line", "INTRODUCCIÓN", "discusión", "1. ética básica"]
NO_TITLES = ["", "x", "environmentally", "GRI: 305", "Climate, change", "governance of risks", "letter from a CEO", "methods and results of it, too", "lower case line", "Ethics!", "A" + "b" * 41, "1.ética", "introducción general"]


@pytest.mark.parametrize("line", TITLES)
def test_titles(spark, line):
    assert one(spark, chunking.is_title(F.lit(line)))


@pytest.mark.parametrize("line", NO_TITLES)
def test_no_titles(spark, line):
    assert not one(spark, chunking.is_title(F.lit(line)))


def test_sentences_of_lists_and_by_language(spark):
    assert one(spark, tx.fine_sentences(F.lit("Scope: all sites\nWater | Waste; Air\n12.5\n• one thing here"))) == ["Scope:", "all sites", "Water", "Waste;", "• one thing here"]
    assert one(spark, tx.fine_sentences(F.lit("used 5 kWh 12.5 in all\n-item one - item two 3. third. Next one"))) == ["used 5 kWh 12.5", "in all", "- item one", "- item two", "3. third.", "Next one"]
    assert one(spark, tx.fine_sentences(F.lit("Note: (see the annex). Then more"))) == ["Note: (see the annex).", "Then more"]
    assert one(spark, tx.sentences_in(F.lit("Der z.B. kleine Fall. Ende! Dr. No"), F.lit("de"))) == ["Der z.B. kleine Fall.", "Ende!", "Dr. No"]
    assert one(spark, tx.sentences_in(F.lit("Sra. Paz llega. Sale."), F.lit("es"))) == ["Sra. Paz llega.", "Sale."]


@pytest.mark.parametrize("line, level", [
    ("Environmental Impact", 1), ("GRI 305: Emissions", 1), ("Climate change and us", 1), ("1.2 Energy use", 2), ("Governance of Climate-Related Risks", 1), ("letter from our CEO", 1), ("water usage by site", 1),
    ("SDG 13: Climate", 1), ("METHODS", 1), ("3. whatever comes, here", 1), ("Works Cited", 1), ("A short title", 1), ("Introducción", 1), ("2. Metodología aplicada", 1), ("introducción general", None), ("a plain line.", None), ("", None),
])
def test_titles(spark, line, level):
    got = chunking.header_lines(spark.createDataFrame([(1, f"some text, long enough.\n  {line}\t\nmore.")], "k int, t string"), "k", "t").collect()
    assert [(r.position, r.text, r.level) for r in got] == ([] if level is None else [(1, line, level)])


def test_long_texts_without_titles_are_cut(spark):
    texts = [(n, "\n".join(["plain, low."] * n)) for n in (50, 300, 301, 900)]
    got = chunking.header_lines(spark.createDataFrame(texts, "k int, t string"), "k", "t").collect()
    assert sorted((r.k, r.position, r.text) for r in got) == [(301, 300, "Section 1"), (900, 300, "Section 1"), (900, 600, "Section 2")]


def spans_of(texts, angles, **how):
    import numpy as np

    return chunking.semantic_spans(texts, np.array([[np.cos(a), np.sin(a)] for a in angles]), **how)


def test_semantic_spans():
    same, long_ = [0.0] * 40, "word " * 12
    assert spans_of([], []) == [] and spans_of(["a"] * 3, same[:3]) == [(0, 2)]
    assert spans_of([long_] * 7, same[:7]) == [(0, 1), (2, 3), (4, 5), (6, 6)]  # thirds, two sentences at least
    assert spans_of([long_] * 6 + ["x"], same[:7]) == [(0, 1), (2, 3), (4, 5)]  # under ten characters
    assert spans_of([long_] * 20, same[:20], most=8) == [(0, 7), (7, 14), (14, 19)]  # one sentence repeats
    turn = [0.0] * 5 + [1.5] * 5
    assert spans_of([long_] * 10, turn, overlap=0) == [(0, 4), (5, 9)]
    assert spans_of([long_] * 4 + [long_ + "and,"] + [long_] * 5, turn) == [(0, 5), (5, 9)]  # the text breaks off
    assert spans_of([long_] * 4 + ["Table 3 " + long_] + [long_] * 6, same[:11]) == [(0, 3), (4, 10)]
    assert spans_of([long_] * 4 + ["as follows:"] + [long_] * 6, same[:11]) == [(0, 3), (4, 10)]
    assert spans_of([long_] * 7 + ["Table 3", "two"], same[:9]) == [(0, 8)]  # a short neighbour of the same subject
    assert spans_of([long_] * 7 + ["Table 3", "two"], [0.0] * 7 + [1.5] * 2) == [(0, 6), (7, 8)]


def test_semantic_chunks_of_documents(spark):
    rows = [(d, i, "word " * 12, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for d in ("a", "b", None) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, o int, s string, v array<double>").repartition(3)
    got = chunking.semantic_chunks(df, "k", "o", "s", "v").collect()
    assert sorted(map(repr, ((r.k, r.chunk, r.first, r.last, r.words) for r in got))) == sorted(repr((d, n, 5 * n, 5 * n + 4, 60)) for d in ("a", "b", None) for n in (0, 1))
    assert chunking.semantic_chunks(df.limit(0), "k", "o", "s", "v").count() == 0


def test_limited_chunks_keep_the_last_sentence(spark):
    rows = [("d", i, "One" if i < 6 else "Two", "s" * 20, [1.0, 0.0] if i % 6 < 3 else [0.0, 1.0]) for i in range(8)]
    got = chunking.limited_chunks(spark.createDataFrame(rows, "k string, o int, h string, s string, v array<double>"), "k", "o", "h", "s", "v", least=0).orderBy("chunk").collect()
    assert [(r.heading, r.first, r.last) for r in got] == [("One", 0, 5), ("Two", 6, 7)]
    short = chunking.limited_chunks(spark.createDataFrame(rows, "k string, o int, h string, s string, v array<double>"), "k", "o", "h", "s", "v").collect()
    assert [(r.first, r.last) for r in short] == [(0, 7)]


def test_islands_cross_bands(spark):
    import random

    rng = random.Random(1)
    filled = {(r, c) for r in range(40) for c in range(12) if rng.random() < 0.55}
    df = spark.createDataFrame([("f", "s", r, c, "x") for r, c in filled], "file string, sheet string, row int, col int, value string")
    seen, want = {}, 0
    for start in sorted(filled):
        if start not in seen:
            todo = [start]
            while todo:
                r, c = todo.pop()
                if (r, c) in filled and (r, c) not in seen:
                    seen[r, c] = want
                    todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
            want += 1
    for band in (1, 7, 1000):
        assert {(r.row, r.col): r.block for r in tables.blocks(df, band).collect()} == seen


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.normal(size=1000)] + [("b", float(i % 4)) for i in range(37)] + [("c", 5.0), ("d", None)]
    got = {r.k: r.q for r in profile.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.0, 0.25, 0.5, 0.9]).collect()}
    for k in "abc":
        assert np.allclose(got[k], np.quantile([v for n, v in rows if n == k], [0.0, 0.25, 0.5, 0.9]))
    assert "d" not in got


def test_similar_names_against_all_pairs(spark):
    names = ["Bay", "eBay", "AcmeCorp", "TheAcmeCorp", "Acme Corp", "acme corp.", "Corp Acme", "a", "ab", "abc", "Energy of North Spain", "Energy of North Spian", "--", "!!", "North Energy Spain of", "abcd", "bcd", "x y z", "z y x"]
    df = spark.createDataFrame([(n, "t") for n in names], "n string, t string")
    got = {(r.a, r.b) for r in graph.similar_names(df, "n", "t").collect()}
    a, b = df.select(F.col("n").alias("a")), df.select(F.col("n").alias("b"))
    want = {(r.a, r.b) for r in a.crossJoin(b).where("a < b").where(vl.same_name(F.col("a"), F.col("b"))).collect()}
    assert got == want and ("Bay", "eBay") in want and ("!!", "--") in want


def test_similar_names_of_many_words_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    names = {" ".join(rng.sample("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi".split(), rng.randint(1, 13))) for _ in range(40)}
    for n in sorted(names):
        w = n.split()
        names |= {" ".join(w[1:]) or "a", n + "x", " ".join([*w, "co", "ltd"]), " ".join(rng.sample(w, len(w))), n[3:], n.replace("a", "e", 1), "a" * len(n)}
    df = spark.createDataFrame([(n, "t") for n in sorted(names)] + [("alpha", None), (None, "t")], "n string, t string")
    got = {(r.a, r.b) for r in graph.similar_names(df, "n", "t").collect()}
    a, b = df.where("t = 't' and n is not null").select(F.col("n").alias("a")), df.where("t = 't'").select(F.col("n").alias("b"))
    assert got == {(r.a, r.b) for r in a.crossJoin(b).where("a < b").where(vl.same_name(F.col("a"), F.col("b"))).collect()}


def test_names_of_few_words_meet_few_others(spark):
    words = [f"{x} {y}" for x in ("red", "old", "hot", "blue") for y in ("bolt", "ring", "gear", "plate")]
    df = spark.createDataFrame([("t", f"{w} {i}".strip()) for w in words for i in ["", "ltd", *range(60)]], "type string, n string")
    df = df.withColumn("plain", F.col("n")).withColumn("len", F.length("n"))
    # meeting by a single common word would make over 100,000 pairs of 992 names
    assert graph._sharing_words(df).count() < 5 * df.count() and graph._holding(df).count() < 12 * df.count()


def test_linked_groups(spark):
    import random

    rng = random.Random(2)
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(0, 60) if i % 20] + [("hub", f"h{i}") for i in range(30)]
    rng.shuffle(edges)
    got = {r.node: r.group for r in graph.linked_groups(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got[f"{i:03d}"] == f"{(i - 1) // 20 * 20 + 1:03d}" for i in range(1, 61)) and {got[f"h{i}"] for i in range(30)} == {"h0"} and got["hub"] == "h0"


def test_louvain_finds_a_ring_of_cliques(spark):
    ring = [(10 * g + a, 10 * g + b) for g in range(6) for a in range(5) for b in range(a)] + [(10 * g, 10 * ((g + 1) % 6) + 1) for g in range(6)]
    edges = spark.createDataFrame([(min(e), max(e), 1.0) for e in ring], "a long, b long, weight double")
    labels = graph.louvain(edges, 2, 6)
    got = {r.node: r.community for r in labels.collect()}
    assert len(got) == 30 and all(len({got[10 * g + a] for a in range(5)}) == 1 for g in range(6))
    best = graph.modularity(edges, spark.createDataFrame([(n, n // 10) for n in got], "node long, community long")).first()[0]
    assert graph.modularity(edges, labels).first()[0] >= 0.9 * best


def test_claims_need_a_subject(spark):
    claims = spark.createDataFrame([(1, "A", "B", 1), (1, "A", "X", 2), (2, "X", "A", 1), (3, "B", None, 1)], "id int, subject string, object string, updated int")
    vertices = spark.createDataFrame([("A", "Org"), ("B", "Place")], "name string, type string")
    kept, edges = graph.placed_claims(claims, vertices, "name")
    assert sorted((r.id, r.object) for r in kept.collect()) == [(1, "X"), (3, None)]
    assert sorted(map(tuple, edges.collect())) == [(1, "A", "HAS_CLAIM"), (3, "B", "HAS_CLAIM")]
    assert [(r.id, r.edges) for r in graph.claims_of(kept, edges, "A").collect()] == [(1, ["HAS_CLAIM"])]


def test_insights_of_community_0_stay(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node int, community int")
    insights = spark.createDataFrame([(0, None, "First line\nmore"), (1, "T", "x"), (None, "T", "y")], "community int, title string, text string")
    graph.store_insights(labels, insights, str(tmp_path / "i"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "i")).collect())) == [(0, 2, "First line", "First line\nmore"), (1, 1, "T", "x")]


def test_stand_in_vectors_and_recall(spark):
    import zlib

    import numpy as np

    v = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(vectors.hashed_embedding(F.col("t"), 16).alias("v")).collect()
    want = np.zeros(16)
    for w in "aba":
        want[zlib.crc32(w.encode()) % 16] += 1
    assert np.allclose(v[0].v, want / np.linalg.norm(want)) and not any(v[1].v) and not any(v[2].v)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows, centres = vectors.inverted_file(df, "k", "v")
    asked = df.where("k % 20 = 0")
    got = {(r.query, r.match) for r in vectors.probed_top_k(rows, centres, asked, "k", "v", 10, 2 * len(centres) // 3).collect()}
    exact = {(r.query, r.match) for r in vectors.top_k(df, asked, "k", "k", "v", 10).collect()}
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    assert exact == {(q, int(m)) for q in range(0, 900, 20) for m in np.argsort(-sims[q])[:10]}
    assert len(got & exact) >= 0.9 * len(exact)
    near = {(r.a, r.b) for r in vectors.approximate_pairs(df.withColumn("v", vectors.normalised("v")), "k", "v", 0.7, 1.0).collect()}
    pairs = {(int(a), int(b)) for a, b in np.argwhere(np.sqrt(np.maximum(0, 2 - 2 * sims)) < 0.7) if a < b}
    assert near <= pairs and len(near) >= 0.9 * len(pairs)


def test_queries_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(60)] + [(99, [0.0, 0.0, 0.0])], "k long, v array<double>")
    whole = sorted(map(tuple, vectors.top_k(df, df, "k", "k", "v", 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 9)
    assert sorted(map(tuple, vectors.top_k(df, df, "k", "k", "v", 3).collect())) == whole and len(whole) == 180


def test_pairs_of_blocks_are_those_that_share_a_bucket(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "PAIR_BLOCK", 40)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 16)
    x = np.random.default_rng(8).normal(size=(300, 8))
    x[50:80] = x[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k long, v array<double>").withColumn("v", vectors.normalised("v"))
    got = {(r.a, r.b): r.distance for r in vectors.approximate_pairs(df, "k", "v", 0.9, 0.5).collect()}

    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = df.select("k", array_to_vector("v").alias("_v"))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=0.5, numHashTables=6, seed=7).fit(rows)
    want = model.approxSimilarityJoin(rows, rows, 0.9, "d").select("datasetA.k", F.col("datasetB.k").alias("b"), "d").where("k < b").collect()
    assert got == {(r[0], r[1]): r[2] for r in want} and len(got) > 435


def test_best_of_equal_vectors_and_of_other_lengths(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "ROW_BLOCK", 7)
    rng = np.random.default_rng(5)
    x = [[1.0, 2.0, 3.0]] * 30 + rng.normal(size=(40, 3)).round(1).tolist() + [[0.0, 0.0, 0.0], [1.0, 2.0], None, [1.0, None, 2.0]]
    df = spark.createDataFrame([(f"k{i:02d}", v) for i, v in enumerate(x)], "k string, v array<double>")
    got = {(r.query, r["rank"]): (r.match, round(r.score, 9)) for r in vectors.top_k(df, df.where("k < 'k60'"), "k", "k", "v", 4).collect()}
    full = [(f"k{i:02d}", np.array(v)) for i, v in enumerate(x[:70])]
    for name, q in full[:60]:
        scored = sorted(((-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 9), m) for m, v in full if m != name))[:4]
        assert [got[name, n + 1] for n in range(4)] == [(m, -s) for s, m in scored]
    assert len(got) == 240


def test_all_lists_probed_find_what_exact_search_finds(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(6).normal(size=(200, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k long, v array<double>")
    rows, centres = vectors.inverted_file(df, "k", "v", 9)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 11)
    monkeypatch.setattr(vectors, "PARTS_OF_LIST", 2)
    got = {(r.query, r.match, r["rank"]) for r in vectors.probed_top_k(rows, centres, df, "k", "v", 3, len(centres)).collect()}
    assert got == {(r.query, r.match, r["rank"]) for r in vectors.top_k(df, df, "k", "k", "v", 3).collect()} and len(got) == 600
    in_list = {r.k: r.list for r in rows.collect()}
    one = vectors.probed_top_k(rows, centres, df, "k", "v", 3, 1).collect()
    assert one and all(in_list[r.query] == in_list[r.match] for r in one)


def connected(edges, labels):
    """Whether the nodes of each community reach each other within it."""
    near = {}
    for a, b, _ in edges:
        if labels[a] == labels[b]:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for c in set(labels.values()):
        members = {n for n, x in labels.items() if x == c}
        seen, todo = set(), [min(members)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near.get(n, ())
        if seen != members:
            return False
    return True


def test_leiden_parts_what_louvain_leaves_split(spark):
    """Two cliques in one community that are tied only by a node of another one."""
    cliques = [[(i + k, j + k, 1) for i in range(5) for j in range(i + 1, 5)] for k in (0, 10, 20)]
    hub = [(30, 0, 1), (30, 10, 1), *[(30, 20 + i, 2) for i in range(5)]]
    edges = [*sum(cliques, []), *hub]
    frame = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in edges], "a long, b long, weight long")
    nodes = sorted({n for e in edges for n in e[:2]})
    split = spark.createDataFrame([(n, 0 if n < 20 else 20) for n in nodes], "node long, community long")
    bad = {r.node: r.community for r in split.collect()}
    assert not connected(edges, bad)
    parts = {r.node: r.part for r in graph.refined(frame, split, 6).collect()}
    assert connected(edges, parts) and all(bad[n] == bad[p] for n, p in parts.items())
    found = graph.leiden(frame, 1, 0, split)
    got = {r.node: r.community for r in found.collect()}
    assert connected(edges, got) and len({got[0], got[10], got[20]}) == 3
    assert graph.modularity(frame, found).first()[0] > graph.modularity(frame, split).first()[0]


def test_leiden_is_connected_and_not_worse(spark):
    rng = random.Random(4)
    edges = {(i, j) for i in range(60) for j in range(i + 1, 60) if rng.random() < (0.5 if i // 10 == j // 10 else 0.04)}
    frame = spark.createDataFrame([(a, b, 1) for a, b in edges], "a long, b long, weight long")
    found, other = graph.leiden(frame, 3, 6), graph.louvain(frame, 3, 6)
    got = {r.node: r.community for r in found.collect()}
    assert connected([(a, b, 1) for a, b in edges], got) and set(got) == {n for e in edges for n in e}
    assert graph.modularity(frame, found).first()[0] >= graph.modularity(frame, other).first()[0] - 0.01


def test_latent_vectors_span_what_the_svd_spans(spark):
    draw = random.Random(2)
    topics = [[f"w{k}x{i}" for i in range(12)] for k in range(6)]
    texts = [" ".join(draw.choices(topics[i % 6], k=30 + 10 * (i % 6)) + draw.choices(topics[draw.randrange(6)], k=5)) for i in range(90)] + ["", None, "?"]
    got = {r.doc_id: np.array(r.embedding) for r in vectors.latent_vectors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 512, 6).collect()}
    counts = np.zeros((len(texts), 512))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w\w+", (t or "").lower()):
            counts[i, zlib.crc32(w.encode()) % 512] += 1
    weighed = counts * (np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1)
    weighed /= np.maximum(np.sqrt((weighed**2).sum(axis=1, keepdims=True)), 1e-300)
    u, s, vt = np.linalg.svd(weighed, full_matrices=False)
    want = u[:, :6] * s[:6]
    want /= np.maximum(np.sqrt((want**2).sum(axis=1, keepdims=True)), 1e-12)
    mine = np.array([got[i] for i in range(len(texts))])
    assert not mine[90:].any() and np.allclose(np.abs(mine[:90]), np.abs(want[:90]), atol=1e-3)
    assert np.allclose(mine[:90] @ mine[:90].T, want[:90] @ want[:90].T, atol=1e-3)
    assert vectors.latent_vectors(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", 64, 4).count() == 0


def test_latent_vectors_over_many_small_steps(spark, monkeypatch):
    texts = [" ".join(f"w{(i * k) % 40}" for k in range(1, 1 + i % 30)) for i in range(120)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: r.embedding for r in vectors.latent_vectors(df, "doc_id", "text", 64, 4).collect()}
    monkeypatch.setattr(vectors, "DENSE_ROWS", 7)
    monkeypatch.setattr(vectors, "WORDS_HELD", 3)
    steps = {r.doc_id: r.embedding for r in vectors.latent_vectors(df, "doc_id", "text", 64, 4).collect()}
    assert len(steps) == 122 and all(np.allclose(whole[k], steps[k], atol=1e-9) for k in whole)


def test_rounds_leave_no_tables_behind(spark, tmp_path, monkeypatch):
    from folioflow.plans import lineage

    monkeypatch.setattr(lineage, "shared_folder", lambda spark: str(tmp_path))
    edges = lineage.cut(spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1), (4, 5, 1)], "a long, b long, weight long"))
    labels = graph.local_moves(edges, 2)
    # those of the edges and of the labels
    assert len(list((tmp_path / "folioflow").iterdir())) == 2 and labels.count() == 5 and edges.count() == 5
