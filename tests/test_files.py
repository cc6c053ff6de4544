"""Readers and writers of files: no file stops the others."""

import csv as library
import io
import json
import os
import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F
from test_operators import archive

from folioflow.operators import metadata
from folioflow.sources import csv, files, office, outbox, quoted, sinks, workbooks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_every_encoding_is_read(spark, tmp_path):
    text = "Año;Valor\n" + "".join(f"ñandú {i};{i}\n" for i in range(1500))
    for name, code in (("a", "utf-8"), ("b", "latin-1"), ("c", "utf-16"), ("d", "utf-8-sig")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(code))
    (tmp_path / "e.csv").write_bytes("x".encode() * 9_999 + "é".encode() * 10)  # a character across the head's end
    (tmp_path / "f.csv").write_bytes(b"\xff\xfea\x00\xd8")  # half a character
    (tmp_path / "g.csv").write_bytes(b"\n# nothing\n")
    got = {r.path.rsplit("/", 1)[1][0]: (r.encoding, r.delimiter) for r in csv.sniffed(spark, str(tmp_path)).collect()}
    assert got == {"a": ("utf-8", ";"), "b": ("latin-1", ";"), "c": ("utf-16", ";"), "d": ("utf-8-sig", ";"), "e": ("utf-8", ","), "f": ("utf-16", ","), "g": ("utf-8", ",")}
    parsed = csv.parsed(spark, str(tmp_path))
    for name in "abcd":
        own = parsed.where(f"file = '{name}.csv' and error is null").orderBy("row").collect()
        assert [list(r.cells) for r in own[:2]] == [["Año", "Valor"], ["ñandú 0", "0"]] and len(own) == 1501
    assert [r.error for r in parsed.where("file = 'g.csv'").collect()] == ["no rows"]


def test_rows_of_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('# note\n\na,b,c\n1,"x, y",3\n2,short\n3,1,2,3\n\n"two\nlines",,"q""q"\n')
    got = csv.parsed(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r.row, r.cells, r.error) for r in got] == [
        (2, ["a", "b", "c"], None), (3, ["1", "x, y", "3"], None), (4, ["2", "short", None], None), (5, None, "4 cells where 3 are expected"), (7, ["two\nlines", None, 'q"q'], None)
    ]
    assert csv.parsed_texts(spark.createDataFrame([("f", None)], "file string, text string")).first().error == "no rows"


WESTERN = "El niño comió en la açoteia, où l'été fut très doux; die größten Bäume fällt man früh. "


@pytest.mark.parametrize("code", ["latin-1", "cp850", "mac_roman", "utf-8", "utf-16-le", "utf-16-be", "utf-32"])
def test_encodings_are_told_apart(code):
    assert csv.encoding_of((WESTERN * 3).encode(code), True) == code
    if code == "utf-8":
        assert csv.encoding_of(WESTERN.encode()[:7], True) == csv.encoding_of(WESTERN.encode()[:7], False) == "utf-8"


def test_encodings_of_marks_and_scripts():
    assert csv.encoding_of((WESTERN + "“so” – 5 €").encode("cp1252"), True) == "cp1252"
    assert csv.encoding_of("Годовой отчёт. Выбросы и отходы".encode("cp1251"), True) == "cp1251"
    assert csv.encoding_of(b"", True) == csv.encoding_of(b"abc", True) == "utf-8" and csv.encoding_of(b"\xff\xfea\x00", True) == "utf-16"


def test_delimiters_by_consistent_rows():
    assert csv.delimiter_of('a;b\n"x, y, z";1,5\n"p, q";2,5\n') == ";"
    assert csv.delimiter_of("name|note\nx|one, two, three, four\ny|five, six\n") == "|"
    assert csv.delimiter_of("a\tb c\n1\t2\n") == "\t" and csv.delimiter_of("one\ntwo\n") == "," and csv.delimiter_of("") == ","
    assert csv.delimiter_of('"a\nb;c",d\n"e\nf;g",h\n') == ","


def test_no_cell_is_too_large_and_no_row_is_cut(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1," + "x" * 300_000 + "\n2,y\n")
    (tmp_path / "b.csv").write_bytes("a,b\nx,y\x85z\n1,p\x0bq\x0c\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text('a,b\n"x\n\n# y\nz",1\n# "note, of "two\n\n \n"",2\n')
    (tmp_path / "d.csv").write_bytes(b'a,b\r\n"x\r\ny",1\rz,2\n')
    got = defaultdict(list)
    for r in csv.parsed(spark, str(tmp_path)).orderBy("row").collect():
        got[r.file[0]].append((r.row, r.cells, r.error))
    assert got["a"] == [(0, ["a", "b"], None), (1, ["1", "x" * 300_000], None), (2, ["2", "y"], None)]
    assert got["b"] == [(0, ["a", "b"], None), (1, ["x", "y…z"], None), (2, ["1", "p\x0bq"], None)]
    assert got["c"] == [(0, ["a", "b"], None), (1, ["x\n\n# y\nz", "1"], None), (8, [None, "2"], None)]
    assert got["d"] == [(0, ["a", "b"], None), (1, ["x\r\ny", "1"], None), (3, ["z", "2"], None)]


def by_the_csv_module(text, sep=","):
    """Rows with the lines before them, comments and blank rows left out by hand."""
    kept, quotes = [], quoted.Quotes(sep)
    lines = io.StringIO(text, newline="").readlines()
    i = 0
    while i < len(lines):
        row, first = lines[i], i
        if not row.startswith("#"):
            while quotes.follow(row, False).inside and i + 1 < len(lines):
                i += 1
                row += lines[i]
            kept += [(first, r) for r in library.reader(io.StringIO(row, newline=""), delimiter=sep) if len(r) > 1 or r and (not r[0] or r[0].strip())]
        i += 1
    return kept


@pytest.fixture
def small_pieces(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


PARTS = ["a", "bb", ",", ",", '"', '""', "\n", "\n", "\r\n", "\r", "#", " ", "é", '"x\ny"', ',"', '",', '"\n', "long words that go on", "\n#", '\n"']


@pytest.mark.parametrize("seed", range(12))
def test_pieces_of_files_like_the_csv_module(spark, tmp_path, small_pieces, seed):
    rng = random.Random(seed)
    texts = {f"f {i}.csv": "".join(rng.choices(PARTS, k=rng.choice((5, 60, 200)))) + "\n" for i in range(3)}
    texts["f 0.csv"] = 'x,"' + texts["f 0.csv"].replace('"', "'") * 3 + '",y\n' + texts["f 0.csv"]  # a row over many pieces
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = defaultdict(list)
    for r in quoted.scanned(spark, str(tmp_path)).collect():
        got[unquote(r.path.rsplit("/", 1)[1])].append((r.row, r.cells))
    for name, text in texts.items():
        want = by_the_csv_module(text)
        if quoted.Quotes(",").follow(text, False).inside:  # the last line break of a quote that stays open
            want[-1][1][-1] = want[-1][1][-1].removesuffix("\n")
            got[name] = sorted(got[name])
            got[name][-1][1][-1] = got[name][-1][1][-1].removesuffix("\n")
        assert sorted(got[name]) == want, text


def test_large_files_are_split(spark, tmp_path, small_pieces):
    text = "# export\nname;note\n" + "".join(f'n{i};"é {i}\n; ""q"" #"\n' for i in range(40)) + "short\n1;2;3\n"
    for name, code in (("a b.csv", "utf-8"), ("b.csv", "latin-1"), ("c.csv", "utf-16"), ("d.csv", "utf-8-sig")):
        (tmp_path / name).write_bytes(text.encode(code))
    one, many = (csv.parsed(spark, str(tmp_path), n).select("file", "row", "cells", "error") for n in (1 << 30, 100))
    assert rows(one) == rows(many) and one.where("error is null").count() == 4 * 42
    assert many.where("error is not null").select("row", "error").distinct().collect() == [(83, "3 cells where 2 are expected")]
    assert csv.form_of(b'"a\nb","c"', False) is None and csv.form_of(b'"a\nb","c"', True) == (",", "utf-8", 2) and csv.form_of(b"", True) == (",", "utf-8", 0)


def test_a_profile_finds_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Report of sales,,\nName,Region,Amount\n" + "".join(f"n{i},r{i % 3},{i * 1.5}\n" for i in range(20)))
    got = {r.name: r for r in csv.profiled(csv.parsed(spark, str(tmp_path))).collect()}
    assert set(got) == {"Name", "Region", "Amount"} and got["Amount"]["class"] == "numeric"
    assert (got["Amount"].rows, got["Amount"].low, got["Amount"].high) == (20, 0.0, 28.5) and got["Name"].mean is None


def document(tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('Metric')}{cell('2020')}</w:tr><w:tr>{cell('Water')}{cell('')}</w:tr></w:tbl>"
    core = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>Plan</dc:title><dc:creator>A. B.</dc:creator><dc:subject/></cp:coreProperties>'
    archive(tmp_path / "d.docx", {"word/document.xml": f"<w:document {w}><w:body>{p('Use of water')}{table}{p('after')}{table}</w:body></w:document>", "docProps/core.xml": core})


def test_tables_and_properties_of_documents(spark, tmp_path):
    document(tmp_path)
    (tmp_path / "bad.docx").write_bytes(b"PK nothing")
    cells = office.document_tables(spark, str(tmp_path))
    assert cells.where("error is not null").count() == 1 and cells.where("value = 'Water'").count() == 2
    texts = {r.table: (r.before, r.text) for r in office.table_texts(cells).collect()}
    assert texts == {0: ("Use of water", "Metric | 2020\nWater | "), 1: ("after", "Metric | 2020\nWater | ")}
    told = office.properties(spark, str(tmp_path / "d.docx"))
    assert {r.name: r.value for r in told.collect()} == {"title": "Plan", "creator": "A. B."}


def test_tables_on_slides(spark, tmp_path):
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    archive(tmp_path / "s.pptx", {
        "ppt/slides/slide2.xml": f"<p:sld {ns}><a:tbl><a:tr>{cell('a')}{cell('b')}</a:tr></a:tbl></p:sld>", "ppt/slides/slide10.xml": f"<p:sld {ns}><a:tbl><a:tr>{cell('c')}</a:tr></a:tbl></p:sld>",
        "ppt/slides/_rels/slide2.xml.rels": '<Relationships><Relationship Type="x/slideLayout" Target="../slideLayouts/slideLayout1.xml"/></Relationships>',
        "ppt/slideLayouts/slideLayout1.xml": f'<p:sldLayout {ns}><p:cSld name="Two columns"/></p:sldLayout>',
    })
    got = office.slide_tables(spark, str(tmp_path)).select("slide", "table", "row", "col", "value", "layout")
    assert rows(got) == [(10, 0, 0, 0, "c", None), (2, 0, 0, 0, "a", "Two columns"), (2, 0, 0, 1, "b", "Two columns")]


def test_each_kind_of_file_has_a_reader(spark, tmp_path):
    document(tmp_path)
    (tmp_path / "a.csv").write_text("x;y\n1;2\n")
    (tmp_path / "b.txt").write_text("some\n\n  text")
    (tmp_path / "c.pdf").write_bytes(b"%PDF one")
    (tmp_path / "e.json").write_text(json.dumps([{"text": "t1"}, {"k": 1}]))
    (tmp_path / "f.json").write_text("{")
    (tmp_path / "g.xlsx").write_bytes(b"\x00broken")
    (tmp_path / "h").write_bytes(b" ")
    got = files.texts(spark, str(tmp_path)).collect()
    by = {name: [(r.kind, r.text) for r in got if r.file == name] for name in {r.file for r in got}}
    assert by["a.csv"] == [("csv", "x, y"), ("csv", "1, 2")] and by["b.txt"] == [("text", "some text")] and by["c.pdf"] == [("text_fallback", "%PDF one")]
    assert by["e.json"] == [("json", "t1"), ("json", '{"k": 1}')] and by["f.json"] == [("text_fallback", "{")] and by["g.xlsx"] == [("excel", None)]
    assert ("docx", "Use of water") in by["d.docx"] and {r.error for r in got if r.file == "h"} == {"empty file"} and all(r.error for r in got if r.file == "g.xlsx")
    paged = files.texts(spark, str(tmp_path / "c.pdf"), pdf=lambda data: [data[:4].decode(), "two\nlines"])
    assert [(r.part, r.text) for r in paged.orderBy("position").collect()] == [("1", "%PDF"), ("2", "two lines")]
    assert [(r.name, r.is_folder) for r in files.listing(spark, str(tmp_path)).collect()][:2] == [("a.csv", False), ("b.txt", False)]
    assert files.json_chunks(spark, str(tmp_path / "e.json"), "text string, k int", 1).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"))
    assert rows(spark.read.schema("k int, v string").json(str(tmp_path / "j"))) == rows(df) == rows(spark.read.csv(str(tmp_path / "c"), header=True, schema="k int, v string"))
    assert sinks.runs(spark, str(tmp_path / "m")).count() == 0
    for run, n in (("r1", 1), ("r2", 5), ("r1", 2)):
        sinks.append_run(spark, str(tmp_path / "m"), run, "out", n, 0.5)
    assert rows(sinks.runs(spark, str(tmp_path / "m"))) == [("r1", "out", 2, 0.5), ("r2", "out", 5, 0.5)]
    sinks.write_graph(df, df.withColumn("type", F.lit("t/1")), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).where("type = 't/1'").count() == 2
    sinks.write_reports(spark.createDataFrame([("r", 2, "B", "two"), ("r", 1, "A", None)], "report string, n int, title string, text string"), "report", "n", "title", "text", str(tmp_path / "md"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "md/report=r"), wholetext=True).collect()) == "# r\n\n## A\n\n\n\n## B\n\ntwo\n\n"


def published(store):
    return sorted(json.loads(line)["id"] for folder in store.visible() for f in Path(folder).iterdir() for line in f.read_text().splitlines())


def test_jobs_are_stored_once(spark, tmp_path):
    df, store = spark.range(0, 120, 1, 3).withColumn("text", F.repeat(F.lit("é"), 200)), outbox.FolderStore(str(tmp_path))
    outbox.stored(df, store, "a", rows=25, most_bytes=4000)
    outbox.stored(df, store, "a", rows=25)  # again: nothing new
    outbox.stored(df.where("id < 0"), store, "empty")
    assert published(store) == list(range(120)) and len(store.visible()) == 3
    sizes = [len(f.read_bytes()) for folder in store.visible() for f in Path(folder).iterdir()]
    assert max(sizes) <= 4100 and len(sizes) == 3 * 6  # 40 rows: 25 in four, 15 in two
    assert list(outbox.halved([5, 1, 1, 9], sum, 6)) == [[5, 1], [1], [9]]


def test_what_is_refused_leaves_nothing(spark, tmp_path):
    class Refusing(outbox.FolderStore):
        def stage(self, job, attempt, batch, rows):
            if any(r["id"] == 77 for r in rows):
                raise OSError("full")
            outbox.FolderStore.stage(self, job, attempt, batch, rows)

    store = Refusing(str(tmp_path))
    with pytest.raises(Exception, match="full"):
        outbox.stored(spark.range(0, 120, 1, 3), store, "a", rows=10)
    assert published(store) == [] and not store.published("a")
    left = [p for p in (tmp_path / "staged").glob("*/*") if p.is_dir()]
    outbox.stored(spark.range(0, 120, 1, 3), outbox.FolderStore(str(tmp_path)), "a", rows=10)
    assert published(store) == list(range(120)) and not set(left) & {Path(v) for v in store.visible()}


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from folioflow.sources import outbox

class Mortal(outbox.FolderStore):
    def stage(self, job, attempt, batch, rows):
        super().stage(job, attempt, batch, rows)
        flag = self.folder + "/killed"
        if batch == 2 and rows[0]["id"] >= 100 and not os.path.exists(flag):
            open(flag, "w").close()
            os.kill(os.getpid(), 9)

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
outbox.stored(spark.range(0, 200, 1, 2), Mortal(sys.argv[1]), "a", rows=10)
"""


def test_a_task_that_is_killed_halfway_stores_each_row_once(tmp_path):
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", KILLED, str(tmp_path)], check=True, timeout=200, cwd=root, env=os.environ | {"PYTHONPATH": str(root)})
    assert (tmp_path / "killed").exists()
    assert published(outbox.FolderStore(str(tmp_path))) == list(range(200))
    assert len(list((tmp_path / "staged/a").iterdir())) == 2  # the killed attempt's batches are gone


@pytest.mark.parametrize("here, names", [("a", {"x1", "x2"}), ("a/b", {"x2"})])
def test_search_goes_below_a_folder_with_few_hits(spark, here, names):
    tree = spark.createDataFrame([("x1", "a"), ("x2", "a/b"), ("x2", "a/c"), ("x3", "b"), ("y", "a")], "name string, folder string")
    got = metadata.found_files(tree, "name", "folder", here, "x").collect()
    assert {r.name for r in got} == names and all(r.folder == "a/b" for r in got if r.name == "x2")


_SHEETS = {
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/><sheet name="Two, too" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>sh</t></si></sst>',
}


def sheet(body):
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


def test_cells_without_places_and_damaged_archives(spark, tmp_path):
    archive(tmp_path / "a.xlsx", _SHEETS | {"xl/worksheets/sheet1.xml": sheet("<row><c><v>1</v></c><c/><c t='s'><v>0</v></c></row><row r='5'><c r='C5'><v>2</v></c><c><v>3</v></c></row><row><c><v>4</v></c></row>"), "xl/worksheets/sheet2.xml": sheet("")})
    data = bytearray((tmp_path / "a.xlsx").read_bytes())
    archive(tmp_path / "b.xlsx", _SHEETS | {"xl/worksheets/sheet1.xml": sheet("<row><c t='s'><v>x</v></c></row>"), "xl/worksheets/sheet2.xml": sheet("")})
    for at in range(60, 90):
        data[at] ^= 255
    (tmp_path / "c.xlsx").write_bytes(bytes(data))
    (tmp_path / "d.xlsx").write_bytes(b"")
    # Spark's own reader leaves out files of no bytes
    for found, bad in ((office.workbook_cells(spark, str(tmp_path)), "bc"), (workbooks.cells(spark, str(tmp_path)), "bcd")):
        got = found.collect()
        assert {(r.row, r.col, r.value) for r in got if r.file == "a.xlsx"} == {(0, 0, "1"), (0, 2, "sh"), (4, 2, "2"), (4, 3, "3"), (5, 0, "4")}
        assert {r.file[0] for r in got if r.error} == set(bad)


def test_pruned_sheets_are_not_unzipped(spark, tmp_path):
    archive(tmp_path / "a.xlsx", _SHEETS | {"xl/worksheets/sheet1.xml": "no XML", "xl/worksheets/sheet2.xml": sheet("<row><c><v>1</v></c><c><v>2</v></c></row>"), "xl/sharedStrings.xml": "no XML"})
    kept = workbooks.cells(spark, str(tmp_path / "*.xlsx"), sheets=["Two, too"], columns=[1])
    assert rows(kept) == [("a.xlsx", "Two, too", 0, 1, "2", None)] and kept.rdd.getNumPartitions() == 1
    assert workbooks.cells(spark, str(tmp_path)).where("error is not null").select("sheet").collect() == [("One",)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for where in ("sheet = 'Two, too'", "sheet in ('Two, too', 'Three') and col = 0"):
            pushed = workbooks.cells(spark, str(tmp_path)).where(where)
            assert pushed.where("error is not null").count() == 0 and pushed.count() >= 1
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert workbooks.cells(spark, str(tmp_path / "none*.xlsx")).count() == 0


def test_written_workbooks_are_read_again(spark, tmp_path):
    out = spark.range(0, 5, 1, 2).select("id", F.when(F.col("id") != 2, F.concat(F.lit("<é>\x01 "), F.col("id").cast("string"))).alias("text"))
    workbooks.write(out, str(tmp_path / "w"), "A & B")
    got = workbooks.cells(spark, str(tmp_path / "w"))
    assert sorted((r.col, r.value) for r in got.where("row > 0").collect()) == [(0, str(i)) for i in range(5)] + [(1, f"<é> {i}") for i in range(5) if i != 2]
    assert {r.sheet for r in got.collect()} == {"A & B"} and sorted(p.suffix for p in (tmp_path / "w").iterdir()) == [".xlsx", ".xlsx"]

    def fail(batches):
        for b in batches:
            yield b
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        workbooks.write(out.mapInArrow(fail, out.schema), str(tmp_path / "w"))
    assert len(list((tmp_path / "w").iterdir())) == 2
