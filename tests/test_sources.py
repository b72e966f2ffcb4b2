import json
import zipfile

import pytest

from brindle.sources import extract, files, media, sheet
from brindle.streaming import arrivals


def _workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Tickets" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Number</t></si><si><r><t>IN</t></r><r><t>C1</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Text</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>42</v></c></row></sheetData></worksheet>')


def test_sheets_of_workbooks_and_csv(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.csv").write_text('x,y\n1,"two, three"\n')
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    rows = sheet.sheets(spark.read.format("binaryFile").load(str(tmp_path)))
    got = {r["path"].rsplit("/", 1)[1]: r for r in rows.collect()}
    assert got["a.xlsx"]["headers"] == ["Number", "Column B", "Text"] and got["a.xlsx"]["cells"] == ["INC1", "", "42"] and got["a.xlsx"]["sheet"] == "Tickets"
    assert got["b.csv"]["cells"] == ["1", "two, three"] and got["b.csv"]["row_number"] == 2
    assert got["broken.xlsx"]["error"] and got["broken.xlsx"]["cells"] is None
    one = sheet.one_sheet(rows.where("sheet = 'Tickets'"))
    assert one.first()["Text"] == "42"
    sheet.register(spark)
    assert spark.read.format("sheet").load(str(tmp_path / "b.csv")).first()["y"] == "two, three"


def test_file_checks(spark, tmp_path):
    for name, content in (("a.pdf", b"x"), ("b.exe", b"x"), ("c.csv", b"")):
        (tmp_path / name).write_bytes(content)
    assert {r["filename"]: r["problem"] for r in files.scan(spark, str(tmp_path)).collect()} == {"a.pdf": None, "b.exe": "unknown_type"}
    listed = spark.createDataFrame([("/x/c.csv", 0), ("/x/d.mp4", 600 << 20)], "path string, length long")
    assert {r["filename"]: r["problem"] for r in files.with_checks(listed).collect()} == {"c.csv": "empty_file", "d.mp4": "too_large"}


def test_transcripts_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.json").write_text(json.dumps({"source_file": "v.mp4", "language": "en", "segments": [{"start": 0.0, "end": 1.5, "text": " hi "}, {"start": 2.0, "end": 3.0, "text": " "}]}))
    segments = media.segments_of(media.transcripts(spark, str(tmp_path / "in")))
    assert [(r["seg_no"], r["text"]) for r in segments.collect()] == [(1, "hi")]
    assert media.subtitles(segments).first()["entry"] == "1\n00:00:00,000 --> 00:00:01,500\nhi\n"
    media.write_sidecars(segments, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "srt")).count() == 4


def test_extractors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ntwo")

    def pages(path, content):
        for i, line in enumerate(content.decode().split("\n")):
            yield {"doc_id": "a", "page": i + 1, "x0": 0.0, "y0": 50.0, "x1": 9.0, "y1": 60.0, "height": 100.0, "text": line}

    rows = extract.blocks(spark.read.format("binaryFile").load(str(tmp_path)), pages)
    assert sorted(r["text"] for r in rows.collect()) == ["one", "two"]


def test_arrivals_are_taken_once(spark, tmp_path):
    folder, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    folder.mkdir()
    taken = lambda df, n: df.select("filename").write.mode("overwrite").parquet(f"{out}/b={n}")
    for name in ("a.csv", "b.exe"):
        (folder / name).write_text("x")
        arrivals.ingest(arrivals.arriving_files(spark, str(folder)), taken, log).awaitTermination()
    (folder / "c.csv").write_text("y")
    arrivals.ingest(arrivals.arriving_files(spark, str(folder)), taken, log).awaitTermination()
    assert sorted(r["filename"] for r in spark.read.parquet(out).collect()) == ["a.csv", "c.csv"]


def test_a_folder_of_sheets_and_uris(spark, tmp_path):
    sheet.register(spark)
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text(f"a,b\n{n},x\n{n},\n")
    (tmp_path / "_done").write_text("")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        df = spark.read.format("sheet").load(path)
        assert df.rdd.getNumPartitions() == 3 and df.columns == ["_row_number", "a", "b"]
        assert sorted(map(tuple, df.select("a", "b").collect())) == sorted((str(n), b) for n in range(3) for b in ("x", ""))


def test_a_failing_batch_does_not_end_the_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.csv").write_text("a\n1\n")
    (folder / "x.bin").write_text("?")
    taken, refused, refreshed = [], [], []

    def take(rows, number):
        names = [r["filename"] for r in rows.collect()]
        if "1.csv" in names:
            raise ValueError("no")
        taken.extend(names)

    files = arrivals.arriving_files(spark, str(folder), most_a_batch=1)
    arrivals.ingest(files, take, str(tmp_path / "log"), lambda rows, n: refused.extend((r["filename"], r["problem"]) for r in rows.collect()), refreshed.append, 0.2).awaitTermination()
    assert sorted(taken) == ["0.csv", "2.csv"] and sorted(refused) == [("1.csv", "failed: no"), ("x.bin", "unknown_type")] and len(refreshed) == 2
    arrivals.ingest(files, take, str(tmp_path / "log")).awaitTermination()
    assert len(taken) == 2  # a file is taken once


def test_images_are_written_by_document(spark, tmp_path):
    df = spark.createDataFrame([("d1", "a.png", b"1"), ("d1", "../../b.png", b"2"), ("d2", "a.png", b"3"), ("d2", "none.png", None), ("d2", "..", b"4"), (None, "x", b"5")], "doc_id string, name string, content binary")
    got = {(r["doc_id"], r["name"]): (r["image_path"], r["error"] is None) for r in media.write_images(df, f"file://{tmp_path}/figures").collect()}
    assert got == {("d1", "a.png"): ("d1/a.png", True), ("d1", "../../b.png"): ("d1/b.png", True), ("d2", "a.png"): ("d2/a.png", True), ("d2", "none.png"): (None, False), ("d2", ".."): (None, False), (None, "x"): (None, False)}
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.png")) == ["figures/d1/a.png", "figures/d1/b.png", "figures/d2/a.png"]
    assert media.write_images(df.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("parts", [0, 3])
def test_table_stream_reads_a_file_or_a_folder(spark, tmp_path, parts):
    rows = spark.range(30).selectExpr("id", "cast(id % 2 as string) as source")
    rows.repartition(parts or 1).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    if not parts:
        [one] = (tmp_path / "in" / "documents.parquet").glob("part-*.parquet")
        (tmp_path / "one").mkdir()
        one.rename(tmp_path / "one" / "documents.parquet")
    taken = []
    stream = arrivals.table_stream(spark, str(tmp_path / ("in" if parts else "one")), "documents")
    stream.writeStream.foreachBatch(lambda df, _: taken.extend(r["id"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(taken) == list(range(30))
