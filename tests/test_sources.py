import io
import zipfile

import pytest

from tesselon.sources import readers


def pack(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.mark.parametrize("line, cells", [
    ("a,b , c", ["a", "b", "c"]), ('"a, b",c', ["a, b", "c"]), ('"say ""hi""",', ['say "hi"', ""]), ("", [""]), ('x "q, r" y,z', ["x q, r y", "z"]), ('"open, end', ["open, end"]),
])
def test_cells(line, cells):
    assert readers.split_cells(line) == cells


W = 'xmlns:w="http://w"'
DOCX = pack({"word/document.xml": f"<w:document {W}><w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:document>"})
XLSX = pack({
    "xl/workbook.xml": '<workbook><sheets><sheet name="Costs"/><sheet name="Empty"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>shared</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c t="b"><v>1</v></c><c><v>2.50</v></c><c t="inlineStr"><is><t>in</t></is></c></row><row><c><v></v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
})
A = 'xmlns:a="http://a"'
PPTX = pack({
    "ppt/slides/slide2.xml": f"<s {A}><a:t>second</a:t></s>", "ppt/slides/slide10.xml": f"<s {A}><a:t>tenth</a:t></s>", "ppt/slides/slide1.xml": f"<s {A}><a:t>first</a:t> <a:t>&lt;run&gt;</a:t></s>",
    "ppt/notesSlides/notesSlide2.xml": f"<s {A}><a:t>say it</a:t></s>",
})


def test_office_dispatch(spark):
    rows = [("a.docx", DOCX), ("b.xlsx", XLSX), ("c.CSV", b'h,"x, y"\n\n1,2\r\n'), ("d.pptx", PPTX), ("e.pptx", b"no zip"), ("f.pdf", b"%PDF-1.7"), ("g.xlsx", b"PK broken"), ("h.ppt", b"nothing")]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r["path"]: r for r in readers.parse_office(files).collect()}
    assert got["a.docx"]["text"] == "One & two\n\nthree"
    assert got["b.xlsx"]["text"] == "--- Sheet: Costs ---\nshared | TRUE | 2.50 | in"
    assert got["c.CSV"]["text"] == "h | x, y\n1 | 2"
    assert got["d.pptx"]["text"] == "--- Slide 1 ---\nfirst <run>\n--- Slide 2 ---\nsecond\nNotes: say it\n--- Slide 10 ---\ntenth"
    assert all(got[p]["text"] is None and got[p]["error"] for p in ("e.pptx", "f.pdf", "g.xlsx", "h.ppt"))
    assert files.filter(readers.looks_like_pdf(files.path, files.content)).select("path").collect() == [("f.pdf",)]


def test_folder_log_ring_and_store(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.ts").write_text("x")
    (tmp_path / "src" / "node_modules" / "b.js").write_text("y")
    got = {r["path"]: (r["language"], r["skip_reason"]) for r in readers.read_folder(spark, str(tmp_path / "src")).collect()}
    assert got == {"a.ts": ("ts", None), "node_modules/b.js": ("ts", "vendor and build folders")}
    lines = spark.createDataFrame([('{"kind":"answer","latency":{"totalMs":3}}',), ("broken",), ('{"kind":"other"}',), ('{"records":[{"kind":"dropped"},{"kind":"event","event":"SIGNUP"}]}',)], "value string")
    assert sorted(r["kind"] for r in readers.read_log(lines).collect()) == ["answer", "dropped", "event"]
    for i in range(3):
        readers.write_ring(spark.range(i * 10, i * 10 + 10), str(tmp_path / "ring"), "id")
    assert sorted(r["id"] for r in readers.read_ring(spark, str(tmp_path / "ring"), "id", 12).collect()) == list(range(18, 30))
    store = str(tmp_path / "store")
    readers.write_partitioned(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), store, ["k"])
    readers.write_partitioned(spark.createDataFrame([("a", 9)], "k string, v int"), store, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(store).collect()) == [("a", 9), ("b", 2)]


def test_batch_plan(spark):
    files = spark.createDataFrame([(1, 0, "a", 10), (1, 1, "a", 10), (1, 2, "old", 30), (1, 3, "b", 95), (1, 4, "c", 40), (1, 5, "", 1), (1, 6, "d", 20), (1, 7, "e", 1)], "context_id int, ord long, path string, size long")
    old = spark.createDataFrame([(1, "old", 30)], "context_id int, path string, size long")
    got = [r["verdict"] for r in sorted(readers.accept_batch(files, old, 3, 100, 90).collect(), key=lambda r: r["ord"])]
    assert got == ["accept", "duplicate name", "replace", "too large", "accept", "no name", "too many", "too many"]


def test_reports_and_wav(spark):
    claims = spark.sql("select 1 meeting_id, timestamp'2024-01-01' ts, 'i1' id, 'Ann' speaker, 'ships friday' text, 'contradicted' status union all select 1, timestamp'2024-01-02', 'i2', 'Bo', 'ok', 'supported'")
    assert readers.claim_report(claims).first()["report"] == "# Claims: 2, contradicted: 1\n- [contradicted] Ann: ships friday\n- [supported] Bo: ok"
    items = spark.sql("select 's' session, timestamp'2024-01-01' ts, 'q1' question, true supported, 'a1' say union all select 's', timestamp'2024-01-02', 'q2', false, null")
    r = readers.session_receipt(items).first()
    assert (r["answered"], r["unsupported"], r["text"]) == (1, 1, "Q: q1 A: a1\nQ: q2 (no supported answer)")
    data = readers.wav_bytes([0.0, 1.0, -1.0, 2.0])
    assert data[:4] == b"RIFF" and len(data) == 44 + 8
