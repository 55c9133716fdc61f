import io
import zipfile

from scriptorium.sources import documents as D


def zipped(body, name=D.BODY):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, body)
    return out.getvalue()


def body(inner):
    return f'<?xml version="1.0"?><w:document xmlns:w="{D.WORD[1:-1]}"><w:body>{inner}</w:body></w:document>'


RICH = body(
    "<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>uno</w:t><w:tab/><w:t>dos é</w:t></w:r><w:del><w:r><w:delText>gone</w:delText><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>in</w:t></w:r></w:ins></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:p/><w:p><w:r><w:t xml:space='preserve'> end </w:t></w:r></w:p>"
)
FILES = {
    "a.txt": b"\xef\xbb\xbfone\r\n\r\n\r\n\r\ntwo\rx ",
    "B.TXT": b"bad \xff byte",
    "c.docx": D.word_file(["one", "two\x00\x0b", "", "", "three 𝔘"]),
    "d.docx": b"no zip",
    "e.docx": zipped("x", "other.xml"),
    "f.docx": zipped("<w:broken"),
    "g.docx": D.word_file(["word"])[:-30],
    "h.pdf": b"%PDF",
    "noextension": b"x",
    "i.txt": b"",
    "j.txt": ("é" * 25_000).encode(),
    "k.docx": zipped(RICH),
    "l.txt": ("x" + "𝔘" * 12_000).encode(),
}


def test_files_become_rows(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["chars"], r["truncated"], r["error"]) for r in D.read_uploads(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("one\n\ntwo\rx", 10, False, None)
    assert got["B.TXT"] == ("bad � byte", 10, False, None)
    assert got["c.docx"] == ("one\n\ntwo\n\nthree 𝔘", 18, False, None)
    assert {n for n, r in got.items() if r[3] == "unreadable"} == {"d.docx", "e.docx", "f.docx", "g.docx"}
    assert {n for n, r in got.items() if r[3] == "unsupported"} == {"h.pdf", "noextension"}
    assert "i.txt" not in got
    assert got["j.txt"] == ("é" * 20_000, 20_000, True, None)
    assert got["k.docx"] == ("uno\tdos éin\n\ncell\n\n end", 23, False, None)
    assert got["l.txt"][1:] == (20_000, True, None) and got["l.txt"][0] == "x" + "𝔘" * 9_999 + "�"


def test_nulls_and_no_files(spark):
    df = spark.createDataFrame([(None, b"x"), ("a.txt", None), ("a.txt", b"x"), ("a.txt", b"x")], "path string, content binary")
    assert sorted((str(r["path"]), r["text"] or "", r["error"] or "") for r in D.extracted(df).collect()) == [("None", "", "unsupported"), ("a.txt", "", ""), ("a.txt", "x", ""), ("a.txt", "x", "")]
    assert D.extracted(df.where("false")).count() == 0
