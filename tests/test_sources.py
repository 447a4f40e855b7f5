import io
import os
import zipfile

import pytest

from terrane.sources import code, extract
from terrane.sources.tree import register


def tree(spark, root, **options):
    register(spark)
    reader = spark.read.format("tree").option("root", str(root))
    for k, v in options.items():
        reader = reader.option(k, v)
    return {r.path.removeprefix(str(root)): r for r in reader.load().collect()}


@pytest.fixture
def files(tmp_path):
    for p in ("docs/readme.md", "src/main.go", "node_modules/x.js", "a/build/b.c", "Makefile", "blob.bin", "x.special", "src/deep/er/y.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    os.symlink("main.go", tmp_path / "src/link")
    return tmp_path


def test_tree(spark, files):
    got = tree(spark, files)
    assert set(got) == {"", "/docs", "/docs/readme.md", "/src", "/src/main.go", "/src/link", "/src/deep", "/src/deep/er", "/src/deep/er/y.py", "/a", "/Makefile"}
    assert got["/src/link"].kind == "symlink" and got["/src/link"].link_target == "main.go"
    assert got["/docs"].kind == "dir" and got["/docs"].size == 0
    assert got["/docs/readme.md"].size == 14 and got["/docs/readme.md"].mtime_ns == os.lstat(files / "docs/readme.md").st_mtime_ns
    assert "/x.special" in tree(spark, files, include="*.special") and "/docs" not in tree(spark, files, exclude="docs")
    assert "/blob.bin" in tree(spark, files, all_files="true")
    assert tree(spark, files / "nothing") == {}
    with pytest.raises(Exception, match="pattern"):
        tree(spark, files, exclude="a/b")


def test_plain_text():
    assert extract.plain_text(b"abc") == "abc" and extract.plain_text(b"a\0b") == "" and extract.plain_text(b"\xff\xfe") == ""
    assert extract.plain_text("aé".encode(), 2) == "" and extract.plain_text("aé".encode(), 3) == "aé"
    assert extract.sniff(b"%PDF-1.4") == "application/pdf" and extract.sniff(b"hello") == "text/plain; charset=utf-8"
    assert extract.sniff(b"\0\1\2") == "application/octet-stream" and extract.sniff(b"  <html>") == "text/html; charset=utf-8"


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office():
    w = 'xmlns:w="http://x"'
    doc = office(**{"word/document.xml": f"<w:d {w}><w:p><w:t>first</w:t></w:p><w:p><w:t>second</w:t><w:t>part</w:t></w:p></w:d>", "word/styles.xml": f"<w:t {w}>no</w:t>", "word/header1.xml": f"<w:t {w}>head</w:t>"})
    text, mime = extract.extract("a.DOCX", doc)
    assert text == "first \nsecond part \n\nhead" and mime.endswith("wordprocessingml.document")
    sheet = office(**{"xl/sharedStrings.xml": "<s><si><t>a</t></si></s>", "xl/worksheets/sheet1.xml": "<s><row><c><v>1</v></c></row></s>"})
    assert extract.extract("a.xlsx", sheet)[0] == "a \n\n1"
    assert extract.office_text(doc, ".docx", 20) == "first \nsecond part"
    with pytest.raises(extract.ExtractionError):
        extract.extract("a.docx", b"no zip")
    with pytest.raises(extract.ExtractionError):
        extract.office_text(office(**{"word/document.xml": "<a>" + " " * 1000 + "</a>"}), ".docx", 100)
    with pytest.raises(extract.ExtractionError):
        extract.office_text(office(**{"word/document.xml": "<a>"}), ".docx")


GO = """package a

import (
\t"fmt"
\t"os"
)

type Worker struct {
\tx int
}

func (w *Worker) RebuildIndex(a int) (int, error) {
\tif a > 0 { fmt.Println("}") } // }
\treturn helper(a), nil
}

var A, B = 1, 2

func helper(a int) int { return a }
"""


def test_go():
    got = [(c.symbol, c.start, c.end) for c in code.code_chunks(GO, ".go")]
    assert got == [("fmt,os", 3, 6), ("Worker", 8, 10), ("Worker.RebuildIndex", 12, 15), ("A,B", 17, 17), ("helper", 19, 19)]
    definitions, references = code.symbols(GO, ".go")
    assert [(d.symbol, d.start, d.end) for d in definitions] == [("RebuildIndex", 12, 15), ("helper", 19, 19)]
    assert {(r.caller, r.callee, r.line) for r in references} == {("RebuildIndex", "Println", 13), ("RebuildIndex", "helper", 14)}
    assert [c.start for c in code.code_chunks("func broken( {", ".go")] == [0]


@pytest.mark.parametrize(
    ("extension", "source", "want"),
    [
        (".py", "class A:\n    def f(self):\n        def g(): pass\n        return h()\n\nasync def k(): pass\n", [("f", 2, 4), ("k", 6, 6)]),
        (".c", "#include <x>\nstatic int foo_bar(struct a *b, int c)\n{\n  if (x) { y(); }\n}\nint z;\n", [("foo_bar", 2, 5)]),
        (".java", "public class A {\n  public int foo(String a) throws E {\n    for (int i : x) { y(); }\n  }\n}\n", [("foo", 2, 4)]),
        (".rs", "pub fn foo(a: &str) -> Result<usize, E> {\n  x();\n}\nimpl A { fn b(&self) {} }\n", [("foo", 1, 3), ("b", 4, 4)]),
        (".js", "export function a() { function b() {} }\nasync function c() {}\n", [("a", 1, 1), ("c", 2, 2)]),
    ],
)
def test_other_languages(extension, source, want):
    assert [(c.symbol, c.start, c.end) for c in code.code_chunks(source, extension)] == want


def test_functions_of_one_line_count_once():
    definitions, _ = code.symbols("function J(){a()}function J(){b.c()}", ".js")
    assert [(d.symbol, d.start) for d in definitions] == [("J", 1)]


def test_long_declarations_and_text_without_any():
    body = "func f() {\n" + "\tx = 1 // some words here\n" * 100 + "}\n"
    got = code.code_chunks("package a\n" + body, ".go")
    assert len(got) == 3 and {(c.symbol, c.start, c.end) for c in got} == {("f", 2, 103)} and all(len(c.content) <= 1200 for c in got)
    assert [(c.symbol, c.start) for c in code.code_chunks("x" * 1300, ".c")] == [("", 0), ("", 0)]
    assert code.code_chunks("   \n", ".md") == [] and code.symbols("x", ".md") == ([], [])


def test_extract_files(spark):
    df = spark.createDataFrame([("/a/b.go", bytearray(GO.encode())), ("/a/c.docx", bytearray(b"broken")), ("/a/d.md", None), ("/a/e.pdf", bytearray(b"%PDF-"))], "path string, content binary")
    got = {r.path: r for r in extract.extract_files(df).collect()}
    assert len(got["/a/b.go"].chunks) == 5 and got["/a/b.go"].language == "go" and got["/a/b.go"].error is None
    assert got["/a/c.docx"].error and got["/a/c.docx"].text == "" and got["/a/d.md"].chunks == [] and got["/a/e.pdf"].error
