import random

import pytest

from terrane.llm.handwritten import judge, layout, origins

PY = "import os\n\ndef read(path, limit=3):\n    with open(path) as f:\n        return f.read(limit)\n\n\ndef write(path, text):\n    # one line\n    with open(path, 'w') as f:\n        f.write(text)\n"
_rng = random.Random(1)
B64 = "".join(_rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(900))


@pytest.mark.parametrize(
    ("path", "text", "origin"),
    [
        ("/r/src/a.py", PY, None),
        ("/r/src/a.py", "# Code generated by mirrorgen from worker.proto. DO NOT EDIT.\n" + PY, "generated"),
        ("/r/src/a.go", "// Copyright the Cache authors.\n//\n// @generated by harbor from a.yaml\n\npackage a\n", "generated"),
        ("/r/src/a.java", "// Diese Datei wurde automatisch aus cache erzeugt - nicht bearbeiten\nclass A {}\n", "generated"),
        ("/r/src/a.js", "// Fichier produit automatiquement par buffer, ne pas modifier\nlet a;\n", "generated"),
        ("/r/src/a.py", "# 本文件由 worker 自动生成，请勿手动修改。\n" + PY, "generated"),
        ("/r/gen/codegen.py", '# Writes the header "DO NOT EDIT" into every file that the generator makes.\n' + PY, None),
        ("/r/src/a.py", "# The messages used here are generated by the service; this file only reads them and is maintained by hand.\n" + PY, None),
        ("/r/src/a.pb.go", None, "generated"),
        ("/r/src/y.tab.c", "", "generated"),
        ("/r/src/M.java", "class M {\n" + "".join(f"    public int getField{i}() {{ return field{i}_; }}\n" for i in range(30)) + "}\n", "generated"),
        ("/r/web/a.min.js", None, "minified"),
        ("/r/web/a.js", "!function(e,t){" + "".join(f"function f{i}(a,b){{return a?b[{i}]:null}}" for i in range(60)) + "}()", "minified"),
        ("/r/web/a.css", "".join(f".a{i}{{margin:{i}px;color:#4359ff;padding:0 29px}}" for i in range(60)), "minified"),
        ("/r/web/a.css", "".join(f".a{i} {{\n  margin: {i}px;\n  color: #4359ff;\n}}\n\n" for i in range(30)), None),
        ("/r/node_modules/x/a.py", PY, "vendored"),
        ("/r/third_party/x/a.py", PY, "vendored"),
        ("/r/src/vendor_portal/a.py", PY, None),
        ("/r/internal/vendors/a.py", PY, None),
        ("/r/tools/third_party_notice.py", PY, None),
        ("/r/src/compat/x.js", "/*!\n * kelyar v3.8.11\n * https://kelyar.example/\n * Released under the MIT license by the kelyar contributors\n */\nlet a;\n", "vendored"),
        ("/r/src/x.py", "# Copied unchanged from the jordal project, see upstream for the history.\n" + PY, "vendored"),
        ("/r/src/x.py", "# Copyright the edge team. Licensed under the same terms as the rest of this tree.\n" + PY, None),
        ("/r/data/t.py", "T = [\n" + "".join("    " + ", ".join(hex(_rng.randrange(256)) for _ in range(14)) + ",\n" for _ in range(20)) + "]\n", "data"),
        ("/r/data/t.sql", "".join(f"INSERT INTO t VALUES ({i}, 'a_b', {i * 7}, {i * 3});\n" for i in range(40)), "data"),
        ("/r/data/t.c", "const char a[] =\n" + "".join(f'    "{B64[i : i + 76]}"\n' for i in range(0, 900, 76)) + ";\n", "data"),
        ("/r/src/few.c", "#include <stdio.h>\n\nstatic const int relay[] = {\n    94, 51, 30,\n    64, 56, 86,\n};\n\nint sum(int a)\n{\n\tint total = 0;\n\tfor (int i = 0; i < a; i++)\n\t\ttotal += relay[i];\n\treturn total;\n}\n", None),
        ("/r/src/key.py", PY + f'KEY = "{B64[:200]}"\n', None),
        ("/r/docs/a.md", "word " * 3000, None),
        ("/r/src/a.py", "# Released under the MIT License.\n" + PY, None),
        ("/r/src/a.py", "# Distributed under the Apache license, version 2.\n" + PY, None),
        ("/r/src/a.py", "# kelyar v8.14.19\n# https://kelyar.example/\n# Released under the MIT license\n" + PY, "vendored"),
        ("/r/src/a.py", "# Reader v2.1\n# Released under the MIT License.\n" + PY, None),
        ("/r/external/adapter.py", PY, None),
        ("/r/src/deps/resolve.py", PY, None),
        ("/r/contrib/plugins/a.py", PY, None),
        ("/r/external/kelyar-3.8/a.py", PY, "vendored"),
        ("/r/deps/kelyar/src/a.py", PY, "vendored"),
        ("/r/src/a.py", "# emitted by protogen v3, changes will be lost\n" + PY, "generated"),
        ("/r/src/a.py", "# Rendered from table.tmpl; never edit, run make instead.\n" + PY, "generated"),
        ("/r/src/a.py", "# Built by hand from parts that may be lost.\n" + PY, None),
        ("/r/web/a.cjs", "!function(e,t){" + "".join(f"function f{i}(a,b){{return a?b[{i}]:null}}" for i in range(60)) + "}()", "minified"),
        ("/r/web/a.dart", "!function(e,t){" + "".join(f"function f{i}(a,b){{return a?b[{i}]:null}}" for i in range(60)) + "}()", "minified"),
        ("/r/web/b.js", "!function(e){for(var i=0;i<9;i++)e[i]=function(){return(i+1)}}(this)", "minified"),
        ("/r/web/c.js", "[][(![]+[])[+[]]+(![]+[])[!+[]+!+[]]]" * 40, "minified"),
        ("/r/data/d.py", "x = (\n" + "\n".join(B64[i : i + 90].replace("+", "a").replace("/", "b") for i in range(0, 900, 90)) + "\n)\n", "data"),
        ("/r/conf/a.json", "{" + '"a":1,' * 400 + "}", None),
        (None, None, None),
        ("", "", None),
    ],
)
def test_judge(path, text, origin):
    assert judge(path, None, text) == origin


_LICENCE = "".join(f"// Term {i} of a licence that is longer than most and is not about where this comes from.\n" for i in range(30))
_IMPORTS = "".join(f"import a.{c}.{c.upper()}b;\n" for c in "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize(
    ("text", "origin"),
    [
        (_LICENCE + "// Code generated by mirrorgen from worker.proto. DO NOT EDIT.\nclass A {}\n", "generated"),
        ("package a;\n" + _IMPORTS + "// @generated by harbor from a.yaml\nclass A {}\n", "generated"),
        (_LICENCE[:900] + "// Copied unchanged from the jordal project, see upstream for the history.\nclass A {}\n", "vendored"),
        (_LICENCE + "// Copied unchanged from the jordal project, see upstream for the history.\nclass A {}\n", "vendored"),
        ("/*\n" + _LICENCE.replace("// ", "") + "Copied unchanged from the jordal project.\n*/\nclass A {}\n", "vendored"),
        (_LICENCE + _IMPORTS + "class A {}\n", None),
        ('class A {\n  String t = """\n' + "x\n" * 20 + 'Copied unchanged from the jordal project.\n""";\n  String u = "copied from b";\n}\n', None),
    ],
)
def test_notes_below_long_heads(text, origin):
    assert judge("/r/src/A.java", None, text) == origin


def test_layout_of_empty_and_long_texts():
    assert layout("").lines == 0 and layout("\n\n# c\n").size == 0
    assert layout("a" * 1_000_000).longest == 1_000_000


def test_operator(spark):
    rows = [
        (1, "file", "/r/a.py", "a.py", PY, 2), (1, "file", "/r/a.py", "a.py", "# @generated by x\n" + PY, 1), (2, "dir", "/r/vendor/x", "x", None, 1),
        (3, "file", "/r/vendor/b.py", "b.py", None, None), (4, "file", None, None, None, 1), (None, "file", "/r/vendor/c.py", "c.py", PY, 1),
        (5, "file", "/r/vendor/d.py", "d.py", PY, 1), (5, "symlink", "/r/vendor/d.py", "d.py", "", 2),
    ]
    df = spark.createDataFrame(rows, "id long, kind string, path string, name string, content_head string, indexed_at_ns long").selectExpr("*", "'x' AS origin", "1L AS file_id")
    assert {(r.file_id, r.origin) for r in origins(df).collect()} == {(1, None), (3, "vendored"), (4, None)}
    assert origins(df.limit(0)).count() == 0
