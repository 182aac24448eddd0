import pytest

from codelode.llm import handwritten as hw

CODE = "def work(a, b):\n    total = a + b\n    if total > 10:\n        raise ValueError('too much')\n    return [x * total for x in range(a)]\n\ndef rest(c):\n    return work(c, c + 1)[:3] or None\n"


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("src/a.py", CODE, None),
        ("src/a.py", "# Code generated by maker. DO NOT EDIT.\n" + CODE, "marked generated"),
        ("src/a.py", '"""\n@generated by maker 1.2\n"""\n' + CODE, "marked generated"),
        ("src/a.js", "// <auto-generated>\n//   maker 1\n// </auto-generated>\nlet a = 1;\n", "marked generated"),
        ("src/a.php", "<?php\n// Fichier généré par maker, ne pas modifier.\n$a = 1;\n", "marked generated"),
        ("src/a.py", "HEAD = '# Code generated by maker. DO NOT EDIT.'\n" + CODE, None),
        ("src/a.py", '"""Generates the queue files; the output carries its own mark."""\n' + CODE, None),
        ("src/a.py", '"""Edit freely: this module replaced the generated client by hand-written code."""\n' + CODE, None),
        ("src/a.js", "/** Auto-generated method stub */\nfunction a() {}\n", None),
        ("src/a.py", "# Copyright the own-repo contributors.\n# All rights reserved.\n" + CODE, None),
        ("lib/a.py", "# Part of otherlib 1.2.3. See the LICENSE of otherlib.\n" + CODE, "notice of another project"),
        ("lib/a.py", "# SPDX-License-Identifier: MIT\n# SPDX-FileCopyrightText: the otherlib project\n" + CODE, "notice of another project"),
        ("lib/a.py", "# SPDX-FileCopyrightText: the own-repo project\n" + CODE, None),
        ("node_modules/x/a.js", "let a = 1", "path of vendored"),
        ("areas/a1/vendor/x/a.py", CODE, "path of vendored"),
        ("src/main/java/app/vendor/A.java", "class A {}", None),
        ("src/vendors/terms.py", CODE, None),
        ("src/api/x_pb2.py", CODE, "path of generated"),
        ("web/app.min.js", "let a = 1", "path of generated"),
        ("src/a.js", "!function(e,t){" + "t.a=(e,n)=>e?n(e.w,1):void 0;" * 40 + "}()", "minified"),
        ("src/a.py", "A = [\n" + "    1.5, -2.25, 3.125, 4.0,\n" * 80 + "]\n", "data"),
        ("src/a.py", "A = (\n" + "    '" + "aZ9+" * 20 + "'\n" * 1 + ("    '" + "bY8/" * 20 + "'\n") * 20 + ")\n", "data"),
        ("src/a.py", "class T:\n" + "".join(f"    def get_{i}(self):\n        return self._s[{i}]\n\n    def set_{i}(self, value):\n        self._s[{i}] = value\n\n" for i in range(20)), "by_rule"),
        ("src/a.py", "", None),
    ],
)
def test_one_file(path, text, want):
    assert hw.judge(path, text, "own-repo") == want


def test_attributes():
    text = "# comment\n*.py linguist-generated\n/lib/** linguist-vendored\nlib/own/** -linguist-vendored\ndocs/*.js linguist-generated=false\n"
    assert hw.declared("a/b.py", [("", text)]) == {"generated": True}
    assert hw.declared("lib/x/y.js", [("", text)]) == {"vendored": True}
    assert hw.declared("lib/own/y.js", [("", text)]) == {"vendored": False}
    deeper = [("", text), ("a", "b.py -linguist-generated\n")]
    assert hw.declared("a/b.py", deeper) == {"generated": False} and hw.declared("c/b.py", deeper) == {"generated": True}
    assert hw.judge("node_modules/x.js", "let a", "", [("", "node_modules/** -linguist-vendored")]) is None
    assert hw.glob_regex("**/gen/*.[jt]s").match("a/b/gen/x.ts") and not hw.glob_regex("gen/*.ts").match("gen/a/x.ts")


def test_key_ignores_comments_and_layout():
    a = hw.code_key(CODE, "py")
    assert a == hw.code_key("# local patch: x\n" + CODE.replace("    ", "\t").replace("\n", "\r\n"), "py") != hw.code_key(CODE.replace("10", "11"), "py")
    assert hw.code_key("# package\n", "py") is None


def test_table(spark):
    files = [(i, r, p) for i, r, p in [(1, 1, "a/x.py"), (1, 1, "a/x.py"), (2, 2, "b/x.py"), (3, 3, "x.py"), (4, 1, "other/x.py"), (5, 1, "c.md"), (6, 1, None), (7, None, "d/y.js"), (8, 4, ".gitattributes"), (9, 4, "odd/z.py"), (10, 5, "__init__.py"), (11, 6, "__init__.py"), (12, 7, "__init__.py")]]
    f = spark.createDataFrame([(*x, 0, "n") for x in files], "id long, repository_id long, path string, size int, own string")
    c = spark.createDataFrame([(1, CODE), (1, CODE), (2, "# patched\n" + CODE), (3, CODE), (4, CODE + "y = 1\n"), (5, CODE), (6, CODE), (7, None), (8, "odd/** linguist-vendored"), (9, "x = 1"), (10, ""), (11, ""), (12, "")], "file_id long, content string")
    r = spark.createDataFrame([(1, "own"), (1, "own"), (2, None)], "id long, name string")
    got = {x.file_id: x.why for x in hw.not_handwritten(f, c, r).collect()}
    assert set(got) == {1, 2, 3, 9} and got[9] == "declared vendored"
    two = f.filter("coalesce(repository_id, 0) <> 3")
    assert {x.file_id for x in hw.not_handwritten(two, c, r).collect()} == {9}
    assert hw.not_handwritten(f.limit(0), c.limit(0), r.limit(0)).count() == 0


def test_an_attribute_taken_back():
    text = "lib/** linguist-vendored\nlib/own/** !linguist-vendored\n"
    assert hw.declared("lib/own/y.js", [("", text)]) == {} and hw.declared("lib/y.js", [("", text)]) == {"vendored": True}
    assert hw.declared("lib/own/y.js", [("", text), ("lib/own", "*.js linguist-generated")]) == {"generated": True}


@pytest.mark.parametrize(("pattern", "want"), [("vendor/**", "**/vendor/**"), ("/a-b/", "**/a-b/**"), ("**/x/**", "**/x/**"), ("*_pb2.py", "**/*_pb2.py"), ("*.py", "**/*.py"), ("a/b/*.py", None), ("x.py", None)])
def test_general_patterns(pattern, want):
    assert hw.general(pattern) == want


def test_mined_patterns(spark):
    mark = "# Code generated by maker. DO NOT EDIT.\n"
    files, texts = [], []

    def add(repository, path, text):
        files.append((len(files), repository, path))
        texts.append((len(files) - 1, text))

    for r in range(1, 5):
        add(r, f"src/made/a{r}.py", mark + CODE + f"z = {r}\n")
        add(r, f"src/made/b{r}.py", CODE + f"y = {r}\n")
        add(r, f"src/main{r}.py", CODE + f"x = {r}\n")
    add(9, "odd/made/c.py", CODE + "c = 1\n")
    add(10, "odd/made/c.py", CODE + "d = 1\n")  # its repository declares something
    add(10, ".gitattributes", "docs/** linguist-generated\n")
    for r in (11, 12, 13):
        add(r, ".gitattributes", "borrowed/ linguist-vendored\n*_zz.py linguist-generated\n")
    add(14, "x/borrowed/e.py", CODE + "e = 1\n")
    add(14, "x/f_zz.py", CODE + "f = 1\n")
    add(14, "x/g.py", CODE + "g = 1\n")
    f = spark.createDataFrame(files, "id long, repository_id long, path string")
    c = spark.createDataFrame(texts, "file_id long, content string")
    got = {x.path + f":{x.repository_id}": x.why for x in hw.not_handwritten(f, c, spark.createDataFrame([(1, "own")], "id long, name string")).collect()}
    assert {p for p, w in got.items() if w == "marked generated"} == {f"src/made/a{r}.py:{r}" for r in range(1, 5)}
    assert {p for p, w in got.items() if w == "mined path of generated"} == {f"src/made/b{r}.py:{r}" for r in range(1, 5)} | {"odd/made/c.py:9", "x/f_zz.py:14"}
    assert {p for p, w in got.items() if w == "mined path of vendored"} == {"x/borrowed/e.py:14"} and len(got) == 11


def test_rules_beyond_the_broadcast_are_joined_with_salts(spark):
    f = spark.createDataFrame([(i, i % 2, f"lib/a{i}.py") for i in range(40)], "file_id long, repository_id long, path string")
    rules = spark.createDataFrame([(1, [("", "lib/** linguist-vendored")])], "repository_id long, attributes array<struct<at: string, text: string>>")
    want = {(i, "declared vendored") for i in range(1, 40, 2)}
    assert {tuple(r) for r in hw.said_of(f, rules).collect()} == {tuple(r) for r in hw.said_of(f, rules, most_bytes=0).collect()} == want
