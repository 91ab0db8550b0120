"""Facts of small sources in several languages, and import specs of several kinds."""

import pytest

from graphlens.sources import languages as L

SOURCES = {
    "a/b.go": ('package b\n\nimport (\n\t"fmt"\n\tx "m.org/p/q" // c\n)\n\n// func no() {}\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Do(a, b int) string {\n\tfmt.Println("}{", f(1, 2))\n\treturn x.Y()\n}\n\nfunc f() {}\n', [("T", "struct", "", 9, 11, True), ("Do", "method", "*T", 13, 16, True), ("f", "func", "", 18, 18, False)], [("fmt", ""), ("m.org/p/q", "x")], [("Println", "fmt", 14, 2, 1), ("f", "", 14, 2, 1), ("Y", "x", 15, 0, 1)]),
    "src/m.ts": ("import { a } from './util';\nimport * as ns from \"lib\";\nexport class C extends B {\n  private async go(x: number): Promise<void> {\n    a(x, [1, 2]);\n  }\n}\nexport const arrow = (y) => y;\nfunction local() { return ns.z(); }\n", [("C", "class", "", 3, 7, True), ("go", "method", "", 4, 6, False), ("arrow", "func", "", 8, 8, True), ("local", "func", "", 9, 9, False)], [("./util", ""), ("lib", "ns")], [("a", "", 5, 2, 1), ("z", "ns", 9, 0, 3)]),
    "p/K.java": ("package p;\nimport java.util.List;\npublic class K {\n  public K(int a) { super(); }\n  public List<String> names(int n) throws E {\n    return make(n);\n  }\n}\n", [("K", "class", "", 3, 8, True), ("K", "constructor", "", 4, 4, True), ("names", "method", "", 5, 7, True)], [("java.util.List", "")], [("make", "", 6, 1, 2)]),
    "s/l.rs": ("use crate::a::B;\npub struct S;\nimpl S {\n    pub fn new(x: u8) -> S {\n        go::run(x)\n    }\n}\n", [("S", "struct", "", 2, 2, True), ("S", "impl", "", 3, 7, False), ("new", "method", "S", 4, 6, True)], [("crate::a::B", "")], [("run", "go", 5, 1, 2)]),
    "r.rb": ("require 'json'\nclass A\n  def go(x)\n    puts(x)\n  end\nend\n", [("A", "class", "", 2, 6, True), ("go", "method", "A", 3, 5, True)], [("json", "")], [("puts", "", 4, 1, 1)]),
    "x_test.go": ("package x\nfunc TestA() {}\n", [("TestA", "func", "", 2, 2, True)], [], []),
    "k.kt": ("import a.b.C as D\ndata class P(val x: Int)\nfun String.up(n: Int) = f(n)\n", [("P", "class", "", 2, 2, True), ("up", "method", "String", 3, 3, True)], [("a.b.C", "D")], [("f", "", 3, 1, 1)]),
    "n.cs": ("using System.Text;\nnamespace N.M\n{\n  public class Q\n  {\n    public static int Go(int a)\n    {\n      return Run(a);\n    }\n  }\n}\n", [("N.M", "namespace", "", 2, 11, False), ("Q", "class", "", 4, 10, True), ("Go", "method", "", 6, 9, True)], [("System.Text", "")], [("Run", "", 8, 1, 2)]),
    "c.cpp": ("#include <vector>\nint A::go(int x) {\n  return f(x);\n}\n", [("go", "method", "A", 2, 4, True)], [("vector", "")], [("f", "", 3, 1, 0)]),
    "q.php": ("<?php\nuse A\\B as C;\nclass P {\n  private function go($x) { return f(); }\n}\n", [("P", "class", "", 3, 5, True), ("go", "method", "P", 4, 4, False)], [("A\\B", "C")], [("f", "", 4, 0, 1)]),
}


@pytest.mark.parametrize("path", sorted(SOURCES))
def test_facts(path):
    text, symbols, imports, refs = SOURCES[path]
    name = next(n for n, row in L.LANGUAGES.items() if path.endswith(row.extensions))
    s, i, r = L.facts(path, name, text)
    assert [(x[3], x[4], x[5], x[7], x[8], x[9]) for x in s] == symbols
    assert [(x[2], x[3]) for x in i] == imports
    assert [(x[4], x[5], x[6], x[8], x[3]) for x in r if x[4] not in ("super", "E", "P")] == refs
    assert all(x[11] == ("_test." in path) for x in s)


def test_language_facts(spark):
    files = spark.createDataFrame([(p, s[0]) for p, s in SOURCES.items()] + [("none.txt", "func f() {}"), ("empty.go", None), ("long.go", "package l\n" + "func f() { g() }\n" * 20_000)], "path string, text string").repartition(3)
    got = L.language_facts(files, "symbols")
    counts = {r["path"]: r["count"] for r in got.groupBy("path").count().collect()}
    assert counts == {p: len(s[1]) for p, s in SOURCES.items()} | {"long.go": 20_000}
    assert L.language_facts(files, "imports").where("path = 'a/b.go'").count() == 2
    assert L.language_facts(files, "refs").where("path = 'long.go'").count() == 20_000
    assert L.language_facts(files.limit(0), "refs").count() == 0


def test_import_units(spark):
    imports = [("src/app/a.ts", "typescript", "./util"), ("src/app/a.ts", "typescript", "../lib/x.js"), ("src/app/a.ts", "typescript", "./deep"), ("src/app/a.ts", "typescript", "./gone"), ("m/M.java", "java", "org.x.Y"), ("m/M.java", "java", "org.x.*"), ("m/M.java", "java", "java.util.List"), ("s/l.rs", "rust", "crate::a::b"), ("c/f.c", "c", "inc/h.h"), ("q.php", "php", "A\\B"), ("g/a.go", "go", "m.org/p/q")]
    units = ["src/app/util", "src/lib/x", "src/app/deep/index", "src/main/org/x/Y", "src/main/org/x", "a/b", "c/inc/h", "lib/A/B", "p/q", "other/util"]
    got = {(r["path"], r["spec"]): r["unit"] for r in L.import_units(spark.createDataFrame(imports, "path string, lang string, spec string"), spark.createDataFrame([(u,) for u in units], "unit string")).collect()}
    assert got == {
        ("src/app/a.ts", "./util"): "src/app/util", ("src/app/a.ts", "../lib/x.js"): "src/lib/x", ("src/app/a.ts", "./deep"): "src/app/deep/index", ("m/M.java", "org.x.Y"): "src/main/org/x/Y", ("m/M.java", "org.x.*"): "src/main/org/x",
        ("s/l.rs", "crate::a::b"): "a/b", ("c/f.c", "inc/h.h"): "c/inc/h", ("q.php", "A\\B"): "lib/A/B", ("g/a.go", "m.org/p/q"): "p/q",
    }


def test_calls_of_any_length():
    text = "def f():\n    g(" + ", ".join(f"h({k}, [{k}, 1])" for k in range(3000)) + ")\n    k()\n    m(,)\n    open(1, 2\n"
    found = L._arguments(text)
    at = {name: text.index(name) + len(name) for name in ("g(", "h(0", "k(", "m(", "open(")}
    assert found[at["g("]] == 3000 and found[at["h(0"] - 1] == 2 and found[at["k("]] == 0 and found[at["m("]] == 0 and at["open("] not in found
