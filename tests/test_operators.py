"""Operators on small literal tables, and against plain Python models on random ones."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from graphlens.operators import graph, resolve, search, store, telemetry
from graphlens.sources import extract
from graphlens.sources.generations import Store


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_store_follows_a_dict(spark, tmp_path):
    """Random edits, deletions and additions, with a compaction now and then."""
    rng, model = random.Random(4), {}
    s = Store(spark, str(tmp_path / "store"), ["path"], shard_rows=4)
    assert s.read() is None
    for step in range(9):
        batch = {}
        for _ in range(rng.randint(1, 12)):
            batch[f"f{rng.randrange(20)}"] = None if rng.random() < 0.3 else rng.randrange(1000)
        pinned, before = s.manifest(), dict(model)
        s.publish(spark.createDataFrame([(p, v, v is None) for p, v in batch.items()], "path string, hash int, deleted boolean"), base=step == 0)
        model = {} if step == 0 else model
        model = {**model, **batch}
        model = {p: v for p, v in model.items() if v is not None}
        assert {r["path"]: r["hash"] for r in s.read().collect()} == model
        if step:
            assert {r["path"]: r["hash"] for r in s.read(pinned).collect()} == before
        if step == 5:
            s.compact()
            assert not s.manifest()["overlays"] and all(e["rows"] <= 4 for e in s.manifest()["shards"]) and {r["path"]: r["hash"] for r in s.read().collect()} == model
    generation = s.manifest()["generation"]
    assert s.publish(spark.createDataFrame([], "path string, hash int, deleted boolean")) == generation and not s.due()
    with pytest.raises(FileExistsError):
        s._swap(s.manifest())


def test_coverage(spark):
    seen = spark.createDataFrame([("a", 1, 10, 1), ("a", 11, 20, 2), ("a", 22, 30, 3), ("b", 1, 5, 4)], "file string, start int, end int, seq int")
    asked = spark.createDataFrame([("a", 1, 20), ("a", 5, 22), ("a", 22, 30), ("b", 2, 6), ("c", 1, 1)], "file string, start int, end int")
    assert rows(store.covered(asked, seen, ["file"])) == [("a", 1, 20, True), ("a", 22, 30, True), ("a", 5, 22, False), ("b", 2, 6, False), ("c", 1, 1, False)]


def test_fallbacks(spark):
    df = spark.createDataFrame([(1, "a", 2, 0, 1), (1, "b", 2, 2, 3), (2, "c", 9, 0, 1), (3, "d", None, 0, 0)], "ref int, c string, n_args int, min_args int, max_args int")
    assert [r["c"] for r in resolve.by_arity(df, ["ref"]).orderBy("c").collect()] == ["b", "c", "d"]
    typed = spark.createDataFrame([(1, "a", ["int"], ["int"]), (1, "b", ["int"], ["long"]), (1, "c", ["int"], ["str"]), (2, "d", ["x"], ["y"])], "ref int, c string, arg_types array<string>, param_types array<string>")
    assert [r["c"] for r in resolve.by_argument_types(typed, ["ref"], {"int": "number", "long": "number"}).orderBy("c").collect()] == ["a", "d"]
    assert [r["c"] for r in resolve.prefer(df.drop("n_args"), ["ref"], F.col("max_args")).orderBy("c").collect()] == ["a", "c", "d"]


def test_ladder(spark):
    refs = spark.createDataFrame([(1, "p", "u", "same"), (2, "p", "u", "named"), (3, "p", "u", "unit"), (4, "p", "u", "broad"), (5, "p", "u", "any"), (6, "p", "u", "many"), (7, "p", "u", "none")], "ref_id int, path string, unit string, name string")
    symbols = spark.createDataFrame([(10, "p", "u", "same", False), (11, "q", "v", "same", True), (12, "q", "v", "named", True), (13, "q2", "u", "unit", False), (14, "q", "w", "broad", True), (15, "q", "z", "any", True), (16, "q", "z", "many", True), (17, "r", "y", "many", True), (18, "q", "z", "none", False)], "symbol_id int, path string, unit string, name string, exported boolean")
    imports = spark.createDataFrame([("p", "v", "named"), ("p", "w", None)], "path string, unit string, name string")
    got = {(r["ref_id"], r["symbol_id"]): (r["label"], r["step"]) for r in resolve.ladder(refs, symbols, imports).collect()}
    assert got == {(1, 10): ("import_resolved", 1), (2, 12): ("import_resolved", 2), (3, 13): ("import_resolved", 3), (4, 14): ("import_resolved", 4), (5, 15): ("name_matched", 5), (6, 16): ("ambiguous", 5), (6, 17): ("ambiguous", 5)}


def test_edges_and_reexports(spark):
    sites = spark.createDataFrame([("a", "b", 9, "ambiguous", 2), ("a", "b", 5, "import_resolved", 1), ("a", "b", 3, "name_matched", 1), ("a", "a", 1, "import_resolved", 1)], "caller string, callee string, line int, label string, candidates int")
    assert rows(resolve.edges(sites)) == [("a", "b", 5, "import_resolved", 1)]
    exports = spark.createDataFrame([("m", "x", "n", None), ("n", "x", "o", "y"), ("o", "*", "p", None)], "unit string, name string, source string, source_name string")
    found = resolve.reexports(spark.createDataFrame([("m", "x")], "unit string, name string"), exports)
    assert {(r["at_unit"], r["at_name"]) for r in found.collect()} == {("m", "x"), ("n", "x"), ("o", "y"), ("p", "y")}


def test_claims_and_relocation(spark):
    claims = spark.createDataFrame([(1, [], "a", "h"), (2, [1], "b", "h"), (3, [2], "c", "h"), (4, [], "d", "h")], "id int, derived_from array<int>, path string, hash string")
    now = spark.createDataFrame([("a", "new"), ("b", "h"), ("c", "h")], "path string, hash string")
    assert rows(graph.claims_status(claims, now)) == [(1, "stale"), (2, "doubted"), (3, "doubted"), (4, "live")]
    lines = spark.createDataFrame([("f", k + 1, x) for k, x in enumerate(["a", "b", "c", "a", "b", "d"])], "path string, line_no int, line string")
    import hashlib

    anchor = spark.createDataFrame([(1, "f", 5, hashlib.sha256(b"a\nb").hexdigest()), (2, "f", 1, "none")], "id int, path string, start int, hash string")
    assert rows(graph.relocate(anchor, lines, 2)) == [(1, 4)]


def test_pagerank_keeps_its_mass(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(30), rng.randrange(30)): rng.random() for _ in range(90)}
    w = spark.createDataFrame([(a, b, x) for (a, b), x in edges.items() if a != b], "src long, dst long, w double")
    got = {r["node"]: r["score"] for r in graph.personalized_pagerank(w, spark.createDataFrame([(0, 0.6), (5, 0.4)], "node long, mass double"), epsilon=1e-4).collect()}
    score, residual = {}, {0: 0.6, 5: 0.4}
    out = {}
    for (a, b), x in edges.items():
        if a != b:
            out.setdefault(a, {})[b] = x
    for _ in range(40):
        live = {n: r for n, r in residual.items() if r >= 1e-4}
        if not live:
            break
        for n in live:
            residual[n] = 0.0
        for n, r in live.items():
            if n not in out:
                score[n] = score.get(n, 0) + r
                continue
            score[n] = score.get(n, 0) + 0.25 * r
            total = sum(out[n].values())
            for m, x in out[n].items():
                residual[m] = residual.get(m, 0) + 0.75 * r * x / total
    assert got.keys() == score.keys() and all(abs(got[n] - score[n]) < 1e-9 for n in got) and sum(got.values()) <= 1 + 1e-9


def test_packing_never_exceeds_its_budget(spark):
    items = spark.createDataFrame([("q", k, str(k), 50 + k, 20, 5) for k in range(1, 60)], "query string, rank long, item string, excerpt_tokens long, signature_tokens long, handle_tokens long")
    got = graph.pack_budget(items, 700).collect()
    assert sum(r["tokens"] for r in got) <= 700 and len(got) == 40 and sum(r["zoom"] == "excerpt" for r in got) <= 8


def test_ledger_scopes(spark):
    checks = spark.createDataFrame([("t", 1, "exact", "a/x", True), ("t", 2, "directory", "a", True), ("t", 3, "workspace", "", True), ("t", 9, "exact", "a/x", True), ("t", 4, "exact", "b", False)], "task string, seq long, kind string, path string, passed boolean").withColumn("check_id", F.col("seq"))
    writes = spark.createDataFrame([("t", 5, "exact", "a/x"), ("t", 6, "directory", "c")], "task string, seq long, kind string, path string")
    assert {r["seq"]: r["current"] for r in telemetry.current_checks(checks, writes, "task").collect()} == {1: False, 2: False, 3: False, 9: True, 4: False}


def test_cost_rounds_once(spark):
    rates = {k: F.lit(v).cast("long") for k, v in {"input": 3, "output": 5, "cache_read": 1, "cache_write": 2, "cache_write_1h": 4}.items()}
    long = lambda v: F.lit(v).cast("long")
    assert spark.range(1).select(telemetry.cost(long(100_000), long(40_000), long(0), long(0), long(0), rates)).first()[0] == 1
    assert spark.range(1).select(telemetry.cost(long(166_666), long(0), long(0), long(0), long(0), rates)).first()[0] == 0


def test_grep_and_prefix(spark):
    files = spark.createDataFrame([("a", "one\ntwo\nTWO"), ("b", "two\0"), ("c", "none")], "path string, text string")
    assert rows(search.grep(files, "path", "text", "two", literal=True, ignore_case=True)) == [("a", 2, "two"), ("a", 3, "TWO")]
    assert rows(search.grep(files, "path", "text", "o", max_bytes=6)) == [("a", 1, "one"), ("a", 2, "two")]


# --- extractors ---


def test_python_facts(spark):
    code = 'import os as o\nfrom .a import b as c, d\n\nclass K:\n    """Doc."""\n    def m(self):\n        return o.path.join(f(1), x=2)\n\ndef _p():\n    pass\n'
    files = spark.createDataFrame([("k.py", code), ("bad.py", "def (")], "path string, text string")
    symbols = extract.python_facts(files, "symbols").orderBy("ord").collect()
    assert [(r["name"], r["kind"], r["receiver"], r["parent_ord"], r["exported"], r["line"]) for r in symbols] == [("K", "class", "", None, True, 4), ("m", "method", "K", 0, True, 6), ("_p", "func", "", None, False, 9)]
    assert [(r["spec"], r["alias"]) for r in extract.python_facts(files, "imports").collect()] == [("os", "o"), (".a", "c"), (".a", "d")]
    assert {(r["name"], r["qualifier"], r["n_args"], r["enclosing_ord"]) for r in extract.python_facts(files, "refs").collect()} == {("join", "o.path", 2, 1), ("f", "", 1, 1)}


def test_contract_files(spark):
    f = lambda p, t: spark.createDataFrame([(p, t)], "path string, text string")
    ddl = 'CREATE TABLE IF NOT EXISTS public."Users" (id int); -- create table no\ncreate table orders (u int references users(id), x int REFERENCES "items"(id));\ncreate view v as select 1; create materialized view mv as select 2; create unlogged table ul (a int); create global temporary table gt (a int)'
    assert rows(extract.sql_tables(f("a.sql", ddl)).select("table", F.array_join("references", ","))) == [("gt", ""), ("mv", ""), ("orders", "items,users"), ("ul", ""), ("users", ""), ("v", "")]
    proto = 'syntax="proto3"; package a.b;\nservice S { // rpc No(A) returns (B)\n rpc Get (Req) returns (stream Res) { option x = {y: 1}; }\n rpc Put(.a.Req) returns (Res); }'
    assert {(r["package"], r["service"], r["method"]) for r in extract.idl_services(f("a.proto", proto)).collect()} == {("a.b", "S", "Get"), ("a.b", "S", "Put")}
    assert rows(extract.graphql_fields(f("a.graphql", "type Query { user(id: ID!): User # c: x\n all: [User] }"))) == [("a.graphql", "Query", "all"), ("a.graphql", "Query", "user")]
    more = 'extend type A @k(x: "y: z") { b(c: Int = 3): D @deprecated(reason: "no: 1") }\nunion U = | A | B\nenum E { X Y }'
    assert rows(extract.graphql_fields(f("b.graphql", more)).select("type", "field")) == [("A", "b"), ("E", "X"), ("E", "Y"), ("U", "A"), ("U", "B")]
    thrift = "service S extends T { // no(1)\n void put(1: i32 a) throws (1: E e),\n list<string> all()\n oneway void go() }"
    assert rows(extract.thrift_services(f("a.thrift", thrift)).select("service", "method", "result")) == [("S", "all", "list<string>"), ("S", "go", "void"), ("S", "put", "void")]
    texts = {
        "Cargo.toml": '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\nlog = { version = "0.4", features = ["a"] }\n[dev-dependencies]\nt = "2"\n', "pom.xml": "<project><artifactId>me</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>a1</artifactId><version>1</version></dependency><dependency><artifactId>a2</artifactId></dependency></dependencies></project>",
        "build.gradle": "implementation 'g:a:1.0'\ntestImplementation(\"g:b\")\n", "x.csproj": '<PackageReference Include="N.J" Version="13" />', "pubspec.yaml": "name: x\ndependencies:\n  http: ^1.0\n  path: any\ndev_dependencies:\n  test: 1\n", "Package.swift": '.package(url: "https://h/p.git", from: "1.2.0")',
        "pyproject.toml": '[project]\ndependencies = [\n  "a[x]>=1",\n  "b",\n]\n', "composer.json": '{"require": {"v/p": "^1"}}',
    }
    many = spark.createDataFrame(list(texts.items()), "path string, text string")
    assert rows(extract.manifest_dependencies(many).select("dependency", "version")) == [("N.J", "13"), ("a", ">=1"), ("a1", "1"), ("a2", ""), ("b", ""), ("g:a", "1.0"), ("g:b", ""), ("http", "^1.0"), ("https://h/p.git", "1.2.0"), ("log", "0.4"), ("path", "any"), ("serde", "1.0"), ("t", "2"), ("test", "1"), ("v/p", "^1")]
    assert rows(extract.openapi_routes(f("openapi.json", '{"paths":{"/u/{id}":{"get":{"operationId":"g"},"parameters":{}}}}')).select("route", "operation")) == [("GET /u/{}", "g")]
    deps = extract.manifest_dependencies(f("x/package.json", '{"dependencies":{"a":"1"},"devDependencies":{"b":"2"}}').union(f("requirements.txt", "c==3 # x\n# no\nd[z]>=1")).union(f("go.mod", "module m\nrequire (\n\texample.org/x v1.2.0\n)")))
    assert rows(deps.select("dependency", "version")) == [("a", "1"), ("b", "2"), ("c", "==3"), ("d", ">=1"), ("example.org/x", "v1.2.0")]


def test_markdown_and_blocks(spark):
    md = "---\ntitle: x\n---\nintro\n# A\ntext\n```\n# no\n```\n## B `f.g()` see [p](docs/a.md) and GET /users/:id\n### C\n# D ABC-12 fooBar\n"
    files = spark.createDataFrame([("r.md", md)], "path string, text string")
    got = extract.markdown_sections(files).orderBy("ord").collect()
    assert [(r["level"], r["title"].split(" ")[0], r["line"], r["parent_ord"]) for r in got] == [(1, "A", 5, None), (2, "B", 10, 0), (3, "C", 11, 1), (1, "D", 12, None)]
    said = {(r["kind"], r["text"]) for r in extract.mentions(extract.markdown_sections(files), ["path", "ord"]).collect()}
    assert {("symbol", "f.g"), ("path", "docs/a.md"), ("route", "GET /users/{}"), ("ticket", "ABC-12"), ("ident", "fooBar")} <= said
    set_in = "Top\n===\ntext\n\nSub\n---\n- item\n---\n```\nNo\n===\n```\n"
    got = extract.markdown_sections(spark.createDataFrame([("s.md", set_in)], "path string, text string")).orderBy("ord").collect()
    assert [(r["level"], r["title"], r["line"], r["parent_ord"]) for r in got] == [(1, "Top", 1, None), (2, "Sub", 5, 0)]
    said = "`a/b.go` `x::Y()` `GET /v1/u` [t](../q.md#h) see https://h.org/v1/x?y and dir/f.py, AB-1 max_tokens os.Exit README.md e.g. Word `a/b.go`\n```\n`no/no.go`\n```\n"
    found = extract.mentions(spark.createDataFrame([(1, said)], "id int, text string"), ["id"])
    assert rows(found.select("kind", "text")) == [("ident", "max_tokens"), ("ident", "os.Exit"), ("path", "../q.md"), ("path", "a/b.go"), ("path", "dir/f.py"), ("route", "ANY /v1/x"), ("route", "GET /v1/u"), ("symbol", "x.Y"), ("ticket", "AB-1")]
    assert extract.mentions(spark.createDataFrame([(1, " ".join(f"`s{k}.x`" for k in range(100)))], "id int, text string"), ["id"]).count() == 64
    text = "\n".join("" if k == 70 else str(k) for k in range(150))
    assert rows(extract.text_blocks(spark.createDataFrame([("t", text)], "path string, text string"))) == [("t", 0, 1, 70), ("t", 1, 71, 130), ("t", 2, 131, 150)]


def test_docx(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>One</w:t></w:r><w:r><w:t xml:space='preserve'> two</w:t></w:r></w:p><w:p><w:t>Three</w:t></w:p>")
    files = spark.createDataFrame([("a.docx", bytearray(b.getvalue())), ("b.docx", bytearray(b"no"))], "path string, content binary")
    assert rows(extract.docx_text(files)) == [("a.docx", "One two\nThree"), ("b.docx", None)]


def test_openapi_in_yaml_and_under_a_prefix(spark):
    f = lambda *files: spark.createDataFrame(files, "path string, text string")
    swagger = '{"swagger":"2.0","basePath":"/v1/","info":{"title":"T"},"paths":{"/u/{id}":{"get":{"operationId":"g"},"parameters":[],"x-note":{}}},"definitions":{"User":{"type":"object"}}}'
    yaml = "openapi: 3.0.0\nservers:\n  - url: https://h.org/api/v2\n  - url: /other\npaths:\n  /p:\n    post:\n      operationId: make\n    patch: {}\ncomponents:\n  schemas:\n    Box: {type: object}\n    Lid: {}\n"
    files = f(("a.json", swagger), ("b.yaml", yaml), ("c.yaml", "a: [1"), ("d.json", "{}"), ("e.yaml", ""), ("f.yaml", None))
    assert rows(extract.openapi_routes(files)) == sorted([("a.json", "GET /v1/u/{}", "g"), ("b.yaml", "POST /api/v2/p", "make"), ("b.yaml", "PATCH /api/v2/p", None)], key=str)
    assert rows(extract.openapi_schemas(files)) == [("a.json", "T", "User"), ("b.yaml", "", "Box"), ("b.yaml", "", "Lid")]


def test_long_docx(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>é word</w:t></w:p>" * 100_000)
    files = spark.createDataFrame([("a.docx", bytearray(b.getvalue()))], "path string, content binary")
    text = extract.docx_text(files).first()["text"]
    assert text == "\n".join(["é word"] * 100_000)
    assert extract.docx_text(files, most_bytes=9).first()["text"] == "é word\n" and extract.docx_text(files, most_source=10).first()["text"] is None
