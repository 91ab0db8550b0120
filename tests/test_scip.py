"""The SCIP data source on indexes written here, and the import's gates, places and targets."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from graphlens.sources import scip


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def put(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def occurrence(span, symbol, roles=0, packed=True):
    spans = put(1, b"".join(map(varint, span))) if packed else b"".join(put(1, x) for x in span)
    return spans + put(2, symbol) + (put(3, roles) if roles else b"")


def document(path, occurrences, text=None, encoding=scip.UTF8, language="go"):
    return put(2, put(1, path) + put(4, language) + (put(5, text) if text is not None else b"") + (put(6, encoding) if encoding else b"") + b"".join(put(2, occurrence(*o)) for o in occurrences))


def index(*documents):
    return put(1, put(3, "file:///w")) + b"".join(documents) + put(3, b"external") + varint(9 << 3) + varint(300)


def sym(descriptors, package="mod v1"):
    return f"scip-x m {package} {descriptors}"


@pytest.mark.parametrize("split", [1, 1000, 1 << 25])
def test_source(spark, tmp_path, split):
    docs = [(f"d{k}.go", [((j, 2, 5 + j), sym(f"p/f{k}_{j}()."), j % 2, j % 3 == 0) for j in range(k * 7 % 40)]) for k in range(60)]
    docs.append(("deep.go", [((1, 2, 3, 4), sym("T#"), 8), ((7, 300, 70_000), "local 1")]))
    for name, part in (("a", docs[:40]), ("b", docs[40:])):
        (tmp_path / name).write_bytes(index(*(document(p, o, encoding=scip.UTF16) for p, o in part)))
    found = scip.read(spark, str(tmp_path / "a"), str(tmp_path / "b"), split_bytes=split)
    want = sorted((p, *(o[0] if len(o[0]) == 4 else (*o[0][:2], o[0][0], o[0][2])), o[1], o[2] if len(o) > 2 else 0) for p, os in docs for o in os)
    rows = found.collect()
    assert sorted((r["path"], r["start_line"], r["start_char"], r["end_line"], r["end_char"], r["symbol"], r["roles"]) for r in rows) == want
    assert {(r["language"], r["encoding"], r["text_hash"]) for r in rows} == {("go", scip.UTF16, None)}
    # whole documents to a task: with the least split each its own, with a large one a task an index
    n = found.rdd.getNumPartitions()
    assert n >= 55 if split == 1 else n == 2 if split > 1 << 20 else 2 < n < 60
    by_document = found.withColumn("_task", F.spark_partition_id()).groupBy("source", "doc").agg(F.count_distinct("_task").alias("n"))
    assert by_document.where("n > 1").count() == 0


def test_cut_indexes_are_errors(spark, tmp_path):
    whole = index(document("a.go", [((0, 0, 1), sym("a()."))]), document("b.go", [((0, 0, 1), sym("b()."))]))
    for k, data in enumerate((whole[:-8 - len(put(3, b"external"))], b"\x0a\x80", b"\x13")):
        (tmp_path / f"cut{k}").write_bytes(data)
        with pytest.raises(Exception, match="ends within|wire type"):
            scip.read(spark, str(tmp_path / f"cut{k}")).collect()
    (tmp_path / "none").write_bytes(b"")
    assert scip.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(("symbol", "want"), [
    ("scip-go gomod ex.com/m v1 `a/b`/T#run().", ("scip-go gomod ex.com/m v1", [("a/b", "/"), ("T", "#"), ("run", "m")])),
    ("s m p  v x v1 A#`<init>`(+1).", ("s m p v x v1", None)), ("local 7", ("", [])), ("s m p v", None), ("s m p v A#(x)", ("s m p v", [("A", "#"), ("x", "(")])),
    ("s m p v A#[T]", ("s m p v", [("A", "#"), ("T", "[")])), ("s m p v M!", ("s m p v", [("M", "!")])), ("s m p v `a``b`.", ("s m p v", [("a`b", ".")])), ("s m p v a", None), ("s m p v `a.", None), ("", None),
])
def test_symbols(symbol, want):
    found = scip.parsed(symbol)
    if want and want[1] is None:  # two blanks are one within a field
        assert found is None or found[0].startswith("s m p v")
    else:
        assert found == want


def test_spellings():
    assert scip.spellings([("Foo", "#"), ("<init>", "m")]) == ["Foo", "constructor"] and scip.spellings([("getName", "m")]) == ["getName", "Name", "name", "get"]
    assert scip.spellings([("$anon", "#")]) == [] and scip.spellings([("+", "m")]) == [] and scip.spellings([("run", "m")]) == ["run"]


def test_places():
    assert scip.place("x.run()", 2, 5, scip.UTF8, ["run"]) == (2, "run", True, "run", True)
    assert scip.place("é𝄞.run()", 4, 7, scip.UTF16, ["run"]) == (7, "run", True, "run", True)
    assert scip.place("é𝄞.run()", 3, 6, scip.UTF32, ["run"])[1:3] == ("run", True)
    assert scip.place("rerun()", 2, 5, scip.UTF8, ["run"]) == (2, "run", False, "run", False)
    assert scip.place("\trun()", 8, 11, scip.UTF8, ["run"])[:3] == (1, "run", True)
    assert scip.place("use a as b;", 4, 10, scip.UTF8, ["a"])[:3] == (4, "a", True)
    assert scip.place("short", 9, 12, scip.UTF8, ["run"]) == (5, "", False, "", False)


RUN, USE, TYPE, EXT, LOST = sym("p/run()."), sym("p/use()."), sym("p/Box#"), sym("q/Print().", "other v2"), sym("p/gone().")
A = "func run() {}\ntype Box struct{}\nfunc use() { run(); Print() }\n"
B = "func go() { run(); x := Box{}; gone() }\nfunc run() {}\nrun()\n"


def spans(text, symbols):
    """Occurrences of the words that symbols spell, definitions where said."""
    out = []
    for line, said in enumerate(text.split("\n")):
        for word, symbol in symbols.items():
            at = said.find(word)
            while at >= 0:
                define = said[:at].endswith(("func ", "type "))
                out.append(((line, at, at + len(word)), symbol, 1 if define else 0))
                at = said.find(word, at + 1)
    return out


def imported(spark, tmp_path, documents, files, observed=None, written=None):
    (tmp_path / "i.scip").write_bytes(index(*documents))
    old = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame([(p, hashlib.sha256(t.encode()).hexdigest(), old + dt.timedelta(days=d)) for p, (t, d) in files.items()], "path string, hash string, modified timestamp")
    lines = spark.createDataFrame([(p, k, x) for p, (t, _) in files.items() for k, x in enumerate(t.removesuffix("\n").split("\n"), 1)], "path string, line_no int, line string")
    seen = None if observed is None else spark.createDataFrame(observed, "path string, hash string")
    sites, rejected = scip.imported(scip.read(spark, str(tmp_path / "i.scip")), frame, lines, seen, written)
    return sorted(tuple(r[c] for c in ("path", "line", "col", "name", "kind", "target_path", "def_line")) for r in sites.collect()), dict(map(tuple, rejected.collect()))


WORDS = {"run": RUN, "use": USE, "Box": TYPE, "Print": EXT, "gone": LOST}


def test_import(spark, tmp_path):
    docs = [document("a.go", spans(A, WORDS)), document("b.go", spans(B, WORDS)), document("a.go", spans("other\n", {"other": RUN})), document("new.go", [])]
    sites, rejected = imported(spark, tmp_path, docs, {"a.go": (A, 0), "b.go": (B, 0)})
    assert rejected == {}
    assert sites == [
        ("a.go", 3, 14, "run", "call", "a.go", 1), ("a.go", 3, 21, "Print", "call", None, None),
        ("b.go", 1, 13, "run", "call", "b.go", 2), ("b.go", 1, 25, "Box", "type", "a.go", 2),  # gone() is the workspace's, without a definition
        ("b.go", 3, 1, "run", "call", "b.go", 2),
    ]


def test_gates(spark, tmp_path):
    good = [("text.go", A), ("late.go", A), ("gone.go", A)]
    docs = [document(p, spans(t, WORDS), text=(t if p == "text.go" else None)) for p, t in good] + [document("stale.go", spans(A, WORDS), text=A + "x")]
    shifted = document("shift.go", [((line + 1, a, b), s, r) for (line, a, b), s, r in spans(A, WORDS)])
    files = {"text.go": (A, 9), "late.go": (A, 9), "stale.go": (A, 0), "shift.go": ("// one more line\n\n" + A.replace("run", "walk"), 0)}
    sites, rejected = imported(spark, tmp_path, [*docs, shifted], files, written=F.lit(dt.datetime(2024, 1, 5)))
    assert {s[0] for s in sites} == {"text.go"}
    assert rejected == {"late.go": "modified after the index was written", "gone.go": "not indexed", "stale.go": "document text differs", "shift.go": "no longer spells its symbols"}
    digest = hashlib.sha256(A.encode()).hexdigest()
    sites, rejected = imported(spark, tmp_path, [document("seen.go", spans(A, WORDS)), document("other.go", spans(A, WORDS))], {"seen.go": (A, 9), "other.go": (A, 0)}, observed=[("seen.go", digest), ("other.go", "0")])
    assert {s[0] for s in sites} == {"seen.go"} and rejected == {"other.go": "changed while the indexer ran"}


def test_aliases_are_tolerated_up_to_a_tenth(spark, tmp_path):
    for n_alias, fits in ((3, True), (4, False)):
        text = "\n".join(["func run() {}"] + ["run()"] * 10 + ["alias()"] * n_alias) + "\n"
        occurrences = spans(text, {"run": RUN}) + [((11 + k, 0, 5), RUN, 0) for k in range(n_alias)]
        sites, rejected = imported(spark, tmp_path, [document("x.go", occurrences)], {"x.go": (text, 0)})
        assert (rejected == {}) is fits and (len(sites) == 10) is fits
    for wrong in (((0, 0, 2), RUN, 0), ((0, 3, 4), RUN, 0), ((9, 0, 3), RUN, 0)):  # splits a word, is blank, past the end
        _, rejected = imported(spark, tmp_path, [document("x.go", [wrong])], {"x.go": ("run ()\n", 0)})
        assert rejected == {"x.go": "no longer spells its symbols"}
