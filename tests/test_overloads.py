"""Parameter lists, families of types, and the choice between overloads."""

import pytest
from pyspark.sql import functions as F

from graphlens.operators import overloads
from graphlens.sources import signatures


@pytest.mark.parametrize(("signature", "name", "lang", "types"), [
    ("public static Page read(@Nullable String text, final int n, Reader r)", "read", "java", ["String", "int", "Reader"]),
    ("bool run(const char* s, XError expected, bool echo = true)", "run", "cpp", ["const char*", "XError", "bool"]),
    ("void f(int *p, char s[])", "f", "c", ["int*", "char[]"]),
    ("fun <T> mock(name: String, block: T.() -> Unit = {}): T", "mock", "kotlin", ["String", "T.() -> Unit"]),
    ("void f(void)", "f", "c", []),
    ("public void Add(this IList s, params string[] names)", "Add", "csharp", ["IList", "string[]"]),
    ("void f(int a, int b...", "f", "cpp", None),
    ("Task<R> Send<R>(IRequest<R> request, Token ct = default)", "Send", "csharp", ["IRequest<R>", "Token"]),
    ("void Resend(int a)", "Send", "csharp", None),
    ("bool run (const char* s, bool echo=true )", "run", "cpp", ["const char*", "bool"]),
    ("def f(a, b: dict[str, int] = {'(': 1}, *rest)", "f", "python", ["", "dict[str, int]", ""]),
    ("void f(@Ann(v = \"a, b)\") Map<K, V> m)", "f", "java", ["Map<K, V>"]),
    ("func f(_ a: Int, with b: @escaping (Int) -> Void)", "f", "swift", ["Int", "@escaping (Int) -> Void"]),
    ("void g(int)", "f", "c", None), ("", "f", "c", None), (None, "f", "c", None), ("f('x", "f", "c", None), ("f(a]", "f", "c", None),
])
def test_parameters(signature, name, lang, types):
    found = signatures.parameters(signature, name, lang)
    assert (None if found is None else [p["type"] for p in found]) == types


def test_parameter_marks():
    p = signatures.parameters("fun f(vararg xs: Int, last: String? = null, g: (Int) -> Unit)", "f", "kotlin")
    assert [(x["name"], x["optional"], x["variadic"]) for x in p] == [("xs", False, True), ("last", True, False), ("g", False, False)]
    p = signatures.parameters("func move(from a: Int, _ b: Int, c: Int = 3)", "move", "swift")
    assert [(x["name"], x["label"], x["optional"]) for x in p] == [("a", "from", False), ("b", "", False), ("c", "c", True)]


def test_type_families(spark):
    cases = {"const char*": ("string", "char*"), "String": ("string", "String"), "int": ("number", "int"), "size_t": ("number", "size_t"), "bool": ("bool", "bool"), "char": ("char", "char"), "Object": ("any", "Object"),
             "XError": ("class", "XError"), "const std::string&": ("string", "string"), "List<User>": ("class", "List"), "": ("unknown", ""), "void *": ("any", "void*"), "a.b.Doc": ("class", "Doc"), "const ns::Doc &": ("class", "Doc"), "unsigned long": ("number", "unsigned")}
    got = spark.createDataFrame([(k,) for k in cases], "k string").select("k", signatures.type_family(F.col("k")).alias("t")).collect()
    assert {r["k"]: (r["t"]["family"], r["t"]["base"]) for r in got} == cases


def chosen(spark, calls, extends=(), types=()):
    """calls: (ref, lang, hints, [signature of each candidate])."""
    rows = [(ref, f"{ref}{k}", lang, s, hints, tp) for ref, lang, hints, sigs in calls for k, (s, tp) in enumerate((x if isinstance(x, tuple) else (x, []) for x in sigs))]
    frame = spark.createDataFrame(rows, "ref string, symbol_id string, lang string, signature string, hints array<string>, type_params array<string>")
    frame = frame.withColumns({"params": signatures.parameter_list("signature", F.lit("f"), "lang"), "accepted": F.lit(True), "own": F.lit(True), "extra": F.lit(0)})
    found = overloads.by_argument_types(frame, ["ref"], spark.createDataFrame(list(extends), "type string, base string"), spark.createDataFrame(list(types), "name string, kind string"))
    out = {}
    for r in found.collect():
        out.setdefault(r["ref"], []).append(int(r["symbol_id"][len(r["ref"]):]))
    return {k: sorted(v) for k, v in out.items()}


def test_overloads(spark):
    calls = [
        ("text", "java", ["#s", "#n"], ["f(String a, int b)", "f(int a, String b)", "f(Object a, Object b)"]),
        ("none", "java", ["#s"], ["f(int a)", "f(boolean b)"]),  # none fits: all stay
        ("named", "kotlin", ["b=#n", "a=#s"], ["f(a: String, b: Int)", "f(b: String, a: Int)", "f(x: String, y: Int)"]),
        ("lambda", "kotlin", ["#n", "#t"], ["f(n: Int, g: () -> Unit)", "f(n: Int, s: String)", "f(n: Int, m: Int, g: () -> Unit)"]),
        ("label", "swift", ["with=#n"], ["f(with n: Int)", "f(_ n: Int)", "f(by n: Int)"]),
        ("sub", "java", ["@Dog"], ["f(Animal a)", "f(Cat c)", "f(String s)"]),
        ("generic", "java", ["#s"], [("f(T t)", ["T"]), "f(int n)"]),
        ("exact", "java", ["#s"], [("f(T t)", ["T"]), "f(String s)"]),
        ("enum", "cpp", ["@Color"], ["f(int n)", "f(std::string s)"]),
        ("null", "java", ["#0"], ["f(int n)", "f(Foo x)"]),
        ("many", "java", ["#s", "#s", "#s"], ["f(String... xs)", "f(int... xs)"]),
        ("c", "c", ["#s"], ["f(int n)", "f(char* s)"]),  # no overloading: all stay
        ("one", "java", ["#s"], ["f(int n)"]), ("cut", "java", ["#s"], ["f(int n", "f(boolean b)"]), ("empty", "java", [], ["f()", "f(int n)"]),
        ("more", "kotlin", ["#n"], ["f(n: Int, m: Int)", "f(n: Int, m: Int = 2)"]),
    ]
    got = chosen(spark, calls, [("Dog", "Animal"), ("Animal", "Thing")], [("Dog", "class"), ("Color", "enum")])
    want = {"text": [0], "none": [0, 1], "named": [0], "lambda": [0], "label": [0], "sub": [0], "generic": [0], "exact": [1], "enum": [0], "null": [1], "many": [0], "c": [0, 1], "one": [0], "cut": [0], "empty": [0], "more": [1]}
    assert got == want
