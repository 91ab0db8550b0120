"""Overloads: parameter lists of signatures made of part names, and calls made of events with six candidates each."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.operators import overloads, resolve
from graphlens.plans.registry import query
from graphlens.sources.signatures import parameter_list

#: A Kotlin function with a parameter for each word of a part's name: every other one has type arguments and a default.
_EVEN, _ODD = "w || ': Int'", "'@Ann(a = \"x, )\") ' || w || ': List<Map<String, (' || w || ') -> Unit>> = f(1, mapOf(\"(\" to 2))'"
SIGNATURE = f"""'fun <T : Any> ' || 'make' || '(' || array_join(transform(split(p_name, ' '), (w, i) -> CASE WHEN i % 2 = 0 THEN {_EVEN} ELSE {_ODD} END), ', ') || ', vararg rest: String): T'"""


@query("parameter_lists", """SELECT p_partkey, string_agg(CASE WHEN i % 2 = 1 THEN w || '|Int|false|false' ELSE w || '|List<Map<String, (' || w || ') -> Unit>>|true|false' END, ';' ORDER BY i) || ';rest|String|false|true' AS params
  FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) GROUP BY p_partkey""")
def parameter_lists(t):
    """Names, types, defaults and variadics; brackets and commas within types, annotations and defaults split nothing."""
    rows = t.part.select("p_partkey", parameter_list(F.expr(SIGNATURE), F.lit("make"), F.lit("kotlin")).alias("p"))
    spelt = F.transform("p", lambda x: F.concat_ws("|", x["name"], x["type"], x["optional"].cast("string"), x["variadic"].cast("string")))
    return rows.select("p_partkey", F.array_join(spelt, ";").alias("params"))


#: The candidates of every call: a name's overloads by their only parameter.
CANDIDATES = ("void f(String s)", "void f(int n)", "void f(bool b)", "void f(Base b)", "void f(Object o)", "void f(T0 t)")
#: What stays of them by the argument and the language, worked out by hand.
KEPT = "VALUES ('#s', 'java', [0]), ('#s', 'cpp', [0]), ('#n', 'java', [1]), ('#n', 'cpp', [1]), ('#0', 'java', [0, 3, 4, 5]), ('#0', 'cpp', [0, 1, 2, 3, 4, 5]), ('', 'java', [0, 1, 2, 3, 4, 5]), ('', 'cpp', [0, 1, 2, 3, 4, 5])" + "".join(
    f", ('@T{k}', '{lang}', {[1, 2] if k == 4 and lang == 'cpp' else [3, 4, 5] if k > 2 else [3, 5]})" for k in range(5) for lang in ("java", "cpp")
)
HINT = "CASE event_type WHEN 'view' THEN '#s' WHEN 'click' THEN '#n' WHEN 'purchase' THEN concat('@T', event_id % 5) WHEN 'error' THEN '#0' ELSE '' END"


@query("overloads_by_type", f"""SELECT event_id, k::BIGINT AS symbol_id FROM (SELECT e.event_id, unnest(kept) AS k FROM (SELECT event_id, {HINT} AS hint, CASE event_id % 2 WHEN 0 THEN 'java' ELSE 'cpp' END AS lang FROM events) e JOIN ({KEPT}) AS v(hint, lang, kept) USING (hint, lang))""")
def overloads_by_type(t):
    """T1 and T2 extend T0, T0 extends Base, T4 is an enumeration."""
    lang = F.when(F.col("event_id") % 2 == 0, "java").otherwise("cpp")
    calls = t.events.select("event_id", lang.alias("lang"), F.array(F.expr(HINT)).alias("hints"))
    candidates = lambda rows: rows.select("*", F.posexplode(F.array(*map(F.lit, CANDIDATES))).alias("n", "signature")).withColumns({"symbol_id": F.col("n").cast("long"), "params": parameter_list("signature", F.lit("f"), "lang"), "type_params": F.array().cast("array<string>"), "accepted": F.lit(True), "own": F.lit(True), "extra": F.lit(0)})
    extends = t.spark.createDataFrame([("T1", "T0"), ("T2", "T1"), ("T0", "Base")], "type string, base string")
    types = t.spark.createDataFrame([(f"T{k}", "enum" if k == 4 else "class") for k in range(5)], "name string, kind string")
    return resolve.once_for_alike(calls, lambda rows: overloads.by_argument_types(candidates(rows), ["event_id"], extends, types).select("event_id", "symbol_id"), "event_id")
