"""The whole ladder of unqualified references: each step that can name a declaration is a join, the first that finds one wins.

Steps that need an import, a type or a place join few rows. Those that need a name only are taken by the references that are left, and join at most
eight declarations of a name (and eight of the reference's own unit), chosen before the join: a name that a third of all references and of all declarations
have makes eight rows a reference, not all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators.overloads import supertypes
from graphlens.operators.resolve import first_nonempty, once_for_alike

#: Languages whose calls can mean a method of the type around them, or of a lambda's receiver; those whose units see their own declarations.
IMPLICIT_THIS = ("java", "csharp", "kotlin", "swift", "scala", "cpp", "dart", "ruby")
IMPLICIT_RECEIVER = ("kotlin", "swift", "scala", "ruby")
UNIT_VISIBLE = ("go", "java", "kotlin", "scala", "csharp", "swift", "dart", "c", "cpp", "objc")
MOST, DEPTH = 8, 4
STEPS = ("alias", "lambda", "file", "this", "named", "reexport", "member", "unit", "broad", "name", "method")


def unqualified(refs: DataFrame, symbols: DataFrame, imports: DataFrame, extends: DataFrame, reexports: DataFrame) -> DataFrame:
    """(ref_id, symbol_id, step, label, candidates): at most eight declarations of each reference, by unit and place.

    ``refs``: ref_id, lang, path, unit, name, is_call, enclosing_type and lambda_type (or null); ``symbols``: symbol_id, path, unit, name, receiver (empty for free ones),
    exported; ``imports``: path, unit, name (null for all of it), alias; ``extends``: type, base; ``reexports``: unit, name, at_unit, at_name, as ``resolve.reexports`` gives them.

    Steps: an import's alias (not Go); methods of the receiver of the lambda around a call; free declarations of the file; methods of the type around a call
    and its supertypes; what an import names; what the imported unit passes on by that name; members of imported types; the unit's own declarations;
    units imported whole. Then, by name alone and not in Go, free declarations anywhere, their own unit first; where there are none, in languages with
    implicit receivers, methods of that name. The last two are ``name_matched`` if single and ``ambiguous`` if not, a lambda's are ``type_hinted``, all others ``import_resolved``.
    """
    asked = refs.select("ref_id", "lang", "path", "unit", "name", "is_call", "enclosing_type", "lambda_type")
    return once_for_alike(asked, lambda r: _unqualified(r, symbols, imports, extends, reexports))


def _unqualified(refs: DataFrame, symbols: DataFrame, imports: DataFrame, extends: DataFrame, reexports: DataFrame) -> DataFrame:
    r = refs.select("ref_id", "lang", F.col("path").alias("r_path"), F.col("unit").alias("r_unit"), "name", "is_call", "enclosing_type", "lambda_type")
    s = symbols.select("symbol_id", "path", "unit", "name", "receiver", "exported")
    free, methods = s.where("receiver = ''"), s.where("receiver <> ''")
    own = extends.select("type", F.col("type").alias("base")).union(supertypes(extends, DEPTH).select("type", "base"))
    named = imports.where("name is not null").select(F.col("path").alias("r_path"), "unit", F.col("name").alias("i_name"), "alias").distinct()
    plain = named.where("alias is null").drop("alias")
    broad = imports.where("name is null").select(F.col("path").alias("r_path"), "unit").distinct()

    def methods_of(column: str, rows: DataFrame) -> DataFrame:
        typed = rows.where(F.col("is_call") & F.col(column).isNotNull()).withColumn("type", F.col(column))
        reach = typed.withColumn("receiver", F.col("type")).unionByName(typed.join(own, "type").withColumnRenamed("base", "receiver").select(*typed.columns, "receiver"))
        return reach.join(methods, ["receiver", "name"])

    passed = reexports.select("unit", F.col("name").alias("i_name"), F.col("at_unit").alias("s_unit"), F.col("at_name").alias("s_name")).distinct()
    found = {
        "alias": r.where("lang <> 'go'").join(named.where("alias is not null").withColumnRenamed("alias", "name"), ["r_path", "name"]).drop("name").withColumnRenamed("i_name", "name").join(free.where("exported"), ["unit", "name"]),
        "lambda": methods_of("lambda_type", r),
        "file": r.join(free, (F.col("r_path") == free["path"]) & (r["name"] == free["name"])),
        "this": methods_of("enclosing_type", r.where(F.col("lang").isin(*IMPLICIT_THIS))),
        "named": r.join(plain.withColumnRenamed("i_name", "name"), ["r_path", "name"]).join(free.where("exported"), ["unit", "name"]),
        "reexport": r.join(plain.withColumn("name", F.col("i_name")), ["r_path", "name"]).join(passed, ["unit", "i_name"]).select("ref_id", "s_unit", "s_name").join(free.where("exported").withColumnsRenamed({"unit": "s_unit", "name": "s_name"}), ["s_unit", "s_name"]).withColumnRenamed("s_unit", "unit"),
        "member": r.where("is_call").join(plain.withColumnRenamed("i_name", "receiver"), "r_path").join(methods.where("exported"), ["unit", "receiver", "name"]),
        "unit": r.where(F.col("lang").isin(*UNIT_VISIBLE)).withColumn("unit", F.col("r_unit")).join(free, ["unit", "name"]),
        "broad": r.join(broad, "r_path").join(free.where("exported"), ["unit", "name"]),
    }
    every = reduce(DataFrame.unionByName, [rows.select("ref_id", "symbol_id", rows["path"] if k != "file" else free["path"], F.lit(STEPS.index(k)).alias("step")) for k, rows in found.items()])
    sure = first_nonempty(every.distinct(), ["ref_id"]).withColumn("far", F.lit(False))

    left = r.where("lang <> 'go'").join(sure.select("ref_id").distinct(), "ref_id", "left_anti")
    first = lambda rows, key: rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("path", "symbol_id"))).where(F.col("_n") <= MOST).drop("_n")
    near = left.withColumn("unit", F.col("r_unit")).join(first(free, ["name", "unit"]), ["name", "unit"]).select("ref_id", "symbol_id", "path", F.lit(9).alias("step"), F.lit(False).alias("far"))
    far = left.join(first(free, ["name"]), "name").select("ref_id", "symbol_id", "path", F.lit(9).alias("step"), (F.col("unit") != F.col("r_unit")).alias("far"))
    nameless = left.where("is_call").where(F.col("lang").isin(*IMPLICIT_RECEIVER)).join(free.select("name").distinct(), "name", "left_anti")
    late = nameless.join(first(methods, ["name"]), "name").select("ref_id", "symbol_id", "path", F.lit(10).alias("step"), (F.col("unit") != F.col("r_unit")).alias("far"))
    here = nameless.withColumn("unit", F.col("r_unit")).join(first(methods, ["name", "unit"]), ["name", "unit"]).select("ref_id", "symbol_id", "path", F.lit(10).alias("step"), F.lit(False).alias("far"))
    won = sure.select("ref_id", "symbol_id", "path", "step", "far").unionByName(near.union(far).union(here).union(late).distinct())
    place = Window.partitionBy("ref_id")
    won = won.withColumn("_n", F.row_number().over(place.orderBy("far", "path", "symbol_id"))).where(F.col("_n") <= MOST).withColumn("candidates", F.count("*").over(place))
    label = F.when(F.col("step") == 1, "type_hinted").when(F.col("step") < 9, "import_resolved").when(F.col("candidates") == 1, "name_matched").otherwise("ambiguous")
    return won.select("ref_id", "symbol_id", F.element_at(F.array(*map(F.lit, STEPS)), F.col("step") + 1).alias("step"), label.alias("label"), "candidates")
