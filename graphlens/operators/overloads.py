"""Overloads by the types of a call's arguments: arguments are bound to parameters, each pair is scored, the best sums stay.

Binding reads one candidate's parameters, a short array. Scoring is a join: each pair looks up whether the argument's type has the
parameter's among its supertypes, and whether it is a type or an enumeration of the workspace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators.graph import bfs
from graphlens.sources.signatures import bound, is_function, type_family

#: Languages whose calls choose by type, and classes that text and numbers convert to.
OVERLOADING = ("java", "csharp", "cpp", "kotlin", "scala", "swift", "dart")
TEXT_LIKE, BOXES = ("CharSequence", "Comparable", "Serializable", "String"), ("Integer", "Long", "Short", "Byte", "Double", "Float", "Number", "BigDecimal", "BigInteger")
#: What a hint without a name says of an argument.
HINTS = {"#f": "function", "#t": "function", "#s": "string", "#n": "number", "#b": "bool", "#c": "char", "#0": "null"}
NO, UNKNOWN, CONVERT, EXACT, DEPTH = -1, 0, 1, 2, 4


def arguments(hints: Column) -> Column:
    """Hints of a call's arguments as (name, trailing, family, base): ``name=`` before a hint names the argument, ``@`` stands before a type;
    nothing is known of any other."""

    def of(hint: Column) -> Column:
        named = hint.contains("=")
        name = F.when(named, F.substring_index(hint, "=", 1)).otherwise(F.lit(""))
        rest = F.when(named, F.substring(hint, F.instr(hint, "=") + 1, F.length(hint))).otherwise(hint)
        kind = F.when(rest.startswith("@"), F.substring(rest, F.lit(2), F.length(rest)))
        typed = type_family(kind)
        # hints drop pointers, so a character type may be a string
        typed_family = F.when(kind == "->", "function").when(kind.isin("char", "wchar_t"), "unknown").otherwise(typed["family"])
        family = F.when(kind.isNotNull(), typed_family)
        for said, name_of in HINTS.items():
            family = F.when(rest == said, name_of).otherwise(family)
        return F.struct(name.alias("name"), (rest == "#t").alias("trailing"), F.coalesce(family, F.lit("unknown")).alias("family"), F.when(kind.isNotNull(), typed["base"]).otherwise(F.lit("")).alias("base"))

    return F.transform(hints, of)


def _score(a: Column, p: Column, generic: Column, lang: Column, subtype: Column, ours: Column, enum: Column) -> Column:
    """Score of an argument (family, base) against a parameter (family, base)."""
    c_like = lang.isin("c", "cpp")
    af, pf, pb = a["family"], F.when(generic & (p["family"] == "class"), "generic").otherwise(p["family"]), p["base"]
    function = (
        F.when((af == "function") & (pf == "function"), EXACT)
        .when(pf.isin("generic", "any"), CONVERT)
        .when(((af == "function") & (pf == "class")) | ((af == "class") & (pf == "function")), UNKNOWN)
        .when(af.isin("any", "null") & (pf == "function"), CONVERT)
        .when(pf == "unknown", UNKNOWN)
        .otherwise(NO)
    )
    text = F.when(pf == "string", EXACT).when((pf == "class") & pb.isin(*TEXT_LIKE), CONVERT).otherwise(NO)
    number = F.when(pf == "number", EXACT).when(pf.isin("bool", "char") & c_like, CONVERT).when((pf == "class") & pb.isin(*BOXES), CONVERT).otherwise(NO)
    boolean = F.when(pf == "bool", EXACT).when((pf == "number") & c_like, CONVERT).when((pf == "class") & (pb == "Boolean"), CONVERT).otherwise(NO)
    character = F.when(pf == "char", EXACT).when(pf == "number", CONVERT).when((pf == "class") & (pb == "Character"), CONVERT).otherwise(NO)
    null = F.when(pf.isin("number", "bool", "char"), F.when(c_like, CONVERT).otherwise(NO)).otherwise(CONVERT)
    named = (
        F.when((pf == "class") & ((pb == a["base"]) | subtype), EXACT)
        .when(pf.isin("number", "bool") & c_like & enum, CONVERT)
        .when(pf.isin("number", "bool", "string") & ours, NO)
        .otherwise(UNKNOWN)
    )
    own = F.when(af == "string", text).when(af == "number", number).when(af == "bool", boolean).when(af == "char", character).when(af == "any", NO).when(af == "null", null).when(af == "class", named).otherwise(UNKNOWN)
    wide = F.when(pf == "unknown", UNKNOWN).when(pf == "generic", CONVERT).when(pf == "any", F.when(af == "any", EXACT).when(af == "null", CONVERT).otherwise(UNKNOWN))
    return F.when(af == "unknown", UNKNOWN).when((af == "function") | (pf == "function"), function).otherwise(F.coalesce(wide, own))


def supertypes(extends: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(type, base): all that a type extends or implements, over ``depth`` levels at most. ``extends``: type, base."""
    up = extends.select(F.col("type").alias("src"), F.col("base").alias("dst"))
    return bfs(up, extends.select(F.col("type").alias("id")).distinct(), depth).select(F.col("seed").alias("type"), F.col("node").alias("base"))


def by_argument_types(candidates: DataFrame, key: list[str], extends: DataFrame, types: DataFrame) -> DataFrame:
    """Of each call's candidates (key, symbol_id, lang, params, type_params, accepted, own, extra, hints), those whose parameters the arguments fit best; all where
    none fits, where there is one only, or where the language does not choose by type.

    ``params``: the rows of ``parameter_list``, null where unknown; ``accepted``: the number of arguments fits; ``own``: by this declaration's own list;
    ``extra``: parameters that come before the first argument. ``extends``: type, base; ``types``: name, kind of the workspace's types.
    """
    n = F.count("*").over(Window.partitionBy(*key))
    every = candidates.withColumns({"_n": n, "_args": arguments(F.col("hints"))})
    choosing = (F.col("_n") > 1) & F.col("lang").isin(*OVERLOADING) & F.col("hints").isNotNull()
    id_ = [*key, "symbol_id"]
    # not binding: the count rules a candidate out, or its list is unknown; either scores nothing
    plain = ~F.col("accepted") | F.col("params").isNull()
    pairs = every.where(choosing & ~plain).withColumn("_b", bound("params", F.transform("_args", lambda a: F.struct(a["name"].alias("name"), a["trailing"].alias("trailing"))), "lang", "extra", "own"))
    unbound = pairs.where("_b is null").select(*id_, F.lit(NO).alias("_s"))
    flat = pairs.where("_b is not null").select(*id_, "lang", "params", "_args", "type_params", F.explode_outer("_b").alias("_p"))
    kind = F.get("params", F.col("_p.param"))["type"]
    flat = flat.select(*id_, "lang", "type_params", F.get("_args", F.col("_p.arg")).alias("_a"), kind.alias("_kind"))
    typed = type_family(F.col("_kind"))
    flat = flat.withColumn("_t", F.struct(F.when(is_function(F.col("_kind")), "function").otherwise(typed["family"]).alias("family"), typed["base"].alias("base")))
    known = types.groupBy(F.col("name").alias("_an")).agg(F.bool_or(F.col("kind") == "enum").alias("_enum"))
    ups = supertypes(extends).select(F.col("type").alias("_an"), F.col("base").alias("_pn"), F.lit(True).alias("_sub")).distinct()
    flat = flat.withColumns({"_an": F.col("_a.base"), "_pn": F.col("_t.base")}).join(known, "_an", "left").join(ups, ["_an", "_pn"], "left")
    no = F.lit(False)
    score = _score(F.col("_a"), F.col("_t"), F.coalesce(F.array_contains("type_params", F.col("_pn")), no), F.col("lang"), F.coalesce("_sub", no), F.col("_enum").isNotNull(), F.coalesce("_enum", no))
    scored = flat.select(*id_, F.when(F.col("_a").isNull(), UNKNOWN).otherwise(score).alias("_s")).groupBy(*id_).agg(F.when(F.min("_s") == NO, NO).otherwise(F.sum("_s")).cast("int").alias("_s"))
    rest = every.where(~choosing | plain).select(*id_, F.lit(UNKNOWN).alias("_s"))
    total = rest.unionByName(scored).unionByName(unbound)
    best = F.max("_s").over(Window.partitionBy(*key))
    chosen = total.withColumn("_m", best).where((F.col("_s") == F.col("_m")) | (F.col("_m") == NO)).select(*id_)
    kept = every.where(~choosing).select(*id_)
    picked = chosen.join(kept.select(*key).distinct(), key, "left_anti").unionByName(kept)
    return candidates.join(picked, id_, "left_semi")
