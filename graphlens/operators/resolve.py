"""Name resolution as joins: candidate sets with a step, the first step that finds something wins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions import text as T
from graphlens.session import cut

#: Strongest first.
LABELS = ("type_checked", "import_resolved", "type_hinted", "name_matched", "ambiguous", "unresolved")


def label_rank(label: Column) -> Column:
    out = F.lit(len(LABELS))
    for k, name in enumerate(LABELS):
        out = F.when(label == name, k).otherwise(out)
    return out


def first_nonempty(candidates: DataFrame, key: list[str], step: str = "step") -> DataFrame:
    """Of each key the candidates of its lowest step: a fallback chain without nested emptiness tests."""
    return candidates.withColumn("_m", F.min(step).over(Window.partitionBy(*key))).where(F.col(step) == F.col("_m")).drop("_m")


def fallback(candidates: DataFrame, key: list[str], fits: Column) -> DataFrame:
    """The candidates that fit; where none of a key does, all of them."""
    return candidates.withColumn("_f", fits).withColumn("_any", F.max("_f").over(Window.partitionBy(*key))).where(F.col("_f") | ~F.col("_any")).drop("_f", "_any")


#: Rows that one salt of a join of pairs has at least; parts of a result of pairs for each partition; ids in one array; kinds that every task may hold.
SALT_ROWS, PARTS, ARRAY_ROWS, HELD = 1024, 16, 512, 1 << 15


def spread_join(many: DataFrame, few: DataFrame, on: list[str], sizes: DataFrame) -> DataFrame:
    """An inner join of few keys with many rows each: the rows of ``many`` are dealt over salts, those of ``few`` are copied to each. ``sizes`` is a table with a row for each key
    that both have, and its rows of each, ``_n`` and ``_m``. A key has as many salts as its part of all pairs asks for, so copies grow with ``few`` and the partitions, not with the
    pairs; keys of several salts are at most ``PARTS`` for each partition. The number of partitions is given, so that small inputs with a large result aren't put together."""
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = F.col("_n") * F.col("_m").cast("double")
    part = max((sizes.agg(F.sum(pairs)).first()[0] or 0.0) / (PARTS * parts), 1.0)
    salts = F.ceil(F.least(F.col("_n") / SALT_ROWS, pairs / part))
    hot = F.broadcast(sizes.select(*on, salts.alias("_salts")).where("_salts > 1"))
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    left = many.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), salts)).drop("_salts").repartition(parts, *on, "_salt")
    right = few.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts").repartition(parts, *on, "_salt")
    return left.join(right, [*on, "_salt"]).drop("_salt")


def alike(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, _like) and the table (_kind, _n, _like): what rows say of each key, and the kinds of keys whose rows are alike, with their numbers of keys. Where each key
    has one row, what rows say is not shuffled."""
    said = F.struct(*[c for c in rows.columns if c != key])
    several = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    if several.isEmpty():
        signed = rows.select(key, F.array(said).alias("_like"))
    else:
        signed = cut(rows.groupBy(key).agg(F.sort_array(F.collect_list(said)).alias("_like")))
    # a number within a partition of the table that is written
    return signed, cut(signed.groupBy("_like").agg(F.count("*").alias("_n")).select(F.monotonically_increasing_id().alias("_kind"), "_n", "_like"))


def of_kinds(signed: DataFrame, kinds: DataFrame) -> DataFrame:
    """The keys of kinds; a few kinds go to every task."""
    return signed.join(F.broadcast(kinds) if kinds.count() <= HELD else kinds, "_like").drop("_like")


def once_for_alike(refs: DataFrame, resolve: Callable[..., DataFrame], key: str = "ref_id", symbols: DataFrame | None = None, symbol: str = "symbol_id") -> DataFrame:
    """``resolve(refs)``, worked out once for all references whose rows are alike but for their ``key``. What it finds for a reference must depend on that
    reference's rows only, and be rows with the ``key``. Nothing is shuffled for a reference and a candidate: the last join makes these pairs, and no step follows it.

    With ``symbols`` it is ``resolve(refs, symbols)``, worked out for symbols that are alike but for their id once, too; ``_many`` is the number of these, and what is
    found holds the column ``symbol``. The ids go to the last join in arrays.
    """
    signed, kinds = alike(refs, key)
    asked = kinds.select(F.col("_kind").alias(key), F.inline("_like"))
    if symbols is None:
        every = resolve(asked)
        found = cut(every.withColumnRenamed(key, "_kind"))
        counted = found.withColumn("_many", F.lit(1))
    else:
        own, classes = alike(symbols, symbol)
        sized = classes.select(F.col("_kind").alias(symbol), F.col("_n").alias("_many"))
        every = resolve(asked, classes.select(F.col("_kind").alias(symbol), F.col("_n").alias("_many"), F.inline("_like")))
        found = cut(every.withColumnRenamed(key, "_kind"))
        counted = found.join(sized, symbol)
    sizes = cut(counted.groupBy("_kind").agg(F.sum("_many").alias("_m")).join(kinds.select("_kind", "_n"), "_kind"))
    members = of_kinds(signed, kinds.join(sizes, "_kind", "left_semi").select("_kind", "_like"))
    if symbols is None:
        return spread_join(members, found, ["_kind"], sizes).select(*every.columns)
    dealt = of_kinds(own, classes).withColumn("_c", F.pmod(F.xxhash64(symbol), F.ceil(F.col("_n") / ARRAY_ROWS)))
    # an array of structs keeps null ids
    lists = dealt.groupBy("_kind", "_c").agg(F.collect_list(F.struct(symbol)).alias("_l")).select(F.col("_kind").alias(symbol), F.col(f"_l.{symbol}").alias("_ids"))
    pairs = spread_join(members, found.join(lists, symbol).drop(symbol), ["_kind"], sizes)
    return pairs.select(*[F.explode("_ids").alias(c) if c == symbol else F.col(c) for c in every.columns])


def by_name(refs: DataFrame, symbols: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """References joined to declarations of their name and of a kind that the reference can mean."""
    fit = F.lit(False)
    for ref_kind, symbol_kinds in kinds.items():
        fit = fit | ((F.col("ref_kind") == ref_kind) & F.col("kind").isin(symbol_kinds))
    return refs.join(symbols, "name").where(fit)


def ladder(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref_id, symbol_id, label, step, candidates) of unqualified references.

    ``refs``: ref_id, path, unit, name; ``symbols``: symbol_id, path, unit, name, exported; ``imports``: path, unit,
    imported name or null for all. Steps: 1 same file, 2 named import, 3 same unit, 4 whole-unit import, 5 any unit. A
    step that finds several in step 5 makes them ambiguous.
    """
    declared = symbols.select("symbol_id", "path", "unit", "name", "exported")
    return once_for_alike(refs.select("ref_id", "path", "unit", "name"), lambda r, s: _ladder(r, s, imports), symbols=declared)


def _ladder(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    r = refs.select("ref_id", F.col("path").alias("r_path"), F.col("unit").alias("r_unit"), "name")
    joined = r.join(symbols, "name")
    i = imports.select(F.col("path").alias("r_path"), F.col("unit").alias("i_unit"), F.col("name").alias("i_name")).distinct()
    same_file = joined.where(F.col("path") == F.col("r_path")).withColumn("step", F.lit(1))
    visible = joined.where("exported").join(i, ["r_path"]).where(F.col("i_unit") == F.col("unit"))
    named = visible.where(F.col("i_name") == F.col("name")).drop("i_unit", "i_name").withColumn("step", F.lit(2))
    same_unit = joined.where(F.col("unit") == F.col("r_unit")).withColumn("step", F.lit(3))
    broad = visible.where(F.col("i_name").isNull()).drop("i_unit", "i_name").withColumn("step", F.lit(4))
    anywhere = joined.where("exported").withColumn("step", F.lit(5))
    every = reduce(DataFrame.unionByName, [same_file, named, same_unit, broad, anywhere])
    won = first_nonempty(every.dropDuplicates(["ref_id", "symbol_id", "step"]), ["ref_id"])
    won = won.withColumn("candidates", F.sum("_many").over(Window.partitionBy("ref_id")))
    label = F.when(F.col("step") < 5, "import_resolved").when(F.col("candidates") == 1, "name_matched").otherwise("ambiguous")
    return won.select("ref_id", "symbol_id", label.alias("label"), "step", "candidates")


def by_arity(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Overloads whose parameter range holds the number of arguments (unknown: fits); all where none does.
    Columns: n_args, min_args, max_args."""
    fits = F.col("n_args").isNull() | F.col("min_args").isNull() | ((F.col("n_args") >= F.col("min_args")) & (F.col("n_args") <= F.col("max_args")))
    return fallback(candidates, key, fits)


def by_argument_types(candidates: DataFrame, key: list[str], families: dict[str, str]) -> DataFrame:
    """Overloads by ``arg_types`` against ``param_types``: exact 2, same family 1, unknown 0, else rejected; the best stay."""
    family = lambda t: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in families.items() for x in kv]), t), t)
    one = lambda a, p: F.when(a.isNull() | (a == "") | p.isNull(), 0).when(a == p, 2).when(family(a) == family(p), 1).otherwise(-1)
    points = F.zip_with("arg_types", F.slice("param_types", 1, F.size("arg_types")), one)
    scored = candidates.withColumn("_p", points).withColumn("_s", F.when(F.exists("_p", lambda x: x < 0), -1).otherwise(F.aggregate("_p", F.lit(0), lambda a, x: a + x)))
    best = scored.withColumn("_m", F.max("_s").over(Window.partitionBy(*key)))
    return best.where((F.col("_s") == F.col("_m")) | (F.col("_m") < 0)).drop("_p", "_s", "_m")


def prefer(candidates: DataFrame, key: list[str], *ranks: Column) -> DataFrame:
    """Ordered preferences, each applied to what the one before left (definitions first, visible first, nearest first)."""
    for r in ranks:
        candidates = first_nonempty(candidates.withColumn("_step", r), key, "_step").drop("_step")
    return candidates


def edges(resolved: DataFrame) -> DataFrame:
    """One edge per (caller, callee): the strongest label, then the earliest line; no self edges.

    ``resolved``: caller, callee, label, line, candidates. min over a struct aggregates before the shuffle.
    """
    best = resolved.where("caller <> callee").groupBy("caller", "callee").agg(F.min(F.struct(label_rank(F.col("label")).alias("r"), "line", "label", "candidates")).alias("b"))
    return best.select("caller", "callee", "b.line", "b.label", "b.candidates")


def unresolved_callers(refs: DataFrame, symbols: DataFrame, name: str = "name") -> DataFrame:
    """References whose name has no declaration."""
    return refs.join(symbols.select(name).distinct(), name, "left_anti").withColumn("label", F.lit("unresolved"))


def hash_gated(refs: DataFrame, sites: DataFrame, files: DataFrame, on: list[str]) -> DataFrame:
    """References with the target of a precise site at their position, where the site's file hash is still the file's."""
    fresh = sites.join(files.select("path", F.col("hash").alias("file_hash")), ["path", "file_hash"], "left_semi").select(*on, F.col("target").alias("precise_target"))
    return refs.join(fresh, on, "left")


def innermost(points: DataFrame, spans: DataFrame, key: str, point: str) -> DataFrame:
    """Of each point the smallest span around it. Spans are dealt over the blocks of 64 lines that they touch, so the
    range join is an equi-join."""
    # of spans over the same lines the first is enough, and points on one line have one answer
    spans = spans.groupBy(key, "start", "end").agg(F.min(F.struct("span_id", F.struct(*spans.columns).alias("_s"))).alias("_f")).select("_f._s.*")
    blocks = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor(F.col("end") / 64))))
    at = points.select(key, point).distinct().withColumn("_b", F.floor(F.col(point) / 64))
    joined = at.join(blocks, [key, "_b"]).where((F.col("start") <= F.col(point)) & (F.col("end") >= F.col(point)))
    order = [F.col("end") - F.col("start"), F.desc("start"), F.col("span_id")]
    best = joined.withColumn("_k", F.row_number().over(Window.partitionBy(key, point).orderBy(*order))).where("_k = 1").drop("_b", "_k")
    return points.distinct().join(best, [key, point])


def overlapping(spans: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Spans that a range of their key meets."""
    r = ranges.select(key, F.col("start").alias("_a"), F.col("end").alias("_z"))
    return spans.join(r, key).where((F.col("start") <= F.col("_z")) & (F.greatest("start", "end") >= F.col("_a"))).drop("_a", "_z").dropDuplicates()


def suffix_join(specs: DataFrame, units: DataFrame) -> DataFrame:
    """(spec, unit): the unit is the spec or ends in ``/`` and the spec; an equi-join on the last segment."""
    last = lambda c: F.substring_index(c, "/", -1)
    s, u = specs.select("spec", last(F.col("spec")).alias("_l")), units.select("unit", last(F.col("unit")).alias("_l"))
    return s.join(u, "_l").where((F.col("unit") == F.col("spec")) | F.col("unit").endswith(F.concat(F.lit("/"), F.col("spec")))).select("spec", "unit")


def reexports(start: DataFrame, exports: DataFrame, hops: int = 3) -> DataFrame:
    """(unit, name, at_unit, at_name, hop): names followed through re-exports (source name null or ``*``: the same name)."""
    found = start.select("unit", "name", F.col("unit").alias("at_unit"), F.col("name").alias("at_name"), F.lit(0).alias("hop"))
    level = found
    for hop in range(1, hops + 1):
        e = exports.select(F.col("unit").alias("at_unit"), F.col("name").alias("e_name"), F.col("source").alias("to_unit"), "source_name")
        step = level.join(e, "at_unit").where((F.col("e_name") == F.col("at_name")) | (F.col("e_name") == "*"))
        level = step.select("unit", "name", F.col("to_unit").alias("at_unit"), F.when((F.col("e_name") == "*") | F.col("source_name").isNull(), F.col("at_name")).otherwise(F.col("source_name")).alias("at_name"), F.lit(hop).alias("hop"))
        found = found.unionByName(level)
    return found.dropDuplicates(["unit", "name", "at_unit", "at_name"])


def contract_join(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """Route keys joined on kind and path; ``ANY`` meets every method on either side."""
    split = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns], F.col("kind").alias("_kind"), F.substring_index("key", " ", 1).alias(f"_{p}m"), F.expr("substring(key, locate(' ', key) + 1)").alias("_path"))
    c, s, on = split(clients, "c"), split(servers, "s"), ["_kind", "_path"]
    sizes = cut(c.groupBy(*on).agg(F.count("*").alias("_n")).join(s.groupBy(*on).agg(F.count("*").alias("_m")), on))
    joined = spread_join(c, s, on, sizes)
    return joined.where((F.col("_cm") == F.col("_sm")) | (F.col("_cm") == "ANY") | (F.col("_sm") == "ANY")).drop("_kind", "_path", "_cm", "_sm")


def federated(*edge_sets: DataFrame) -> DataFrame:
    """The edges of all members and joins, one per pair across repositories."""
    return edges(reduce(DataFrame.unionByName, edge_sets))


def external(imports: DataFrame, units: DataFrame) -> DataFrame:
    """Import specs that no local unit answers."""
    return imports.join(units.select(F.col("unit").alias("spec")).distinct(), "spec", "left_anti")


def implementations(methods: DataFrame, required: DataFrame) -> DataFrame:
    """Relational division: (iface, type) where the type has every method of the interface.

    Candidates come from the interface's rarest method, so common methods are only probed for types that can qualify.
    """
    have, need = methods.select("type", "method").distinct(), required.select("iface", "method").distinct()
    freq = have.groupBy("method").agg(F.count("*").alias("_f"))
    sized = need.join(freq, "method", "left").withColumn("_n", F.count("*").over(Window.partitionBy("iface")))
    rare = sized.withColumn("_k", F.row_number().over(Window.partitionBy("iface").orderBy(F.coalesce("_f", F.lit(0)), "method"))).where("_k = 1")
    able = rare.join(have, "method").select("iface", "type")
    hits = able.join(sized.select("iface", "method", "_n"), "iface").join(have, ["type", "method"])
    return hits.groupBy("iface", "type", "_n").agg(F.count("*").alias("_c")).where("_c = _n").select("iface", "type")


def external_by_name(refs: DataFrame, owners: DataFrame, symbols: DataFrame, reexports: DataFrame | None = None) -> DataFrame:
    """(ref_id, symbol_id, candidates): declarations of this index that references of another one mean. An import spec counts if a unit here is owned by
    that name; the first spec, in order, under which anything is found decides, and within it members of the type that the spec ends with come before free declarations, own
    ones before those that the unit only passes on. Go resolves to exported declarations only.

    ``refs``: ref_id, lang, specs (in order), name, n_args; ``owners``: lang, spec, unit; ``symbols``: symbol_id, lang, name, unit, receiver, kind,
    exported, min_args, max_args; ``reexports``: lang, unit, name, from_unit. Methods of other types, embeds, and kinds that cannot be called (but in Go) are passed over.
    """
    declared = symbols.select("symbol_id", "lang", "name", "unit", "receiver", "kind", "exported", "min_args", "max_args")
    return once_for_alike(refs.select("ref_id", "lang", "specs", "name", "n_args"), lambda r, s: _external_by_name(r, owners, s, reexports), symbols=declared)


def _external_by_name(refs: DataFrame, owners: DataFrame, symbols: DataFrame, reexports: DataFrame | None) -> DataFrame:
    asked = refs.select("ref_id", "lang", "name", "n_args", F.posexplode("specs").alias("_k", "spec"))
    owned = asked.join(owners.select("lang", "spec", "unit").distinct(), ["lang", "spec"])
    ways = owned.withColumn("_rx", F.lit(0))
    if reexports is not None:
        passed = owned.where("lang <> 'go'").join(reexports.select("lang", "unit", "name", "from_unit").distinct(), ["lang", "unit", "name"])
        ways = ways.unionByName(passed.select(*[F.col("from_unit").alias(c) if c == "unit" else c for c in owned.columns], F.lit(2).alias("_rx")))
    found = ways.join(symbols, ["lang", "unit", "name"]).where((F.col("kind") != "embed") & ((F.col("lang") != "go") | F.col("exported")))
    last = F.element_at(F.split("spec", r"[./:\\\\]+"), -1)
    member = (F.col("receiver") != "") & (T.base_type(F.col("receiver")) == last)
    free = (F.col("kind") != "method") & (F.col("kind").isin("function", "class", "struct", "type", "interface", "constructor", "enum") | (F.col("lang") == "go"))
    step = F.col("_k") * 4 + F.col("_rx") + F.when(member, 0).when(free, 1)
    won = first_nonempty(found.withColumn("step", step).where("step is not null"), ["ref_id"])
    won = by_arity(won.dropDuplicates(["ref_id", "symbol_id"]), ["ref_id"])
    return won.select("ref_id", "symbol_id", F.sum("_many").over(Window.partitionBy("ref_id")).alias("candidates"))
