"""What an agent is shown: mentions, call sites, search unions, caps and orders, levels of detail, recall, checks to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions import text as T
from graphlens.operators.graph import bfs
from graphlens.operators.resolve import first_nonempty, once_for_alike

CAP, NAMES = 8, 16
CANONICAL = ("package", "path", "line", "name")


# --- orders and caps ---


def canonical(symbols: DataFrame) -> DataFrame:
    """Symbols by package, path, line and name."""
    return symbols.orderBy(*CANONICAL)


def capped(rows: DataFrame, group: list[str], order: list, n: int = CAP) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def exact_then_ranked(exact: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(query, symbol_id, place from 1): exact matches by id, then the first ``k`` ranked ones that are not among them.

    ``exact``: query, symbol_id; ``ranked``: query, symbol_id, rank.
    """
    rows = exact.select("query", "symbol_id", F.lit(0).alias("_s"), F.lit(0).cast("long").alias("_r"))
    rows = rows.union(ranked.where(F.col("rank") <= k).select("query", "symbol_id", F.lit(1), F.col("rank").cast("long")))
    first = rows.groupBy("query", "symbol_id").agg(F.min(F.struct("_s", "_r")).alias("_o"))
    return first.select("query", "symbol_id", F.row_number().over(Window.partitionBy("query").orderBy("_o", "symbol_id")).alias("place"))


# --- lookups ---


def declared(symbols: DataFrame, kinds: list[str] | None = None, exported: bool | None = None, modifiers: int = 0, tests: bool | None = None) -> DataFrame:
    """Symbols of some kinds, visibility, modifier bits (all of them), in test files or not."""
    rows = symbols.where(F.col("kind").isin(*kinds)) if kinds is not None else symbols
    rows = rows.where(F.col("exported") == exported) if exported is not None else rows
    rows = rows.where(F.col("modifiers").bitwiseAND(modifiers) == modifiers) if modifiers else rows
    return rows.where(F.col("is_test") == tests) if tests is not None else rows


def package_view(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(package, files, symbols, imports): the number of a package's files and symbols, and what its files import."""
    f = files.where("package <> ''").groupBy("package").agg(F.count_distinct("path").alias("files"))
    s = symbols.groupBy("package").agg(F.count("*").alias("symbols"))
    i = imports.join(files.select("path", "package"), "path").groupBy("package").agg(F.array_sort(F.collect_set("unit")).alias("imports"))
    none = F.array().cast("array<string>")
    return f.join(s, "package", "left").join(i, "package", "left").select("package", "files", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("imports", none).alias("imports"))


def batch_names(names: DataFrame, symbols: DataFrame, most: int = NAMES) -> DataFrame:
    """(name, symbol_id, found): the answer for each of the first ``most`` distinct names (name, place); a name without
    symbols has one row without an id."""
    asked = names.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").limit(most)
    joined = asked.join(symbols.select("name", "symbol_id"), "name", "left")
    return joined.select("name", "symbol_id", F.col("symbol_id").isNotNull().alias("found"))


def prefer_folder(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query, symbol_id, ambiguous): of several declarations the first in the asking file's folder; without one there, all
    of them. ``queries``: query, folder; ``symbols``: symbol_id, name, folder and the columns of the canonical order."""
    found = queries.select("query", F.col("folder").alias("_f")).join(symbols, F.col("query") == F.col("name"))
    w = Window.partitionBy("query", "_f")
    here = F.coalesce(F.col("folder") == F.col("_f"), F.lit(False))
    place = F.row_number().over(w.orderBy(F.desc(here), *CANONICAL, "symbol_id"))
    marked = found.withColumns({"_n": F.count("*").over(w), "_any": F.max(here).over(w), "_k": place})
    return marked.where("not _any or _k = 1").select("query", F.col("_f").alias("folder"), "symbol_id", (~F.col("_any") & (F.col("_n") > 1)).alias("ambiguous"))


def call_sites(refs: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(path, line, col, name, caller): calls of the asked names (name) with the symbol around them, if any. ``refs``: path, line, col,
    name, kind, enclosing (a symbol_id or null)."""
    calls = refs.where("kind = 'call'").join(names.select("name").distinct(), "name", "left_semi")
    around = symbols.select(F.col("symbol_id").alias("enclosing"), F.col("name").alias("caller"))
    return calls.join(around, "enclosing", "left").select("path", "line", "col", "name", "caller")


def symbol_levels(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol_id, callers, callees) of every symbol; ``edges``: caller, callee."""
    pairs = edges.select("caller", "callee").distinct()
    into, out = pairs.groupBy(F.col("callee").alias("symbol_id")).agg(F.count("*").alias("callers")), pairs.groupBy(F.col("caller").alias("symbol_id")).agg(F.count("*").alias("callees"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return symbols.select("symbol_id").join(into, "symbol_id", "left").join(out, "symbol_id", "left").select("symbol_id", zero("callers"), zero("callees"))


def file_symbols(symbols: DataFrame) -> DataFrame:
    """(path, place from 1, symbol_id): each file's symbols in line order."""
    return symbols.select("path", F.row_number().over(Window.partitionBy("path").orderBy("line", "symbol_id")).alias("place"), "symbol_id")


def outlines(symbols: DataFrame, files: DataFrame, least: int = 2000) -> DataFrame:
    """(path, line, kind, name): the declarations of files (path, size) of more than ``least`` bytes."""
    return symbols.join(files.where(F.col("size") > least).select("path"), "path", "left_semi").select("path", "line", "kind", "name")


def in_states(deliveries: DataFrame, states: list[str]) -> DataFrame:
    """Deliveries in some states by creation and id."""
    return deliveries.where(F.col("state").isin(*states)).orderBy("created", "id")


def capped_json(text: Column, limit: int, steps: int = 24) -> Column:
    """A text as a JSON result of at most ``limit`` bytes: whole, or the largest prefix of whole characters that fits with
    a mark that it was cut, found by halving."""
    whole = F.to_json(F.struct(F.lit(False).alias("truncated"), text.alias("content")))
    cut = lambda n: F.to_json(F.struct(F.lit(True).alias("truncated"), T.truncate_utf8(text, n).alias("content")))

    def halved(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"] + 1) / 2).cast("int")
        fits = F.octet_length(cut(middle)) <= limit
        return F.struct(F.when(fits, middle).otherwise(state["low"]).alias("low"), F.when(fits, state["high"]).otherwise(middle - 1).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.least(F.octet_length(text), F.lit(limit)).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halved, lambda s: s["low"])
    return F.when(F.octet_length(whole) <= limit, whole).otherwise(cut(found))


# --- mentions ---


def resolved_mentions(mentions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, symbol_id, label, candidates) of document mentions.

    A path means the declarations at the top of the first of its candidate paths that has any. A ticket means the sections
    of other documents that mention it. Any other mention means the declarations of its name that aren't sections: one is
    a match, several are ambiguous, definitions first. At most eight each.

    ``mentions``: ref_id, kind, name, path (of the document), section (a symbol_id), paths (array, the best first);
    ``symbols``: symbol_id, name, kind, path, top, definition.
    """
    tickets = mentions.where("kind = 'ticket'").select("name", F.col("path").alias("_p"), F.col("section").alias("symbol_id")).distinct()
    # no document can use more than eight sections of another one
    others = capped(tickets, ["name", "_p"], ["symbol_id"])
    # a mention is its paths, its name and document, or its name
    is_path, is_ticket = F.col("kind") == "path", F.col("kind") == "ticket"
    own = mentions.select("ref_id", F.when(is_path | is_ticket, F.col("kind")).when(F.col("kind").isNotNull(), "name").alias("kind"), F.when(~is_path, F.col("name")).alias("name"), F.when(is_ticket, F.col("path")).alias("path"), F.when(is_path, F.col("paths")).alias("paths"))
    return once_for_alike(own, lambda m: _resolved_mentions(m, others, symbols))


def _resolved_mentions(mentions: DataFrame, others: DataFrame, symbols: DataFrame) -> DataFrame:
    path = mentions.where("kind = 'path'").select("ref_id", F.posexplode("paths").alias("_s", "path"))
    path = first_nonempty(path.join(symbols.where("top").select("path", "symbol_id"), "path"), ["ref_id"], "_s").select("ref_id", "symbol_id", F.lit("import_resolved").alias("label"), F.lit(0).alias("_o"))
    tickets = mentions.where("kind = 'ticket'").select("ref_id", "name", "path")
    ticket = tickets.join(others, "name").where("path <> _p").select("ref_id", "symbol_id", F.lit("name_matched"), F.lit(0))
    named = mentions.where("kind not in ('path', 'ticket')").select("ref_id", "name").join(symbols.where("kind <> 'section'").select("name", "symbol_id", "definition"), "name")
    many = F.count("*").over(Window.partitionBy("ref_id")) > 1
    named = named.select("ref_id", "symbol_id", F.when(many, "ambiguous").otherwise("name_matched"), F.when(F.col("definition"), 0).otherwise(1))
    found = capped(path.union(ticket).union(named).distinct(), ["ref_id"], ["_o", "symbol_id"])
    return found.select("ref_id", "symbol_id", "label", F.count("*").over(Window.partitionBy("ref_id")).cast("int").alias("candidates"))


def mentioned_by(resolved: DataFrame, mentions: DataFrame) -> DataFrame:
    """(symbol_id, section): the sections whose mentions resolve to a symbol."""
    return resolved.join(mentions.select("ref_id", "section"), "ref_id").select("symbol_id", "section").distinct()


# --- candidates ---


def constructors(calls: DataFrame, declared: DataFrame) -> DataFrame:
    """(ref_id, ctor_id): of a class's constructors those that accept the number of arguments, where some do and the
    language overloads; else all. A definition also accepts what a declaration of as many parameters accepts.

    ``calls``: ref_id, class_id, args (null: unknown); ``declared``: ctor_id, class_id, least, most, is_declaration, overloads.
    """
    every = declared.select("ctor_id", "class_id", "least", "most", "is_declaration", "overloads")
    return once_for_alike(calls.select("ref_id", "class_id", "args"), _constructors, symbols=every, symbol="ctor_id")


def _constructors(calls: DataFrame, declared: DataFrame) -> DataFrame:
    fits = F.col("args").between(F.col("least"), F.col("most"))
    pairs = calls.join(declared, "class_id").withColumn("_fits", fits)
    peer = F.max(F.col("_fits") & F.col("is_declaration")).over(Window.partitionBy("ref_id", "most"))
    pairs = pairs.withColumn("_ok", F.coalesce(F.col("_fits") | peer, F.lit(False)))
    some = F.max("_ok").over(Window.partitionBy("ref_id"))
    return pairs.withColumn("_some", some).where(F.col("args").isNull() | ~F.col("overloads") | ~F.col("_some") | F.col("_ok")).select("ref_id", "ctor_id")


def in_build_deps(candidates: DataFrame, deps: DataFrame, many: str | None = None) -> DataFrame:
    """(ref_id, symbol_id): candidates within the transitive build dependencies of the reference's unit, where there are
    several and some are within; else all. ``candidates``: ref_id, unit, symbol_id, target, and ``many``, the symbols that a row stands for; ``deps``: unit, dep (closed)."""
    inside = deps.select("unit", F.col("dep").alias("target"), F.lit(True).alias("_in")).distinct()
    marked = candidates.join(inside, ["unit", "target"], "left").withColumn("_in", F.coalesce("_in", F.col("unit") == F.col("target")))
    w = Window.partitionBy("ref_id")
    return marked.withColumns({"_n": (F.sum(many) if many else F.count("*")).over(w), "_any": F.max("_in").over(w)}).where("_in or not _any or _n < 2").select("ref_id", "symbol_id")


def promoted_methods(methods: DataFrame, embeds: DataFrame, known: DataFrame, depth: int = 4) -> DataFrame:
    """(type, method): own methods and those of embedded types up to ``depth`` deep, library interfaces' included.

    ``methods`` and ``known``: type, method; ``embeds``: type, other.
    """
    every = methods.select("type", "method").union(known.select("type", "method"))
    holders = embeds.select(F.col("type").alias("id")).distinct()
    reach = bfs(embeds.select(F.col("type").alias("src"), F.col("other").alias("dst")), holders, depth)
    through = reach.select(F.col("seed").alias("_top"), F.col("node").alias("type")).join(every, "type").select(F.col("_top").alias("type"), "method")
    return methods.select("type", "method").union(through).distinct()


# --- changes and checks ---


def poll_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, left): paths that are dirty now, and those that were dirty before and no longer are."""
    a, b = before.select("path").distinct().withColumn("_a", F.lit(True)), now.select("path").distinct().withColumn("_b", F.lit(True))
    return a.join(b, "path", "full_outer").select("path", F.col("_b").isNull().alias("left"))


def change_set(diff: DataFrame, dirty: DataFrame, touched: DataFrame, listed: DataFrame, most: int = 50_000, moved: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, action) of all changed paths, candidate or deleted; and one row with ``fallback``, whether a full listing is
    due: more than ``most`` changes, or a path for which ``moved`` holds (module and ignore files)."""
    paths = diff.select("path").union(dirty.select("path")).union(touched.select("path")).distinct()
    here = listed.select("path", F.lit(True).alias("_here")).distinct()
    changes = paths.join(here, "path", "left").select("path", F.when(F.col("_here"), "candidate").otherwise("deleted").alias("action"))
    special = F.coalesce(F.max(moved if moved is not None else F.lit(False)), F.lit(False))
    return changes, changes.agg(((F.count("*") > most) | special).alias("fallback"))


def obligations(changed: DataFrame, tests: DataFrame, commands: list[tuple[str, str]], code: Column | None = None) -> DataFrame:
    """(id, kind, command): the checks that a change asks for: one for each given (kind, command), one for each test
    command that is mapped to a changed path; and where there is none, one without command, if a path is code. Nothing
    changed asks for nothing. ``changed``: path (of changes and of what they affect); ``tests``: path, command."""
    spark, paths = changed.sparkSession, changed.select("path").distinct()
    some = paths.limit(1).select(F.lit(1).alias("_"))
    given = spark.createDataFrame(commands, "kind string, command string").join(some, F.lit(True)).select("kind", "command")
    mapped = tests.join(paths, "path").select(F.lit("test").alias("kind"), "command").distinct()
    own = given.where("kind = 'test'").select("kind", "command").union(mapped).distinct()
    bare = paths.where(code if code is not None else F.lit(True)).limit(1).select(F.lit("test").alias("kind"), F.lit("").alias("command"))
    bare = bare.join(own.limit(1).select(F.lit(1).alias("_o")), F.lit(True), "left_anti")
    every = given.where("kind <> 'test'").union(own).union(bare)
    return every.select(F.concat(F.col("kind"), F.when(F.col("command") == "", "").otherwise(F.concat(F.lit(":"), "command"))).alias("id"), "kind", "command")


def delegation(requests: DataFrame, mode: str = "enabled", planner_calls: int = 0, packages: int = 0, files: int = 0, calls: int = 0) -> DataFrame:
    """With ``action``, ``reason`` and ``false_positive``: whether a request goes to a planner. A threshold of 0 is off.

    ``requests``: explicit, resume_likely, high_risk (booleans), packages, files, calls, planner_calls, expected.
    """
    reached = lambda column, least: (F.lit(least) > 0) & (F.col(column) >= least)
    qualifies = (("explicit_ppd", F.col("explicit")), ("resume_likely", F.col("resume_likely")), ("high_risk", F.col("high_risk")), ("package_breadth", reached("packages", packages)), ("file_breadth", reached("files", files)), ("multi_stage", reached("calls", calls)))
    reason = F.lit("simple_task")
    for name, fits in reversed(qualifies):
        reason = F.when(fits, name).otherwise(reason)
    stopped = F.when(F.lit(mode == "disabled"), "policy_disabled").when(reached("planner_calls", planner_calls), "planner_call_limit")
    known = {"shadow": "shadow", "enabled": "delegate"}
    able = stopped.isNull() & (reason != "simple_task")
    action = F.when(able & F.lit(mode in known), known.get(mode, "bypass")).otherwise("bypass")
    why = F.coalesce(stopped, F.when(able & F.lit(mode not in known), f"unsupported_mode:{mode}").otherwise(reason))
    rows = requests.withColumns({"action": action, "reason": why})
    return rows.withColumn("false_positive", F.col("action").isin("shadow", "delegate") & (F.col("expected") == "bypass"))


# --- recall ---


def layered_recall(records: DataFrame, tenant: str, scope: str, scope_id: str, now, words: list[str], limit: int, semantic: bool = False) -> DataFrame:
    """Records of exactly one tenant and scope that are valid now and hold every word, the newest first, ties by id.

    ``records``: id, tenant, scope, scope_id, kind, content, created, expires, invalidated. ``semantic``: whether records
    of that kind take part.
    """
    kept = records.where((F.col("tenant") == tenant) & (F.col("scope") == scope) & (F.col("scope_id") == scope_id) & ~F.col("invalidated") & (F.col("expires").isNull() | (F.col("expires") > now)))
    kept = kept if semantic else kept.where("kind <> 'semantic'")
    for word in words:
        kept = kept.where(F.array_contains(T.words(F.lower("content")), word.lower()))
    return kept.orderBy(F.desc("created"), "id").limit(limit)


# --- runs and leases ---


def arm_report(runs: DataFrame) -> DataFrame:
    """(arm, runs, tools, wall_ms, missed, tokens_per_accepted, calls_per_accepted, success_pct) of experiment runs."""
    won = F.count_if("success")
    per = lambda c: F.when(won > 0, F.sum(c) / won).otherwise(0.0)
    return runs.groupBy("arm").agg(F.count("*").alias("runs"), F.sum("tools").alias("tools"), F.sum("wall_ms").alias("wall_ms"), F.sum("missed").alias("missed"), per("tokens").alias("tokens_per_accepted"), per("calls").alias("calls_per_accepted"), (won * 100 / F.count("*")).alias("success_pct"))


def suite_summary(results: DataFrame) -> DataFrame:
    """(suite, baseline, optimized, saved, failed, tier1): totals, the share saved, how many tasks failed, and how many
    were routed to the first tier."""
    base, new = F.sum("baseline"), F.sum("optimized")
    return results.groupBy("suite").agg(base.alias("baseline"), new.alias("optimized"), F.when(base > 0, 1 - new / base).otherwise(0.0).alias("saved"), F.count_if(~F.col("success")).alias("failed"), F.count_if(F.col("tier") == "T1").alias("tier1"))


def next_attempt(deliveries: DataFrame, attempts: DataFrame, key: list[str]) -> DataFrame:
    """The number of each delivery's next attempt, 1 for the first."""
    done = attempts.groupBy(*key).agg(F.max("attempt").alias("_a"))
    return deliveries.select(*key).distinct().join(done, key, "left").select(*key, (F.coalesce("_a", F.lit(0)) + 1).alias("attempt"))


def finalize(queue: DataFrame, outcomes: DataFrame, now) -> DataFrame:
    """The next row of each delivery whose outcome comes with the lease's epoch and owner before it expires; others are
    refused. ``queue``: id, owner, epoch, expires, status; ``outcomes``: id, owner, epoch, status."""
    joined = outcomes.alias("o").join(queue.alias("q"), F.col("o.id") == F.col("q.id"))
    held = (F.col("o.owner") == F.col("q.owner")) & (F.col("o.epoch") == F.col("q.epoch")) & (F.col("q.expires") > now) & (F.col("q.status") == "leased")
    accepted = F.coalesce(held, F.lit(False))
    return joined.select(F.col("q.id").alias("id"), F.col("q.epoch").alias("epoch"), F.when(accepted, F.col("o.status")).otherwise(F.col("q.status")).alias("status"), accepted.alias("accepted"))


def calls_by_turn(calls: DataFrame, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(turn_id, calls): the names of each turn's calls by time and id, of sessions that are given."""
    joined = calls.join(turns.select("turn_id", "session_id"), "turn_id").join(sessions.select("session_id"), "session_id")
    return joined.groupBy("turn_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "call_id", "name"))), lambda x: x["name"]).alias("calls"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the columns of ``order``."""
    row = F.struct(*[F.col(c) for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("_r")).select(*key, "_r.*")
