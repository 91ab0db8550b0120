"""What an agent is shown, over stand-ins: customers are declarations (names repeat), suppliers document sections, orders
mentions, calls and requests, events runs and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import text as T
from graphlens.operators import context, resolve
from graphlens.plans.registry import query

SYMBOL_SQL = """(SELECT c_custkey AS symbol_id, 'n' || (c_custkey % 97) AS name, 'p' || c_nationkey AS package, 'f' || (c_custkey % 50) AS path, c_custkey AS line, 'p' || (c_nationkey % 5) AS folder,
  CASE WHEN c_custkey % 10 = 0 THEN 'section' ELSE lower(c_mktsegment) END AS kind, c_custkey % 3 = 0 AS top, c_acctbal > 0 AS definition, c_acctbal > 3000 AS exported, c_custkey % 4 AS modifiers, c_custkey % 7 = 0 AS is_test FROM customer)"""
SYMBOL_COLUMNS = ["c_custkey AS symbol_id", "concat('n', c_custkey % 97) AS name", "concat('p', c_nationkey) AS package", "concat('f', c_custkey % 50) AS path", "c_custkey AS line", "concat('p', c_nationkey % 5) AS folder", "CASE WHEN c_custkey % 10 = 0 THEN 'section' ELSE lower(c_mktsegment) END AS kind", "c_custkey % 3 = 0 AS top", "c_acctbal > 0 AS definition", "c_acctbal > 3000 AS exported", "c_custkey % 4 AS modifiers", "c_custkey % 7 = 0 AS is_test"]


def symbols(t):
    return t.customer.selectExpr(*SYMBOL_COLUMNS)


MENTION_SQL = """(SELECT o_orderkey AS ref_id, ['symbol', 'path', 'ticket', 'ident'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 4 = 2 THEN 't' || (o_orderkey % 300) ELSE 'n' || (o_orderkey % 120) END AS name,
  'd' || (o_custkey % 20) AS path, o_custkey AS section, ['x' || (o_orderkey % 9), 'f' || (o_orderkey % 60), 'f' || (o_orderkey % 50)] AS paths FROM orders)"""


def mentions(t):
    kind = F.element_at(F.array(*map(F.lit, ("symbol", "path", "ticket", "ident"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    named = lambda prefix, n: F.concat(F.lit(prefix), F.col("o_orderkey") % n)
    return t.orders.select(F.col("o_orderkey").alias("ref_id"), kind.alias("kind"), F.when(F.col("o_orderkey") % 4 == 2, named("t", 300)).otherwise(named("n", 120)).alias("name"), F.concat(F.lit("d"), F.col("o_custkey") % 20).alias("path"), F.col("o_custkey").alias("section"), F.array(named("x", 9), named("f", 60), named("f", 50)).alias("paths"))


RESOLVED_SQL = f"""s AS {SYMBOL_SQL}, m AS {MENTION_SQL}, pp AS (SELECT ref_id, unnest(paths) AS p, unnest([0, 1, 2]) AS k FROM m WHERE kind = 'path'),
  ph AS (SELECT ref_id, symbol_id, k, min(k) OVER (PARTITION BY ref_id) AS first FROM pp JOIN s ON s.path = p AND top),
  a AS (SELECT DISTINCT ref_id, symbol_id, 'import_resolved' AS label, 0 AS o FROM ph WHERE k = first
    UNION ALL SELECT DISTINCT x.ref_id, y.section, 'name_matched', 0 FROM m x JOIN m y ON x.kind = 'ticket' AND y.kind = 'ticket' AND x.name = y.name AND x.path <> y.path
    UNION ALL SELECT ref_id, symbol_id, CASE WHEN count(*) OVER (PARTITION BY ref_id) > 1 THEN 'ambiguous' ELSE 'name_matched' END, CASE WHEN definition THEN 0 ELSE 1 END FROM m JOIN s ON s.name = m.name AND s.kind <> 'section' WHERE m.kind IN ('symbol', 'ident')),
  r AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY o, symbol_id) AS k FROM a),
  found AS (SELECT ref_id, symbol_id, label, CAST(count(*) OVER (PARTITION BY ref_id) AS INTEGER) AS candidates FROM r WHERE k <= 8)"""


@query("mentions_resolved", f"WITH {RESOLVED_SQL} SELECT * FROM found")
def mentions_resolved(t):
    return context.resolved_mentions(mentions(t), symbols(t))


@query("mentioned_by", f"WITH {RESOLVED_SQL} SELECT DISTINCT symbol_id, section FROM found JOIN m USING (ref_id)")
def mentioned_by(t):
    rows = mentions(t)
    return context.mentioned_by(context.resolved_mentions(rows, symbols(t)), rows)


@query("call_sites", f"""SELECT 'd' || (o_custkey % 20) AS path, o_orderkey AS line, o_custkey % 80 AS col, 'n' || (o_orderkey % 97) AS name, s.name AS caller
  FROM orders LEFT JOIN {SYMBOL_SQL} s ON s.symbol_id = CASE WHEN o_orderstatus <> 'P' THEN o_custkey END WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 97 IN (SELECT n_nationkey FROM nation)""")
def call_sites(t):
    refs = t.orders.select(F.concat(F.lit("d"), F.col("o_custkey") % 20).alias("path"), F.col("o_orderkey").alias("line"), (F.col("o_custkey") % 80).alias("col"), F.concat(F.lit("n"), F.col("o_orderkey") % 97).alias("name"), F.when(F.col("o_orderpriority") == "5-LOW", "use").otherwise("call").alias("kind"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("enclosing"))
    return context.call_sites(refs, symbols(t), t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("name")))


@query("canonical_first", f"SELECT symbol_id, package FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY path, line, name) AS k FROM {SYMBOL_SQL}) WHERE k <= 8")
def canonical_first(t):
    """The cap of eight in canonical order, of each package."""
    return context.capped(symbols(t), ["package"], ["path", "line", "name"]).select("symbol_id", "package")


@query("declared_filter", f"SELECT symbol_id FROM {SYMBOL_SQL} WHERE kind IN ('building', 'section') AND exported AND modifiers & 1 = 1 AND NOT is_test")
def declared_filter(t):
    return context.declared(symbols(t), ["building", "section"], True, 1, False).select("symbol_id")


@query("exact_then_ranked", f"""WITH s AS {SYMBOL_SQL}, q AS (SELECT 'n' || n_nationkey AS query, n_nationkey AS k FROM nation), a AS (
  SELECT query, symbol_id, 0 AS s, 0 AS r FROM q JOIN s ON name = query UNION ALL SELECT query, symbol_id, 1, r FROM (SELECT query, symbol_id, row_number() OVER (PARTITION BY query ORDER BY line DESC) AS r FROM q JOIN s ON package = 'p' || k) WHERE r <= 10),
  d AS (SELECT query, symbol_id, min(s * 1000 + r) AS o FROM a GROUP BY ALL) SELECT query, symbol_id, CAST(row_number() OVER (PARTITION BY query ORDER BY o, symbol_id) AS INTEGER) AS place FROM d""")
def exact_then_ranked(t):
    """Exact names first, then the ranked of the package of the same number."""
    from pyspark.sql import Window

    s, q = symbols(t), t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("query"), F.concat(F.lit("p"), "n_nationkey").alias("package"))
    exact = q.join(s, F.col("query") == F.col("name")).select("query", "symbol_id")
    ranked = q.join(s, "package").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("line"))))
    return context.exact_then_ranked(exact, ranked, 10)


@query("package_view", f"""WITH f AS (SELECT DISTINCT path, package FROM {SYMBOL_SQL}), i AS (SELECT DISTINCT 'f' || (o_custkey % 50) AS path, 'u' || (o_orderkey % 30) AS unit FROM orders)
  SELECT p.package, p.files, coalesce(n.symbols, 0) AS symbols, coalesce(u.imports, []) AS imports FROM (SELECT package, count(DISTINCT path) AS files FROM f GROUP BY 1) p
  LEFT JOIN (SELECT package, count(*) AS symbols FROM {SYMBOL_SQL} GROUP BY 1) n USING (package) LEFT JOIN (SELECT package, list_sort(list(DISTINCT unit)) AS imports FROM f JOIN i USING (path) GROUP BY 1) u USING (package)""")
def package_view(t):
    imports = t.orders.select(F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("path"), F.concat(F.lit("u"), F.col("o_orderkey") % 30).alias("unit")).distinct()
    return context.package_view(symbols(t).select("path", "package").distinct(), symbols(t), imports)


@query("batch_names", f"""WITH n AS (SELECT 'n' || (s_suppkey * 7 % 120) AS name, min(s_suppkey) AS place FROM supplier GROUP BY 1 ORDER BY 2, 1 LIMIT 16)
  SELECT n.name, s.symbol_id, s.symbol_id IS NOT NULL AS found FROM n LEFT JOIN {SYMBOL_SQL} s USING (name)""")
def batch_names(t):
    """The answers for the first sixteen distinct names; the limit is the feature."""
    return context.batch_names(t.supplier.select(F.concat(F.lit("n"), F.col("s_suppkey") * 7 % 120).alias("name"), F.col("s_suppkey").alias("place")), symbols(t))


@query("prefer_folder", f"""WITH q AS (SELECT DISTINCT 'n' || (s_suppkey % 97) AS query, 'p' || (s_suppkey % 5) AS folder FROM supplier),
  j AS (SELECT query, q.folder, symbol_id, s.folder = q.folder AS here, package, path, line, name FROM q JOIN {SYMBOL_SQL} s ON name = query),
  w AS (SELECT *, bool_or(here) OVER (PARTITION BY query, folder) AS held, count(*) OVER (PARTITION BY query, folder) AS n, row_number() OVER (PARTITION BY query, folder ORDER BY here DESC, package, path, line, name, symbol_id) AS k FROM j)
  SELECT query, folder, symbol_id, NOT held AND n > 1 AS ambiguous FROM w WHERE NOT held OR k = 1""")
def prefer_folder(t):
    asked = t.supplier.select(F.concat(F.lit("n"), F.col("s_suppkey") % 97).alias("query"), F.concat(F.lit("p"), F.col("s_suppkey") % 5).alias("folder")).distinct()
    return context.prefer_folder(asked, symbols(t))


@query("symbol_levels", """WITH e AS (SELECT DISTINCT o_custkey AS caller, o_orderkey % 211 AS callee FROM orders)
  SELECT c_custkey AS symbol_id, coalesce(a.n, 0) AS callers, coalesce(b.n, 0) AS callees FROM customer LEFT JOIN (SELECT callee, count(*) AS n FROM e GROUP BY 1) a ON a.callee = c_custkey LEFT JOIN (SELECT caller, count(*) AS n FROM e GROUP BY 1) b ON b.caller = c_custkey""")
def symbol_levels(t):
    return context.symbol_levels(symbols(t), t.orders.select(F.col("o_custkey").alias("caller"), (F.col("o_orderkey") % 211).alias("callee")))


CTOR = "c_custkey % 40 AS class_id, c_custkey % 4 AS least, c_custkey % 4 + c_custkey % 3 AS most, c_custkey % 5 = 0 AS is_declaration, c_custkey % 40 % 2 = 0 AS overloads"


@query("constructors", f"""WITH d AS (SELECT c_custkey AS ctor_id, {CTOR} FROM customer), c AS (SELECT o_orderkey AS ref_id, o_custkey % 40 AS class_id, CASE WHEN o_orderkey % 6 < 5 THEN o_orderkey % 6 END AS args FROM orders),
  f AS (SELECT *, coalesce(args BETWEEN least AND most, false) AS fits FROM c JOIN d USING (class_id)), k AS (SELECT *, fits OR bool_or(fits AND is_declaration) OVER (PARTITION BY ref_id, most) AS ok FROM f),
  s AS (SELECT *, bool_or(ok) OVER (PARTITION BY ref_id) AS held FROM k) SELECT ref_id, ctor_id FROM s WHERE args IS NULL OR NOT overloads OR NOT held OR ok""")
def constructors(t):
    declared = t.customer.selectExpr("c_custkey AS ctor_id", *CTOR.split(", "))
    calls = t.orders.selectExpr("o_orderkey AS ref_id", "o_custkey % 40 AS class_id", "CASE WHEN o_orderkey % 6 < 5 THEN o_orderkey % 6 END AS args")
    return context.constructors(calls, declared)


@query("in_build_deps", f"""WITH c AS (SELECT o_orderkey AS ref_id, o_custkey % 25 AS unit, symbol_id, CAST(substr(package, 2) AS BIGINT) AS target FROM orders JOIN {SYMBOL_SQL} s ON s.name = 'n' || (o_orderkey % 97)),
  d AS (SELECT DISTINCT n_nationkey AS unit, n_nationkey * k % 25 AS dep FROM nation, (SELECT unnest([2, 3, 5]) AS k)), m AS (SELECT c.*, c.unit = target OR (c.unit, target) IN (SELECT (unit, dep) FROM d) AS inside FROM c),
  w AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n, bool_or(inside) OVER (PARTITION BY ref_id) AS held FROM m) SELECT ref_id, symbol_id FROM w WHERE inside OR NOT held OR n < 2""")
def in_build_deps(t):
    refs = t.orders.select(F.col("o_orderkey").alias("ref_id"), (F.col("o_custkey") % 25).alias("unit"), F.concat(F.lit("n"), F.col("o_orderkey") % 97).alias("name"))
    declared = symbols(t).select("symbol_id", "name", F.substring("package", 2, 9).cast("long").alias("target"))
    deps = t.nation.select(F.col("n_nationkey").cast("long").alias("unit"), F.explode(F.array(F.lit(2), F.lit(3), F.lit(5))).alias("k")).select("unit", (F.col("unit") * F.col("k") % 25).alias("dep"))
    return resolve.once_for_alike(refs, lambda rows, found: context.in_build_deps(rows.join(found, "name"), deps, "_many"), symbols=declared)


METHODS = "SELECT DISTINCT c_custkey % 200 AS type, 'm' || (c_custkey % 31) AS method FROM customer"
EMBEDS = "SELECT DISTINCT s_suppkey % 200 AS type, (s_suppkey * 3 + 1) % 200 AS other FROM supplier"


@query("promoted_methods", f"""WITH RECURSIVE m AS ({METHODS}), e AS ({EMBEDS}), l AS (SELECT 1::BIGINT AS type, 'Close' AS method), r AS (SELECT type AS top, type, 0 AS d FROM e UNION SELECT top, other, d + 1 FROM r JOIN e USING (type) WHERE d < 4)
  SELECT type, method FROM m UNION SELECT top, method FROM r JOIN (SELECT * FROM m UNION ALL SELECT * FROM l) x ON x.type = r.type WHERE d > 0 AND (top <> r.type OR method <> 'Close')""")
def promoted_methods(t):
    """Embedded types lend their methods; one is a library interface."""
    methods = t.customer.selectExpr("c_custkey % 200 AS type", "concat('m', c_custkey % 31) AS method").distinct()
    embeds = t.supplier.selectExpr("s_suppkey % 200 AS type", "(s_suppkey * 3 + 1) % 200 AS other").distinct()
    return context.promoted_methods(methods, embeds, t.spark.createDataFrame([(1, "Close")], "type long, method string"))


@query("precise_implementations", """WITH h AS (SELECT DISTINCT l_suppkey AS type, concat(l_returnflag, '(', l_linenumber, ')') AS m FROM lineitem), n AS (SELECT DISTINCT s_suppkey % 9 AS iface, concat(['A', 'N', 'R'][s_suppkey % 3 + 1], '(', s_suppkey % 5 + 1, ')') AS m FROM supplier WHERE s_suppkey % 9 < 6)
  SELECT iface, type FROM (SELECT iface, m, count(*) OVER (PARTITION BY iface) AS c FROM n) JOIN h USING (m) GROUP BY iface, type, c HAVING count(*) = c""")
def precise_implementations(t):
    """Inclusion of signatures, name and parameters together."""
    have = t.lineitem.select(F.col("l_suppkey").alias("type"), F.concat("l_returnflag", F.lit("("), "l_linenumber", F.lit(")")).alias("method"))
    flag = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    need = t.supplier.where("s_suppkey % 9 < 6").select((F.col("s_suppkey") % 9).alias("iface"), F.concat(flag, F.lit("("), F.col("s_suppkey") % 5 + 1, F.lit(")")).alias("method"))
    return resolve.implementations(have, need)


@query("poll_diff", "SELECT coalesce(a.o_custkey, b.o_custkey) AS path, b.o_custkey IS NULL AS left FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') b USING (o_custkey)")
def poll_diff(t):
    dirty = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("path"))
    return context.poll_diff(dirty("F"), dirty("O"))


@query("change_set", """WITH p AS (SELECT o_custkey AS path FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT s_suppkey * 3 FROM supplier), c AS (SELECT path, CASE WHEN c_custkey IS NULL THEN 'deleted' ELSE 'candidate' END AS action FROM p LEFT JOIN customer ON c_custkey = path AND c_acctbal > 0)
  SELECT path, action, (SELECT count(*) > 50000 OR bool_or(path = -1) FROM c) AS fallback FROM c""")
def change_set(t):
    key = F.col("o_custkey").alias("path")
    changes, due = context.change_set(t.orders.where("o_orderstatus = 'P'").select(key), t.orders.where("o_orderpriority = '1-URGENT'").select(key), t.supplier.select((F.col("s_suppkey") * 3).alias("path")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("path")), moved=F.col("path") == -1)
    return changes.join(F.broadcast(due), F.lit(True))


@query("obligations", """WITH p AS (SELECT DISTINCT o_custkey AS path FROM orders WHERE o_orderstatus = 'P'), t AS (SELECT DISTINCT 'run ' || (c_custkey % 37) AS command FROM customer JOIN p ON path = c_custkey WHERE c_mktsegment = 'BUILDING')
  SELECT 'build:make' AS id, 'build' AS kind, 'make' AS command WHERE EXISTS (SELECT 1 FROM p) UNION ALL SELECT 'test:' || command, 'test', command FROM t UNION ALL SELECT 'test', 'test', '' WHERE EXISTS (SELECT 1 FROM p) AND NOT EXISTS (SELECT 1 FROM t)""")
def obligations(t):
    changed = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("path"))
    tests = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("path"), F.concat(F.lit("run "), F.col("c_custkey") % 37).alias("command"))
    return context.obligations(changed, tests, [("build", "make")])


REQUEST = ["o_orderkey AS id", "o_orderkey % 50 = 0 AS explicit", "o_orderkey % 31 = 0 AS resume_likely", "o_orderstatus = 'P' AND o_orderkey % 3 = 0 AS high_risk", "o_custkey % 4 AS packages", "o_custkey % 7 AS files", "o_orderkey % 11 AS calls", "o_orderkey % 13 AS planner_calls", "CASE WHEN o_orderkey % 2 = 0 THEN 'bypass' ELSE 'delegate' END AS expected"]


@query("delegation", f"""WITH r AS (SELECT {", ".join(REQUEST)} FROM orders), d AS (SELECT *, CASE WHEN planner_calls >= 12 THEN 'planner_call_limit' WHEN explicit THEN 'explicit_ppd' WHEN resume_likely THEN 'resume_likely' WHEN high_risk THEN 'high_risk' WHEN packages >= 3 THEN 'package_breadth' WHEN files >= 6 THEN 'file_breadth' WHEN calls >= 9 THEN 'multi_stage' ELSE 'simple_task' END AS reason FROM r),
  a AS (SELECT *, CASE WHEN reason IN ('planner_call_limit', 'simple_task') THEN 'bypass' ELSE 'delegate' END AS action FROM d) SELECT id, action, reason, action = 'delegate' AND expected = 'bypass' AS false_positive FROM a""")
def delegation(t):
    return context.delegation(t.orders.selectExpr(*REQUEST), "enabled", 12, 3, 6, 9).select("id", "action", "reason", "false_positive")


@query("layered_recall", """SELECT id FROM (SELECT c_custkey AS id, c_custkey AS created, 'the ' || c_mktsegment || ' rule' AS content, CASE WHEN c_custkey % 3 = 0 THEN 'semantic' ELSE 'procedural' END AS kind, CASE WHEN c_custkey % 5 > 0 THEN c_custkey + 900 END AS expires, c_custkey % 7 = 0 AS invalidated, c_nationkey AS n FROM customer)
  WHERE n = 3 AND NOT invalidated AND (expires IS NULL OR expires > 1000) AND kind <> 'semantic' AND lower(content) LIKE '%building%' ORDER BY created DESC, id LIMIT 50""")
def layered_recall(t):
    """Valid records of one partition with a word; the limit is the feature."""
    records = t.customer.selectExpr("c_custkey AS id", "c_custkey AS created", "concat('the ', c_mktsegment, ' rule') AS content", "CASE WHEN c_custkey % 3 = 0 THEN 'semantic' ELSE 'procedural' END AS kind", "CASE WHEN c_custkey % 5 > 0 THEN c_custkey + 900 END AS expires", "c_custkey % 7 = 0 AS invalidated", "CAST(c_nationkey AS STRING) AS tenant", "'repo' AS scope", "'r1' AS scope_id")
    return context.layered_recall(records, "3", "repo", "r1", 1000, ["Building"], 50).select("id")


RUN = "event_type AS arm, user_id AS calls, user_id % 9 AS tools, event_id % 1000 AS wall_ms, event_id % 3 AS missed, event_id % 5000 AS tokens, event_id % 4 > 0 AS success"


@query("arm_report", f"""WITH r AS (SELECT {RUN} FROM events) SELECT arm, count(*) AS runs, CAST(sum(tools) AS BIGINT) AS tools, CAST(sum(wall_ms) AS BIGINT) AS wall_ms, CAST(sum(missed) AS BIGINT) AS missed, round(CASE WHEN count(*) FILTER (success) > 0 THEN sum(tokens) / count(*) FILTER (success) ELSE 0 END, 4) AS tokens_per_accepted,
  round(CASE WHEN count(*) FILTER (success) > 0 THEN sum(calls) / count(*) FILTER (success) ELSE 0 END, 4) AS calls_per_accepted, round(count(*) FILTER (success) * 100 / count(*), 4) AS success_pct FROM r GROUP BY arm""")
def arm_report(t):
    found = context.arm_report(t.events.selectExpr(*RUN.split(", ")))
    return found.withColumns({c: F.round(c, 4) for c in ("tokens_per_accepted", "calls_per_accepted", "success_pct")})


RESULT = "event_type AS suite, event_id % 5000 + 100 AS baseline, event_id % 3000 AS optimized, event_id % 8 > 0 AS success, CASE WHEN user_id % 2 = 0 THEN 'T1' ELSE 'T2' END AS tier"


@query("suite_summary", f"""WITH r AS (SELECT {RESULT} FROM events) SELECT suite, CAST(sum(baseline) AS BIGINT) AS baseline, CAST(sum(optimized) AS BIGINT) AS optimized, round(1 - sum(optimized) / sum(baseline), 6) AS saved, count(*) FILTER (NOT success) AS failed, count(*) FILTER (tier = 'T1') AS tier1 FROM r GROUP BY 1""")
def suite_summary(t):
    return context.suite_summary(t.events.selectExpr(*RESULT.split(", "))).withColumn("saved", F.round("saved", 6))


@query("next_attempt", "SELECT c_custkey, coalesce(max(o_orderkey % 9), 0) + 1 AS attempt FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def next_attempt(t):
    attempts = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 9).alias("attempt"))
    return context.next_attempt(t.customer, attempts, ["c_custkey"])


QUEUE = "c_custkey AS id, c_custkey % 7 AS owner, c_custkey % 5 AS epoch, c_acctbal AS expires, CASE WHEN c_custkey % 11 = 0 THEN 'queued' ELSE 'leased' END AS status"


@query("lease_finalize", f"""WITH q AS (SELECT {QUEUE} FROM customer), o AS (SELECT s_suppkey AS id, s_suppkey % 7 AS owner, s_suppkey % 6 AS epoch, 'done' AS status FROM supplier), j AS (SELECT q.id, q.epoch, o.owner = q.owner AND o.epoch = q.epoch AND q.expires > 1000 AND q.status = 'leased' AS accepted, q.status AS old, o.status AS new FROM o JOIN q USING (id))
  SELECT id, epoch, CASE WHEN accepted THEN new ELSE old END AS status, accepted FROM j""")
def lease_finalize(t):
    outcomes = t.supplier.selectExpr("s_suppkey AS id", "s_suppkey % 7 AS owner", "s_suppkey % 6 AS epoch", "'done' AS status")
    return context.finalize(t.customer.selectExpr(*QUEUE.split(", ")), outcomes, 1000)


@query("calls_by_turn", """SELECT o_orderkey AS turn_id, list(name ORDER BY ts, call_id, name) AS calls FROM (SELECT l_orderkey, l_returnflag || l_linenumber AS name, l_shipdate AS ts, l_partkey AS call_id FROM lineitem) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def calls_by_turn(t):
    calls = t.lineitem.select(F.col("l_orderkey").alias("turn_id"), F.concat("l_returnflag", "l_linenumber").alias("name"), F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("call_id"))
    return context.calls_by_turn(calls, t.orders.select(F.col("o_orderkey").alias("turn_id"), F.col("o_custkey").alias("session_id")), t.customer.select(F.col("c_custkey").alias("session_id")))


@query("latest_session", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_session(t):
    return context.latest(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("decision_state", "SELECT o_orderkey, p.s_name AS resolution FROM orders LEFT JOIN supplier p ON p.s_suppkey = o_orderkey AND p.s_acctbal > 0")
def decision_state(t):
    """Decisions with their resolutions, where there are any."""
    return t.orders.select("o_orderkey").join(t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("o_orderkey"), F.col("s_name").alias("resolution")), "o_orderkey", "left")


@query("docs_after_code", """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'F' AS code, o_orderstatus = 'O' AS section, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders),
  k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, code ORDER BY rank) AS own, row_number() OVER (PARTITION BY o_custkey, NOT code ORDER BY rank) AS doc FROM r)
  SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN code THEN own WHEN doc = 1 THEN 4.5 ELSE 1000000000 + rank END) AS INTEGER) AS place FROM k""")
def docs_after_code(t):
    """Of a customer's orders the filled ones are sections: the first follows four code rows, the others all."""
    from pyspark.sql import Window

    from graphlens.operators import lookup

    ranked = t.orders.select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"))
    return lookup.docs_last(ranked, ["o_custkey"], "rank", "doc").select("o_custkey", "o_orderkey", "place")


@query("task_identifiers", r"""WITH t AS (SELECT item_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}_./-]+'), lambda w: trim(w, '.-/')), lambda w: length(w) >= 2 AND (regexp_matches(w, '^[\p{L}_]') OR regexp_matches(w, '/.*\.[^./]+$')))) AS names FROM benchmark) SELECT item_id, list_sort(names) AS names FROM t""")
def task_identifiers(t):
    return t.benchmark.select("item_id", F.array_sort(T.identifiers(F.col("text"))).alias("names"))


@query("token_scale", """WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, least(greatest((event_id % 9000 + 3000) / (event_id % 7000), 1.0), 2.0) AS ratio FROM events WHERE event_id % 7000 >= 4000),
  s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 1.0::DOUBLE AS scale FROM r UNION ALL SELECT user_id, r.k, scale + 0.3 * (ratio - scale) FROM s JOIN r USING (user_id) WHERE r.k = s.k + 1)
  SELECT user_id, round(max_by(scale, k), 6) AS scale FROM s GROUP BY 1""")
def token_scale(t):
    from graphlens.operators import telemetry

    rows = t.events.select("user_id", "event_id", (F.col("event_id") % 7000).alias("estimated"), (F.col("event_id") % 9000 + 3000).alias("actual"))
    return telemetry.calibrated_scale(rows, "user_id", ["event_id"]).select("user_id", F.round("scale", 6).alias("scale"))


@query("file_symbols", f"SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY line, symbol_id) AS INTEGER) AS place, symbol_id FROM {SYMBOL_SQL}")
def file_symbols(t):
    return context.file_symbols(symbols(t))


@query("outlines", f"SELECT path, line, kind, name FROM {SYMBOL_SQL} WHERE path IN (SELECT 'f' || s_suppkey FROM supplier WHERE s_acctbal > 2000)")
def outlines(t):
    return context.outlines(symbols(t), t.supplier.select(F.concat(F.lit("f"), "s_suppkey").alias("path"), F.col("s_acctbal").alias("size")))


@query("in_states", "SELECT o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate, o_orderkey")
def in_states(t):
    return context.in_states(t.orders.selectExpr("o_orderkey AS id", "o_orderstatus AS state", "o_orderdate AS created"), ["F", "P"]).select("id", "state")
