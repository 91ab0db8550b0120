"""Versioned tables and resolution over stand-ins: events are file versions (path = user and type, generation = id,
tombstone = type error), orders are listings and items, lineitems references, parts and suppliers declarations."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.operators import resolve, store
from graphlens.plans.registry import query

KEY = ["user_id", "event_type"]


@query("latest_per_path", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'")
def latest_per_path(t):
    return store.latest(t.events, KEY, ["event_id"], F.col("event_type") == "error").select(*KEY, "event_id", "value")


@query("live_stats", """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1)
  SELECT count(*) AS paths, count(*) FILTER (event_type <> 'error') AS live, count(DISTINCT user_id) AS users, (SELECT count(*) FROM events) - count(*) AS shadowed FROM l""")
def live_stats(t):
    top = store.latest(t.events.select(*KEY, "event_id"), KEY, ["event_id"])
    counts = top.agg(F.count("*").alias("paths"), F.count_if(F.col("event_type") != "error").alias("live"), F.countDistinct("user_id").alias("users"))
    return counts.join(t.events.agg(F.count("*").alias("n")), F.lit(True)).select("paths", "live", "users", (F.col("n") - F.col("paths")).alias("shadowed"))


LISTED = "(SELECT o_custkey, max(o_totalprice) AS size, max(o_orderpriority) AS mtime FROM orders {0} GROUP BY o_custkey)"


def _listing(t, where: str):
    return t.orders.where(where).groupBy("o_custkey").agg(F.max("o_totalprice").alias("size"), F.max("o_orderpriority").alias("mtime"))


@query("listing_diff", f"""SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN a.o_custkey IS NULL THEN 'deleted' WHEN a.size = b.size AND a.mtime = b.mtime THEN 'same' ELSE 'changed' END AS change
  FROM {LISTED.format("WHERE o_orderstatus <> 'F'")} a FULL JOIN {LISTED.format("WHERE o_orderstatus <> 'P'")} b USING (o_custkey)""")
def listing_diff(t):
    return store.listing_diff(_listing(t, "o_orderstatus <> 'F'"), _listing(t, "o_orderstatus <> 'P'"), "o_custkey", ["size", "mtime"])


@query("reuse_split", f"""SELECT a.o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'extract' WHEN a.size = b.size AND a.mtime = b.mtime THEN 'skip' WHEN a.mtime = b.mtime THEN 'reuse' ELSE 'extract' END AS action
  FROM {LISTED.format("WHERE o_orderstatus <> 'F'")} a LEFT JOIN {LISTED.format("WHERE o_orderstatus <> 'P'")} b USING (o_custkey)""")
def reuse_split(t):
    return store.reuse_split(_listing(t, "o_orderstatus <> 'F'"), _listing(t, "o_orderstatus <> 'P'"), "o_custkey", ["size", "mtime"], "mtime")


@query("compaction_plan", """SELECT o_custkey, overlays, over, base, overlays >= 16 OR over >= 16777216 OR (overlays >= 4 AND over * 4 > base) AS due FROM (
  SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS overlays, CAST(coalesce(sum(CAST(round(o_totalprice) AS BIGINT)) FILTER (o_orderstatus <> 'F'), 0) AS BIGINT) AS over, CAST(coalesce(sum(CAST(round(o_totalprice) AS BIGINT)) FILTER (o_orderstatus = 'F'), 0) AS BIGINT) AS base FROM orders GROUP BY 1)""")
def compaction_plan(t):
    size, over = F.round("o_totalprice").cast("long"), F.col("o_orderstatus") != "F"
    g = t.orders.groupBy("o_custkey").agg(F.count_if(over).alias("overlays"), F.sum(F.when(over, size).otherwise(0)).alias("over"), F.sum(F.when(~over, size).otherwise(0)).alias("base"))
    return g.withColumn("due", store.compaction_due(F.col("overlays"), F.col("over"), F.col("base")))


ITEMS = "SELECT *, row_number() OVER w AS n, sum(cents) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT o_orderkey, o_orderpriority, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey)"


def _items(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query("retention_candidates", f"SELECT o_orderkey FROM ({ITEMS}) WHERE o_orderdate < TIMESTAMP '1993-06-01' OR n > 2000 OR run > 20000000000")
def retention_candidates(t):
    return store.retention(_items(t), "o_orderpriority", "o_orderkey", "o_orderdate", "cents", F.lit("1993-06-01").cast("timestamp_ntz"), 2000, 20_000_000_000).select("o_orderkey")


@query("retention_batch", f"SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM ({ITEMS}) WHERE n > 2000) WHERE k <= 100")
def retention_batch(t):
    return store.retention_batch(store.retention(_items(t), "o_orderpriority", "o_orderkey", "o_orderdate", "cents", most=2000), "o_orderpriority", "o_orderkey", "o_orderdate").select("o_orderkey")


@query("retention_status", f"SELECT o_orderpriority AS scope, count(*) AS items, CAST(sum(cents) AS BIGINT) AS bytes, count(*) FILTER (n > 2000) AS candidates, CAST(coalesce(sum(cents) FILTER (n > 2000), 0) AS BIGINT) AS reclaimable FROM ({ITEMS}) GROUP BY 1")
def retention_status(t):
    gone = store.retention(_items(t), "o_orderpriority", "o_orderkey", "o_orderdate", "cents", most=2000).groupBy("o_orderpriority").agg(F.count("*").alias("c"), F.sum("cents").alias("r"))
    every = _items(t).groupBy("o_orderpriority").agg(F.count("*").alias("items"), F.sum("cents").alias("bytes"))
    return every.join(gone, "o_orderpriority", "left").select(F.col("o_orderpriority").alias("scope"), "items", "bytes", F.coalesce("c", F.lit(0)).alias("candidates"), F.coalesce("r", F.lit(0)).alias("reclaimable"))


@query("price_layers", "SELECT p_brand AS model, p_size AS layer, max(p_retailprice) AS price FROM part JOIN (SELECT p_brand, max(p_size) AS p_size FROM part GROUP BY 1) USING (p_brand, p_size) GROUP BY ALL")
def price_layers(t):
    """Brands stand for models, sizes for layers; a layer has one entry a model, here the dearest."""
    entries = t.part.groupBy(F.col("p_brand").alias("model"), F.col("p_size").alias("layer")).agg(F.max("p_retailprice").alias("price"))
    return store.layered(entries, ["model"], "layer")


@query("insert_new", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def insert_new(t):
    return store.insert_new(t.orders.where("o_orderstatus = 'O'").select("o_custkey"), t.orders.where("o_orderstatus = 'P'"), ["o_custkey"])


@query("upsert", """SELECT user_id, coalesce(b.n, a.n) AS n FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) b USING (user_id)""")
def upsert(t):
    count = lambda kind: t.events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"))
    return store.upsert(count("view"), count("click"), ["user_id"])


@query("compare_and_set", """SELECT e.event_id, CASE WHEN v.user_id IS NULL THEN 'missing' WHEN e.expected = v.version AND row_number() OVER (PARTITION BY e.user_id, e.expected = v.version ORDER BY e.event_id) = 1 THEN 'applied' ELSE 'conflict' END AS status
  FROM (SELECT event_id, user_id, event_id % 3 AS expected FROM events WHERE event_type = 'purchase') e LEFT JOIN (SELECT user_id, count(*) % 3 AS version FROM events WHERE event_type = 'signup' GROUP BY 1) v USING (user_id)""")
def compare_and_set(t):
    changes = t.events.where("event_type = 'purchase'").select("event_id", "user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("expected"))
    current = t.events.where("event_type = 'signup'").groupBy("user_id").agg((F.count("*") % 3).alias("version"))
    return store.compare_and_set(current, changes, "user_id", "version", "expected").select("event_id", "status")


@query("cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def cascade_delete(t):
    keep = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.cascade(keep, t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey")


SEEN = "SELECT l_suppkey AS file, CAST(l_quantity AS BIGINT) * 20 AS s, CAST(l_quantity AS BIGINT) * 20 + CAST(l_partkey % 25 AS BIGINT) AS e, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"


@query("seen_coverage", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq DESC) AS k FROM ({SEEN})), k AS (SELECT * FROM r WHERE k <= 64),
  i AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY s, e, seq ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file ORDER BY s, e, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM k)),
  m AS (SELECT file, min(s) AS ms, max(e) AS me FROM i GROUP BY file, i),
  q AS (SELECT s_suppkey AS file, CAST(s_suppkey % 40 AS BIGINT) * 20 AS start, CAST(s_suppkey % 40 AS BIGINT) * 20 + 15 AS "end" FROM supplier)
  SELECT q.file, q.start, q."end", coalesce(bool_or(ms <= q.start AND me >= q."end"), false) AS covered FROM q LEFT JOIN m USING (file) GROUP BY ALL""")
def seen_coverage(t):
    q = F.col("l_quantity").cast("long") * 20
    seen = t.lineitem.select(F.col("l_suppkey").alias("file"), q.alias("start"), (q + (F.col("l_partkey") % 25)).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    at = (F.col("s_suppkey") % 40) * 20
    return store.covered(t.supplier.select(F.col("s_suppkey").alias("file"), at.alias("start"), (at + 15).alias("end")), seen, ["file"])


# --- resolution ---


@query("symbols_exact", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('A', 'R') AND s_nationkey < 12")
def symbols_exact(t):
    """Suppliers are declarations (their nation half is the kind), lineitems references (the return flag is the kind)."""
    refs = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("name"), F.col("l_returnflag").alias("ref_kind"))
    symbols = t.supplier.select(F.col("s_suppkey").alias("name"), "s_name", F.when(F.col("s_nationkey") < 12, "func").otherwise("type").alias("kind"))
    return resolve.by_name(refs, symbols, {"A": ["func"], "R": ["func"]}).select("l_orderkey", "l_linenumber", "s_name")


@query("ladder_first_step", """WITH r AS (SELECT o_orderkey AS ref_id, o_custkey % 50 AS path, o_custkey % 10 AS unit, o_custkey % 25 AS name FROM orders),
  s AS (SELECT c_custkey AS symbol_id, c_custkey % 200 AS path, c_custkey % 20 AS unit, c_nationkey AS name, c_acctbal > 5000 AS exported FROM customer),
  i AS (SELECT DISTINCT s_suppkey % 50 AS path, s_suppkey % 20 AS unit, CASE WHEN s_acctbal > 0 THEN s_nationkey END AS name FROM supplier),
  c AS (SELECT ref_id, symbol_id, 1 AS step FROM r JOIN s USING (name) WHERE r.path = s.path
    UNION SELECT ref_id, symbol_id, CASE WHEN i.name IS NOT NULL THEN 2 ELSE 4 END FROM r JOIN s USING (name) JOIN i ON i.path = r.path AND i.unit = s.unit AND (i.name IS NULL OR i.name = r.name) WHERE exported
    UNION SELECT ref_id, symbol_id, 3 FROM r JOIN s USING (name) WHERE r.unit = s.unit UNION SELECT ref_id, symbol_id, 5 FROM r JOIN s USING (name) WHERE exported),
  f AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS candidates FROM (SELECT *, min(step) OVER (PARTITION BY ref_id) AS m FROM c) WHERE step = m)
  SELECT ref_id, symbol_id, CASE WHEN step < 5 THEN 'import_resolved' WHEN candidates = 1 THEN 'name_matched' ELSE 'ambiguous' END AS label, step, candidates FROM f""")
def ladder_first_step(t):
    refs = t.orders.select(F.col("o_orderkey").alias("ref_id"), (F.col("o_custkey") % 50).alias("path"), (F.col("o_custkey") % 10).alias("unit"), (F.col("o_custkey") % 25).alias("name"))
    symbols = t.customer.select(F.col("c_custkey").alias("symbol_id"), (F.col("c_custkey") % 200).alias("path"), (F.col("c_custkey") % 20).alias("unit"), F.col("c_nationkey").cast("long").alias("name"), (F.col("c_acctbal") > 5000).alias("exported"))
    imports = t.supplier.select((F.col("s_suppkey") % 50).alias("path"), (F.col("s_suppkey") % 20).alias("unit"), F.when(F.col("s_acctbal") > 0, F.col("s_nationkey").cast("long")).alias("name"))
    return resolve.ladder(refs, symbols, imports)


@query("arity_filter", """WITH c AS (SELECT l_orderkey, l_linenumber, p_partkey, CAST(l_quantity AS INTEGER) AS n, p_size AS lo, p_size + 5 AS hi FROM lineitem JOIN part ON p_partkey = l_partkey),
  f AS (SELECT *, n BETWEEN lo AND hi AS fits, bool_or(n BETWEEN lo AND hi) OVER (PARTITION BY l_orderkey) AS any_fits FROM c) SELECT l_orderkey, l_linenumber, p_partkey FROM f WHERE fits OR NOT any_fits""")
def arity_filter(t):
    """An order's parts are overloads; sizes are parameter ranges and the quantity the number of arguments."""
    c = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_partkey", F.col("l_quantity").cast("int").alias("n_args"), F.col("p_size").alias("min_args"), (F.col("p_size") + 5).alias("max_args"))
    return resolve.by_arity(c, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "p_partkey")


@query("pkg_deps", "SELECT DISTINCT c_nationkey AS package, s_nationkey AS dep FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey <> c_nationkey AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def pkg_deps(t):
    """Nations are packages, trade is an import; only indexed packages (three regions) count."""
    trade = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    deps = trade.select(F.col("c_nationkey").alias("package"), F.col("s_nationkey").alias("dep")).where("package <> dep").distinct()
    return deps.join(t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("dep")), "dep", "left_semi").select("package", "dep")


@query("pkg_dependents", "SELECT s_nationkey AS package, count(DISTINCT c_nationkey) AS dependents FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1")
def pkg_dependents(t):
    trade = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return trade.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("package")).agg(F.countDistinct("c_nationkey").alias("dependents"))


EDGES = "SELECT l_suppkey AS caller, l_partkey % 100 AS callee, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'import_resolved' WHEN 'N' THEN 'name_matched' ELSE 'ambiguous' END AS label, CAST(1 + l_linenumber % 3 AS INTEGER) AS candidates FROM lineitem"
EDGE_ROW = "row_number() OVER (PARTITION BY caller, callee ORDER BY CASE label WHEN 'import_resolved' THEN 1 WHEN 'name_matched' THEN 3 ELSE 4 END, line, label, candidates)"
EDGE_SQL = f"SELECT caller, callee, line, label, candidates FROM (SELECT *, {EDGE_ROW} AS k FROM ({EDGES}) WHERE caller <> callee) WHERE k = 1"


def call_edges(t):
    """A supplier calls the part (of a hundred) that it delivers; the return flag is the label."""
    label = F.when(F.col("l_returnflag") == "A", "import_resolved").when(F.col("l_returnflag") == "N", "name_matched").otherwise("ambiguous")
    sites = t.lineitem.select(F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 100).alias("callee"), F.col("l_linenumber").alias("line"), label.alias("label"), (1 + F.col("l_linenumber") % 3).cast("int").alias("candidates"))
    return resolve.edges(sites)


@query("call_edges", EDGE_SQL)
def all_edges(t):
    return call_edges(t)


@query("incoming_edges", f"SELECT * FROM ({EDGE_SQL}) WHERE callee IN (SELECT n_nationkey FROM nation)")
def incoming_edges(t):
    return call_edges(t).join(t.nation.select(F.col("n_nationkey").cast("long").alias("callee")), "callee", "left_semi").select("caller", "callee", "line", "label", "candidates")


@query("outgoing_edges", f"SELECT * FROM ({EDGE_SQL}) WHERE caller IN (SELECT n_nationkey FROM nation)")
def outgoing_edges(t):
    return call_edges(t).join(t.nation.select(F.col("n_nationkey").cast("long").alias("caller")), "caller", "left_semi").select("caller", "callee", "line", "label", "candidates")


@query("federated_union", f"SELECT caller, callee, line, label, candidates FROM (SELECT *, {EDGE_ROW} AS k FROM (SELECT * FROM ({EDGES}) WHERE line <= 3 UNION ALL SELECT caller, callee, line, 'ambiguous', candidates FROM ({EDGES}) WHERE line > 2) WHERE caller <> callee) WHERE k = 1")
def federated_union(t):
    label = F.when(F.col("l_returnflag") == "A", "import_resolved").when(F.col("l_returnflag") == "N", "name_matched").otherwise("ambiguous")
    sites = t.lineitem.select(F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 100).alias("callee"), F.col("l_linenumber").alias("line"), label.alias("label"), (1 + F.col("l_linenumber") % 3).cast("int").alias("candidates"))
    return resolve.federated(sites.where("line <= 3"), sites.where("line > 2").withColumn("label", F.lit("ambiguous")))


@query("callers_unresolved", "SELECT o_orderkey, 'unresolved' AS label FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def callers_unresolved(t):
    refs, symbols = t.orders.select("o_orderkey", F.col("o_custkey").alias("name")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("name"))
    return resolve.unresolved_callers(refs, symbols).select("o_orderkey", "label")


@query("hash_gated_join", "SELECT e.event_id, CASE WHEN u.h = e.event_id % 5 THEN e.event_id * 2 END AS target FROM events e LEFT JOIN (SELECT user_id, count(*) % 5 AS h FROM events GROUP BY 1) u USING (user_id)")
def hash_gated_join(t):
    """Every event is a reference with a precise site, made when its file's hash was its id modulo five."""
    files = t.events.groupBy(F.col("user_id").alias("path")).agg((F.count("*") % 5).alias("hash"))
    sites = t.events.select(F.col("user_id").alias("path"), "event_id", (F.col("event_id") % 5).alias("file_hash"), (F.col("event_id") * 2).alias("target"))
    refs = t.events.select(F.col("user_id").alias("path"), "event_id")
    return resolve.hash_gated(refs, sites, files, ["path", "event_id"]).select("event_id", F.col("precise_target").alias("target"))


SPANS = "SELECT p_partkey AS span_id, p_size % 10 AS f, CAST(p_partkey % 500 AS INTEGER) AS s, CAST(p_partkey % 500 + p_size * 3 AS INTEGER) AS e FROM part"


def _spans(t):
    at = (F.col("p_partkey") % 500).cast("int")
    return t.part.select(F.col("p_partkey").alias("span_id"), (F.col("p_size") % 10).alias("file"), at.alias("start"), (at + F.col("p_size") * 3).cast("int").alias("end"))


@query("innermost_span", f"SELECT s_suppkey, span_id FROM (SELECT s_suppkey, span_id, row_number() OVER (PARTITION BY s_suppkey ORDER BY e - s, s DESC, span_id) AS k FROM supplier JOIN ({SPANS}) ON f = s_nationkey % 10 AND s_suppkey % 500 BETWEEN s AND e) WHERE k = 1")
def innermost_span(t):
    points = t.supplier.select("s_suppkey", (F.col("s_nationkey") % 10).alias("file"), (F.col("s_suppkey") % 500).alias("line"))
    return resolve.innermost(points, _spans(t), "file", "line").select("s_suppkey", "span_id")


@query("range_overlap", f"SELECT DISTINCT span_id FROM ({SPANS}) JOIN (SELECT n_nationkey % 10 AS f, n_nationkey * 15 AS a, n_nationkey * 15 + 8 AS z FROM nation) USING (f) WHERE s <= z AND greatest(s, e) >= a")
def range_overlap(t):
    ranges = t.nation.select((F.col("n_nationkey") % 10).alias("file"), (F.col("n_nationkey") * 15).alias("start"), (F.col("n_nationkey") * 15 + 8).alias("end"))
    return resolve.overlapping(_spans(t), ranges, "file").select("span_id").distinct()


@query("suffix_join", "SELECT DISTINCT spec, unit FROM (SELECT DISTINCT lower(n_name) AS spec FROM nation) JOIN (SELECT DISTINCT lower(r_name) || '/' || lower(n_name) AS unit FROM nation JOIN region ON r_regionkey = n_regionkey) ON unit = spec OR unit LIKE '%/' || spec")
def suffix_join(t):
    units = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name")).alias("unit")).distinct()
    return resolve.suffix_join(t.nation.select(F.lower("n_name").alias("spec")).distinct(), units)


CLIENT = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ANY' WHEN 1 THEN 'GET' ELSE 'POST' END AS m, page_id % 40 AS p FROM pages"


@query("contract_join_any", f"SELECT a.page_id AS client, b.page_id AS server FROM ({CLIENT}) a JOIN ({CLIENT}) b ON a.p = b.p AND a.page_id <> b.page_id AND (a.m = b.m OR 'ANY' IN (a.m, b.m))")
def contract_join_any(t):
    method = F.when(F.col("page_id") % 3 == 0, "ANY").when(F.col("page_id") % 3 == 1, "GET").otherwise("POST")
    routes = t.pages.select("page_id", F.lit("route").alias("kind"), F.concat(method, F.lit(" /"), (F.col("page_id") % 40).cast("string")).alias("key"))
    return resolve.contract_join(routes, routes).where("c_page_id <> s_page_id").select(F.col("c_page_id").alias("client"), F.col("s_page_id").alias("server"))


@query("external_anti", "SELECT DISTINCT c_nationkey AS spec FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)")
def external_anti(t):
    return resolve.external(t.customer.select(F.col("c_nationkey").alias("spec")).distinct(), t.supplier.where("s_acctbal > 3000").select(F.col("s_nationkey").alias("unit")))


@query("division_impls", """WITH h AS (SELECT DISTINCT l_suppkey AS type, p_brand AS method FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT DISTINCT p_type AS iface, p_brand AS method FROM part WHERE p_size < 8)
  , c AS (SELECT iface, count(*) AS c FROM n GROUP BY iface) SELECT iface, type FROM (SELECT iface, type, count(*) AS k FROM n JOIN h USING (method) GROUP BY ALL) JOIN c USING (iface) WHERE k = c""")
def division_impls(t):
    """Suppliers implement brands; a part type requires the brands that it comes in when small."""
    have = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("type"), F.col("p_brand").alias("method"))
    return resolve.implementations(have, t.part.where("p_size < 8").select(F.col("p_type").alias("iface"), F.col("p_brand").alias("method")))
