"""Graphs over stand-ins: calls between suppliers and parts, trade between nations, co-ordered parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.operators import graph
from graphlens.plans.registry import query
from graphlens.plans.store_queries import EDGE_SQL, call_edges

#: Calls among declarations: every order is a call of its customer, and its status the label.
LABEL = "CASE o_orderstatus WHEN 'F' THEN 'import_resolved' WHEN 'O' THEN 'name_matched' ELSE 'ambiguous' END"
CALLS = f"SELECT o_custkey AS src, o_orderkey * 7 % (SELECT max(c_custkey) FROM customer) + 1 AS dst, min({LABEL}) AS label, count(*) AS candidates FROM orders GROUP BY ALL"


def _calls(t):
    last = t.customer.agg(F.max("c_custkey")).first()[0]
    return t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7 % last + 1).alias("dst"), F.expr(LABEL).alias("label")).groupBy("src", "dst").agg(F.min("label").alias("label"), F.count("*").alias("candidates"))


def _bfs_sql(edges: str, seeds: str, depth: int, go: str = "true") -> str:
    return f"""WITH RECURSIVE e AS ({edges}), r AS (SELECT id AS seed, id AS node, 0 AS depth, true AS go FROM ({seeds})
  UNION SELECT seed, e.dst, depth + 1, {go} FROM r JOIN e ON e.src = r.node AND r.go WHERE depth < {depth})
  SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY seed, node HAVING min(depth) > 0"""


#: The callers of every supplier's number: levels over the sure edges, then all edges of what is followed.
CALLERS = f"""WITH RECURSIVE e AS ({CALLS}), r AS (SELECT s_suppkey AS seed, s_suppkey AS node, 1 AS depth FROM supplier
  UNION SELECT seed, e.src, depth + 1 FROM r JOIN e ON e.dst = r.node WHERE depth < 3 AND label <> 'ambiguous'),
  f AS (SELECT seed, node AS callee, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY seed, node)
  SELECT seed, depth, callee, label, e.src AS caller, candidates FROM f JOIN e ON e.dst = f.callee"""


def _found(t):
    edges = _calls(t).withColumnsRenamed({"src": "caller", "dst": "callee"})
    return graph.find_callers(edges, t.supplier.select(F.col("s_suppkey").alias("id")), 3)


@query("bfs_depth3", CALLERS)
def bfs_depth3(t):
    """find_callers to depth three, from every supplier's number; ambiguous callers are listed, not followed."""
    return _found(t)


@query("callers_by_depth", f"""SELECT seed, depth, callee, label, string_agg(entry, ',' ORDER BY entry) AS callers FROM (
  SELECT *, caller::VARCHAR || CASE WHEN candidates > 1 THEN ' (1 of ' || candidates || ' candidates)' ELSE '' END AS entry FROM ({CALLERS})) GROUP BY ALL""")
def callers_by_depth(t):
    """The same as a caller's answer: by callee and by how the call was resolved."""
    return graph.callers_by_depth(_found(t)).withColumn("callers", F.array_join("callers", ","))


TESTS = "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'"


@query("tests_for", f"""WITH RECURSIVE e AS (SELECT dst AS src, src AS dst FROM ({CALLS})), tst AS ({TESTS}), r AS (SELECT s_suppkey AS seed, s_suppkey AS node, 0 AS depth, true AS go FROM supplier
  UNION SELECT seed, e.dst, depth + 1, e.dst NOT IN (SELECT id FROM tst) FROM r JOIN e ON e.src = r.node AND r.go WHERE depth < 3)
  SELECT DISTINCT seed, node AS test FROM r WHERE depth > 0 AND node <> seed AND node IN (SELECT id FROM tst)""")
def tests_for(t):
    last = t.customer.agg(F.max("c_custkey")).first()[0]
    edges = t.orders.select(F.col("o_custkey").alias("caller"), (F.col("o_orderkey") * 7 % last + 1).alias("callee"))
    symbols = t.customer.select(F.col("c_custkey").alias("symbol_id"), (F.col("c_mktsegment") == "BUILDING").alias("is_test"))
    return graph.tests_for(edges, symbols, t.supplier.select(F.col("s_suppkey").alias("id")))


@query("impact", f"""WITH s AS (SELECT c_custkey AS id, c_nationkey AS package, c_acctbal > 3000 AS exported, c_mktsegment = 'BUILDING' AS is_test FROM customer)
  SELECT s.id AS symbol_id, count(*) FILTER (NOT c.is_test) AS callers, count(*) FILTER (c.is_test) AS tests, coalesce(bool_or(s.exported AND c.package <> s.package), false) AS breaking
  FROM s LEFT JOIN ({CALLS}) e ON e.dst = s.id LEFT JOIN s c ON c.id = e.src GROUP BY s.id""")
def impact(t):
    symbols = t.customer.select(F.col("c_custkey").alias("symbol_id"), F.col("c_nationkey").alias("package"), (F.col("c_acctbal") > 3000).alias("exported"), (F.col("c_mktsegment") == "BUILDING").alias("is_test"))
    edges = _calls(t).select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return graph.impact(symbols, edges, symbols)


TREE = "SELECT c_custkey AS src, CAST(c_custkey * 2 + k AS BIGINT) AS dst FROM customer, (SELECT unnest([0, 1]) AS k) WHERE c_custkey * 2 + k IN (SELECT c_custkey FROM customer)"


@query("subtypes_closure", f"""WITH RECURSIVE e AS ({TREE}), r AS (SELECT s_suppkey AS root, s_suppkey AS type, 0 AS d FROM supplier UNION SELECT root, dst, d + 1 FROM r JOIN e ON src = type WHERE d < 6)
  SELECT DISTINCT root, type FROM r WHERE d > 0 AND type NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)""")
def subtypes_closure(t):
    """Customers form a binary heap; every fifth is abstract."""
    kids = t.customer.select(F.col("c_custkey").alias("base"), F.explode(F.array(F.col("c_custkey") * 2, F.col("c_custkey") * 2 + 1)).alias("type"))
    kids = kids.join(t.customer.select(F.col("c_custkey").alias("type")), "type", "left_semi")
    abstract = t.customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("type"))
    return graph.subtypes(kids, t.supplier.select(F.col("s_suppkey").alias("id")), abstract)


UP = "SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey > 1"


@query("dep_closure", _bfs_sql(UP, "SELECT c_custkey AS id FROM customer", 30).replace("SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth", "SELECT seed, node"))
def dep_closure(t):
    """A customer depends on the one of half its number."""
    up = t.customer.where("c_custkey > 1").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") / 2).cast("long").alias("dst"))
    return graph.closure(up, t.customer.select(F.col("c_custkey").alias("id"))).select("seed", "node")


@query("co_change_top20", "SELECT b.l_partkey AS file, count(DISTINCT b.l_orderkey) AS co_changes FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey = 5 AND b.l_partkey <> 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def co_change_top20(t):
    """Orders are commits, parts the files that they change."""
    return graph.co_change(t.lineitem, "l_orderkey", "l_partkey", 5)


@query("claims_status", """WITH RECURSIVE c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 40 < 20 THEN c_custkey - 1 ELSE c_custkey // 2 END AS parent, c_custkey % 20 = 0 AND c_custkey % 3 = 1 AS stale FROM customer),
  d AS (SELECT id FROM c WHERE stale UNION SELECT c.id FROM c JOIN d ON c.parent = d.id)
  SELECT id, CASE WHEN stale THEN 'stale' WHEN id IN (SELECT id FROM d) THEN 'doubted' ELSE 'live' END AS status FROM c""")
def claims_status(t):
    """Half of all claims stand in chains of twenty, the others derive from the one of half their number."""
    key = F.col("c_custkey")
    changed = (key % 20 == 0) & (key % 3 == 1)
    parent = F.when(key % 40 < 20, key - 1).otherwise((key / 2).cast("long"))
    claims = t.customer.select(key.alias("id"), F.array(parent).alias("derived_from"), key.alias("path"), F.lit("old").alias("hash"))
    now = t.customer.select(key.alias("path"), F.when(changed, "new").otherwise("old").alias("hash"))
    return graph.claims_status(claims, now)


@query("diversify", """SELECT o_custkey, o_orderkey, round(o_totalprice * pow(0.6, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1), 4) AS adjusted FROM orders""")
def diversify(t):
    """Orders are candidates of a customer's query, their priority is the file."""
    return graph.diversify(t.orders, ["o_custkey"], "o_orderpriority", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", F.round("adjusted", 4).alias("adjusted"))


#: Sections are suppliers: each mentions the declarations of its number and the next, by a kind that its key gives.
MENTION_KIND = "CASE s_suppkey % 5 WHEN 0 THEN 'symbol' WHEN 1 THEN 'route' WHEN 2 THEN 'path' WHEN 3 THEN 'ident' ELSE 'ticket' END"
MENTION_SQL = f"SELECT -s_suppkey AS section, s_suppkey + k AS target, {MENTION_KIND} AS kind, CASE k WHEN 0 THEN 'name_matched' ELSE 'ambiguous' END AS label, 2 AS candidates FROM supplier, (SELECT unnest([0, 1]) AS k)"
WEIGHT_SQL = f"""w AS (SELECT caller, callee, CASE label WHEN 'type_checked' THEN 1.0::DOUBLE WHEN 'import_resolved' THEN 1.0 WHEN 'type_hinted' THEN 0.8 WHEN 'name_matched' THEN 0.4 WHEN 'ambiguous' THEN 0.15 ELSE 0 END / candidates AS w FROM ({EDGE_SQL})),
  m AS (SELECT section, target, CASE kind WHEN 'symbol' THEN 0.8::DOUBLE WHEN 'route' THEN 0.8 WHEN 'path' THEN 0.5 WHEN 'ident' THEN 0.4 WHEN 'ticket' THEN 0.3 END * CASE label WHEN 'name_matched' THEN 0.4 ELSE 0.15 END / candidates AS w FROM ({MENTION_SQL})),
  e AS (SELECT src, dst, sum(w) AS w FROM (SELECT caller AS src, callee AS dst, w FROM w UNION ALL SELECT callee, caller, 0.8 * w FROM w UNION ALL SELECT section, target, w FROM m) WHERE w > 0 GROUP BY ALL)"""


def _weights(t):
    label = F.when(F.col("k") == 0, "name_matched").otherwise("ambiguous")
    mentions = t.supplier.select((-F.col("s_suppkey")).alias("section"), "s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    mentions = mentions.select("section", (F.col("s_suppkey") + F.col("k")).alias("target"), F.expr(MENTION_KIND).alias("kind"), label.alias("label"), F.lit(2).alias("candidates"))
    return graph.edge_weights(call_edges(t), mentions)


@query("edge_weights", f"WITH {WEIGHT_SQL} SELECT src, dst, round(w, 6) AS w FROM e")
def edge_weights(t):
    return _weights(t).select("src", "dst", F.round("w", 6).alias("w"))


@query("seed_mass", """WITH s AS (SELECT o_custkey AS query, o_orderkey AS node, CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'path' ELSE 'word' END AS kind FROM orders),
  w AS (SELECT query, node, sum(w / n) AS w FROM (SELECT *, CASE kind WHEN 'exact' THEN 1.0::DOUBLE WHEN 'path' THEN 0.5 ELSE 0.3 END AS w, count(*) OVER (PARTITION BY query, kind) AS n FROM s) GROUP BY ALL)
  SELECT query, node, round(w / sum(w) OVER (PARTITION BY query), 6) AS mass FROM w""")
def seed_mass(t):
    kind = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "path").otherwise("word")
    return graph.seed_mass(t.orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("node"), kind.alias("kind"))).select("query", "node", F.round("mass", 6).alias("mass"))


@query("ppr_rank", f"""WITH RECURSIVE {WEIGHT_SQL}, p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e), have AS (SELECT DISTINCT src FROM e),
  s AS (SELECT 0 AS k, 1::BIGINT AS node, 1.0::DOUBLE AS r, 0.0::DOUBLE AS score UNION ALL
    SELECT k, node, sum(r) AS r, sum(score) AS score FROM (
      SELECT k + 1 AS k, node, CASE WHEN r >= {graph.EPSILON} THEN 0 ELSE r END AS r, score + CASE WHEN r >= {graph.EPSILON} THEN r * CASE WHEN have.src IS NULL THEN 1 ELSE {graph.ALPHA} END ELSE 0 END AS score
      FROM s LEFT JOIN have ON have.src = node WHERE k < {graph.ROUNDS} AND (SELECT max(r) FROM s) >= {graph.EPSILON}
      UNION ALL SELECT k + 1, dst, r * (1 - {graph.ALPHA}) * p, 0 FROM s JOIN p ON src = node WHERE k < {graph.ROUNDS} AND r >= {graph.EPSILON}) GROUP BY k, node)
  SELECT node, round(score, 5) AS score FROM s WHERE k = (SELECT max(k) FROM s) AND score > 0""")
def ppr_rank(t):
    """Personalised PageRank over the whole call and mention graph from one declaration."""
    ranked = graph.personalized_pagerank(_weights(t), t.spark.createDataFrame([(1, 1.0)], "node long, mass double"))
    return ranked.select("node", F.round("score", 5).alias("score"))


@query("pack_budget", """WITH RECURSIVE i AS (SELECT o_custkey AS query, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, CAST(o_orderkey AS VARCHAR) AS item, o_orderkey % 700 AS e, o_orderkey % 60 AS s, 12 AS h FROM orders),
  p AS (SELECT DISTINCT query, 0::BIGINT AS rank, '' AS item, '' AS zoom, 0::BIGINT AS tokens, 2000::BIGINT AS room, 0 AS used FROM i UNION ALL
    SELECT query, rank, item, zoom, tokens, room - tokens, used + CASE zoom WHEN 'excerpt' THEN 1 ELSE 0 END FROM (
      SELECT query, rank, item, zoom, room, used, CASE zoom WHEN 'excerpt' THEN e WHEN 'signature' THEN s WHEN 'handle' THEN h ELSE 0 END AS tokens FROM (
        SELECT i.query, i.rank, i.item, e, s, h, room, used, CASE WHEN used < 8 AND e <= room THEN 'excerpt' WHEN s <= room THEN 'signature' WHEN h <= room THEN 'handle' ELSE 'omitted' END AS zoom FROM p JOIN i ON i.query = p.query AND i.rank = p.rank + 1 WHERE p.rank < 40)))
  SELECT query, rank, item, zoom, tokens FROM p WHERE rank > 0""")
def pack_budget(t):
    """Each customer's orders packed into a budget of tokens."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    items = t.orders.select(F.col("o_custkey").alias("query"), rank.alias("rank"), F.col("o_orderkey").cast("string").alias("item"), (F.col("o_orderkey") % 700).alias("excerpt_tokens"), (F.col("o_orderkey") % 60).alias("signature_tokens"), F.lit(12).cast("long").alias("handle_tokens"))
    return graph.pack_budget(items, 2000)


#: Seeds of each benchmark item: a supplier by its name, a part by its path, a section of the same number by a search.
ITEM_SEEDS = """SELECT item_id AS query, item_id * 3 % (SELECT max(s_suppkey) FROM supplier) + 1 AS node, 'exact' AS kind FROM benchmark
  UNION ALL SELECT item_id, item_id % 100, 'path' FROM benchmark UNION ALL SELECT item_id, -(item_id % (SELECT max(s_suppkey) FROM supplier) + 1), 'search' FROM benchmark"""
NEIGHBOURS = f"""c AS (SELECT caller, callee, line, label, CASE label WHEN 'import_resolved' THEN 1.0::DOUBLE WHEN 'name_matched' THEN 0.4 ELSE 0.15 END / candidates AS w FROM ({EDGE_SQL}) WHERE caller <> callee),
  n AS (SELECT src, dst, w, kind, label FROM (SELECT *, row_number() OVER (PARTITION BY src, kind ORDER BY line, dst, label, w) AS k FROM (
    SELECT caller AS src, callee AS dst, w, 'calls' AS kind, label, line FROM c UNION ALL SELECT callee, caller, 0.8 * w, 'called_by', label, line FROM c
    UNION ALL SELECT section, target, CASE kind WHEN 'symbol' THEN 0.8::DOUBLE WHEN 'route' THEN 0.8 WHEN 'path' THEN 0.5 WHEN 'ident' THEN 0.4 ELSE 0.3 END * CASE label WHEN 'name_matched' THEN 0.4 ELSE 0.15 END / candidates, 'mentions', label, 0 FROM ({MENTION_SQL})) WHERE w > 0) WHERE k <= 48)"""
PUSH = f"""{NEIGHBOURS}, seeds AS ({ITEM_SEEDS}),
  sw AS (SELECT query, node, sum(w / n) AS w FROM (SELECT *, CASE kind WHEN 'exact' THEN 1.0::DOUBLE WHEN 'path' THEN 0.5 ELSE 0.4 END AS w, count(*) OVER (PARTITION BY query, kind) AS n FROM seeds) GROUP BY ALL),
  mass AS (SELECT query, node, w / sum(w) OVER (PARTITION BY query) AS mass FROM sw),
  p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p, kind, label FROM n), have AS (SELECT DISTINCT src FROM n),
  s AS (SELECT 0 AS k, query, node, mass AS r, 0.0::DOUBLE AS score, NULL::STRUCT(m DOUBLE, pred BIGINT, kind VARCHAR, label VARCHAR) AS best, true AS seed FROM mass UNION ALL
    SELECT k, query, node, sum(r), sum(score), min(best), bool_or(seed) FROM (
      SELECT k + 1 AS k, query, node, CASE WHEN r >= {graph.EPSILON} THEN 0 ELSE r END AS r, score + CASE WHEN r >= {graph.EPSILON} THEN r * CASE WHEN have.src IS NULL THEN 1 ELSE {graph.ALPHA} END ELSE 0 END AS score, best, seed
      FROM s LEFT JOIN have ON have.src = node WHERE k < {graph.ROUNDS} AND (SELECT max(r) FROM s) >= {graph.EPSILON}
      UNION ALL SELECT k + 1, query, dst, r * {1 - graph.ALPHA} * p, 0, {{'m': -round(r * {1 - graph.ALPHA} * p, 12), 'pred': src, 'kind': kind, 'label': label}}, false FROM s JOIN p ON src = node WHERE k < {graph.ROUNDS} AND r >= {graph.EPSILON}) GROUP BY k, query, node),
  f AS (SELECT query, node, score, CASE WHEN NOT seed THEN best.pred END AS pred, CASE WHEN NOT seed THEN best.kind END AS kind, CASE WHEN NOT seed THEN best.label END AS label FROM s WHERE k = (SELECT max(k) FROM s) AND score > 0)"""


def _seeds(t):
    last = t.supplier.agg(F.max("s_suppkey")).first()[0]
    item = F.col("item_id")
    kinds = F.array(*[F.struct(node.cast("long").alias("node"), F.lit(kind).alias("kind")) for node, kind in ((item * 3 % last + 1, "exact"), (item % 100, "path"), (-(item % last + 1), "search"))])
    return t.benchmark.select(item.alias("query"), F.explode(kinds).alias("s")).select("query", "s.*")


def _pushed(t):
    label = F.when(F.col("k") == 0, "name_matched").otherwise("ambiguous")
    mentions = t.supplier.select((-F.col("s_suppkey")).alias("section"), "s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    mentions = mentions.select("section", (F.col("s_suppkey") + F.col("k")).alias("target"), F.expr(MENTION_KIND).alias("kind"), label.alias("label"), F.lit(2).alias("candidates"))
    return graph.push(graph.neighbours(call_edges(t), mentions), graph.seed_mass(_seeds(t)))


@query("context_push", f"WITH RECURSIVE {PUSH} SELECT query, node, round(score, 5) AS score, pred, kind, label FROM f")
def context_push(t):
    """What each benchmark item reaches from its seeds, with the strongest step that leads there."""
    return _pushed(t).withColumn("score", F.round("score", 5))


#: Ranks: reached from elsewhere than a seed counts 0.4, tests and sections half; then files alternate, and all is packed into 4096 tokens.
RANKED = f"""{PUSH}, g AS (SELECT f.*, 0.2 * CASE WHEN f.node < 0 AND x.node IS NOT NULL THEN query % 10 / 10.0::DOUBLE ELSE 0 END AS bm25, x.node IS NOT NULL AND f.node >= 0 AND x.exact AS exact, pred IS NOT NULL AND y.node IS NULL AS far
    FROM f LEFT JOIN (SELECT query, node, bool_or(kind = 'exact') AS exact FROM seeds GROUP BY ALL) x USING (query, node) LEFT JOIN (SELECT DISTINCT query, node FROM seeds) y ON y.query = f.query AND y.node = f.pred),
  h AS (SELECT query, node, round((score + bm25 + CASE WHEN exact THEN 1 ELSE 0 END) * CASE WHEN node % 5 = 0 THEN 0.5 ELSE 1 END * CASE WHEN node < 0 THEN 0.5 ELSE 1 END * CASE WHEN far THEN 0.4 ELSE 1 END, 9) AS score FROM g),
  d AS (SELECT query, node, round(score * pow(0.6, row_number() OVER (PARTITION BY query, abs(node) % 7 ORDER BY score DESC, node) - 1), 9) AS adjusted FROM h),
  i AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY adjusted DESC, node) AS rank, node::VARCHAR AS item, 50 + abs(node) * 37 % 600 AS e, 10 + abs(node) % 40 AS s, 8 AS h FROM d)"""


@query("context_retrieval", f"""WITH RECURSIVE {RANKED},
  q AS (SELECT DISTINCT query, 0::BIGINT AS rank, '' AS item, '' AS zoom, 0::BIGINT AS tokens, 4096::BIGINT AS room, 0 AS used FROM i UNION ALL
    SELECT query, rank, item, zoom, tokens, room - tokens, used + CASE zoom WHEN 'excerpt' THEN 1 ELSE 0 END FROM (
      SELECT query, rank, item, zoom, room, used, CASE zoom WHEN 'excerpt' THEN e WHEN 'signature' THEN s WHEN 'handle' THEN h ELSE 0 END AS tokens FROM (
        SELECT i.query, i.rank, i.item, e, s, h, room, used, CASE WHEN used < 8 AND e <= room THEN 'excerpt' WHEN s <= room THEN 'signature' WHEN h <= room THEN 'handle' ELSE 'omitted' END AS zoom FROM q JOIN i ON i.query = q.query AND i.rank = q.rank + 1 WHERE q.rank < 40)))
  SELECT query, rank, item, zoom, tokens FROM q WHERE rank > 0""")
def context_retrieval(t):
    """One context query for every benchmark item: seeds, push, score, diversify, pack."""
    from pyspark.sql import Window

    seeds = _seeds(t)
    own = seeds.groupBy("query", "node").agg(F.bool_or(F.col("kind") == "exact").alias("exact"), F.lit(True).alias("is_seed"))
    near = seeds.select("query", F.col("node").alias("pred"), F.lit(True).alias("near")).distinct()
    no = F.lit(False)
    rows = _pushed(t).join(own, ["query", "node"], "left").join(near, ["query", "pred"], "left")
    section = F.col("node") < 0
    bm25 = F.when(section & F.col("is_seed"), F.col("query") % 10 / 10.0).otherwise(0.0)
    score = graph.final_score(F.col("score"), bm25, F.coalesce("exact", no) & ~section, F.col("node") % 5 == 0, section, F.col("pred").isNotNull() & F.col("near").isNull())
    rows = rows.select("query", "node", F.round(score, 9).alias("score"), (F.abs("node") % 7).alias("file"))
    rows = graph.diversify(rows, ["query"], "file", "score", "node").withColumn("adjusted", F.round("adjusted", 9))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("adjusted"), "node")).cast("long")
    number = F.abs("node")
    items = rows.select("query", rank.alias("rank"), F.col("node").cast("string").alias("item"), (50 + number * 37 % 600).alias("excerpt_tokens"), (10 + number % 40).alias("signature_tokens"), F.lit(8).cast("long").alias("handle_tokens"))
    return graph.pack_budget(items, 4096)
