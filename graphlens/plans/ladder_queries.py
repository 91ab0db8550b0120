"""The ladder over stand-ins: orders are references, customers declarations, suppliers imports, nations types."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.operators import ladder
from graphlens.plans.registry import query

REFS = """SELECT o_orderkey AS ref_id, CASE o_orderkey % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'java' WHEN 2 THEN 'python' WHEN 3 THEN 'kotlin' ELSE 'ruby' END AS lang, o_custkey % 50 AS path, o_custkey % 10 AS unit, concat('n', o_custkey % 40) AS name, o_orderstatus <> 'P' AS is_call,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('t', o_orderkey % 12) END AS enclosing_type, CASE WHEN o_orderkey % 11 = 0 THEN concat('t', o_orderkey % 30) END AS lambda_type FROM orders"""
SYMBOLS = "SELECT c_custkey AS symbol_id, c_custkey % 200 AS path, c_custkey % 20 AS unit, concat('n', c_custkey % 37) AS name, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 37 = 5 THEN concat('t', c_custkey % 15) ELSE '' END AS receiver, c_acctbal > 3000 AS exported FROM customer"
IMPORTS = """SELECT s_suppkey % 50 AS path, s_suppkey % 20 AS unit, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 2 THEN concat('t', s_nationkey % 15) WHEN 1 THEN concat('n', 30 + s_suppkey % 10) ELSE concat('n', s_nationkey) END AS name, CASE WHEN s_suppkey % 4 = 3 THEN concat('n', s_nationkey + 1) END AS alias FROM supplier"""
EXTENDS = "SELECT concat('t', n_nationkey) AS type, concat('t', (n_nationkey + 4) % 15) AS base FROM nation"
PASSED = "SELECT s_suppkey % 20 AS unit, concat('n', 30 + s_suppkey % 10) AS name, (s_suppkey + 5) % 20 AS at_unit, concat('n', s_nationkey) AS at_name FROM supplier"


@query("unqualified_ladder", f"""WITH RECURSIVE r AS ({REFS}), s AS ({SYMBOLS}), f AS (SELECT * FROM s WHERE receiver = ''), m AS (SELECT * FROM s WHERE receiver <> ''), i AS (SELECT DISTINCT * FROM ({IMPORTS})), x AS (SELECT DISTINCT * FROM ({PASSED})), e AS ({EXTENDS}),
  u AS (SELECT DISTINCT type, type AS base, 0 AS d FROM e UNION SELECT u.type, e.base, d + 1 FROM u JOIN e ON e.type = u.base WHERE d < 4),
  tt AS (SELECT type, base FROM u UNION SELECT DISTINCT t, t FROM (SELECT enclosing_type AS t FROM r UNION SELECT lambda_type FROM r) WHERE t IS NOT NULL),
  c AS (SELECT ref_id, symbol_id, f.path, 0 AS step FROM r JOIN i ON i.path = r.path AND i.alias = r.name JOIN f ON f.unit = i.unit AND f.name = i.name AND exported WHERE lang <> 'go'
    UNION SELECT ref_id, symbol_id, m.path, 1 FROM r JOIN tt ON tt.type = lambda_type JOIN m ON m.receiver = tt.base AND m.name = r.name WHERE is_call
    UNION SELECT ref_id, symbol_id, f.path, 2 FROM r JOIN f ON f.path = r.path AND f.name = r.name
    UNION SELECT ref_id, symbol_id, m.path, 3 FROM r JOIN tt ON tt.type = enclosing_type JOIN m ON m.receiver = tt.base AND m.name = r.name WHERE is_call AND lang IN ('java', 'kotlin', 'ruby')
    UNION SELECT ref_id, symbol_id, f.path, 4 FROM r JOIN i ON i.path = r.path AND i.name = r.name AND alias IS NULL JOIN f ON f.unit = i.unit AND f.name = r.name AND exported
    UNION SELECT ref_id, symbol_id, f.path, 5 FROM r JOIN i ON i.path = r.path AND i.name = r.name AND alias IS NULL JOIN x ON x.unit = i.unit AND x.name = i.name JOIN f ON f.unit = at_unit AND f.name = at_name AND exported
    UNION SELECT ref_id, symbol_id, m.path, 6 FROM r JOIN i ON i.path = r.path AND alias IS NULL JOIN m ON m.unit = i.unit AND m.receiver = i.name AND m.name = r.name AND exported WHERE is_call
    UNION SELECT ref_id, symbol_id, f.path, 7 FROM r JOIN f ON f.unit = r.unit AND f.name = r.name WHERE lang IN ('go', 'java', 'kotlin')
    UNION SELECT ref_id, symbol_id, f.path, 8 FROM r JOIN i ON i.path = r.path AND i.name IS NULL JOIN f ON f.unit = i.unit AND f.name = r.name AND exported
    UNION SELECT ref_id, symbol_id, f.path, 9 FROM r JOIN f USING (name) WHERE lang <> 'go'
    UNION SELECT ref_id, symbol_id, m.path, 10 FROM r JOIN m USING (name) WHERE is_call AND lang IN ('kotlin', 'ruby') AND name NOT IN (SELECT name FROM f)),
  w AS (SELECT c.*, step >= 9 AND s.unit <> r.unit AS far FROM (SELECT *, min(step) OVER (PARTITION BY ref_id) AS least FROM c) c JOIN s USING (symbol_id) JOIN r USING (ref_id) WHERE step = least),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY far, path, symbol_id) AS n FROM w) WHERE n <= 8), z AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS candidates FROM k)
  SELECT ref_id, symbol_id, ['alias', 'lambda', 'file', 'this', 'named', 'reexport', 'member', 'unit', 'broad', 'name', 'method'][step + 1] AS step, CASE WHEN step = 1 THEN 'type_hinted' WHEN step < 9 THEN 'import_resolved' WHEN candidates = 1 THEN 'name_matched' ELSE 'ambiguous' END AS label, candidates FROM z""")
def unqualified_ladder(t):
    """Every order's name through all steps."""
    of = lambda text, table: t.spark.sql(text.replace(f"FROM {table}", "FROM {rows}"), rows=getattr(t, table))
    return ladder.unqualified(of(REFS, "orders"), of(SYMBOLS, "customer"), of(IMPORTS, "supplier"), of(EXTENDS, "nation"), of(PASSED, "supplier"))
