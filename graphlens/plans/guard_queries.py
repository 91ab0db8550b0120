"""The size guard over conversations: every fourth answer is a tool's payload, system messages carry a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.operators import guard
from graphlens.plans.registry import query

LIMIT = 330
#: The steps one after the other, each taken while the total is over the limit; then the prompts that come back, one by one.
GUARD_SQL = f"""WITH RECURSIVE m AS (SELECT conv_id AS session, turn AS idx, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'tool' ELSE role END AS role, strlen(coalesce(text, '')) AS bytes, (strlen(coalesce(text, '')) + 2) // 3 AS tokens,
    CASE WHEN role = 'system' THEN CASE conv_id % 4 WHEN 0 THEN 'memory' WHEN 1 THEN 'skills' WHEN 2 THEN 'diagnostics' ELSE '' END END AS source,
    sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations),
  a1 AS (SELECT *, CASE WHEN role = 'tool' AND bytes > 1024 THEN least(tokens, 342) ELSE tokens END AS c1 FROM m),
  a2 AS (SELECT *, CASE WHEN role = 'tool' AND bytes > 512 THEN least(c1, 171) ELSE c1 END AS c2 FROM a1),
  a3 AS (SELECT *, CASE WHEN role = 'tool' AND bytes > 256 THEN least(c2, 86) ELSE c2 END AS c3 FROM a2),
  last AS (SELECT session, max(t) AS last, sum(tokens) AS total, arg_max(bytes, idx) FILTER (role = 'user') <= 256 AS brief FROM m GROUP BY session),
  ops AS (SELECT session, 1 AS stage, 0 AS a, idx AS b, tokens - c1 AS saving FROM a3 WHERE tokens > c1 UNION ALL SELECT session, 1, 1, idx, c1 - c2 FROM a3 WHERE c1 > c2 UNION ALL SELECT session, 1, 2, idx, c2 - c3 FROM a3 WHERE c2 > c3
    UNION ALL SELECT session, 2, CASE source WHEN 'diagnostics' THEN 0 ELSE 4 END, idx, tokens FROM m WHERE source IN ('memory', 'diagnostics') UNION ALL SELECT session, 4, 0, idx, tokens FROM m WHERE source = 'skills'
    UNION ALL SELECT session, 3, t, 0, sum(c3) FROM a3 JOIN last USING (session) WHERE role <> 'system' AND t < last GROUP BY session, t),
  o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY stage, a, b) AS k FROM ops),
  r AS (SELECT session, 0::BIGINT AS k, 0 AS stage, 0::BIGINT AS a, 0::BIGINT AS b, false AS taken, total::BIGINT AS total FROM last
    UNION ALL SELECT o.session, o.k, o.stage, o.a, o.b, r.total > {LIMIT}, r.total - CASE WHEN r.total > {LIMIT} THEN o.saving ELSE 0 END FROM r JOIN o ON o.session = r.session AND o.k = r.k + 1),
  e AS (SELECT session, arg_max(total, k) AS total, coalesce(max(stage) FILTER (taken), 0) AS stage FROM r GROUP BY session),
  s AS (SELECT a3.*, e.total, e.stage, brief, EXISTS (FROM r WHERE r.session = a3.session AND taken AND ((r.stage IN (2, 4) AND r.b = a3.idx) OR (r.stage = 3 AND r.a = a3.t AND role <> 'system'))) AS gone,
    (SELECT max(r.a) FROM r WHERE r.session = a3.session AND taken AND r.stage = 1 AND r.b = a3.idx) AS step FROM a3 JOIN e USING (session) JOIN last USING (session)),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY idx DESC) AS n FROM s WHERE role = 'user' AND gone AND brief AND stage < 4 AND bytes <= 4096 AND total <= {LIMIT}) WHERE n <= 4),
  b AS (SELECT DISTINCT session, 0::BIGINT AS n, total, -1::BIGINT AS idx, false AS back FROM p
    UNION ALL SELECT p.session, p.n, b.total + CASE WHEN b.total + p.tokens <= {LIMIT} THEN p.tokens ELSE 0 END, p.idx, b.total + p.tokens <= {LIMIT} FROM b JOIN p ON p.session = b.session AND p.n = b.n + 1)
  SELECT s.session AS conv_id, s.idx AS turn, CASE WHEN coalesce(back, false) THEN 'readmitted' WHEN gone THEN 'dropped' WHEN step IS NOT NULL THEN 'capped' ELSE 'kept' END AS state,
    CASE WHEN gone AND NOT coalesce(back, false) THEN 0 ELSE CASE step WHEN 0 THEN c1 WHEN 1 THEN c2 WHEN 2 THEN c3 ELSE tokens END END AS tokens FROM s LEFT JOIN b ON b.session = s.session AND b.idx = s.idx"""


@query("guard_trim", GUARD_SQL)
def guard_trim(t):
    """What each conversation sends within 330 tokens."""
    source = F.when(F.col("role") == "system", F.element_at(F.array(F.lit("memory"), F.lit("skills"), F.lit("diagnostics"), F.lit("")), (F.col("conv_id") % 4 + 1).cast("int")))
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), "tool").otherwise(F.col("role"))
    messages = t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("idx"), role.alias("role"), F.col("text").alias("content"), source.alias("source"))
    found = guard.trimmed(messages, LIMIT, largest=1024, preview_tokens=lambda content, cap: F.lit((cap + 2) // 3))
    return found.select(F.col("session").alias("conv_id"), F.col("idx").alias("turn"), "state", "tokens")


BUDGET = 160
#: Step by step: an excerpt's next half, then an item from the end, while the answer is over the budget.
FIT_SQL = f"""WITH RECURSIVE m AS (SELECT conv_id AS query, turn AS rank, role, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations),
  h AS (SELECT query, rank, unnest(range(1, length(bin(n)) + 1)) AS k, x, n FROM m WHERE n > 0),
  ops AS (SELECT query, 1 AS stage, -rank AS a, k, strlen(to_json(left(x, n >> (k - 1)::INTEGER))::VARCHAR) - strlen(to_json(left(x, n >> k::INTEGER))::VARCHAR) AS saving FROM h
    UNION ALL SELECT query, 2, -rank, 0, strlen('{{"head":{{"role":"' || role || '"}},"excerpt":""}}') + CASE WHEN nth = 1 THEN 0 ELSE 1 END FROM m),
  o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY stage, a, k) AS i FROM ops),
  w AS (SELECT query, sum(strlen('{{"head":{{"role":"' || role || '"}},"excerpt":""}}') + strlen(to_json(x)::VARCHAR) - 2 + CASE WHEN nth = 1 THEN 0 ELSE 1 END) AS size FROM m GROUP BY query),
  r AS (SELECT query, 0::BIGINT AS i, 0 AS stage, 0::BIGINT AS a, 0::BIGINT AS k, false AS taken, size::BIGINT AS size, {len('{"items":[],"max_tokens":' + str(BUDGET) + ',"omitted":{},"truncated":false}')} AS around FROM w
    UNION ALL SELECT query, i, stage, a, k, taken, size - CASE WHEN taken THEN saving ELSE 0 END, {len('{"items":[],"max_tokens":' + str(BUDGET) + ',"omitted":{"output_budget":1},"truncated":true}')} FROM (
      SELECT o.query, o.i, o.stage, o.a, o.k, o.saving, r.size, tok + 32 + (tok + 9) // 10 > {BUDGET} AS taken FROM (SELECT *, (size + around + 2) // 3 AS tok FROM r) r JOIN o ON o.query = r.query AND o.i = r.i + 1 WHERE r.i = 0 OR r.taken))
  SELECT query, rank, left(x, n >> coalesce((SELECT max(r.k) FROM r WHERE r.query = m.query AND r.taken AND r.stage = 1 AND r.a = -m.rank), 0)::INTEGER) AS excerpt FROM m
  WHERE NOT EXISTS (FROM r WHERE r.query = m.query AND r.taken AND r.stage = 2 AND r.a = -m.rank)"""


@query("budget_fit", FIT_SQL)
def budget_fit(t):
    """What of each conversation's turns, as excerpts, fits an answer of 160 tokens."""
    items = t.conversations.select(F.col("conv_id").alias("query"), F.col("turn").alias("rank"), F.struct("role").alias("head"), F.col("text").alias("excerpt"))
    return guard.fitted(items, BUDGET).select("query", "rank", "excerpt")
