"""The batch twins of the stateful streams, and JSON at depth, over events: a user is a repository or a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import json as J
from graphlens.plans.registry import query
from graphlens.streaming import timers

QUIET, CEILING, MOST = 2 * 3_600_000, 6 * 3_600_000, 2

#: Batches row by row: a change opens one if the last is over by its pause or its ceiling.
BATCH_SQL = f"""WITH RECURSIVE c AS (SELECT user_id AS repo, event_type AS path, epoch_us(ts) // 1000 AS ms FROM events),
  m AS (SELECT repo, ms, row_number() OVER (PARTITION BY repo ORDER BY ms) AS k FROM (SELECT DISTINCT repo, ms FROM c)),
  r AS (SELECT repo, ms, k, ms AS opened FROM m WHERE k = 1
    UNION ALL SELECT m.repo, m.ms, m.k, CASE WHEN m.ms >= least(r.ms + {QUIET}, r.opened + {CEILING}) THEN m.ms ELSE r.opened END FROM r JOIN m ON m.repo = r.repo AND m.k = r.k + 1),
  p AS (SELECT repo, opened, path, min(ms) AS first, max(ms) AS last FROM c JOIN r USING (repo, ms) GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY repo, opened ORDER BY first, path) AS n FROM p)
  SELECT repo, opened, least(max(last) + {QUIET}, opened + {CEILING}) AS closed, string_agg(CASE WHEN n <= {MOST} THEN path END, ',' ORDER BY path) AS paths, max(n) > {MOST} AS "full" FROM n GROUP BY repo, opened"""


@query("change_batches", BATCH_SQL)
def change_batches(t):
    """Events are changes of a path, their type; a batch ends after two hours of silence, or six of changes."""
    changes = t.events.select(F.col("user_id").alias("repo"), F.col("event_type").alias("path"), "ts")
    found = timers.change_batches(changes, QUIET, CEILING, MOST)
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp")).alias(c)
    return found.select("repo", millis("opened"), millis("closed"), F.array_join("paths", ",").alias("paths"), "full")


#: The recorder event by event: state is both queues, and each event lists what it changes.
RECORD_SQL = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS session, event_type || event_id % 3 AS c, event_id % 5 < 3 AS before, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
  r AS (SELECT DISTINCT session, 0::BIGINT AS k, []::STRUCT(c VARCHAR, s BIGINT)[] AS p, []::STRUCT(c VARCHAR, s BIGINT)[] AS q, []::STRUCT(c VARCHAR, what VARCHAR, s BIGINT, e BIGINT)[] AS out FROM e
    UNION ALL SELECT session, k,
      CASE WHEN done THEN list_filter(p2, lambda x: x.c <> c) ELSE p2 END,
      CASE WHEN done AND len(q) = 3 THEN q[2:] ELSE q END || CASE WHEN done THEN [one] ELSE [] END,
      CASE WHEN held IS NOT NULL THEN [{'c': c, 'what': 'duplicate', 's': held, 'e': ms}] WHEN open IS NOT NULL AND before THEN [{'c': c, 'what': 'duplicate', 's': open, 'e': ms}] ELSE [] END
        || CASE WHEN len(p1) > 4 THEN [{'c': p1[1].c, 'what': 'evicted', 's': p1[1].s, 'e': NULL}] ELSE [] END
        || CASE WHEN done THEN [{'c': c, 'what': 'completed', 's': one.s, 'e': ms}] ELSE [] END
        || CASE WHEN done AND len(q) = 3 THEN [{'c': q[1].c, 'what': 'forgotten', 's': q[1].s, 'e': NULL}] ELSE [] END
    FROM (SELECT *, list_filter(p2, lambda x: x.c = c)[1] AS one, held IS NULL AND NOT before AS done FROM (
      SELECT *, CASE WHEN len(p1) > 4 THEN p1[2:] ELSE p1 END AS p2 FROM (
        SELECT *, CASE WHEN held IS NULL AND open IS NULL THEN p || [{'c': c, 's': ms}] ELSE p END AS p1 FROM (
          SELECT e.session, e.k, e.c, e.before, e.ms, r.p, r.q, list_filter(r.q, lambda x: x.c = e.c)[1].s AS held, list_filter(r.p, lambda x: x.c = e.c)[1].s AS open FROM r JOIN e ON e.session = r.session AND e.k = r.k + 1)))))
  SELECT session, o.c AS call_id, o.what AS status, o.s AS started, o.e AS ended FROM (SELECT session, unnest(out) AS o FROM r)"""


def _recorded(t):
    phase = F.when(F.col("event_id") % 5 < 3, "before").otherwise("after")
    calls = t.events.select(F.col("user_id").cast("string").alias("session"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("call_id"), phase.alias("phase"), "ts", F.col("event_id").alias("seq"))
    return timers.recorded_calls(calls, 4, 3)


@query("recorded_calls", RECORD_SQL)
def recorded_calls(t):
    """Events begin and end calls of a session; four may be open and three are remembered."""
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp")).alias(c)
    return _recorded(t).select("session", "call_id", "status", millis("started"), millis("ended"))


@query("recorder_stats", f"""SELECT session, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'duplicate') AS duplicate,
  count(*) FILTER (status = 'evicted') AS evicted, count(*) FILTER (status = 'forgotten') AS forgotten FROM ({RECORD_SQL}) GROUP BY session""")
def recorder_stats(t):
    return timers.recorder_stats(_recorded(t))


#: Arguments of a tool call, keys in no order, a credential at depth two and three.
ARGUMENTS = """concat('{ "z": ', props, ', "path": "src/', event_type, '.go", "env": [ {"key": "id AKIA', upper(substr(md5(CAST(event_id AS STRING)), 1, 16)), '.", "b": [ "', event_type, '", 2.50, null ]}, true ], "n": ', CAST(event_id AS STRING), ' }')"""
PROPS = "replace(props, ' ', '')"


@query("canonical_json", f"""SELECT event_id, '{{"env":[{{"b":["' || event_type || '",2.5,null],"key":"id AKIA' || upper(substr(md5(event_id::VARCHAR), 1, 16)) || '."}},true],"n":' || event_id || ',"path":"src/' || event_type || '.go","z":' || {PROPS} || '}}' AS args FROM events""")
def canonical_json(t):
    """Arguments of calls with their keys in order, at every level."""
    return t.events.select("event_id", J.canonical_json(F.expr(ARGUMENTS)).alias("args"))


@query("redact_json", f"""SELECT event_id, '{{"env":[{{"b":["' || event_type || '",2.5,null],"key":"id [REDACTED]."}},true],"n":' || event_id || ',"path":"src/' || event_type || '.go","z":' || {PROPS} || '}}' AS args FROM events""")
def redact_json(t):
    """Credentials in arguments, however deep."""
    return t.events.select("event_id", J.redact_json(F.expr(ARGUMENTS)).alias("args"))
