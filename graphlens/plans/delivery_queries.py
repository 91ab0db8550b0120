"""Deliveries over events: a user is a delivery, its events the log, or requests to change it."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.operators import deliveries
from graphlens.plans.registry import query

#: A log of each user: admitted first, then types by the event's; every hundred-and-first has a wrong version, every eighty-ninth another source, every seventy-third a gap before it.
LOG = """SELECT delivery, n + sum(CASE WHEN event_id % 73 = 1 AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY delivery ORDER BY n) AS sequence, type, CASE WHEN type <> 'noted' THEN v + CASE WHEN event_id % 101 = 2 THEN 1 ELSE 0 END END AS version,
    CASE WHEN type = 'transitioned' THEN CASE WHEN event_id % 89 = 3 THEN 's9' ELSE concat('s', (moved - 1) % 3) END END AS src, CASE WHEN type IN ('admitted', 'transitioned') THEN concat('s', moved % 3) END AS dst
  FROM (SELECT *, sum(CASE WHEN type <> 'noted' THEN 1 ELSE 0 END) OVER (PARTITION BY delivery ORDER BY n) AS v, sum(CASE WHEN type = 'transitioned' THEN 1 ELSE 0 END) OVER (PARTITION BY delivery ORDER BY n) AS moved
    FROM (SELECT *, CASE WHEN n = 1 THEN 'admitted' WHEN event_type IN ('view', 'click') THEN 'transitioned' WHEN event_type = 'purchase' THEN 'goal_revised' WHEN event_type = 'error' THEN 'decision_requested' ELSE 'noted' END AS type
      FROM (SELECT user_id AS delivery, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)))"""


@query("delivery_replay", f"""WITH RECURSIVE l AS ({LOG}), e AS (SELECT *, row_number() OVER (PARTITION BY delivery ORDER BY sequence) AS k FROM l),
  r AS (SELECT DISTINCT delivery, 0::BIGINT AS k, NULL::VARCHAR AS state, NULL::BIGINT AS version, NULL::BIGINT AS broken_at, NULL::VARCHAR AS problem FROM e
    UNION ALL SELECT delivery, k, CASE WHEN bad IS NULL AND type IN ('admitted', 'transitioned') THEN dst ELSE state END, CASE WHEN bad IS NULL AND type <> 'noted' THEN next ELSE version END, CASE WHEN bad IS NOT NULL THEN sequence END, bad
    FROM (SELECT e.delivery, e.k, e.type, e.dst, e.version AS next, e.sequence, r.state, r.version,
        CASE WHEN e.sequence <> e.k THEN 'sequence' WHEN (e.type = 'admitted') <> (e.k = 1) THEN 'admission' WHEN e.type NOT IN ('admitted', 'noted') AND e.version <> r.version + 1 THEN 'version'
             WHEN e.type = 'transitioned' AND (e.src <> r.state OR (e.src, e.dst) NOT IN (('s0', 's1'), ('s1', 's2'), ('s2', 's0'))) THEN 'transition' END AS bad
      FROM r JOIN e ON e.delivery = r.delivery AND e.k = r.k + 1 WHERE r.problem IS NULL))
  SELECT delivery, arg_max(CASE WHEN state IS NULL THEN '' ELSE state END, k) AS state, arg_max(coalesce(version, 0), k)::BIGINT AS version, max(k) - count(problem) AS events, max(broken_at)::BIGINT AS broken_at, max(problem) AS problem FROM r GROUP BY delivery""")
def delivery_replay(t):
    """The state of each delivery after its log, or after the part of it that holds."""
    log = t.spark.sql(LOG.replace("FROM events", "FROM {events}"), events=t.events)
    legal = t.spark.createDataFrame([("s0", "s1"), ("s1", "s2"), ("s2", "s0")], "src string, dst string")
    found = deliveries.replay(log, legal)
    return found.select("delivery", F.coalesce("state", F.lit("")).alias("state"), F.coalesce("version", F.lit(0)).alias("version"), "events", "broken_at", "problem")


REQUESTS = "SELECT user_id AS delivery, event_id AS seq, concat('k', event_id % 9) AS key, event_type AS fingerprint, event_id % 6 + 1 AS expected FROM events"


@query("delivery_mutations", f"""WITH RECURSIVE q AS ({REQUESTS}), c AS (SELECT c_custkey AS delivery, c_custkey % 3 + 1 AS version FROM customer WHERE c_acctbal > 0), e AS (SELECT *, row_number() OVER (PARTITION BY delivery ORDER BY seq) AS k FROM q),
  r AS (SELECT DISTINCT e.delivery, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, c.version::BIGINT AS version, MAP {{}}::MAP(VARCHAR, VARCHAR) AS keys FROM e LEFT JOIN c USING (delivery)
    UNION ALL SELECT delivery, k, seq, outcome, version + CASE outcome WHEN 'applied' THEN 1 ELSE 0 END, CASE outcome WHEN 'applied' THEN map_concat(keys, MAP {{key: fingerprint}}) ELSE keys END FROM (
      SELECT e.delivery, e.k, e.seq, e.key, e.fingerprint, r.version, r.keys, CASE WHEN r.version IS NULL THEN 'missing' WHEN r.keys[e.key] = e.fingerprint THEN 'replayed' WHEN r.keys[e.key] IS NOT NULL THEN 'conflict' WHEN e.expected = r.version THEN 'applied' ELSE 'stale' END AS outcome
      FROM r JOIN e ON e.delivery = r.delivery AND e.k = r.k + 1))
  SELECT delivery, seq, outcome, version FROM r WHERE k > 0""")
def delivery_mutations(t):
    """Requests in order against versions and keys."""
    requests = t.spark.sql(REQUESTS.replace("FROM events", "FROM {events}"), events=t.events)
    return deliveries.mutations(requests, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("delivery"), (F.col("c_custkey") % 3 + 1).alias("version")))
