"""Telemetry and evaluation over stand-ins: events are tool calls (a session is a user's day), conversations turns,
lineitems usage calls (the return flag is the status), orders delivery logs and paired runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import text as T
from graphlens.operators import evals
from graphlens.operators import telemetry as tm
from graphlens.plans.registry import query

SESSION = "user_id || '/' || strftime(ts, '%Y-%m-%d')"


def _calls(t):
    return t.events.withColumn("session", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")))


@query("turn_segments", "SELECT conv_id, turn, CAST(segment AS BIGINT) AS segment FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS segment FROM conversations) WHERE segment > 0")
def turn_segments(t):
    return tm.segments(t.conversations, "conv_id", ["turn"]).select("conv_id", "turn", "segment")


@query("tool_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def tool_counts(t):
    return tm.top_counts(t.events, "event_type", 3)


@query("tool_bigrams", f"SELECT p || '>' || event_type AS bigram, count(*) AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY {SESSION} ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL GROUP BY 1")
def tool_bigrams(t):
    return tm.tool_bigrams(_calls(t), "session", ["ts", "event_id"], "event_type")


OUTCOME = "CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'accepted' WHEN event_type = 'error' THEN 'rejected' END"


@query("pattern_candidates", f"""WITH o AS (SELECT CAST(user_id % 3 AS VARCHAR) AS repo, sha256(CAST(user_id AS VARCHAR)) AS h, {OUTCOME} AS outcome, ts, event_type AS tools, CAST(event_id AS VARCHAR) AS sol FROM events WHERE event_type <> 'signup'),
  g AS (SELECT repo, h, count(*) FILTER (outcome = 'accepted') AS s, count(*) FILTER (outcome <> 'accepted') AS f, max(ts) FILTER (outcome = 'accepted') AS last FROM o GROUP BY ALL),
  k AS (SELECT * FROM g WHERE s + f >= 3 AND s * 100 > (s + f) * 70),
  c AS (SELECT repo, h, tools, count(*) AS n FROM o WHERE outcome = 'accepted' GROUP BY repo, h, tools), m AS (SELECT repo, h, tools FROM (SELECT *, row_number() OVER (PARTITION BY repo, h ORDER BY n DESC, tools) AS r FROM c) WHERE r = 1)
  SELECT k.repo, k.h AS trigger_hash, k.s AS successes, k.f AS failures, any_value(m.tools) AS tools, min(o.sol) AS solution FROM k JOIN m USING (repo, h) JOIN o ON o.repo = k.repo AND o.h = k.h AND o.outcome = 'accepted' AND o.ts = k.last GROUP BY k.repo, k.h, k.s, k.f""")
def pattern_candidates(t):
    """A user is a trigger, event types are outcomes and tool sequences."""
    rows = t.events.select((F.col("user_id") % 3).cast("string").alias("repo"), F.col("user_id").cast("string").alias("trigger"), F.expr(OUTCOME).alias("outcome"), "ts", F.col("event_type").alias("tools"), F.col("event_id").cast("string").alias("solution"))
    return tm.patterns(rows)


@query("store_stats", "SELECT count(*) AS calls, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'purchase') AS accepted, count(*) FILTER (event_type = 'error') AS rejected FROM events")
def store_stats(t):
    kind = F.col("event_type")
    return t.events.agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.count_if(kind == "purchase").alias("accepted"), F.count_if(kind == "error").alias("rejected"))


RATES = {"input": 3_000_000, "output": 15_000_000, "cache_read": 300_000, "cache_write": 3_750_000, "cache_write_1h": 6_000_000}
COST = "(q * 3000000 + li * 15000000 + d * 300000 + (tx - least(tx, 2)) * 3750000 + least(tx, 2) * 6000000 + 500000) // 1000000"
USE = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS li, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS tx FROM lineitem"


@query("call_cost", f"SELECT l_orderkey, l_linenumber, CAST({COST} AS BIGINT) AS micros FROM ({USE})")
def call_cost(t):
    """Quantity, line number, discount and tax stand for tokens."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    micros = tm.cost(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), cents("l_discount"), cents("l_tax"), F.lit(2).cast("long"), {k: F.lit(v).cast("long") for k, v in RATES.items()})
    return t.lineitem.select("l_orderkey", "l_linenumber", micros.alias("micros"))


@query("cost_tiered", """SELECT l_orderkey, l_linenumber, CASE WHEN q > 40 THEN 6 WHEN q > 20 THEN 4 ELSE 3 END AS input FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q FROM lineitem)""")
def cost_tiered(t):
    prices = t.spark.createDataFrame([("m", 0, 3, 15), ("m", 20, 4, 20), ("m", 40, 6, 22)], "model string, above int, input int, output int")
    calls = t.lineitem.select("l_orderkey", "l_linenumber", F.lit("m").alias("model"), F.col("l_quantity").cast("int").alias("prompt_tokens"))
    return tm.with_tier(calls, prices).select("l_orderkey", "l_linenumber", F.col("rate.input").alias("input"))


@query("session_cost", f"SELECT {SESSION} AS session, count(*) AS calls, round(sum(value), 4) AS cost, count(*) FILTER (event_type = 'signup') AS unpriced FROM events GROUP BY 1")
def session_cost(t):
    return _calls(t).groupBy("session").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.count_if(F.col("event_type") == "signup").alias("unpriced"))


@query("budget_level", """SELECT event_id, level, CASE level WHEN 'normal' THEN 800::BIGINT WHEN 'increased' THEN 400 WHEN 'aggressive' THEN 200 ELSE 100 END AS threshold FROM (
  SELECT event_id, CASE WHEN r >= 1 THEN 'stop' WHEN r >= 0.9 THEN 'warn' WHEN r >= 0.75 THEN 'aggressive' WHEN r >= 0.5 THEN 'increased' ELSE 'normal' END AS level FROM (
  SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 80 AS r FROM events))""")
def budget_level(t):
    from pyspark.sql import Window

    used = F.count("*").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    e = t.events.select("event_id", tm.budget_level(used, F.lit(80)).alias("level"))
    return e.withColumn("threshold", tm.compression_threshold(F.lit(800), F.col("level")).cast("long"))


STATUS = "CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'reserved' ELSE 'unknown' END"


@query("usage_cumulative", f"""SELECT l_orderkey, count(*) AS calls, CAST(coalesce(sum(a) FILTER (s = 'completed'), 0) AS BIGINT) AS spent, CAST(coalesce(sum(a) FILTER (s = 'reserved'), 0) AS BIGINT) AS outstanding, count(*) FILTER (s = 'unknown') AS unknown_calls, bool_and(s <> 'unknown') AS cost_known
  FROM (SELECT l_orderkey, {STATUS} AS s, CAST(l_quantity AS BIGINT) AS a FROM lineitem) GROUP BY 1""")
def usage_cumulative(t):
    return tm.usage_by_status(t.lineitem.select("l_orderkey", F.expr(STATUS).alias("status"), F.col("l_quantity").cast("long").alias("amount")), ["l_orderkey"])


@query("usage_by_node", f"SELECT l_suppkey AS node, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'reserved') AS reserved, count(*) FILTER (s = 'unknown') AS unknown FROM (SELECT l_suppkey, {STATUS} AS s FROM lineitem) GROUP BY 1")
def usage_by_node(t):
    wide = t.lineitem.select(F.col("l_suppkey").alias("node"), F.expr(STATUS).alias("s")).groupBy("node").pivot("s", ["completed", "reserved", "unknown"]).count()
    return wide.fillna(0)


@query("distinct_call_totals", "SELECT l_suppkey, CAST(sum(q) AS BIGINT) AS tokens FROM (SELECT l_suppkey, l_partkey, CAST(arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS BIGINT) AS q FROM lineitem GROUP BY ALL) GROUP BY 1")
def distinct_call_totals(t):
    """A supplier's part is a call id; the first delivery counts."""
    first = tm.distinct_calls(t.lineitem.withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber")), ["l_suppkey", "l_partkey"], ["seq"])
    return first.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("tokens"))


@query("replay_violations", """WITH e AS (SELECT *, lag(l_linenumber) OVER w AS s, lag(l_linestatus) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus))
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> s + 1 THEN 'sequence' ELSE 'transition' END AS problem FROM e WHERE s IS NOT NULL AND (l_linenumber <> s + 1 OR NOT ((p = 'O' AND l_linestatus = 'O') OR (p = 'O' AND l_linestatus = 'F')))""")
def replay_violations(t):
    legal = t.spark.createDataFrame([("O", "O"), ("O", "F")], "src string, dst string")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_linestatus")
    return tm.replay_violations(rows, "l_orderkey", "l_linenumber", "l_linestatus", legal)


@query("queue_claim", "SELECT o_custkey, o_orderkey AS id, CAST(o_orderkey % 4 + 1 AS BIGINT) AS epoch FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey) AS k FROM orders WHERE (o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '1998-01-01') OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01')) WHERE k = 1")
def queue_claim(t):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    status = F.when(F.col("o_orderstatus") == "P", "leased").otherwise("ready")
    q = t.orders.select("o_custkey", F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("available_at"), F.col("o_totalprice").alias("created_at"), (F.col("o_orderkey") % 4).alias("epoch"), (F.col("o_orderdate") + F.expr("interval 730 days")).alias("lease_expires_at"))
    due = q.withColumn("lease_expires_at", F.when(F.col("available_at") < day("1996-01-01"), day("1990-01-01")).otherwise(day("2000-01-01")))
    return tm.queue_claim(due, "o_custkey", day("1998-01-01"))


@query("ledger_currency", """WITH c AS (SELECT user_id, event_id, event_id % 6 AS f, value > 10 AS passed FROM events WHERE event_type = 'view'), w AS (SELECT user_id, event_id AS ws, event_id % 6 AS f, event_id % 50 = 0 AS whole FROM events WHERE event_type = 'purchase')
  SELECT event_id AS check_id, passed AND NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = c.user_id AND ws > event_id AND (whole OR w.f = c.f)) AS current FROM c""")
def ledger_currency(t):
    """Views are checks of one file, purchases writes to one file or, now and then, to the workspace."""
    path = F.concat(F.lit("src/f"), (F.col("event_id") % 6).cast("string"))
    checks = t.events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("check_id"), F.col("event_id").alias("seq"), F.lit("exact").alias("kind"), path.alias("path"), (F.col("value") > 10).alias("passed"))
    writes = t.events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 50 == 0, "workspace").otherwise("exact").alias("kind"), path.alias("path"))
    return tm.current_checks(checks, writes, "user_id").select("check_id", "current")


@query("obligation_status", "SELECT l_orderkey, CASE min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 3 ELSE 4 END) WHEN 0 THEN 'failed' WHEN 3 THEN 'pending' ELSE 'satisfied' END AS status FROM lineitem GROUP BY 1")
def obligation_status(t):
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "N", "pending").otherwise("satisfied")
    return tm.obligation_status(t.lineitem.select("l_orderkey", status.alias("status")), "l_orderkey")


@query("task_limit_first", """SELECT l_suppkey, dimension, seq FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY seq) AS k FROM (SELECT l_suppkey, seq, CASE WHEN a > 9000 THEN 'tokens' WHEN b > 1500 THEN 'calls' END AS dimension FROM (
  SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS seq, sum(CAST(l_quantity AS BIGINT)) OVER w AS a, sum(CAST(l_linenumber AS BIGINT)) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber ROWS UNBOUNDED PRECEDING))) WHERE dimension IS NOT NULL) WHERE k = 1""")
def task_limit_first(t):
    rows = t.lineitem.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_linenumber").cast("long").alias("calls"))
    return tm.first_exhausted(rows, "l_suppkey", ["seq"], {"tokens": 9000, "calls": 1500})


@query("feedback_confidence", "SELECT user_id, round(greatest(0, least(1, 0.5 + sum(CASE event_type WHEN 'purchase' THEN 5 WHEN 'view' THEN -10 WHEN 'error' THEN -15 ELSE 0 END)::DOUBLE / 100)), 6) AS confidence FROM events GROUP BY 1")
def feedback_confidence(t):
    kind = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "view", "rejected").when(F.col("event_type") == "error", "reverted").otherwise("none")
    return tm.confidence(t.events.select("user_id", kind.alias("kind")), "user_id").withColumn("confidence", F.round("confidence", 6))


@query("futility_repeats", "SELECT user_id, CAST(epoch AS BIGINT) AS epoch, event_type, count(*) AS n FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM events) WHERE event_type <> 'purchase' GROUP BY ALL HAVING count(*) >= 3")
def futility_repeats(t):
    return tm.repeated_calls(t.events, "user_id", ["ts", "event_id"], "event_type", F.col("event_type") == "purchase")


@query("failure_streaks", """WITH e AS (SELECT user_id, event_id % 2 AS command, event_type IN ('error', 'view') AS failed, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS r, sum(CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM events)
  SELECT user_id, command, max(n) AS streak FROM (SELECT user_id, command, r - f AS i, count(*) AS n FROM e WHERE failed GROUP BY ALL) GROUP BY ALL HAVING max(n) >= 3""")
def failure_streaks(t):
    return tm.failure_streaks(t.events.withColumn("command", F.col("event_id") % 2), "user_id", ["ts", "event_id"], "command", F.col("event_type").isin("error", "view"))


#: Four events are a round; purchases write, clicks and views call, the others check their user's event types, with an exit of their own.
STEPS = """SELECT user_id AS session, event_id // 40 AS round, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'write' WHEN 'click' THEN 'call' WHEN 'view' THEN 'call' ELSE 'check' END AS kind, event_type || event_id % 2 AS what, CASE WHEN event_id % 3 > 0 THEN event_id % 2 END AS exit, event_id % 4 = 0 AS passed FROM events"""


@query("futility_notices", f"""WITH RECURSIVE s AS ({STEPS}), o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round, kind <> 'write', seq) AS k FROM s),
  r AS (SELECT DISTINCT session, 0::BIGINT AS k, MAP {{}}::MAP(VARCHAR, BIGINT) AS seen, MAP {{}}::MAP(VARCHAR, BIGINT) AS failed, []::VARCHAR[] AS told, []::STRUCT(round BIGINT, seq BIGINT, kind VARCHAR, what VARCHAR, n BIGINT)[] AS said FROM o
    UNION ALL SELECT session, k, CASE WHEN kind = 'write' THEN MAP {{}} ELSE map_concat(seen, MAP {{key: n}}) END, CASE WHEN kind = 'check' THEN map_concat(failed, MAP {{what: f}}) ELSE failed END,
      CASE WHEN kind = 'write' THEN [] ELSE told || list_transform(new, lambda x: x.kind || ':' || x.what || ':' || CASE x.kind WHEN 'failure' THEN x.n::VARCHAR ELSE key END) END, new
    FROM (SELECT *, list_filter(CASE WHEN (kind = 'call' AND n >= 3) OR (kind = 'check' AND n >= 2) THEN [{{'round': round, 'seq': seq, 'kind': kind, 'what': what, 'n': n}}] ELSE [] END
          || CASE WHEN kind = 'check' AND f >= 3 THEN [{{'round': round, 'seq': seq, 'kind': 'failure', 'what': what, 'n': f}}] ELSE [] END,
          lambda x: NOT list_contains(told, x.kind || ':' || x.what || ':' || CASE x.kind WHEN 'failure' THEN x.n::VARCHAR ELSE key END)) AS new
      FROM (SELECT o.*, r.seen, r.failed, r.told, o.kind || o.what || coalesce(CASE o.kind WHEN 'check' THEN o.exit::VARCHAR ELSE '' END, '?') AS key,
          coalesce(r.seen[o.kind || o.what || coalesce(CASE o.kind WHEN 'check' THEN o.exit::VARCHAR ELSE '' END, '?')], 0) + 1 AS n, CASE WHEN o.passed THEN 0 ELSE coalesce(r.failed[o.what], 0) + 1 END AS f FROM r JOIN o ON o.session = r.session AND o.k = r.k + 1)))
  SELECT session, x.round, x.seq, x.kind, x.what, CAST(x.n AS INTEGER) AS n FROM (SELECT session, unnest(said) AS x FROM r)""")
def futility_notices(t):
    """What each session is told, step by step."""
    rows = t.spark.sql(STEPS.replace("FROM events", "FROM {events}").replace("//", "DIV"), events=t.events)
    return tm.futility_notices(rows)


@query("turn_trim", """WITH s AS (SELECT conv_id, segment, sum((strlen(text) + 2) // 3) AS tokens FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS segment FROM conversations) WHERE segment > 0 GROUP BY ALL)
  SELECT conv_id, CAST(segment AS BIGINT) AS segment, CAST(tokens AS BIGINT) AS tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY segment DESC ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY conv_id ORDER BY segment DESC) AS k FROM s) WHERE run <= 400 OR k = 1""")
def turn_trim(t):
    return tm.kept_turns(t.conversations.withColumn("tokens", T.token_estimate(F.col("text"))), "conv_id", ["turn"], "tokens", 400)


@query("changed_blocks", "SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(a.p_type, b.p_type) AS p_type FROM (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_size < 25 GROUP BY ALL) a FULL JOIN (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_size >= 25 GROUP BY ALL) b USING (p_brand, p_type) WHERE a.n IS DISTINCT FROM b.n")
def changed_blocks(t):
    count = lambda w: t.part.where(w).groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return tm.changed_blocks(count("p_size < 25"), count("p_size >= 25"), ["p_brand", "p_type"], "n")


@query("call_correlation", "SELECT user_id, a.ts AS started, b.ts AS ended FROM (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1) a JOIN (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY 1) b USING (user_id)")
def call_correlation(t):
    kind = lambda k: t.events.where(F.col("event_type") == k).select("user_id", "ts")
    return tm.correlate(kind("view"), kind("click"), "user_id")


@query("check_roots", """WITH p AS (SELECT 'r' || (s_suppkey % 3) || '/n' || s_nationkey || '/f' || s_suppkey AS path, 'r' || (s_suppkey % 3) AS top, 'r' || (s_suppkey % 3) || '/n' || s_nationkey AS sub FROM supplier),
  m AS (SELECT DISTINCT 'r' || (s_suppkey % 3) || '/n' || s_nationkey AS root FROM supplier WHERE s_nationkey % 2 = 0)
  SELECT 'go' AS family, root, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT path, CASE WHEN sub IN (SELECT root FROM m) THEN sub ELSE top END AS root FROM p) GROUP BY root""")
def check_roots(t):
    top = F.concat(F.lit("r"), (F.col("s_suppkey") % 3).cast("string"))
    sub = F.concat(top, F.lit("/n"), F.col("s_nationkey").cast("string"))
    changed = t.supplier.select(F.concat(sub, F.lit("/f"), F.col("s_suppkey").cast("string")).alias("path"))
    manifests = t.supplier.where("s_nationkey % 2 = 0").select(F.lit("go").alias("family"), sub.alias("root")).union(t.supplier.select(F.lit("go"), top)).distinct()
    return tm.check_roots(changed, manifests)


@query("prometheus_lines", """SELECT 'events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def prometheus_lines(t):
    return tm.prometheus(t.events.groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n")), "events_total", ["type"], "n")


# --- evaluation: customers are tasks, market segments cohorts, priorities arms ---


@query("repeated_stats", "SELECT o_orderpriority AS arm, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(sqrt(coalesce(var_samp(o_totalprice), 0)), 4) AS deviation, round(1.96 * sqrt(coalesce(var_samp(o_totalprice), 0) / count(*)), 4) AS ci95, round(avg((o_orderstatus = 'F')::INT), 6) AS success_rate FROM orders GROUP BY 1")
def repeated_stats(t):
    r = evals.repeated_runs(t.orders.withColumnRenamed("o_orderpriority", "arm"), ["arm"], "o_totalprice", F.col("o_orderstatus") == "F")
    return r.select("arm", "n", F.round("mean", 4).alias("mean"), F.round(F.sqrt("variance"), 4).alias("deviation"), F.round("ci95", 4).alias("ci95"), F.round("success_rate", 6).alias("success_rate"))


ARM = "SELECT o_custkey AS task, max(o_orderstatus) = 'O' AS success, CAST(round(avg(o_totalprice)) AS BIGINT) AS tokens, count(*) AS calls FROM orders WHERE o_orderpriority {0} GROUP BY 1"


@query("paired_decision", f"""WITH p AS (SELECT c_mktsegment AS cohort, b.success AS bs, c.success AS cs, b.tokens AS bt, c.tokens AS ct, b.calls AS bc, c.calls AS cc FROM ({ARM.format("<= '2-HIGH'")}) b JOIN ({ARM.format("> '2-HIGH'")}) c USING (task) JOIN customer ON c_custkey = task),
  g AS (SELECT cohort, round((avg(bs::INT) - avg(cs::INT)) * 100, 6) AS regression, round(median((bt - ct) * 100.0::DOUBLE / bt) FILTER (bs AND cs AND bt > 0), 6) AS token_reduction, round(median((bc - cc) * 100.0::DOUBLE / bc) FILTER (bs AND cs AND bc > 0), 6) AS call_reduction FROM p GROUP BY 1)
  SELECT *, coalesce(regression <= 5 AND token_reduction >= 15 AND call_reduction >= 10, false) AS accepted FROM g""")
def paired_decision(t):
    arm = F.when(F.col("o_orderpriority") <= "2-HIGH", "b").otherwise("c")
    runs = t.orders.groupBy(F.col("o_custkey").alias("task"), arm.alias("arm")).agg((F.max("o_orderstatus") == "O").alias("success"), F.round(F.avg("o_totalprice")).cast("long").alias("tokens"), F.count("*").alias("calls"))
    paired = evals.pairs(runs, ["task"], "arm", "b", "c", ["success", "tokens", "calls"]).join(t.customer.select(F.col("c_custkey").alias("task"), F.col("c_mktsegment").alias("cohort")), "task")
    d = evals.paired_decision(paired, "cohort")
    return d.select("cohort", *[F.round(c, 6).alias(c) for c in ("regression", "token_reduction", "call_reduction")], "accepted")


@query("tokens_per_success", "SELECT o_orderpriority AS arm, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS tokens, count(*) FILTER (o_orderstatus = 'F') AS successes, round(sum(CAST(round(o_totalprice) AS BIGINT)) / count(*) FILTER (o_orderstatus = 'F'), 4) AS tokens_per_success FROM orders GROUP BY 1")
def tokens_per_success(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("arm"), F.round("o_totalprice").cast("long").alias("tok"), "o_orderstatus")
    return evals.tokens_per_success(rows, ["arm"], "tok", F.col("o_orderstatus") == "F").withColumn("tokens_per_success", F.round("tokens_per_success", 4))


@query("regression_gate", """WITH c AS (SELECT c_nationkey, count(*) AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT c_nationkey, count(*) AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND c_nationkey <> 3 GROUP BY 1)
  SELECT c_nationkey, c.v, CASE WHEN b.v IS NULL THEN 'stale' WHEN c.v > b.v * 1.1::DOUBLE THEN 'regressed' ELSE 'ok' END AS verdict FROM c LEFT JOIN b USING (c_nationkey)""")
def regression_gate(t):
    count = lambda w: t.orders.where(w).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("v"))
    return evals.gate(count("o_orderstatus = 'F'"), count("o_orderstatus = 'O'").where("c_nationkey <> 3"), ["c_nationkey"], "v")


@query("label_precision", """SELECT label, count(*) AS matched, count(*) FILTER (f = g) AS top1, count(*) FILTER (f = g OR f + 1 = g) AS "any" FROM (SELECT o_orderstatus AS label, o_custkey % 5 AS f, o_orderkey % 5 AS g FROM orders) GROUP BY 1""")
def label_precision(t):
    first = F.col("o_custkey") % 5
    found = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("label"), first.alias("first"), F.array(first, first + 1).alias("candidates"))
    return evals.label_precision(found, t.orders.select("o_orderkey", (F.col("o_orderkey") % 5).alias("target")), ["o_orderkey"])


@query("retrieval_recall", "SELECT a.o_custkey AS task, count(*) AS gold, count(b.l_partkey) AS hit, round(count(b.l_partkey) / count(*), 6) AS recall FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) a LEFT JOIN (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'N') b USING (o_custkey, l_partkey) GROUP BY 1")
def retrieval_recall(t):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("task"), "l_partkey", "l_returnflag")
    return evals.recall(rows.where("l_returnflag = 'N'"), rows, ["task"], "l_partkey").withColumn("recall", F.round("recall", 6))
