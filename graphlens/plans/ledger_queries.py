"""Obligations over a ledger made of events: a task is a user, purchases and signups write, views and clicks check, errors cancel."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.operators import obligations as O
from graphlens.plans.registry import query

PATH = "CASE event_id % 4 WHEN 0 THEN concat('src/a', event_id % 3, '.go') WHEN 1 THEN 'src' WHEN 2 THEN concat('lib/b', event_id % 5, '.py') ELSE '.' END"
LEDGER = f"""SELECT user_id AS task, event_id AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' WHEN event_type = 'error' THEN 'uncertainty' ELSE 'verification' END AS type,
  {PATH} AS path, CASE event_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'directory' ELSE 'workspace' END AS scope,
  CASE event_id % 5 WHEN 0 THEN 'go test ./...' WHEN 1 THEN 'go build ./...' WHEN 2 THEN 'python -m pytest -q' WHEN 3 THEN 'go vet' ELSE 'go test' END AS command,
  CASE WHEN event_id % 6 = 0 THEN 'go-test' ELSE '' END AS command_family, CASE event_id % 3 WHEN 0 THEN 'test' ELSE 'build' END AS command_class, '.' AS check_root,
  concat('cancelled:', CASE event_id % 3 WHEN 0 THEN 'test:go test' WHEN 1 THEN 'go build ./...' ELSE 'nothing' END) AS detail, value > 30 AS passed, event_id % 7 = 0 AS cancelled FROM events"""
#: (id, kind, command, class, family, root, paths) that every task owes.
OWED = (
    ("test:go test", "test", "go test", "test", "", "", ["src/a0.go", "src/a1.go"]),
    ("build:go build ./...", "build", "go build ./...", "build", "", "", ["src", "lib/b1.py"]),
    ("test:pytest", "test", "pytest", "test", "", "", ["lib"]),
    ("family", "test", "", "test", "go-test", ".", ["src/a2.go"]),
    ("class", "diff", "", "build", "", "", ["lib/b2.py"]),
    ("quiet", "quiescence", "", "", "", "", []),
)
_ROWS = ", ".join(f"({', '.join(repr(x) for x in o[:6])}, {o[6]}::VARCHAR[])" for o in OWED)
#: Every obligation's paths against the ledger, event by event.
PATH_SQL = f"""WITH RECURSIVE ev AS ({LEDGER}), e AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY seq) AS k FROM ev),
  owed AS (SELECT * FROM (VALUES {_ROWS}) AS v(id, kind, command, class, family, root, paths)), tasks AS (SELECT DISTINCT task FROM ev),
  r AS (SELECT task, id, kind, owed.command, class, family, root, unnest(paths) AS path, 0::BIGINT AS k, 'pending' AS status, NULL::BIGINT AS evidence FROM tasks, owed
    UNION ALL SELECT task, id, kind, command, class, family, root, path, k,
      CASE WHEN fits THEN CASE WHEN passed THEN 'satisfied' WHEN cancelled THEN 'cancelled' ELSE 'failed' END
           WHEN type = 'write' AND status = 'satisfied' AND (meets OR scopes OR inputs) THEN 'stale'
           WHEN type = 'uncertainty' AND meets AND (detail = 'cancelled:' || id OR (command <> '' AND detail = 'cancelled:' || command)) THEN 'cancelled' ELSE status END,
      CASE WHEN fits THEN seq ELSE evidence END
    FROM (SELECT r.task, r.id, r.kind, r.command, r.class, r.family, r.root, r.path, e.k, r.status, r.evidence, e.type, e.passed, e.cancelled, e.detail, e.seq,
        e.path = '.' OR e.path = r.path OR starts_with(r.path, e.path || '/') OR starts_with(e.path, r.path || '/') AS meets,
        e.type = 'verification' AND (e.path = '.' OR e.path = r.path OR starts_with(r.path, e.path || '/')) AND CASE
          WHEN r.family <> '' THEN e.command_family = r.family AND e.check_root = r.root AND e.command_class = r.class
          WHEN r.kind = 'quiescence' THEN false
          WHEN r.command <> '' THEN e.command = r.command OR (r.command IN ('go test', 'pytest') AND starts_with(replace(e.command, 'python -m ', '') || ' ', r.command || ' '))
          ELSE e.command_class = r.class END AS fits,
        c.scope = 'workspace' OR c.path = e.path OR (c.scope = 'directory' AND (c.path = '.' OR starts_with(e.path, c.path || '/'))) AS scopes,
        c.command_family = 'go-test' AND (regexp_extract('./' || e.path, '^(?:\\./)?(.*)/[^/]*$', 1) = 'lib' OR (e.path LIKE '%.go' AND c.scope = 'exact' AND c.path LIKE '%.go')) AS inputs
      FROM r JOIN e ON e.task = r.task AND e.k = r.k + 1 LEFT JOIN ev c ON c.task = r.task AND c.seq = r.evidence)),
  p AS (SELECT task, id AS obligation_id, path, arg_max(status, k) AS status FROM r GROUP BY ALL)"""


def _tables(t):
    rows = t.spark.sql(LEDGER.replace("FROM events", "FROM {events}"), events=t.events)
    checks = F.col("type") == "verification"
    scope = F.when(checks, F.array(F.struct(F.col("scope").alias("kind"), "path"))).otherwise(F.array().cast("array<struct<kind: string, path: string>>"))
    lib = F.when(F.col("command_family") == "go-test", F.array(F.lit("lib")))
    ledger = rows.select("*", F.array("path").alias("paths"), scope.alias("scopes"), lib.alias("input_dirs")).drop("path", "scope")
    names = ("obligation_id", "kind", "command", "command_class", "command_family", "check_root")
    one = lambda o: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, o, strict=False)], F.array(*map(F.lit, o[6])).cast("array<string>").alias("paths"))
    owed = rows.select("task").distinct().select("task", F.explode(F.array(*map(one, OWED))).alias("o")).select("task", "o.*")
    return owed, ledger


@query("obligation_paths", f"{PATH_SQL} SELECT * FROM p")
def obligation_paths(t):
    """The status of each path of each task's obligations."""
    return O.path_status(*_tables(t))


@query("obligation_fold", f"{PATH_SQL}, w AS (SELECT task, obligation_id, min(CASE status WHEN 'failed' THEN 0 WHEN 'cancelled' THEN 1 WHEN 'stale' THEN 2 WHEN 'pending' THEN 3 ELSE 4 END) AS s FROM p GROUP BY ALL) SELECT tasks.task, owed.id AS obligation_id, coalesce(['failed', 'cancelled', 'stale', 'pending', 'satisfied'][s + 1], 'pending') AS status FROM tasks CROSS JOIN owed LEFT JOIN w ON w.task = tasks.task AND w.obligation_id = owed.id")
def obligation_fold(t):
    """The worst status of each obligation."""
    return O.fold(*_tables(t))
