"""Obligations of a task against its ledger: which checks are still owed, by path and as a whole.

Of one obligation and path, only the last result counts, and whether anything that it depends on was written since. So the ordered
walk over a ledger is two aggregates and a comparison. Overlaps of paths and scopes are equi-joins on exploded folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses from the worst; an obligation has the worst of its paths.
WORST = ("failed", "cancelled", "stale", "pending", "satisfied")
#: Runners whose command may go on with arguments.
RUNNERS = ("go test", "pytest", "cargo test", "npm test")


def folders(path: Column) -> Column:
    """A path and all folders above it, the root as ``.``."""
    bare = F.regexp_replace(path, "/+$", "")
    parts = F.split(bare, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit(".")), above))


def answers(o, e) -> Column:
    """Whether a check is one that an obligation asks for: of its family and root, else of its command (a runner's with any
    arguments), else of its class. ``o`` and ``e`` give a column of the obligation and of the check by its name."""
    family = (e("command_family") == o("command_family")) & e("check_root").eqNullSafe(o("check_root")) & e("command_class").eqNullSafe(o("command_class"))
    bare = F.regexp_replace(e("command"), "^(?:python3? -m )", "")
    runs = (o("kind") == "test") & o("command").isin(*RUNNERS) & ((bare == o("command")) | bare.startswith(F.concat(o("command"), F.lit(" "))))
    no = lambda c: F.coalesce(c, F.lit(False))
    named = no(runs) | no(e("command") == o("command")) | no(e("detail") == o("obligation_id")) | no(e("detail") == o("command"))
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return no(F.when(given(o("command_family")), family).when(o("kind") == "quiescence", False).when(given(o("command")), named).otherwise(e("command_class") == o("command_class")))


def _inputs(checks: DataFrame) -> DataFrame:
    """(task, seq, key): what a Go check reads beyond its scopes: packages that it depends on, its module's files, and the package of each file in its scope."""
    root = F.when(F.coalesce("check_root", F.lit("")).isin("", "."), "").otherwise(F.concat("check_root", F.lit("/")))
    files = F.filter("scopes", lambda s: (s["kind"] == "exact") & s["path"].endswith(".go"))
    none = F.array().cast("array<string>")
    keys = F.concat(
        F.transform(F.coalesce("input_dirs", none), lambda d: F.concat(F.lit("dir:"), d)),
        F.array(F.concat(F.lit("file:"), root, F.lit("go.mod")), F.concat(F.lit("file:"), root, F.lit("go.sum"))),
        F.coalesce(F.transform(files, lambda s: F.concat(F.lit("go:"), _parent(s["path"]))), none),
    )
    return checks.where("command_family like 'go-%'").select("task", "seq", F.explode(F.array_distinct(keys)).alias("key"))


def _parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def _outdated(checks: DataFrame, writes: DataFrame) -> DataFrame:
    """(task, seq, written): the last write that meets a check's own scopes or inputs. A scope without kind is a file; events without
    scopes have their paths."""
    exact = lambda p: F.struct(F.lit("exact").alias("kind"), p.alias("path"))
    both = lambda d: d.select("task", "seq", F.explode(F.when(F.size("scopes") > 0, F.col("scopes")).otherwise(F.transform("paths", exact))).alias("s"), (F.size("scopes") > 0).alias("scoped"), "paths")
    area = F.when(F.col("s.kind") == "workspace", ".").otherwise(F.regexp_replace("s.path", "/+$", ""))
    # without scopes on either side, paths meet as folders do
    wide = F.col("s.kind").isin("workspace", "directory")
    c = both(checks).select("task", F.col("seq").alias("c_seq"), area.alias("c_path"), wide.alias("c_wide"), F.col("scoped").alias("c_scoped"))
    # of all writes to a place the last is the only one that matters
    w = both(writes).groupBy("task", area.alias("w_path"), wide.alias("w_wide"), F.col("scoped").alias("w_scoped")).agg(F.max("seq").alias("w_seq"))
    down = c.withColumn("k", F.col("c_path")).join(w.withColumn("k", F.explode(folders(F.col("w_path")))), ["task", "k"])
    down = down.where((F.col("c_path") == F.col("w_path")) | F.col("c_wide") | (F.col("w_wide") & (F.col("w_path") == ".")) | (~F.col("c_scoped") & ~F.col("w_scoped")))
    up = c.withColumn("k", F.explode(folders(F.col("c_path")))).join(w.withColumn("k", F.col("w_path")), ["task", "k"])
    up = up.where((F.col("c_path") == F.col("w_path")) | F.col("w_wide") | (~F.col("c_scoped") & ~F.col("w_scoped")))
    paths = writes.select("task", F.col("seq").alias("w_seq"), F.explode("paths").alias("p"))
    go = F.when(F.col("p").endswith(".go"), F.array(F.concat(F.lit("go:"), _parent(F.col("p"))))).otherwise(F.array().cast("array<string>"))
    touched = paths.select("task", "w_seq", F.explode(F.concat(F.array(F.concat(F.lit("dir:"), _parent(F.col("p"))), F.concat(F.lit("file:"), F.col("p"))), go)).alias("key")).groupBy("task", "key").agg(F.max("w_seq").alias("w_seq"))
    read = _inputs(checks).select("task", F.col("seq").alias("c_seq"), "key").join(touched, ["task", "key"])
    names = ["task", "c_seq", "w_seq"]
    every = down.select(*names).union(up.select(*names)).union(read.select(*names)).where("w_seq > c_seq")
    return every.groupBy("task", F.col("c_seq").alias("seq")).agg(F.max("w_seq").alias("written"))


def path_status(obligations: DataFrame, events: DataFrame) -> DataFrame:
    """(task, obligation_id, path, status) of every path of every obligation: ``pending`` without a result, else that of the last one: ``satisfied``, ``failed``
    or ``cancelled``; ``stale`` if it was satisfied and the path, or what the check read, was written since.

    ``obligations``: task, obligation_id, kind, command, command_class, command_family, check_root, paths. ``events``: task, seq (distinct within a task), type (write,
    verification, uncertainty), paths, scopes, command, command_class, command_family, check_root, input_dirs, detail, passed, cancelled. A check counts for the paths
    that one of its own paths holds; a write for those that it holds or lies in; an uncertainty, ``cancelled:`` and the obligation's name, likewise.
    """
    asked = obligations.withColumn("path", F.explode("paths"))
    there = ["task", "obligation_id", "path"]
    spread = events.select("task", "seq", "type", F.explode("paths").alias("e_path")).withColumn("e_path", F.regexp_replace("e_path", "/+$", ""))
    spread = spread.where("type <> 'write'").unionByName(spread.where("type = 'write'").groupBy("task", "type", "e_path").agg(F.max("seq").alias("seq")))
    held = asked.select(*there, F.explode(folders(F.col("path"))).alias("k")).join(spread.withColumn("k", F.col("e_path")), ["task", "k"])
    within = asked.select(*there, F.regexp_replace("path", "/+$", "").alias("k")).join(spread.where("type <> 'verification'").withColumn("k", F.explode(folders(F.col("e_path")))), ["task", "k"])
    met = held.select(*there, "seq", "type").union(within.select(*there, "seq", "type")).distinct()
    written = met.where("type = 'write'").groupBy(*there).agg(F.max("seq").alias("_written"))
    said = met.where("type <> 'write'").join(events.drop("type", "paths"), ["task", "seq"]).alias("e").join(obligations.drop("paths").alias("o"), ["task", "obligation_id"])
    cancels = (F.col("e.type") == "uncertainty") & F.coalesce((F.col("e.detail") == F.concat(F.lit("cancelled:"), F.col("obligation_id"))) | ((F.coalesce("o.command", F.lit("")) != "") & (F.col("e.detail") == F.concat(F.lit("cancelled:"), F.col("o.command")))), F.lit(False))
    # the join makes the obligation's id a column of its own
    checks = (F.col("e.type") == "verification") & answers(lambda n: F.col(n if n == "obligation_id" else f"o.{n}"), lambda n: F.col(f"e.{n}"))
    result = F.when(cancels, "cancelled").when(F.col("e.passed"), "satisfied").when(F.coalesce("e.cancelled", F.lit(False)), "cancelled").otherwise("failed")
    last = said.where(cancels | checks).groupBy(*there).agg(F.max(F.struct(F.col("e.seq").alias("seq"), result.alias("status"))).alias("_last"))
    joined = asked.select(*there).distinct().join(last, there, "left").join(written, there, "left").withColumn("seq", F.col("_last.seq"))
    counted = events.where("type = 'verification'").join(last.select("task", F.col("_last.seq").alias("seq")).distinct(), ["task", "seq"], "left_semi")
    joined = joined.join(_outdated(counted, events.where("type = 'write'")), ["task", "seq"], "left")
    stale = (F.col("_last.status") == "satisfied") & (F.coalesce(F.greatest("_written", "written"), F.lit(-1)) > F.col("seq"))
    return joined.select(*there, F.when(F.col("seq").isNull(), "pending").when(stale, "stale").otherwise(F.col("_last.status")).alias("status"))


def fold(obligations: DataFrame, events: DataFrame) -> DataFrame:
    """(task, obligation_id, status) of every obligation: the worst of its paths' statuses, pending without paths."""
    order = F.lit(len(WORST) - 1)
    for k, status in enumerate(WORST):
        order = F.when(F.col("status") == status, k).otherwise(order)
    worst = path_status(obligations, events).groupBy("task", "obligation_id").agg(F.element_at(F.array(*map(F.lit, WORST)), F.min(order) + 1).alias("status"))
    return obligations.select("task", "obligation_id").join(worst, ["task", "obligation_id"], "left").select("task", "obligation_id", F.coalesce("status", F.lit("pending")).alias("status"))
