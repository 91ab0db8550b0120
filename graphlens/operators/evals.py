"""Evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_runs(runs: DataFrame, group: list[str], value: str, success: Column) -> DataFrame:
    """Mean, sample variance (0 for one run), the half width of a 95 % interval, and the rate of success."""
    v = F.coalesce(F.var_samp(value), F.lit(0.0))
    return runs.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), v.alias("variance"), (F.sqrt(v / F.count("*")) * 1.96).alias("ci95"), F.avg(success.cast("double")).alias("success_rate"))


def pairs(runs: DataFrame, key: list[str], arm: str, baseline: str, candidate: str, values: list[str]) -> DataFrame:
    """Baseline and candidate runs of one task and repeat side by side."""
    side = lambda name, p: runs.where(F.col(arm) == name).select(*key, *[F.col(v).alias(f"{p}_{v}") for v in values])
    return side(baseline, "b").join(side(candidate, "c"), key)


def paired_decision(paired: DataFrame, cohort: str, regression: float = 5, tokens: float = 15, calls: float = 10) -> DataFrame:
    """Per cohort: success regression in points, median reductions in percent where both succeed, and whether it is
    accepted. Columns: b_/c_ success, tokens, calls."""
    both = F.col("b_success") & F.col("c_success")
    reduction = lambda v: F.median(F.when(both & (F.col(f"b_{v}") > 0), (F.col(f"b_{v}") - F.col(f"c_{v}")) * 100.0 / F.col(f"b_{v}")))
    out = paired.groupBy(cohort).agg(((F.avg(F.col("b_success").cast("double")) - F.avg(F.col("c_success").cast("double"))) * 100).alias("regression"), reduction("tokens").alias("token_reduction"), reduction("calls").alias("call_reduction"))
    ok = (F.col("regression") <= regression) & (F.col("token_reduction") >= tokens) & (F.col("call_reduction") >= calls)
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def tokens_per_success(runs: DataFrame, group: list[str], tokens: str, success: Column) -> DataFrame:
    """Failed runs stay in the numerator; no success gives null."""
    n = F.count_if(success)
    return runs.groupBy(*group).agg(F.sum(tokens).alias("tokens"), n.alias("successes"), F.when(n > 0, F.sum(tokens) / n).alias("tokens_per_success"))


def gate(current: DataFrame, baseline: DataFrame, key: list[str], value: str, most: float = 0.10) -> DataFrame:
    """ok, regressed (more than 10 % above), or stale (no baseline)."""
    joined = current.join(baseline.select(*key, F.col(value).alias("_b")), key, "left")
    return joined.withColumn("verdict", F.when(F.col("_b").isNull(), "stale").when(F.col(value) > F.col("_b") * (1 + most), "regressed").otherwise("ok")).drop("_b")


def label_precision(found: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """(label, matched, top1, any): per label how often the first, or any, candidate is the gold target."""
    joined = found.join(gold.select(*key, F.col("target").alias("_g")), key)
    return joined.groupBy("label").agg(F.count("*").alias("matched"), F.count_if(F.col("first") == F.col("_g")).alias("top1"), F.count_if(F.array_contains("candidates", F.col("_g"))).alias("any"))


def recall(found: DataFrame, gold: DataFrame, key: list[str], item: str) -> DataFrame:
    """(key, gold, hit, recall) of each task."""
    hits = gold.select(*key, item).distinct().join(found.select(*key, item).distinct().withColumn("_h", F.lit(1)), [*key, item], "left")
    return hits.groupBy(*key).agg(F.count("*").alias("gold"), F.count("_h").alias("hit"), (F.count("_h") / F.count("*")).alias("recall"))


def gold_match(refs: DataFrame, gold: DataFrame) -> DataFrame:
    """References with the gold reference that stands for each: of those on its line that spell its name, one whose columns hold its own, else
    the first; references without any are left out. Several may meet one gold reference.

    ``refs``: ref_id, path, line, col (from 1), name and any other columns; ``gold``: gold_id, path, line, start, end (from 0, end exclusive), text, def_path,
    def_line, callable, errata.
    """
    # of gold references over the same columns the first is enough
    spans = gold.groupBy("path", "line", "text", "start", "end").agg(F.min(F.struct("gold_id", "def_path", "def_line", "callable", "errata")).alias("_f"))
    gold = spans.select("path", "line", "text", "start", "end", "_f.*")
    sides = gold.select("path", "line", F.col("text").alias("name"), F.struct("start", "gold_id", "end", "def_path", "def_line", "callable", "errata").alias("_g"))
    joined = refs.join(sides, ["path", "line", "name"])
    outside = ~((F.col("col") - 1 >= F.col("_g.start")) & (F.col("col") - 1 < F.col("_g.end")))
    best = joined.groupBy("ref_id").agg(F.min(F.struct(outside.alias("outside"), "_g")).alias("_b"))
    return refs.join(best, "ref_id").select(*[refs[c] for c in refs.columns], "_b._g.gold_id", "_b._g.def_path", "_b._g.def_line", "_b._g.callable", "_b._g.errata", (~F.col("_b.outside")).alias("same_column"))


def gold_precision(matched: DataFrame) -> DataFrame:
    """(label, matched, top1, any) per label: how often the first, or any, of a reference's targets (path, line, end_line, in order) holds the
    gold definition. Gold references that are in error do not count; a reference without label is ``unresolved``."""
    holds = lambda t: (t["path"] == F.col("def_path")) & F.col("def_line").between(t["line"], F.greatest(t["line"], t["end_line"]))
    rows = matched.where("not errata").withColumns({"_1": F.coalesce(holds(F.get("targets", F.lit(0))), F.lit(False)), "_any": F.exists("targets", holds)})
    return rows.groupBy(F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit("unresolved")).alias("label")).agg(F.count("*").alias("matched"), F.count_if("_1").alias("top1"), F.count_if("_any").alias("any"))


def gold_coverage(matched: DataFrame, gold: DataFrame, callable_: bool) -> DataFrame:
    """(gold, covered, coverage) of the gold references of calls or of types that are not in error."""
    own = (F.col("callable") == callable_) & ~F.col("errata")
    met = matched.where(own).select("gold_id").distinct().withColumn("_met", F.lit(1))
    return gold.where(own).select("gold_id").join(met, "gold_id", "left").agg(F.count("*").alias("gold"), F.count("_met").alias("covered")).withColumn("coverage", F.when(F.col("gold") > 0, F.round(F.col("covered") / F.col("gold"), 4)).otherwise(0.0))
