"""The guard of a request's size: what of a session's messages is shortened or left out until the rest fits a limit.

The steps have a fixed order: tool payloads are cut to previews, halving the size from ``largest`` to ``least`` over all of them at each step;
then optional context goes, source by source; then whole user turns, the oldest first; then standing guidance. Each step saves a known number of
tokens if all before it were taken, and steps are taken exactly while the total is over the limit. So the staged walk is one
running sum over a session's steps. Only the re-admission of a few small prompts at the end looks back at what it has taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions import text as T

#: Sources that may go at any time, in this order, and those that go last; sizes of a payload's preview.
OPTIONAL = ("diagnostics", "graph_prediction", "repository_context", "session_summaries", "memory", "learned_pattern", "user_hook")
GUIDANCE = ("skills", "project_docs")
LARGEST, LEAST, BRIEF, SMALL, READMITTED = 16 << 10, 256, 256, 4_096, 4


def _caps(largest: int, least: int) -> list[int]:
    out = [largest]
    while out[-1] > least:
        out.append(max(least, out[-1] // 2))
    return out


def _place(column: str, names: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("int")
    for k, name in enumerate(names):
        out = F.when(F.col(column) == name, k).otherwise(out)
    return out


def _measured(messages: DataFrame, caps: list[int], tokens: Callable, preview_tokens: Callable) -> DataFrame:
    """Messages with their size, and for each cap the tokens once previews up to it were tried: a preview that saves nothing is not taken."""
    size = F.octet_length(F.coalesce("content", F.lit("")))
    every = messages.withColumns({"_bytes": size, "_tokens": tokens(F.coalesce("content", F.lit(""))).cast("long")})
    after, steps = F.col("_tokens"), []
    for cap in caps:
        shown = F.when((F.col("role") == "tool") & (F.col("_bytes") > cap), preview_tokens(F.col("content"), cap).cast("long"))
        after = F.least(after, shown)  # null where no preview is made, which least() passes over
        steps.append(after)
    return every.withColumn("_after", F.array(*steps))


def trimmed(messages: DataFrame, limit: int, largest: int = LARGEST, least: int = LEAST, tokens: Callable[[Column], Column] = T.token_estimate, preview_tokens: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """(session, idx, state, tokens) of every message: ``kept``, ``capped`` (a preview stands for it), ``dropped``, or ``readmitted``; tokens as sent.

    ``messages``: session, idx (their order, distinct within a session), role, content, source (of system messages). The latest user message and all that
    follows it stay, system messages too unless their source may go. If the latest user message is brief, up to four small user prompts
    of dropped turns come back, the newest first, where there is room; not if guidance had to go. A null content is empty.
    ``preview_tokens``: tokens of a payload's preview of at most so many bytes (default: those of its prefix of that length).
    """
    preview_tokens = preview_tokens or (lambda content, cap: tokens(T.truncate_utf8(content, cap)))
    caps = _caps(largest, least)
    by_idx = Window.partitionBy("session").orderBy("idx")
    whole = Window.partitionBy("session")
    every = _measured(messages.select("session", "idx", "role", "content", "source"), caps, tokens, preview_tokens)
    every = every.withColumn("_turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(by_idx))
    last_user = F.max(F.when(F.col("role") == "user", F.struct("idx", "_bytes"))).over(whole)
    every = every.withColumns({"_last": F.max("_turn").over(whole), "_brief": F.coalesce(last_user["_bytes"] <= BRIEF, F.lit(False)), "_total": F.sum("_tokens").over(whole)}).drop("content")

    pairs = every.where("role = 'tool'").select("session", "idx", "_tokens", "_after", F.posexplode(F.transform("_after", lambda x, k: F.struct(F.when(k == 0, F.col("_tokens")).otherwise(F.get("_after", k - 1)).alias("from"), x.alias("to")))).alias("step", "c"))
    shorten = pairs.select("session", F.lit(1).alias("stage"), F.col("step").alias("a"), F.col("idx").cast("long").alias("b"), (F.col("c.from") - F.col("c.to")).alias("saving")).where("saving > 0")

    def sources(stage: int, names: tuple[str, ...]) -> DataFrame:
        mine = every.where("role = 'system'").withColumn("a", _place("source", names)).where("a is not null")
        return mine.select("session", F.lit(stage).alias("stage"), "a", F.col("idx").cast("long").alias("b"), F.col("_tokens").alias("saving"))

    turns = every.where("role <> 'system' and _turn < _last").groupBy("session", "_turn").agg(F.sum(F.element_at("_after", -1)).alias("saving"))
    turns = turns.select("session", F.lit(3).alias("stage"), F.col("_turn").cast("int").alias("a"), F.lit(0).cast("long").alias("b"), "saving")
    steps = shorten.unionByName(sources(2, OPTIONAL)).unionByName(turns).unionByName(sources(4, GUIDANCE))

    before = F.coalesce(F.sum("saving").over(Window.partitionBy("session").orderBy("stage", "a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = every.select("session", "_total").distinct()
    taken = steps.withColumn("_before", before).join(totals, "session").where(F.col("_total") - F.col("_before") > limit)

    cut = taken.where("stage = 1").groupBy("session", F.col("b").alias("idx")).agg(F.max("a").alias("_step"))
    gone = taken.where("stage in (2, 4)").select("session", F.col("b").alias("idx"), F.lit(True).alias("_gone"))
    old = taken.where("stage = 3").select("session", F.col("a").cast("long").alias("_turn"), F.lit(True).alias("_old"))
    spent = taken.groupBy("session").agg(F.sum("saving").alias("_saved"), F.max("stage").alias("_stage"))
    joined = every.join(cut, ["session", "idx"], "left").join(gone, ["session", "idx"], "left").join(old, ["session", "_turn"], "left").join(spent, "session", "left")
    dropped = F.coalesce("_gone", F.lit(False)) | ((F.col("role") != "system") & F.coalesce("_old", F.lit(False)))
    sent = F.when(F.col("_step").isNotNull(), F.get("_after", F.col("_step"))).otherwise(F.col("_tokens"))
    state = joined.select("session", "idx", "role", "_bytes", "_brief", sent.alias("tokens"), dropped.alias("_dropped"), F.col("_step").isNotNull().alias("_cut"), (F.col("_total") - F.coalesce("_saved", F.lit(0))).alias("_left"), (F.coalesce("_stage", F.lit(0)) == 4).alias("_guided"))

    # the four newest small prompts that went, and which of them fit again, newest first
    prompts = state.where((F.col("role") == "user") & F.col("_dropped") & F.col("_brief") & ~F.col("_guided") & (F.col("_bytes") <= SMALL) & (F.col("_left") <= limit))
    prompts = prompts.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("idx")))).where(F.col("_n") <= READMITTED)
    held = prompts.groupBy("session").agg(F.first("_left").alias("_left"), F.array_sort(F.collect_list(F.struct("_n", "idx", "tokens"))).alias("_p"))
    fits = lambda s, p: s["left"] + p["tokens"] <= limit
    start = F.struct(F.col("_left").alias("left"), F.array().cast("array<long>").alias("back"))
    folded = F.aggregate("_p", start, lambda s, p: F.struct((s["left"] + F.when(fits(s, p), p["tokens"]).otherwise(0)).alias("left"), F.when(fits(s, p), F.concat(s["back"], F.array(p["idx"].cast("long")))).otherwise(s["back"]).alias("back")), lambda s: s["back"])
    back = held.select("session", F.explode(folded).alias("idx")).withColumn("_back", F.lit(True))
    final = state.join(back, ["session", "idx"], "left")
    name = F.when(F.col("_back"), "readmitted").when(F.col("_dropped"), "dropped").when(F.col("_cut"), "capped").otherwise("kept")
    return final.select("session", "idx", name.alias("state"), F.when(F.col("_dropped") & F.col("_back").isNull(), 0).otherwise(F.col("tokens")).alias("tokens"))


# --- answers within an exact budget ---


def _json_bytes(value: Column) -> Column:
    return F.octet_length(F.to_json(F.struct(value.alias("v")))) - 6  # {"v":...}


def _envelope(query_items: str, truncated: bool, budget: int) -> str:
    return f'{{"items":[{query_items}],"max_tokens":{budget},"omitted":{{{chr(34)}output_budget{chr(34)}:1}},"truncated":true}}' if truncated else f'{{"items":[{query_items}],"max_tokens":{budget},"omitted":{{}},"truncated":false}}'


def charged(size: Column) -> Column:
    """Tokens that an answer of so many bytes is charged: the estimate, a tenth more, and a fixed reserve."""
    tokens = F.floor((size + 2) / 3)
    return tokens + 32 + F.ceil(tokens / 10)


def fitted(items: DataFrame, budget: int) -> DataFrame:
    """(query, rank, excerpt) of the items of each answer that fits ``budget``: excerpts are halved, the last one first and down to
    nothing before the one in front of it, then items go from the end, and not one step more than is needed.

    ``items``: query, rank (distinct within a query), head (a struct of an item's other fields), excerpt. What is measured is the whole answer as JSON
    (``answers``), with its notice once anything was cut. A step changes the length of its own item only, so the length after any number of steps is a
    running sum, and the first that fits is the result; a query whose bare notice is over the budget has no items. A null excerpt is empty.
    """
    text = F.coalesce("excerpt", F.lit(""))
    every = items.select("query", "rank", "head", text.alias("excerpt")).withColumn("_n", F.length("excerpt"))
    bare = F.octet_length(F.to_json(F.struct("head", F.lit("").alias("excerpt"))))
    every = every.withColumns({"_bare": bare, "_first": F.row_number().over(Window.partitionBy("query").orderBy("rank")) == 1})
    halved = lambda k: F.substring("excerpt", F.lit(1), F.shiftright("_n", k) if isinstance(k, int) else F.expr(f"CAST(floor(_n / pow(2, {k})) AS INT)"))
    levels = every.where("_n > 0").withColumn("k", F.explode(F.expr("sequence(1, length(bin(_n)))")))
    cut = levels.select("query", F.lit(1).alias("stage"), (-F.col("rank")).alias("a"), "k", (_json_bytes(halved("(k - 1)")) - _json_bytes(halved("k"))).cast("long").alias("saving"))
    gone = every.select("query", F.lit(2).alias("stage"), (-F.col("rank")).alias("a"), F.lit(0).alias("k"), (F.col("_bare") + F.when(F.col("_first"), 0).otherwise(1)).cast("long").alias("saving"))
    plain, noticed = (len(_envelope("", t, budget).encode()) for t in (False, True))
    whole = every.groupBy("query").agg(F.sum(F.col("_bare") + _json_bytes(F.col("excerpt")) - 2 + F.when(F.col("_first"), 0).otherwise(1)).cast("long").alias("_size"))
    # how far each step brings its query, and whether the step before it still was over
    before = F.coalesce(F.sum("saving").over(Window.partitionBy("query").orderBy("stage", "a", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = cut.unionByName(gone).withColumn("_before", before).join(whole, "query")
    # the notice comes with the first step, which only an answer without it decides
    size = F.col("_size") - F.col("_before") + F.when(F.col("_before") == 0, plain).otherwise(noticed)
    taken = steps.where((charged(F.col("_size") + plain) > budget) & (charged(size) > budget))
    cuts = taken.where("stage = 1").groupBy("query", (-F.col("a")).alias("rank")).agg(F.max("k").alias("_k"))
    lost = taken.where("stage = 2").select("query", (-F.col("a")).alias("rank"))
    kept = every.join(lost, ["query", "rank"], "left_anti").join(cuts, ["query", "rank"], "left")
    return kept.select("query", "rank", "head", F.when(F.col("_k").isNull(), F.col("excerpt")).otherwise(halved("_k")).alias("excerpt"), F.col("_k").isNotNull().alias("cut"))


def answers(items: DataFrame, fit: DataFrame, budget: int) -> DataFrame:
    """(query, answer): the JSON of each query's fitted items, in order, with the notice if anything was cut or left out."""
    one = F.to_json(F.struct("head", "excerpt"))
    kept = fit.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("j")))), lambda x: x["j"]), ",").alias("_j"), F.count("*").alias("_n"), F.bool_or("cut").alias("_cut"))
    every = items.groupBy("query").agg(F.count("*").alias("_all")).join(kept, "query", "left")
    body = F.coalesce("_j", F.lit(""))
    cut = F.coalesce("_cut", F.lit(False)) | (F.coalesce("_n", F.lit(0)) < F.col("_all"))
    shape = lambda truncated: F.concat(*[p for part in _envelope("\0", truncated, budget).split("\0") for p in (F.lit(part), body)][:-1])
    return every.select("query", F.when(cut, shape(True)).otherwise(shape(False)).alias("answer"))
