"""Graph analytics over edge tables. Loops have a depth bound; each round is a join, and the frontier is cut to a table."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.session import cut

ALPHA, EPSILON, ROUNDS = 0.25, 5e-4, 40
#: Rows of a partition where pairs are dealt by their number.
DEALT = 250_000
#: Weights by how a reference was resolved, and by what a document's mention names.
WEIGHTS = {"type_checked": 1.0, "import_resolved": 1.0, "type_hinted": 0.8, "name_matched": 0.4, "ambiguous": 0.15}
MENTION_WEIGHTS = {"symbol": 0.8, "route": 0.8, "path": 0.5, "ident": 0.4, "ticket": 0.3}


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None = None, expand: Column | None = None) -> DataFrame:
    """(seed, node, depth): what is reached from each seed along (src, dst) in at most ``depth`` steps, with the least; without
    ``depth``, until a round finds nothing new.

    ``expand``: a condition on an edge; where it fails, its end is listed but not expanded. Seeds are not listed.
    """
    e = edges.select("src", "dst", (F.lit(True) if expand is None else expand).alias("_go"))
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(True).alias("_go"))
    level = seen
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        step = level.where("_go").select("seed", F.col("node").alias("src")).join(e, "src")
        step = step.groupBy("seed", F.col("dst").alias("node")).agg(F.max("_go").alias("_go")).withColumn("depth", F.lit(d))
        level = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", "depth", "_go")
        if depth is None or depth > 3:
            level = cut(level)
            if level.isEmpty():
                break
        seen = seen.unionByName(level)
    return seen.where("depth > 0").select("seed", "node", "depth")


def reached(edges: DataFrame, sources: DataFrame, hops: int = 4) -> DataFrame:
    """(id): all that can be reached from any of ``sources`` (id) in one step or more; sources only where they are. A round
    takes ``hops`` steps in one plan and is then written, so long chains take few rounds. No side is sent through the driver."""
    e = cut(edges.select("src", "dst").distinct())
    frontier, found = sources.select("id").distinct(), None
    while True:
        steps, hop = None, frontier
        for _ in range(hops):
            hop = e.join(hop.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
            steps = hop if steps is None else steps.union(hop)
        fresh = cut(steps.distinct() if found is None else steps.distinct().join(found.hint("merge"), "id", "left_anti"))
        if fresh.isEmpty():
            return fresh if found is None else found
        found = fresh if found is None else found.unionByName(fresh)
        frontier = fresh


def below(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of ``reached``, for graphs in which most nodes have one way in: rounds grow with the logarithm of a chain.

    A node with one way in looks up it; each round it looks past what it sees, so the part that it knows doubles, until it
    comes to a source, or to a node with no way in or several. Those with several are walked by ``reached`` over what the
    chains leave of the graph. A ring is known whole once the part is as long as there are nodes. Joins are merges: neither
    side is sent through the driver, however little a round leaves.
    """
    marked = sources.select(F.col("id").alias("src")).where("src IS NOT NULL").distinct().withColumn("_s", F.lit(True))
    ways = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    ways = cut(ways.join(marked.hint("merge"), "src", "left").select("dst", "src", F.col("_s").isNotNull().alias("hit")))
    entries = ways.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("at"), F.bool_or("hit").alias("hit"))
    state = cut(entries.where("n = 1").select(F.col("dst").alias("id"), "at", "hit", (~F.col("hit")).alias("open")))
    known, nodes = 1, state.count()
    while known < nodes and not state.where("open").isEmpty():
        seen = state.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("hit").alias("_hit"), F.col("open").alias("_open"))
        moved = state.where("open").select("id", "at").join(seen.hint("merge"), "at", "left")
        moved = moved.select("id", F.coalesce("_at", "at").alias("at"), F.coalesce("_hit", F.lit(False)).alias("hit"), F.coalesce("_open", F.lit(False)).alias("open"))
        state, known = cut(state.where("NOT open").unionByName(moved)), 2 * known
    found = state.where("hit").select("id")
    several = entries.where("n > 1").select(F.col("dst").alias("id"))
    if several.isEmpty():
        return found
    several = cut(several)
    ends = state.select(F.col("id").alias("src"), F.col("at").alias("_at"), F.col("hit").alias("_hit"))
    left = ways.join(several.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi").join(ends.hint("merge"), "src", "left")
    left = cut(left.select(F.coalesce("_at", "src").alias("src"), "dst", (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit")))
    inner = left.join(several.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi")
    first = left.where("hit").select(F.col("dst").alias("id")).distinct()
    more = cut(first.union(reached(inner, first)).distinct())
    after = state.where("NOT hit").select(F.col("at").alias("id"), F.col("id").alias("_id")).join(more.hint("merge"), "id", "left_semi")
    return found.union(more).union(after.select(F.col("_id").alias("id")))


def find_callers(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(seed, depth, callee, label, caller, candidates): the callers of each seed (id), and of its callers, up to ``depth``
    levels (three at most, as callers expect). Ambiguous callers are listed and not followed.

    ``edges``: caller, callee, label, candidates. A declaration is followed from the level at which it is first reached by an
    edge that is not ambiguous, so the levels are those of a walk over such edges, joined once more to all edges.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth is 1 to 3")
    sure = edges.where("label <> 'ambiguous'").select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    ids = seeds.select("id").distinct()
    followed = ids.select(F.col("id").alias("seed"), F.col("id").alias("callee"), F.lit(1).alias("depth"))
    if depth > 1:
        followed = followed.unionByName(bfs(sure, ids, depth - 1).select("seed", F.col("node").alias("callee"), (F.col("depth") + 1).alias("depth")))
    return followed.join(edges, "callee").select("seed", "depth", "callee", "label", "caller", "candidates")


def callers_by_depth(found: DataFrame) -> DataFrame:
    """(seed, depth, callee, label, callers): the rows of ``find_callers`` by callee and label, callers in order."""
    entry = F.concat(F.col("caller").cast("string"), F.when(F.col("candidates") > 1, F.concat(F.lit(" (1 of "), F.col("candidates").cast("string"), F.lit(" candidates)"))).otherwise(F.lit("")))
    return found.groupBy("seed", "depth", "callee", "label").agg(F.array_sort(F.collect_list(entry)).alias("callers"))


def _dealt(rows: DataFrame, many: int, *keys: str) -> DataFrame:
    """``rows`` over partitions of about ``DEALT`` rows, whatever their number: an aggregate on the keys has no part before its
    shuffle, and holds no more than a partition."""
    return rows.repartition(1 + many // DEALT, *keys)


def _steps(at: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(seed, ``name``): the ends of edges (src, dst) from where each seed is (seed, src). Pairs are counted before they are made and dealt
    by their number; a source with more than a partition's is salted by seed. Both are tables: they are read more than once."""
    here = _dealt(at.select("src"), at.count(), "src").groupBy("src").agg(F.count("*").alias("_n"))
    fans = _dealt(edges.select("src"), edges.count(), "src").groupBy("src").agg(F.count("*").alias("_m"))
    load = cut(here.join(fans.hint("merge"), "src").select("src", (F.col("_n") * F.col("_m")).alias("_n")))
    pairs = load.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = F.broadcast(load.where(F.col("_n") > DEALT).select("src", F.expr(f"1 + _n div {DEALT}").alias("_k")))  # fewer than partitions
    salts = F.coalesce("_k", F.lit(1))
    left = at.join(hot, "src", "left").select("src", "seed", F.pmod(F.xxhash64("seed"), salts).alias("_salt"))
    right = edges.join(hot, "src", "left").select("src", "dst", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("_salt"))
    met = _dealt(left, pairs, "src", "_salt").join(_dealt(right, pairs, "src", "_salt").hint("merge"), ["src", "_salt"])
    return _dealt(met.select("seed", F.col("dst").alias(name)), pairs, "seed", name).distinct()


def tests_for(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, test): tests that call a seed within ``depth`` steps; tests are not expanded. ``edges``: caller, callee.

    The walk goes along callers that are no tests, a step fewer than ``depth``, and all that it comes to meets the tests' edges
    at once: the last level, by far the largest, is made of tests only.
    """
    tests = symbols.where("is_test").select(F.col("symbol_id").alias("dst"), F.lit(True).alias("_t")).distinct()
    calls = cut(edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst")))
    many = calls.count()
    calls = calls.join(tests.hint("merge"), "dst", "left").select("src", "dst", F.col("_t").isNotNull().alias("_t"))
    back = cut(_dealt(calls, many, "src", "dst").distinct())
    level = cut(seeds.select(F.col("id").alias("seed"), F.col("id").alias("src")).distinct())
    seen = level
    for _ in range(1, depth):
        level = cut(_steps(level, back.where("NOT _t"), "src"))
        seen = seen.unionByName(level)
    return _steps(seen, back.where("_t"), "test").where("seed <> test")


def impact(symbols: DataFrame, edges: DataFrame, touched: DataFrame) -> DataFrame:
    """(symbol_id, callers, tests, breaking) of touched symbols: breaking if exported and called from another package."""
    s = symbols.select(F.col("symbol_id").alias("caller"), F.col("package").alias("_cp"), F.col("is_test").alias("_ct"))
    joined = symbols.join(touched.select("symbol_id"), "symbol_id", "left_semi").join(edges.select("caller", F.col("callee").alias("symbol_id")), "symbol_id", "left").join(s, "caller", "left")
    return joined.groupBy("symbol_id").agg(
        F.count_if(~F.col("_ct")).alias("callers"),
        F.count_if(F.col("_ct")).alias("tests"),
        F.max(F.coalesce(F.col("exported") & (F.col("_cp") != F.col("package")), F.lit(False))).alias("breaking"),
    )


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Everything reachable, by rounds until one finds nothing new."""
    return bfs(edges, seeds)


def subtypes(extends: DataFrame, roots: DataFrame, abstract: DataFrame, depth: int = 6) -> DataFrame:
    """(root, type): transitive subtypes; abstract kinds are crossed but not reported. ``extends``: type, base."""
    found = bfs(extends.select(F.col("base").alias("src"), F.col("type").alias("dst")), roots, depth)
    return found.join(abstract.select(F.col("type").alias("node")), "node", "left_anti").select(F.col("seed").alias("root"), F.col("node").alias("type"))


def _weight(column: str, weights: dict[str, float]) -> Column:
    """The weight of a name; others weigh nothing."""
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = F.when(F.col(column) == name, weight).otherwise(out)
    return out


def edge_weights(edges: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """(src, dst, w): both directions, a label's weight over the number of candidates, the way back at 0.8 of it; and from
    document sections to what they mention. Labels without a weight give no edge.

    ``edges``: caller, callee, label, candidates; ``mentions``: section, target, kind, label, candidates.
    """
    w = _weight("label", WEIGHTS) / F.col("candidates")
    every = edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), w.alias("w")).union(edges.select("callee", "caller", (w * 0.8).alias("w")))
    if mentions is not None:
        every = every.union(mentions.select("section", "target", (_weight("kind", MENTION_WEIGHTS) * w).alias("w")))
    return every.where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def personalized_pagerank(weights: DataFrame, seeds: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, rounds: int = ROUNDS) -> DataFrame:
    """(node, score): forward push in synchronous rounds from seeds (node, mass). Residuals of at least ``epsilon`` are
    pushed; a node without edges keeps its mass. The sum of all scores never exceeds the seeds' mass."""
    out = weights.withColumn("_p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "_p")
    dead = F.col("_has").isNull()
    have = out.select(F.col("src").alias("node"), F.lit(True).alias("_has")).distinct()
    state = cut(seeds.groupBy("node").agg(F.sum("mass").alias("r")).select("node", "r", F.lit(0.0).alias("score")))
    for _ in range(rounds):
        live = state.where(F.col("r") >= epsilon)
        if live.isEmpty():
            break
        kept = state.join(have, "node", "left").select("node", F.when(F.col("r") >= epsilon, 0.0).otherwise(F.col("r")).alias("r"), (F.col("score") + F.when(F.col("r") >= epsilon, F.col("r") * F.when(dead, 1.0).otherwise(alpha)).otherwise(0.0)).alias("score"))
        sent = live.select(F.col("node").alias("src"), "r").join(out, "src").select(F.col("dst").alias("node"), (F.col("r") * (1 - alpha) * F.col("_p")).alias("r"), F.lit(0.0).alias("score"))
        state = cut(kept.union(sent).groupBy("node").agg(F.sum("r").alias("r"), F.sum("score").alias("score")))
    return state.where("score > 0").select("node", "score")


def neighbours(edges: DataFrame, mentions: DataFrame | None = None, most: int = 48) -> DataFrame:
    """(src, dst, w, kind, label): whom a declaration ``calls`` and whom it is ``called_by`` (at 0.8 of the weight), and what a section ``mentions``; at
    most ``most`` of each, the first by line and number, so that no hub is joined to more. Labels without a weight give none.

    ``edges``: caller, callee, line, label, candidates; ``mentions``: section, target, kind, label, candidates.
    """
    w = _weight("label", WEIGHTS) / F.col("candidates")
    own = edges.where("caller <> callee")
    sides = [
        own.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), w.alias("w"), F.lit("calls").alias("kind"), "label", "line"),
        own.select(F.col("callee").alias("src"), F.col("caller").alias("dst"), (w * 0.8).alias("w"), F.lit("called_by").alias("kind"), "label", "line"),
    ]
    if mentions is not None:
        sides.append(mentions.select(F.col("section").alias("src"), F.col("target").alias("dst"), (_weight("kind", MENTION_WEIGHTS) * w).alias("w"), F.lit("mentions").alias("kind"), "label", F.lit(0).alias("line")))
    every = sides[0]
    for side in sides[1:]:
        every = every.unionByName(side)
    nth = F.row_number().over(Window.partitionBy("src", "kind").orderBy("line", "dst", "label", "w"))
    return every.where("w > 0").withColumn("_n", nth).where(F.col("_n") <= most).drop("_n", "line")


def push(adjacent: DataFrame, seeds: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, rounds: int = ROUNDS) -> DataFrame:
    """(query, node, score, pred, kind, label): personalised PageRank of many queries in one run, by synchronous forward push.

    ``adjacent``: the rows of ``neighbours``; ``seeds``: query, node, mass. Residuals are keyed by query and node; those of at least ``epsilon``
    are pushed, and each push carries where it comes from, so the aggregate that sums residuals also keeps the predecessor of the largest one
    (ties: the smallest). Seeds have none. A query's scores never exceed its mass.
    """
    out = cut(adjacent.withColumn("_p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "_p", "kind", "label"))
    have = out.select(F.col("src").alias("node"), F.lit(True).alias("_has")).distinct()
    # the least of (-mass, ...) is the largest mass; rounded, so that equal sums in another order stay equal
    best = lambda m, pred, kind, label: F.struct((-F.round(m, 12)).alias("m"), pred.alias("pred"), kind.alias("kind"), label.alias("label"))
    node = dict(seeds.dtypes)["node"]
    none = F.lit(None).cast(f"struct<m: double, pred: {node}, kind: string, label: string>")
    state = cut(seeds.groupBy("query", "node").agg(F.sum("mass").alias("r")).select("query", "node", "r", F.lit(0.0).alias("score"), none.alias("best"), F.lit(True).alias("seed")))
    for _ in range(rounds):
        live = state.where(F.col("r") >= epsilon)
        if live.isEmpty():
            break
        taken = F.when(F.col("r") >= epsilon, F.col("r") * F.when(F.col("_has").isNull(), 1.0).otherwise(alpha)).otherwise(0.0)
        kept = state.join(have, "node", "left").select("query", "node", F.when(F.col("r") >= epsilon, 0.0).otherwise(F.col("r")).alias("r"), (F.col("score") + taken).alias("score"), "best", "seed")
        mass = F.col("r") * (1 - alpha) * F.col("_p")
        sent = live.select("query", F.col("node").alias("src"), "r").join(out, "src").select("query", F.col("dst").alias("node"), mass.alias("r"), F.lit(0.0).alias("score"), best(mass, F.col("src"), F.col("kind"), F.col("label")).alias("best"), F.lit(False).alias("seed"))
        state = cut(kept.union(sent).groupBy("query", "node").agg(F.sum("r").alias("r"), F.sum("score").alias("score"), F.min("best").alias("best"), F.bool_or("seed").alias("seed")))
    said = lambda c: F.when(~F.col("seed"), F.col(f"best.{c}")).alias(c)
    return state.where("score > 0").select("query", "node", "score", said("pred"), said("kind"), said("label"))


def ways_back(found: DataFrame, most: int = 8) -> DataFrame:
    """(query, node, way): from each node of ``push`` back over predecessors to a seed, nodes in that order; a way that comes to a node again, or to one
    without a score, ends there. Predecessors are looked up ``most`` times at most: a push loses a quarter at each step, so ways are short."""
    step = found.select("query", F.col("node").alias("_at"), F.col("pred").alias("_next"))
    ways = found.select("query", "node", F.array("node").alias("way"), F.col("pred").alias("_at"))
    for _ in range(most):
        going = F.col("_at").isNotNull() & ~F.array_contains("way", F.col("_at"))
        ways = ways.join(step, ["query", "_at"], "left").select("query", "node", F.when(going, F.concat("way", F.array("_at"))).otherwise(F.col("way")).alias("way"), F.when(going, F.col("_next")).alias("_at"))
    return ways.select("query", "node", "way")


def seed_mass(seeds: DataFrame) -> DataFrame:
    """(query, node, mass): seeds of a kind share its weight; each query's masses add up to one."""
    kinds = {"exact": 1.0, "range": 1.0, "path": 0.5, "word": 0.3, "search": 0.4}
    weight = F.lit(0.1)
    for name, w in kinds.items():
        weight = F.when(F.col("kind") == name, w).otherwise(weight)
    shared = seeds.withColumn("_w", weight / F.count("*").over(Window.partitionBy("query", "kind")))
    summed = shared.groupBy("query", "node").agg(F.sum("_w").alias("_w"))
    return summed.select("query", "node", (F.col("_w") / F.sum("_w").over(Window.partitionBy("query"))).alias("mass"))


def final_score(ppr: Column, bm25: Column, exact: Column, is_test: Column, is_section: Column, two_hop: Column) -> Column:
    score = ppr + bm25 * 0.2 + F.when(exact, 1.0).otherwise(0.0)
    for part, factor in ((is_test, 0.5), (is_section, 0.5), (two_hop, 0.4)):
        score = score * F.when(part, factor).otherwise(1.0)
    return score


def diversify(rows: DataFrame, group: list[str], file: str, score: str, tie: str, decay: float = 0.6) -> DataFrame:
    """Greedy choice of the largest score * decay^(items already taken from its file): within a file the order is by
    score, so the factor is known from the rank, and one sort replaces the loop."""
    place = F.row_number().over(Window.partitionBy(*group, file).orderBy(F.desc(score), tie)) - 1
    return rows.withColumn("adjusted", F.col(score) * F.pow(F.lit(decay), place))


def pack_budget(items: DataFrame, budget: int, excerpts: int = 8, most: int = 40) -> DataFrame:
    """Greedy packing of at most ``most`` ranked rows of each query: an excerpt if it fits (at most ``excerpts``), else a
    signature, else a handle, else nothing. The state is folded over a query's rows, a short array."""
    top = items.withColumn("_k", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("_k") <= most)
    rows = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "excerpt_tokens", "signature_tokens", "handle_tokens"))).alias("_rows"))
    said = lambda zoom, tokens: F.struct(F.lit(zoom).alias("zoom"), tokens.cast("long").alias("tokens"))

    def packed(state: Column, x: Column) -> Column:
        left = state["left"]
        choice = (
            F.when((state["used"] < excerpts) & (x["excerpt_tokens"] <= left), said("excerpt", x["excerpt_tokens"]))
            .when(x["signature_tokens"] <= left, said("signature", x["signature_tokens"]))
            .when(x["handle_tokens"] <= left, said("handle", x["handle_tokens"]))
            .otherwise(said("omitted", F.lit(0)))
        )
        row = F.struct(x["rank"].cast("long").alias("rank"), x["item"].alias("item"), choice["zoom"].alias("zoom"), choice["tokens"].alias("tokens"))
        return F.struct((left - choice["tokens"]).alias("left"), (state["used"] + (choice["zoom"] == "excerpt").cast("int")).alias("used"), F.concat(state["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(0).alias("used"), F.array().cast("array<struct<rank:bigint,item:string,zoom:string,tokens:bigint>>").alias("rows"))
    folded = rows.select("query", F.aggregate("_rows", start, packed, lambda s: s["rows"]).alias("_out"))
    return folded.select("query", F.explode("_out").alias("_o")).select("query", "_o.*")


def co_change(changes: DataFrame, commit: str, file: str, target, k: int = 20) -> DataFrame:
    """(file, co_changes): files changed in the commits that changed ``target``, the most frequent first."""
    mine = changes.where(F.col(file) == target).select(commit).distinct()
    others = changes.where(F.col(file) != target).select(commit, file).distinct().join(mine, commit, "left_semi")
    return others.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("co_changes")).orderBy(F.desc("co_changes"), "file").limit(k)


def claims_status(claims: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, status): stale if its own anchor changed, doubted if anything that it derives from is stale, by however many
    steps, else live. What is stale is one source for all claims.

    ``claims``: id, derived_from (array of ids), path, hash; ``changed``: path, hash as it is now.
    """
    now = changed.select("path", F.col("hash").alias("_h"))
    own = cut(claims.join(now.hint("merge"), "path", "left").select("id", (F.col("_h").isNotNull() & (F.col("_h") != F.col("hash"))).alias("_stale")))
    derived = claims.select(F.col("id").alias("dst"), F.explode("derived_from").alias("src"))
    doubted = below(derived, own.where("_stale").select("id")).withColumn("_d", F.lit(True))
    return own.join(doubted.hint("merge"), "id", "left").select("id", F.when(F.col("_stale"), "stale").when(F.col("_d"), "doubted").otherwise("live").alias("status"))


def relocate(anchors: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """(id, start): where an anchor's ``n`` lines stand now: the nearest window of equal hash to its old start.

    ``anchors``: id, path, start, hash; ``lines``: path, line_no, line.
    """
    w = Window.partitionBy("path").orderBy("line_no")
    window = F.concat_ws("\n", F.col("line"), *[F.lead("line", k).over(w) for k in range(1, n)])
    shingles = lines.withColumn("_last", F.lead("line", n - 1).over(w)).withColumn("_text", window).where(F.col("_last").isNotNull()).select("path", "line_no", F.sha2("_text", 256).alias("hash"))
    found = anchors.join(shingles, ["path", "hash"])
    order = [F.abs(F.col("line_no") - F.col("start")), F.col("line_no")]
    return found.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_k = 1").select("id", F.col("line_no").alias("start"))
