"""What is shuffled for many references and many declarations of one name: it grows with both, not with their product."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphlens.functions import text as T
from graphlens.operators import context, evals, graph, ladder, lookup, resolve, search
from graphlens.plans import QUERIES

REFS, SYMBOLS = 2000, 400


def stages(spark):
    doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, doubles, None)
    return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}


def shuffled(spark, run):
    """(rows of the result, records that its stages shuffled)"""
    before = stages(spark)
    n = run().agg(F.sum(F.lit(1)).alias("n")).first()["n"]
    return n, sum(records for stage, records in stages(spark).items() if stage not in before)


def ids(spark, n, name, *columns):
    return spark.range(n).selectExpr(f"id AS {name}", *columns)


def _import_qualified(spark):
    imports = spark.createDataFrame([("p", "a", "u")], "path string, alias string, unit string")
    return lookup.import_qualified(ids(spark, REFS, "ref_id", "'p' AS path", "'a' AS qualifier", "'n' AS name"), imports, ids(spark, SYMBOLS, "symbol_id", "'u' AS unit", "'n' AS name", "true AS exported", "id % 2 = 0 AS static"))


def _constructors(spark):
    return context.constructors(ids(spark, REFS, "ref_id", "1 AS class_id", "int(id % 3) AS args"), ids(spark, SYMBOLS, "ctor_id", "1 AS class_id", "int(id % 2) AS least", "2 AS most", "false AS is_declaration", "false AS overloads"))


def _external(spark):
    owners = spark.createDataFrame([("go", "p/m", "u")], "lang string, spec string, unit string")
    symbols = ids(spark, SYMBOLS, "symbol_id", "'go' AS lang", "'n' AS name", "'u' AS unit", "'' AS receiver", "'function' AS kind", "true AS exported", "0 AS min_args", "1 AS max_args")
    return resolve.external_by_name(ids(spark, REFS, "ref_id", "'go' AS lang", "array('p/m') AS specs", "'n' AS name", "1 AS n_args"), owners, symbols)


def _ladder(spark):
    imports = spark.createDataFrame([], "path string, unit string, name string")
    return resolve.ladder(ids(spark, REFS, "ref_id", "'p' AS path", "'u' AS unit", "'n' AS name"), ids(spark, SYMBOLS, "symbol_id", "'q' AS path", "'u' AS unit", "'n' AS name", "true AS exported"), imports)


def _unqualified(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    refs = ids(spark, REFS, "ref_id", "'java' AS lang", "'p' AS path", "'u' AS unit", "'n' AS name", "true AS is_call", "string(null) AS enclosing_type", "string(null) AS lambda_type")
    symbols = ids(spark, SYMBOLS, "symbol_id", "'q' AS path", "'u' AS unit", "'n' AS name", "'' AS receiver", "true AS exported")
    return ladder.unqualified(refs, symbols, empty("path string, unit string, name string, alias string"), empty("type string, base string"), empty("unit string, name string, at_unit string, at_name string"))


MENTION = ("'d' AS path", "id AS section", "array('p') AS paths")
SYMBOL = ("'n' AS name", "'func' AS kind", "'p' AS path", "true AS top", "true AS definition")


def _mentions(spark):
    return context.resolved_mentions(ids(spark, REFS, "ref_id", "'symbol' AS kind", "'n' AS name", *MENTION), ids(spark, SYMBOLS, "symbol_id", *SYMBOL))


def _mentioned_by(spark):
    rows = ids(spark, REFS, "ref_id", "'path' AS kind", "'n' AS name", *MENTION)
    return context.mentioned_by(context.resolved_mentions(rows, ids(spark, SYMBOLS, "symbol_id", *SYMBOL)), rows)


def _gold(spark):
    refs = ids(spark, REFS, "ref_id", "1 AS path", "1 AS line", "3 AS col", "'f' AS name")
    return evals.gold_match(refs, ids(spark, SYMBOLS, "gold_id", "1 AS path", "1 AS line", "0 AS start", "9 AS end", "'f' AS text", "1 AS def_path", "1 AS def_line", "true AS callable", "false AS errata"))


def _innermost(spark):
    return resolve.innermost(ids(spark, REFS, "point", "1 AS file", "5 AS line"), ids(spark, SYMBOLS, "span_id", "1 AS file", "0 AS start", "9 AS end"), "file", "line")


@pytest.mark.parametrize("run,n", [
    (_import_qualified, REFS * SYMBOLS // 2), (_constructors, REFS * SYMBOLS), (_external, REFS * SYMBOLS), (_ladder, REFS * SYMBOLS), (_unqualified, REFS * 8),
    (_mentions, REFS * 8), (_mentioned_by, REFS * 8), (_gold, REFS), (_innermost, REFS),
])
def test_pairs_are_not_shuffled(spark, run, n):
    rows, records = shuffled(spark, lambda: run(spark))
    assert rows == n and records < REFS * SYMBOLS / 4


def test_candidates_of_the_registered_queries_are_not_shuffled(spark, tmp_path):
    table = lambda name, n, *columns: spark.range(n).selectExpr(*columns).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    table("orders", 97 * 20, "id * 97 AS o_orderkey", "id AS o_custkey")
    table("customer", 97 * 400, "id AS c_custkey", "int(id % 25) AS c_nationkey", "'BUILDING' AS c_mktsegment", "1.0D AS c_acctbal")
    table("nation", 25, "int(id) AS n_nationkey")
    rows, records = shuffled(spark, lambda: QUERIES["in_build_deps"](spark, str(tmp_path)))
    assert rows > 50_000 and records < 97 * 20 * 400 / 4
    table("events", 3000, "id AS event_id", "'view' AS event_type")
    rows, records = shuffled(spark, lambda: QUERIES["overloads_by_type"](spark, str(tmp_path)))
    assert rows == 3000 and records < 3000 * 6


def test_one_of_a_kind_is_resolved(spark):
    """References may have several rows, equal ones too, and nulls; each gets what its own rows say."""
    data = [(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (4, None), (5, None), (6, "a"), (6, "a"), (None, "a")]
    refs, seen = spark.createDataFrame(data, "ref_id int, name string"), []

    def of(rows):
        seen.append(rows.count())
        return rows.groupBy("ref_id").agg(F.count("*").alias("n"), F.max("name").alias("last"))

    assert sorted(map(tuple, resolve.once_for_alike(refs, of).collect()), key=str) == sorted([(1, 2, "b"), (2, 2, "b"), (3, 1, "a"), (4, 1, None), (5, 1, None), (6, 2, "a"), (None, 1, "a")], key=str)
    assert seen == [2 + 1 + 1 + 2]


def test_routes_of_one_path_are_dealt(spark):
    """All clients and servers have one path; their pairs are made by several tasks."""
    routes = ids(spark, 8 * resolve.SALT_ROWS, "page_id", "'route' AS kind", "'ANY /x' AS key")
    pairs = resolve.contract_join(routes, routes.where("page_id < 3"))
    parts = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 24 * resolve.SALT_ROWS and len(parts) > 1


def test_scores_are_made_where_documents_are(spark):
    docs = ids(spark, 400, "doc_id", "concat('shared word number', id) AS text")
    asked = ids(spark, 50, "query_id", "concat('shared question ', id) AS query")
    rows, records = shuffled(spark, lambda: search.recall(docs, "doc_id", "text", asked))
    assert rows == 400 * 50 and records < 400 * 50 / 4
    posted = search.postings(docs, "doc_id", "text")
    rows, records = shuffled(spark, lambda: search.bm25(posted, "doc_id", T.query_terms(asked, ["query_id"], "query")))
    assert rows == 400 * 50 and records < 400 * 50 / 2


def test_texts_of_one_language_are_counted_in_place(spark):
    texts = ids(spark, 2000, "id", "'en' AS lang", "'some words here' AS text")
    rows, records = shuffled(spark, lambda: T.weighted_terms(texts, ["lang"], "text"))
    assert rows and records < 200


def test_equal_questions_meet_once(spark):
    """Copies match the first of them, and near questions the first copy; pairs of copies are not made."""
    asked = ids(spark, 400, "id", "concat('a b c d e f g h i j k l', CASE WHEN id % 2 = 1 THEN ' m' ELSE '' END) AS question")
    found = {r["id"]: (r["match"], round(r["similarity"], 3)) for r in search.question_dedup(asked).collect()}
    assert found == {1: (0, 0.923), **{k: (k % 2, 1.0) for k in range(2, 400)}}
    assert shuffled(spark, lambda: search.question_dedup(asked))[1] < 400 * 399 / 2 / 4


def test_what_derives_from_stale_claims_is_found_in_few_rounds_without_the_driver(spark, monkeypatch):
    """A chain of 300 claims takes as many rounds as its length has doublings, and no round's table is broadcast."""
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    claims = ids(spark, 300, "id", "array(id - 1) AS derived_from", "id AS path", "'old' AS hash")
    found = graph.claims_status(claims, ids(spark, 300, "path", "IF(id = 100, 'new', 'old') AS hash"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r["id"]: r["status"] for r in found.collect()} == {k: "live" if k < 100 else "stale" if k == 100 else "doubted" for k in range(300)}
    assert len(plans) < 20 and not any("BroadcastExchange" in p for p in plans)


@pytest.mark.parametrize("seed", range(4))
def test_below_is_what_is_reached(spark, seed):
    """Chains, rings, nodes with several ways in, sources that are reached or no node at all, nulls and repeated edges."""
    rng = random.Random(seed)
    edges = [(rng.randrange(40), k) for k in range(40)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(3 * seed)] + [(50, 51), (51, 52), (52, 50), (52, 53), (60, 61), (61, 60), (61, 62), (None, 5), (7, None)]
    sources = {rng.randrange(40) for _ in range(3)} | {52, 99}
    want, frontier = set(), sources
    while frontier:
        frontier = {b for a, b in edges if a in frontier and b is not None} - want
        want |= frontier
    got = graph.below(spark.createDataFrame(edges * 2, "src int, dst int"), spark.createDataFrame([(x,) for x in sources], "id int"))
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Partitions grow with the pairs, for a hub of callers too; tests that call each other, a seed that is a test, a seed that calls itself, repeated and null edges."""
    monkeypatch.setattr(graph, "DEALT", 10, raising=False)
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(150)] + [(k, 0) for k in range(60)] + [(0, 1), (1, 1), (None, 2), (2, None)]
    tests, seeds = {k for k in range(60) if k % 4 == 0}, range(0, 60, 3)
    want = set()
    for seed in seeds:
        level, seen = {seed}, {seed}
        for _ in range(3):
            level = {a for a, b in edges if b in level and a is not None and (b == seed or b not in tests)} - seen
            seen |= level
        want |= {(seed, x) for x in seen & tests if x != seed}
    found = graph.tests_for(spark.createDataFrame(edges * 2, "caller int, callee int"), ids(spark, 60, "symbol_id", "id % 4 = 0 AS is_test"), spark.createDataFrame([(x,) for x in seeds], "id int"))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.rdd.getNumPartitions() > 4  # the setting


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_coverage", "bm25_two_corpora"])
def test_every_term_of_a_long_query_counts(spark, tmp_path, name):
    """The 33rd and later terms of an item find documents too."""
    terms = [f"w{k:02d}" for k in range(40)]
    spark.createDataFrame([(1, "w00 x", "en"), (2, "w39 x", "en"), (3, "x", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(terms))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["matched"]) for r in found) == [(7, 1, 1, 1), (7, 2, 2, 1)]


MANY = 20_000


def _in_build_deps(spark):
    symbols = ids(spark, SYMBOLS, "symbol_id", "'n' AS name", "1L AS target")
    deps = spark.createDataFrame([(1, 2)], "unit long, dep long")
    return resolve.once_for_alike(ids(spark, MANY, "ref_id", "1L AS unit", "'n' AS name"), lambda r, s: context.in_build_deps(r.join(s, "name"), deps, "_many"), symbols=symbols)


@pytest.mark.parametrize("run", [_constructors, _external, _in_build_deps, _import_qualified, _ladder])
def test_references_are_dealt_twice_and_symbols_by_kinds(spark, monkeypatch, run):
    """A reference is dealt to be paired, before that its key to find repeated ones where it isn't dealt yet; copies of what its kind means are few."""
    monkeypatch.setitem(globals(), "REFS", MANY)
    rows, records = shuffled(spark, lambda: run(spark))
    assert rows == MANY * SYMBOLS // (2 if run is _import_qualified else 1) and records < MANY * (2.2 if run is _import_qualified else 1.2)


def test_symbols_that_are_alike_are_resolved_once(spark):
    """Ids may have several rows, equal ones too, be null, and stand for others in counts; each reference gets every id."""
    refs = spark.createDataFrame([(k, "a" if k < 5 else "b") for k in range(8)], "ref_id int, name string")
    data = [(k, "a") for k in range(3000)] + [(4000, "a"), (4000, "b"), (5000, "b"), (5000, "b"), (None, "b"), (6000, None)]
    seen = []

    def of(rows, symbols):
        seen.append((rows.count(), symbols.count()))
        return rows.join(symbols, "name").select("ref_id", "symbol_id", F.sum("_many").over(Window.partitionBy("ref_id")).alias("n"))

    found = resolve.once_for_alike(refs, of, symbols=spark.createDataFrame(data, "symbol_id int, name string"))
    want = [(r, s, 3001) for r in range(5) for s in [*range(3000), 4000]] + [(r, s, 4) for r in range(5, 8) for s in (4000, 5000, 5000, None)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert seen == [(2, 1 + 2 + 2 + 1 + 1)]


@pytest.mark.parametrize("counters,held", [(1 << 20, 1 << 19), (2, 0)])
def test_questions_match_as_all_pairs_say(spark, monkeypatch, counters, held):
    """Whatever the order of the words, and however ids are sent; copies, short questions, an id of two questions, none and nulls."""
    monkeypatch.setattr(search, "COUNTERS", counters, raising=False)
    monkeypatch.setattr(search, "HELD", held, raising=False)
    monkeypatch.setattr(search, "LONG", 256 if held else 2, raising=False)
    rng = random.Random(3)
    texts = [" ".join(f"W{rng.randrange(60)}" for _ in range(rng.choice((1, 3, 12, 40)))) for _ in range(60)]
    texts += [f"{rng.choice(texts)} {rng.choice(('', 'extra', 'one two'))}" for _ in range(90)] + ["", "?!", None]
    data = list(enumerate(texts)) + [(200, texts[0]), (200, "a b c d e f g h"), (201, "a b c d e f g H h")]
    words = [(k, frozenset(t.lower().split()) if t and t != "?!" else frozenset()) for k, t in data]
    want = {}
    for k, w in words:
        near = [(-len(w & v) / len(w | v), j) for j, v in words if j < k and w and v and len(w & v) >= 0.85 * len(w | v)]
        if near:
            want.setdefault((k, w), min(near))
    got = search.question_dedup(spark.createDataFrame(data, "id int, question string")).collect()
    assert sorted((r["id"], r["match"], round(r["similarity"], 6)) for r in got) == sorted((k, j, round(-s, 6)) for (k, _), (s, j) in want.items())


def test_words_of_questions_are_not_shuffled(spark):
    """Only the rarest words of a question are dealt; the others are counted in place."""
    asked = ids(spark, 2000, "id", "concat_ws(' ', transform(sequence(1, 100), x -> concat('w', abs(hash(id, x)) % 5000))) AS question")
    assert shuffled(spark, lambda: search.question_dedup(asked))[1] < 2000 * 100 / 4
