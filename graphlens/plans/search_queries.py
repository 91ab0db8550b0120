"""BM25, fuzzy names, recall and question dedup. ``documents`` are the corpus, ``benchmark`` texts the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import text as T
from graphlens.operators import search
from graphlens.plans.registry import query
from graphlens.plans.text_queries import WORDS, sql_stem, sql_terms
from graphlens.session import cut


def _bm25_sql(corpus: str, coverage: bool) -> str:
    cover = "least(1, mass / total) * least(1, mass / total)" if coverage else "1"
    return f"""
WITH post AS (SELECT doc_id, {corpus} AS corpus, term, tf FROM {sql_terms("doc_id", "text", "documents")} JOIN (SELECT doc_id AS d, lang FROM documents) ON doc_id = d),
len AS (SELECT doc_id, corpus, sum(tf) AS dl FROM post GROUP BY ALL),
stats AS (SELECT corpus, count(*) AS n, sum(dl) / count(*) AS avg_len FROM len GROUP BY corpus),
q AS (SELECT DISTINCT item_id, term FROM {sql_terms("item_id", "text", "benchmark")}),
idf AS (SELECT corpus, term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(avg_len) AS avg_len FROM post JOIN stats USING (corpus) GROUP BY corpus, term, n),
tot AS (SELECT item_id, corpus, sum(idf) AS total FROM q JOIN idf USING (term) GROUP BY ALL),
s AS (SELECT item_id, corpus, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS s, count(*) AS matched, sum(idf) AS mass
  FROM q JOIN idf USING (term) JOIN post USING (corpus, term) JOIN len USING (doc_id, corpus) GROUP BY ALL),
r AS (SELECT *, round(s * {cover}, 6) AS score FROM s JOIN tot USING (item_id, corpus)),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score, matched FROM k WHERE rank <= 10
"""


def _bm25(t, corpus, coverage: bool):
    docs = t.documents.select("doc_id", "text", "lang")
    # the postings are an index: built once, as a table, and read by statistics and scores alike
    posted = cut(search.postings(docs, "doc_id", "text", corpus=corpus))
    asked = cut(T.query_terms(t.benchmark, ["item_id"], "text", None).withColumnRenamed("item_id", "query_id"))
    scored = search.bm25(posted, "doc_id", asked, coverage=coverage).withColumn("score", F.round("score", 6))
    return search.top_with_ties(scored, ["query_id"], "score", ["doc_id"], 10).select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score", "matched")


@query("bm25_topk", _bm25_sql("'all'", False))
def bm25_topk(t):
    return _bm25(t, None, False)


@query("bm25_coverage", _bm25_sql("'all'", True))
def bm25_coverage(t):
    return _bm25(t, None, True)


@query("bm25_two_corpora", _bm25_sql("lang", True))
def bm25_two_corpora(t):
    return _bm25(t, F.col("lang"), True)


#: Parts are declarations with a name in camel case; queries are the words of names and whole names.
NAMED = "(SELECT p_partkey, p_type AS text, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') AS name FROM part)"
NAMES_SQL = f"""
WITH d AS {NAMED}, qs AS (SELECT unnest(string_split(p_name, ' ')) AS query FROM part UNION SELECT name FROM d),
post AS (SELECT p_partkey, term, sum(tf) AS tf FROM (FROM {sql_terms("p_partkey", "text", "d")} UNION ALL FROM {sql_terms("p_partkey", "name", "d", 3.0)}) GROUP BY ALL),
len AS (SELECT p_partkey, sum(tf) AS dl FROM post GROUP BY ALL), stats AS (SELECT count(*) AS n, sum(dl) / count(*) AS avg_len FROM len),
q AS (SELECT query, unnest(list_sort(list(DISTINCT term))[1:32]) AS term FROM {sql_terms("query", "query", "qs")} GROUP BY query),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(avg_len) AS avg_len FROM post, stats GROUP BY term, n),
tot AS (SELECT query, sum(idf) AS total FROM q JOIN idf USING (term) GROUP BY ALL),
s AS (SELECT query, p_partkey, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS s, count(*) AS matched, sum(idf) AS mass FROM q JOIN idf USING (term) JOIN post USING (term) JOIN len USING (p_partkey) GROUP BY ALL),
own AS (SELECT query, p_partkey, idf FROM d JOIN q ON {sql_stem("lower(d.name)")} = q.term JOIN idf ON idf.term = q.term),
r AS (SELECT s.query, s.p_partkey, matched, round(s * least(1, mass / total) * least(1, mass / total) + coalesce(own.idf, 0) + CASE WHEN lower(d.name) = lower(s.query) THEN 1000 ELSE 0 END, 6) AS score
  FROM s JOIN tot USING (query) JOIN d USING (p_partkey) LEFT JOIN own ON own.query = s.query AND own.p_partkey = s.p_partkey)
SELECT query, CAST(rank AS INTEGER) AS rank, p_partkey, score, matched FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, p_partkey) AS rank FROM r) WHERE rank <= 10
"""


@query("bm25_names", NAMES_SQL)
def bm25_names(t):
    """Names count three times; a query word that is a whole name adds its idf, a query that is one adds 1000."""
    name = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")
    docs = t.part.select("p_partkey", F.col("p_type").alias("text"), name.alias("name"))
    posted = cut(search.postings(docs, "p_partkey", "text", "name"))
    texts = t.part.select(F.explode(F.split("p_name", " ")).alias("query")).union(docs.select("name")).distinct().withColumn("query_id", F.col("query"))
    asked = T.query_terms(texts, ["query_id"], "query").withColumn("query", F.col("query_id"))
    scored = search.bm25(posted, "p_partkey", cut(asked), docs).withColumn("score", F.round("score", 6))
    return search.top_with_ties(scored, ["query_id"], "score", ["p_partkey"], 10).select(F.col("query_id").alias("query"), "rank", "p_partkey", "score", "matched")


FUZZY_Q = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS query FROM part"
NEAR_Q = "SELECT DISTINCT substr(p_name, 1, 3) || 'zq' || substr(p_name, 5) AS query FROM part"
GRAMS = "list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))"


@query("fuzzy_substring", f"""SELECT query, name FROM (SELECT query, name, row_number() OVER (PARTITION BY query ORDER BY name) AS k
  FROM ({FUZZY_Q}) JOIN (SELECT DISTINCT p_name AS name FROM part) ON contains(lower(name), lower(trim(query)))) WHERE k <= 25""")
def fuzzy_substring(t):
    asked = t.part.select(F.explode(F.split("p_name", " ")).alias("query")).distinct()
    return search.fuzzy(t.part.select(F.col("p_name").alias("name")), asked).where("how = 'contains'").select("query", "name")


@query("fuzzy_didyoumean", f"""WITH q AS (SELECT query, lower(trim(query)) AS q FROM ({NEAR_Q})), n AS (SELECT DISTINCT p_name AS name, lower(p_name) AS low FROM part),
  g AS (SELECT query, q, len({GRAMS.format("q")}) AS n, unnest({GRAMS.format("q")}) AS gram FROM q), ng AS (SELECT name, low, unnest({GRAMS.format("low")}) AS gram FROM n),
  s AS (SELECT query, q, n, name, low, count(*) AS c FROM g JOIN ng USING (gram) GROUP BY ALL),
  d AS (SELECT query, name, levenshtein(q, low) AS d, q FROM s WHERE c * 3 >= n AND NOT EXISTS (SELECT 1 FROM n WHERE contains(n.low, s.q)))
  SELECT query, name, CAST(d AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, name) AS k FROM d WHERE d <= greatest(1, strlen(q) // 2)) WHERE k <= 5""")
def fuzzy_didyoumean(t):
    asked = t.part.select(F.expr("substr(p_name, 1, 3) || 'zq' || substr(p_name, 5)").alias("query")).distinct()
    return search.fuzzy(t.part.select(F.col("p_name").alias("name")), asked).where("how = 'near'").select("query", "name", "distance")


def _counts(k: str, text: str, table: str) -> str:
    return f"(SELECT {k}, term, count(*) AS c FROM (SELECT {k}, unnest({WORDS.format(f'lower({text})')}) AS term FROM {table}) GROUP BY ALL)"


@query("recall_score", f"""WITH d AS {_counts("doc_id", "text", "documents")}, q AS {_counts("item_id", "text", "benchmark")},
  o AS (SELECT item_id, doc_id, sum(least(d.c, q.c)) AS o FROM d JOIN q USING (term) GROUP BY ALL), dl AS (SELECT doc_id, sum(c) AS dl FROM d GROUP BY 1), ql AS (SELECT item_id, sum(c) AS ql FROM q GROUP BY 1),
  s AS (SELECT o.item_id, o.doc_id, o / sqrt(dl * ql) * CASE WHEN contains(lower(documents.text), lower(benchmark.text)) THEN 1.5 ELSE 1 END AS s
    FROM o JOIN dl USING (doc_id) JOIN ql USING (item_id) JOIN documents ON documents.doc_id = o.doc_id JOIN benchmark ON benchmark.item_id = o.item_id)
  SELECT item_id, doc_id, round(s, 6) AS score FROM s WHERE s >= 0.05""")
def recall_score(t):
    found = search.recall(t.documents.select("doc_id", "text"), "doc_id", "text", t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
    return found.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"))


@query("jaccard_dedup", f"""WITH s AS (SELECT doc_id AS id, list_distinct({WORDS.format("lower(text)")}) AS w FROM documents),
  p AS (SELECT a.id, b.id AS match, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM s a JOIN s b ON b.id < a.id AND len(b.w) >= 0.85 * len(a.w) AND len(a.w) >= 0.85 * len(b.w) WHERE len(a.w) > 0 AND len(b.w) > 0),
  j AS (SELECT id, match, i / (n - i) AS sim FROM p WHERE i >= 0.85 * (n - i))
  SELECT id, match, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, match) AS k FROM j) WHERE k = 1""")
def jaccard_dedup(t):
    """Documents stand for questions."""
    return search.question_dedup(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("question"))).select("id", "match", F.round("similarity", 6).alias("similarity"))


@query("budget_prefix", """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, sum(length(o_orderpriority) * 10) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM orders) WHERE run <= 400""")
def budget_prefix(t):
    return search.prefix_within(t.orders, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], F.length("o_orderpriority") * 10, 400).select("o_custkey", "o_orderkey")
