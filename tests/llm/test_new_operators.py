"""Secret scans, fill-in-the-middle and ranked lexical search against plain versions, on awkward rows and on none."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlens.llm import credentials, fim, lexical, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, n string, form string, term string, spans string, _b string"


def rows_of(frame, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in frame.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(2, 11))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    said = [None, "", " \n", "a", "é", "日本 x日y", "A<b", "it <P> has a mark", "ends <M>", "<", "<S", "one Two\tTHREE 12ab é-É_z", "AKIA" + "Z" * 11, "AKIA" + "Z" * 12, "f" * 31, "f" * 32 + " " + "0" * 40]
    said += ["Password: 'abc' token token: token: abcdefgh12", "API_KEY=abcdefgh apikey:\n12345678 api-key=12345678", "ſecret=longenough1 secret = \"a/b+c.d_e-f=\" PASSWD  =  x.y.z.1.2", "tokentoken=12345678secret:12345678"]
    said += [f"{say(rng.randint(3, 60))} token = \"{hexed(40)}\" {say(9)}" for _ in range(30)]
    said += [f"{say(20)} password={hexed(18)} {say(3)}. AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789') for _ in range(16))}, {say(2)}" for _ in range(30)]
    said += [say(rng.randint(1, 300)) for _ in range(60)] + [say(20_000), "x" * 30_000 + " word", f"{say(5)} {hexed(24)} {say(5)}"]
    return said


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k * 7 % 401, t) for k, t in enumerate(texts)] + [(7, texts[1]), (14, texts[30]), (14, texts[30]), (14, texts[31]), (None, texts[33])]
    return spark.createDataFrame([(*r, "en", None, 1, "r", "n", "f", "t", "s", "b") for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def folder(docs, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    items = [(0, "one two é"), (1, None), (2, "!!"), (3, "zzzz unknown9"), (None, "one"), (5, "x日y TWO two"), (5, "three")]
    spark.createDataFrame(items + [(10 + k, r["text"][:300]) for k, r in enumerate(docs.where("length(text) > 30").orderBy("doc_id", "text").limit(20).collect())], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


# 12


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    said = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(said[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    return (doc_id, len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")))


def test_bits():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        for share in (0.0, 0.02, 0.5, 1.0):
            bits = rng.random(n) < share
            held = fim.Bits(bits)
            assert held.rank(np.arange(n + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
            assert held.select(np.arange(bits.sum() + 3)).tolist() == [*np.flatnonzero(bits).tolist(), n, n, n]


def test_fill_in_the_middle(docs, none):
    made = fim.transform(docs)
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert rows_of(made, *names) == collections.Counter(plain_fim(r["doc_id"], r["text"]) for r in docs.collect())
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("text"))
    assert rows_of(back, "doc_id", "text") == collections.Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert fim.transform(none).count() == 0


# 11


PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def plain_base(text):
    return sorted((m.start(), n, m.end()) for n, (_, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m.group(g)) >= least)


def test_base_spans_and_their_digest(docs, none):
    kinds = [k for k, *_ in PATTERNS]
    got = credentials.scan(docs).collect()
    want = collections.Counter((r["doc_id"], tuple((kinds[n], a, b) for a, n, b in plain_base(r["text"]))) for r in docs.collect())
    assert collections.Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in kinds)) for r in got) == want
    for r in got:
        spans = [(s["start"], s["end"], s["kind"]) for s in r["spans"]]
        assert [s[0] for s in spans] == sorted(s[0] for s in spans)
        base = [s for s in spans if s[2] in kinds]
        assert all(a >= d or c >= b for a, b, k in spans if k not in kinds for c, d, _ in base)
    assert credentials.scan(none).count() == 0
    assert all(r["spans"] == [] for r in credentials.scan(docs.where("text not rlike '[0-9A-Z=:]'")).collect())


def test_what_the_automata_add(docs, texts):
    """The bare credential is found and no ordinary word is; scores agree with a walk through each automaton alone."""
    held = credentials.labelled(docs)
    formats = credentials.Formats(held)
    bare = texts[-1].split()[5]
    words = sorted({w for t in texts[80:] for w in re.findall(r"[A-Za-z0-9+/_-]{8,}", t or "")} - {bare})
    said = pa.array([bare, *words, "1234567812345678", "internationalization"], pa.large_string())
    kinds = formats.kind_of(said)
    assert kinds[0] >= 0 and (kinds[1:] == -1).all()
    own = [k for t in texts for _, n, _, v in credentials.base_spans(t or "") for k in [v] if n == 1 and len(v) == 20]
    assert formats.kinds == ["assign", "access", "hex"] and (formats.kind_of(pa.array(own, pa.large_string())) == 1).all()
    alone = [credentials.Automaton([v for k, v in enumerate(held[kind]) if k % 5]) for kind in formats.kinds] + [credentials.Automaton(held[k]) for k in credentials.ORDINARY]
    for a, scores in zip(said.to_pylist(), formats.scores(said), strict=True):
        assert np.allclose(scores, [x.log_prob(a) for x in alone])
    spans = {(s["kind"], s["start"], s["end"]) for r in credentials.scan(docs.where(F.col("text") == texts[-1]).unionByName(docs.where("text rlike 'password|token'"))).collect() for s in r["spans"] if s["kind"].startswith("format")}
    assert {(a, b) for _, a, b in spans} == {(texts[-1].index(bare), texts[-1].index(bare) + 24)}


def test_automata():
    """States are merged where futures agree: a language's automaton is found, its probabilities sum to at most one."""
    rng = random.Random(5)
    values = ["ab" * (1 + int(-math.log2(1 - rng.random()))) for _ in range(2000)]  # one pair more in half of all cases
    found = credentials.Automaton(values)
    assert len(found.end) <= 4
    assert found.log_prob("ababab") > found.log_prob("aba") + 2 and math.isclose(found.log_prob("abab"), math.log(1 / 4), abs_tol=0.2) and found.log_prob("abab") > found.log_prob("aabb") + 5
    assert np.allclose(np.exp(found.cost).sum(axis=1) + np.exp(found.end), 1)
    nothing = credentials.Automaton([])
    assert math.isclose(nothing.log_prob("a"), 2 * math.log(1 / (len(credentials.SYMBOLS) + 2)))


# 13


def plain_search(rows, items, k=50):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    held = [(i, collections.Counter(terms(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    found = []
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    for i, own in asked.items():
        scored = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        found += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return collections.Counter(found)


@pytest.mark.parametrize(("k", "broadcast_rows"), [(50, 10_000), (3, 0), (1000, 10_000)])
def test_ranked_search(spark, docs, folder, none, k, broadcast_rows):
    items = spark.read.parquet(f"{folder}/benchmark.parquet").withColumn("term", F.lit("x"))
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], k)
    index = lexical.Index(docs)
    assert rows_of(index.search(items, k, broadcast_rows), "item_id", "rank", "doc_id", "score") == want
    one = items.where("item_id = 0")
    assert rows_of(index.search(one, k, broadcast_rows), "item_id", "rank", "doc_id", "score") == collections.Counter({x: n for x, n in want.items() if x[0] == 0})
    assert index.search(items.limit(0), k, broadcast_rows).count() == 0
    assert lexical.Index(none).search(items, k, broadcast_rows).count() == 0


# the registered queries


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_ranked_lexical_search"])
def test_queries_match_their_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        # ids are unique and there, as in the tables: SQL takes rows of one id for one document
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet' where {'doc_id' if t == 'documents' else 'item_id'} is not null" + (" qualify row_number() over (partition by doc_id order by text) = 1" if t == "documents" else ""))
        spark.createDataFrame(con.sql(f"select * from {t}").arrow().read_all() if hasattr(con.sql("select 1").arrow(), "read_all") else con.sql(f"select * from {t}").arrow()).write.mode("overwrite").parquet(f"{folder}/unique/{t}.parquet")
    got, want = queries.QUERIES[name](spark, f"{folder}/unique"), con.sql(queries.ORACLES[name])
    assert got.count() > 0
    assert rows_of(got, *want.columns) == collections.Counter(want.fetchall())


def test_secret_query(spark, folder, docs):
    got = queries.QUERIES["op11_secret_scans"](spark, folder)
    kinds = [k for k, *_ in PATTERNS]
    want = collections.Counter()
    for r in docs.collect():
        spans = plain_base(r["text"])
        want[(r["doc_id"], *(sum(n == k for _, n, _ in spans) for k in range(3)), hashlib.sha256(",".join(f"{kinds[n]}:{a}:{b}" for a, n, b in spans).encode()).hexdigest())] += 1
    assert rows_of(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    assert any("format_" in r["spans"] for r in got.collect()) and dict(got.dtypes) == {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
