"""run() against a brute-force version: each stage's decisions are made again in plain Python on what the stage before kept."""

import collections
import re

import pytest

import corpus_pipeline
from graphlens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=5):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def folder(documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return path


def test_pipeline(spark, folder):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        kept[name] = docs.collect()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    source = spark.read.parquet(f"{folder}/documents.parquet")

    verdict = collections.Counter((r["doc_id"], r["n_words"]) for r in quality.judge(source).where("kept").collect())
    first = kept["quality_rules"]
    assert collections.Counter((r["doc_id"], len(WORD.findall(r["text"]))) for r in first) == verdict and first

    sets = [shingles(r["text"]) for r in first]
    label = list(range(len(first)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(first)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and None not in (first[a]["doc_id"], first[b]["doc_id"]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for k, r in enumerate(first):
        groups[find(k)].append(r["doc_id"])
    second = kept["jaccard_join"]
    assert collections.Counter(r["doc_id"] for r in second) == collections.Counter(min(g) if None not in g else None for g in groups.values())

    size = lambda r: len(WORD.findall(r["text"]))
    third = kept["source_mixing"]
    copies = collections.Counter(tuple(r) for r in third)
    assert set(copies) <= {tuple(r) for r in second} and max(copies.values()) <= 3
    total = sum(map(size, second))
    assert total - 2 * max(map(size, second)) <= sum(map(size, third)) <= total

    last = kept["best_fit_packing"]
    assert collections.Counter(r["doc_id"] for r in last if r["piece"] == 0) == collections.Counter(r["doc_id"] for r in third)
    places = collections.defaultdict(list)
    for r in last:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 4096
    whole = corpus_pipeline.run(spark, folder)
    key = lambda rows: collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(whole.collect()) == key(last)


def test_empty_corpus(spark, tmp_path, no_documents):
    pytest.importorskip("public_tokenizers")
    no_documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
