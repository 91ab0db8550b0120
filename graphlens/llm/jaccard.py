"""N-gram Jaccard join of whole documents, with rare-first prefix filtering.

A document's set is its distinct word n-grams (a shorter document: all its words as one). Sets are ordered by one order
of all n-grams, rare ones first; two sets with Jaccard similarity t share an n-gram among the first
``n - ceil(t n) + 1`` of each. Documents meet in the lists of these prefix n-grams.

* Rarity comes from counts of n-gram hashes in 2^20 counters over all documents: a table of fixed size, which is
  broadcast. Any fixed order is right; this one puts shared passages last.
* Equal sets are one class, so copies of a text cost nothing beyond their scan.
* Filters on a pair: length (the smaller set has at least t times the larger one's size), position (what can still be
  shared from the common n-gram on), and suffix (a lower bound of the sets' Hamming distance: the number of odd bits in
  the difference of two 512-bit parity sketches never exceeds it). The sketches stay in the table of classes and are
  joined to distinct pairs; the lists carry 64-bit names only.
* Components without all pairs: in each list, pairs along chains, in salted sub-lists, are candidates. Of these, each
  class's likeliest partner is verified first, then those whose components still differ. Then all pairs that share a
  list and lie in different components are candidates, less those already verified. So a group of n near copies costs
  about n pairs, and still no link between components is lost.
* Every link lies within a component. ``links=True`` also counts them: a component's sets are dealt into blocks, and each
  two blocks of a component are multiplied as 0/1 matrices, so all its pairs are verified and none is written.

N-grams and classes are compared by 64-bit hashes of their words (classes by 128 bits where rows are told apart).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm import common
from graphlens.llm.components import connected_components

BUCKET_BITS, CHUNK_BITS, SUB_LIST, CHAIN, SEEN, SKETCH = 20, 12, 128, 3, 200_000, 8
BLOCK, BLOCK_GRAMS, FEATURES = 256, 1 << 20, 4096
_SKETCH = [f"s{k}" for k in range(1, SKETCH + 1)]
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The set of each text: sorted 64-bit hashes of its distinct word n-grams, lower-cased A-Z."""
    offsets, codes, distinct = common.tokenize(texts)
    words = common.hash64(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        rolled = rolled * _A + words[k : k + len(rolled)]
    rolled = _mixed(rolled * _A + np.uint64(n))
    sets = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - start >= n:
            sets.append(np.unique(rolled[start : end - n + 1]))
        elif end > start:
            one = np.zeros(1, np.uint64)
            for w in words[start:end]:
                one = one * _A + w
            sets.append(_mixed(one * _A + np.uint64(end - start)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _class(own: np.ndarray) -> tuple[int, int]:
    import xxhash

    high, low = divmod(xxhash.xxh3_128_intdigest(own.tobytes()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


def _sketch(own: np.ndarray) -> np.ndarray:
    """The parity of the number of n-grams that fall on each bit."""
    bits = 64 * SKETCH
    odd = np.bincount((own >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: a document's class, size and sketch; and a chunk of a task's n-gram counters, packed."""

    def run(batches):
        mask, counts, seen = np.uint64((1 << BUCKET_BITS) - 1), np.zeros(1 << BUCKET_BITS, np.uint32), set()
        for batch in common.slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), n)
            keys = [_class(x) if len(x) else (None, None) for x in sets]
            fresh = []
            for x, key in zip(sets, keys, strict=True):
                if len(x) and key not in seen:
                    fresh.append(x)
                    seen.add(key)
            if len(seen) > SEEN:
                seen.clear()
            if fresh:
                counts += np.bincount((np.concatenate(fresh) & mask).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            sketches = np.array([_sketch(x) for x in sets]).reshape(-1, SKETCH)
            yield [pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()), batch.column("id"), batch.column("t"), [len(x) for x in sets], [a for a, _ in keys], [b for _, b in keys], *(sketches[:, k] for k in range(SKETCH))]
        chunks = counts.reshape(-1, 1 << CHUNK_BITS)
        full = np.flatnonzero(chunks.any(axis=1))
        none = pa.nulls(len(full), pa.int64())
        yield [full, [zlib.compress(chunks[k].tobytes(), 1) for k in full], *[none] * (5 + SKETCH)]

    return common.mapped(docs, run, "chunk int, counts binary, id long, t long, n long, k1 long, k2 long, " + ", ".join(f"{s} long" for s in _SKETCH))


def _rarity(profile: DataFrame) -> np.ndarray:
    """Ranks of the counters by their sums, in 16 bits, in steps of a sixteenth of an octave."""

    def summed(table):
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in table["counts"].to_pylist())
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "order": pa.array([np.round(16 * np.log2(total + 1)).astype(np.uint16).tobytes()])})

    order = np.zeros((1 << BUCKET_BITS >> CHUNK_BITS, 1 << CHUNK_BITS), np.uint16)
    for row in profile.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(summed, "chunk int, order binary").collect():  # 256 rows at most
        order[row["chunk"]] = np.frombuffer(row["order"], np.uint16)
    return order.ravel()


def _postings(docs: DataFrame, n: int, num: int, den: int, order) -> DataFrame:
    """(g, cid, n, pos): the prefix n-grams of every class in a task, with their places."""

    def run(batches):
        rank, mask, seen = order.value, np.uint64((1 << BUCKET_BITS) - 1), set()
        for batch in common.slices(batches, "text"):
            out: list[list] = [[], [], [], []]
            for own in shingle_sets(batch.column("text"), n):
                if not len(own):
                    continue
                key = _class(own)
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                size = len(own)
                prefix = size - -(-num * size // den) + 1
                # own is sorted by hash, and the sort is stable: (rarity, hash)
                first = own[np.argsort(rank[(own & mask).astype(np.int64)], kind="stable")[:prefix]]
                for column, value in zip(out, (first.view(np.int64), np.full(prefix, key[0]), np.full(prefix, size), np.arange(prefix)), strict=True):
                    column.append(value)
            yield [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]

    return common.mapped(docs, run, "g long, cid long, n int, pos int")


def _need(both: Column, num: int, den: int) -> Column:
    """What two sets must share, from the sum of their sizes."""
    return F.ceil(F.lit(num) * both / F.lit(num + den))


def _possible(x: str, y: str, num: int, den: int) -> Column:
    """Length and positional filter of rows x and y of one list."""
    c = lambda side, name: F.col(f"{side}.{name}")
    length = F.least(c(x, "n"), c(y, "n")) * den >= F.greatest(c(x, "n"), c(y, "n")) * num
    place = F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos")) >= _need(c(x, "n") + c(y, "n"), num, den)
    return length & place


def _odd(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in _SKETCH), F.lit(0))


def _near(x: str, y: str, num: int, den: int) -> Column:
    """Suffix filter."""
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    return _odd(x, y) <= both - 2 * _need(both, num, den)


def _verified(pairs: DataFrame, classes: DataFrame, whole: DataFrame, n: int, num: int, den: int, repeated: bool) -> DataFrame:
    """The pairs (a, b) of classes whose texts' sets have Jaccard similarity num/den or more, as a table."""
    named = common.materialize(pairs.join(classes.select(F.col("cid").alias("a"), F.col("id").alias("ia")), "a").join(classes.select(F.col("cid").alias("b"), F.col("id").alias("ib")), "b"))
    asked = named.select(F.col("ia").alias("id")).union(named.select("ib")).distinct()
    texts = whole.join(asked, "id", "left_semi")
    texts = common.materialize(texts.dropDuplicates(["id", "t"]) if repeated else texts)
    left, right = (texts.select(F.col("id").alias(f"i{c}"), F.col("text").alias(f"t{c}")) for c in "ab")

    def run(batches):
        for batch in common.slices(common.slices(batches, "ta"), "tb"):
            keep = []
            # a doc_id can have several texts: the class says which one is meant
            for x, y, a, b in zip(shingle_sets(batch.column("ta"), n), shingle_sets(batch.column("tb"), n), batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * shared >= num * (len(x) + len(y) - shared) and _class(x)[0] == a and _class(y)[0] == b)
            yield [batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))]

    found = common.materialize(common.mapped(named.join(left, "ia").join(right, "ib"), run, "a long, b long").distinct())
    common.release(named, texts)
    return found


def _chains(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs along each list: in sub-lists of about ``SUB_LIST`` rows, and along the sub-lists' first rows."""
    salted = lists.withColumn("_subs", F.ceil(F.col("size") / F.lit(SUB_LIST))).withColumn("_sub", F.pmod(F.xxhash64("cid"), F.col("_subs")))
    fields = F.struct("cid", "n", "pos")

    def linked(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("n", "cid")
        near = rows.withColumn("_y", F.array(*[F.lag(fields, k).over(w) for k in range(1, CHAIN + 1)])).select(fields.alias("x"), F.explode("_y").alias("y"))
        return near.where(F.col("y").isNotNull() & _possible("x", "y", num, den)).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))

    first = salted.where("_subs > 1").withColumn("_k", F.row_number().over(Window.partitionBy("g", "_sub").orderBy("n", "cid"))).where("_k = 1")
    return linked(salted, ["g", "_sub"]).union(linked(first, ["g"])).distinct()


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose components differ."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


@dataclass
class _Found:
    """Tables: a row per document; the classes; the components of those that link; links between them (a spanning part)."""

    own: DataFrame
    classes: DataFrame
    labels: DataFrame
    whole: DataFrame
    repeated: bool


def _classes_and_components(docs: DataFrame, n: int, num: int, den: int, hold: bool) -> _Found:
    """``hold``: rows of one doc_id with unlike texts hold their classes together."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))
    profile = common.materialize(_profile(whole, n))
    order = spark.sparkContext.broadcast(_rarity(profile))
    own = profile.where("chunk is null").select("id", "t", "n", "k1", "k2")
    classes = profile.where("chunk is null and id is not null and k1 is not null").groupBy(F.col("k1").alias("cid"), "k2", F.col("n").cast("int").alias("n")).agg(F.min("id").alias("id"), *[F.min(s).alias(s) for s in _SKETCH])
    classes = common.materialize(classes)
    rows, ids = own.where("id is not null").agg(F.count("*"), F.count_distinct("id")).first()
    repeated = rows > ids

    posted = common.materialize(_postings(whole.where("id is not null"), n, num, den, order).distinct())
    sizes = posted.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    lists = common.materialize(posted.join(sizes, "g"))
    common.release(posted)

    pairs = common.materialize(_chains(lists, num, den))
    tried = pairs.join(classes.alias("x"), F.col("a") == F.col("x.cid")).join(classes.alias("y"), F.col("b") == F.col("y.cid")).where(_near("x", "y", num, den)).select("a", "b", _odd("x", "y").alias("odd"))
    tried = common.materialize(tried)
    common.release(pairs)
    either = tried.select("a", "b", "odd").union(tried.select("b", "a", "odd"))
    best = common.materialize(either.groupBy("a").agg(F.min(F.struct("odd", "b")).alias("_b")).select(F.least("a", "_b.b").alias("a"), F.greatest("a", "_b.b").alias("b")).distinct())
    links = _verified(best, classes, whole, n, num, den, repeated)
    labels = common.materialize(connected_components(links))
    # the other candidates along chains, where their components still differ
    other = common.materialize(_across(tried.select("a", "b").join(best, ["a", "b"], "left_anti"), labels))
    common.release(tried)
    if not other.isEmpty():
        more = _verified(other, classes, whole, n, num, den, repeated)
        links = common.materialize(links.union(more))
        labels = common.materialize(connected_components(links))

    named = lists.join(labels, F.col("cid") == labels["id"], "left").select("g", "n", "pos", "cid", F.coalesce("component", "cid").alias("c"))
    named = common.materialize(named)
    mixed = named.groupBy("g").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).where("_low < _high").select("g")
    apart = common.materialize(named.join(mixed, "g").join(classes.select("cid", *_SKETCH), "cid"))
    common.release(lists, named)
    able = apart.alias("x").join(apart.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.c") != F.col("y.c")) & _possible("x", "y", num, den) & _near("x", "y", num, den))
    rest = common.materialize(able.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct().join(best.union(other), ["a", "b"], "left_anti"))
    common.release(apart, best, other)
    joining = _verified(rest, classes, whole, n, num, den, repeated)
    if hold and repeated:
        member = own.where("k1 is not null and id is not null").select("id", F.col("k1").alias("b")).distinct()
        held = member.join(member.groupBy("id").agg(F.min("b").alias("a")), "id").where("a <> b").select("a", "b")
        joining = common.materialize(joining.union(held))
    if not joining.isEmpty():
        every = connected_components(links.union(joining))
        labels = common.materialize(every)
    common.release(links, rest)
    return _Found(own, classes, labels.select(F.col("id").alias("cid"), "component"), whole, repeated)


def _linked(counts: np.ndarray, sizes_x: np.ndarray, sizes_y: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * counts >= num * (sizes_x[:, None] + sizes_y[None, :] - counts)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets share, as a product of 0/1 matrices, some n-grams at a time."""
    sizes = [len(x) for x in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    code = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[code]
    owner, code = owner[code >= 0], code[code >= 0]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, FEATURES):
        a, b = np.searchsorted(code, [at, at + FEATURES])
        part = np.zeros((len(sets), FEATURES), np.float32)
        part[owner[a:b], code[a:b] - at] = 1
        total += part @ part.T
    np.fill_diagonal(total, sizes)
    return np.round(total).astype(np.int64)


def _link_numbers(found: _Found, n: int, num: int, den: int) -> DataFrame:
    """(cid, n_links): the number of other classes that each class of a component links with."""
    member = found.labels.join(found.classes.select("cid", "id", "n"), "cid")
    blocks = member.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_GRAMS))).alias("_blocks"))
    dealt = common.materialize(member.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("_blocks"))))
    texts = found.whole.join(dealt.select("id").distinct(), "id", "left_semi")
    texts = texts.dropDuplicates(["id", "t"]) if found.repeated else texts
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_o")
    keyed = texts.join(dealt, "id").select("component", "cid", "own", "text", other).select("component", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "cid", "own", "text")

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        cid, own, sets = table["cid"].to_numpy(), table["own"].to_numpy(), shingle_sets(table["text"].combine_chunks(), n)
        right = np.flatnonzero([len(x) > 0 and _class(x)[0] == c for x, c in zip(sets, cid, strict=True)])
        cid, own, sets = cid[right], own[right], [sets[k] for k in right]
        if not sets:
            return pa.table({"cid": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
        sizes = np.array([len(x) for x in sets])
        linked = _linked(shared_counts(sets), sizes, sizes, num, den)
        np.fill_diagonal(linked, False)
        if i != j:  # pairs within a block have a key of their own
            linked &= own[:, None] != own[None, :]
        return pa.table({"cid": cid, "n_links": linked.sum(axis=1)})

    return keyed.groupBy("component", "i", "j").applyInArrow(run, "cid long, n_links long").groupBy("cid").agg(F.sum("n_links").alias("n_links"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text; other columns are ignored); with
    ``links`` also class_id, the smallest doc_id with the same set, and n_links, the number of other sets that it links
    with.

    Documents link when ``den * shared >= num * union``. component_id is the smallest doc_id reachable by links. A null
    or wordless text has an empty set, links with nothing and is its own component. Rows of one doc_id with unlike texts
    link the components of both. A row without doc_id has n_shingles and no component. An empty table gives no rows.
    """
    found = _classes_and_components(docs, n, num, den, hold=True)
    known = found.classes.join(found.labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = known.groupBy("component").agg(F.min("id").alias("component_id"))
    known = known.join(least, "component").select(F.col("cid").alias("k1"), "k2", F.col("n").cast("long").alias("n"), "component_id", F.col("id").alias("class_id"))
    if links:
        known = known.join(_link_numbers(found, n, num, den), F.col("k1") == F.col("cid"), "left").drop("cid")
    o, k = found.own.alias("o"), known.alias("k")
    joined = o.join(k, (F.col("o.k1") == F.col("k.k1")) & (F.col("o.k2") == F.col("k.k2")) & (F.col("o.n") == F.col("k.n")), "left")
    own = lambda c: F.when(F.col("o.id").isNotNull(), c)
    more = [own(F.coalesce("class_id", "o.id")).alias("class_id"), own(F.coalesce("n_links", F.lit(0))).alias("n_links")] if links else []
    whole = joined.select(F.col("o.id").alias("doc_id"), F.col("o.n").alias("n_shingles"), own(F.coalesce("component_id", "o.id")).alias("component_id"), *more)
    return _least_of_repeated(whole) if found.repeated else whole


def _least_of_repeated(rows: DataFrame) -> DataFrame:
    """Rows of one doc_id, one of which has no words: the smallest component that any of them has."""
    least = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("component_id").alias("_least"))
    return rows.join(least, F.col("doc_id") == F.col("_id"), "left").withColumn("component_id", F.col("_least")).drop("_id", "_least")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest doc_id, once.

    Unlike texts of one doc_id are documents of their own. Of rows that agree in doc_id and text, that with the smallest
    hash of all its columns stays; of one component's texts of one doc_id, that with the smallest hash. Rows without
    doc_id stay. Documents without words link with nothing and stay.
    """
    found = _classes_and_components(docs, n, num, den, hold=False)
    labelled = found.own.where("id is not null").join(found.labels, F.col("k1") == F.col("cid"), "left").withColumn("_c", F.coalesce("component", "k1"))
    first = labelled.where("k1 is not null").groupBy("_c").agg(F.min(F.struct("id", "t")).alias("_f")).select("_f.*")
    kept = first.union(labelled.where("k1 is null").select("id", "t").distinct())
    name = common.unused(docs)
    kept = kept.select(F.col("id").alias(name("id")), F.col("t").alias(name("t")))
    stay = docs.join(kept, (F.col("doc_id").cast("long") == F.col(name("id"))) & (F.xxhash64(F.col("text").cast("string")) == F.col(name("t"))), "left_semi")
    if found.repeated:
        w = Window.partitionBy("doc_id", F.xxhash64(F.col("text").cast("string"))).orderBy(F.xxhash64(*docs.columns))
        stay = stay.withColumn(name("k"), F.row_number().over(w)).where(F.col(name("k")) == 1).drop(name("k"))
    return stay.unionByName(docs.where("doc_id is null"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"), 3, 90, 100, links=True)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS g FROM d
), h AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), chr(10))) END AS c, g FROM s),
k AS (SELECT c, min(doc_id) AS class_id, any_value(n) AS n, any_value(g) AS g FROM h WHERE c IS NOT NULL GROUP BY c),
u AS (SELECT class_id, n, md5(unnest(g)) AS x FROM k),
pairs AS (
  SELECT a, b FROM (SELECT x.class_id AS a, y.class_id AS b, x.n AS n, y.n AS m, count(*) AS i FROM u x JOIN u y ON x.x = y.x AND x.class_id < y.class_id GROUP BY ALL)
  WHERE 100 * i >= 90 * (n + m - i)
), e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r AS (SELECT class_id AS a, class_id AS root FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a WHERE r.root < e.b),
comp AS (SELECT a AS class_id, min(root) AS component_id FROM r GROUP BY a)
SELECT h.doc_id, h.n AS n_shingles, coalesce(comp.component_id, h.doc_id) AS component_id, coalesce(k.class_id, h.doc_id) AS class_id, coalesce(l.n_links, 0) AS n_links
FROM h LEFT JOIN k USING (c) LEFT JOIN comp ON comp.class_id = k.class_id LEFT JOIN (SELECT a, count(*) AS n_links FROM e GROUP BY a) l ON l.a = k.class_id
"""
