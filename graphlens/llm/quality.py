"""Quality rules: counts and repetition first, then the perplexity of a modified Kneser-Ney model.

The model's n-grams are characters; their context runs on over one word border: a word follows the last ``n - 2``
characters of the word before it (filled up with start marks) and an end mark, the first word of a document follows
start marks. So the order of words counts. A text is a bag of two kinds of unit: distinct words (their n-grams inside)
and distinct borders (the end of one word with the head of the next); n-grams are counted and looked up once per
distinct unit of a batch.

Spark counts the n-grams of the highest order over all documents, and from each order the continuation counts of the
next (n-grams that begin with a start mark keep their own counts). Discounts come from the counts of counts of each
order. Every document is counted, so every n-gram of a document has a probability: ``priced`` gives it by joins of the
counted tables, order by order, nothing pruned. The ``ENTRIES`` most frequent n-grams are broadcast as sorted arrays of
64-bit hashes with their costs (16 bytes an entry), and looked up by binary search; what is not among them gets its cost
from a join on the hash, of one row per document and n-gram. So ``ENTRIES`` sets what is joined, not the result.

A document's measure is the mean bits per character. Its bands are language-specific: around the median of the language,
``WIDTH`` robust deviations to either side, where a deviation has a part between documents and one that falls with the
document's length. A language's deviation is drawn towards that of all languages' documents, each around its own median, with the
weight of ``PRIOR_DOCS`` documents; its median is its own at every size. No language uses the bands of all together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm import common

N, ENTRIES, PRIOR_DOCS, WIDTH, HELD = 5, 1 << 19, 50, 6.0, 1 << 19
START, STOP = "\x02", "\x03"
_MULT = np.uint64(0x9E3779B97F4A7C15)


# --- counting ---


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, count) over all words of ``text``, A-Z in lower case."""

    def run(batches):
        for batch in common.slices(batches, "text", 8 << 20):
            _, codes, distinct = common.tokenize(batch.column("text"))
            if len(distinct):
                counts = np.bincount(codes, minlength=len(distinct))
                full = pa.array(counts > 0)
                yield [distinct.filter(full).cast(pa.string()), counts[counts > 0]]

    return common.mapped(texts, run, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def units(distinct: pa.Array, codes: np.ndarray, first: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """The units of a batch as an array of strings, all of whose windows of ``n`` characters are n-grams: the distinct words with
    their end mark, then the distinct borders. And the number of each token's border among the units. ``codes``: the
    words of all texts in a row; ``first``: whether one is its text's first."""
    import pyarrow.compute as pc

    kind = pa.large_string()
    words = distinct.cast(kind)
    said = pc.binary_join_element_wise(words, pa.scalar(STOP, kind), pa.scalar("", kind))
    heads = pc.utf8_slice_codeunits(said, 0, n - 1).dictionary_encode()
    ends = pc.utf8_slice_codeunits(pc.binary_join_element_wise(pa.scalar(START * (n - 2), kind), words, pa.scalar("", kind)), -(n - 2)) if n > 2 else pc.utf8_slice_codeunits(words, 0, 0)
    tails = pc.binary_join_element_wise(ends, pa.scalar(STOP, kind), pa.scalar("", kind)).dictionary_encode()
    if not len(codes):
        return said.slice(0, 0), np.zeros(0, np.int64)
    head, tail = np.asarray(heads.indices, np.int64)[codes], np.asarray(tails.indices, np.int64)[codes]
    before = np.where(first, len(tails.dictionary), np.concatenate([[0], tail[:-1]]))
    pairs, border = np.unique(before * len(heads.dictionary) + head, return_inverse=True)
    contexts = pa.concat_arrays([tails.dictionary, pa.array([START * (n - 1)], kind)])
    borders = pc.binary_join_element_wise(contexts.take(pa.array(pairs // len(heads.dictionary))), heads.dictionary.take(pa.array(pairs % len(heads.dictionary))), pa.scalar("", kind))
    return pa.concat_arrays([said, borders]), border + len(distinct)


def _firsts(offsets: np.ndarray) -> np.ndarray:
    """Whether a token is its text's first, from the offsets of all texts."""
    first = np.zeros(offsets[-1] + 1, bool)
    first[offsets[:-1]] = True
    return first[:-1]


def _windows(said: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All code points of an array of large strings in a row, the hash of the n-gram that ends at each, whether it lies
    within one string, and where each string ends."""
    import pyarrow.compute as pc

    offsets = np.frombuffer(said.buffers()[1], np.int64)[said.offset : said.offset + len(said) + 1] if len(said) else np.zeros(2, np.int64)
    data = memoryview(said.buffers()[2])[offsets[0] : offsets[-1]] if len(said) else b""
    codes = np.frombuffer(str(data, "utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(np.asarray(pc.utf8_length(said), np.int64))
    place = np.arange(len(codes)) - np.repeat(ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0))
    return codes, gram_hashes(codes, n), place >= n - 1, ends


def gram_counts(texts: DataFrame, n: int = N) -> DataFrame:
    """(gram, count) of the highest order over all words of ``text``, A-Z in lower case."""

    def counted(texts: pa.Array) -> pa.Table | None:
        offsets, codes, distinct = common.tokenize(texts)
        said, border = units(distinct, codes, _firsts(offsets), n)
        if not len(said):
            return None
        times = np.bincount(np.concatenate([codes, border]), minlength=len(said))
        points, hashes, real, ends = _windows(said, n)
        times = np.repeat(times, np.diff(ends, prepend=0))
        at = np.flatnonzero(real & (times > 0))
        _, sample, code = np.unique(hashes[at], return_index=True, return_inverse=True)
        sums = np.bincount(code, times[at], len(sample)).astype(np.int64)
        spelt = points[at[sample][:, None] + np.arange(1 - n, 1)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return pa.table({"gram": pa.array([spelt[k : k + n] for k in range(0, len(spelt), n)], pa.string()), "count": sums})

    def run(batches):
        held: list[pa.Table] = []
        for batch in common.slices(batches, "text", 2 << 20):
            if (found := counted(batch.column("text"))) is not None:
                held.append(found)
            if sum(map(len, held)) > HELD:
                held = [pa.concat_tables(held).group_by("gram").aggregate([("count", "sum")]).rename_columns(["gram", "count"])]
                if len(held[0]) > HELD // 2:
                    yield [held[0]["gram"].combine_chunks(), held[0]["count"].combine_chunks()]
                    held = []
        if held:
            last = pa.concat_tables(held).group_by("gram").aggregate([("count", "sum")])
            yield [last["gram"].combine_chunks(), last["count_sum"].combine_chunks()]

    return common.mapped(texts, run, "gram string, count long").groupBy("gram").agg(F.sum("count").alias("count"))


def orders(top: DataFrame, n: int = N) -> list[DataFrame]:
    """Tables (gram, count) of orders 1 to ``n``; below the highest, counts are those of distinct characters before the
    gram, but for grams at a word's start."""
    tables = [top]
    for _ in range(n - 1):
        above = tables[0]
        suffix = F.expr("substring(gram, 2)")
        counted = above.groupBy(suffix.alias("gram")).agg(F.sum("count").alias("_c"), F.count("*").alias("_n"))
        tables.insert(0, common.materialize(counted.select("gram", F.when(F.col("gram").startswith(START), F.col("_c")).otherwise(F.col("_n")).alias("count"))))
    return tables


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` code points that end at each place (places before n - 1: of fewer)."""
    h = np.full(len(codes), n, np.uint64)
    for k in range(n - 1, -1, -1):
        part = np.zeros(len(codes), np.uint64)
        part[k:] = codes[: len(codes) - k] + np.uint64(1)
        h = (h ^ part) * _MULT
        h ^= h >> np.uint64(29)
    return h


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text ends."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), np.cumsum([len(x) for x in texts])


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2 and more (Chen and Goodman); where counts of counts are missing, a half, one, one and a half."""
    if min(n1, n2, n3, n4) == 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0, 0], [1, 2, 3])])


def priced(tables: list[DataFrame]) -> DataFrame:
    """(gram, count, p) of the highest order: each n-gram's interpolated probability, by joins of all ``orders``."""
    lower = None
    for order, table in enumerate(tables, 1):
        d = [float(x) for x in discounts(*table.agg(*[F.count_if(F.col("count") == k) for k in (1, 2, 3, 4)]).first())]
        context, suffix = F.expr(f"substring(gram, 1, {order - 1})"), F.expr("substring(gram, 2)")
        less = F.when(F.col("count") == 1, d[1]).when(F.col("count") == 2, d[2]).otherwise(d[3])
        heads = table.groupBy(context.alias("_x")).agg(F.sum("count").alias("_total"), (F.sum(less) / F.sum("count")).alias("_weight"), F.count("*").alias("_kinds"))
        rows = table.withColumn("_x", context).join(heads, "_x")
        own = (F.col("count") - less) / F.col("_total")
        if lower is None:
            found = rows.select("gram", "count", (own + F.col("_weight") / (F.col("_kinds") + 1)).alias("p"))
        else:
            found = rows.withColumn("_s", suffix).join(lower.select(F.col("gram").alias("_s"), F.col("p").alias("_p")), "_s").select("gram", "count", (own + F.col("_weight") * F.col("_p")).alias("p"))
        lower = common.materialize(found)
    return lower


def costs(top: DataFrame, n: int = N) -> DataFrame:
    """(key, count, bits) of all n-grams of the highest order, by hash."""

    def run(batches):
        for batch in batches:
            p = batch.column("p").to_numpy()
            yield [gram_hashes(_points(batch.column("gram").to_pylist())[0], n)[n - 1 :: n].view(np.int64), batch.column("count"), -np.log2(np.maximum(p, 1e-30))]

    return common.materialize(common.mapped(priced(orders(top, n)), run, "key long, count long, bits double"))


class Frequent:
    """Costs of the most frequent n-grams in sorted hash arrays; what isn't among them is named, not guessed.

    Hashes are spread evenly, so their first bits say where in the array to look: ``starts`` holds the place of each
    prefix, and a handful of neighbours are compared.
    """

    def __init__(self, n: int, keys: np.ndarray, bits: np.ndarray) -> None:
        at = np.argsort(keys)
        self.n, self.keys, self.costs = n, keys[at], bits[at]
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        prefixes = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64)
        self.starts = np.append(np.searchsorted(self.keys >> self.shift, prefixes), len(keys)).astype(np.int32)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash stands; -1 where it doesn't."""
        prefix = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[prefix], self.starts[prefix + 1]
        found, left = np.full(len(hashes), -1, np.int32), np.flatnonzero(at < end)
        while left.size:
            here = at[left]
            hit = self.keys[here] == hashes[left]
            found[left[hit]] = here[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found

    def bits(self, said: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each unit's frequent n-grams; then the hashes of its other ones, all units' in a row, and their ends."""
        _, hashes, real, ends = _windows(said, self.n)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        inside = np.flatnonzero(real)
        at = self.places(hashes[inside])
        cost = np.zeros(len(hashes))
        cost[inside[at >= 0]] = self.costs[at[at >= 0]]
        other = np.zeros(len(hashes), bool)
        other[inside[at < 0]] = True
        sums = np.concatenate([[0], np.cumsum(cost)])
        return sums[ends] - sums[starts], hashes[other], np.concatenate([[0], np.cumsum(other)])[ends]


# --- documents ---


def repeated_words(hashes: np.ndarray, window: int = 8) -> int:
    """Words in windows of ``window`` words that are found twice or more, the first included."""
    if len(hashes) <= window:
        return 0
    rolled = np.zeros(len(hashes) - window + 1, np.uint64)
    for k in range(window):
        rolled = (rolled ^ hashes[k : k + len(rolled)]) * _MULT
        rolled ^= rolled >> np.uint64(31)
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(rolled), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[:-window][twice] += 1
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _others(doc: np.ndarray, unit: np.ndarray, hashes: np.ndarray, ends: np.ndarray, n_docs: int) -> pa.Array:
    """For each document a list of (hash, times) of the n-grams that aren't among the frequent ones."""
    sizes = np.diff(np.concatenate([[0], ends])).astype(np.int64)
    full = sizes[unit] > 0
    doc, unit = doc[full], unit[full]
    times = sizes[unit]
    place = np.repeat((ends - sizes)[unit] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(unit) else np.zeros(0, np.int64)
    distinct, code = np.unique(hashes[place.astype(np.int64)], return_inverse=True)
    most = max(len(distinct), 1)
    pairs, count = np.unique(np.repeat(doc, times) * most + code, return_counts=True)
    bounds = np.searchsorted(pairs, np.arange(n_docs + 1) * most)
    named = distinct[pairs % most] if len(distinct) else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(named.view(np.int64)), pa.array(count, pa.int64())], ["g", "n"]))


def _measured(docs: DataFrame, model, n: int) -> DataFrame:
    """Counts and bits of the frequent n-grams; ``rest`` are the others, ``row`` is the row's own number."""
    import pyarrow.compute as pc

    kind = pa.list_(pa.struct([("g", pa.int64()), ("n", pa.int64())]))

    def run(batches):
        from pyspark import TaskContext

        own, row = model.value, TaskContext.get().partitionId() << 33
        for batch in common.slices(batches, "text", 2 << 20):
            texts = common.strings(batch.column("text"))
            offsets, codes, distinct = common.tokenize(texts, lower=False)
            a, b = offsets[:-1], offsets[1:]
            summed = lambda v: (s := np.concatenate([[0], np.cumsum(v[codes])]))[b] - s[a]
            lengths = np.asarray(pc.utf8_length(distinct), np.int64) if len(distinct) else np.zeros(0, np.int64)
            lowered = pc.ascii_lower(distinct).dictionary_encode()
            of = np.asarray(lowered.indices, np.int64)
            said, border = units(lowered.dictionary, of[codes], _firsts(offsets), n)
            bits, others, ends = own.bits(said)
            doc = np.repeat(np.arange(len(a)), b - a)
            rest = _others(np.concatenate([doc, doc]), np.concatenate([of[codes], border]), others, ends, len(a)).cast(kind)
            # each token's own n-grams: those at its border and those inside it
            spent = np.concatenate([[0], np.cumsum(bits[of[codes]] + bits[border])]) if len(codes) else np.zeros(1)
            hashes = (codes.astype(np.uint64) + np.uint64(1)) * _MULT  # windows are compared within a text, so a word's code will do
            chars = summed(lengths)
            repeated = [repeated_words(hashes[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield [batch.column("id"), batch.column("lang"), batch.column("key"), b - a, chars, np.asarray(pc.count_substring_regex(texts, r"[#*$%&|<>]"), np.int64), [duplicate_lines(x) for x in texts.to_pylist()], repeated, spent[b] - spent[a], row + np.arange(len(a)), rest]
            row += len(a)

    return common.mapped(docs, run, f"doc_id {dict(docs.dtypes)['id']}, lang string, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double, row long, rest array<struct<g:bigint,n:bigint>>")


def measure(docs: DataFrame, n: int = N, entries: int = ENTRIES) -> DataFrame:
    """Counts and mean bits per character of every row of ``docs`` (id, text, lang, key)."""
    top = common.materialize(gram_counts(docs.select("text"), n))
    every = costs(top, n)
    head = common.most_frequent(every, entries).select("key", "bits").toArrow()
    model = docs.sparkSession.sparkContext.broadcast(Frequent(n, head["key"].to_numpy().view(np.uint64), head["bits"].to_numpy()))
    found = common.materialize(_measured(docs, model, n))
    rest = found.select("row", F.explode("rest").alias("r")).select("row", F.col("r.g").alias("key"), "r.n").join(every.select("key", F.col("bits").alias("_b")), "key")
    more = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("_b")).alias("_more"))
    whole = (F.col("bits") + F.coalesce("_more", F.lit(0.0))) / F.greatest(F.col("word_chars") + F.col("n_words"), F.lit(1))
    return found.drop("rest").join(more, "row", "left").withColumn("bits", whole).drop("row", "_more")


def bands(measured: DataFrame) -> DataFrame:
    """(_l, docs, center of bits, spread) of documents that pass the base rules: of each language (``=`` and its name)
    and of all together (``*``). A language's spread is shrunk towards the one within all languages.

    Medians come from counts of hundredths of a bit, so nothing has to be sorted.
    """
    good = measured.where("not base_failed")

    def medians(rows: DataFrame, value, name: str) -> DataFrame:
        # a table of its own, so that the windows over a language get its counts, not its documents
        counts = common.materialize(rows.groupBy("_l", F.round(value, 2).alias(name)).agg(F.count("*").alias("_n")))
        up = Window.partitionBy("_l").orderBy(name)
        return counts.withColumns({"_c": F.sum("_n").over(up), "_all": F.sum("_n").over(Window.partitionBy("_l"))}).where("2 * _c >= _all").groupBy("_l").agg(F.min(name).alias(name), F.max("_all").alias("docs"))

    # each document counts for its language and for all together (null)
    every = good.select(F.explode(F.array(F.col("lang"), F.lit(None).cast("string"))).alias("_l"), "bits", "n_words").where("_l is not null").unionByName(good.select(F.lit(None).cast("string").alias("_l"), "bits", "n_words"))
    every = every.withColumn("_l", F.coalesce(F.concat(F.lit("="), "_l"), F.lit("*")))
    center = medians(every, F.col("bits"), "center")
    away = every.join(center.select(F.col("_l").alias("_k"), "center"), F.col("_l") == F.col("_k")).withColumn("_d", F.abs(F.col("bits") - F.col("center")) * F.sqrt(F.lit(1.0) / (F.lit(1.0) / 400 + F.lit(1.0) / F.col("n_words"))) / 20)
    # within: all documents with a language, each around its own language's median
    within = away.where("_l <> '*'").withColumn("_l", F.lit("within"))
    mads = common.materialize(medians(away.select("_l", "_d").unionByName(within.select("_l", "_d")), F.col("_d"), "mad").drop("docs"))
    spread = lambda c: F.greatest(c, F.lit(0.01)) * 1.4826
    pooled = mads.where("_l = 'within'").select(spread(F.col("mad")).alias("_pooled"))
    found = center.join(mads, "_l").select("_l", "docs", "center", spread(F.col("mad")).alias("spread"))
    shrunk = (F.col("docs") * F.col("spread") + PRIOR_DOCS * F.col("_pooled")) / (F.col("docs") + PRIOR_DOCS)
    return found.where("_l <> '*'").crossJoin(pooled).withColumn("spread", shrunk).drop("_pooled").unionByName(found.where("_l = '*'"))


def judge(docs: DataFrame, n: int = N, entries: int = ENTRIES, width: float = WIDTH) -> DataFrame:
    """Counts, ``base_failed``, ``bits``, ``kept`` and ``key`` (a hash of doc_id, text and lang) of every row of ``docs``.

    ``docs``: doc_id, text, lang; other columns are ignored. A null or empty text has no words and fails. Repeated rows
    are judged each, alike. A null language has the band of all documents. An empty table
    gives no rows.
    """
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    whole = docs.select(F.col("doc_id").alias("id"), text.alias("text"), lang.alias("lang"), F.xxhash64("doc_id", text, lang).alias("key"))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    measured = common.materialize(measure(whole, n, entries).withColumn("base_failed", failed))
    found = common.materialize(bands(measured))
    everything = found.where("_l = '*'").select(F.col("center").alias("_c0"), F.col("spread").alias("_s0")).first()
    c0, s0 = (everything[0], everything[1]) if everything else (0.0, 0.0)
    own = found.where("_l <> '*'").select(F.expr("substring(_l, 2)").alias("_l"), "center", "spread")
    joined = measured.join(own, F.col("lang") == F.col("_l"), "left")
    reach = F.coalesce("spread", F.lit(s0)) * 20 * F.sqrt(F.lit(1.0) / 400 + F.lit(1.0) / F.greatest("n_words", F.lit(1))) * width
    center = F.coalesce("center", F.lit(c0))
    kept = ~F.col("base_failed") & (F.col("bits") >= center - reach) & (F.col("bits") <= center + reach)
    return joined.select(*measured.columns, (center - reach).alias("low"), (center + reach).alias("high"), kept.alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    name = common.unused(docs)("key")
    keys = judge(docs, **options).where("kept").select(F.col("key").alias(name)).distinct()
    key = F.xxhash64("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    return docs.join(keys, key == F.col(name), "left_semi")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits", "low", "high")
