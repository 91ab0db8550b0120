"""Scoring texts with a gated recurrent language model, trained here in numpy.

Tokens are the words of a text, A-Z in lower case, and one end. Spark counts the words of all training documents. The
output is factored: a softmax over classes, then the word within its class.

* The most frequent tokens, the head, are in classes of ``MEMBERS``; within these, a second softmax on the state. The
  number of these classes, and with it the head and the input rows, grows with the root of the training vocabulary.
* All other words are in classes by a hash of their last letters, which tell languages apart, once for the ``KNOWN`` most
  frequent words and once for the rest; within these, a word has its share of the class's counts, one added to each.
  Each rest class keeps one such share for words never seen in training.

So the probabilities of all words, unseen ones included, add up to one at most.

The recurrent layer is a minimal gated unit: ``f = s(x_f + h U_f)``, ``c = tanh(x_c + f (h U_c))``, ``h' = h + f (c - h)``.
Training is by truncated backpropagation over windows of ``WINDOW`` tokens, the state carried on through the stream and
set to zero where a document begins. In each round Spark deals the round's documents to shards by a hash of doc_id and
text; their number follows the bytes, not how the input is split. A task trains a copy of the model on its shard, in the
order of the hashes, and Spark averages the copies, weighted by tokens. The rounds have 1, 2 and 5 eighths of the
training documents, by hash, so every training token is learned from, once, at every size.

Scoring carries the state over the windows of a whole document. What a task knows without looking further is the
broadcast model and the ``KNOWN`` words; counts of rarer words come from a join on the word, of one row per document and
word. The model has a few hundred numbers for each root of a word of the vocabulary: some megabytes for 10^9 words.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import common
from graphlens.llm.quality import word_counts

HIDDEN, WIDTH, LEAST_CLASSES, MEMBERS, GROUPS, KNOWN = 24, 16, 16, 32, 32, 1 << 17
WINDOW, LANES, UPDATES, RATE, ROUNDS, SEED = 16, 256, 300, 0.012, ((0,), (1, 2), (3, 4, 5, 6, 7)), 7
SHARD_BYTES, TRAIN_BYTES, SCORE_TOKENS, SOFTMAX_TOKENS = 24 << 20, 32 << 20, 4 << 20, 1 << 14


def head_classes(vocabulary: int) -> int:
    """Classes of the head for so many distinct training words."""
    return max(LEAST_CLASSES, math.ceil(math.sqrt(vocabulary) / 64))


def shapes(heads: int) -> dict[str, tuple[int, ...]]:
    classes, rows = heads + 2 * GROUPS, 4 * heads * MEMBERS
    return {"e": (rows + GROUPS, WIDTH), "wx": (WIDTH, 2 * HIDDEN), "bx": (2 * HIDDEN,), "u": (HIDDEN, 2 * HIDDEN), "wc": (HIDDEN, classes), "bc": (classes,), "wm": (heads, HIDDEN, MEMBERS), "bm": (heads, MEMBERS)}


def size_of(heads: int) -> int:
    return sum(math.prod(s) for s in shapes(heads).values())


def views(flat: np.ndarray, heads: int) -> dict[str, np.ndarray]:
    """The model's matrices as parts of one vector."""
    out, at = {}, 0
    for name, shape in shapes(heads).items():
        out[name] = flat[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return out


def fresh(heads: int) -> np.ndarray:
    rng, flat = np.random.default_rng(SEED), np.zeros(size_of(heads), np.float32)
    m = views(flat, heads)
    for name, scale in (("e", 0.3), ("wx", 1 / math.sqrt(WIDTH)), ("u", 0.5 / math.sqrt(HIDDEN)), ("wc", 0.1), ("wm", 0.1)):
        m[name][:] = rng.normal(0, scale, m[name].shape)
    m["bx"][:HIDDEN] = -1  # long memory at first
    return flat


def group_of(word: Column) -> Column:
    return F.pmod(F.crc32(F.right(word, F.lit(3))), F.lit(GROUPS)).cast("int")


class Vocabulary:
    """The most frequent words with what the model needs of them: at most ``KNOWN``."""

    def __init__(self, words: list[str], counts: np.ndarray, group_sums: np.ndarray, n_docs: int, heads: int) -> None:
        """``words`` by falling count; ``group_sums``: sums of count + 1 of all training words of each group."""
        self.heads, self.head, self.rows = heads, heads * MEMBERS, 4 * heads * MEMBERS
        self.words, self.counts = pa.array(words, pa.large_string()), counts.astype(np.int64)
        self.n_docs = n_docs
        groups = np.array([self.group(w) for w in words], np.int64)
        tail = np.arange(len(words)) >= self.head - 1  # the end is the first of the head
        in_tail = np.bincount(groups[tail], counts[tail] + 1, GROUPS)
        head = np.bincount(groups[~tail], counts[~tail] + 1, GROUPS)
        self.tail_log = np.log10(np.maximum(in_tail, 1))
        self.rest_log = np.log10(np.maximum(group_sums - in_tail - head, 0) + 1)

    @staticmethod
    def group(word: str) -> int:
        return zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % GROUPS

    def of(self, distinct: pa.Array) -> dict[str, np.ndarray]:
        """For each distinct word: input row, class, member (-1 outside the head), log10(count + 1), and whether it is known."""
        import pyarrow.compute as pc

        at = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=self.words), -1), np.int64)
        known = at >= 0
        group = np.fromiter(map(self.group, distinct.to_pylist()), np.int64, len(distinct))
        rank = at + 1
        head = known & (rank < self.head)
        log = np.log10(np.where(known, self.counts[np.maximum(at, 0)] if len(self.counts) else 0, 0) + 1.0)
        return {
            "row": np.where(known & (rank < self.rows), rank, self.rows + group).astype(np.int32),
            "cls": np.where(head, rank // MEMBERS, self.heads + group + np.where(known, 0, GROUPS)).astype(np.int16),
            "mem": np.where(head, rank % MEMBERS, -1).astype(np.int16),
            "log": log,
            "own": np.where(head, 0.0, np.where(known, log - self.tail_log[group], -self.rest_log[group])),
            "known": known,
        }

    def stream(self, texts: pa.Array, wanted: tuple[str, ...] = ("row", "cls", "mem", "log", "own", "known")) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, pa.Array]:
        """Ends of the texts in the stream of tokens, the tokens' columns (each text has its end token), codes, words."""
        offsets, codes, distinct = common.tokenize(texts)
        columns = self.of(distinct)
        ends = offsets[1:] + np.arange(1, len(offsets))
        place = np.ones(ends[-1] if len(ends) else 0, bool)
        place[ends - 1] = False
        end = {"row": 0, "cls": 0, "mem": 0, "log": math.log10(self.n_docs + 1), "own": 0.0, "known": self.n_docs > 0}
        out = {}
        for name in wanted:
            out[name] = np.full(len(place), end[name], columns[name].dtype)
            out[name][place] = columns[name][codes]
        return ends, out, codes, distinct


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.reciprocal(1 + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 1 - 2 * np.reciprocal(1 + np.exp(2 * x))


def _bounded(logits: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logits of states within -1 and 1, made safe for exp: where the weights alone keep them small, they are as they are."""
    if float(np.abs(w).sum(axis=0).max() + np.abs(b).max()) > 60:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def train(flat: np.ndarray, heads: int, row: np.ndarray, cls: np.ndarray, mem: np.ndarray, start: np.ndarray) -> None:
    """One pass over a stream, in place: Adam on windows of truncated backpropagation. The stream is laid out in lanes,
    as many as leave ``UPDATES`` windows, at most ``LANES``; the last lanes are filled up with places that teach nothing."""
    n = len(row)
    lanes = int(min(LANES, max(1, n // (WINDOW * UPDATES)), n))
    steps = -(-n // lanes)
    cut = lambda x: np.ascontiguousarray(np.concatenate([x, np.zeros(lanes * steps - n, x.dtype)]).reshape(lanes, steps).T)
    before = cut(np.concatenate([np.zeros(1, row.dtype), row[:-1]]))
    cls, mem, start, real = cut(cls), cut(mem), cut(start), cut(np.ones(n, bool))
    m, grad = views(flat, heads), np.zeros(len(flat), np.float32)
    d = views(grad, heads)
    first, second = np.zeros(len(flat), np.float32), np.zeros(len(flat), np.float32)
    state = np.zeros((lanes, HIDDEN), np.float32)
    updates = -(-steps // WINDOW)
    for k in range(updates):
        at = slice(k * WINDOW, min((k + 1) * WINDOW, steps))
        rows, t_n = before[at], at.stop - at.start
        e = m["e"][rows.ravel()]
        x = (e @ m["wx"] + m["bx"]).reshape(t_n, lanes, 2 * HIDDEN)
        old, fs, cs, hus = (np.empty((t_n, lanes, s), np.float32) for s in (HIDDEN, HIDDEN, HIDDEN, HIDDEN))
        out = np.empty((t_n, lanes, HIDDEN), np.float32)
        keep = (~start[at]).astype(np.float32)[:, :, None]
        for t in range(t_n):
            state = state * keep[t]
            hu = state @ m["u"]
            f = _sigmoid(x[t, :, :HIDDEN] + hu[:, :HIDDEN])
            c = _tanh(x[t, :, HIDDEN:] + f * hu[:, HIDDEN:])
            old[t], fs[t], cs[t], hus[t] = state, f, c, hu[:, HIDDEN:]
            state = state + f * (c - state)
            out[t] = state
        flat_out = out.reshape(-1, HIDDEN)
        grad[:] = 0
        teaches = real[at].ravel()
        full = bool(teaches.all())
        scale = np.float32(1 / (len(flat_out) if full else max(teaches.sum(), 1)))
        # classes
        logits = flat_out @ m["wc"]
        logits += m["bc"]
        np.exp(_bounded(logits, m["wc"], m["bc"]), out=logits)
        logits *= scale / (logits @ np.ones((logits.shape[1], 1), np.float32))
        target, member = cls[at].ravel(), mem[at].ravel()
        logits[np.arange(len(target)), target] -= scale
        if not full:
            logits[~teaches] = 0
        d["wc"][:], d["bc"][:] = flat_out.T @ logits, np.ones(len(logits), np.float32) @ logits
        d_out = logits @ m["wc"].T
        # members of the head's classes
        order = np.argsort(target, kind="stable")
        order = order if full else order[teaches[order]]
        edges = np.searchsorted(target[order], np.arange(heads + 1))
        for c in range(heads):
            own = order[edges[c] : edges[c + 1]]
            if len(own):
                h = flat_out[own]
                p = h @ m["wm"][c] + m["bm"][c]
                np.exp(_bounded(p, m["wm"][c], m["bm"][c]), out=p)
                p *= scale / p.sum(axis=1, keepdims=True)
                p[np.arange(len(own)), member[own]] -= scale
                d["wm"][c], d["bm"][c] = h.T @ p, p.sum(axis=0)
                d_out[own] += p @ m["wm"][c].T
        d_out = d_out.reshape(t_n, lanes, HIDDEN)
        # back through time
        dx = np.empty((t_n, lanes, 2 * HIDDEN), np.float32)
        dhu = np.empty((t_n, lanes, 2 * HIDDEN), np.float32)
        later = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(t_n - 1, -1, -1):
            dh = d_out[t] + later
            f, c = fs[t], cs[t]
            dc = dh * f * (1 - c * c)
            df = (dh * (c - old[t]) + dc * hus[t]) * f * (1 - f)
            dx[t, :, :HIDDEN], dx[t, :, HIDDEN:] = df, dc
            dhu[t, :, :HIDDEN], dhu[t, :, HIDDEN:] = df, dc * f
            later = (dh * (1 - f) + dhu[t] @ m["u"].T) * keep[t]
        dx, dhu = dx.reshape(-1, 2 * HIDDEN), dhu.reshape(-1, 2 * HIDDEN)
        d["u"][:] = old.reshape(-1, HIDDEN).T @ dhu
        d["wx"][:], d["bx"][:] = e.T @ dx, dx.sum(axis=0)
        de = dx @ m["wx"].T
        sort = np.argsort(rows.ravel().astype(np.uint16) if len(m["e"]) <= 1 << 16 else rows.ravel(), kind="stable")  # 16 bits are sorted by radix
        sorted_rows = rows.ravel()[sort]
        runs = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        d["e"][sorted_rows[runs]] = np.add.reduceat(de[sort], runs, axis=0)
        norm = float(np.sqrt(np.dot(grad, grad)))
        if norm > 1:
            grad *= np.float32(1 / norm)
        first *= np.float32(0.9)
        first += np.float32(0.1) * grad
        second *= np.float32(0.99)
        second += np.float32(0.01) * grad * grad
        rate = RATE * (1 - 0.9 * k / updates) * math.sqrt(1 - 0.99 ** (k + 1)) / (1 - 0.9 ** (k + 1))
        flat -= np.float32(rate) * first / (np.sqrt(second) + np.float32(1e-6))


def score(flat: np.ndarray, heads: int, ends: np.ndarray, columns: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of the classes, and of the head's members, of each whole text, the state carried on."""
    m = views(flat, heads)
    table = m["e"] @ m["wx"] + m["bx"]
    starts = np.concatenate([[0], ends[:-1]])
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    total = np.zeros(len(ends))
    state = np.zeros((len(ends), HIDDEN), np.float32)
    before = np.concatenate([[0], columns["row"][:-1]]) if len(columns["row"]) else columns["row"]
    longest = int(lengths[0]) if len(lengths) else 0
    at = 0
    while at < longest:
        active = int(np.searchsorted(-lengths, -at, side="left"))
        width = int(min(WINDOW if active > 64 else 16 * WINDOW, longest - at))
        place = starts[None, :active] + at + np.arange(width)[:, None]
        real = at + np.arange(width)[:, None] < lengths[None, :active]
        place = np.minimum(place, len(before) - 1)
        rows, h, out = before[place], state[:active], np.empty((width, active, HIDDEN), np.float32)
        for t in range(width):
            n = int(np.searchsorted(-lengths[:active], -(at + t), side="left"))
            x, hu = table[rows[t, :n]], h[:n] @ m["u"]
            f = _sigmoid(x[:, :HIDDEN] + hu[:, :HIDDEN])
            h[:n] += f * (_tanh(x[:, HIDDEN:] + f * hu[:, HIDDEN:]) - h[:n])
            out[t, :n] = h[:n]
        token, lane = place[real], np.broadcast_to(np.arange(active), real.shape)[real]
        hidden = out[real]
        target, member = columns["cls"][token], columns["mem"][token]
        cost = np.empty(len(target))
        for a in range(0, len(target), SOFTMAX_TOKENS):
            part = slice(a, a + SOFTMAX_TOKENS)
            logits = hidden[part] @ m["wc"]
            logits += m["bc"]
            logits = _bounded(logits, m["wc"], m["bc"])
            cost[part] = logits[np.arange(len(logits)), target[part]] - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))
        own_order = np.argsort(target, kind="stable")
        edges = np.searchsorted(target[own_order], np.arange(heads + 1))
        for c in range(heads):
            own = own_order[edges[c] : edges[c + 1]]
            if len(own):
                p = _bounded(hidden[own] @ m["wm"][c] + m["bm"][c], m["wm"][c], m["bm"][c])
                cost[own] += p[np.arange(len(own)), member[own]] - np.log(np.exp(p).sum(axis=1))
        total[:active] += np.bincount(lane, cost, active)
        at += width
    result = np.zeros(len(ends))
    result[order] = total / math.log(10)
    return result


def _round(docs: DataFrame, shards: int, vocabulary, model) -> np.ndarray:
    """The model after a round: each shard's copy, averaged by tokens. ``docs``: text, and its place ``h``."""

    def run(batches):
        own, said, seen = model.value.copy(), vocabulary.value, 0
        held: list[pa.Array] = []

        def learn() -> int:
            ends, columns, _, _ = said.stream(pa.concat_arrays(held), ("row", "cls", "mem"))
            start = np.zeros(len(columns["row"]), bool)
            start[np.concatenate([[0], ends[:-1]])] = True
            train(own, said.heads, columns["row"], columns["cls"], columns["mem"], start)
            return len(start)

        size = 0
        for batch in common.slices(batches, "text"):
            held.append(common.strings(batch.column("text")))
            size += held[-1].nbytes
            if size >= TRAIN_BYTES:
                seen, held, size = seen + learn(), [], 0
        if held:
            seen += learn()
        if seen:
            yield [np.arange(len(own)), own.astype(np.float64) * seen, np.full(len(own), float(seen))]

    dealt = docs.repartition(shards, "h").sortWithinPartitions("h").select("text")
    with common.shuffles_cleaned(docs.sparkSession):
        sums = common.mapped(dealt, run, "k int, v double, w double").groupBy("k").agg((F.sum("v") / F.sum("w")).alias("v")).toArrow()  # one row for each parameter
    if not sums.num_rows:
        return model.value
    out = np.zeros(len(model.value), np.float32)
    out[sums["k"].to_numpy()] = sums["v"].to_numpy()
    return out


def fit(training: DataFrame, counts: DataFrame, n_docs: int) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and model from training documents (text, and ``h``, a hash that deals them) and their word counts
    (word, count)."""
    spark = training.sparkSession
    heads = head_classes(counts.count())
    top = common.most_frequent(counts, KNOWN).toArrow().sort_by([("count", "descending"), ("word", "ascending")])
    groups = counts.groupBy(group_of(F.col("word")).alias("g")).agg(F.sum(F.col("count") + 1).alias("n")).toPandas()
    sums = np.zeros(GROUPS)
    sums[groups["g"].to_numpy(int)] = groups["n"].to_numpy()
    vocabulary = Vocabulary(top["word"].to_pylist(), top["count"].to_numpy(), sums, n_docs, heads)
    sent, flat = spark.sparkContext.broadcast(vocabulary), fresh(heads)
    eighth = F.pmod(F.xxhash64("h", F.lit("round")), F.lit(8))
    sizes = {r["e"]: r["n"] for r in training.groupBy(eighth.alias("e")).agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    for part in ROUNDS:
        shards = max(1, math.ceil(sum(sizes.get(e, 0) for e in part) / SHARD_BYTES))
        flat = _round(training.where(eighth.isin(*part)), shards, sent, spark.sparkContext.broadcast(flat))
    return vocabulary, flat


def _scored(docs: DataFrame, vocabulary, model) -> DataFrame:
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def run(batches):
        from pyspark import TaskContext

        own, said, key = model.value, vocabulary.value, TaskContext.get().partitionId() << 33
        # texts of many slices are scored together, so that few stand alone at their ends: eight bytes a token are held
        held: list[list] = []

        def scored():
            streams = [{c: x[0][c] for c in ("row", "cls", "mem")} for x in held]
            columns = {c: np.concatenate([x[c] for x in streams]) for c in ("row", "cls", "mem")}
            starts = np.cumsum([0, *(len(x["row"]) for x in streams)])
            part = score(own, said.heads, np.concatenate([x[1] + a for x, a in zip(held, starts, strict=False)]), columns)
            at = 0
            for _, ends, before, apart, after in held:
                yield [*before, part[at : at + len(ends)] + apart, *after]
                at += len(ends)

        for batch in common.slices(batches, "text"):
            ends, columns, codes, distinct = said.stream(batch.column("text"))
            starts = np.concatenate([[0], ends[:-1]])
            summed = lambda v: (s := np.concatenate([[0], np.cumsum(v)]))[ends] - s[starts]
            # rare words: one row for each text and word
            offsets = ends - np.arange(1, len(ends) + 1)
            doc = np.searchsorted(offsets, np.arange(len(codes)), side="right")
            known = columns["known"]
            place = np.ones(len(known), bool)
            place[ends - 1] = False
            rare = ~known[place]
            pairs, times = np.unique(doc[rare] * max(len(distinct), 1) + codes[rare], return_counts=True)
            word = distinct.take(pa.array(pairs % max(len(distinct), 1))).cast(pa.string())
            bounds = np.searchsorted(pairs, np.arange(len(ends) + 1) * max(len(distinct), 1))
            rest = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([word, pa.array(times, pa.int64())], ["word", "n"])).cast(kind)
            before = [key + np.arange(len(ends)), batch.column("doc_id"), batch.column("held_out"), ends - starts, summed(known.astype(np.int64)), summed(columns["log"])]
            held.append([{c: columns[c] for c in ("row", "cls", "mem")}, ends, before, summed(columns["own"]), [rest]])
            key += len(ends)
            if sum(len(x[0]["row"]) for x in held) >= SCORE_TOKENS:
                yield from scored()
                held = []
        if held:
            yield from scored()

    schema = f"key long, doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, log_sum double, part double, rest array<struct<word:string,n:long>>"
    return common.mapped(docs, run, schema)


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    Rows where ``held_out`` isn't true are learned from. A null text is empty: it has its end only. Repeated rows are
    learned from and scored each. Without training documents, all words are unseen and the model is the fresh one. Other
    columns are ignored, whatever their names. How the input is split into partitions does not matter.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = rows.where(~F.col("held_out")).select("text", F.xxhash64("doc_id", "text").alias("h"))
    counts = common.materialize(word_counts(training.select("text")))
    n_docs = training.count()
    n, v = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    n, v = n + n_docs, v + (n_docs > 0)
    vocabulary, flat = fit(training, counts, n_docs)
    scored = common.materialize(_scored(rows, spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(flat)))
    rest = scored.select("key", F.explode("rest").alias("r")).select("key", "r.word", "r.n")
    rare = rest.join(counts, "word").groupBy("key").agg(F.sum("n").alias("_known"), F.sum(F.col("n") * F.log10(F.col("count") + 1)).alias("_log"))
    joined = scored.drop("rest").join(rare, "key", "left")
    known, log = F.coalesce("_known", F.lit(0)), F.coalesce("_log", F.lit(0.0))
    base = F.col("log_sum") + log - F.col("n_tokens") * math.log10(n + v + 1)
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("part") + log).alias("score"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    return score_documents(common.table(spark, sf_dir, "documents"), held)
