"""Secret scanning: fixed patterns first, then automata inferred from what they find.

The pattern matches are the labelled credentials. For each kind, the values become a prefix tree with counts, and states
whose futures are statistically compatible (Hoeffding's bound on the share of every symbol and of the end, on all the way
down) are merged into a probabilistic automaton, in the order of the tree's breadth (the scheme known as ALERGIA). More
automata are inferred in the same way from ordinary candidates: from all, and from those of letters, of capitals and of digits
only, which may be too rare among all to be learnt there.

A candidate is a maximal run of ``[A-Za-z0-9+/_-]`` of ``LEAST`` characters or more that overlaps no pattern match. Every
candidate of every text is scored by its likelihood under each automaton. It is a credential of the likeliest kind if it
is as likely a character as all but the lowest ``LOWEST`` of that kind's own held-out values, and ``ODDS`` times likelier than under any ordinary automaton.

The automata are fitted on at most ``SAMPLE`` distinct values of a kind, the smallest hashes first, of at most ``LONGEST``
characters each; that bounds what the driver collects and what is broadcast. All texts are searched and scored, whole.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import common

#: Fixed by the contract: kind, pattern, group whose length counts, least length.
PATTERNS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: Patterns that a text must hold to have a match of its kind; they run over a batch at once.
HINTS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
KINDS = tuple(k for k, *_ in PATTERNS)
#: Samples of ordinary candidates, and what all of a candidate must match to be in one.
ORDINARY = {"any": r"(?s).*", "letters": "[A-Za-z]*", "capitals": "[A-Z]*", "digits": "[0-9]*"}
LEAST, CANDIDATE = 8, re.compile(r"[A-Za-z0-9+/_-]{8,}")
SAMPLE, LONGEST, ALPHA, ODDS, HELD_OUT, LOWEST, SLACK = 1_000, 256, 0.05, 1e6, 5, 0.05, 0.25
#: Symbols of the automata: these characters, then one for all others.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_SYMBOL = np.full(256, len(SYMBOLS), np.uint8)
_SYMBOL[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def coded(value: str) -> list[int]:
    """Symbols of a value; a character outside the alphabet is the last symbol."""
    return [SYMBOLS.find(c) if c in SYMBOLS else len(SYMBOLS) for c in value]


class Automaton:
    """A probabilistic automaton merged from the prefix tree of some values.

    ``next[state, symbol]`` is the state that follows, ``cost[state, symbol]`` the natural logarithm of its probability and
    ``end[state]`` that of stopping. Each state has one count more, spread as all states' counts together are; a symbol that a
    state has never been left by leads to where it leads most often, or back to the start.
    """

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self.alpha = alpha
        self._tree(values)
        self._merge()
        self._tables()

    def _tree(self, values: list[str]) -> None:
        self.follows: list[dict[int, int]] = [{}]
        self.times: list[dict[int, int]] = [{}]
        self.stops, self.total = [0], [0]
        for value in values:
            state = 0
            for x in coded(value):
                self.total[state] += 1
                self.times[state][x] = self.times[state].get(x, 0) + 1
                if x not in self.follows[state]:
                    self.follows[state][x] = len(self.total)
                    self.follows.append({})
                    self.times.append({})
                    self.stops.append(0)
                    self.total.append(0)
                state = self.follows[state][x]
            self.total[state] += 1
            self.stops[state] += 1

    def _alike(self, a: int, b: int) -> bool:
        """Whether all shares of two states, and of what follows them, differ within the bound."""
        pairs = [(a, b)]
        while pairs:
            p, q = pairs.pop()
            bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(self.total[p]) + 1 / math.sqrt(self.total[q]))
            shares = [(self.stops[p], self.stops[q]), *((self.times[p].get(x, 0), self.times[q].get(x, 0)) for x in self.times[p].keys() | self.times[q].keys())]
            if any(abs(m / self.total[p] - n / self.total[q]) > bound for m, n in shares):
                return False
            pairs += [(self.follows[p][x], self.follows[q][x]) for x in self.follows[p].keys() & self.follows[q].keys()]
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the counts of ``blue`` and all that follows it to ``red`` and its followers."""
        pairs = [(red, blue)]
        while pairs:
            p, q = pairs.pop()
            self.total[p] += self.total[q]
            self.stops[p] += self.stops[q]
            for x, n in self.times[q].items():
                self.times[p][x] = self.times[p].get(x, 0) + n
            for x, state in self.follows[q].items():
                if x in self.follows[p]:
                    pairs.append((self.follows[p][x], state))
                else:
                    self.follows[p][x] = state

    def _merge(self) -> None:
        self.kept = [0]
        waiting = deque((0, x) for x in sorted(self.follows[0]))
        held = {0}
        while waiting:
            source, x = waiting.popleft()
            blue = self.follows[source][x]
            if blue in held:
                continue
            for red in self.kept:
                if self._alike(red, blue):
                    before = {r: set(self.follows[r]) for r in self.kept}
                    self.follows[source][x] = red
                    self._fold(red, blue)
                    waiting.extend((r, s) for r in self.kept for s in sorted(self.follows[r].keys() - before[r]))
                    break
            else:
                held.add(blue)
                self.kept.append(blue)
                waiting.extend((blue, s) for s in sorted(self.follows[blue]))

    def _tables(self) -> None:
        number = {state: k for k, state in enumerate(self.kept)}
        n, width = len(self.kept), len(SYMBOLS) + 1
        counts, self.next = np.zeros((n, width + 1)), np.zeros((n, width), np.int64)
        for state, k in number.items():
            counts[k, width] = self.stops[state]
            for x, times in self.times[state].items():
                counts[k, x] = times
            for x, after in self.follows[state].items():
                self.next[k, x] = number[after]
        led = np.zeros((n, width))
        for k in range(n):
            np.add.at(led, (self.next[k], np.arange(width)), counts[k, :width])
        self.next = np.where(counts[:, :width] > 0, self.next, np.where(led.any(axis=0), led.argmax(axis=0), 0))
        overall = counts.sum(axis=0) + 1
        shares = np.log((counts + overall / overall.sum()) / (counts.sum(axis=1, keepdims=True) + 1))
        self.cost, self.end = shares[:, :width], shares[:, width]
        del self.follows, self.times, self.stops, self.total, self.kept

    def log_prob(self, value: str) -> float:
        state, total = 0, 0.0
        for x in coded(value):
            total += self.cost[state, x]
            state = self.next[state, x]
        return float(total + self.end[state])


class Formats:
    """The automata of all kinds that have values, the ordinary ones, and each kind's least likelihood a character.

    All automata stand in one table, so that a batch of candidates walks through all of them together.
    """

    def __init__(self, values: dict[str, list[str]]) -> None:
        self.kinds = [k for k in KINDS if values.get(k)]
        self.least = []
        automata = []
        for kind in self.kinds:
            own = values[kind]
            held = own[::HELD_OUT] if len(own) >= 2 * HELD_OUT else own
            learnt = [v for k, v in enumerate(own) if k % HELD_OUT] if len(own) >= 2 * HELD_OUT else own
            automata.append(Automaton(learnt))
            self.least.append(float(np.quantile([automata[-1].log_prob(v) / (len(v) + 1) for v in held], LOWEST)) - SLACK)
        automata += [Automaton(values.get(name, [])) for name in ORDINARY]
        self.roots = np.cumsum([0, *(len(a.end) for a in automata)])[:-1]
        self.next = np.concatenate([a.next + r for a, r in zip(automata, self.roots, strict=True)])
        self.cost, self.end = np.concatenate([a.cost for a in automata]), np.concatenate([a.end for a in automata])

    def scores(self, candidates: pa.Array) -> np.ndarray:
        """Log-likelihood of each candidate (large strings) under each automaton, the ordinary ones last.

        All candidates take a step at a time; the few that are longer than the others go on alone, in plain Python.
        """
        offsets = np.frombuffer(candidates.buffers()[1], np.int64)[candidates.offset : candidates.offset + len(candidates) + 1]
        symbols = _SYMBOL[np.frombuffer(candidates.buffers()[2] or b"", np.uint8)]
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        left = np.sort(lengths)
        states, totals = np.tile(self.roots, (len(lengths), 1)), np.zeros((len(lengths), len(self.roots)))
        step = 0
        while (alive := len(lengths) - int(np.searchsorted(left, step, side="right"))) > 16:
            at = order[:alive]
            x, state = symbols[offsets[at] + step], states[at]
            totals[at] += self.cost[state, x[:, None]]
            states[at] = self.next[state, x[:, None]]
            step += 1
        for k in order[:alive]:
            rest = symbols[offsets[k] + step : offsets[k + 1]].tolist()
            for j in range(len(self.roots)):
                state, total = int(states[k, j]), 0.0
                for x in rest:
                    total += self.cost[state, x]
                    state = int(self.next[state, x])
                states[k, j], totals[k, j] = state, totals[k, j] + total
        return totals + self.end[states]

    def kind_of(self, candidates: pa.Array) -> np.ndarray:
        """Number of the kind that each candidate is a credential of, -1 for none."""
        if not self.kinds or not len(candidates):
            return np.full(len(candidates), -1)
        scores = self.scores(candidates)
        own, ordinary = scores[:, : len(self.kinds)], scores[:, len(self.kinds) :].max(axis=1)
        lengths = np.asarray(pc.binary_length(candidates), np.int64)
        fits = (own / (lengths + 1)[:, None] >= np.array(self.least)) & (own - ordinary[:, None] >= math.log(ODDS))
        return np.where(fits.any(axis=1), np.argmax(np.where(fits, own, -np.inf), axis=1), -1)


def base_spans(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str, str]]:
    """(start, kind number, end, value) of the pattern matches of a text, leftmost and non-overlapping within a kind; what is too short
    goes after matching. In order of start, then kind."""
    found = []
    for number, (kind, pattern, group, least) in enumerate(PATTERNS):
        if kind in kinds:
            found += [(m.start(), number, m.end(), m.group(group)) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(found)


def hinted(texts: pa.Array) -> np.ndarray:
    """Of each text and kind, whether the pattern can match at all."""
    return np.stack([pc.match_substring_regex(texts, HINTS[k]).to_numpy(zero_copy_only=False) for k in KINDS], axis=1)


def candidates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct candidates of a batch of texts, with the number of the text and of the candidate for each occurrence."""
    if texts.buffers()[2] is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), texts.slice(0, 0)
    plain = _PLAIN[np.frombuffer(texts.buffers()[2], np.uint8)]
    spaced = pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], pa.py_buffer(plain)], offset=texts.offset)
    offsets, codes, distinct = common.tokenize(spaced, lower=False)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), distinct.slice(0, 0)
    long = np.asarray(pc.binary_length(distinct)) >= LEAST
    number = np.cumsum(long) - 1
    owner, keep = np.repeat(np.arange(len(texts)), np.diff(offsets)), long[codes]
    return owner[keep], number[codes[keep]], distinct.filter(pa.array(long))


def labelled(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """At most ``sample`` distinct values of each kind and of each sort of ordinary candidates, the smallest hashes first."""

    def run(batches: Iterator[pa.RecordBatch]):
        lowest: dict[str, dict[str, int]] = {name: {} for name in ORDINARY}
        for batch in common.slices(batches, "text"):
            texts = common.strings(batch.column("text"))
            kinds, values, owned = [], [], set()
            hints = hinted(texts)
            for k in np.flatnonzero(hints.any(axis=1)):
                for _, number, _, value in base_spans(texts[int(k)].as_py(), tuple(x for x, h in zip(KINDS, hints[k], strict=True) if h)):
                    kinds.append(KINDS[number])
                    values.append(value)
                    owned.update(CANDIDATE.findall(value))
            yield [kinds, values]
            _, _, distinct = candidates(texts)
            hashes = common.hash64(distinct)
            for name, said in ORDINARY.items():
                fits = np.asarray(pc.match_substring_regex(distinct, f"^{said}$").to_numpy(zero_copy_only=False), bool)
                near = np.flatnonzero(fits)
                near = near[np.argsort(hashes[near])[: 2 * sample + len(owned)]]
                lowest[name] |= {v: int(h) for v, h in zip(distinct.take(pa.array(near)).to_pylist(), hashes[near], strict=True) if v not in owned}
                lowest[name] = dict(sorted(lowest[name].items(), key=lambda x: (x[1], x[0]))[: 2 * sample])
        for name, own in lowest.items():
            yield [[name] * len(own), list(own)]

    found = common.materialize(common.mapped(docs.select(F.col("text").cast("string").alias("text")), run, "kind string, value string").where(F.length("value") <= LONGEST).distinct())
    matched = found.where(F.col("kind").isin(*KINDS))
    samples = {}
    for kind in (*KINDS, *ORDINARY):
        rows = found.where(F.col("kind") == kind).select("value")
        if kind in ORDINARY:
            rows = rows.join(matched.select("value").distinct(), "value", "left_anti")
        samples[kind] = [r["value"] for r in rows.orderBy(F.xxhash64("value"), "value").limit(sample).collect()]
    common.release(found)
    return samples


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and the spans (kind, start, end) of each row of ``docs`` (doc_id, text): code points, end exclusive.

    Kinds are those of the patterns and, for what the automata add, ``format_`` before the kind. In order of start, then kind.
    A null or empty text has none; repeated rows are scanned each; an empty table gives none. With no labelled
    credential at all, nothing is added to the patterns' matches. Texts of any length are searched whole. Other columns
    are left out, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Formats(labelled(docs, sample)))
    named = [*KINDS, *(f"format_{k}" for k in KINDS)]

    def run(batches):
        formats = sent.value
        own = np.array([KINDS.index(k) + len(KINDS) for k in formats.kinds] + [-1])
        for batch in common.slices(batches, "text"):
            texts = common.strings(batch.column("text"))
            hints = hinted(texts)
            owner, number, distinct = candidates(texts)
            kind = own[formats.kind_of(distinct)]
            hit = kind[number] >= 0 if len(number) else np.zeros(0, bool)
            marked = np.zeros(len(texts), bool)
            marked[owner[hit]] = True
            said = {v: int(k) for v, k in zip(distinct.filter(pa.array(kind >= 0)).to_pylist(), kind[kind >= 0], strict=True)}
            spans: list[list[dict]] = [[] for _ in range(len(texts))]
            for k in np.flatnonzero(hints.any(axis=1) | marked):
                text = texts[int(k)].as_py()
                found = [(start, n, end) for start, n, end, _ in base_spans(text, tuple(x for x, h in zip(KINDS, hints[k], strict=True) if h))]
                if marked[k]:
                    found += added(text, found, said)
                spans[k] = [{"kind": named[n], "start": start, "end": end} for start, n, end in sorted(found)]
            yield [batch.column("doc_id"), spans]

    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return common.mapped(kept, run, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind: string, start: int, end: int>>")


def added(text: str, base: list[tuple[int, int, int]], said: dict[str, int]) -> list[tuple[int, int, int]]:
    """The candidates of a text that are credentials and overlap none of its pattern matches."""
    covered: list[list[int]] = []
    for start, _, end in sorted(base):
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    found, at = [], 0
    for m in CANDIDATE.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        if m.group() in said and (at == len(covered) or covered[at][0] >= m.end()):
            found.append((m.start(), said[m.group()], m.end()))
    return found


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(of(*KINDS)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
