"""Best-fit packing of tokenised documents into sequences by the linear grouping scheme.

Only documents longer than a sequence are cut. Lengths are at most ``capacity``, so the histogram of lengths is small
whatever the corpus is, and pieces of one length are interchangeable: the whole plan is made on the histogram.

1. Pieces longer than a share of the capacity are large. Sorted by length, they are split into groups of equal
   cardinality; in each group the lengths are rounded up to the group's largest.
2. Over these few sizes, the configuration programme (fewest sequences covering every group) is solved by a revised
   simplex that prices every configuration (few, as each holds a few large pieces). The solution is rounded down; what remains is packed by best fit decreasing.
3. Actual pieces take the places of their group. They are shorter than the places, which leaves room.
4. The small pieces, largest first, go by best fit into the room that is left, then into new sequences.

The plan is a list of runs "so many pieces of this length, from this rank on, go to these sequences at this offset",
bounded by the capacity and the number of groups. Pieces get their rank among those of their length by a salted window
and meet the runs in an equi-join on the length.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import common

CAPACITY, END_ID, GROUPS, LARGE_SHARE, CACHED_WORDS, BLOCK, JOINED, SIGNS = 4096, 1, 12, 1 / 4, 600_000, 16384, 512, ".,;:!?"

_held: dict = {}


#: The settings of a tokenizer with which white space parts a text for good and letters have no case.
_PARTING = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


class _Encoder:
    """Ids of texts, a distinct chunk between white space encoded once.

    A tokenizer with the settings of ``_PARTING`` drops white space and never joins what stands on its two sides, so the
    ids of a text are those of its chunks in turn. Chunks are kept over batches and tasks of a worker, up to
    ``CACHED_WORDS``. With any other settings whole texts are encoded.

    Where the model marks the ends of words, new words of plain letters are encoded ``JOINED`` to a text, as a text of its own
    costs more than its word; the marks part their ids again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.parts = (settings["normalizer"], settings["pre_tokenizer"]) == _PARTING
        self.closing = None
        if suffix := settings["model"].get("end_of_word_suffix"):
            vocabulary = self.tokenizer.get_vocab()
            self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closing[[k for x, k in vocabulary.items() if x.endswith(suffix)]] = True
        self.known: dict[str, int] = {}
        self.ids, self.ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]

    @staticmethod
    def plain(chunk: str) -> bool:
        return chunk.isalpha() and (chunk.isascii() or max(chunk) < "İ")

    @staticmethod
    def split(chunk: str) -> tuple[str, str]:
        """A chunk of plain letters and its closing sign are encoded apart, and plain letters in lower case, as the
        tokenizer does: fewer distinct chunks. Others stay whole."""
        body, sign = (chunk[:-1], chunk[-1]) if chunk[-1] in SIGNS else (chunk, "")
        if _Encoder.plain(body):
            return body.lower(), sign
        return chunk, ""

    def rows(self, chunks: list[str]) -> list[int]:
        """Places in the table of kept chunks."""
        fresh = [x for x in dict.fromkeys(chunks) if x not in self.known]
        if len(self.known) + len(fresh) > CACHED_WORDS and self.known:
            self.known, self.ids, self.ends = {}, [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
            fresh = list(dict.fromkeys(chunks))
        if fresh:
            blocks, sizes, done, others = [], [], [], fresh
            # the tokenizer's own results take far more memory than the ids, so a block of them is held at a time
            if self.closing is not None:
                words = [x for x in fresh if self.plain(x)]
                others = [x for x in fresh if not self.plain(x)]
                for at in range(0, len(words), BLOCK):
                    block = words[at : at + BLOCK]
                    texts = [" ".join(block[k : k + JOINED]) for k in range(0, len(block), JOINED)]
                    ids = np.fromiter(chain.from_iterable(x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
                    stops = np.flatnonzero(self.closing[ids]) + 1
                    if len(stops) != len(block):  # a word without its mark: each on its own
                        others += block
                        continue
                    sizes.append(np.diff(stops, prepend=0))
                    blocks.append(ids)
                    done += block
            fresh = done + others
            for at in range(0, len(others), BLOCK):
                encoded = [x.ids for x in self.tokenizer.encode_batch_fast(others[at : at + BLOCK], add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, encoded), np.int64, len(encoded)))
                blocks.append(np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes[-1].sum())))
            self.ids = [np.concatenate([*self.ids, *blocks])]
            self.ends = [np.concatenate([self.ends[0], self.ends[0][-1] + np.cumsum(np.concatenate(sizes))])]
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        return [self.known[x] for x in chunks]

    def places(self, chunks: pa.Array) -> np.ndarray:
        """Places of the two parts of distinct chunks. ASCII words are split as by ``split`` and told apart in Arrow, so those that
        differ by case or sign are looked up once."""
        import pyarrow.compute as pc

        easy = pc.match_substring_regex(chunks, f"^[A-Za-z]+[{SIGNS}]?$")
        lower = pc.ascii_lower(chunks.filter(easy))
        bodies = pc.ascii_rtrim(lower, characters=SIGNS).dictionary_encode()
        signs = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(lower, -1), value_set=pa.array(list(SIGNS), lower.type)), len(SIGNS))
        names = [*bodies.dictionary.to_pylist(), *SIGNS, ""]
        others = [self.split(x) if x else ("", "") for x in chunks.filter(pc.invert(easy)).to_pylist()]
        rows = np.array(self.rows([*names, *(x for pair in others for x in pair)]), np.int64)
        found, is_easy = np.empty((len(chunks), 2), np.int64), easy.to_numpy(zero_copy_only=False)
        found[is_easy, 0] = rows[np.asarray(bodies.indices)]
        found[is_easy, 1] = rows[len(bodies.dictionary) + np.asarray(signs)]
        found[~is_easy] = rows[len(names) :].reshape(-1, 2)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text ends among them."""
        if not self.parts:
            encoded = [x.ids for x in self.tokenizer.encode_batch_fast(common.strings(texts).to_pylist(), add_special_tokens=False)]
            return np.fromiter((x for ids in encoded for x in ids), np.uint32), np.cumsum([0, *map(len, encoded)])
        offsets, codes, distinct = common.tokenize(texts, lower=False)
        rows = self.places(distinct)[codes].ravel()
        begins = self.ends[0][:-1][rows]
        lengths = self.ends[0][1:][rows] - begins
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[0][np.repeat(begins - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[2 * offsets]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null or empty text has the end id only. A repeated row gives its pieces again. Other columns are left out.
    """

    def run(batches):
        if tokenizer_path not in _held:
            _held.clear()
            _held[tokenizer_path] = _Encoder(tokenizer_path)
        encoder = _held[tokenizer_path]
        for batch in common.slices(batches, "text", 8 << 20):
            ids, ends = encoder.encode(batch.column("text"))
            docs_of, number, start, length, crc, kept = [], [], [], [], [], []
            for k, doc in enumerate(batch.column("id").to_pylist()):
                own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id)).astype("<u4")
                for n, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    docs_of.append(doc)
                    number.append(n)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            yield [docs_of, number, start, length, crc, *([kept] if with_ids else [])]

    kind = dict(docs.dtypes)[id_col]
    return common.mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# --- the plan, on the histogram ---


def _all_configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """Every set of rounded sizes that fits, as counts by size. Large pieces exceed a share of the capacity, so a
    configuration holds a few, and their number does not depend on the corpus."""
    found: list[list[int]] = []

    def extend(chosen: list[int], start: int, left: int) -> None:
        for g in range(start, len(sizes)):
            if sizes[g] <= left:
                found.append([*chosen, g])
                extend(found[-1], g, left - sizes[g])

    extend([], 0, capacity)
    counts = np.zeros((len(found), len(sizes)), np.int16)
    for k, chosen in enumerate(found):
        for g in chosen:
            counts[k, g] += 1
    return counts


def _configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1000) -> list[tuple[list[int], int]]:
    """Configurations and how often each is used, rounded down from the optimum of the configuration programme."""
    n, every = len(sizes), _all_configurations(sizes, capacity)
    basis = np.diag([float(capacity // s) for s in sizes])
    b = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = inverse @ b
        values = every @ np.maximum(np.ones(n) @ inverse, 0)
        column = every[int(np.argmax(values))].astype(float)
        if values.max() <= 1 + 1e-7:
            break
        move = inverse @ column
        ratios = np.where(move > 1e-9, np.maximum(x, 0) / np.where(move > 1e-9, move, 1), np.inf)
        leave = int(np.argmin(ratios))
        if not np.isfinite(ratios[leave]):
            break
        basis[:, leave] = column
    x = np.linalg.inv(basis) @ b
    found = [([int(round(v)) for v in basis[:, k]], int(np.floor(x[k] + 1e-9))) for k in range(n)]
    return [(c, m) for c, m in found if m > 0]


class _Room:
    """Sets of sequences with equal room, kept sorted by room; each set is (first sequence, how many)."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.sets: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, many: int) -> None:
        if room > 0 and many > 0:
            if room not in self.sets:
                bisect.insort(self.rooms, room)
                self.sets[room] = []
            self.sets[room].append((first, many))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        """Take out the set of the least room that holds ``length``."""
        k = bisect.bisect_left(self.rooms, length)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        first, many = self.sets[room].pop()
        if not self.sets[room]:
            del self.sets[room]
            del self.rooms[k]
        return room, first, many


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_share: float = LARGE_SHARE) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces to each sequence in turn, offset of the first)."""
    lengths = sorted((n for n, c in histogram.items() if c > 0), reverse=True)
    used: Counter = Counter()  # pieces of a length that have a place
    runs: list[tuple[int, int, int, int, int, int]] = []
    room = _Room()
    sequences = 0

    def place(length: int, pieces_: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], pieces_, first, each, offset))
        used[length] += pieces_

    def best_fit(length: int, left: int) -> None:
        nonlocal sequences
        while left:
            found = room.tightest(length)
            if found is None:
                each = min(capacity // length, left)
                many = left // each
                place(length, each * many, sequences, each, 0)
                room.add(capacity - each * length, sequences, many)
                sequences += many
                left -= each * many
                continue
            space, first, many = found
            each = min(space // length, left)
            full = min(many, left // each)
            place(length, each * full, first, each, capacity - space)
            room.add(space - each * length, first, full)
            room.add(space, first + full, many - full)
            left -= each * full

    large = [n for n in lengths if n > capacity * large_share]
    total = sum(histogram[n] for n in large)
    if total:
        # groups of equal cardinality, the largest first: (length, pieces) in falling length
        members: list[list[list[int]]] = []
        count, per = 0, -(-total // min(groups, total))
        for n in large:
            left = histogram[n]
            while left:
                if count % per == 0:
                    members.append([])
                take = min(left, per - count % per)
                members[-1].append([n, take])
                count += take
                left -= take
        sizes, demand = [g[0][0] for g in members], [sum(c for _, c in g) for g in members]
        merged: dict[int, list[int]] = {}
        for k, s in enumerate(sizes):
            merged.setdefault(s, []).append(k)
        keys = sorted(merged, reverse=True)
        queues = [[x for k in merged[s] for x in members[k]] for s in keys]
        for config, many in _configurations(keys, [sum(demand[k] for k in merged[s]) for s in keys], capacity):
            open_sets = [(sequences, many, 0)]  # first, how many, filled
            sequences += many
            for g, times in enumerate(config):
                for _ in range(times):
                    after = []
                    for first, m, filled in open_sets:
                        while m:
                            length, left = queues[g][0]
                            take = min(m, left)
                            place(length, take, first, 1, filled)
                            after.append((first, take, filled + length))
                            queues[g][0][1] -= take
                            if not queues[g][0][1]:
                                queues[g].pop(0)
                            first, m = first + take, m - take
                    open_sets = after
            for first, m, filled in open_sets:
                room.add(capacity - filled, first, m)
        for queue in queues:  # what the rounding left over
            for length, left in queue:
                best_fit(length, left)
    for n in lengths:
        if n <= capacity * large_share:
            best_fit(n, histogram[n])
    return runs


def pack(found: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``found`` (length and any other columns) with sequence_id and offset. It is read more than once: give a table.

    No rows give no rows. Pieces that agree in doc_id, piece, start and crc are interchangeable.
    """
    spark: SparkSession = found.sparkSession
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # lengths are 1 to capacity
    runs = plan(histogram, capacity, groups)
    table = spark.createDataFrame(pa.table({c: pa.array([r[k] for r in runs], pa.int64()) for k, c in enumerate(("_length", "_rank", "_pieces", "_first", "_each", "_offset"))}).to_pandas(), "_length long, _rank long, _pieces long, _first long, _each long, _offset long")
    order = ["_key", "doc_id", "piece", "start", "ids_crc32"]
    ranked = common.with_rank(found.withColumn("_key", F.xxhash64("doc_id", "piece", "ids_crc32")), ["length"], order, common.buckets_for(sum(histogram.values())), "_at")
    at = F.col("_at") - F.col("_rank")
    return (
        ranked.join(F.broadcast(table) if len(runs) <= 64 * capacity else table, (F.col("length") == F.col("_length")) & (at >= 0) & (at < F.col("_pieces")))
        .withColumn("sequence_id", F.col("_first") + F.expr("(_at - _rank) div _each"))
        .withColumn("offset", F.col("_offset") + (at % F.col("_each")) * F.col("length"))
        .drop("_key", "_at", "_length", "_rank", "_pieces", "_first", "_each", "_offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from packed pieces that carry their ids: sequence_id, ids, at most a capacity each."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(placed, lambda x: x["ids"])).alias("ids"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents with their places: the digest that the query and the pipeline's last stage return."""
    found = common.materialize(pieces(docs, tokenizer_path))
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
