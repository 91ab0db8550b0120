"""Fill-in-the-middle: a text is cut in three and put together as prefix, suffix, middle or suffix, prefix, middle.

A cut falls between units (runs of letters, any other character alone). A batch of texts is one bitvector over its UTF-8
bytes, where a set bit says that a unit begins there; a second one marks the bytes that begin a code point. Both are
packed into 64-bit words under a directory of popcounts (``Bits``). So a text's number of units is a difference of two
ranks, a cut before unit ``r`` is a select, and the lengths in code points are ranks of the cuts: a look into the directory
and one word each, whatever the length of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import common

#: Fixed by the contract: the marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WORD_BITS, BLOCK_WORDS = 64, 8
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class Bits:
    """A packed bitvector with the popcounts before each block, and before each word within its block."""

    def __init__(self, bits: np.ndarray) -> None:
        self.size = len(bits)
        n_blocks = self.size // (WORD_BITS * BLOCK_WORDS) + 1
        packed = np.zeros(n_blocks * BLOCK_WORDS * WORD_BITS // 8, np.uint8)
        packed[: (self.size + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        counts = np.bitwise_count(self.words).reshape(n_blocks, BLOCK_WORDS).astype(np.int64)
        self.inside = np.cumsum(counts, axis=1) - counts
        self.blocks = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of set bits before each place (0 to ``size``)."""
        word, low = at // WORD_BITS, (at % WORD_BITS).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << low) - np.uint64(1))
        return self.blocks[word // BLOCK_WORDS] + self.inside.ravel()[word] + np.bitwise_count(below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Place of the set bit with ``nth`` others before it; ``size`` where there is none."""
        found = np.full(len(nth), self.size, np.int64)
        there = np.flatnonzero(nth < self.blocks[-1])
        block = np.searchsorted(self.blocks, nth[there], side="right") - 1
        rest = nth[there] - self.blocks[block]
        word = (self.inside[block] <= rest[:, None]).sum(axis=1) - 1
        rest -= self.inside[block, word]
        word += block * BLOCK_WORDS
        single = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, WORD_BITS // 8), axis=1, bitorder="little")
        found[there] = word * WORD_BITS + np.argmax(np.cumsum(single, axis=1) == rest[:, None] + 1, axis=1)
        return found


def boundaries(texts: pa.Array) -> tuple[Bits, Bits, np.ndarray, np.ndarray]:
    """Of large strings: where units begin, where code points begin, the bytes, and the offset of each text (and the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    letter, points = _LETTER[data], (data & 0xC0) != 0x80
    follows = np.concatenate([[False], letter[:-1]]) if len(data) else letter
    follows[offsets[:-1][np.diff(offsets) > 0]] = False
    return Bits(points & ~(letter & follows)), Bits(points), data, offsets


def draws(doc_id, seed: int) -> list[int]:
    """Four numbers of 32 bits from the SHA-256 of ``seed:doc_id``; a null id is an empty one."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(docs: DataFrame, fim_percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form (``plain``, ``psm`` or ``spm``), prefix_chars and middle_chars (code points, null where
    plain) and the output text of every row of ``docs`` (doc_id, text).

    A null text is an empty one; an empty text, and one that holds a mark itself, stays plain. What happens to a text
    depends on its id and itself only, so repeated rows come out alike and reruns agree; rows without an id share their
    draws. An empty table gives none. Texts of any length are handled whole. Other columns are left out, whatever their names.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches):
        for batch in common.slices(batches, "text"):
            units, points, data, offsets = boundaries(common.strings(batch.column("text")))
            drawn = np.array([draws(x, seed) for x in batch.column("doc_id").to_pylist()], np.int64).reshape(-1, 4)
            start, end = offsets[:-1], offsets[1:]
            before = units.rank(start)
            n = units.rank(end) - before
            first, second = np.minimum(drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)), np.maximum(drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1))
            cut, stop = (np.where(r < n, units.select(before + r), end) for r in (first, second))
            chars = [points.rank(b) - points.rank(a) for a, b in ((start, cut), (cut, stop))]
            forms, outputs = [], []
            for k in range(len(n)):
                text = data[start[k] : end[k]].tobytes()
                if not text or drawn[k, 2] % 100 >= fim_percent or any(x in text for x in marks):
                    forms.append("plain")
                    outputs.append(text)
                    continue
                a, b = cut[k] - start[k], stop[k] - start[k]
                forms.append("spm" if drawn[k, 3] % 100 < spm_percent else "psm")
                outputs.append(b"".join((s, text[b:], p, text[:a], m, text[a:b]) if forms[-1] == "spm" else (p, text[:a], s, text[b:], m, text[a:b])))
            cut_up = np.array([f == "plain" for f in forms], bool)
            yield [batch.column("doc_id"), n, forms, *(pa.array(x, pa.int64(), mask=cut_up) for x in chars), pa.array(outputs, pa.binary()).cast(pa.string())]

    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return common.mapped(kept, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from. No part holds a mark, so each mark's first place is where it was put."""
    said = {"psm": (PREFIX, SUFFIX), "spm": (SUFFIX, PREFIX)}

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(output))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(output))

    prefix, suffix, middle = parts(*said["psm"])
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(*said["spm"])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


ORACLE = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
           sha256(concat('1:', coalesce(doc_id::VARCHAR, ''))) AS h
    FROM documents),
drawn AS (
    SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
           ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
    FROM cut),
formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
parts AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
    FROM formed)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(common.table(spark, sf_dir, "documents"))
    text = restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))
