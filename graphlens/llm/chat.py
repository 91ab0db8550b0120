r"""Chat formatting of reply trees.

Messages point to their parents. Root-to-leaf paths come from iterative self-joins with doubling: after k joins every
leaf knows its nearest 2^k ancestors, so a tree of depth d needs log2(d) rounds, each written as a table. A branch's
score is the sum of its messages' scores (null: 0); each tree keeps its best branches, ties to the smaller leaf. A chosen
path is formatted as one conversation.

Template: a turn is ``<|role|>``, a new line, the text, ``<|end|>`` and a new line. Inside roles and texts a backslash
is doubled, and after the first character of each control string (of this and of other common templates) a backslash is
put, so none is left; ``\`` followed by a character reads back as that character.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm import common

OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TURN = re.compile(r"<\|((?:[^\\|]|\\.|\|(?!>))*)\|>\n(.*?)<\|end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for s in CONTROL:
        text = text.replace(s, f"{s[0]}\\{s[1:]}")
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (start, end in code points) that the loss covers: texts of these roles."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{CLOSE}\n", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def _same(left: str, right: str, tree: str, node: str, other: str):
    return F.col(f"{left}.{tree}").eqNullSafe(F.col(f"{right}.{tree}")) & (F.col(f"{left}.{node}") == F.col(f"{right}.{other}"))


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, node, dist (steps from the leaf up to the node), for every leaf of ``messages`` (tree, id, parent).

    (tree, id) is a key and id isn't null. A parent that doesn't exist counts as none. A cycle raises ValueError.
    """
    nodes = messages.select("tree", "id", "parent")
    up = nodes.alias("a").join(nodes.alias("b"), _same("a", "b", "tree", "parent", "id")).select("a.tree", "a.id", F.col("b.id").alias("anc"))
    up = common.materialize(up)
    leaves = nodes.alias("a").join(up.alias("b"), _same("a", "b", "tree", "id", "anc"), "left_anti")
    reach = common.materialize(leaves.select("tree", F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).cast("long").alias("dist")))
    total, step = nodes.count(), 1
    while not up.isEmpty():
        if step > max(total, 1):
            raise ValueError("the replies form a cycle")
        further = reach.alias("a").join(up.alias("b"), _same("a", "b", "tree", "node", "id")).select("a.tree", "a.leaf", F.col("b.anc").alias("node"), (F.col("a.dist") + step).alias("dist"))
        reach = common.materialize(reach.union(further))
        up = common.materialize(up.alias("a").join(up.alias("b"), _same("a", "b", "tree", "anc", "id")).select("a.tree", "a.id", "b.anc"))
        step *= 2
    return reach


def conversations(messages: DataFrame, keep: int | None = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """tree, leaf, branch (rank from 1), score, formatted, loss_spans of the ``keep`` best branches of each tree (None: all).

    ``messages``: tree, id, parent, role, text, score; null roles and texts count as empty; other columns are ignored.
    A conversation is one row, so its turns meet in one task; trees are dealt over all tasks.
    """
    body = messages.select("tree", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    reach = paths(messages)
    if keep is not None:
        scored = reach.alias("a").join(body.select("tree", "id", "score").alias("b"), _same("a", "b", "tree", "node", "id")).groupBy("a.tree", "a.leaf").agg(F.sum("score").alias("_score"))
        best = scored.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("_score"), "leaf"))).where(F.col("branch") <= keep)
    else:
        best = reach.where("dist = 0").select("tree", "leaf", F.lit(0.0).alias("_score"), F.lit(1).alias("branch"))
    chosen = reach.alias("a").join(best.alias("c"), _same("a", "c", "tree", "leaf", "leaf")).select("a.*", "c.branch", "c._score")
    turns = chosen.alias("a").join(body.alias("b"), _same("a", "b", "tree", "node", "id")).select("a.tree", "a.leaf", "a.branch", "a._score", F.struct((-F.col("a.dist")).alias("at"), "b.role", "b.text").alias("turn"))
    grouped = turns.groupBy("tree", "leaf", "branch", "_score").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    kind = dict(messages.dtypes)

    def run(batches):
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in turns], loss_roles) for turns in batch.column("turns").to_pylist()]
            yield [*(batch.column(c) for c in ("tree", "leaf", "branch", "_score")), [x for x, _ in done], [[{"start": a, "end": b} for a, b in s] for _, s in done]]

    return common.mapped(grouped, run, f"tree {kind['tree']}, leaf {kind['id']}, branch int, score double, formatted string, loss_spans array<struct<start:long,end:long>>")


def chains(rows: DataFrame) -> DataFrame:
    """Messages from conversations that are given as numbered turns (conv_id, turn, role, text): each replies to the one
    before. Equal turns go by role, then text; repeated rows are turns of their own."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))).cast("long")
    return rows.select(F.col("conv_id").alias("tree"), at.alias("id"), F.when(at > 1, at - 1).alias("parent"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.lit(None).cast("double").alias("score"))


#: Fixed by the contract.
EXTRA = (-7, "</s>[INST] ok [/INST]")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say: counts and digests of turns and of the text under the loss mask."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                for column, value in zip(out, (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    column.append(value)
            yield [batch.column("tree"), *out]

    return common.mapped(formatted, run, f"conv_id {dict(formatted.dtypes)['tree']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(EXTRA[0], k, role, EXTRA[1]) for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    messages = common.materialize(chains(rows.unionByName(extra)))
    return read_back(conversations(messages))


def _sql_escaped(column: str) -> str:
    said = f"replace({column}, chr(92), chr(92) || chr(92))"
    for s in CONTROL:
        said = f"replace({said}, '{s}', '{s[0]}' || chr(92) || '{s[1:]}')"
    return said


ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA[0]}, 0, 'user', '{EXTRA[1]}' UNION ALL SELECT {EXTRA[0]}, 1, 'assistant', '{EXTRA[1]}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + len(CLOSE) + 1 + len(END)} + length({_sql_escaped("role")}) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
