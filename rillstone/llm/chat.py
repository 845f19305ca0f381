"""Chat formatting from reply trees.

Messages are nodes with a parent.  Iterative self-joins double each node's known way up (pointer jumping), so a tree of
depth D takes log2(D) joins; they give every leaf its root, its path's length and score.  Branches are ranked by mean
score, and the chosen root-to-leaf paths are enumerated from the jump tables and written as one conversation each.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside texts and roles every ``<`` + n backslashes +
``|`` gets one backslash more, so no control string can occur there and reading back is exact; a role's backslashes and
line ends are escaped besides.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.common import drop, written

START, END = "<|im_start|>", "<|im_end|>"
_LOW = -(1 << 63)
_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escaped(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role), flags=re.S)


def formatted(turns: list[tuple[str | None, str | None]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """(conversation, spans of code points under the loss mask: the texts of the role ``learn``)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role or '')}\n", escaped(text or "")
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(conversation: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(conversation):
        if m.start() != at:
            break
        turns.append((_unrole(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(conversation):
        raise ValueError("not a formatted conversation")
    return turns


def linear_tree(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (tree, node, parent, score, role, text): each turn answers the one before.

    Turns are in order of turn (null first), role, text; equal rows follow one another.  A null conv_id is a tree of its own.
    """
    key = F.coalesce(F.col("conv_id").cast("long"), F.lit(_LOW)).alias("tree")
    base = rows.select(key, F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return base.withColumn("node", node).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def best_paths(nodes: DataFrame, per_root: int = 1) -> DataFrame:
    """nodes(tree, node, parent, score) -> (tree, leaf, rank, node, up): the nodes of the chosen paths; up counts from the leaf.

    A parent that isn't there makes its child a root.  Ties in mean score go to the smaller leaf.  Null scores count 0; nodes
    are unique inside a tree; a cycle is an error.
    """
    base = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    first = base.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("hops"), F.col("node").alias("root"))
    tables = [written(first, "ways")]
    limit = max(1, tables[0].count()).bit_length() + 1
    going, done = tables[0].filter("up is not null"), tables[0].filter("up is null")
    while not going.isEmpty():  # only nodes that haven't reached their root join again
        if len(tables) > limit:
            raise ValueError("the replies of a tree form a cycle")
        above = going.union(done).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("hops").alias("hops2"), F.col("root").alias("root2"))
        more = going.join(above, ["tree", "up"])
        tables.append(written(more.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("root2").alias("root")), "ways"))
        going, done = tables[-1].filter("up is not null"), done.union(tables[-1].filter("up is null"))
    parents = tables[0].filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = done.join(parents, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree", "root").orderBy(F.desc(F.col("total") / F.col("hops")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_root)
    members = chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(tables) - 2, -1, -1):
        # each is 2**k messages up
        jump = tables[k].filter("up is not null").select("tree", "node", F.col("up").alias("above"))
        jumped = members.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        members = written(members.union(jumped), "members")
    for t in tables if len(tables) > 1 else ():  # members is a table of its own then
        drop(t)
    return members


def conversations(nodes: DataFrame, per_root: int = 1, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, text, loss_spans, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    One row for each chosen path of nodes(tree, node, parent, score, role, text); digests are taken from the text as
    read back and from its spans.  Null roles and texts count as empty.  A path is one value and so one task's memory.
    """
    paths = best_paths(nodes, per_root)
    met = paths.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = met.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    schema = "tree long, leaf long, rank int, text string, loss_spans array<struct<`from`:bigint,`to`:bigint>>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["tree", "leaf", "rank", "text", "loss_spans", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in rows:
            for start in range(0, batch.num_rows, 256):
                out = []
                for tree, leaf, rank, turns in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    text, spans = formatted([(t["role"], t["text"]) for t in turns], learn)
                    back = read_back(text)
                    loss = "".join(unescaped(text[a:b]) for a, b in spans)
                    said = "".join(f"{r}\n{t}\n" for r, t in back)
                    out.append((tree, leaf, rank, text, [{"from": a, "to": b} for a, b in spans], len(back), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return turns.mapInArrow(run, schema)


def formatted_conversations(rows: DataFrame) -> DataFrame:
    """One formatted conversation for each conv_id of a conversations table (see ``linear_tree`` and ``conversations``)."""
    nodes = written(linear_tree(rows), "turns")
    out = conversations(nodes)
    return out.select(F.when(F.col("tree") != _LOW, F.col("tree")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: DuckDB SQL of op1 over ``conversations``; the template is part of it.
CHAT_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r, text as t from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok', 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok', 'assistant', '<|im_end|><|im_start|>assistant ok'
), grouped as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r nulls first, t nulls first) as said,
    coalesce(string_agg(text, '' order by turn nulls first, r nulls first, t nulls first) filter (role = 'assistant'), '') as loss,
    sum(length('<|im_start|><|im_end|>') + 2 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::bigint as formatted_chars
  from turns group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from grouped
"""
