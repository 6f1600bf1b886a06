"""Chat formatting of reply trees.

Iterated self-joins list every root-to-leaf path of a message forest, paths are ranked
within their tree by score, and each chosen path becomes one formatted conversation
with the spans that carry loss. The template is reversible: whatever a text holds, the
turns are read back exactly.

A turn is ``### Name: text</turn>`` and a line feed. Within names and texts a backslash
is put before every backslash, ``###``, ``</turn>`` and (in names) ``:`` or line feed,
so an unescaped marker only ever comes from the template.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_table, table

START, MID, END = "### ", ": ", "</turn>\n"
_TITLES = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {v: k for k, v in _TITLES.items()}
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
FORMATTED = "formatted string, loss_spans array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _name(role: str) -> str:
    # names that aren't one of the three are marked, so that "Assistant" and "assistant" differ
    return _TITLES.get(role) or "=" + escape(role).replace(":", "\\:")


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the code-point spans of its assistant texts, as they stand there (escaped)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + _name(role) + MID, escape(text)
        parts += (head, body, END)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The inverse of ``format_turns``; raises ValueError on text that it can't have made."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = unescape(m[1][1:]) if m[1][:1] == "=" else _ROLES[m[1]]
        out.append((role, unescape(m[2])))
        at = m.end()
    return out


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, dist, node): the nodes on the path to every leaf; dist counts from the leaf up.

    messages: (tree, node, parent, ...), one row per node of a tree. Every round doubles
    the paths: rows are joined to the ancestor 2^k above, and that table is joined to
    itself, so a path of n nodes takes log2(n) rounds and no row holds a whole path. A
    parent that doesn't exist makes its child a root. Nodes on a cycle reach no root
    and have no leaf; they make no path.
    """
    nodes = messages.select("tree", "node", "parent")
    parents = nodes.select("tree", F.col("node").alias("up"))
    up = nodes.select("tree", "node", F.col("parent").alias("up")).join(parents, ["tree", "up"]).select("tree", "node", "up")
    most = nodes.count()
    jumps = []  # the k-th table: every node's ancestor 2^k above, where it has one
    while not (up := shared_table(up, "up")).isEmpty() and 2 ** len(jumps) < 2 * most:
        jumps.append(up)
        above = up.select("tree", F.col("node").alias("up"), F.col("up").alias("_far"))
        up = up.join(above, ["tree", "up"]).select("tree", "node", F.col("_far").alias("up"))
    leaves = nodes.join(jumps[0].select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti") if jumps else nodes
    # a node with an ancestor further up than there are nodes never reaches a root
    leaves = leaves.join(up.select("tree", "node"), ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("dist"), "node")
    for k, jump in enumerate(jumps):
        ahead = paths.join(jump, ["tree", "node"]).select("tree", "leaf", (F.col("dist") + 2**k).alias("dist"), F.col("up").alias("node"))
        paths = shared_table(paths.unionByName(ahead), "paths")
    return paths


def _format_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made = [format_turns([(m["role"], m["text"]) for m in turns]) for turns in pdf["_turns"]]
        out = pdf.drop(columns="_turns")
        out["formatted"] = [f for f, _ in made]
        out["loss_spans"] = [[{"start": a, "end": b} for a, b in spans] for _, spans in made]
        yield out


def format_trees(messages: DataFrame, top_k: int | None = None) -> DataFrame:
    """(tree, leaf, score, branch, formatted, loss_spans): one row per chosen path.

    messages: (tree, node, parent, role, text, score); further columns are ignored. Nodes
    are unique within a tree. A path's score is the mean of its nodes' scores (null: 0);
    branches count from 1 by falling score, ties by leaf; top_k None keeps all. Null roles
    and texts are empty. A path becomes one value in one row, so a single conversation is
    held by one task; many trees or many branches are spread. Empty input gives no rows.
    """
    paths = root_to_leaf_paths(messages)
    said = messages.select("tree", "node", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    # branches are ranked without their texts, which are shuffled to their path and no further
    scored = paths.join(said.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    scored = scored.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if top_k is not None:
        scored = scored.where(F.col("branch") <= top_k)
        paths = paths.join(scored.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    turn = F.struct((-F.col("dist")).alias("at"), "role", "text")
    whole = paths.join(said, ["tree", "node"]).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("_turns")).join(scored, ["tree", "leaf"])
    schema = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in ("tree", "leaf", "score", "branch"))
    return whole.select("tree", "leaf", "score", "branch", "_turns").mapInPandas(_format_rows, f"{schema}, {FORMATTED}")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees with one branch: each row answers the one before it.

    Rows with equal turns (and repeated rows) are all kept, ordered by role, then text; a
    null turn comes first. Null conv_id is a conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    nth = F.row_number().over(order).cast("long")
    out = conversations.select("conv_id", "role", "text", nth.alias("node"))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return out.select(tree.alias("tree"), "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a reader of the formatted text gets back."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for pdf in batches:
        rows = []
        for tree, formatted, spans in zip(pdf["tree"], pdf["formatted"], pdf["loss_spans"], strict=True):
            turns = read_turns(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            rows.append((None if tree == "null" else int(tree), len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
        out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        yield out.astype({"conv_id": "Int64"})


def op1_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    made = format_trees(shared_table(linear_messages(conversations.unionByName(added)), "messages"))
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return made.select("tree", "formatted", "loss_spans").mapInPandas(_digests, schema)


_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), esc AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS n_text,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
      ELSE 1 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) END AS n_role
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + n_role + 14) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""

QUERIES = {"op1_reply_trees": op1_reply_trees}
ORACLES = {"op1_reply_trees": _SQL}
