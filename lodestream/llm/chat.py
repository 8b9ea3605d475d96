r"""Chat formatting of reply trees.

A message names its tree, its node and its parent node. Self-joins double the
distance that they span (one level, two, four ...), so a thread of any depth needs
a logarithmic number of joins. Every root-to-leaf path becomes a branch, branches of
a tree are ranked by the sum of their messages' scores (ties: smaller leaf), and each chosen
branch is written as one string.

Template: ``<turn ROLE>\nTEXT</turn>\n`` per message. Inside TEXT and ROLE a backslash
is doubled, ``</turn>`` becomes ``\e`` and ``<turn `` becomes ``\o``; in ROLE also ``>``
becomes ``\g`` and a line feed ``\n``. So the template's own marks occur nowhere else, and
:func:`parse` gives back what :func:`render` was given.

Defined cases: null role and null text are empty; a null tree key is a tree of its own; of
repeated (tree, node) pairs the row with the smallest (parent, role, text) counts; a
parent that isn't there makes its child a root; messages on or below a cycle have no root
and give no branch; an empty table gives an empty result. Further columns are ignored.
One branch is one output row, hence must fit into a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

OPEN, CLOSE = "<turn ", "</turn>"
_BACK = {"\\": "\\", "e": CLOSE, "o": OPEN, "g": ">", "n": "\n"}
_TURN = re.compile(r"<turn ([^>\n]*)>\n(.*?)</turn>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(CLOSE, "\\e").replace(OPEN, "\\o")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def render(turns: list[tuple[str, str]], learn: frozenset[str] = frozenset({"assistant"})) -> tuple[str, list[int]]:
    """The conversation as one string, and the loss mask: starts and ends (code points) of the learned texts."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head = f"{OPEN}{escape(role).replace('>', chr(92) + 'g').replace(chr(10), chr(92) + 'n')}>\n"
        body = escape(text)
        if role in learn:
            mask += [at + len(head), at + len(head) + len(body)]
        out += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation; raises ValueError on anything else."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def masked_text(formatted: str, mask: list[int]) -> str:
    """The text under the loss mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in zip(mask[::2], mask[1::2]))


def enumerate_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, node, parent) to (tree, leaf, node, up): every node of every root-to-leaf path."""
    nodes = cut(nodes, "chat-nodes")
    n = nodes.count()
    up = cut(
        nodes.select("tree", F.col("parent").alias("node"), F.col("node").alias("child"))
        .join(nodes.select("tree", "node"), ["tree", "node"])
        .select("tree", F.col("child").alias("node"), F.col("node").alias("anc")),
        "chat-up0",
    )
    levels = []
    while not up.isEmpty():
        levels.append(up)
        if 2 ** (len(levels) - 1) >= n:
            break
        far = up.select("tree", F.col("node").alias("anc"), F.col("anc").alias("far"))
        up = cut(up.join(far, ["tree", "anc"]).select("tree", "node", F.col("far").alias("anc")), f"chat-up{len(levels)}")
    inner = levels[0].select("tree", F.col("anc").alias("node")) if levels else nodes.select("tree", "node").limit(0)
    leaves = nodes.select("tree", "node").join(inner, ["tree", "node"], "left_anti")
    if levels and 2 ** (len(levels) - 1) >= n:
        leaves = leaves.join(levels.pop().select("tree", "node"), ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(levels) - 1, -1, -1):
        paths = cut(paths, f"chat-path{k}")
        further = paths.join(levels[k], ["tree", "node"]).select("tree", "leaf", F.col("anc").alias("node"), (F.col("up") + 2**k).alias("up"))
        paths = paths.unionByName(further)
    return paths


def format_trees(messages: DataFrame, best: int | None = None, learn: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """Format the ``best`` branches (all where None) of each tree.

    ``messages``: tree, node, parent, role, text, score. Returns tree, leaf, rank,
    path_score, n_turns, formatted, mask (array of long, starts and ends).
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit(""))
    kind = messages.schema["tree"].dataType
    rows = (
        messages.select(
            key.alias("tree"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
        )
        .filter(F.col("node").isNotNull())
        .groupBy("tree", "node")
        .agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
        .select("tree", "node", "m.*")
    )
    rows = cut(rows, "chat-messages")
    paths = cut(enumerate_paths(rows.select("tree", "node", "parent")), "chat-paths")
    if best is not None:
        ranks = paths.join(rows.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"))
        by = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
        ranks = ranks.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= best)
        paths = paths.join(ranks.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    turns = (
        paths.join(rows, ["tree", "node"])
        .groupBy("tree", "leaf")
        .agg(F.sum("score").alias("path_score"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct(F.negative("up").alias("at"), "role", "text"))).alias("turns"))
        .select("tree", "leaf", "path_score", "n_turns", "turns.role", "turns.text")
    )
    leaf_type = messages.schema["node"].dataType.simpleString()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [render(list(zip(r, t)), learn) for r, t in zip(b["role"], b["text"])]
            out = b[["tree", "leaf", "path_score", "n_turns"]].copy()
            out["formatted"], out["mask"] = [x[0] for x in done], [x[1] for x in done]
            yield out

    out = turns.mapInPandas(write, f"tree string, leaf {leaf_type}, path_score double, n_turns long, formatted string, mask array<long>")
    by = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
    tree = F.when(F.col("tree") != "", F.substring("tree", 2, 2**30)).cast(kind)
    if best is None:
        return out.withColumn("tree", tree)
    return out.withColumn("rank", F.row_number().over(by)).withColumn("tree", tree)


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from format_trees()'s output."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tree, text, mask in zip(b["tree"], b["formatted"], b["mask"]):
                turns, loss = parse(text), masked_text(text, list(mask))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((tree, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.select("tree", "formatted", "mask").mapInPandas(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def thread_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages: each turn replies to the one before it.

    Order is turn (null first), then role, then text; repeated rows stay repeated turns.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(by).cast("long")
    return rows.select(F.col("conv_id").alias("tree"), n.alias("node"), "role", "text").select("tree", "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
