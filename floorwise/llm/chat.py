"""Chat formatting of reply trees.

Messages are nodes with parents. Iterative self-joins double the reach of every node's
pointer to an ancestor, adding scores and depths on the way, until all have passed their
root. Leaves are ranked by their branch's score; the chosen leaves' paths are
enumerated by the same pointers, doubling again, and each path becomes one conversation.

The template marks turns as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a
backslash follows the first character of every control string, and backslashes are doubled,
so no text can close or open a turn and escaping can be undone. The loss mask covers each
assistant text, without its markers.

Defined results: a null text or role is empty, a null score is 0, and a null conversation is
one of its own; a parent that is not there makes its node a root, and so does the smallest
node of a cycle; of rows with the same node id in a conversation the first by parent, role,
text and score is the node. ``linear`` numbers the rows of a table itself, by turn, then role,
then text, so ties and repeated rows all stay. Texts of any length stay whole; other columns
are not passed on; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floorwise.llm.shared import Written

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of widespread chat templates.
CONTROLS = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile(r"\\|(?=" + "|".join(map(re.escape, CONTROLS)) + ").", re.DOTALL)
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + "(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "0" else m[1], text)


def formatted(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[list[int]]]:
    """The text of a conversation and the spans of code points under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace('\n', '\\0')}\n", escape(text)
        if role == learned:
            spans.append([at + len(head), at + len(head) + len(body)])
        parts += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns that a formatted text holds."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def linear(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as trees of one branch, every row answering the one before it."""
    order = Window.partitionBy("conversation").orderBy("turn", "role", "text")
    named = rows.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = named.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("conversation", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def unique_nodes(rows: DataFrame) -> DataFrame:
    """One row for each node id of a conversation: the first by parent, role, text and score."""
    first = F.min(F.struct(F.col("parent").isNull(), "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")).alias("first")
    return rows.groupBy("conversation", "node").agg(first).select("conversation", "node", "first.parent", "first.role", "first.text", "first.score")


def _roots_of_cycles(nodes: DataFrame, on_cycles: DataFrame) -> DataFrame:
    """(c, n): the smallest node of each cycle; ``on_cycles`` are the nodes (c, n) that cycles are made of."""
    own = nodes.join(on_cycles, F.col("conversation").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left_semi")
    now = Written(own.select(F.col("conversation").alias("c"), F.col("node").alias("n"), F.col("parent").alias("above"), F.col("node").alias("least")), "cycles")
    for _ in range(now.df.count().bit_length()):  # reach doubles
        far = now.df.select(F.col("c").alias("d"), F.col("n").alias("m"), F.col("above").alias("farther"), F.col("least").alias("other"))
        step = now.df.join(far, F.col("c").eqNullSafe(F.col("d")) & (F.col("above") == F.col("m")))
        following = Written(step.select("c", "n", F.col("farther").alias("above"), F.least("least", "other").alias("least")), "cycles")
        now.discard()
        now = following
    return now.df.where("n = least").select("c", "n")


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(conversation, leaf, rank, node, back) of the ``branches`` best root-to-leaf paths.

    ``nodes``: conversation, node, parent, score, ids unique in a conversation. A branch
    scores the mean of its nodes; of equal branches the one with the smaller leaf comes first.
    ``back`` counts from the leaf.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    known = nodes.select(F.col("conversation").alias("c"), F.col("node").alias("n"))
    first = nodes.select("conversation", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    first = first.join(known, same("conversation", "c") & (F.col("parent") == F.col("n")), "left")
    jumps = [Written(first.select("conversation", "node", F.col("n").alias("above"), "total", F.lit(1).cast("long").alias("depth")), "jumps")]
    parents = jumps[0].df.where("above is not null").select(F.col("conversation").alias("c"), F.col("above").alias("n")).distinct()
    leaves = jumps[0].df.join(parents, same("conversation", "c") & (F.col("node") == F.col("n")), "left_anti").select("conversation", "node")
    most = jumps[0].df.count().bit_length() + 1  # reach doubles, and no path has more nodes than there are
    while not jumps[-1].df.where("above is not null").isEmpty():
        if len(jumps) > most:  # what has not passed a root by now points to nodes of cycles, and to all of them
            on_cycles = jumps[-1].df.where("above is not null").select(F.col("conversation").alias("c"), F.col("above").alias("n")).distinct()
            roots = Written(_roots_of_cycles(nodes, on_cycles), "roots").df.withColumn("cut", F.lit(True))
            cut = nodes.join(roots, same("conversation", "c") & (F.col("node") == F.col("n")), "left")
            return paths(cut.select("conversation", "node", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"), "score"), branches)
        now = jumps[-1].df.where("above is not null")
        ended = [j.df.where("above is null") for j in jumps]
        far = reduce(DataFrame.unionByName, ended, now)
        far = far.select(F.col("conversation").alias("c"), F.col("node").alias("n"), F.col("above").alias("farther"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        step = now.join(far, same("conversation", "c") & (F.col("above") == F.col("n")))  # only nodes that have not passed their root
        step = step.select("conversation", "node", F.col("farther").alias("above"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("deeper")).alias("depth"))
        jumps.append(Written(step, "jumps"))
    scores = reduce(DataFrame.unionByName, [j.df.where("above is null") for j in jumps])
    scores = scores.select(F.col("conversation").alias("c"), F.col("node").alias("n"), (F.col("total") / F.col("depth")).alias("branch_score"))
    scored = leaves.join(scores, same("conversation", "c") & same("node", "n"))
    ranks = Window.partitionBy("conversation").orderBy(F.desc("branch_score"), "node")
    chosen = scored.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= branches)
    found = chosen.select("conversation", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("back"))
    for k, jump in enumerate(jumps[:-1]):
        up = jump.df.where("above is not null").select(F.col("conversation").alias("c"), F.col("node").alias("n"), "above")
        farther = found.join(up, same("conversation", "c") & (F.col("node") == F.col("n")))
        found = Written(found.unionByName(farther.select("conversation", "leaf", "rank", F.col("above").alias("node"), (F.col("back") + (1 << k)).alias("back"))), "paths").df
    return found


def conversations(nodes: DataFrame, branches: int = 1, learned: str = "assistant", unique: bool = False) -> DataFrame:
    """One row per chosen path: conversation, leaf, rank, formatted text and loss spans.

    ``unique`` says that no node id repeats in a conversation, as in what ``linear`` gives.
    """
    if not unique:
        nodes = Written(unique_nodes(nodes), "nodes").df
    of_path = paths(nodes, branches)
    texts = nodes.select(F.col("conversation").alias("c"), F.col("node").alias("n"), "role", "text")
    turns = of_path.join(texts, F.col("conversation").eqNullSafe(F.col("c")) & F.col("node").eqNullSafe(F.col("n")))
    turn = F.struct((-F.col("back")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conversation", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # one conversation's texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                few = batch.slice(i, 64)
                done = [formatted([(t["role"], t["text"]) for t in turns], learned) for turns in few.column("turns").to_pylist()]
                columns = [few.column(c) for c in ("conversation", "leaf", "rank")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.list_(pa.int64())))], ["conversation", "leaf", "rank", "formatted", "loss_spans"])

    kind = dict(nodes.dtypes)
    return gathered.mapInArrow(run, f"conversation {kind['conversation']}, leaf {kind['node']}, rank int, formatted string, loss_spans array<array<bigint>>")
