"""Chat formatting of reply trees: every root-to-leaf path is a branch, branches are ranked by score, chosen ones become text.

Messages know their parent only. Self-joins double how far each message sees: after k rounds it knows its ancestor 2 ** k steps up, and
the score and number of messages on the way. When all have reached their root, each leaf's branch has its score and rank.
The chosen leaves then walk the same steps down from the longest, which lists the ancestors of all of them in as many joins. Texts
take part in the last join only.

The template marks turns with control strings. The same strings inside roles and texts, and those of other common templates, get a
backslash after their first character, and backslashes are doubled, so reading back gives the text exactly.

Defined cases: null roles and texts are empty. A parent counts only if it is an earlier message of the same tree; else the message is a
root, so no cycle can arise. A tree may have several roots. A null tree id is a tree. Branches of one score rank by their
leaf. Rows that repeat a message's id are one message, the one with the least role and text. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.llm.common import written

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
# Strings that may not stand in a text as they are: the start and end of this template's marks, and marks of other templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"


def escaped(text: str | Column) -> Column:
    out = F.replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def as_trees(conversations: DataFrame) -> DataFrame:
    """Turns of ``conv_id, turn, role, text`` as messages: each one answers the turn before. Equal turns go by role and text."""
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.withColumn("message", F.row_number().over(in_order).cast("bigint"))
    parent = F.when(F.col("message") > 1, F.col("message") - 1)
    return numbered.select(F.col("conv_id").alias("tree"), "message", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: DataFrame, b: DataFrame, tree: str, message: str) -> Column:
    return a["tree"].eqNullSafe(b[tree]) & (a["jump"] == b[message])


def reach_roots(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The jump tables ``tree, message, jump`` for 1, 2, 4, ... steps, and ``tree, message, total, depth`` of every message."""
    known = messages.select(F.col("tree").alias("of"), F.col("message").alias("up"))
    rooted = messages.select("tree", "message", F.when(F.col("parent") < F.col("message"), F.col("parent")).alias("jump"), F.coalesce("score", F.lit(0.0)).alias("total"))
    state = rooted.join(known, _same(rooted, known, "of", "up"), "left").select("tree", "message", F.col("up").alias("jump"), "total", F.lit(1).cast("bigint").alias("depth"))
    jumps = []
    while True:
        state = written(state, "reach")
        going = state.filter("jump IS NOT NULL")
        if going.isEmpty():
            return jumps, state.select("tree", "message", "total", "depth")
        jumps.append(going.select("tree", "message", "jump"))
        far = state.select(F.col("tree").alias("of"), F.col("message").alias("up"), F.col("jump").alias("next"), F.col("total").alias("more"), F.col("depth").alias("steps"))
        # only messages on their way join; those at their root are done
        stepped = going.join(far, _same(going, far, "of", "up")).select(
            "tree", "message", F.col("next").alias("jump"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("steps")).alias("depth"))
        state = state.filter("jump IS NULL").unionByName(stepped)


def ranked_branches(messages: DataFrame, reached: DataFrame, best: int | None) -> DataFrame:
    """``tree, leaf, branch_score, rank`` of every leaf, or of the ``best`` ones of each tree."""
    parents = messages.filter("parent < message").select(F.col("tree").alias("of"), F.col("parent").alias("up")).distinct()
    leaves = reached.join(parents, reached["tree"].eqNullSafe(parents["of"]) & (reached["message"] == parents["up"]), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("message"))
    ranked = leaves.select("tree", F.col("message").alias("leaf"), F.col("total").alias("branch_score"), F.row_number().over(order).alias("rank"))
    return ranked.filter(F.col("rank") <= best) if best else ranked


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """``tree, leaf, branch_score, rank, n_turns, formatted, loss_spans`` of the chosen branches.

    ``messages`` is ``tree, message, parent, role, text, score``. ``loss_spans`` lists first code point and code point after the last of
    every text under the loss mask: those of ``TRAINED_ROLE``.
    """
    single = messages.groupBy("tree", "message").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent", "score")).alias("m"))
    messages = written(single.select("tree", "message", "m.*"), "messages")
    narrow = messages.select("tree", "message", "parent", "score")
    jumps, reached = reach_roots(narrow)
    chosen = written(ranked_branches(narrow, reached, best), "branches")
    path = chosen.select("tree", "leaf", F.col("leaf").alias("message"))
    for table in reversed(jumps):
        step = table.select(F.col("tree").alias("of"), F.col("message").alias("at"), "jump")
        further = path.join(step, path["tree"].eqNullSafe(step["of"]) & (path["message"] == step["at"])).select("tree", "leaf", F.col("jump").alias("message"))
        path = written(path.unionByName(further), "path")  # each step reads the path twice: cut, or the plan doubles
    depths = reached.select(F.col("tree").alias("of"), F.col("message").alias("at"), "depth")
    placed = path.join(depths, path["tree"].eqNullSafe(depths["of"]) & (path["message"] == depths["at"])).select("tree", "leaf", "message", "depth")
    texts = messages.select(F.col("tree").alias("of"), F.col("message").alias("at"), "role", "text")
    turns = placed.join(texts, placed["tree"].eqNullSafe(texts["of"]) & (placed["message"] == texts["at"])).select(
        "tree", "leaf", "depth", (F.col("role") == TRAINED_ROLE).alias("trained"), F.concat(F.lit(TURN), escaped("role"), F.lit(SAYS)).alias("head"), escaped("text").alias("body"))
    whole = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    down = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(down), F.lit(0)) + F.char_length("head")
    spanned = whole.withColumn("start", start).withColumn("end", F.col("start") + F.char_length("body"))
    gathered = spanned.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "piece", "trained", "start", "end"))).alias("turns"))
    formatted = gathered.select(
        F.col("tree").alias("of"), F.col("leaf").alias("at"), F.size("turns").cast("bigint").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"))
    return chosen.join(formatted, chosen["tree"].eqNullSafe(formatted["of"]) & (chosen["leaf"] == formatted["at"])).drop("of", "at")


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """The turns as (role, text), and all text under the loss mask."""
    turns = [tuple(unescaped(part) for part in piece.removeprefix(TURN).split(SAYS)) for piece in formatted.split(END)[:-1]]
    return turns, unescaped("".join(formatted[start:end] for start, end in spans))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            turns, loss = read_back(row["formatted"], [(s["start"], s["end"]) for s in row["loss_spans"]])
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append({"tree": row["tree"], "n_turns": len(turns), "turns_sha256": hashlib.sha256(said.encode()).hexdigest(), "loss_chars": len(loss),
                         "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(row["formatted"])})
        yield pa.RecordBatch.from_pylist(rows, DIGESTS)


DIGESTS = pa.schema([("tree", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text says when it is read back, as counts and digests."""
    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(_digests, "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
