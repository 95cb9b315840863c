"""Conversations from reply trees: enumerate root-to-leaf paths, rank them by score, format the best ones.

Format of a turn: ``### ROLE:``, a line feed, the text, ``</turn>``, a line feed.
Inside roles and texts the characters of FIXED escapes never occur as such, so a
marker in the output is always a real one, and unescaping gives the exact text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.storage import materialise

START, MIDDLE, END = "### ", ":\n", "</turn>\n"
TRAINED_ROLE = "assistant"
#: the backslash comes first when escaping and last when unescaping
TEXT_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"), ("\n", "\\n"))


def escape(text: Column, escapes: tuple = TEXT_ESCAPES) -> Column:
    for char, code in escapes:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column, escapes: tuple = TEXT_ESCAPES) -> Column:
    for char, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def turns_as_tree(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of linear conversations: every row replies to the one before it.

    Rows are ordered by turn (null first), equal turns by role and text. Returns
    conv_id, msg, parent, role, text, score.
    """
    order = Window.partitionBy("conv_id").orderBy("_turn", "role", "text")
    named = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    numbered = named.withColumn("msg", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent")
    return numbered.select("conv_id", "msg", parent, "role", "text", F.lit(0.0).alias("score"))


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """The ``paths`` best root-to-leaf paths of every conversation, one row per message on them.

    ``messages`` has conv_id, msg, parent, score; (conv_id, msg) is unique and
    a parent that does not occur counts as none. A path's score is the sum over
    its messages (null: 0); ties go to the smaller leaf. Self-joins double the
    reach of every message towards its root, log2(depth) of them in all; the
    same joins backwards list the messages of the chosen paths, so that work and
    rows stay near messages x log2(depth) even for one very long chain. Replies in a
    circle have no root and raise ValueError.

    Returns conv_id, leaf, rank, path_score, msg, height (messages up to the leaf).
    """
    base = messages.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_tree"), F.col("conv_id").isNull().alias("_null"), "conv_id", "msg", "parent", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    tree = ["_tree", "_null"]
    base = materialise(base, "messages")
    known = base.select(*tree, F.col("msg").alias("up"))
    inner = base.withColumnRenamed("parent", "up")
    lost = inner.join(known, [*tree, "up"], "left_anti")
    jump = inner.join(known, [*tree, "up"], "left_semi").unionByName(lost.withColumn("up", F.lit(None).cast("long")))
    jump = materialise(jump.select(*tree, "msg", "up", F.col("score").alias("total")), "jump")
    leaves = base.select(*tree, "conv_id", "msg").join(jump.select(*tree, F.col("up").alias("msg")), [*tree, "msg"], "left_anti")
    largest = base.groupBy(*tree).count().agg(F.max("count")).first()[0] or 0
    levels = [jump]
    while not levels[-1].filter("up IS NOT NULL").isEmpty():
        if 2 ** (len(levels) - 1) > largest:
            raise ValueError("replies form a circle")
        last = levels[-1]
        above = last.select(*tree, F.col("msg").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"))
        wider = last.join(above, [*tree, "up"], "left")
        levels.append(materialise(wider.select(*tree, "msg", F.col("_up").alias("up"), (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total")), "jump"))
    scored = leaves.join(levels[-1], [*tree, "msg"]).select(*tree, "conv_id", F.col("msg").alias("leaf"), F.col("total").alias("path_score"))
    rank = F.row_number().over(Window.partitionBy(*tree).orderBy(F.desc("path_score"), "leaf"))
    chosen = scored.withColumn("rank", rank).filter(F.col("rank") <= paths)
    on_path = materialise(chosen.withColumn("msg", F.col("leaf")).withColumn("height", F.lit(0).cast("long")), "path")
    for power in reversed(range(len(levels) - 1)):
        hop = levels[power].filter("up IS NOT NULL").select(*tree, "msg", "up")
        more = on_path.join(hop, [*tree, "msg"]).withColumn("msg", F.col("up")).drop("up").withColumn("height", F.col("height") + 2**power)
        on_path = materialise(on_path.unionByName(more.select(*on_path.columns)), "path", replaces=on_path)
    return on_path.drop(*tree)


def format_paths(messages: DataFrame, paths: int = 1, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """Each chosen path as one formatted conversation with its loss mask.

    ``messages``: conv_id, msg, parent, role, text, score; other columns are
    ignored. Null role or text counts as empty; null conv_id is a conversation
    of its own. Returns conv_id, leaf, rank, path_score, formatted, and
    loss_spans: start and end (exclusive) in code points of each text of
    ``trained_role``. One output row holds one whole conversation.
    """
    on_path = best_paths(messages, paths)
    told = messages.select(F.col("conv_id").alias("_conv"), F.col("msg").alias("_msg"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("msg") == F.col("_msg"))
    head = F.concat(F.lit(START), escape(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE))
    parts = on_path.join(told, same).select("conv_id", "leaf", "rank", "path_score", (-F.col("height")).alias("place"), head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained_role).alias("trained"))
    turns = F.array_sort(F.collect_list(F.struct("place", "head", "body", "trained")))
    whole = parts.groupBy("conv_id", "leaf", "rank", "path_score").agg(turns.alias("_turns"))
    text = F.array_join(F.transform("_turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    # the running length would be copied per turn inside aggregate(); a second explode keeps it linear
    spans = whole.select("conv_id", "leaf", "rank", F.posexplode("_turns").alias("_i", "_t"))
    until = Window.partitionBy("conv_id", "leaf", "rank").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.length("_t.head") + F.length("_t.body") + len(END)).over(until) - len(END)
    marks = spans.withColumn("_end", ends).filter("_t.trained").groupBy(F.col("conv_id").alias("_conv"), F.col("leaf").alias("_leaf"), F.col("rank").alias("_rank")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("_end") - F.length("_t.body")).alias("start"), F.col("_end").alias("end")))).alias("loss_spans")
    )
    formatted = whole.select("conv_id", "leaf", "rank", "path_score", text.alias("formatted"))
    key = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("leaf") == F.col("_leaf")) & (F.col("rank") == F.col("_rank"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return formatted.join(marks, key, "left").select("conv_id", "leaf", "rank", "path_score", "formatted", F.coalesce("loss_spans", none).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text, unescaped."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")
    role = lambda p: F.substring_index(p, MIDDLE, 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substr(role(p), F.lit(len(START) + 1)), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(p, F.length(role(p)) + len(MIDDLE) + 1)).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
