"""Chat formatting of reply trees.

Messages are nodes with a parent. Iterative self-joins (each doubles the distance that a
node's pointer reaches) give every node its depth, root and path score; leaves are ranked
by that score; the chosen leaf's ancestors are its path, which is formatted as one
conversation. A deep thread takes log2(depth) joins, and no join pairs messages with
each other, only with one ancestor.

Template: every turn is ``### role: text </turn>`` and a line feed. Inside roles and
texts a backslash goes before each backslash, ``#`` and ``<`` (and ``:`` in roles), so
no text can hold a marker and taking the backslashes away gives it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.llm.common import staged

TURN_END = " </turn>\n"


def escape(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#<{also}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


# ------------------------------------------------------------------------- reply trees


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depth and path score of every node, and the pointers by distance 1, 2, 4, ...

    ``nodes``: tree, node, parent (null for a root), score. A parent that is not in the
    table makes its child a root; a cycle has no root, so its nodes never arrive and are
    left out of all paths. Returns (tree, node, depth, path_score) and the pointer tables.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    state = nodes.join(known.withColumn("there", F.lit(True)), ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("bigint").alias("steps"), F.col("score").alias("total"))
    state = staged(state, "tree-0")
    jumps, longest = [], state.count()
    while 2 ** len(jumps) <= 2 * longest:
        waiting = state.filter("up is not null")
        if waiting.isEmpty():
            break
        jumps.append(waiting.select("tree", "node", "up"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        # only nodes that have not arrived take part: few threads are deep
        moved = waiting.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("total") + F.col("total2")).alias("total"))
        state = staged(state.filter("up is null").union(moved), f"tree-{len(jumps)}")
    return state.filter("up is null").select("tree", "node", (F.col("steps") - 1).alias("depth"), F.col("total").alias("path_score")), jumps


def branches(nodes: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` root-to-leaf paths of every tree: (tree, branch, node, depth).

    Leaves are ranked by the mean score of their path, then by depth (deeper first) and
    by node; ``branch`` counts from 1. The path is read off the pointers: from the leaf,
    each distance from the longest down adds the ancestors that lie so far above.
    """
    reached, jumps = climb(nodes)
    parents = nodes.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct()
    leaves = reached.join(parents, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("path_score") / (F.col("depth") + 1)), F.desc("depth"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= best)
    path = chosen.select("tree", "branch", "node")
    for jump in reversed(jumps):
        path = path.union(path.join(jump, ["tree", "node"]).select("tree", "branch", F.col("up").alias("node")))
        path = staged(path.distinct(), "path") if jump is not jumps[0] else path.distinct()
    return path.join(reached.select("tree", "node", "depth"), ["tree", "node"])


def format_paths(path: DataFrame, keys: list[str], loss_role: str = "assistant") -> DataFrame:
    """One formatted conversation a key: ``keys``, n_turns, formatted, loss (array of
    structs start, length: the code points of ``formatted`` that training learns from).

    ``path``: the keys, depth, role, text. Null roles and texts count as empty; turns of
    equal depth come in the order of role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = path.select(*keys, "depth", role.alias("role"), F.concat(F.lit("### "), escape(role, ":"), F.lit(": ")).alias("head"), escape(text).alias("body"))
    turns = turns.withColumn("chars", F.char_length("head") + F.char_length("body") + len(TURN_END))
    row = F.struct("depth", "role", "body", "head", "chars")
    whole = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("t"))
    # how many code points lie before each turn
    before = F.aggregate("t", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x["chars"]))
    spans = F.filter(
        F.transform("t", lambda x, i: F.when(x["role"] == loss_role, F.struct((F.get(F.col("before"), i) + F.char_length(x["head"])).alias("start"), F.char_length(x["body"]).alias("length")))),
        lambda s: s.isNotNull(),
    )
    return whole.withColumn("before", before).select(
        *keys,
        F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(TURN_END))), "").alias("formatted"),
        spans.alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of structs role, text."""
    parts = F.split(formatted, TURN_END.replace("\n", r"\n"))
    real = F.slice(parts, 1, F.size(parts) - 1)  # after the last mark is nothing
    head = r"(?s)^### ((?:[^\\:]|\\.)*+): (.*)$"
    return F.transform(real, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def reply_nodes(rows: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of a linear conversation as a reply tree: each answers the one before it.

    Rows of one conversation go by turn (null turns first), then role and text; repeated
    rows are turns of their own. A null conversation id is a conversation of its own.
    """
    d = rows.select(qcol(tree_col).cast("bigint").alias("tree0"), qcol(turn_col).cast("bigint").alias("turn"), qcol(role_col).alias("role"), qcol(text_col).alias("text"))
    d = d.withColumn("tree", F.coalesce(F.col("tree0").cast("string"), F.lit("")))
    place = Window.partitionBy("tree").orderBy("turn", "role", "text")
    d = d.withColumn("node", F.row_number().over(place).cast("bigint"))
    return d.select("tree", "tree0", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def control_rows(spark: SparkSession) -> DataFrame:
    """Conversation -7: texts that look like the template's own marks."""
    said = r"\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")


def op9_chat(conversations: DataFrame) -> DataFrame:
    """Every conversation, formatted and read back from the formatted text and its mask."""
    own = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    nodes = staged(reply_nodes(own.unionByName(control_rows(conversations.sparkSession))), "chat-nodes")
    path = branches(nodes.select("tree", "node", "parent", "score"))
    told = path.join(nodes.select("tree", "tree0", "node", "role", "text"), ["tree", "node"])
    done = format_paths(told, ["tree", "tree0"])
    back = done.select(F.col("tree0").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
