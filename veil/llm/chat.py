"""Chat formatting: the best paths of reply trees, each as one conversation. Joins and built-in expressions only.

Paths are enumerated by iterative self-joins of ids, scores and depths, without texts. By pointer doubling a round joins
each node with the node its pointer leads to, so a chain of n replies takes log2(n) rounds; sums of scores double along.
Leaves are ranked within their conversation by the mean score of their path. The nodes of a chosen path are listed by the same
pointers, largest first. Only then texts come in, once for each chosen path they are on.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Within texts and roles a ``<`` with bars behind it
gets one bar more, so no control string is left in them, and taking one bar away restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.operators.spans import running_starts
from veil.session import materialize

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<(\|+)"), F.lit("<|$1"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<\|(\|+)"), F.lit("<$1"))


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chains(turns: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as trees: each row answers the one before it, by turn, then role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node")).withColumns(
        {"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)}
    )


def paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` root-to-leaf paths of each conversation: conv, leaf, rank, and one row for each node with its ``depth``.

    ``nodes``: conv (not null), node, parent, score; (conv, node) unique. A parent that is not there makes a root. Ties in
    score go to the smaller leaf. Nodes whose ancestors form a ring have no root and are on no path.
    """
    here = nodes.select("conv", "node")
    known = here.select(F.col("conv").alias("k_conv"), F.col("node").alias("k_node"))
    step = nodes.join(known, (F.col("conv") == F.col("k_conv")) & (F.col("parent") == F.col("k_node")), "left").select(
        "conv", "node", F.col("k_node").alias("up"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(1).cast("long").alias("depth")
    )
    step = materialize(step)
    done, open_ = step.where("up is null"), step.where("up is not null")
    jumps, left = [], None
    while True:
        before, left = left, open_.count()
        if not left or left == before:  # the same nodes as before are on rings
            break
        jumps.append(open_.select(F.col("conv").alias("j_conv"), F.col("node").alias("j_node"), "up"))
        ahead = done.unionByName(open_).select(F.col("conv").alias("a_conv"), F.col("node").alias("a_node"), F.col("up").alias("a_up"), F.col("score").alias("a_score"), F.col("depth").alias("a_depth"))
        # only nodes whose root isn't reached yet are joined
        moved = materialize(
            open_.join(ahead, (F.col("conv") == F.col("a_conv")) & (F.col("up") == F.col("a_node"))).select(
                "conv", "node", F.col("a_up").alias("up"), (F.col("score") + F.col("a_score")).alias("score"), (F.col("depth") + F.col("a_depth")).alias("depth")
            )
        )
        done, open_ = done.unionByName(moved.where("up is null")), moved.where("up is not null")
    parents = jumps[0].select(F.col("j_conv").alias("p_conv"), F.col("up").alias("p_node")).distinct() if jumps else None
    leaves = done
    if parents is not None:
        leaves = leaves.join(parents, (F.col("conv") == F.col("p_conv")) & (F.col("node") == F.col("p_node")), "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy((F.col("score") / F.col("depth")).desc(), "node")))
    on_path = ranked.where(F.col("rank") <= best).select("conv", F.col("node").alias("leaf"), "rank", "node", "depth")
    for size, jump in sorted(((1 << i, j) for i, j in enumerate(jumps)), key=lambda x: -x[0]):
        higher = on_path.where(F.col("depth") > size).join(jump, (F.col("conv") == F.col("j_conv")) & (F.col("node") == F.col("j_node")))
        on_path = on_path.unionByName(higher.select("conv", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - size).alias("depth")))
        on_path = materialize(on_path)
    return on_path


def _formatted(turns: Column, loss_role: str) -> Column:
    """Struct (formatted, loss) of an array of (depth, role, text): loss has the code point ranges of the loss role's texts."""
    heads = F.transform(turns, lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")))
    bodies = F.transform(turns, lambda t: escape(t["text"]))
    lengths = F.zip_with(heads, bodies, lambda h, b: F.length(h) + F.length(b) + len(END))
    starts = F.slice(running_starts(lengths), 1, F.size(turns))
    ranges = F.zip_with(F.arrays_zip(heads.alias("h"), bodies.alias("b")), F.arrays_zip(turns.alias("t"), starts.alias("s")), lambda x, y: F.struct(
        y["t"]["role"].alias("role"), (y["s"] + F.length(x["h"])).alias("start_at"), (y["s"] + F.length(x["h"]) + F.length(x["b"])).alias("end_at")
    ))
    text = F.array_join(F.zip_with(heads, bodies, lambda h, b: F.concat(h, b, F.lit(END))), "")
    loss = F.transform(F.filter(ranges, lambda r: r["role"] == loss_role), lambda r: F.struct(r["start_at"], r["end_at"]))
    return F.struct(text.alias("formatted"), loss.alias("loss"))


def format_trees(nodes: DataFrame, best: int = 1, loss_role: str = "assistant") -> DataFrame:
    """conv_id, rank, leaf, ``formatted`` and ``loss`` (ranges of code points: start_at, end_at) of the best paths.

    ``nodes``: conv_id, node (long), parent, score, role, text; other columns are not read. A null id is a conversation like
    any other; a null role or text is an empty one. Of rows that repeat a node's id the smallest counts; rows without a node
    id are on no path. An empty table gives an empty result.
    """
    # null gets a key that no id has
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("conv")
    fields = F.struct("parent", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = nodes.where("node is not null").select(key, "conv_id", F.col("node").cast("long").alias("node"), fields.alias("row"))
    rows = materialize(rows.groupBy("conv", "node").agg(F.first("conv_id").alias("conv_id"), F.min("row").alias("row")).select("conv", "conv_id", "node", "row.*"))
    chosen = paths(rows.select("conv", "node", "parent", "score"), best)
    full = chosen.join(rows.select("conv", "conv_id", "node", "role", "text"), ["conv", "node"])
    turns = full.groupBy("conv", "leaf", "rank").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    return turns.select("conv_id", "rank", "leaf", _formatted(F.col("turns"), loss_role).alias("f")).select("conv_id", "rank", "leaf", "f.*")


def read_back(formatted: Column) -> Column:
    """Array of (role, text) out of a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    heads = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece):
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        at = F.instr(body, F.lit("\n"))
        return F.struct(_unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(F.substring(body, at + 1, F.length(body))).alias("text"))

    return F.transform(heads, turn)


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, restored."""
    return F.transform(loss, lambda r: unescape(F.substring(formatted, r["start_at"] + 1, r["end_at"] - r["start_at"])))
