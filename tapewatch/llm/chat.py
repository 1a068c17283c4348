"""Operator 5: conversations from reply trees. DataFrame only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewatch.llm.common import keep

#: The template: HEAD role SEP text END. The escapes are applied in this order and undone in the reverse order.
HEAD, SEP, END = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    """text without the template's control strings; every backslash left starts an escape."""
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    """The text that escape() was given."""
    for a, b in reversed(pairs):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def without_cycles(nodes: DataFrame) -> DataFrame:
    """nodes (conv_id, node, up, ...) in which the smallest node of each cycle of replies is a root.

    Pointers are doubled until they span more nodes than any conversation has; a node whose
    pointer hasn't reached a root by then leads into a cycle, its pointer stands on it, and the
    smallest node that was passed from there on is the cycle's smallest.
    """
    most = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    hop = nodes.filter("up is not null").select("conv_id", "node", "up", F.least("node", "up").alias("least"))
    for _ in range(most.bit_length()):
        far = hop.select("conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"))
        hop = keep(hop.join(far, ["conv_id", "up"]).select("conv_id", "node", F.col("up2").alias("up"), F.least("least", "least2").alias("least")))
    on_cycle = hop.select("conv_id", F.col("up").alias("node")).distinct()
    cut = hop.join(on_cycle, ["conv_id", "node"]).select("conv_id", F.col("least").alias("node")).distinct().withColumn("cut", F.lit(True))
    return nodes.join(cut, ["conv_id", "node"], "left").withColumn("up", F.when(F.col("cut").isNull(), F.col("up"))).drop("cut")


def chosen_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """conv_id, path (leaf), depth, node: the best root-to-leaf paths of each reply tree.

    nodes: conv_id, node, parent (null for a root), score. Self-joins double the distance that
    each node's ancestor pointer spans and add up the branch's score, so a tree of depth d needs
    log2(d) of them. Leaves are ranked by their branch's score (ties: the smaller leaf), and the
    chosen leaves collect their ancestors by the same pointers. Replies that go round in a circle
    start at the circle's smallest node.
    """
    first = nodes.select("conv_id", "node", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).alias("sum"), F.lit(1).cast("long").alias("dist"))
    first = keep(first)
    # Ids that grow along the replies can't make a circle; others are looked at.
    if first.filter("up >= node").limit(1).count():
        first = keep(without_cycles(first))
    done, open_, levels = first.filter("up is null"), first.filter("up is not null"), []
    while open_.limit(1).count():  # only nodes whose pointer hasn't reached a root are joined again
        levels.append(open_.select("conv_id", "node", "up"))
        far = done.unionByName(open_).select("conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("dist").alias("dist2"))
        moved = open_.join(far, ["conv_id", "up"]).select("conv_id", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("dist") + F.col("dist2")).alias("dist"))
        moved = keep(moved)
        done, open_ = done.unionByName(moved.filter("up is null")), moved.filter("up is not null")
    step = done
    inner = first.select("conv_id", F.col("up").alias("node")).filter("node is not null").distinct()
    best = Window.partitionBy("conv_id").orderBy(F.desc("sum"), "node")
    leaves = step.join(inner, ["conv_id", "node"], "left_anti").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= paths)
    found = keep(leaves.select("conv_id", F.col("node").alias("path"), "rank", "node", F.col("dist").alias("depth")))
    for k, level in enumerate(levels):
        more = found.join(level, ["conv_id", "node"]).select("conv_id", "path", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        found = keep(found.unionByName(more))  # each turn reads it twice; its self-join needs fresh columns
    return found


def format_reply_trees(nodes: DataFrame, paths: int = 1, loss_role: str = "assistant") -> DataFrame:
    """conv_id, path, rank, n_turns, formatted, turn_loss (array of boolean), loss_spans.

    nodes: conv_id, node, parent, role, text, score. Each chosen path becomes one conversation:
    for each turn HEAD, the escaped role, SEP, the escaped text, END. loss_spans has the start and
    end (code points) of each escaped text of loss_role. A null role or text is empty; a parent
    that is not among the conversation's nodes makes its child a root, and so does a circle of replies for its
    smallest node; a conversation's chosen path is one value, however long its texts; a null conv_id is a
    conversation of its own; rows that repeat a (conv_id, node) are the same node with one of the rows'
    contents; an empty table gives no row; further columns are not read.
    """
    base = nodes.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_key"), F.col("conv_id").isNull().alias("_none"), "conv_id", "node", "parent",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("score").cast("double").alias("score"),
    )
    base = base.withColumn("conv", F.struct("_none", "_key")).dropDuplicates(["conv", "node"])
    own = base.select(F.col("conv").alias("_c"), F.col("node").alias("_p"))
    linked = base.join(own, (F.col("conv") == F.col("_c")) & (F.col("parent") == F.col("_p")), "left").drop("parent").withColumnRenamed("_p", "parent")
    linked = keep(linked.select("conv", "conv_id", "node", "parent", "role", "text", "score"))
    on_path = chosen_paths(linked.select(F.col("conv").alias("conv_id"), "node", "parent", "score"), paths).withColumnRenamed("conv_id", "conv")
    turns = on_path.join(linked.select("conv", "conv_id", "node", "role", "text"), ["conv", "node"])
    turns = turns.withColumns({"_head": F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(SEP)), "_body": escape(F.col("text"))})
    so_far = Window.partitionBy("conv", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("_at", F.coalesce(F.sum(F.length("_head") + F.length("_body") + len(END)).over(so_far), F.lit(0)) + F.length("_head"))
    turn = F.struct("depth", F.concat("_head", "_body", F.lit(END)).alias("said"), (F.col("role") == loss_role).alias("loss"), F.col("_at").cast("long").alias("start"), (F.col("_at") + F.length("_body")).cast("long").alias("end"))
    whole = turns.groupBy("conv", "path").agg(F.first("conv_id").alias("conv_id"), F.first("rank").alias("rank"), F.sort_array(F.collect_list(turn)).alias("_t"))
    spans = F.transform(F.filter("_t", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return whole.select("conv_id", "path", "rank", F.size("_t").cast("long").alias("n_turns"), F.array_join(F.transform("_t", lambda t: t["said"]), "").alias("formatted"), F.transform("_t", lambda t: t["loss"]).alias("turn_loss"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, path, formatted, turns (role, text and loss parsed from the formatted string) and learned.

    learned is all text under the loss mask, read from the formatted string by loss_spans and unescaped.
    """
    said = F.split("formatted", END)
    said = F.slice(said, 1, F.size(said) - 1)  # nothing follows the last END

    def parse(s: Column, loss: Column) -> Column:
        role = F.substring_index(s.substr(F.lit(len(HEAD) + 1), F.length(s)), SEP, 1)
        text = s.substr(F.length(role) + (len(HEAD) + len(SEP) + 1), F.length(s))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"), loss.alias("loss"))

    masked = F.transform("loss_spans", lambda s: F.call_function("substring", F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    learned = F.array_join(F.transform(masked, lambda s: unescape(s)), "")
    return formatted.select("conv_id", "path", "formatted", F.zip_with(said, "turn_loss", parse).alias("turns"), learned.alias("learned"))


def turn_trees(conversations: DataFrame) -> DataFrame:
    """conversations as reply trees: each row answers the row before it by turn.

    Beside the last of two or more rows stands a draft that was not said: an empty reply to the same
    row, whose score of -1 ranks its branch below the conversation's own.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"))
    rows = rows.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})
    drafts = rows.filter("node = n and n > 1").withColumns({"node": F.col("node") + 1, "text": F.lit(""), "score": F.lit(-1.0)})
    return rows.unionByName(drafts).drop("n")
