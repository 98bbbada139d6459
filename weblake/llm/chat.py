"""Chat formatting: root-to-leaf paths of reply trees, formatted as conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblake.llm.columns import running_sums
from weblake.llm.storage import dropped, stored

# The template's marks, and control strings of common chat templates.
BEGIN, MESSAGE, END = "<|im_start|>", "<|message|>", "<|im_end|>\n"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    """``text`` without control strings: a backslash after the first character breaks each of them."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame, tree: str, node: str, parent: str, score: Column, keep: int = 1) -> DataFrame:
    """The ``keep`` best root-to-leaf paths of each reply tree.

    messages: one row per node, node ids unique over all trees; a parent that is null or missing
    makes a root. Returns tree, branch (1 is the best), node and depth, a row for each node of each
    kept path. A branch is ranked by the mean score of its nodes, then length (longer first), then
    the leaf's id.

    Iterative self-joins that double their reach: after k joins each node knows its ancestor 2^k
    steps up and the score in between, so a chain of n turns takes log2(n) joins and no row grows.
    The same jumps, walked back from the chosen leaves, list each path's nodes once. Rows on a cycle
    reach no root and are left out.
    """
    ids = messages.select(F.col(node).alias("id"))
    nodes = messages.select(F.col(tree).alias("tree"), F.col(node).alias("id"), F.col(parent).alias("up"), score.cast("double").alias("score"))
    known = ids.withColumnRenamed("id", "up")
    roots = nodes.join(known, "up", "left_anti").select("tree", "id", F.lit(None).cast(dict(nodes.dtypes)["up"]).alias("up"), "score")
    inner = nodes.join(known, "up", "left_semi").select("tree", "id", "up", "score")
    jumps = [stored(inner.unionByName(roots).select("tree", "id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("steps"), F.col("score").alias("total")))]
    leaves = jumps[0].select("id").join(jumps[0].select(F.col("up").alias("id")), "id", "left_anti")
    limit = jumps[0].count()
    while 2 ** (len(jumps) - 1) <= limit and not jumps[-1].where("up is not null").isEmpty():
        last = jumps[-1]
        known = reduce(DataFrame.unionByName, (j.where("up is null") for j in jumps[:-1]), last)
        above = known.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("total").alias("above"), F.col("steps").alias("more"))
        # Only nodes that have not reached their root go on; each is done in the round in which it does.
        step = last.where("up is not null").join(above, "up").select("tree", "id", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("above")).alias("total"))
        jumps.append(stored(step))
    done = [j.where("up is null").select("tree", "id", "steps", "total") for j in jumps]
    ranked = reduce(DataFrame.unionByName, done).join(leaves, "id")
    order = [F.desc(F.col("total") / (F.col("steps") + 1)), F.desc("steps"), "id"]
    best = ranked.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).where(F.col("branch") <= keep)
    paths = stored(best.select("tree", "branch", "id", F.col("steps").alias("depth")))
    for k in reversed(range(len(jumps) - 1)):
        up = jumps[k].where("up is not null").select("id", "up")
        more = paths.join(up, "id").select("tree", "branch", F.col("up").alias("id"), (F.col("depth") - 2**k).alias("depth"))
        grown = stored(paths.unionByName(more))
        dropped(paths)
        paths = grown
    dropped(*jumps)
    return paths.select(F.col("tree").alias(tree), "branch", F.col("id").alias(node), "depth")


def reply_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Node and parent ids for conversations that are kept by turn: each row replies to the one before.

    Adds ``node`` and ``parent``. Rows of one turn number are ordered by role and text and follow each
    other; rows equal in all of these stay separate. Rows of a null conversation are left out.
    """
    rows = turns.where(F.col(conv).isNotNull())
    place = F.row_number().over(Window.partitionBy(conv).orderBy(F.asc_nulls_first(turn), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    rows = rows.withColumn("place", place)
    name = lambda n: F.concat_ws(":", F.col(conv).cast("string"), n.cast("string"))
    return rows.withColumn("node", name(F.col("place"))).withColumn("parent", F.when(F.col("place") > 1, name(F.col("place") - 1))).drop("place")


def format_paths(messages: DataFrame, paths: DataFrame, tree: str, node: str, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each path as one conversation: tree, branch, ``formatted`` and ``loss_mask``.

    A turn reads begin mark, role, message mark, text, end mark; role and text are escaped. Null roles
    and texts count as empty. loss_mask: array of struct(start, length) of the assistant texts in
    ``formatted``, in code points.
    """
    turns = messages.select(F.col(node), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = paths.join(turns, node).select(
        tree, "branch", "depth",
        F.concat(F.lit(BEGIN), escaped(F.col("role")), F.lit(MESSAGE)).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"),
    )
    grouped = turns.groupBy(tree, "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "head", "body", "learn"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END)
    ends = running_sums(F.transform("turns", size))
    grouped = grouped.select(tree, "branch", "turns", formatted.alias("formatted"), ends.alias("ends"))
    spans = F.zip_with("turns", "ends", lambda t, e: F.when(t["learn"], F.struct((e - len(END) - F.length(t["body"])).alias("start"), F.length(t["body"]).alias("length"))))
    return grouped.select(tree, "branch", "formatted", F.array_compact(spans).alias("loss_mask"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", score: Column | None = None, keep: int = 1) -> DataFrame:
    """Conversations that are kept by turn, formatted: conv, branch, formatted, loss_mask.

    Other input columns are left out; see ``reply_tree``, ``reply_paths`` and ``format_paths`` for
    nulls, ties and repeated rows. An empty table gives an empty result.
    """
    messages = stored(reply_tree(turns.select(conv, turn, "role", "text"), conv, turn))
    paths = reply_paths(messages, conv, "node", "parent", F.lit(1.0) if score is None else score, keep)
    return format_paths(messages, paths, conv, "node")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``read``, array of struct(role, text), and ``learned``, the text under the mask, to formatted conversations."""
    parts = F.transform(F.filter(F.split("formatted", r"\Q" + END + r"\E"), lambda x: x != ""), lambda x: F.split(F.substring(x, F.lit(len(BEGIN) + 1), F.length(x)), r"\Q" + MESSAGE + r"\E", 2))
    read = F.transform(parts, lambda p: F.struct(unescaped(F.get(p, 0)).alias("role"), unescaped(F.get(p, 1)).alias("text")))
    learned = unescaped(F.array_join(F.transform("loss_mask", lambda m: F.substring(F.col("formatted"), m["start"] + 1, m["length"])), ""))
    return formatted.withColumn("read", read).withColumn("learned", learned)
