"""A Merkle manifest of a data set: digests of rows, trees by slot pivot, proofs and their check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblake.llm.storage import dropped, stored

#: Children of a node.
FANOUT = 16
#: Bits of monotonically_increasing_id below the number of the partition.
ROW_BITS = 33


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and its text; null as ``-``. No two rows of fields read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Iterable[Column]) -> Column:
    """The digest of a row."""
    return digest(F.concat(*map(field, values)))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, id, digest, carried) with ``at``, their place in the tree, and ``n``, the tree's rows.

    Rows are sorted in ranges of tree and id, so a tree of any size is many tasks; a place is the rows
    of the tree in ranges before plus the place in the range.
    """
    # Stored before the ranges are drawn: their sample would read and digest all texts once more.
    kept = stored(rows)
    order = [F.col("tree"), F.col("id").asc_nulls_first(), F.col("digest")]
    ranges = stored(kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("range", F.shiftright("row", ROW_BITS))
    runs = ranges.groupBy("tree", "range").agg(F.min("row").alias("first"), F.count("*").alias("m"))
    of = Window.partitionBy("tree")
    before = F.coalesce(F.sum("m").over(of.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "range", (before - F.col("first")).alias("shift"), F.sum("m").over(of).alias("n"))
    return ranges.join(runs, ["tree", "range"]).select("tree", (F.col("row") + F.col("shift")).alias("at"), "n", "digest", "carried")


def _slot(k: int) -> str:
    return f"slot_{k}"


def _pivoted(nodes: DataFrame) -> DataFrame:
    """One row per parent of ``nodes``: its children spread into FANOUT columns, and its digest.

    Children are FANOUT neighbours by place, so a parent's key never holds more rows than that.
    """
    child = F.struct("digest", "carried")
    slots = [F.max(F.when(F.col("at") % FANOUT == k, child)).alias(_slot(k)) for k in range(FANOUT)]
    parents = nodes.groupBy("tree", F.floor(F.col("at") / FANOUT).alias("parent")).agg(F.max(F.ceil(F.col("n") / FANOUT)).alias("n"), *slots)
    return parents.withColumn("digest", digest(F.concat_ws("", *(F.col(_slot(k))["digest"] for k in range(FANOUT)))))


def _grown(leaves: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The parents of each level of all trees, and the trees' tops (tree, digest, carried) by level."""
    levels, tops, nodes = [], [], leaves
    most = leaves.agg(F.max("n")).head()[0] or 0
    while True:
        tops.append(nodes.where("n = 1").select("tree", "digest", "carried"))
        if most <= 1:
            return levels, tops
        levels.append(stored(_pivoted(nodes.where("n > 1"))))
        nodes = levels[-1].select("tree", F.col("parent").alias("at"), "n", "digest", F.lit(None).cast(leaves.schema["carried"].dataType).alias("carried"))
        most = -(-most // FANOUT)


def _unfolded(levels: list[DataFrame], tops: list[DataFrame], above: DataFrame) -> DataFrame:
    """All leaves, each with the path from it to the root.

    above: tree, ``top`` (its digest), ``root`` and ``path``, what the path holds above the tree. Goes down
    level by level; a path is written once for each parent and spread over its children.
    """
    down: DataFrame | None = None
    for level in range(len(levels), -1, -1):
        begun = tops[level].join(above, "tree").select("tree", F.lit(0).cast("long").alias("at"), "digest", "carried", "top", "root", "path")
        nodes = begun if down is None else begun.unionByName(down)
        if not level:
            return nodes
        held = nodes.select("tree", F.col("at").alias("parent"), "top", "root", "path")
        names = [_slot(k) for k in range(FANOUT)]
        side = lambda part: F.concat_ws("", *(F.col(c)["digest"] for c in part))
        children = [
            F.when(
                F.col(c).isNotNull(),
                F.struct(
                    F.lit(k).alias("slot"), F.col(c)["digest"].alias("digest"), F.col(c)["carried"].alias("carried"),
                    F.struct(side(names[:k]).alias("left"), side(names[k + 1 :]).alias("right")).alias("step"),
                ),
            )
            for k, c in enumerate(names)
        ]
        spread = levels[level - 1].join(held, ["tree", "parent"]).select("tree", "parent", "top", "root", "path", F.explode(F.array(*children)).alias("c")).where("c is not null")
        down = spread.select(
            "tree", (F.col("parent") * FANOUT + F.col("c.slot")).alias("at"), F.col("c.digest").alias("digest"), F.col("c.carried").alias("carried"),
            "top", "root", F.concat(F.array("c.step"), F.col("path")).alias("path"),
        )


def with_proofs(rows: DataFrame, leaf_col: str = "leaf", id_col: str = "doc_id", tree_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """The manifest of ``rows``: a Merkle tree for each value of ``tree_col`` and one over their roots.

    Returns id, ``leaf``, ``subroot`` (the root of the row's tree), ``root``, ``path`` (from the leaf to the
    root, the siblings on the ``left`` and on the ``right`` of each step, joined) and the columns of
    ``carry``; other columns are left out. Leaves of a tree ascend by id, nulls first, rows of one id by
    their leaf; each FANOUT consecutive nodes become their digest until one is left, and so do the
    subroots, ordered by ``tree_col`` (null first, bytewise). A single leaf is its tree's root; rows equal
    in all columns are leaves of their own; an empty table has no rows and no root.

    Slot pivot: conditional aggregates spread the children of each parent into columns; joining
    all columns gives the digest, leaving out the own slot the siblings. There are log16(rows) levels, each
    a sixteenth of the one below; joins are by tree and parent, so no key has more than FANOUT rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("-"))
    carried = F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"of {k}") for k, c in enumerate(carry)))
    leaves = _numbered(rows.select(tree.alias("tree"), F.col(id_col).alias("id"), F.col(leaf_col).alias("digest"), carried.alias("carried")))
    levels, tops = _grown(leaves)
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    over = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest", F.struct("tree").alias("carried"))
    upper_levels, upper_tops = _grown(_numbered(over))
    root = upper_tops[-1].select("tree", F.lit(None).cast("string").alias("top"), F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = stored(_unfolded(upper_levels, upper_tops, root).select(F.col("carried.tree").alias("tree"), F.col("digest").alias("top"), "root", "path"))
    dropped(*upper_levels)
    found = _unfolded(levels, tops, above)
    return found.select(
        F.col("carried.id").alias(id_col), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "path",
        *(F.col("carried")[f"of {k}"].alias(c) for k, c in enumerate(carry)),
    )


def proof_text(path: Column) -> Column:
    """All siblings of a path, from the leaf to the root, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to: the data set's if neither was changed."""
    return F.aggregate(path, leaf_digest, lambda acc, p: digest(F.concat(p["left"], acc, p["right"])))
