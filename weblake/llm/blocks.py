"""Comparing all members of a group in blocks, whatever the group's size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType


#: A key with more rows than this, and more than this part of all rows, is hot.
HOT_ROWS = 1000
HOT_PARTS = 1000


def checked_ids(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with its ids as long; ids that are no whole numbers are refused."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be of a whole-number type, not {kind.simpleString()}: number the rows first")
    return df if isinstance(kind, LongType) else df.withColumn(id_col, F.col(id_col).cast("long"))


def join_split(rows: DataFrame, keyed: DataFrame, on: str | list[str], n: str) -> DataFrame:
    """``rows`` joined with the one row of each key in ``keyed``, whose column ``n`` counts the key's rows.

    Hot keys, at most HOT_PARTS of them, are broadcast, so their rows stay where they are; all other
    rows are shuffled by key.
    """
    on = [on] if isinstance(on, str) else on
    total = keyed.agg(F.sum(n).alias("n")).head()["n"] or 0
    hot = F.col(n) > max(HOT_ROWS, total // HOT_PARTS)
    if keyed.where(hot).isEmpty():
        return rows.join(keyed, on)
    few = F.broadcast(keyed.where(hot))
    cold = rows.join(F.broadcast(keyed.where(hot).select(*on)), on, "left_anti").join(keyed.where(~hot), on)
    return rows.join(few, on).unionByName(cold)


def in_block_pairs(rows: DataFrame, size: Column, salt: Column, block_rows: int) -> DataFrame:
    """``rows`` dealt so that any two rows of a group meet in exactly one pair of blocks (or in one block).

    size: the rows of the group. Adds ``of`` (the row's own block), ``first`` and ``second`` (the pair
    of blocks it is dealt to, first <= second). A group of n rows becomes pairs of blocks of about
    ``block_rows`` rows each, so a hot group is many even tasks.
    """
    blocks = F.greatest(F.lit(1), F.ceil(size / block_rows)).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("of", F.pmod(salt, F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("first", F.least("of", "other")).withColumn("second", F.greatest("of", "other")).drop("blocks", "other")


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches, one table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *starts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
