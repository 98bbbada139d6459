"""Sharding: the minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.llm.ranks import ranked
from weblake.llm.storage import stored

FIRST_BITS = 12
MORE_BITS = 8


@dataclass(frozen=True)
class Node:
    """All groups whose keys share their first bits: their summed size, first and last key."""

    prefix: int
    size: int
    first: int
    last: int

    @property
    def atomic(self) -> bool:
        return self.first == self.last


def _reach(nodes: list[Node], capacity: int, shards: int, fluid: bool) -> list[int]:
    """Where each greedily filled shard ends, as a running size.

    ``fluid``: nodes of several groups may be cut anywhere, which bounds the true reach from above;
    else nowhere, which bounds it from below.
    """
    ends, at, i, left = [], 0, 0, 0
    for _ in range(shards):
        room = capacity
        while i < len(nodes):
            size = left or nodes[i].size
            if size <= room:
                room, at, left, i = room - size, at + size, 0, i + 1
            elif fluid and not nodes[i].atomic:
                at, left, room = at + room, size - room, 0
                break
            else:
                break
        ends.append(at)
    return ends


def _least_capacity(nodes: list[Node], shards: int, fluid: bool) -> int:
    total = sum(n.size for n in nodes)
    low, high = 1, max(1, total)
    while low < high:
        mid = (low + high) // 2
        if _reach(nodes, mid, shards, fluid)[-1] == total:
            high = mid
        else:
            low = mid + 1
    return low


def _summed(rows: DataFrame, bits: int) -> list[Node]:
    found = rows.groupBy(F.shiftright("group_key", 64 - bits).alias("prefix")).agg(F.sum("size").alias("size"), F.min("group_key").alias("first"), F.max("group_key").alias("last"))
    return [Node(*r) for r in found.collect()]


def cut_keys(rows: DataFrame, shards: int) -> list[int]:
    """The first key of each shard after shard 0, for the smallest feasible capacity.

    rows: ``group_key`` (long; its order is the order of the groups) and ``size``. Sizes are summed by
    the leading bits of the key. On those sums a binary search, checked greedily, bounds the
    capacity from both sides; only the sums in which a cut may fall are then split by further bits,
    until every cut falls between single groups and the two bounds meet. The driver holds the 4,096
    first sums and 256 more for each that is split: a few for each cut at each level.
    """
    bits = FIRST_BITS
    nodes = sorted(_summed(rows, bits), key=lambda n: n.first)
    while nodes:
        low, high = _least_capacity(nodes, shards, True), _least_capacity(nodes, shards, False)
        spans = list(zip(_reach(nodes, low, shards, False), _reach(nodes, high, shards, True), strict=True))
        at, split = 0, set()
        for n in nodes:
            if not n.atomic and any(a <= at + n.size and b >= at for a, b in spans):
                split.add(n)
            at += n.size
        if not split or bits >= 64:
            break
        inside = rows.where(F.shiftright("group_key", 64 - bits).isin(*(n.prefix for n in split)))
        bits = min(64, bits + MORE_BITS)
        nodes = sorted([n for n in nodes if n not in split] + _summed(inside, bits), key=lambda n: n.first)
    cuts, ends = [], set()
    if nodes:
        ends = {e for e in _reach(nodes, _least_capacity(nodes, shards, False), shards, False)}
    at = 0
    for n in nodes:
        if at and at in ends:
            cuts.append(n.first)
        at += n.size
    return cuts


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts whole groups of equal texts into ``shards`` shards of nearly equal bytes.

    Returns id, size (UTF-8 bytes of the text plus 1; a null text counts as empty), text_crc32, shard
    and slot (0, 1, ... in each shard); other input columns are left out. Groups are ordered by a
    64-bit hash of the text, so a cut falls anywhere without a sort; texts of one hash stay together.
    Shards are contiguous in that order and the largest is as small as can be; where one group is
    larger than a fair share, later shards may be empty. Rows of repeated ids all get slots; an empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group_key")))
    number = F.lit(0)
    for cut in cut_keys(rows, shards):
        number = number + (F.col("group_key") >= cut).cast("int")
    rows = rows.withColumn("shard", number)
    placed = ranked(rows, "shard", [F.col(id_col), F.col("group_key")], F.xxhash64(id_col))
    return placed.select(id_col, "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot"))
