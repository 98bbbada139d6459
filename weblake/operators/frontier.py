"""Dedup, order and limits of URL and item tables, and the frontier of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblake.functions import urls
from weblake.operators.joins import left_join_split
from weblake.operators.storage import dropped, stored
from weblake.operators.tables import numbered_by


def _first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row by ``order`` (nulls first) of each key: an aggregation, so of a hot key each task passes on one row."""
    return df.groupBy(F.col(key).alias("its key")).agg(F.min_by(F.struct(*df.columns), F.struct(order)).alias("its row")).select("its row.*")


def dedupe_urls(df: DataFrame, url: str, order: str, normalized: bool = False) -> DataFrame:
    """First row by ``order`` per canonical (or normalized) URL, and ``url_key``."""
    key = urls.normalize_url(F.col(url)) if normalized else urls.canonicalize_url(F.col(url))
    return _first(df.withColumn("url_key", key), "url_key", order)


def dedupe_by_id(df: DataFrame, id_col: str, order: str) -> DataFrame:
    return _first(df, id_col, order)


def frontier_order(frontier: DataFrame, lifo: bool = False) -> DataFrame:
    """Jobs to do, by priority, then by insertion (last first if ``lifo``)."""
    return frontier.where("status = 'todo'").orderBy("priority", F.desc("index") if lifo else F.asc("index"))


def frontier_places(frontier: DataFrame, lifo: bool = False) -> DataFrame:
    """All jobs to do, and ``place``, 1, 2, ... in the order of ``frontier_order``."""
    order = [F.asc("priority"), F.desc("index") if lifo else F.asc("index")]
    return numbered_by(frontier.where("status = 'todo'"), order, "place", start=1)


def politeness_plan(frontier: DataFrame, throttle: float = 0.2, parallelism: int = 1) -> DataFrame:
    """Jobs to do with ``batch`` and ``start``, seconds from now, if requests took no time.

    Per group, ``parallelism`` at once and ``throttle`` seconds between; jobs without group start at once.
    A group is cut into ranges of its order that are numbered alone, so a hot group is no single task.
    """
    todo = frontier.where("status = 'todo'")
    order = ["priority", "index"]
    grouped = numbered_by(todo.where("group is not null"), order, "turn", within=("group",))
    grouped = grouped.withColumn("batch", F.floor(F.col("turn") / parallelism)).select(*todo.columns, "batch")
    free = todo.where("group is null").withColumn("batch", F.lit(0).cast("long"))
    return grouped.unionByName(free).withColumn("start", F.col("batch") * F.lit(throttle))


def planned_releases(jobs: DataFrame, group: str, index: str, at: str, duration: str, throttle: int = 200_000) -> DataFrame:
    """``jobs`` and ``release``: when each may start if a group does one at a time, with known durations (all in microseconds).

    Jobs go by ``at``, then index; after the one before has ended a group rests for ``throttle``. With S the sum of
    durations and rests before a job, its release is S and the largest at - S up to it: a running maximum. Ranges of a group
    are worked out alone and shifted by what the ranges before add up to, so a hot group is no single task.
    Jobs without a group start at ``at``. Times and durations are not null; of equal ones any order gives the same plan.
    """
    ranged = stored(jobs.where(F.col(group).isNotNull()).repartitionByRange(group, at, index).withColumn("its range", F.spark_partition_id()))
    running = Window.partitionBy(group, "its range").orderBy(at, index).rowsBetween(Window.unboundedPreceding, 0)
    cost = F.col(duration) + throttle
    local = ranged.withColumn("sum", F.sum(cost).over(running) - cost).withColumn("wait", F.max(F.col(at) - F.col("sum")).over(running))
    parts = local.groupBy(group, "its range").agg(F.sum(cost).alias("cost"), F.max("wait").alias("most"))
    before = Window.partitionBy(group).orderBy("its range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.withColumn("shift", F.coalesce(F.sum("cost").over(before), F.lit(0)))
    shifts = shifts.withColumn("waited", F.max(F.col("most") - F.col("shift")).over(before)).select(group, "its range", "shift", "waited")
    release = F.col("shift") + F.col("sum") + F.greatest(F.col("wait") - F.col("shift"), "waited")
    planned = local.join(shifts, [group, "its range"]).select(*jobs.columns, release.cast("long").alias("release"))
    return planned.unionByName(jobs.where(F.col(group).isNull()).withColumn("release", F.col(at).cast("long")))


def best_caption_track(tracks: DataFrame, video: str, langs: list[str], strict: bool = False) -> DataFrame:
    """Per video the track of the most preferred language; written before generated, then by language."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, langs)), F.col("lang")), F.lit(0)), F.lit(len(langs) + 1))
    ranked = tracks.withColumn("lang rank", rank)
    if strict:
        ranked = ranked.where(F.col("lang rank") <= len(langs))
    return ranked.groupBy(video).agg(F.min_by(F.struct(*[c for c in tracks.columns if c != video]), F.struct("lang rank", "generated", "lang")).alias("t")).select(video, "t.*")


def _tour(nodes: DataFrame, post: str) -> DataFrame:
    """The steps of a walk round each post's trees: el, pred (the step before), enters, down, rooted.

    A node is entered, its children are walked round one after the other, and it is left: step 2 * num
    enters, 2 * num + 1 leaves. A step has at most one step after it, so no key of ``pred`` repeats.
    nodes: post, id, up, at and num, a number of its own for each node.
    """
    own = nodes.select("num", "id", "at", F.col("up").isNull().alias("root"), post, F.when(F.col("up").isNotNull(), F.struct(F.col(post), F.col("up").alias("id"))).alias("parent"))
    known = left_join_split(own, nodes.select(F.struct(F.col(post), F.col("id")).alias("parent"), F.col("num").alias("above")), "parent")
    # Nodes whose parent is missing begin a walk of their own, which no root leads to.
    family = F.struct(F.col(post), F.coalesce("above", F.lit(-1)).alias("above"), F.when(F.col("root") | F.col("above").isNotNull(), F.lit(-1)).otherwise(F.col("num")).alias("alone"))
    places = stored(numbered_by(known.select("num", "root", "above", family.alias("family"), "at", "id"), ["at", "id"], "place", within=("family",)))
    before = places.select("family", (F.col("place") + 1).alias("place"), F.col("num").alias("prior"))
    last = places.where("above is not null").groupBy(F.col("above").alias("num")).agg(F.max_by("num", "place").alias("last"))
    linked = places.join(before, ["family", "place"], "left").join(last, "num", "left")
    enter = F.struct(
        (F.col("num") * 2).alias("el"), F.coalesce(F.col("prior") * 2 + 1, F.col("above") * 2).alias("pred"), F.lit(1).cast("long").alias("enters"), F.lit(1).cast("long").alias("down"), F.col("root").alias("rooted"),
    )
    leave = F.struct(
        (F.col("num") * 2 + 1).alias("el"), F.coalesce(F.col("last") * 2 + 1, F.col("num") * 2).alias("pred"), F.lit(0).cast("long").alias("enters"), F.lit(-1).cast("long").alias("down"), F.lit(False).alias("rooted"),
    )
    return linked.select(F.explode(F.array(enter, leave)).alias("s")).select("s.*")


def thread_order(comments: DataFrame, post: str, id_col: str, parent: str, arrival: str) -> DataFrame:
    """``comments``, depth, position and error: a comment, then its replies, siblings by arrival, then id.

    The trees of a post are walked round (see ``_tour``), and each step of the walk learns how many nodes
    were entered up to it, and how deep it is, by pointers that double: as many joins as the logarithm
    of the post's comments, however deep they are, by keys that never repeat. All rows stay: those that no
    root reaches (a parent is missing, they are their own ancestors, or post or id are null) have an error
    and no place; rows of one id share one, by the least of their parents (null first) and arrivals.
    """
    rows = comments.select(post, F.col(id_col).alias("id"), F.struct(F.col(parent).alias("up"), F.col(arrival).alias("at")).alias("n")).where(F.col(post).isNotNull() & F.col("id").isNotNull())
    nodes = stored(rows.groupBy(post, "id").agg(F.min("n").alias("n")).select(post, "id", "n.up", "n.at", F.monotonically_increasing_id().alias("num")))
    most = nodes.groupBy(post).count().agg(F.max("count")).head()[0] or 0
    steps = stored(_tour(nodes, post))
    # Steps that go round in a circle never come to a beginning.
    for _ in range((2 * most).bit_length()):
        on = steps.where("pred is not null")
        if on.isEmpty():
            break
        back = steps.select(F.col("el").alias("pred"), *(F.col(c).alias(f"b {c}") for c in ("pred", "enters", "down", "rooted")))
        joined = on.join(back, "pred").select("el", F.col("b pred").alias("pred"), (F.col("enters") + F.col("b enters")).alias("enters"), (F.col("down") + F.col("b down")).alias("down"), F.col("b rooted").alias("rooted"))
        after = stored(joined.unionByName(steps.where("pred is null")))
        dropped(steps)
        steps = after
    placed = steps.where("pred is null and rooted and el % 2 = 0").select(F.shiftright("el", 1).alias("num"), (F.col("down") - 1).cast("int").alias("depth"), F.col("enters").cast("int").alias("position"))
    placed = placed.join(nodes.select("num", post, F.col("id").alias(id_col)), "num").drop("num")
    out = comments.join(placed, [post, id_col], "left")
    return out.withColumn("error", F.when(F.col("depth").isNull(), "no-root"))


def limit_per_query(df: DataFrame, query: str, order: Column | str, n: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(query).orderBy(order))).where(F.col("nth") <= n).drop("nth")


def dump_queue(frontier: DataFrame, resumed: bool = False, cleanup: bool = False) -> DataFrame:
    """The queue by index; resumed: what was being done is to do again; cleanup: done jobs go, but for the last index."""
    out = frontier.withColumn("status", F.when(F.lit(resumed) & (F.col("status") == "doing"), "todo").otherwise(F.col("status")))
    if cleanup:
        last = out.agg(F.max("index")).first()[0]
        out = out.where((F.col("status") != "done") | (F.col("index") == F.lit(last)))
    return out.orderBy("index")


def next_frontier(new: DataFrame, frontier: DataFrame, seen: DataFrame, url: str, order: str) -> DataFrame:
    """The frontier and new targets, each URL once, without those seen."""
    both = frontier.unionByName(new, allowMissingColumns=True)
    keyed = dedupe_urls(both, url, order)
    known = seen.select(urls.canonicalize_url(F.col(url)).alias("url_key"))
    return keyed.join(known, "url_key", "left_anti").drop("url_key")
