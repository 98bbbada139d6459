"""Near-duplicate vectors: an exact metric range join over pivot cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblake.llm.blocks import checked_ids, join_split, runs
from weblake.llm.components import connected_components
from weblake.llm.storage import dropped, stored

COSINE = 0.98
#: A cell for so many distinct vectors of a label, up to MOST_CELLS; only the LABELS largest labels are cut into
#: cells, others are one cell each. Pivots are chosen among SAMPLE_ROWS vectors of the label, those of the smallest
#: hashed ids. That bounds what the driver gathers and what is broadcast.
CELL_ROWS = 1024
MOST_CELLS = 128
LABELS = 64
SAMPLE_ROWS = 512
BLOCK_ROWS = 1024
#: Slack for rounding in the bounds that leave cells out; links themselves are decided by the cosine.
SLACK = 1e-9


def unit_vectors(vectors: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one length over their lengths, in double precision."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    # Scaled first, so that squares of very large or small components neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, str]:
    """id, label, dim, digest and ``vec`` (the components, packed) of usable vectors, and the numpy type of ``vec``."""
    label = vectors.schema[label_col].dataType.simpleString()
    kind = "float32" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "float64"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, dims, digests, packed = [], [], [], []
            for i, vector in enumerate(batch.column(2)):
                if not vector.is_valid or vector.values.null_count:
                    continue
                x = np.asarray(vector.values.to_numpy(zero_copy_only=False), kind) + np.zeros(1, kind)  # -0.0 is 0.0
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    continue
                at.append(i)
                dims.append(len(x))
                digests.append(hashlib.md5(x.tobytes()).hexdigest())
                packed.append(x.tobytes())
            good = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([good.column(0), good.column(1), pa.array(dims, pa.int32()), pa.array(digests, pa.string()), pa.array(packed, pa.binary())], names=["id", "label", "dim", "digest", "vec"])

    rows = vectors.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, label_col, vector_col)
    return rows.mapInArrow(run, f"id long, label {label}, dim int, digest string, vec binary"), kind


def choose_pivots(distinct: DataFrame, kind: str) -> dict[tuple, np.ndarray]:
    """For each of the LABELS largest (label, dim): pivots, each the farthest of the sample from those before.

    Labels of fewer than two cells have none.
    """
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * CELL_ROWS)
    sizes = {(r.label, r.dim): r.n for r in sizes.orderBy(F.desc("n"), "label", "dim").limit(LABELS).collect()}
    if not sizes:
        return {}
    place = F.row_number().over(Window.partitionBy("label", "dim").orderBy(F.xxhash64("id"), "id"))
    rows = distinct.where(F.col("label").isin(*{label for label, _ in sizes})).select("label", "dim", "vec", "id").withColumn("place", place).where(F.col("place") <= SAMPLE_ROWS)
    samples: dict[tuple, list[bytes]] = {}
    for r in rows.orderBy("label", "dim", "place").collect():
        samples.setdefault((r.label, r.dim), []).append(bytes(r.vec))
    pivots = {}
    for key, n in sizes.items():
        if key not in samples:
            continue
        points = unit_vectors(samples[key], kind)
        chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < min(MOST_CELLS, n // CELL_ROWS, len(points)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
        pivots[key] = points[chosen]
    return pivots


def _in_cells(distinct: DataFrame, pivots, kind: str, radius: float) -> DataFrame:
    """Each vector at home in the cell of its nearest pivot, and asking in each cell that may hold a neighbour.

    A neighbour y within ``radius`` of x whose nearest pivot is q has d(x, q) <= d(y, q) + radius <=
    d(y, p) + radius <= d(x, p) + 2 * radius for x's own nearest pivot p: other cells are left out by
    the triangle inequality. Of the rest, those go whose border, the plane midway between p and q, is
    farther from x than the radius. Both vectors of a pair would ask in the other's cell; of two cells,
    only those at home in one ask in the other, so each pair meets once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(get("label"), get("dim"), strict=True)):
                groups.setdefault(key, []).append(i)
            vec = get("vec")
            rows, cells, homes = [], [], []
            for key, at in groups.items():
                points = pivots.value.get(key)
                at = np.array(at)
                if points is None:
                    home, i, cell = np.zeros(len(at), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                else:
                    x, n = unit_vectors([vec[i] for i in at], kind), len(points)
                    square = np.maximum(0, 2 - 2 * x @ points.T)
                    home = square.argmin(axis=1)
                    near = square[np.arange(len(at)), home]
                    between = np.linalg.norm(points[:, None, :] - points[None, :, :], axis=2)
                    ask = np.sqrt(square) <= np.sqrt(near)[:, None] + 2 * radius + SLACK
                    ask &= (square - near[:, None]) <= 2 * between[home] * (radius + SLACK) + SLACK
                    ahead = (home[:, None] - np.arange(n)[None, :]) % n
                    ask &= (2 * ahead < n) & (ahead > 0) | (2 * ahead == n) & (np.arange(n)[None, :] < home[:, None])
                    i, cell = np.nonzero(ask)
                rows += [at, at[i]]
                cells += [home, cell]
                homes += [np.ones(len(at), bool), np.zeros(len(i), bool)]
            if rows:
                out = batch.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(homes))], names=[*batch.schema.names, "cell", "home"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema.fields)
    return distinct.mapInArrow(run, f"{fields}, cell int, home boolean")


def _dealt(cells: DataFrame) -> DataFrame:
    """Cells cut into blocks, and each row sent to the pairs of blocks that it takes part in.

    Blocks 0 to h - 1 hold those at home, the rest those that ask; a pair has a home block first, and
    each row knows ``of``, its own. A cell of few rows is one block of all, paired with itself.
    """
    place = ["label", "dim", "cell"]
    sizes = stored(cells.groupBy(*place).agg(F.sum(F.col("home").cast("int")).alias("homes"), F.sum((~F.col("home")).cast("int")).alias("asks"), F.count("*").alias("n")))
    rows = join_split(cells, sizes, place, "n")
    small = F.col("n") <= 4 * BLOCK_ROWS
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK_ROWS)).cast("int")
    rows = rows.withColumn("h", F.when(small, 1).otherwise(blocks("homes"))).withColumn("a", F.when(small, 0).otherwise(blocks("asks")))
    salt = F.xxhash64("id")
    rows = rows.withColumn("of", F.when(F.col("home") | small, F.pmod(salt, F.col("h"))).otherwise(F.col("h") + F.pmod(salt, F.col("a"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("h") + F.col("a")).otherwise(F.col("h")) - 1)))
    return rows.withColumn("first", F.least("of", "other")).withColumn("second", F.greatest("of", "other"))


def _linked(cells: DataFrame, kind: str, cosine: float) -> DataFrame:
    """Of the pairs of blocks: (id, n, null) with an id's number of links, and (id, null, to), a spanning forest of them."""
    keys = ["label", "dim", "cell", "first", "second"]
    dealt = _dealt(cells).repartition(*keys).sortWithinPartitions(*keys).select(*keys, "of", "id", "copies", "vec", "home")
    far = np.iinfo(np.int64).max

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            home, of, ids, copies = (t[c].to_numpy() for c in ("home", "of", "id", "copies"))
            same = t["first"][0].as_py() == t["second"][0].as_py()
            a = np.flatnonzero(home & (of == t["first"][0].as_py()))
            b = np.flatnonzero(~home) if same else np.flatnonzero(of == t["second"][0].as_py())
            if not len(a) or len(a) + len(b) < 2:
                continue
            x = unit_vectors(t["vec"].to_pylist(), kind)
            across = (x[a] @ x[b].T >= cosine) & (ids[a][:, None] != ids[b][None, :])
            n_a, n_b = across @ copies[b], copies[a] @ across
            within = np.zeros((0, 0), bool)
            if same:
                # Which of two equal pairs a product of matrices rounds how depends on its shape: one half decides.
                within = np.triu(x[a] @ x[a].T >= cosine, 1) & (ids[a][:, None] != ids[a][None, :])
                within |= within.T
                n_a = n_a + within @ copies[a]
            some_a, some_b = np.flatnonzero(n_a), np.flatnonzero(n_b)
            if not len(some_a):
                continue
            across = across[np.ix_(some_a, some_b)]
            within = within[np.ix_(some_a, some_a)] if same else within
            nodes = np.concatenate([ids[a][some_a], ids[b][some_b]])
            least = nodes.copy()
            while True:  # the smallest id that each reaches within the run
                of_a, of_b = least[: len(some_a)], least[len(some_a) :]
                new_a = np.minimum(of_a, np.where(across, of_b[None, :], far).min(axis=1, initial=far))
                if same:
                    new_a = np.minimum(new_a, np.where(within, new_a[None, :], far).min(axis=1, initial=far))
                new = np.concatenate([new_a, np.minimum(of_b, np.where(across, new_a[:, None], far).min(axis=0, initial=far))])
                if (new == least).all():
                    break
                least = new
            n = np.concatenate([n_a[some_a], n_b[some_b]]).astype(np.int64)
            moved = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n), pa.array(least, mask=~moved)], names=["id", "n", "to"])

    return dealt.mapInArrow(run, "id long, n long, to long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of equal labels whose cosine, in double precision, is ``cosine`` or more.

    Returns id, n_links (other vectors linked directly), component_id (the smallest id that links
    reach, itself included) and kept (id = component_id); no other input columns. Vectors that are
    null, empty, zero or hold null or non-finite components, and those of a null label or without
    id, link with nothing (without id: component_id is null, kept true); so do vectors of different
    lengths. Ids are whole numbers, other types are refused; each row is a vector, also where rows
    repeat; different vectors of one id do not link with each other and share their links.

    On unit vectors the cosine is a distance, so this is a range join of radius sqrt(2 - 2 * cosine).
    Equal vectors of a label are joined as one with a count of copies. Pivots, in number as the label's
    rows need and from a bounded sample, cut a label into cells; a vector is at home in one and asks
    in those that its radius reaches. Cells are compared in pairs of blocks, each pair of vectors
    once, and pass on counts and spanning forests, not pairs.
    """
    vectors = checked_ids(vectors, id_col)
    context = vectors.sparkSession.sparkContext
    usable, kind = _usable(vectors, id_col, vector_col, label_col)
    usable = stored(usable)
    same = ["label", "dim", "digest"]
    distinct = stored(usable.groupBy(*same).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("vec").alias("vec")))
    pivots = context.broadcast(choose_pivots(distinct, kind))
    cells = _in_cells(distinct.select("id", "label", "dim", "vec", "copies"), pivots, kind, float(np.sqrt(max(0.0, 2 - 2 * cosine))))
    linked = stored(_linked(cells, kind, cosine))
    counts = linked.groupBy("id").agg(F.sum("n").alias("n"))
    components = connected_components(linked.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))

    known = distinct.drop("vec").join(counts, "id", "left").join(components, "id", "left")
    known = stored(known.select(*same, "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    found = join_split(usable.select("id", *same), known, same, "copies").select("id", "n_links", "component_id")
    alone = vectors.select(F.col(id_col).alias("id"))
    rest = alone.where("id is not null").join(usable.select("id").distinct(), "id", "left_anti").unionByName(alone.where("id is null"))
    rest = rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    dropped(distinct)
    return found.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
