"""MinHash near-duplicates: consistent weighted samples of TF-IDF shingles, banded and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.llm.blocks import checked_ids, in_block_pairs, join_split, runs
from weblake.llm.components import connected_components
from weblake.llm.storage import dropped, stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**4) ** 20 < 0.00003.
BANDS, BAND_ROWS = 20, 4
SAMPLES = BANDS * BAND_ROWS
#: With P shingles in all (each once a document), a shingle in more than P / FREQUENT families has a
#: weight of its own; those in fewer all weigh alike. So FREQUENT bounds the table for any corpus.
FREQUENT = 1 << 17
#: A chunk of shingles passes on those that make up more than 1 / PASSED of it, so a count over all
#: chunks is short by P / PASSED at most, half of what makes a shingle frequent.
PASSED = 2 * FREQUENT
#: Ranges of hashes in which chunks pass on their shingles, each as one array.
RANGES = 64
#: Shingles, or pairs of shingle and family, that a task gathers before it passes them on.
GATHERED = 1 << 21
#: Where there are more than TASKS partitions for each core, up to JOINED of them are gathered in one task.
TASKS, JOINED = 4, 8
#: Members of a bucket in different classes are compared if their samples agree this much:
#: five standard deviations of the estimate below the threshold.
LEAST_ESTIMATE = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / SAMPLES) ** 0.5
#: A block holds about so many texts, and so many words.
BLOCK_ROWS = 512
BLOCK_WORDS = 1_000_000
#: Members that one copy of their leader's text is sent with.
LED_ROWS = 256
#: Signatures that a task remembers, so that a copy is not sampled again.
REMEMBERED = 4096
CHUNK = 512
COLUMNS = 4096
#: Sums of weights in another order differ by less.
ROUNDING = 1e-6

_TABLES: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> dict[str, np.ndarray]:
    """Word characters by code point, and quantiles of the distributions that the samples draw from."""
    if not _TABLES:
        _TABLES["word"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        grid = np.concatenate([np.linspace(0, 1, 400_000), np.linspace(1, 40, 400_000)[1:]])
        gamma = np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + grid) * np.exp(-grid), grid)
        _TABLES["gamma"] = gamma.astype(np.float32)
        _TABLES["log gamma"] = np.log(gamma).astype(np.float32)
        _TABLES["seeds"] = _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _TABLES


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text: its runs of letters and digits, lowered."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _tables()["word"][points]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(lengths.max(), 0x9E3779B97F4A7C15, np.uint64))
    codes = _mix(points[at].astype(np.uint64)) * powers[place]
    return _mix(np.add.reduceat(codes, starts) + lengths.astype(np.uint64))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray, str]:
    """Hashes of a text's distinct shingles, sorted, how often each occurs, and a digest of its words.

    A text of fewer words than a shingle has one of all its words; one without words has none.
    """
    words = word_hashes(text or "")
    if not len(words):
        return words, np.zeros(0, np.int64), ""
    n = min(SHINGLE_WORDS, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(h)]
    found, counts = np.unique(_mix(h), return_counts=True)
    return found, counts, hashlib.md5(words.tobytes()).hexdigest()


def _known(hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are among the sorted hashes, and the places of these there."""
    at = np.searchsorted(hashes, h)
    inside = at < len(hashes)
    inside[inside] = hashes[at[inside]] == h[inside]
    return inside, at[inside]


class Idf(NamedTuple):
    """Weights of the frequent shingles, by their sorted hashes, and that of all others."""

    hashes: np.ndarray
    weights: np.ndarray
    rare: float

    def of(self, h: np.ndarray) -> np.ndarray:
        found = np.full(len(h), self.rare, np.float32)
        known, at = _known(self.hashes, h)
        found[known] = self.weights[at]
        return found


def weights(h: np.ndarray, counts: np.ndarray, idf: Idf) -> np.ndarray:
    return counts.astype(np.float32) * idf.of(h)


def samples(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples of a weighted set: SAMPLES 64-bit codes.

    Two sets have the same code in a place with the probability of their weighted Jaccard similarity.
    Each shingle's draws come from its hash: r and c from Gamma(2, 1), b uniform; with
    t = floor(log(w) / r + b), the shingle of the least log(c) - r * (t - b + 1) and its t are the sample.
    """
    t_, log_w = _tables(), np.log(w)
    best = np.full(SAMPLES, np.inf, np.float32)
    code = np.zeros(SAMPLES, np.uint64)
    every = np.arange(SAMPLES)
    for i in range(0, len(h), CHUNK):
        x = _mix(h[i : i + CHUNK, None] + t_["seeds"][None, :])
        r = t_["gamma"][x & np.uint64(0xFFFF)]
        b = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w[i : i + CHUNK, None] / r + b)
        a = t_["log gamma"][(x >> np.uint64(32)) & np.uint64(0xFFFF)] - r * (t - b + 1)
        k = a.argmin(axis=0)
        low = a[k, every]
        chosen = _mix(h[i + k] ^ _mix(t[k, every].astype(np.int64).view(np.uint64) + t_["seeds"]))
        code = np.where(low < best, chosen, code)
        best = np.minimum(low, best)
    return code


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights), ROUNDING added."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64) if len(common) else 0.0
    return low / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - low) + ROUNDING


def family(h: np.ndarray) -> int:
    """The least hash of a text's shingles, mixed once more: near copies mostly have the same."""
    return int(_mix(h[:1] ^ np.uint64(0xA5A5A5A5A5A5A5A5))[0])


def idf_of(hashes: np.ndarray, df: np.ndarray, least: float, families: int) -> Idf:
    """1 + log(N / df) / log(N / least), with df at least ``least``: from 1, for a shingle of all N families, to 2.

    A rare shingle weighs at most twice as much as a common one, and pairs are judged by that: near
    copies share common shingles and differ in rare ones, and by log(N / df) alone families fall
    apart whose members differ by one word in two hundred.
    """
    often = df > least
    order = np.argsort(hashes[often])
    scale = np.log(families / least) if families > least else 1.0
    own = 1 + np.log(families / df[often][order]) / scale
    return Idf(hashes[often][order], own.astype(np.float32), 2.0)


def _frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, float]:
    """Sorted hashes, at most PASSED, of all shingles in more than ``least`` documents (and a few in fewer), and ``least``.

    Chunks pass on arrays of shingles by ranges of hashes, so that their rows are as many as chunks and
    ranges, whatever the texts; a range's arrays are added up where they meet.
    """
    borders = np.array([(k << 64) // RANGES for k in range(1, RANGES)], np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(gathered), return_counts=True)
            often = n > held / PASSED
            found, n = found[often], n[often]
            cuts = np.concatenate([[0], np.searchsorted(found, borders), [len(found)]])
            some = np.flatnonzero(np.diff(cuts))
            # The range -1 says how many shingles the chunk held.
            of = pa.array([-1, *some.tolist()], pa.int64())
            parts = [slice(cuts[k], cuts[k + 1]) for k in some]
            hashes, counts = ([b"", *(x[p].tobytes() for p in parts)] for x in (found, n.astype(np.int64)))
            return pa.RecordBatch.from_arrays([of, pa.array([held, *[0] * len(some)], pa.int64()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["range", "held", "hashes", "counts"])

        gathered, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                h = shingles(text.as_py())[0]
                gathered.append(h)
                held += len(h)
                if held >= GATHERED:
                    yield chunk()
                    gathered, held = [], 0
        if held:
            yield chunk()

    # A chunk of less than PASSED shingles passes on all of them, so small partitions are joined.
    rows = docs.select(text_col)
    partitions = rows.rdd.getNumPartitions()
    rows = rows.coalesce(max(1, partitions // JOINED, min(partitions, TASKS * docs.sparkSession.sparkContext.defaultParallelism)))
    passed = stored(rows.mapInArrow(run, "range long, held long, hashes binary, counts binary"))
    least = max(1.0, (passed.agg(F.sum("held")).first()[0] or 0) / FREQUENT)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.zeros(len(found), np.int64)
            np.add.at(n, at, np.concatenate(counts))
            return found, n

        hashes, counts, new = [], [], 0
        for batch in batches:
            for h, n in zip(batch.column(0), batch.column(1), strict=True):
                hashes.append(np.frombuffer(h.as_py(), np.uint64))
                counts.append(np.frombuffer(n.as_py(), np.int64))
                new += len(hashes[-1])
                if new >= GATHERED:
                    found, n = added()
                    hashes, counts, new = [found], [n], 0
        if hashes:
            found, n = added()
            yield pa.RecordBatch.from_arrays([pa.array([found[n > max(1.0, least / 2)].tobytes()], pa.binary())], names=["hashes"])

    dealt = passed.where("range >= 0").repartition(RANGES, "range").select("hashes", "counts")
    found = dealt.mapInArrow(add, "hashes binary").toArrow()["hashes"].to_pylist()
    dropped(passed)
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h, np.uint64) for h in found)])), least


def learn_idf(docs: DataFrame, text_col: str = "text") -> Idf:
    """``idf_of`` over all documents with words.

    df counts families of documents, those of the same least hash, so that thousands of near copies
    do not make their own text common: df of a shingle is the exact number of families that have
    it in any of their documents. Two passes over the texts: chunks of shingles pass on what is
    frequent in them, which loses none that is frequent in all; then only these are counted, each once
    a family. Which shingles a chunk passes on depends on the files, the weights do not. The driver
    gets at most PASSED hashes and counts, whatever the corpus.
    """
    context = docs.sparkSession.sparkContext
    hashes, least = _frequent(docs, text_col)
    known = context.broadcast(hashes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> pa.RecordBatch:
            at, of = np.concatenate(gathered), np.repeat(np.array(families, np.uint64).view(np.int64), [len(g) for g in gathered])
            order = np.lexsort((of, at))
            at, of = at[order], of[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
            return pa.RecordBatch.from_arrays([pa.array(at[new]), pa.array(of[new])], names=["at", "family"])

        gathered, families, held = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                h = shingles(text.as_py())[0]
                if not len(h):
                    continue
                # The place -1 counts the families themselves.
                gathered.append(np.append(_known(known.value, h)[1], -1))
                families.append(family(h))
                held += len(gathered[-1])
                if held >= GATHERED:
                    yield pairs()
                    gathered, families, held = [], [], 0
        if held:
            yield pairs()

    counts = docs.select(text_col).mapInArrow(run, "at long, family long").groupBy("at").agg(F.count_distinct("family").alias("n")).toArrow()
    at, n = counts["at"].to_numpy(), counts["n"].to_numpy()
    known.unpersist()
    return idf_of(hashes[at[at >= 0]], n[at >= 0], least, int(n[at < 0].sum()))


def signatures(docs: DataFrame, idf, id_col: str, text_col: str) -> DataFrame:
    """id, ``words`` (digest of the words), ``size`` (their shingles), ``bands`` (a code for each band) and ``codes`` (samples, 4 bytes each).

    Documents without words are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, bytes]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                ids, digests, sizes, bands, codes = [], [], [], [], []
                for at, text in zip(part.column(0), part.column(1), strict=True):
                    h, n, words = shingles(text.as_py())
                    if not words:
                        continue
                    if words not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        s = samples(h, weights(h, n, idf.value))
                        of_band = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
                        for k in range(BAND_ROWS):
                            of_band = _mix(of_band * np.uint64(0x9E3779B97F4A7C15) + s[k::BAND_ROWS])
                        known[words] = of_band.view(np.int64), s.astype(np.uint32).tobytes()
                    ids.append(at.as_py())
                    digests.append(words)
                    sizes.append(int(n.sum()))
                    bands.append(known[words][0])
                    codes.append(known[words][1])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(codes, pa.binary())], names=["id", "words", "size", "bands", "codes"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col)).mapInArrow(run, "id long, words string, size long, bands array<bigint>, codes binary")


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) whose texts have a weighted Jaccard similarity of SIMILARITY or more.

    The members b of a leader a are dealt to salts of about LED_ROWS each; the leader's text goes once
    to each salt, ahead of them, so no group meets in one task.
    """
    counts = stored(pairs.groupBy("a").agg(F.count("*").alias("n")))
    salted = join_split(pairs, counts, "a", "n")
    salted = stored(salted.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / LED_ROWS)).alias("salt")))
    texts = texts.select("id", "text")
    heads = salted.select("a", "salt", F.col("a").alias("id")).distinct().join(texts, "id").select("a", "salt", F.lit(0).alias("led"), "id", "text")
    led = salted.select("a", "salt", F.col("b").alias("id")).join(texts, "id").select("a", "salt", F.lit(1).alias("led"), "id", "text")
    dealt = heads.unionByName(led).repartition("a", "salt").sortWithinPartitions("a", "salt", "led")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            a, b = [], []
            for head, led, i, text in zip(*(batch.column(c) for c in (0, 2, 3, 4)), strict=True):
                h, n, _ = shingles(text.as_py())
                this = h, weights(h, n, idf.value)
                if not led.as_py():
                    leader = this
                elif similarity(leader, this) >= SIMILARITY:
                    a.append(head.as_py())
                    b.append(i.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _overlaps(sets: list[tuple[np.ndarray, np.ndarray]], idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Weights that each two texts share, and each text's own weight, of (hashes, counts) of several texts.

    A shingle that occurs k times is k items; what two texts share is then a product of matrices over
    the items that two or more of the texts have.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [c.sum() for _, c in sets])
    item = np.concatenate([np.repeat(h, c) for h, c in sets])
    nth = np.concatenate([np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for _, c in sets])
    weight = idf.of(item).astype(np.float64)
    own = np.bincount(owner, weights=weight, minlength=n)
    keys = item + _mix(nth.astype(np.uint64)) * (nth > 0)
    _, column, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, weight = owner[shared], weight[shared]
    column = np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((n, n))
    for start in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        now = (column >= start) & (column < start + COLUMNS)
        has, worth = np.zeros((n, COLUMNS)), np.zeros(COLUMNS)
        has[owner[now], column[now] - start] = 1
        worth[column[now] - start] = weight[now]
        both += (has * worth) @ has.T
    return both, own


def _forest(nodes: np.ndarray, link: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node it reaches) of a graph given by a matrix."""
    least = nodes.copy()
    while True:
        after = np.minimum(least, np.where(link, least[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (after == least).all():
            return [(int(a), int(b)) for a, b in zip(nodes, least, strict=True) if a != b]
        least = after


def _links_in_blocks(members: DataFrame, idf) -> DataFrame:
    """Links (a, b) between members of a bucket whose classes differ, as spanning forests of pairs of blocks.

    members: code, id, n (members of the bucket), size (their shingles), class, codes, band, text. Each
    pair is looked at in the first band that it shares; where the samples agree enough, the texts'
    shingles decide, all pairs of a block at once.
    """
    keys = ["code", "first", "second"]
    of_words = F.ceil(F.col("size") * F.lit(BLOCK_ROWS / BLOCK_WORDS))
    dealt = in_block_pairs(members, F.greatest(F.col("n"), of_words), F.xxhash64("id"), BLOCK_ROWS)
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            ids, classes, of = (t[c].to_numpy() for c in ("id", "class", "of"))
            if len(ids) < 2 or (classes == classes[0]).all():
                continue
            codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint32).reshape(len(ids), SAMPLES)
            band, first, second = t["band"][0].as_py(), t["first"][0].as_py(), t["second"][0].as_py()
            likely = np.zeros((len(ids), len(ids)), bool)
            for i in np.flatnonzero(of == first):
                agree = codes == codes[i]
                here = agree.reshape(len(ids), BANDS, BAND_ROWS).all(axis=2).argmax(axis=1) == band
                likely[i] = here & (of == second) & (classes != classes[i]) & (agree.mean(axis=1) >= LEAST_ESTIMATE)
            likely |= likely.T
            at = np.flatnonzero(likely.any(axis=1))
            if not len(at):
                continue
            texts = t["text"]
            both, own = _overlaps([shingles(texts[int(i)].as_py())[:2] for i in at], idf.value)
            linked = likely[np.ix_(at, at)] & (both >= SIMILARITY * (own[:, None] + own[None, :] - both) - ROUNDING)
            if forest := _forest(ids[at], linked):
                a, b = zip(*forest, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.select(*keys, "of", "id", "class", "band", "codes", "text").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate documents: id, class_id (the smallest id of the class) and kept.

    Two documents are linked if the weighted Jaccard similarity of their TF-IDF shingles of five
    words is 0.8 or more; a class holds all that links reach, and its smallest id is kept. Words are
    runs of letters and digits, lowered; documents of equal words are one text. A null text or one
    without words is a class of its own; so is a row without id, with a null class_id and kept true.
    Ids are whole numbers, other types are refused; equal rows share a class, and rows of one id
    with different texts, which should be numbered first, are judged text by text. Other input
    columns are left out.

    Documents of equal words are compared once. Of each bucket of a band, every member is verified
    against the smallest id; what is still in different classes is then compared in blocks by
    samples, and verified if those agree enough, so nothing is capped and a bucket of copies costs one
    comparison for each. Verification reads the texts again, only those of candidates, and passes on
    links, not the pairs it looked at. Rows of hot buckets, texts and leaders stay spread over tasks.
    """
    docs = checked_ids(docs, id_col)
    context = docs.sparkSession.sparkContext
    idf = context.broadcast(learn_idf(docs, text_col))
    signed = stored(signatures(docs, idf, id_col, text_col))
    texts_of = stored(signed.groupBy("words").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    reps = stored(signed.join(texts_of.select(F.col("first").alias("id")), "id", "left_semi").dropDuplicates(["id"]))
    banded = reps.select("id", "size", F.posexplode("bands").alias("band", "code"))
    buckets = stored(banded.groupBy("code").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1"))
    members = stored(join_split(banded, buckets, "code", "n"))

    led = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    candidates = members.select("id").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(candidates, "id", "left_semi").dropDuplicates(["id"])
    texts = stored(texts)
    classes = stored(connected_components(verified(led, texts, idf)))

    classed = members.where("n > 2").join(classes, "id", "left").withColumn("class", F.coalesce("component", "id"))
    open_ = classed.groupBy("code").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n"), F.sum("size").alias("size"))
    open_ = stored(open_.where("low <> high").select("code", "n", "size"))
    classed = join_split(classed.select("code", "id", "band", "class"), open_, "code", "n")
    more = stored(_links_in_blocks(classed.join(reps.select("id", "codes"), "id").join(texts, "id"), idf))
    if not more.isEmpty():
        links = classes.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
        classes = stored(connected_components(links))

    named = texts_of.join(classes.withColumnRenamed("id", "first"), "first", "left").select("words", "n", F.coalesce("component", "first").alias("class_id"))
    # Only ids and digests are read later: the signatures' files can go.
    slim = stored(signed.select("id", "words"))
    found = join_split(slim, stored(named), "words", "n").select("id", "class_id")
    alone = docs.select(F.col(id_col).alias("id"))
    rest = alone.where("id is not null").join(slim.select("id").distinct(), "id", "left_anti").unionByName(alone.where("id is null"))
    dropped(members, texts, signed, reps, buckets)
    return found.unionByName(rest.select("id", F.col("id").alias("class_id"))).select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))
