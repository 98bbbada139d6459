"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from weblake.llm.bpe import byte_letters
from weblake.llm.storage import ROW, dropped, stored

#: White space that a piece model writes as this letter.
SPACE = "▁"
#: Code points of texts that are aligned together, and chunks and code points that a task remembers.
SLICE = 1 << 20
REMEMBERED = 1 << 18
REMEMBERED_CHARS = 1 << 25
#: Pairs whose counts are sent to every task: the most frequent ones. All others are counted by a join.
FREQUENT = 1 << 19
#: Documents whose links are scored together.
ROWS = 512
#: Counts are told apart by this many steps for each doubling when the frequent ones are chosen.
STEPS = 8


@dataclass
class CSR:
    """A sparse matrix by rows: ``starts`` of each row (and the end) in ``columns`` and ``values``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int) -> CSR:
        """From entries in any order; entries of one place are added."""
        few = not len(columns) or columns.max() < 1 << 32
        order = np.argsort(rows << 32 | columns) if few else np.lexsort((columns, rows))
        rows, columns, values = rows[order], columns[order], values[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])
        at = np.flatnonzero(new)
        added = np.add.reduceat(values, at) if len(at) else values
        return cls(np.searchsorted(rows[at], np.arange(n_rows + 1)), columns[at], added)

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def only(self, rows: np.ndarray) -> CSR:
        """These rows."""
        lengths = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[rows] - starts[:-1], lengths) + np.arange(starts[-1])
        return CSR(starts, self.columns[at], self.values[at])

    def times(self, other: CSR) -> CSR:
        """The product by Gustavson's rows: each entry (i, k) brings row k of the other, scaled, to row i."""
        lengths = np.diff(other.starts)[self.columns]
        at = np.repeat(other.starts[self.columns] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        rows = np.repeat(self.rows, lengths)
        return CSR.of(rows, other.columns[at], np.repeat(self.values, lengths) * other.values[at], len(self.starts) - 1)


class Aligner:
    """Two vocabularies, and the chunks of text that a task has aligned with them."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.byte_bpe = Tokenizer.from_file(byte_vocabulary)
        self.byte_bpe.encode_special_tokens = True
        self.byte_bpe.no_padding()
        self.byte_bpe.no_truncation()
        self.pieces = SentencePieceProcessor(model_file=piece_model)
        of = {c: i for i, c in enumerate(byte_letters())}
        size = self.byte_bpe.get_vocab_size()
        tokens = [self.byte_bpe.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in tokens]
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.b_bits = max(1, (len(names) - 1).bit_length())
        with open(byte_vocabulary, encoding="utf-8") as f:
            split = json.load(f)["pre_tokenizer"] or {}
        # Before a single space both begin anew: the one splits words there, the other has no piece across.
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", False) and not any(SPACE in p.lstrip(SPACE) for p in names)
        self.space = re.compile(r"(?<=\S) (?=\S)")
        self.edged = re.compile(r"\A\s|\s\Z|\A\Z")
        self.forget()

    def forget(self, kept: np.ndarray | None = None) -> None:
        """Forgets all chunks but those ``kept`` (ascending numbers)."""
        if kept is None:
            #: For each chunk its number; by number the groups written out, the figures, whether its tokens spell it, its links and its uses.
            self.known: dict[str, int] = {}
            self.groups: list[str] = []
            self.figures, self.good, self.used = np.zeros((0, 5), np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
            self.links = CSR(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        else:
            names = list(self.known)
            self.known = {names[k]: n for n, k in enumerate(kept.tolist())}
            self.groups = [self.groups[k] for k in kept.tolist()]
            self.figures, self.good, self.used = self.figures[kept], self.good[kept], self.used[kept] // 2
            self.links = self.links.only(kept)
        self.plain: set[str] = set()
        self.chars = sum(map(len, self.known)) + sum(map(len, self.groups))

    def make_room(self) -> None:
        """Once too much is remembered, forgets the chunks that were used least; those used often stay."""
        if len(self.known) <= REMEMBERED and self.chars <= REMEMBERED_CHARS:
            return
        least = 2
        while (kept := np.flatnonzero(self.used >= least)).size > REMEMBERED // 2:
            least *= 2
        self.forget(kept)
        if self.chars > REMEMBERED_CHARS // 2:
            self.forget()

    def parts(self, text: str) -> list[str]:
        """The text cut before single spaces between other characters; these spaces begin the next part."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if new := set(parts).difference(self.plain):
            if any(map(self.edged.search, new)):
                return self.space.split(text)
            self.plain |= new
        return parts

    def learn(self, new: list[str]) -> None:
        """Aligns chunks that are not known yet.

        Tokens by bytes, A, and bytes by tokens, B transposed, have the product of overlap links: its
        rows tell which tokens of B share bytes with each token of A. A group begins where a token of
        A shares none with the token before. Ids of A by groups times groups by ids of B then give
        the links of tokens that share a group, counted by pair of ids.
        """
        spaced = [" " + c for c in new]
        a_ids = [e.ids for e in self.byte_bpe.encode_batch_fast(spaced, add_special_tokens=False)]
        b_ids = self.pieces.encode(new, num_threads=1)
        ids = [np.fromiter(chain.from_iterable(x), np.int64) for x in (a_ids, b_ids)]
        counts = [np.fromiter(map(len, x), np.int64, len(new)) for x in (a_ids, b_ids)]
        good = self.spelt(spaced, *ids, *counts)
        figures = np.zeros((len(new), 5), np.int64)
        right = np.flatnonzero(good)
        written = [""] * len(new)
        pairs = CSR(np.zeros(len(new) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(right):
            n_a, n_b = (c[right] for c in counts)
            a, b = (x[np.repeat(good, c)] for x, c in zip(ids, counts, strict=True))
            of_a, of_b = np.repeat(np.arange(len(right)), n_a), np.repeat(np.arange(len(right)), n_b)
            ends = np.concatenate([[0], np.cumsum(self.a_lengths[a])])
            ones = np.ones(ends[-1], np.int64)
            incidence = CSR(ends, np.arange(ends[-1]), ones)
            transposed = CSR(np.arange(ends[-1] + 1), np.repeat(np.arange(len(b)), self.b_lengths[b]), ones)
            overlap = incidence.times(transposed)
            first, last = overlap.columns[overlap.starts[:-1]], overlap.columns[overlap.starts[1:] - 1]
            begins = np.ones(len(a), bool)
            begins[1:] = first[1:] != last[:-1]
            group_a = np.cumsum(begins) - 1
            group_b = np.zeros(len(b), np.int64)
            group_b[overlap.columns] = group_a[overlap.rows]
            n_groups = int(group_a[-1]) + 1
            of_group = of_a[begins]
            # Equal ids within a group are one entry of the matrices, so a long group costs its different ids.
            rows, row_of = np.unique(of_a << 32 | a, return_inverse=True)
            ids_by_groups = CSR.of(row_of, group_a, np.ones(len(a), np.int64), len(rows))
            groups_by_ids = CSR.of(group_b, b, np.ones(len(b), np.int64), n_groups)
            shared = ids_by_groups.times(groups_by_ids)
            ids = rows[shared.rows]
            linked = CSR.of(ids >> 32, (ids & 0xFFFFFFFF) << self.b_bits | shared.columns, shared.values, len(right))
            lengths = np.zeros(len(new), np.int64)
            lengths[right] = np.diff(linked.starts)
            pairs = CSR(np.concatenate([[0], np.cumsum(lengths)]), linked.columns, linked.values)
            links = np.bincount(group_a, minlength=n_groups) * np.bincount(group_b, minlength=n_groups)
            by_chunk = lambda where, what: np.bincount(where, what, len(right)).astype(np.int64)
            overlaps = np.bincount(of_a[overlap.rows], minlength=len(right))
            figures[right] = np.stack([n_a, n_b, np.bincount(of_group, minlength=len(right)), _sums(of_group, links, len(right)), overlaps], axis=1)
            texts = self.written(a, b, group_a, group_b)
            edges = np.searchsorted(of_group, np.arange(len(right) + 1)).tolist()
            for k, i, j in zip(right.tolist(), edges, edges[1:], strict=False):
                written[k] = texts[i] if j == i + 1 else ";".join(texts[i:j])
        self.known.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.groups += written
        self.chars += sum(map(len, new)) + sum(map(len, written))
        self.figures, self.good = np.concatenate([self.figures, figures]), np.concatenate([self.good, good])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        starts = np.concatenate([self.links.starts, self.links.starts[-1] + pairs.starts[1:]])
        self.links = CSR(starts, np.concatenate([self.links.columns, pairs.columns]), np.concatenate([self.links.values, pairs.values]))

    def spelt(self, spaced: list[str], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Whether each chunk's tokens of A, and those of B, are its bytes."""
        said = [c.encode() for c in spaced]
        sizes = np.fromiter(map(len, said), np.int64, len(said))
        good = np.ones(len(said), bool)
        for ids, counts, table, lengths in ((a, n_a, self.a_bytes, self.a_lengths), (b, n_b, self.b_bytes, self.b_lengths)):
            ends = np.concatenate([[0], np.cumsum(counts)])
            spelt = np.concatenate([[0], np.cumsum(lengths[ids])])[ends]
            tokens = list(map(table.__getitem__, ids.tolist()))
            if not np.array_equal(np.diff(spelt), sizes) or b"".join(tokens) != b"".join(said):
                good &= [b"".join(tokens[i:j]) == w for i, j, w in zip(ends.tolist(), ends[1:].tolist(), said, strict=False)]
        return good

    def written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
        """Each group as its ids of A, a bar and its ids of B."""
        sides = []
        for ids, groups in ((a, group_a), (b, group_b)):
            names = list(map(str, ids.tolist()))
            edges = np.flatnonzero(np.diff(groups, prepend=-1, append=groups[-1] + 1)).tolist()
            sides.append([names[i] if j == i + 1 else ",".join(names[i:j]) for i, j in zip(edges, edges[1:], strict=False)])
        return list(map("|".join, zip(*sides, strict=True)))

    def align(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, CSR]:
        """Each text's groups written out, its figures (tokens of A, of B, groups, links, overlaps), and its links by pair."""
        self.make_room()
        parts = [self.parts(t) if t else [] for t in texts]
        if new := list(set().union(*parts).difference(self.known)):
            self.learn(new)
        kinds = [list(map(self.known.__getitem__, p)) for p in parts]
        # Where a chunk's tokens do not spell it, the text's own tokens decide: it is aligned in one piece.
        odd = [k for k, found in enumerate(kinds) if found and not self.good[found].all()]
        if new := list({texts[k] for k in odd}.difference(self.known)):
            self.learn(new)
        for k in odd:
            kinds[k] = [self.known[texts[k]]]
        counts = np.fromiter(map(len, kinds), np.int64, len(kinds))
        flat = np.fromiter(chain.from_iterable(kinds), np.int64, counts.sum())
        self.used += np.bincount(flat, minlength=len(self.used))
        uses = CSR.of(np.repeat(np.arange(len(texts)), counts), flat, np.ones(len(flat), np.int64), len(texts))
        figures = np.stack([_sums(uses.rows, self.figures[uses.columns, f] * uses.values, len(texts)) for f in range(5)], axis=1)
        groups = [";".join(map(self.groups.__getitem__, k)) for k in kinds]
        return groups, figures, uses.times(self.links)


def _sums(where: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place."""
    found = np.zeros(n, np.int64)
    np.add.at(found, where, what)
    return found


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(byte_vocabulary: str, piece_model: str) -> Aligner:
    """The vocabularies, read once in each Python worker."""
    key = byte_vocabulary, piece_model
    if key not in _LOADED:
        _LOADED[key] = Aligner(*key)
    return _LOADED[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts in slices of about SLICE code points, with the place of each slice's first."""
    at, held, chars = 0, [], 0
    for k, value in enumerate(texts):
        text = value.as_py()
        if held and chars + len(text or "") > SLICE:
            yield at, held
            at, held, chars = k, [], 0
        held.append(text)
        chars += len(text or "")
    if held:
        yield at, held


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def linked(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Aligns each text: id, the FIGURES, ``groups_sha256``, ``pairs`` and ``times``, and ``groups`` if kept.

    ``pairs`` has the different pairs of linked ids, ascending, as (A's id << bits) + B's id, with the bits that
    B's ids need; ``times`` how often each is linked. A narrow map: texts in slices, memory bounded by
    the longest text and by what is remembered of chunks.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = [f"`{id_col}` {id_type}", *(f"{f} long" for f in FIGURES), "groups_sha256 string", "pairs array<long>", "times array<long>"] + ["groups string"] * ("groups" in keep)
    names = [f.split(" ")[0].strip("`") for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(byte_vocabulary, piece_model)
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                groups, figures, links = aligner.align(texts)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                starts = pa.array(links.starts, pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int64())) for x in (links.columns, links.values)]
                columns = [batch.column(0).slice(at, len(texts)), *(pa.array(figures[:, f], pa.int64()) for f in range(len(FIGURES))), pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(groups, pa.string())] * ("groups" in keep), names=names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, ", ".join(fields))


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair`` and ``n``, the documents that hold it linked."""
    return links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def _least_frequent(counts: DataFrame, most: int) -> int:
    """The least count of frequent pairs: at most ``most`` pairs have it or more."""
    step = lambda n: F.floor(F.log2(n) * STEPS).cast("int")
    found = sorted(counts.groupBy(step(F.col("n")).alias("step")).agg(F.count("*").alias("m"), F.min("n").alias("n"), F.max("n").alias("top")).collect(), reverse=True)
    held, least = 0, None
    for _, m, n, top in found:
        if held + m > most:
            break
        held, least = held + m, n
    return least if least is not None else (found[0][3] + 1 if found else 1)


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """How two vocabularies share the bytes of each text.

    ``byte_vocabulary`` is a byte-level BPE of the tokenizers library (A), ``piece_model`` a sentencepiece
    model (B); both encode a space and the text, special tokens' strings as plain text. Byte offsets
    where tokens of both end cut the tokens into groups; each token of A is linked with each of B in its
    group. Returns id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_overlaps`` (pairs of tokens that
    share bytes), ``n_best`` (links whose pair of ids is held by as many documents as any pair of its A id),
    ``count_sum`` (documents that hold the pair, summed over links) and ``groups_sha256``; other columns
    are left out. A null or empty text, and one that its tokens do not spell, has no tokens: zeros and an
    empty digest. Each row is a document, also of a repeated or null id; an empty table gives none.

    The links of a document are counted by pair of ids and stored. Counts of the ``frequent`` most frequent
    pairs and the highest count of each A id (as many as the vocabulary has) go to every task; links
    of rarer pairs meet their counts in a join by pair, whose keys are rare by then.
    """
    links = stored(linked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), byte_vocabulary, piece_model, "id").withColumn(ROW, F.monotonically_increasing_id()))
    counts = stored(pair_counts(links))
    bits = _piece_bits(piece_model)
    highest = {a: n for a, n in counts.groupBy(F.shiftright("pair", bits).alias("a")).agg(F.max("n").alias("n")).collect()}
    top = np.zeros(max(highest, default=0) + 1, np.int64)
    top[list(highest)] = list(highest.values())
    least = _least_frequent(counts, frequent)
    often = counts.where(F.col("n") >= least).sort("pair").toPandas()
    sent = docs.sparkSession.sparkContext.broadcast((often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64), top))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            pairs, times = (batch.column(k) for k in (1, 2))
            starts = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            where = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            keys, m = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.searchsorted(known, keys)
            found = at < len(known)
            found[found] = known[at[found]] == keys[found]
            count = np.zeros(len(keys), np.int64)
            count[found] = n[at[found]]
            is_best = found & (count == best[keys >> bits])
            sums = [_sums(where, m * is_best, batch.num_rows), _sums(where, m * count, batch.num_rows)]
            rare = CSR.of(where[~found], keys[~found], m[~found], batch.num_rows)
            lists = [pa.ListArray.from_arrays(pa.array(rare.starts, pa.int32()), pa.array(x, pa.int64())) for x in (rare.columns, rare.values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s, pa.int64()) for s in sums), *lists], names=["row", "n_best", "count_sum", "rare", "rare_times"])

    scored = links.select(ROW, "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, rare array<long>, rare_times array<long>")
    scored = stored(scored)
    rare = scored.where("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("r")).select("row", F.col("r.rare").alias("pair"), F.col("r.rare_times").alias("m"))
    tops = counts.groupBy(F.shiftright("pair", bits).alias("a")).agg(F.max("n").alias("top"))
    # As many rows as the vocabulary of A has ids.
    rare = rare.join(counts.where(F.col("n") < least), "pair").withColumn("a", F.shiftright("pair", bits)).join(F.broadcast(tops), "a")
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("m")).otherwise(0)).alias("best"), F.sum(F.col("m") * F.col("n")).alias("sum"))
    whole = scored.drop("rare", "rare_times").join(sums, "row", "left")
    more = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    whole = whole.select(F.col("row").alias(ROW), more("n_best", F.col("best")), more("count_sum", F.col("sum")))
    found = links.drop("pairs", "times").join(whole, ROW)
    return found.select(F.col("id").alias(id_col), *FIGURES, "n_best", "count_sum", "groups_sha256")


def _piece_bits(piece_model: str) -> int:
    return max(1, (SentencePieceProcessor(model_file=piece_model).get_piece_size() - 1).bit_length())
