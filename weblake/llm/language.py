"""Language identification by n-gram filters with a bit for each language."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblake.llm.storage import dropped, stored

#: Lengths of the n-grams, in characters; a blank stands for whatever is no letter.
SIZES = (3, 4)
#: About so many labelled texts of each language teach the filters.
SAMPLE_ROWS = 1500
#: A language holds an n-gram that makes up this share of its n-grams at least ...
LEAST_RATE = 2e-5
#: ... and this part of the n-gram's highest share in any language.
LEAST_RATIO = 0.4
PROBES = 3
BITS_PER_GRAM = 16
UNKNOWN = "und"
#: Texts are taken from a batch so many rows, and joined so many characters, at a time.
ROWS = 256
STEP_CHARS = 200_000

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams of some texts, the text of each, and which texts have a letter.

    Texts are lowered; an n-gram has letters inside and at its ends letters or blanks.
    """
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    letter = letters()[points]
    codes = np.where(letter, points, 32).astype(np.uint64)
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[letter]] = True
    hashes, owners = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        keep = letter[1 : 1 + m].copy()
        for k in range(2, n - 1):
            keep &= letter[k : k + m]
        at = np.flatnonzero(keep)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[at + k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        hashes.append(h)
        owners.append(owner[at])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), has_letter
    return np.concatenate(hashes), np.concatenate(owners), has_letter


def steps(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about STEP_CHARS characters, with the number of the first of each run."""
    run, chars, first = [], 0, 0
    for i, t in enumerate(texts):
        run.append(t or "")
        chars += len(run[-1])
        if chars >= STEP_CHARS:
            yield first, run
            run, chars, first = [], 0, i + 1
    if run:
        yield first, run


@dataclass
class LanguageFilters:
    """Bloom filters of all languages over the same positions: bit l of a position belongs to language l.

    The bits that all positions of an n-gram share are the languages that hold it. A language's false
    positive rate is the share of its bits that are set, to the power of the probes.
    """

    languages: list[str]
    table: np.ndarray
    false_positive: np.ndarray

    @classmethod
    def of(cls, held: list[tuple[str, int]]) -> LanguageFilters:
        by_language: dict[str, list[int]] = {}
        for language, gram in held:
            by_language.setdefault(language, []).append(gram)
        languages = sorted(by_language)
        words = max(1, -(-len(languages) // 64))
        kind = next(k for k, b in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64 * words)) if len(languages) <= b)
        positions = 1 << max(10, int(np.ceil(np.log2(max(1, len(held) * BITS_PER_GRAM // max(1, len(languages)))))))
        table = np.zeros((words, positions), kind)
        for number, language in enumerate(languages):
            at = cls.places(np.array(by_language[language], np.int64).view(np.uint64), positions)
            for p in at:
                table[number // 64, p] |= kind(1 << number % 64)
        filled = np.array([((table[i // 64] >> kind(i % 64)) & kind(1)).mean() for i in range(len(languages))])
        return cls(languages, table, filled**PROBES)

    @staticmethod
    def places(h: np.ndarray, positions: int) -> list[np.ndarray]:
        step = (h >> np.uint64(40)) | np.uint64(1)
        return [((h + np.uint64(k) * step) & np.uint64(positions - 1)).astype(np.int64) for k in range(PROBES)]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language whose corrected share of the text's n-grams is largest, and that share."""
        hashes, owner, has_letter = grams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        places = self.places(hashes, self.table.shape[1])
        masks = [row[places[0]] & row[places[1]] & row[places[2]] for row in self.table]
        shares = np.zeros((len(self.languages), len(texts)))
        for i, rate in enumerate(self.false_positive):
            mask = masks[i // 64]
            hits = np.bincount(owner, weights=(mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), minlength=len(texts))
            shares[i] = np.maximum(0, (hits - total * rate) / (max(1e-9, 1 - rate) * np.maximum(total, 1)))
        best = shares.argmax(axis=0) if len(self.languages) else np.zeros(len(texts), int)
        known = has_letter & bool(self.languages)
        score = np.clip(shares.max(axis=0), 0, 1) if len(self.languages) else np.zeros(len(texts))
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], list(np.where(known, score, 0.0))


def learn_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageFilters:
    """Filters of the languages of labelled texts; rows without text or language teach nothing.

    Texts are sampled by a hash of their id (without id, of the text), about ``sample_rows`` of each language and all of rarer
    ones, and read whole. An n-gram belongs to a language that has it at LEAST_RATE of its n-grams,
    so a language has 1 / LEAST_RATE of each length at most: that bounds what the driver gathers and
    what is broadcast, whatever the input's size.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageFilters.of([])
    part = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_rows / n))))
    rows = rows.where(F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("text"))), F.lit(1 << 20)) < part[F.col("lang")] * (1 << 20))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                texts, langs = (c.to_pylist() for c in batch.slice(i, ROWS).columns)
                for name in sorted(set(langs)):
                    own = [t for t, x in zip(texts, langs, strict=True) if x == name]
                    parts = [np.unique(grams(run)[0], return_counts=True) for _, run in steps(own)]
                    found, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = F.create_map(*(F.lit(x) for pair in totals.items() for x in pair))
    common = counts.withColumn("rate", F.col("n") / total[F.col("lang")]).where(F.col("rate") >= LEAST_RATE).select("lang", "gram", "rate").collect()
    dropped(counts)
    top: dict[int, float] = {}
    for _, gram, rate in common:
        top[gram] = max(rate, top.get(gram, 0))
    return LanguageFilters.of([(lang, gram) for lang, gram, rate in common if rate >= LEAST_RATIO * top[gram]])


def identify_languages(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Predicts each text's language: id, the columns named in ``keep``, lang_pred and score (or ``names``).

    lang_pred is ``und`` with score 0 where the text is null or has no letter, or nothing was learned;
    ties go to the language that sorts first; rows of repeated ids are each judged by their text. score (0 to 1) is the share of the text's n-grams that
    the language holds, corrected for false positives. A narrow map over whole texts.
    """
    known = docs.sparkSession.sparkContext.broadcast(filters)
    # The text goes to the tasks once, also where it is kept.
    columns = docs.select(F.col(id_col), *keep, *([] if text_col in keep else [F.col(text_col)]))
    at_text = columns.columns.index(text_col)
    fields = columns.schema.fields[: 1 + len(keep)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                langs, scores = [], []
                for _, texts in steps(part.column(at_text).to_pylist()):
                    a, b = known.value.predict(texts)
                    langs += a
                    scores += b
                yield pa.RecordBatch.from_arrays([*part.columns[: len(fields)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in fields), *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return columns.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double")


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that no filter may learn from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2
