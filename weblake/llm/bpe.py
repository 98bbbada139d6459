"""BPE encoding and decoding with forced cuts."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Words, and chunks of text, that a task remembers in each of two generations: the younger takes the older's place once full.
REMEMBERED = 125_000
#: Longer words are not remembered, and merged by a heap.
SHORT = 64
SUFFIX = "</w>"
#: Two ids, or a rank and an id, as one number: ids need fewer bits than these.
BITS = 24
LOW = (1 << BITS) - 1
NONE = 1 << 60
#: The first code point without a meaning in any version of Unicode so far.
FIRST_UNASSIGNED = "\u0378"


def byte_letters() -> list[str]:
    """The printable letter for each byte: itself if it is printable in Latin-1, else the next from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def _unassigned() -> list[tuple[int, int]]:
    """Ranges of code points without a meaning in Python's Unicode tables."""
    ranges: list[tuple[int, int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1] = ranges[-1][0], c
            else:
                ranges.append((c, c))
    return ranges


class ForcedCutBPE(dict):
    """A word-level BPE vocabulary whose words are cut where no token can span.

    A pair of neighbouring letters that no token of the vocabulary holds can never end up in one
    token, so no merge crosses it and the parts on either side merge independently. Each word is cut
    at all such pairs, its fragments are encoded alone, and their ids are joined.
    As a mapping it remembers, for each chunk of text without white space, its ids and tokens.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        #: For two ids the rank of their merge and the id it makes, both as one number.
        self.merges: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.merges[self.ids[left] << BITS | self.ids[right]] = rank << BITS | self.ids[left + right]
        #: The merges of two letters, by these letters.
        self.first_merges = {self.tokens[m >> BITS] + self.tokens[m & LOW]: made for m, made in self.merges.items() if len(self.tokens[m >> BITS] + self.tokens[m & LOW]) == 2}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letters = byte_letters()
        self.joinable = {t[k : k + 2] for token in self.ids for t in [token.removesuffix(SUFFIX)] for k in range(len(t) - 1)}
        self.known: dict[str, tuple[str, str]] = {}
        self.older_words: dict[str, tuple[str, str]] = {}
        self.older_chunks: dict[str, tuple[str, str]] = {}
        self.white = regex.compile(r"\s+")
        self.newer = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _unassigned()) + "]")
        self.library = Tokenizer.from_file(path)

    def fragment(self, letters: str, last: bool) -> list[int]:
        """Ids of a fragment: merges by rank, leftmost first."""
        parts = list(map(self.ids.__getitem__, letters))
        if last:
            parts[-1] = self.ids[letters[-1] + SUFFIX]
        if len(parts) > SHORT:
            return self.long_fragment(parts)
        merge = self.merges.get
        pairs = list(map(self.first_merges.get, map(add, letters, letters[1:]), repeat(NONE)))
        if last and pairs:
            pairs[-1] = merge(parts[-2] << BITS | parts[-1], NONE)
        while pairs and (least := min(pairs)) != NONE:
            i = pairs.index(least)
            new = least & LOW
            parts[i : i + 2] = [new]
            del pairs[i]
            if i:
                pairs[i - 1] = merge(parts[i - 1] << BITS | new, NONE)
            if i < len(pairs):
                pairs[i] = merge(new << BITS | parts[i + 1], NONE)
        return parts

    def long_fragment(self, parts: list[int]) -> list[int]:
        """The same by a heap, in O(n log n)."""
        n, gone = len(parts), -1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (m := self.merges.get(a << BITS | b)) is not None]
        heapq.heapify(heap)
        while heap:
            least, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = least & LOW, gone
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (m := self.merges.get(parts[x] << BITS | parts[y])) is not None:
                    heapq.heappush(heap, (m, x, parts[x], parts[y]))
        return [p for p in parts if p != gone]

    def word(self, letters: str) -> tuple[str, str]:
        """Ids and tokens of a word in byte letters, each joined by spaces: cut, encoded by fragment, joined."""
        found = self.known.get(letters)
        if found is not None:
            return found
        found = self.older_words.get(letters)
        if found is None:
            if self.joinable.issuperset(map(add, letters, letters[1:])):
                ids = self.fragment(letters, True)
            else:
                cuts = [0, *(k for k in range(1, len(letters)) if letters[k - 1 : k + 1] not in self.joinable)]
                ids = [i for a, b in zip(cuts, cuts[1:], strict=False) for i in self.fragment(letters[a:b], False)] + self.fragment(letters[cuts[-1] :], True)
            found = self.written(ids)
        if len(self.known) >= REMEMBERED:
            self.older_words, self.known = self.known, {}
        if len(letters) <= SHORT:
            self.known[letters] = found
        return found

    def written(self, ids: list[int]) -> tuple[str, str]:
        if len(ids) == 1:
            return str(ids[0]), self.tokens[ids[0]]
        return " ".join(map(str, ids)), " ".join(map(self.tokens.__getitem__, ids))

    def words_of(self, chunk: str) -> list[str]:
        """The words of a chunk without white space, in byte letters."""
        if chunk.isascii():
            # Byte letters of printable ASCII are the characters themselves.
            lower = chunk.lower()
            if lower.isalpha():
                return [lower]
            if lower[:-1].isalpha() and lower[-1] in ".,;:!?":
                return [lower[:-1], lower[-1]]
            if lower.isprintable():
                return self.words.findall(lower)
        elif max(chunk) >= FIRST_UNASSIGNED and self.newer.search(chunk):
            # Characters younger than Python's own tables: the library's tables split and lower them.
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
            return [w for w, _ in words]
        # Letters are lowered one by one, so a final capital sigma gets no form of its own.
        plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return ["".join([self.letters[b] for b in w.encode("utf-8")]) for w in self.words.findall(plain)]

    def __missing__(self, chunk: str) -> tuple[str, str]:
        """Ids and tokens of a chunk of text, each joined by spaces."""
        found = self.older_chunks.get(chunk)
        if found is None:
            if chunk in self.special:
                found = self.written([self.special[chunk]])
            else:
                words = [self.word(w) for w in self.words_of(chunk)]
                found = words[0] if len(words) == 1 else (" ".join([w[0] for w in words]), " ".join([w[1] for w in words]))
        if len(self) >= REMEMBERED:
            self.older_chunks = dict(self)
            self.clear()
        if len(chunk) <= SHORT:
            self[chunk] = found
        return found

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space and around special tokens: no word crosses these."""
        if any(s in text for s in self.special):
            return [c for k, part in enumerate(self.specials.split(text)) for c in ([part] if k % 2 else self.chunks(part))]
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
            return [c for c in self.white.split(text) if c]
        return text.split()

    def encoded(self, text: str | None) -> tuple[str, str]:
        """Ids and tokens of a text, each joined by spaces."""
        found = list(map(self.__getitem__, self.chunks(text or "")))
        if ("", "") in found:
            found = [f for f in found if f[0]]
        ids, tokens = zip(*found, strict=True) if found else ((), ())
        return " ".join(ids), " ".join(tokens)


_LOADED: dict[str, ForcedCutBPE] = {}


def loaded(path: str) -> ForcedCutBPE:
    """The vocabulary, read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ForcedCutBPE(path)
    return _LOADED[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "decoded"), carry: tuple[str, ...] = ()) -> DataFrame:
    """Encodes each text and decodes the ids again.

    Returns id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 and, if
    kept, ``ids`` (array of int) and ``decoded``; of other input columns, those of ``carry``. A null
    text counts as empty: no ids. Texts are encoded one at a time in a narrow map, so memory is bounded by the
    longest text; every executor reads the vocabulary file at ``vocabulary``. The decoded text joins
    the tokens by a space, as a vocabulary without a decoder does.
    """
    id_type = docs.schema[id_col].dataType
    fields = [f"`{id_col}` {id_type.simpleString()}", "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    fields += ["ids array<int>"] * ("ids" in keep) + ["decoded string"] * ("decoded" in keep)
    fields += [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        # Encoding makes no cycles: collecting them would only walk what is remembered, again and again.
        gc.disable()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    counts, id_sums, decoded_sums, ids, decoded = [], [], [], [], []
                    for text in part.column(1):
                        joined, tokens = bpe.encoded(text.as_py())
                        counts.append(joined.count(" ") + (joined != ""))
                        id_sums.append(hashlib.sha256(joined.encode("ascii")).hexdigest())
                        decoded_sums.append(hashlib.sha256(tokens.encode("utf-8")).hexdigest())
                        if "ids" in keep:
                            ids.append(np.fromstring(joined, dtype=np.int32, sep=" "))
                        if "decoded" in keep:
                            decoded.append(tokens)
                    columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(decoded_sums, pa.string())]
                    columns += [pa.array(ids, pa.list_(pa.int32()))] * ("ids" in keep) + [pa.array(decoded, pa.string())] * ("decoded" in keep) + part.columns[2:]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.rsplit(" ", 1)[0].strip("`") for f in fields])
        finally:
            gc.enable()

    return docs.select(F.col(id_col), F.col(text_col), *carry).mapInArrow(run, ", ".join(fields))
