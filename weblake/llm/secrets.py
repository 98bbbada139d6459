"""Secret scans: patterns, and the token-efficiency test for random strings."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
MASK = "[SECRET]"

WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: A run of these characters, this long, is put to the token-efficiency test.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Characters per token at or below which a run counts as random.
MOST_CHARS_PER_TOKEN = 2.0
#: Runs are tokenized in windows of this many characters.
WINDOW = 512
# Known digests and identifiers: hexadecimal digests of usual lengths, UUIDs, and names or paths made of words.
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
# Atomic groups: a part of a name is never split again, so the test is linear.
IDENTIFIER = re.compile(r"(?>[-_/=+]*(?>[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|[0-9]{1,4}))++")

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The tiktoken vocabulary of a rank file, read once in each Python worker."""
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def chars_per_token(run: str, enc: tiktoken.Encoding) -> float:
    return len(run) / sum(len(enc.encode_ordinary(run[i : i + WINDOW])) for i in range(0, len(run), WINDOW))


def looks_random(run: str, enc: tiktoken.Encoding) -> bool:
    """Mixed characters that are no known digest or identifier and that the vocabulary compresses badly."""
    mixed = any(c.isdigit() for c in run) and any(c.isalpha() for c in run) or sum(a.islower() and b.isupper() for a, b in zip(run, run[1:], strict=False)) >= 3
    if not mixed or UUID.fullmatch(run) or (len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run)) or IDENTIFIER.fullmatch(run):
        return False
    return chars_per_token(run, enc) <= MOST_CHARS_PER_TOKEN


def spans_of(text: str | None, enc: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of each secret, sorted."""
    if not text:
        return []
    found = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    # Base spans and candidates are walked side by side: ``far`` is the farthest end of base spans that start before.
    base, k, far = sorted((a, b) for a, _, b in found), 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            far = max(far, base[k][1])
            k += 1
        if far <= m.start() and looks_random(m[0], enc):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with MASK in place of each span; spans that touch or overlap become one."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], "" if at and start == at else MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str, mask: bool) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    names = docs.columns
    at_text = names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(at_text).to_pylist()
                found = [spans_of(t, enc) for t in texts]
                if mask:
                    kept = [t if not s else masked(t, s) for t, s in zip(texts, found, strict=True)]
                    yield part.set_column(at_text, part.schema.field(at_text), pa.array(kept, part.schema.field(at_text).type))
                else:
                    spans = [[{"start": a, "rank": k, "end": b, "kind": KINDS[k]} for a, k, b in s] for s in found]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, span)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = docs.schema if mask else f"`{id_col}` {kind}, spans array<struct<start:int,rank:int,end:int,kind:string>>"
    return docs.mapInArrow(run, schema)


def find_secrets(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds secrets in each text: id and ``spans``, array of struct(start, rank, end, kind).

    Spans are sorted by start, then by the order of KINDS; places are code points, end exclusive.
    ``random`` spans come from the token-efficiency test and never overlap the others. A null or empty
    text has an empty array; equal texts, and rows of repeated ids, each have their spans; other input columns are left out. ``vocabulary`` is a tiktoken rank file
    that every executor can read, ``pattern`` its splitting pattern. A narrow map, a few texts at a
    time.
    """
    return _mapped(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, vocabulary, pattern, False)


def mask_secrets(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all rows and columns; each secret in the text is replaced by MASK."""
    return _mapped(docs, id_col, text_col, vocabulary, pattern, True)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
