import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from weblake.llm import alignment
from weblake.llm.queries_models import BYTE_BPE, PIECE_BPE

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups_sha256"]


def letter_of_byte():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECE_BPE), letter_of_byte()


def groups_by_hand(libraries, text):
    """Lists of (A ids, B ids, overlaps), from whole texts and loops over bytes."""
    a, b, letters = libraries
    if not text:
        return []
    said = (" " + text).encode()
    spans = []
    for ids, spelt in (
        ((x := a.encode(" " + text, add_special_tokens=False).ids), [bytes(letters[c] for c in a.id_to_token(i)) for i in x]),
        ((y := b.encode(text)), [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]),
    ):
        if b"".join(spelt) != said:
            return []
        at, side = 0, []
        for i, t in zip(ids, spelt, strict=True):
            side.append((i, at, at + len(t)))
            at += len(t)
        spans.append(side)
    ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    out, lo = [], 0
    for e in ends:
        x, y = ([s for s in side if lo <= s[1] and s[2] <= e] for side in spans)
        out.append(([s[0] for s in x], [s[0] for s in y], sum(p[1] < q[2] and q[1] < p[2] for p in x for q in y)))
        lo = e
    return out


def by_hand(libraries, rows):
    found = [(i, groups_by_hand(libraries, t)) for i, t in rows]
    links = [Counter((p, q) for a, b, _ in gs for p in a for q in b) for _, gs in found]
    held = Counter(pair for c in links for pair in c)
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for (i, gs), c in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in gs)
        out.append((
            i, sum(len(a) for a, _, _ in gs), sum(len(b) for _, b, _ in gs), len(gs), sum(c.values()), sum(o for _, _, o in gs),
            sum(n for (p, q), n in c.items() if held[p, q] == best[p]), sum(n * held[pair] for pair, n in c.items()),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return sorted(out, key=repr)


TEXTS = [
    None, "", " ", "\n", "a", "Hello world.", "  two  spaces here ", "tab\there \n\n new line", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b and ▁ c", "naïve Ärger größer ß ǅ",
    "é ﬁ Ⅳ １２ ½", "日本語のテキスト です", "\U0001f600\U0001f468‍\U0001f469 ok", " x   y　z", "\x00 \x1c a \x1f b \x85 c", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40, "don't we'll I'm 's",
    "x" * 5000, "12345 67890 1,234.56", "word " * 300, "word " * 300, "퟿� \U0010ffff",
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p", 2) for i, t in rows], "doc_id long, text string, id long, pair string, row long")


@pytest.mark.parametrize("frequent", [1 << 19, 40, 0])
def test_alignment_equals_loops_over_bytes(spark, libraries, frequent):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "Hello again world."), (3, "Hello again world."), (3, "Hello again world.")]
    found = alignment.align(table(spark, rows).repartition(3), BYTE_BPE, PIECE_BPE, frequent=frequent)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=repr) == by_hand(libraries, rows)


def test_documents_equal_loops_over_bytes(spark, libraries, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    expected = by_hand(libraries, rows)
    for frequent in (1 << 19, 500):
        assert sorted(map(tuple, alignment.align(docs, BYTE_BPE, PIECE_BPE, frequent=frequent).collect()), key=repr) == expected


def test_empty_table(spark):
    assert alignment.align(table(spark, []), BYTE_BPE, PIECE_BPE).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t 　\x1cab's.1▁é"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=5))
def test_texts_in_chunks_equal_whole_texts(texts):
    a = Tokenizer.from_file(BYTE_BPE) if not hasattr(test_texts_in_chunks_equal_whole_texts, "held") else None
    if a is not None:
        a.encode_special_tokens = True
        test_texts_in_chunks_equal_whole_texts.held = (a, SentencePieceProcessor(model_file=PIECE_BPE), letter_of_byte())
    libraries = test_texts_in_chunks_equal_whole_texts.held
    groups, figures, links = alignment.loaded(BYTE_BPE, PIECE_BPE).align(texts)
    for k, t in enumerate(texts):
        hand = groups_by_hand(libraries, t)
        assert groups[k] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in hand)
        assert figures[k].tolist() == [sum(len(x) for x, _, _ in hand), sum(len(y) for _, y, _ in hand), len(hand), sum(len(x) * len(y) for x, y, _ in hand), sum(o for _, _, o in hand)]


def test_products_by_rows_equal_dense_products():
    random.seed(3)
    for _ in range(50):
        n, m, k = (random.randint(1, 9) for _ in range(3))
        x, y = np.random.default_rng(_).integers(0, 3, (n, m)), np.random.default_rng(_ + 99).integers(0, 3, (m, k))
        sparse = [alignment.CSR.of(*np.nonzero(z), z[np.nonzero(z)], len(z)) for z in (x, y)]
        product = sparse[0].times(sparse[1])
        dense = np.zeros((n, k), int)
        dense[product.rows, product.columns] = product.values
        assert (dense == x @ y).all() and len(product.starts) == n + 1
