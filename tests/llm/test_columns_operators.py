import hashlib
import math
import random
import re
import time
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weblake.llm import mixing, personal, quality, sharding
from weblake.llm.queries_columns import op5_personal_data, op9_minimax_shards

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, spans string, words int, rank int"


def docs_of(spark, texts, source=None):
    rows = [(i, t, None, source, None, None, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def brute_spans(text):
    t = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


def checked_personal(rows):
    for text, r in rows:
        base = brute_spans(text)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert set(base) <= set(r.spans.split(",")) | {""}
        n = Counter(x.split(":")[0] for x in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in ("email", "ip", "card", "phone"))


def test_personal_data_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    checked_personal((texts[r.doc_id], r) for r in op5_personal_data(spark, sf_dir).collect())


def test_personal_data_edges(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "a@b.c_x@d.e", "x@y.z.", "😀 é a.b+c@d-e.f-g 😀", "1.2.3.4.5.6.7.8", "000255.0.0.1 256.1.1.1 1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (386) 555-3733 +1 (386) 555-3733", "@" * 50, "a" * 100_000, "7" * 50_000, "+1 " * 3000, "a@" + ".b" * 20_000, "a@b" + ".c" * 20_000]
    texts += ["".join(rng.choice("a.@1+-4 (8)é😀_%") for _ in range(300)) for _ in range(300)]
    texts += ["x a@b.co " * 3000]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    checked_personal((texts[r.doc_id], r) for r in op5_personal_data(spark, str(tmp_path)).collect())


def test_added_personal_data(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "IBAN DE89 3704 0044 0532 0130 01.", "call 212-555-0123 now", "212-555-0123", "SSN 123-45-6789"]
    got = {r.doc_id: [s.kind for s in r.spans] for r in personal.find_personal_data(docs_of(spark, texts)).collect()}
    assert got == {0: ["iban"], 1: [], 2: ["tel"], 3: [], 4: ["ssn"]}


def test_long_texts_full_of_personal_data(spark):
    part = "ab@cd.ef call 212-555-0123 "
    started = time.monotonic()
    (row,) = personal.find_personal_data(docs_of(spark, [part * 30_000])).select(F.size("spans").alias("n"), F.expr("size(filter(spans, s -> s.kind = 'tel'))").alias("tel")).collect()
    assert (row.n, row.tel) == (60_000, 30_000) and time.monotonic() - started < 90


def test_added_spans_give_way_to_base_spans(spark):
    rng = random.Random(3)
    parts = ["212-555-0123", "+1 212-555-0123", "123-45-6789", "a@b.co", "call", "ssn", "1.2.3.4", "4111 1111 1111 1111", "x", "+123-45-6789 99", "212-555-0123@b.co"]
    texts = [rng.choice(" ,;").join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    base = {k.name for k in personal.KINDS if k.base}
    whole = {r.doc_id: r.spans for r in personal.find_personal_data(docs_of(spark, texts)).collect()}
    added = {r.doc_id: r.spans for r in personal.find_personal_data(docs_of(spark, texts), kinds=tuple(k for k in personal.KINDS if not k.base)).collect()}
    n = 0
    for i in range(len(texts)):
        based = [(s.start, s.end) for s in whole[i] if s.kind in base]
        clear = {(s.kind, s.start, s.end) for s in added[i] if not any(s.start < b and a < s.end for a, b in based)}
        assert {(s.kind, s.start, s.end) for s in whole[i] if s.kind not in base} == clear
        n += len(added[i]) - len(clear)
    assert n > 20


def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated)


def test_quality_equals_brute_force_and_edges(spark, sf_dir):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "a", "a a", "a a a a", "the\x0bof\x1cand x", "w " * 30_000, "😀# é|\nx\nx\n \nx"]
    texts += [" ".join(rng.choice("ab c\n d") for _ in range(80)) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for r in quality.quality_rules(docs_of(spark, texts)).collect():
        b = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and (not r.base_failed or not r.kept)
    assert quality.quality_rules(docs_of(spark, [])).count() == 0


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("kind", ["plain", "hot", "few", "none"])
def test_shards_are_minimax(spark, kind):
    rng = random.Random(kind)
    texts = {"plain": [str(rng.random()) * rng.randint(1, 50) for _ in range(3000)], "hot": ["same text " * 9] * 700 + [str(rng.random()) for _ in range(900)], "few": [None, "", "é", "é"], "none": []}[kind]
    docs = docs_of(spark, texts)
    rows = sharding.shard(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    keys = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()}
    groups, loads, slots = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
        groups[keys[r.doc_id]] += r.size
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(keys[r.doc_id], r.shard) for r in rows}) == len(groups)
    if texts:
        assert max(loads.values()) == brute_capacity([groups[k] for k in sorted(groups)], 8)


def test_shard_query(spark, sf_dir):
    rows = op9_minimax_shards(spark, sf_dir).collect()
    assert {r.law for r in rows} == {"bytes"} and {r.shard for r in rows} == set(range(8))


def brute_mix(blocks, units):
    """The blocks in order, each (source, number), and each source's fluid at each slot, in exact fractions."""
    sources = sorted(blocks)

    def time(v):
        return sum(min(units[q] * v, Fraction(blocks[q])) for q in sources)

    windows = {(s, i): (math.floor(time(Fraction(i, units[s]))), math.ceil(time(Fraction(i + 1, units[s])))) for s in sources for i in range(blocks[s])}
    order, done = [], Counter()
    for t in range(sum(blocks.values())):
        ready = [(windows[s, done[s]][1], s) for s in sources if done[s] < blocks[s] and windows[s, done[s]][0] <= t]
        deadline, s = min(ready)
        assert t < deadline
        order.append((s, done[s]))
        done[s] += 1
    return order, windows


def fluids(blocks, weights, slots):
    """Blocks of each source that have flowed at the weights by each slot, as floats."""
    done, left = dict.fromkeys(blocks, 0.0), [s for s in blocks if blocks[s]]
    out = [dict(done)]
    for _ in range(slots):
        room = 1.0
        while room > 1e-12 and left:
            total = sum(weights[s] for s in left)
            step = min([room, *((blocks[s] - done[s]) * total / weights[s] for s in left)])
            for s in left:
                done[s] += step * weights[s] / total
            room -= step
            left = [s for s in left if blocks[s] - done[s] > 1e-9]
        out.append(dict(done))
    return out


MIXES = [
    ({"s0": 4000, "s1": 900, "s2": 333, "": 40}, None, 2),
    ({"s0": 4000, "s1": 900, "s2": 333, "": 40}, {"s0": 3.0, "s1": 1.0, "s2": 2.0}, 2),
    ({"a": 2500, "b": 2000}, {"a": 0.55555, "b": 0.44445}, 1),
    ({"a": 3000, "b": 20}, {"a": 0.9999, "b": 0.0001}, 1),
    ({f"s{i:02}": 7 + i * i % 90 for i in range(60)}, {f"s{i:02}": 1 / (i + 1) for i in range(60)}, 1),
    ({"one": 70}, None, 32),
]


@pytest.mark.parametrize("n, weights, rows_each", MIXES)
def test_mix_equals_brute_force_and_stays_within_a_block_of_the_target(spark, n, weights, rows_each):
    rows = [(i, s or None, None) for i, s in enumerate(s for s, k in n.items() for _ in range(k))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, position string")
    got = mixing.mix_order(docs, weights, block_rows=rows_each).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    blocks = {s: -(-k // rows_each) for s, k in n.items()}
    weights = {s: weights.get(s, min(weights.values())) if weights else k**0.5 for s, k in n.items()}
    total = sum(weights[s] for s in sorted(weights))
    order, windows = brute_mix(blocks, {s: round(w / total * mixing.SCALE) for s, w in weights.items()})
    assert {(r.position, r.source, r.block) for r in got} == {(p, *b) for p, b in enumerate(order)}
    assert all((r.release, r.deadline) == windows[r.source, r.block] for r in got)
    digests = {}
    for r in sorted(got, key=lambda r: (r.position, r.offset)):
        digests.setdefault(r.source, []).append(hashlib.md5(str(r.doc_id).encode()).hexdigest())
    assert all(d == sorted(d) for d in digests.values())
    done = Counter()
    for p, target in enumerate(fluids(blocks, weights, len(order))):
        assert all(abs(done[s] - target[s]) < 1 + 1e-6 for s in n), p
        if p < len(order):
            done[order[p][0]] += 1


def test_large_mixes_have_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    monkeypatch.setattr(mixing, "CHUNK", 16)
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(2000)], "doc_id long, source string")
    got = mixing.mix_order(docs, block_rows=2).collect()
    assert max(r.offset for r in got) == 39 and len(got) == 2000
    assert {r.position for r in got} == set(range(34 + 17))


def test_mix_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a")] * 40 + [(None, "b")] * 9 + [(2, None)] * 3, "doc_id long, source string")
    got = mixing.mix_order(docs, block_rows=4).collect()
    assert Counter((r.doc_id, r.source) for r in got) == {(1, "a"): 40, (None, "b"): 9, (2, ""): 3}
    assert len({(r.position, r.offset) for r in got}) == 52
    with pytest.raises(ValueError):
        mixing.mix_order(docs, {"a": 0.0})


def test_mixed_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "x") for i in range(50)], "doc_id long, source string, `offset` string")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sorted(out.collect()) == sorted(docs.collect())
    assert mixing.mix_order(docs.limit(0)).count() == 0
