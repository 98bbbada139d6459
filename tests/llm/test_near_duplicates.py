import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from weblake.llm import blocks, embeddings, minhash
from weblake.llm.components import connected_components


def reached(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


UNWEIGHTED = minhash.Idf(np.zeros(0, np.uint64), np.zeros(0, np.float32), 1.0)


def windows(text):
    """Runs of five words and how often each occurs; a shorter text is one run."""
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    n = min(5, len(words))
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else Counter()


def brute_idf(sets):
    """1 + log(N / df) / log(N / least) of each run of words, counted over families."""
    hashed = lambda run: minhash.shingles(" ".join(run))[0][:1]
    hashes = {run: hashed(run) for s in sets for run in s}
    family = [minhash.family(min((hashes[run] for run in s), key=lambda h: int(h[0]))) for s in sets]
    having = defaultdict(set)
    for s, of in zip(sets, family, strict=True):
        for run in s:
            having[run].add(of)
    families, least = len(set(family)), max(1.0, sum(map(len, sets)) / minhash.FREQUENT)
    scale = math.log(families / least) if families > least else 1.0
    return {run: 1 + math.log(families / len(of)) / scale if len(of) > least else 2.0 for run, of in having.items()}


def brute_classes(texts):
    sets = {i: s for i, t in texts.items() if (s := windows(t))}
    idf = brute_idf(list(sets.values()))
    own = {i: sum(n * idf[run] for run, n in s.items()) for i, s in sets.items()}
    holders = defaultdict(list)
    for i in sorted(sets):
        for run in sets[i]:
            holders[run].append(i)
    common = defaultdict(float)
    for run, ids in holders.items():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += min(sets[a][run], sets[b][run]) * idf[run]
    links = [(a, b) for (a, b), both in common.items() if both >= (0.8 - minhash.ROUNDING) * (own[a] + own[b] - both)]
    return reached(texts, links)


def sample_texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = {0: None, 1: "", 2: "...", 3: "one two", 4: "One, two!", 5: "one two three"}
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.choice([8, 60, 300]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            edited = [rng.choice(vocabulary) if rng.random() < 0.01 else w for w in base]
            texts[len(texts)] = " ".join(edited)
    hot = rng.choices(vocabulary, k=200)
    for _ in range(150):
        copy = list(hot)
        copy[rng.randrange(200)] = rng.choice(vocabulary)
        texts[len(texts)] = " ".join(copy)
    for _ in range(40):
        texts[len(texts)] = " ".join(hot)
    texts[len(texts)] = " ".join(rng.choices(vocabulary, k=60_000))
    return texts


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    texts = sample_texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, words string, class_id int")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    expected = brute_classes(texts)
    assert {i: r.class_id for i, r in got.items()} == expected
    assert all(r.kept == (r.class_id == i) for i, r in got.items())
    assert expected[3] == expected[4] == 3 and expected[5] == 5 and len(set(expected.values())) < len(texts) - 150


@pytest.mark.parametrize("block", [2, 512])
def test_open_buckets_are_compared_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    words = [f"w{i}" for i in range(100)]
    texts = {i: " ".join(words[:i] + ["x"] + words[i:]) for i in (5, 30, 60, 90)} | {99: " ".join(words[::-1])}
    idf = spark.sparkContext.broadcast(UNWEIGHTED)
    same = np.zeros(minhash.SAMPLES, np.uint32).tobytes()
    rows = [(7, i, 5, 100, i, same, band, t) for i, t in texts.items() for band in (0, 3)]
    members = spark.createDataFrame(rows, "code long, id long, n long, size long, class long, codes binary, band int, text string")
    links = minhash._links_in_blocks(members.where("band = 0"), idf).collect()
    assert reached(texts, links) == {5: 5, 30: 5, 60: 5, 90: 5, 99: 99}
    assert minhash._links_in_blocks(members.where("band = 3"), idf).count() == 0


def test_overlaps_equal_pairwise_sums():
    rng = random.Random(4)
    sets = [minhash.shingles(" ".join(rng.choices("abcd", k=rng.randint(1, 400))))[:2] for _ in range(12)]
    seen = np.unique(np.concatenate([h for h, _ in sets]))
    idf = minhash.Idf(seen[::2], np.linspace(0.3, 1.2, len(seen[::2])).astype(np.float32), 2.0)
    both, own = minhash._overlaps(sets, idf)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                s = minhash.similarity((a[0], minhash.weights(*a, idf)), (b[0], minhash.weights(*b, idf)))
                assert abs(both[i, j] / (own[i] + own[j] - both[i, j]) - s) < 1e-5


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    agreed, similar = [], []
    for _ in range(60):
        h = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        w = rng.uniform(0.5, 3, len(h)).astype(np.float32)
        a, b = slice(0, 220), slice(40, 300)
        agreed.append((minhash.samples(h[a], w[a]) == minhash.samples(h[b], w[b])).mean())
        similar.append(minhash.similarity((h[a], w[a]), (h[b], w[b])))
    assert abs(np.mean(agreed) - np.mean(similar)) < 0.02


@pytest.mark.parametrize(("frequent", "gathered"), [(1 << 17, 1 << 21), (1 << 14, 3000), (1 << 13, 500)])
def test_idf_counts_families(spark, monkeypatch, frequent, gathered):
    rng = random.Random(8)
    say = lambda k: " ".join(rng.choices([f"w{i}" for i in range(3000)], k=k))
    common, seldom, family = say(30), say(30), say(200).split()
    texts = [f"{common if i % 4 else seldom} {say(40)}" for i in range(600)]
    for _ in range(300):
        copy = list(family)
        copy[rng.randrange(200)] = "edit" + str(rng.random())
        texts.append(" ".join(copy))
    monkeypatch.setattr(minhash, "FREQUENT", frequent)
    monkeypatch.setattr(minhash, "PASSED", 2 * frequent)
    monkeypatch.setattr(minhash, "GATHERED", gathered)
    texts += [None, "", "--"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    idf = minhash.learn_idf(docs)
    again = minhash.learn_idf(docs.repartition(2))
    assert (idf.hashes == again.hashes).all() and (idf.weights == again.weights).all() and len(idf.hashes) <= frequent
    expected = brute_idf([s for t in texts if (s := windows(t))])
    own = {run: minhash.shingles(" ".join(run))[0] for run in expected}
    got = idf.of(np.concatenate(list(own.values())))
    assert np.abs(got - np.array(list(expected.values()))).max() < 1e-6
    assert got.max() == 2 and 1 <= got.min() < 1.5 and len(set(got)) > 2
    assert idf.of(minhash.shingles(" ".join(family))[0]).min() > 1.2


def test_idf_of_nothing(spark):
    for texts in ([], [(None,), ("",)], [("one text of just a few words",)]):
        idf = minhash.learn_idf(spark.createDataFrame(texts, "text string"))
        assert len(idf.hashes) == 0 and (idf.of(np.arange(3, dtype=np.uint64)) == 2).all()


def test_near_duplicates_of_nothing_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect()} == {(1, 1), (None, None)}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 100)] + [(500, i) for i in range(501, 900)] + [(3, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == reached([*range(101), *range(500, 900)], links)


@pytest.mark.parametrize("block, cell, hot", [(1024, 1024, 1000), (7, 20, 1000), (7, 1024, 5), (1024, 9, 1000)])
def test_vectors_equal_brute_force(spark, monkeypatch, block, cell, hot):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell)
    monkeypatch.setattr(blocks, "HOT_ROWS", hot)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        x = centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])
        rows.append((i, [float(v) for v in x], i % 2))
    rows += [(400 + i, list(rows[5][1]), 1) for i in range(30)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [None] + [1.0] * 15, 1), (504, list(rows[5][1]), None), (505, [], 1), (506, rows[5][1][:8], 1), (None, list(rows[5][1]), 1), (None, None, 1), (507, [v * 1e-200 for v in rows[5][1]], 1), (508, [v * 1e200 for v in rows[5][1]], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    rows, lost = [r for r in rows if r[0] is not None], 2
    units = {}
    for i, v, label in rows:
        if label is None or not v or None in v or not np.isfinite(v).all() or not np.any(v):
            continue
        x = np.array(v) / np.abs(v).max()
        units[i] = label, x / np.linalg.norm(x)
    links = [(a, b) for a in units for b in units if a != b and units[a][0] == units[b][0] and len(units[a][1]) == len(units[b][1]) and units[a][1] @ units[b][1] >= 0.98]
    component = reached([r[0] for r in rows], links)
    got = embeddings.near_duplicate_vectors(df).collect()
    assert sum((r.vec_id, r.n_links, r.component_id, r.kept) == (None, 0, None, True) for r in got) == lost and len(got) == len(rows) + lost
    got = {r.vec_id: r for r in got if r.vec_id is not None}
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (sum(a == i for a, _ in links), component[i], component[i] == i)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_ids_must_be_numbers(spark):
    with pytest.raises(TypeError):
        minhash.near_duplicates(spark.createDataFrame([("x", "a b")], "doc_id string, text string"))
    with pytest.raises(TypeError):
        embeddings.near_duplicate_vectors(spark.createDataFrame([("x", [1.0], 1)], "vec_id string, embedding array<double>, label int"))
