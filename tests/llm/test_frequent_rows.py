"""Rows that the count of frequent shingles passes on: as many as chunks and ranges, not as shingles."""

from collections import Counter

import numpy as np

from weblake.llm import minhash


def test_small_partitions_pass_on_arrays(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 7 + j * j) % 501}" for j in range(60)) for i in range(400)] + ["the same six words once more"] * 40 + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(60)
    passed = []
    monkeypatch.setattr(minhash, "stored", lambda df: passed.append(df.persist()) or passed[0])
    monkeypatch.setattr(minhash, "dropped", lambda *frames: None)
    found, least = minhash._frequent(docs, "text")
    exact = Counter(int(h) for t in texts for h in minhash.shingles(t)[0])
    assert least == 1.0 and found.tolist() == sorted(h for h, n in exact.items() if n > 1)
    assert passed[0].count() <= 32 * (minhash.RANGES + 1) < len(exact)
    assert found.dtype == np.uint64
